"""Every query of the engine against its DuckDB text on the smallest tables, and golden cases of the contact rules."""

import duckdb
import pytest

from tallyfold.functions import contacts as C
from tallyfold.functions.dialect import Spark
from tallyfold.functions.rules import STRICT
from tallyfold.plans import base, registry
from tallyfold.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def same(rows):
    return sorted(tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_duckdb(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.sql(registry.oracle_sql()[name])
    at = [list(found.columns).index(c) for c in cols]
    assert same(tuple(r[c] for c in cols) for r in df.collect()) == same(tuple(r[i] for i in at) for r in found.fetchall())


def test_flagship_has_rows(spark):
    assert registry.flagship(spark, SF).count() == 50


GOLDEN = [
    ("Info@Acmefix.com", "info@acmefix.com", "ok"),
    ("mailto:sales@acmefix.com?subject=x", "sales@acmefix.com", "ok"),
    ("info@acmefix.com.", "info@acmefix.com", "ok"),
    ("user%2Btag@acmefix.com", "user+tag@acmefix.com", "ok"),
    ("info@www.acmefix.com", "info@www.acmefix.com", "ok"),
    ("owner@proton.me", "owner@proton.me", "ok"),
    ("", "", "empty"),
    ("noreply@acmefix.com", "noreply@acmefix.com", "blocked_pattern"),
    ("bob.jsmith@acmefix.com", "bob.jsmith@acmefix.com", "blocked_pattern"),
    ("a@b@acmefix.com", "a@b@acmefix.com", "malformed"),
    ("hello@linkedin.com", "hello@linkedin.com", "blocked_domain"),
    ("bob@mail.acmefix.com", "bob@mail.acmefix.com", "subdomain"),
    ("bob@x.com", "bob@x.com", "short_root"),
    ("-bob@acmefix.com", "-bob@acmefix.com", "local_len_edge"),
    ("a@acmefix.com", "a@acmefix.com", "local_short"),
    ("a..b@acmefix.com", "a..b@acmefix.com", "local_chars"),
    ("cdn.bob@acmefix.com", "cdn.bob@acmefix.com", "asset_prefix"),
    ("static@acmefix.com", "static@acmefix.com", "asset_local"),
    ("info@-acmefix.com", "info@-acmefix.com", "domain_shape"),
    ("info@1-847.com", "info@1-847.com", "phone_like"),
    ("info@acme_fix.com", "info@acme_fix.com", "label_shape"),
    ("info@a1b2c3d4e5.com", "info@a1b2c3d4e5.com", "many_digits"),
    ("info@acmefix.c0m", "info@acmefix.c0m", "tld_shape"),
    ("info@acmefix.io", "info@acmefix.io", "tld_not_allowed"),
    ("info@acmefix.co.uk", "info@acmefix.co.uk", "tld_not_allowed"),
]


def test_email_golden(spark):
    d = Spark()
    rows = spark.createDataFrame([(i, raw) for i, (raw, _, _) in enumerate(GOLDEN)], "i int, raw string")
    rows.createOrReplaceTempView("golden_raw")
    rows = spark.sql(f"SELECT i, {C.email(d, 'raw')} AS email FROM golden_raw").collect()
    spark.createDataFrame(rows).createOrReplaceTempView("golden_email")
    found = {r.i: (r.email, r.v) for r in spark.sql(f"SELECT i, email, {C.verdict(d, 'email', STRICT)} AS v FROM ({C.email_parts(d, 'golden_email', 'email', STRICT)}) p").collect()}
    assert found == {i: (e, v) for i, (_, e, v) in enumerate(GOLDEN)}


@pytest.mark.parametrize(
    ("url", "host", "reg"),
    [("HTTP://User@WWW.Acmefix.com:8080/x", "acmefix.com", "acmefix.com"), ("shop.acmefix.com", "shop.acmefix.com", "acmefix.com"), ("www.acmefix.co.uk", "acmefix.co.uk", "acmefix.co.uk"), ("localhost", "localhost", "localhost"), ("", "", "")],
)
def test_domains_golden(spark, url, host, reg):
    spark.createDataFrame([(url,)], "u string").createOrReplaceTempView("golden_url")
    d = Spark()
    r = spark.sql(f"SELECT host, {C.registrable(d, 'host', STRICT)} AS reg FROM (SELECT {C.domain(d, 'u')} AS host FROM golden_url) t").first()
    assert (r.host, r.reg) == (host, reg)


def test_url_key_golden(spark):
    assert spark.sql(f"SELECT {C.url_key(Spark(), repr('HTTPS://Acmefix.com/Shop/?q=1#x'))} AS k").first().k == "https://acmefix.com/Shop?q=1"


PAGES = [
    # Five unrelated links: none is a candidate, so the guessed paths of score 0 fill the page, by URL.
    (1, "https://www.acmefix.com/a/b?x=1", "".join(f'<a href="/{w}">{w}</a>' for w in ("der", "die", "das", "und", "wie"))),
    # Two candidates by path, one by text alone (score of neither: 99), one of another site; pads rank with them.
    (2, "https://acmefix.com/", '<a href="/services">x</a><A class="n" HREF=\'about-us\'><b>y</b></A><a href="/z">our policy</a><a href="https://other.com/contact">c</a><a href="mailto:a@b.c">contact</a>'),
    # Five candidates: no pads, though all rank behind them.
    (3, "https://acmefix.com/", "".join(f'<a href="/{w}">{w}</a>' for w in ("faq", "help", "return", "staff", "sales", "der"))),
    # A path that the page links itself isn't guessed again.
    (4, "https://acmefix.com/", '<a href="/contact">Contact</a>'),
]
ZERO = ("consultation", "contact", "contact-me", "contact-us", "estimate", "free-estimate", "get-in-touch", "request-quote")


def test_contact_links_golden(spark):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").createOrReplaceTempView("golden_pages")

    def found(**more):
        got = {}
        text = registry.page_links_topk_padded(Spark(), **more).replace("FROM pages", "FROM golden_pages")
        for r in spark.sql(text).collect():
            got.setdefault(r.page_id, []).append((r.score, r.link, r.pad))
        return {i: sorted(rows) for i, rows in got.items()}

    got = found()
    pads = lambda host, n=5: [(0, f"https://{host}/{w}", 1) for w in ZERO[:n]]
    assert got[1] == pads("www.acmefix.com")
    assert got[2] == pads("acmefix.com")
    assert got[3] == [(99, f"https://acmefix.com/{w}", 0) for w in ("faq", "help", "return", "sales", "staff")]
    assert got[4] == sorted([(0, "https://acmefix.com/contact", 0), *(p for p in pads("acmefix.com") if not p[1].endswith("/contact"))])
    assert len(STRICT.target_paths) == 39
    assert [(s, u) for s, u, pad in found(k=40)[2] if not pad] == [(2, "https://acmefix.com/about-us"), (4, "https://acmefix.com/services"), (99, "https://acmefix.com/z")]


LISTING = [
    # ord, url, name, address, category, phone, website
    (1, "https://m/p/1", "Shop", "1 St", "a", "5", "https://shop.com/"),
    (2, "https://m/p/2", "SHOP", "1 st", "a", "5", "shop.com"),
    (3, "https://m/p/3", "Shop", "1 St", "a", "5", "https://shop.com/x"),
    (4, "https://m/p/4", "Shop", "1 St", "a", "5", "https://l.facebook.com/l.php?h=1&u=https%3A%2F%2Fshop.com%2F"),
    (5, "https://m/p/5", "N/A", "1 St", "a", "5", ""),
    (6, "https://m/p/5", "Unknown Business", "1 St", "b", "5", "N/A"),
]


@pytest.fixture
def listing(spark, monkeypatch):
    rows = [(o, "c1", "r1", name, "4.5", "9 (1,009)", site, url, address, category, phone) for o, url, name, address, category, phone, site in LISTING]
    spark.createDataFrame(rows, "ord long, campaign_id string, request_id string, name string, stars string, reviews string, website string, url string, address string, category string, phone string").createOrReplaceTempView("golden_listing")
    for module in (registry, base):
        monkeypatch.setattr(module, "LISTING", "SELECT * FROM golden_listing")


def test_contact_shapes_golden(spark, listing):
    shape = {r.ord: r for r in spark.sql(registry.contact_shape(Spark())).collect()}
    assert len(shape[1]) == 18 + 3 and shape[1].reviews == "1009" and shape[5].company_name == "" and shape[5].website == "none" and shape[4].hours == ""
    wire = {r.ord: r for r in spark.sql(registry.contact_wire_shape(Spark())).collect()}
    fields = "campaign_id request_id business_name address category rating review_count phone domain email facebook instagram twitter yelp place_id".split()
    assert [wire[6][f] for f in fields] == ["c1", "r1", "Unknown Business", "1 St", '["b", "sub 0"]', "4.5", 1009, "5", "none", "", "", "", "", "", "ChIJ6"]
    assert (wire[5].business_name, wire[5].place_id, wire[3].domain) == ("Unknown Business", "", "https://shop.com/x")
    one = spark.sql(f"SELECT {Spark().json_dict('map(chr(34), chr(233), chr(107), null)')} AS a, {Spark().json_list('array(concat(chr(34), chr(233)), null)')} AS b").first()
    assert one.a == '{"\\"": "é", "k": null}'
    assert one.b == '["\\"é", null]'


def test_contact_dedupe_golden(spark, listing):
    # One URL in three spellings is one contact; another path stays, as the reference's domain field keeps paths.
    assert sorted(r.ord for r in spark.sql(registry.contact_dedupe_generic(Spark())).collect()) == [1, 3, 5]


def test_contact_enrich_golden(spark, listing):
    rows = {r.ord: r for r in spark.sql(registry.contact_enrich(Spark())).collect()}
    assert len(registry._OVERLAID) == 13 and set(registry._OVERLAID) < set(rows[3].asDict())
    # 3 and 6 are place pages: blank and N/A leave the listing's value, others are trimmed and laid over.
    assert (rows[3].name, rows[3].address, rows[3].website, rows[3].stars, rows[3].reviews, rows[3].hours_detail) == ("Shop", "1 St", "https://shop.com/x", "4.5", "9 (1,009)", "Mon: 3-18")
    assert (rows[3].hours, rows[3].located_in, rows[3].plus_code, rows[3].category, rows[3].phone) == ("Open", "Mall 3", "9F3+2X", "A", "5")
    assert (rows[5].url, rows[5].listed_url, rows[1].url) == ("https://m/p/5?q=place_id:ChIJ6/x", "https://m/p/5", "https://m/p/1")


def test_request_selection_golden(spark):
    # By key: 4 is pending, 2, 6, 14 and 18 are in use.
    spark.createDataFrame([(4, 1), (2, 1), (6, 1), (14, 2), (18, 2)], "o_orderkey long, o_custkey long").createOrReplaceTempView("golden_orders")
    got = spark.sql(registry.request_selection(Spark()).replace("FROM orders", "FROM golden_orders")).collect()
    assert sorted((r.campaign, r.id) for r in got) == [(1, 4), (2, 14), (2, 18)]


@pytest.mark.parametrize(("n", "rows"), [(None, 4000), (300, 300), (0, 1), (-5, 1), (9000, 4000)])
def test_log_tail_golden(spark, n, rows):
    spark.sql("SELECT id AS event_id, id AS user_id, 'x' AS event_type, current_timestamp() AS ts FROM range(5000)").createOrReplaceTempView("golden_events")
    text = registry.log_tail(Spark()) if n is None else registry.log_tail(Spark(), n)
    assert sorted(r.seq for r in spark.sql(text.replace("FROM events", "FROM golden_events")).collect()) == list(range(5000 - rows, 5000))
