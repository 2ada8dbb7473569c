"""Page trees, XPath, channels and templates by hand; sources, sinks and settings."""

import json
import os
import time

from urllib.parse import quote

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfold.functions import html as H
from tallyfold.functions import template as T
from tallyfold.operators import engines
from tallyfold.operators import extraction as X
from tallyfold.plans import listing, registry
from tallyfold.sources import files, tables
from tallyfold.streaming import flows

PAGE = """<html><body><div class="box a"><h2>One &amp; <b>two</b></h2><p id=p1>First<br>line<p>Second</p><a href="/x/">x</a></div>
<div class="box"><h2></h2><script>var y = "no@no.com"</script><ul><li>1<li>2<li>3</ul><a href='https://b.com/'>b</a></div></body></html>"""


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("//h2", ["One & two"]), ("//div[2]/a/@href", ["https://b.com/"]), ("//a/@href", ["/x/", "https://b.com/"]), ("//div[@class='box']//a", ["b"]), ("//div[contains(@class, 'a')]/h2/b/text()", ["two"]),
        ("count(//a)", ["2"]), ("count(//a) > 1", ["true"]), ("string(//h2)", ["One & two"]), ("normalize-space(//p[@id='p1'])", ["Firstline"]), ("//a[starts-with(@href, 'https:')]/parent::div/@class", ["box"]),
        ("//*[self::h2 or self::b][text()]", ["One & two", "two"]), ("//a[not(contains(@href, 'b.com'))]", ["x"]), ("//a[last()]", ["x", "b"]), ("(//a)[last()]", ["b"]), ("//h2/following-sibling::a | //h2/b", ["two", "x", "b"]), ("//b/ancestor::div/@class", ["box a"]),
        ("//div[h2[.='']]//a", ["b"]), ("concat('a', 'b', 1)", ["ab1"]), ("substring-after(//a[2]/@href, '//')", []), ("translate('abc', 'ab', 'x')", ["xc"]), ("//li[position() = 1]/text()", ["1"]), ("count(//ul/li)", ["3"]), ("//p[2]", ["Second"]), ("//p/following-sibling::a", ["x"]), ("string-length('abcd') = 4 and true()", ["true"]), ("//script/text()", ['var y = "no@no.com"']), ("", []),
    ],
)
def test_xpath(path, want):
    assert H.values(H.parse(PAGE), path) == want


def test_xpath_that_is_not_known():
    for path in ("//a[", "foo(1)", "//a/bar::b", "a b"):
        with pytest.raises(ValueError):
            H.values(H.parse(PAGE), path)
    assert H.parse(None).children == H.parse("").children == [] and H.values(H.parse("</p>text<"), "//p") == []


def test_elements_end_where_a_browser_ends_them():
    root = H.parse("<table><tr><td><p>a<div>b</div><td>c<tr><td>d</table><dl><dt>x<dd>y<dt>z</dl><p>one<ul><li>two<ul><li>in</ul><li>three</ul><select><option>1<option>2</select><p>end")
    assert H.values(root, "//tr/td[1]") == ["ab", "d"] and H.values(root, "count(//tr)") == ["2"] and H.values(root, "//dl/*") == ["x", "y", "z"]
    assert H.values(root, "//p") == ["a", "one", "end"] and H.values(root, "/ul/li/text()") == ["two", "three"] and H.values(root, "//option") == ["1", "2"]


def test_named_references_need_their_semicolon():
    """As in the SQL: a text that is cut inside a reference stays as written, in attributes and scripts too."""
    root = H.parse("<title>a &amp;&amp; b&amp</title><a href='?a=1&copy=2&amp;b=3'>&quot;&ampx; &am &#64; R&D;\ufdd0</a><script>a&lt=b&amp;</script>")
    assert H.values(root, "//title") == ["a && b&amp"] and H.values(root, "//a/@href") == ["?a=1&copy=2&b=3"] and H.values(root, "//a") == ['"&ampx; &am @ R&D;\ufdd0']
    assert H.values(root, "//script/text()") == ["a&lt=b&amp;"]


def coded(text, key):
    return f"{key:02x}" + "".join(f"{ord(c) ^ key:02x}" for c in text)


def test_email_channels():
    html = f"""<a href="MAILTO:Info@Acme.com?subject=x">m</a><i data-email="attr@acme.com">i</i><a href="/cdn-cgi/l/email-protection#{coded('link@acme.com', 42)}">p</a>
    <span class="x __cf_email__" data-cfemail="{coded('Span@Acme.com', 7)}">s</span><script type="application/ld+json">{{"a": [{{"EMAIL": "LD@acme.com", "email": 5}}]}}</script>
    <script type="application/ld+json">not json</script><p>text (at) acme (dot) com</p>"""
    got = H.email_channels(html)
    assert {("info@acme.com", "mailto"), ("attr@acme.com", "attribute"), ("link@acme.com", "protected link"), ("span@acme.com", "protected span"), ("ld@acme.com", "linked data"), ("ld@acme.com", "raw"), ("attr@acme.com", "raw")} <= set(got)
    assert any(c == "text" and e.endswith("text@acme.com") for e, c in got) and got == sorted(got)
    assert H.email_channels(None) == H.email_channels("") == [] and H.unprotected("zz") == H.unprotected("4") == H.unprotected("") == ""


FIELDS = [
    {"label": "Name", "target_field": "companyName", "xpath": "//h2", "required": True},
    {"label": "Site", "target_field": "website", "xpath": "//a/@href"},
    {"label": "Note", "target_type": "dynamic", "target_field": "Note", "xpath": "//p", "regex": "sec(o)nd"},
]


def test_template_blocks(spark):
    template = {"fast": {"block_xpath": "//div", "fields": FIELDS}, "slow": {"enabled": True}}
    got = list(T.Program(template).blocks(PAGE, "https://a.com/q"))
    assert got[0] == (1, {"business_name": "One & two", "domain": "https://a.com/x"}, {"note": "o"}, [], "https://a.com/x", "domain")
    assert got[1] == (2, {"domain": "https://b.com"}, {}, ["Name"], "https://b.com", "domain")
    pages = spark.createDataFrame([(1, "https://a.com/q", PAGE), (2, None, None)], "page_id long, url string, html string")
    rows = X.extract_blocks(pages, template)
    assert [(r.block, r.core["domain"], r.missing) for r in rows.collect()] == [(1, "https://a.com/x", []), (2, "https://b.com", ["Name"])] and X.whole_blocks(rows).count() == 1
    detail = spark.createDataFrame([(9, "https://a.com/x", {"business_name": "New"}, {"hours": "9-5"}), (8, "https://a.com/x", {"phone": "1"}, {})], "page_id long, url string, core map<string,string>, source_data map<string,string>")
    both = {r.block: r for r in X.with_details(rows, detail).collect()}
    assert both[1].core == {"business_name": "One & two", "domain": "https://a.com/x", "phone": "1"} and both[2].core == {"domain": "https://b.com"}
    assert X.extract_blocks(pages.where("false"), template).count() == 0


def field(**config):
    return T.Field.of(config)


def test_template_fields():
    assert T.Field.of({"xpath": "//a"}, in_block=True).path == ".//a" and T.Field.of({"xpath": ".//a"}, in_block=True).path == ".//a" and T.Field.of({"xpath": "a"}, in_block=True).path == "a" and field(xpath="//a").path == "//a"
    find = lambda value, pattern: T.Pattern(pattern).find(value)
    assert find("Tel: 12 34", "([0-9]+) ([0-9]+)") == "12" and find("x", "[") == "x" and find("x", "y") == "" and find("AB", "b") == "B"
    assert field(label="E-mail", target_field="work_email").email and field(label="Email 2").email and not field(label="Phone").email
    assert field(regex="[0-9]{2}").value_of(["a 1", "b 22"]) == "22" and field(regex="a b").value_of(["a", "b"]) == "a b" and field().value_of(["a", "b"]) == "a b"
    tried = field(regex="[0-9]").attempts(["x", "N/A", "7"])
    assert [t["matched"] for t in tried] == [False, False, True] and len(field(regex="1").attempts(["1"] * 20)) == 12
    assert field(target_field="CompanyName").name == "business_name" and field(target_field="Note", target_type="Dynamic").name == "note" and field(label="", xpath="//b").label == "//b"
    root = H.parse('<a href="mailto:zed@a.com">x</a> amy@a.com <i> </i><i>late</i>')
    assert T.contact(root, [field(label="Email", target_field="email", xpath="//b")], "u", "h")[0] == {"email": "zed@a.com"}
    assert field(label="l", xpath="//a", regex="x").trace(root) == {"label": "l", "xpath": "//a", "regex": "x", "matches": 1, "value": "x", "previews": ["x"], "attempts": [{"index": 1, "matched": True, "value": "x", "preview": "x"}], "matched_index": 1, "status": "ok"}
    assert field(xpath="//i", first=True).read(root).value == "" and field(xpath="//i").read(root).value == "late" and field(xpath="//a/@href", first=True, regex=":(.*)").read(root).value == "zed@a.com"
    told = [field(label=k, xpath=x, regex=r).summary(root) for k, x, r in (("a", "//a", ""), ("b", "//a", "[0-9]"), ("c", "//u", ""), ("d", "", ""), ("e", "//a[", ""))]
    assert told[:4] == ["a=ok", "b=regex_empty(raw_len=1)", "c=xpath_empty", "d=empty_xpath"] and told[4].startswith("e=error(")
    assert T.debug_extract("<p>1</p><p>b2</p>", "//p", "b([0-9])") == {"matches": 2, "value": "2", "attempts": [{"index": 1, "matched": False, "value": "", "preview": "1"}, {"index": 2, "matched": True, "value": "2", "preview": "b2"}], "matched_index": 2, "status": "ok"}


def test_template_urls():
    assert T.absolute("https://a.com/b/c", "../d/./e/") == "https://a.com/d/e" and T.absolute("https://a.com", "n/a") == "" and T.absolute("https://a.com", "http://[x") == "http://[x"
    site = lambda x: T.website("https://a.com/", x)
    assert site("//b.com/") == "https://b.com" and site("shop.com/a/") == "https://shop.com/a" and site("/x/") == "https://a.com/x" and site("none") == ""
    once = "https://l.facebook.com/l.php?u=https%3A%2F%2Fshop.com%2Fa%2F&h=1"
    twice = f"https://l.facebook.com/l.php?u={quote(once, safe='')}"
    assert site(once) == site(twice) == site(f"https://l.facebook.com/l.php?u={quote(twice, safe='')}") == "https://shop.com/a" and site("https://l.facebook.com/l.php?h=1") == "https://l.facebook.com/l.php?h=1"
    assert T.detail_url({"url": "call us", "www": "N/A"}, {"fb_link": "/p/"}, "https://a.com/x") == ("https://a.com/p", "source_data.fb_link") and T.detail_url({}, {}, "u") == ("", "")


LIST = """<div role="feed"><div><a href="https://www.google.com/maps/place/9/"></a><div class="fontHeadlineSmall">Acme</div><span role="img" aria-label="4.5 stars"><span>4.5</span><span>(1,234)</span></span>
<div><span><span>Plumber</span></span><span aria-hidden="true">·</span><span>12 Main St</span></div><div><span>Open until 5</span><span aria-hidden="true">·</span><span>(555) 000-1234</span></div></div></div>"""


def test_listing_block(spark):
    """A block by hand: each list field is the first text that its path finds, and the type stands in a span of its own."""
    pages = spark.createDataFrame([(1, "https://m.example.net", LIST)], "page_id long, url string, html string")
    got = X.extract_blocks(pages, listing.LISTING).first().core
    assert got == {"business_name": "Acme", "url": "https://www.google.com/maps/place/9/", "rating": "4.5", "review_count": "1,234", "business_type": "Plumber", "address": "12 Main St", "hours": "Open until 5", "phone": "(555) 000-1234"}


def test_emails_behind_entities_and_words(spark):
    pages = spark.createDataFrame([(1, "u", "<p>info&#64;acme.com</p>"), (2, "u", '<b href="x"></b><a href="mailto:info&#64;acme.com">x</a>'), (3, "u", "<p>no mail</p>"), (4, "u", None)], "page_id long, url string, html string")
    got = {(r.page_id, r.email, r.channel) for r in X.email_channels(pages).collect()}
    assert got == {(1, "info@acme.com", "text"), (2, "info@acme.com", "mailto")}
    fields = [{"label": "Email", "target_field": "email", "xpath": "//b[@id='none']"}]
    words = spark.createDataFrame([(1, "u", "<p>info (at) acme (dot) com</p>"), (2, "u", "<p>Zed%40x.com or amy@x.com.</p>"), (3, "u", "<i data-x='raw@x.com'></i>")], "page_id long, url string, html string")
    found = {r.page_id: r.core.get("email") for r in X.extract_pages(words, fields).collect()}
    assert found == {1: "info@acme.com", 2: "amy@x.com", 3: "raw@x.com"}


@given(st.lists(st.sampled_from(["<div>", "</div>", "<p a='1'>", "</p>", "<span>", "</span>", "x", "<b>", "</b>", "<ul><li>", "</ul>"]), max_size=40))
@settings(max_examples=150, deadline=None)
def test_index_finds_what_a_walk_finds(parts):
    """Paths that use the index against the same ones step by step."""
    root = H.parse("".join(parts))
    walk = "/descendant-or-self::node()/"
    for deep in ("//p", "//span[1]", "//div//b", "//div[.//b]//p[2]", "//p[@a='1'][1]", "//*[self::p or self::b]", "//div[last()]", "//li/..//text()", "//b[count(../b)]", "//div[p][2]"):
        assert [id(x) for x in H.nodes(root, deep)] == [id(x) for x in H.nodes(root, deep.replace("//", walk))]
    every = [x for x in root.tree.all if isinstance(x, H.Node)]
    for node in every:
        inside = [x for x in root.tree.all if any(up is node for up in H._axis(x, "ancestor"))]
        assert node.below() == inside and node.text() == "".join(x.value for x in inside if isinstance(x, H.Text))


def test_only_asked_details_are_parsed(spark):
    blocks = spark.createDataFrame([(1, 1, {"a": "1"}, {}, [], "https://a.com/x", ""), (1, 2, {"a": "2"}, {}, [], "", "")], X.BLOCK)
    pages = spark.createDataFrame([(5, "https://a.com/x", "<h1>New</h1>"), (6, "https://a.com/y", "<h1>Other</h1>"), (7, None, "")], "page_id long, url string, html string")
    details = X.extract_pages(X.asked_pages(pages, blocks), [{"label": "a", "target_field": "a", "xpath": "//h1"}], keep="url")
    assert [(r.page_id, r.core) for r in details.collect()] == [(5, {"a": "New"})]
    plan = details._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join LeftSemi")
    assert {r.block: r.core for r in X.with_details(blocks, details).collect()} == {1: {"a": "New"}, 2: {"a": "2"}}


def test_made_up_pages_are_parsed_side_by_side(spark):
    """Customers come out of one task; their pages are dealt anew before they are parsed."""
    for name in ("place_details", "listing_with_details"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        parsed = plan[plan.rindex("MapInArrow") :] if name == "place_details" else plan[plan.index("MapInArrow") : plan.index("Join LeftSemi")]
        assert "Repartition" in parsed


def test_plain_steps():
    """Steps without predicates: attributes in order and once each, the node itself, children of nodes that lie in each other."""
    root = H.parse("<div id=a x=1><b>1</b><div id=c><b>2</b></div><b id=e>3</b></div>")
    for path, want in (("//div/@id", ["a", "c"]), ("/div/@*", ["1", "a"]), ("//div/b", ["1", "2", "3"]), ("//*[self::b][@id='e']", ["3"]), ("//b/self::div", []), ("//div/text()", []), ("//b/text()", ["1", "2", "3"]), ("//@id/self::id", ["a", "c", "e"]), ("//b[@id]/../@x", ["1"]), ("concat(//b, //div/b)", ["11"])):
        assert H.values(root, path) == want, path


def test_capture_and_links(spark):
    pages = spark.createDataFrame([(1, "u", "\ufb01x", 200), (2, "u", "plain", 200), (3, "u", "gone", 404), (4, "u", None, 200)], "page_id long, url string, html string, status int")
    assert {r.page_id: r.html for r in X.capture(pages).collect()} == {1: "fix", 2: "plain", 4: None}
    got = X.absolute_links(spark.createDataFrame([("https://a.com/b/c", "../d"), (None, "/x"), ("https://a.com", None)], "u string, l string"), "u", "l", "to")
    assert [r.to for r in got.collect()] == ["https://a.com/d", "/x", ""]


def test_capture_moves_little_to_python(spark):
    """Pages go to Python in batches cut by bytes, other columns and nulls as they are."""
    texts = ["élan Ärger ß", "e\u0301lan", "x²", "\u00a0", None, "\ufb01\ufb01"] * 50
    rows = [(i, f"u{i % 7}", x, 200, [i]) for i, x in enumerate(texts)]
    made = X.capture(spark.createDataFrame(rows, "page_id long, url string, html string, status int, more array<int>"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= X.BATCH_BYTES and "MapInArrow" in made._jdf.queryExecution().optimizedPlan().toString()
    want = ["élan Ärger ß", "élan", "x2", " ", None, "fifi"] * 50
    assert [tuple(r) for r in made.orderBy("page_id").collect()] == [(i, u, want[i], n, more) for i, u, _, n, more in rows]


def test_engines(spark):
    named = engines.email_engines()
    pages = spark.createDataFrame([(1, '<a href="mailto:A@b.com">x</a>')], "page_id long, html string")
    assert named.get(" TEXT ")[0] == "text" and named.get("scrapy")[0] == named.get(None)[0] == "tree"
    assert [r.email for r in named.get("text")[1](pages).collect()] == ["a@b.com"] and {r.channel for r in named.get("x")[1](pages).collect()} == {"raw", "mailto"}


def test_settings_and_jobs(tmp_path):
    path = str(tmp_path / "s" / "settings.json")
    defaults = {"a": {"x": 1, "y": 2}, "b": [1]}
    assert files.load_settings(path, defaults) == defaults
    files.save_settings(path, {"b": [2], "a": {"y": 3}})
    assert open(path).read().index('"a"') < open(path).read().index('"b"') and files.load_settings(path, defaults) == {"a": {"x": 1, "y": 3}, "b": [2]} and defaults["a"]["y"] == 2
    (tmp_path / "bad.json").write_text("[1")
    assert files.load_settings(str(tmp_path / "bad.json"), defaults) == defaults
    queue = str(tmp_path / "q")
    job = files.enqueue(queue, "7", "Shop")
    assert json.load(open(job))["campaign_name"] == "Shop" and files.enqueue(queue, "7", "Shop") is None and os.listdir(queue) == ["campaign_7.json"]
    moved = files.move_job(job, f"{queue}/processed")
    assert files.enqueue(queue, "7", "Shop") is None
    os.rename(moved, f"{moved}.17")
    assert files.enqueue(queue, "7", "Shop") is None and files.enqueue(queue, "7", "Shop", aside=False) is not None
    (tmp_path / "q" / "processed" / "campaign_7.json").write_text("{}")
    assert files.move_job(f"{queue}/campaign_7.json", f"{queue}/processed").rpartition(".")[2].isdigit()


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"campaigns": [{"id": " 1 ", "name": "A"}, {"id": "2", "name": ""}, {"name": "x"}]}))
    assert [tuple(r) for r in tables.active_campaigns(spark, str(tmp_path / "c.json")).collect()] == [("1", "A")]
    (tmp_path / "r.json").write_text(json.dumps({"requests": [{"id": "1", "req_text": " a ", "status": "InUse"}, {"id": "", "req_text": "b"}, {"id": "3", "status": "Pending"}]}))
    assert [tuple(r) for r in tables.requests(spark, str(tmp_path / "r.json")).collect()] == [("3", "", "pending")] and tables.requests(spark, str(tmp_path / "r.json"), True).count() == 2
    docs = spark.createDataFrame([('{"campaigns":{"c1":{"requests":{"unfinished":3}}}}',), ('{"campaigns":7}',), ("x",)], "doc string")
    assert [r.progress for r in tables.progress(docs, "c1").collect()] == [{"unfinished": "3"}, {}, {}]
    (tmp_path / "s.json").write_text(json.dumps({"campaign_id": "c1", "stats": {"contacts_without_email": "12"}, "source_template": {"fast": {}}}))
    assert [(r.campaign_id, r.contacts_without_email, json.loads(r.template)) for r in tables.campaign_stats(spark, str(tmp_path / "s.json")).collect()] == [("c1", 12, {"fast": {}})]
    contacts = spark.createDataFrame([("c1", "r1", "Shop", "1"), ("c1", "r1", None, "2")], "campaign_id string, request_id string, companyName string, phone string")
    for _ in range(2):
        tables.write_contacts(contacts, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 4 and back.columns[:18] == tables.CONTACT_COLUMNS
    tables.write_dead_letters(contacts.selectExpr("*", "0 AS batch_no"), str(tmp_path / "dead"))
    assert [(r.size, len(r.contacts)) for r in spark.read.json(str(tmp_path / "dead")).collect()] == [(2, 2)]
    (tmp_path / "jobs").mkdir()
    for i, (name, text) in enumerate([("b.json", '{"campaign_id": "2"}'), ("a.json", '{"campaign_id": "1"}'), ("z.json", "no json")]):
        (tmp_path / "jobs" / name).write_text(text)
        os.utime(tmp_path / "jobs" / name, (1000 + i, 1000 + i))
    assert [r.file_name for r in tables.job_files(spark, str(tmp_path / "jobs")).collect()] == ["b.json", "a.json", "z.json"] and tables.next_job(spark, str(tmp_path / "jobs")).first().campaign_id == "2"


def test_log_stream(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "1.txt").write_text("[email] FOUND a -> b\nplain\n")
    got = flows.drain(tables.log_lines(spark, str(tmp_path / "log")), "log")
    assert sorted((r.source, r.line) for r in got.collect()) == [("", "plain"), ("email", "FOUND a -> b")]


def test_run_states_as_a_stream(spark, tmp_path):
    spark.createDataFrame([("r1", 1, "maps_scrape", "complete"), ("r1", 2, "cleanup_contacts", "complete"), ("r2", 1, "finalize", "complete"), ("r3", 1, "polish", "fail")], "run_id string, seq long, stage string, event string").write.parquet(str(tmp_path / "in"))
    got = flows.drain(flows.run_states(flows.rows_of(spark, str(tmp_path / "in"))), "states", "complete")
    assert sorted((r.run_id, r.state, r.next_stage) for r in got.collect()) == [("r1", "open", "email_fast"), ("r2", "done", None), ("r3", "unsupported", None)]


def test_a_crawl_times_out(spark, tmp_path):
    schema, ends = "key string, kind string", []
    spark.createDataFrame([("a", "queued"), ("a", "queued"), ("a", "seen")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = flows.crawl_ends(stream, 500).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "mark")).foreachBatch(lambda b, n: ends.extend(tuple(r) for r in b.collect())).trigger(processingTime="300 milliseconds").start()
    until = time.time() + 60
    while not ends and time.time() < until:
        time.sleep(0.2)
    query.stop()
    assert ends == [("a", 2, 1, "timed out")]


def test_follow_stops_when_told(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    got, seen = [], []
    flows.follow(flows.rows_of(spark, str(tmp_path / "in")), str(tmp_path / "mark"), lambda b, n: got.extend(r.id for r in b.collect()), lambda: len(got) >= 5 and len(seen) > 0, lambda p: seen.append(p["numInputRows"]), 0.3)
    assert sorted(got) == [0, 1, 2, 3, 4] and sum(seen) >= 5

    def bad(batch, number):
        raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        flows.follow(flows.rows_of(spark, str(tmp_path / "in")), str(tmp_path / "mark2"), bad, lambda: False, None, 0.3)
