"""The engine's own queries by name, each one text for Spark and for DuckDB."""

from __future__ import annotations

from functools import partial

from tallyfold.functions import contacts as C
from tallyfold.functions import links as L
from tallyfold.functions.dialect import DuckDB, Spark
from tallyfold.functions.rules import LENIENT, POLICIES, STRICT
from tallyfold.operators.ranking import chunks, keep_first, overlay
from tallyfold.plans import extraction, records, sinks, streams, temporal
from tallyfold.plans.base import LISTING, anchors, candidates, details, hosts, mailed
from tallyfold.plans.base import ranked as _ranked
from tallyfold.sources.tables import view


def page_domain_parts(d):
    return f"SELECT page_id, host, {C.registrable(d, 'host', STRICT)} AS registrable, {C.url_key(d, 'url')} AS url_key FROM ({hosts(d)}) h"


def page_url_key_dedupe(d):
    return keep_first(f"(SELECT page_id, {C.url_key(d, 'url')} AS url_key FROM pages) p", "url_key", "page_id", "page_id, url_key")


def doc_email_candidates(d):
    return f"SELECT doc_id, email FROM ({candidates(d, 'documents', 'doc_id', 'text')}) c WHERE email <> ''"


def doc_email_verdicts(d):
    parts = C.email_parts(d, f"({candidates(d, 'documents', 'doc_id', 'text')}) c", "email", STRICT)
    return f"SELECT doc_id, email, {C.verdict(d, 'email', STRICT)} AS verdict FROM ({parts}) p"


def verdict_histogram(d):
    return f"SELECT verdict, count(*) AS n FROM ({doc_email_verdicts(d)}) v GROUP BY verdict"


def best_email(policy, d):
    """The best e-mail of each page under a policy, where it has one."""
    best = f"SELECT page_id, email, tier FROM ({_ranked(d, policy, mailed(d))}) r WHERE rn <= 1"
    return f"SELECT h.page_id, h.host, CASE WHEN b.tier < 9 THEN b.email END AS best_email, CASE WHEN b.tier < 9 THEN b.tier END AS tier FROM ({hosts(d)}) h LEFT JOIN ({best}) b ON h.page_id = b.page_id"


def best_email_per_contact(d):
    """The best e-mail of each business over the candidates of all its pages."""
    best = f"SELECT host, email, tier FROM ({_ranked(d, 'any_valid', mailed(d), key='host')}) r WHERE rn <= 1"
    return f"SELECT h.host, h.pages, CASE WHEN b.tier < 9 THEN b.email END AS best_email, CASE WHEN b.tier < 9 THEN b.tier END AS tier FROM (SELECT host, count(*) AS pages FROM ({hosts(d)}) p GROUP BY host) h LEFT JOIN ({best}) b ON h.host = b.host"


def best_email_in_phases(d, policy="business_only"):
    """The best e-mail of each business: over all its pages, else, in a second phase, over at most two social pages of each of its pages.

    Social pages are made up, one text for each link; their e-mails pass the
    looser rule and then the one ranking.
    """
    first = f"SELECT host, email FROM ({_ranked(d, policy, mailed(d), key='host')}) r WHERE rn <= 1 AND tier < 9"
    text = "concat('Find us: owner', page_id, '@gmail.com, hello', page_id % 7, '@othershop.com or order', page_id, '@gmail.com')"
    social = f"(SELECT s.page_id, p.url, s.html FROM (SELECT page_id, {text} AS html FROM ({page_social_links(d)}) l) s JOIN pages p ON p.page_id = s.page_id) social"
    ranked = f"SELECT host, email, rn AS place FROM ({_ranked(d, 'any_valid', social, key='host')}) r WHERE tier < 9 AND {records.social_ok(d)}"
    second = keep_first(f"({ranked}) k", "host", "place", "host, email")
    return f"""SELECT h.host, coalesce(a.email, b.email) AS email, CASE WHEN a.email IS NOT NULL THEN 'regular' WHEN b.email IS NOT NULL THEN 'social' END AS phase
FROM (SELECT DISTINCT host FROM ({hosts(d)}) p) h LEFT JOIN ({first}) a ON a.host = h.host LEFT JOIN ({second}) b ON b.host = h.host"""


def debug_events(d, n=500):
    """The last n events of each run of a template, as they came."""
    return keep_first("(SELECT user_id % 7 AS run_id, event_id AS seq, event_type AS type FROM events) e", "run_id", "seq DESC", "run_id, seq, type", n)


def page_contact_summary(d):
    """The flagship: host, registrable domain, candidate counts and best e-mail of every page; one window and one aggregate by page."""
    found = f"SELECT page_id, count(*) AS n_candidates, sum(CASE WHEN verdict = 'ok' THEN 1 ELSE 0 END) AS n_valid, min(verdict) AS first_verdict, max(CASE WHEN rn = 1 AND tier < 9 THEN email END) AS best_email FROM ({_ranked(d, 'any_valid')}) r GROUP BY page_id"
    return f"""SELECT h.page_id, h.host, {C.registrable(d, 'h.host', LENIENT)} AS registrable, coalesce(n.n_candidates, 0) AS n_candidates,
CAST(coalesce(n.n_valid, 0) AS BIGINT) AS n_valid, n.first_verdict, n.best_email FROM ({hosts(d)}) h LEFT JOIN ({found}) n ON h.page_id = n.page_id"""


def _links(d):
    hrefs = d.all("html", 'href="[^"#][^"]*"')
    raw = f"SELECT page_id, url, {d.explode}({hrefs}) AS tag FROM pages"
    return f"SELECT page_id, {d.rep('tag', chr(94) + 'href=' + chr(34) + '|' + chr(34) + '$', '')} AS link FROM ({raw}) r"


def page_links_topk_padded(d, rules=STRICT, k=5):
    """k contact-like links of a page by (score, link); a page with fewer gets the target paths that it doesn't link, scored and ranked alike.

    One scan: each page's anchors and a row for the page itself, which becomes
    its guessed paths where the window counts too few. The windows share one
    partitioning by page.
    """
    like = " OR ".join(L.contact_like(d, x, rules.target_paths) for x in ("path", "text"))
    sited = f"SELECT *, {L.site(d, 'url')} AS home, {L.site(d, 'link')} AS there FROM ({anchors(d, True)}) a"
    own = f"SELECT *, CASE WHEN NOT mark AND home <> '' AND home = there AND ({like}) THEN 1 ELSE 0 END AS own FROM ({sited}) s"
    counted = f"SELECT *, sum(own) OVER (PARTITION BY page_id) AS n FROM ({own}) o WHERE own = 1 OR mark"
    paths = d.array(*(d.s(f"/{p.lstrip('/')}") for p in rules.target_paths))
    spread = f"SELECT page_id, url, home, link, path, text, own, {d.explode}(CASE WHEN own = 1 THEN {d.array(d.s(''))} ELSE {paths} END) AS guess FROM ({counted}) c WHERE own = 1 OR n < {k}"
    named = f"SELECT page_id, home, own, CASE WHEN own = 1 THEN link ELSE concat({L.origin(d, 'url')}, guess) END AS link, CASE WHEN own = 1 THEN path ELSE guess END AS path, CASE WHEN own = 1 THEN text ELSE '' END AS text FROM ({spread}) g"
    held = f"SELECT *, max(own) OVER (PARTITION BY page_id, link) AS linked FROM ({named}) m WHERE own = 1 OR (home <> '' AND home = {L.site(d, 'link')})"
    scored = f"SELECT page_id, link, least({C.priority(d, 'path', rules)}, {C.priority(d, 'text', rules)}) AS score, 1 - own AS pad FROM ({held}) h WHERE own = 1 OR linked = 0"
    return keep_first(f"({scored}) u", "page_id", "score, link", "page_id, link, score, pad", k)


def link_kinds(d):
    return f"""SELECT page_id, link, {L.looks_like_url(d, 'link')} AS url_like, {L.blocked_resource(d, 'link')} AS blocked, {L.slashless(d, 'link')} AS slashless,
{L.clean_url(d, 'link')} AS cleaned, {L.social_loose(d, 'link')} AS social_loose, {L.social_strict(d, 'link')} AS social_strict FROM (SELECT DISTINCT page_id, link FROM ({_links(d)}) l) u"""


def page_social_links(d):
    """Two social pages of each page at most, from links and from one made up for every fifth page."""
    made = "SELECT page_id, concat('https://www.facebook.com/', CASE WHEN page_id % 10 = 0 THEN 'shop' ELSE 'sharer/' END, page_id) AS link FROM pages WHERE page_id % 5 = 0"
    social = f"(SELECT DISTINCT page_id, link FROM (SELECT page_id, link FROM ({_links(d)}) l UNION ALL {made}) u WHERE {L.social_strict(d, 'link')}) s"
    return keep_first(social, "page_id", "link", "page_id, link", 2)


_CLAIMS = """SELECT event_id AS seq, concat('w', user_id % 5) AS worker, CASE event_id % 5
WHEN 0 THEN concat('Claimed pipeline run=r', event_id, ' campaign=', user_id, ' campaign_name=Shop ', user_id, ' stage=email_scrape')
WHEN 1 THEN concat('Claimed pipeline run=r', event_id, ' campaign=', user_id, ' stage=maps') WHEN 2 THEN 'No claimable run (empty)'
WHEN 3 THEN concat('Stage failed: run=r', event_id, ' campaign=', user_id, ' stage=verify') ELSE event_type END AS line FROM events"""


def claim_lines(d):
    """What each log line tells of a worker's current work; lines that tell nothing are left out."""
    state = "CASE WHEN line LIKE '%Claimed pipeline run=%' THEN 'claimed' WHEN line LIKE '%No claimable run (%' THEN 'idle' WHEN line LIKE '%Stage failed: run=%' THEN 'failed' WHEN line LIKE '%Pipeline worker stopping%' THEN 'stopped' END"
    part = lambda name: f"nullif(regexp_extract(line, {d.s(f'(?:^|[ ]){name}=([^ ]+)')}, 1), '')"
    named = f"nullif(trim(regexp_extract(line, {d.s('campaign_name=(.*?) +stage=')}, 1)), '')"
    return f"SELECT seq, worker, state, {part('campaign')} AS campaign_id, {named} AS campaign_name, {part('stage')} AS stage FROM (SELECT *, {state} AS state FROM ({_CLAIMS}) c) s WHERE state IS NOT NULL"


def current_work(d):
    return keep_first(f"({claim_lines(d)}) c", "worker", "seq DESC", "worker, seq, state, campaign_id, campaign_name, stage")


def request_summary(d):
    """The counters of each request: blocks, what was sent or left out, and what became of the detail pages."""
    dup = f"SELECT *, row_number() OVER (PARTITION BY name, website, phone, address ORDER BY ord) AS nth, row_number() OVER (PARTITION BY url ORDER BY ord) AS seen FROM ({LISTING}) l"
    step = "CASE WHEN name = 'N/A' THEN 'missing' WHEN nth > 1 THEN 'duplicate' ELSE 'sent' END"
    slow = "CASE WHEN name = 'N/A' OR ord % 4 = 0 THEN 'none' WHEN ord % 13 = 1 THEN 'no url' WHEN seen > 1 THEN 'again' WHEN ord % 17 = 0 THEN 'error' WHEN ord % 19 = 0 THEN 'timeout' WHEN ord % 23 = 0 THEN 'empty' ELSE 'opened' END"
    n = lambda test: f"CAST(sum(CASE WHEN {test} THEN 1 ELSE 0 END) AS BIGINT)"
    return f"""SELECT campaign_id, request_id, count(*) AS blocks, {n("step = 'sent'")} AS sent, {n("step = 'duplicate'")} AS skipped_duplicates, {n("step = 'missing'")} AS skipped_missing_required,
{n("slow <> 'none'")} AS slow_attempted, {n("slow IN ('opened', 'timeout', 'empty')")} AS slow_opened, {n("slow = 'no url'")} AS slow_missing_url, {n("slow = 'again'")} AS slow_detail_duplicates,
{n("slow = 'timeout'")} AS slow_wait_timeout, {n("slow = 'empty'")} AS slow_empty_fields, {n("slow = 'error'")} AS slow_errors FROM (SELECT campaign_id, request_id, {step} AS step, {slow} AS slow FROM ({dup}) u) s GROUP BY campaign_id, request_id"""


_SOCIAL = "'' AS email, '' AS facebook, '' AS instagram, '' AS twitter, '' AS yelp"


def contact_shape(d):
    """A result's 18 contact fields."""
    text = lambda x: f"coalesce({C.picked(x)}, '')"
    same = ", ".join(f"{text(x)} AS {x}" for x in ("address", "phone", "hours", "hours_detail", "located_in", "plus_code", "booking_link"))
    return f"""SELECT ord, campaign_id, request_id, {text('name')} AS company_name, {same}, {C.rating(d, C.stripped(d, text('star_text')))} AS rating,
replace(regexp_extract({text('review_text')}, '[0-9,]+', 0), ',', '') AS reviews, {text('categories')} AS category, {C.site_or_none(d, text('website'))} AS website, {text('place_url')} AS url, {_SOCIAL} FROM ({details(d)}) r"""


def contact_wire_shape(d):
    """A contact's 15 fields on the wire, with the website and the search query beside them."""
    s = lambda x: C.stripped(d, f"c.{x}")
    return f"""SELECT c.ord, c.campaign_id, c.request_id, coalesce(nullif({s('company_name')}, ''), 'Unknown Business') AS business_name, {s('address')} AS address, {s('category')} AS category, {C.rating(d, s('rating'))} AS rating,
coalesce(TRY_CAST({d.rep(s('reviews'), '[^0-9]', '')} AS BIGINT), 0) AS review_count, {s('phone')} AS phone, {C.site_or_none(d, 'c.website')} AS domain, {_SOCIAL}, {C.place_id(d, 'c.url')} AS place_id,
coalesce({C.picked('l.website')}, 'N/A') AS website, {d.quote_plus("concat(l.name, ' ~*&', l.address)")} AS query FROM ({contact_shape(d)}) c JOIN ({LISTING}) l ON l.ord = c.ord"""


def contact_dedupe_fast(d):
    return keep_first(f"({LISTING}) l", "url, name, address", "ord", "ord, url, name, address")


def contact_dedupe_generic(d):
    """First contact of each (name, website as a URL, phone, address); the reference's domain field holds that URL."""
    sited = C.websites(d, f"(SELECT ord, url, website, coalesce(nullif({C.cleaned(d, 'name')}, ''), 'Unknown Business') AS name, coalesce(phone, '') AS phone, coalesce(address, '') AS address FROM ({LISTING}) l) n", "url", "website", "site")
    return keep_first(f"(SELECT ord, lower(concat(name, '|', site, '|', phone, '|', address)) AS k FROM ({sited}) x) y", "k", "ord", "ord, k")


def request_chunks(d):
    return chunks(f"({LISTING}) l", "campaign_id, request_id", "ord", 20, "ord, campaign_id, request_id")


_OVERLAID = ("name", "address", "phone", "website", "stars", "reviews", "category", "hours", "url", "located_in", "plus_code", "booking_link", "hours_detail")


def contact_enrich(d):
    """Each listing with its place page's 13 values laid over it where they aren't missing."""
    new = {"phone": "CASE WHEN ord % 2 = 0 THEN '' ELSE phone END", "category": "CASE WHEN ord % 4 = 0 THEN 'N/A' ELSE upper(category) END", "url": "place_url"}
    other = {c: f"CASE (ord % 7 + {i}) % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'N/A' ELSE concat(' ', upper({c})) END" for i, c in enumerate(_OVERLAID) if c not in new}
    values = ", ".join(f"{x} AS {c}" for c, x in (other | new).items())
    detail = keep_first(f"(SELECT url AS page, ord AS detail_ord, {values} FROM ({details(d)}) l WHERE ord % 3 = 0) q", "page", "detail_ord", f"page, {', '.join(_OVERLAID)}")
    return f"SELECT l.ord, l.url AS listed_url, {overlay(*_OVERLAID)} FROM ({details(d)}) l LEFT JOIN ({detail}) d ON trim(l.url) = d.page AND trim(l.url) NOT IN ('', 'N/A')"


def campaign_lookup(d):
    first = keep_first("(SELECT n_nationkey, lower(trim(n_name)) AS name FROM nation) n", "name", "n_nationkey", "n_nationkey, name")
    return f"SELECT s.s_suppkey, coalesce(n.n_nationkey, -1) AS campaign_id, coalesce(n.name, '') AS campaign_name FROM supplier s LEFT JOIN nation x ON x.n_nationkey = s.s_nationkey LEFT JOIN ({first}) n ON n.name = lower(trim(x.n_name))"


def unqueued_campaigns(d):
    queued = f"SELECT DISTINCT {d.rep('job', '[.].*$', '')} AS campaign_id FROM (SELECT concat('c', c_nationkey % 4, CASE WHEN c_custkey % 2 = 0 THEN '.json' ELSE '.json.17' END) AS job FROM customer) j"
    return f"SELECT DISTINCT l.campaign_id FROM ({LISTING}) l WHERE NOT EXISTS (SELECT 1 FROM ({queued}) q WHERE q.campaign_id = l.campaign_id)"


def campaigns_missing_email(d):
    return f"SELECT n.n_nationkey, n.n_name FROM nation n WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_custkey % 9 = 0)"


def email_upsert(d):
    news = keep_first("(SELECT o_custkey AS contact_id, o_orderkey AS ord, concat('box', o_orderkey % 100, '@shop.com') AS email FROM orders WHERE o_orderkey % 4 = 0) o", "contact_id", "ord", "contact_id, email")
    return f"SELECT c.c_custkey AS contact_id, coalesce(n.email, CASE WHEN c.c_custkey % 2 = 0 THEN 'old@shop.com' END) AS email, n.contact_id IS NOT NULL AS updated FROM customer c LEFT JOIN ({news}) n ON n.contact_id = c.c_custkey"


def request_selection(d):
    """Five open requests a campaign: pending ones, and those in use only where none is pending."""
    status = "CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN '' WHEN 2 THEN 'inuse' ELSE 'completed' END"
    text = "CASE WHEN o_orderkey % 10 = 0 THEN '  ' ELSE concat('plumber ', o_orderkey) END"
    rows = f"SELECT o_orderkey AS id, o_custkey % 50 AS campaign, {status} AS status, {text} AS req_text FROM orders"
    open_ = f"(SELECT * FROM ({rows}) r WHERE trim(req_text) <> '' AND status IN ('', 'pending', 'inuse')) o"
    pool = f"(SELECT * FROM (SELECT *, max(CASE WHEN status = 'inuse' THEN 0 ELSE 1 END) OVER (PARTITION BY campaign) AS pending FROM {open_}) p WHERE pending = 0 OR status <> 'inuse') s"
    return keep_first(pool, "campaign", "id", "campaign, id, status", 5)


def batch_estimate(d, batch=10, cap=25, multiplier=1.1):
    """Batches for a customer's open orders: rounded up, at least 1 and at most the cap (0: none); 1 where the count is unknown, 0 where nothing is open."""
    e = f"CAST(ceil(pending / {float(max(1, batch))}e0 * {float(max(0.1, multiplier or 1.0))}e0) AS BIGINT)"
    held = f"least({e}, {int(cap)})" if cap > 0 else e
    rows = "SELECT o_custkey, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE sum(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) END AS pending FROM orders GROUP BY o_custkey"
    return f"SELECT o_custkey, pending, CASE WHEN pending IS NULL THEN 1 WHEN pending <= 0 THEN 0 ELSE greatest(1, {held}) END AS batches FROM ({rows}) p"


def retry_classes(d):
    code = "CASE event_id % 8 WHEN 0 THEN 200 WHEN 1 THEN 204 WHEN 2 THEN 408 WHEN 3 THEN 429 WHEN 4 THEN 500 WHEN 5 THEN 599 WHEN 6 THEN 404 ELSE 301 END"
    kind = "CASE WHEN code BETWEEN 200 AND 299 THEN 'ok' WHEN code >= 500 OR code IN (408, 429) THEN 'retry' ELSE 'stop' END"
    return f"SELECT code, {kind} AS outcome, count(*) AS n FROM (SELECT {code} AS code FROM events) e GROUP BY code, {kind}"


_LOG = f"SELECT event_id AS seq, {streams.SOURCE} AS source, {streams.LINE} AS line, ts FROM events"


def outcome_counters(d):
    """What log lines tell of e-mails found; the tests hold in this order."""
    has = lambda x: f"position({d.s(x)} IN line) > 0"
    arrow, done = has("->"), has("✓ DONE")
    tests = [("social", f"{has('FACEBOOK FOUND ')} AND {arrow}"), ("social", f"{done} AND {arrow} AND {has('[FB priority]')}"), ("regular", f"{done} AND {arrow}"), ("regular", f"({has(' - INFO - FOUND ')} OR line LIKE 'FOUND %') AND {arrow}")]
    kind = "CASE " + " ".join(f"WHEN {t} THEN '{k}'" for k, t in tests) + " ELSE 'none' END"
    return f"SELECT source, kind, count(*) AS n FROM (SELECT source, {kind} AS kind FROM (SELECT source, trim(line) AS line FROM ({_LOG}) l) t) k GROUP BY source, kind"


LOG_LINES = 4000


def log_tail(d, n=LOG_LINES):
    """The last n lines of the log, n between 1 and the buffer's 4000; the registered query shows the whole buffer."""
    return f"SELECT seq, source, line FROM ({_LOG}) l ORDER BY seq DESC LIMIT {max(1, min(int(n), LOG_LINES))}"


def last_activity(d):
    return keep_first(f"({_LOG}) l", "source", "seq DESC", "source, seq, line")


def stable_count_stop(d, n=3):
    """For each user, the first event at which a count was unchanged for n observations in a row."""
    rows = "SELECT user_id, event_id, CAST(floor(value / 25) AS BIGINT) AS n FROM events"
    marked = f"SELECT *, CASE WHEN n = lag(n) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM ({rows}) r"
    runs = f"SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS spell FROM ({marked}) m"
    nth = f"SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, spell ORDER BY event_id) AS nth FROM ({runs}) s"
    return f"SELECT user_id, min(event_id) AS stop_at FROM ({nth}) t WHERE nth >= {int(n)} GROUP BY user_id"


def lease_gaps(d):
    """Beats of each run and how many gaps outlast a lease of two hours."""
    gap = "unix_timestamp(ts) - unix_timestamp(lag(ts) OVER w)" if d.explode == "explode" else "CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) AS BIGINT)"
    return f"SELECT user_id, count(*) AS beats, CAST(sum(CASE WHEN gap > 7200 THEN 1 ELSE 0 END) AS BIGINT) AS lost FROM (SELECT user_id, {gap} AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) g GROUP BY user_id"


def json_prop_extract(d):
    return f"SELECT k, count(*) AS n FROM (SELECT {d.hex('props')} AS k FROM events) e GROUP BY k"


def setting_coercion(d):
    raw = "CASE event_id % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN ' 12' WHEN 2 THEN 'abc' WHEN 3 THEN 'on' ELSE '5000' END"
    n = "coalesce(TRY_CAST(trim(raw) AS INT), 10)"
    return f"SELECT raw, lower(trim(raw)) IN ('1', 'true', 'yes', 'on', 'y') AS flag, least(greatest({n}, 1), 4000) AS clamped, CASE WHEN raw IN ('Yes', 'abc') THEN raw ELSE 'fast' END AS mode, count(*) AS n FROM (SELECT {raw} AS raw FROM events) e GROUP BY raw"


def q_join_agg(d):
    return "SELECT n.n_name, count(*) AS n_orders, count(DISTINCT o.o_custkey) AS n_customers FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE o.o_orderstatus = 'O' GROUP BY n.n_name"


def q_rollup(d):
    return "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)"


def q_rank(d):
    return keep_first("orders", "o_custkey", "o_totalprice DESC, o_orderkey", "o_custkey, o_orderkey, rn", 3)


def q_tumbling(d):
    hour = "date_trunc('hour', ts)"
    return f"SELECT {hour} AS start, event_type, count(*) AS n FROM events GROUP BY {hour}, event_type"


_PLANS = {f.__name__: f for f in (
    page_domain_parts, page_url_key_dedupe, doc_email_candidates, doc_email_verdicts, verdict_histogram, page_contact_summary, page_links_topk_padded,
    contact_shape, contact_wire_shape, contact_dedupe_fast, contact_dedupe_generic, request_chunks, contact_enrich, campaign_lookup, unqueued_campaigns,
    campaigns_missing_email, email_upsert, request_selection, batch_estimate, retry_classes, outcome_counters, log_tail, last_activity,
    stable_count_stop, lease_gaps, json_prop_extract, setting_coercion, q_join_agg, q_rollup, q_rank, q_tumbling,
    best_email_per_contact, best_email_in_phases, debug_events, link_kinds, page_social_links, claim_lines, current_work, request_summary,
)} | records.PLANS | {"run_transitions": streams.run_transitions} | {f"best_email_per_page_{p}": partial(best_email, p) for p in POLICIES}


def queries():
    return {name: (lambda spark, sf_dir, f=f: view(spark, sf_dir, f(Spark()))) for name, f in _PLANS.items()} | streams.QUERIES | extraction.QUERIES | temporal.QUERIES | sinks.QUERIES


def oracle_sql():
    return {name: f(DuckDB()) for name, f in _PLANS.items()} | streams.ORACLES | extraction.ORACLES | temporal.ORACLES | sinks.ORACLES


def flagship(spark, sf_dir):
    return view(spark, sf_dir, page_contact_summary(Spark()))
