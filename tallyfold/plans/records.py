"""Queries over records, requests, links and log lines, each one text for Spark and for DuckDB.

Contacts, requests and runs aren't tables here: customers, orders and events
stand in for them, by one text on both sides.
"""

from __future__ import annotations

from tallyfold.functions import contacts as C
from tallyfold.functions import links as L
from tallyfold.functions.rules import LENIENT, STRICT
from tallyfold.operators.ranking import keep_first
from tallyfold.plans.base import LISTING, anchors, candidates, details, hosts, mailed

# -- links -----------------------------------------------------------------


def link_sites(d):
    """Whether each link stays on its page's site: by host, and by registrable domain."""
    dom = f"SELECT page_id, link, {L.site(d, 'url')} AS own, {L.site(d, 'link')} AS other, {C.domain(d, 'url')} AS a, {C.domain(d, 'link')} AS b FROM ({anchors(d)}) l"
    reg = f"SELECT *, {C.registrable(d, 'a', STRICT)} AS ra, {C.registrable(d, 'b', STRICT)} AS rb FROM ({dom}) x"
    return f"SELECT DISTINCT page_id, link, own <> '' AND own = other AS same_host, a <> '' AND b <> '' AND (a = b OR ra = rb) AS same_site FROM ({reg}) y"


def crawl_links_topk(d, k=5, columns="page_id, link, score"):
    """The first k links of a page to go on with: distinct http links of its site, by score, then as they stand on the page."""
    hrefs = d.all("html", "(?is)<a(?:\\s[^>]*)?>")
    raw = f"SELECT page_id, url, {d.posexplode(hrefs, 'tag')} FROM pages"
    href = f"replace(trim({d.rep(f'trim(regexp_extract(tag, {d.s(HREF)}, 1))', chr(94) + chr(91) + chr(34) + chr(39) + ']|[' + chr(34) + chr(39) + ']$', '')}), '&amp;', '&')"
    cut = f"SELECT page_id, url, pos, {href} AS href FROM ({raw}) r"
    # tests are columns up to the aggregate: as filters, they would move down and be made of whole expressions again
    full = f"SELECT page_id, url, pos, href <> '' AND NOT {d.like('href', '^(?:mailto|javascript|tel):')} AS usable, {L.joined(d, 'url', 'href')} AS link FROM ({cut}) c"
    own = f"SELECT page_id, pos, link, usable AND {d.like('link', '^(?i:https?)://')} AS usable, {C.domain(d, 'url')} AS a, {C.domain(d, 'link')} AS b FROM ({full}) f"
    reg = f"SELECT *, {C.registrable(d, 'a', STRICT)} AS ra, {C.registrable(d, 'b', STRICT)} AS rb FROM ({own}) o"
    first = f"SELECT page_id, link, min(CASE WHEN usable AND a <> '' AND b <> '' AND (a = b OR ra = rb) THEN pos END) AS pos FROM ({reg}) s GROUP BY page_id, link"
    scored = f"(SELECT page_id, link, pos, {C.priority(d, 'link', STRICT)} AS score FROM ({first}) u WHERE pos IS NOT NULL) v"
    return keep_first(scored, "page_id", "score, pos", columns, k)


HREF = "(?is)^<a(?:\\s[^>]*?)?\\shref\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s>\"']+)"


def link_scores(d):
    """The better of the scores of a link's path and of its text; whether either holds a target path."""
    like = " OR ".join(L.contact_like(d, x, STRICT.target_paths) for x in ("path", "text"))
    return f"SELECT page_id, link, min(least({C.priority(d, 'path', STRICT)}, {C.priority(d, 'text', STRICT)})) AS score, max(CASE WHEN {like} THEN 1 ELSE 0 END) AS contact_like FROM ({anchors(d)}) a GROUP BY page_id, link"


def block_ordinals(d):
    """Blocks of a page numbered from 1 as they stand."""
    return f"SELECT page_id, pos + 1 AS ordinal, tag AS block FROM (SELECT page_id, {d.posexplode(d.all('html', '(?is)<(?:p|li|h1|h2)[^>]*>'), 'tag')} FROM pages) b"


# -- e-mails ---------------------------------------------------------------


def social_ok(d, email="email"):
    """Whether the looser rule for social pages takes an e-mail."""
    local, host = f"regexp_extract({email}, '^([^@]*)@', 1)", f"regexp_extract({email}, '@(.*)$', 1)"
    words = "|".join(FAKE_LABELS)
    allowed = f"({host} IN ({', '.join(map(d.s, LENIENT.public_providers))}) OR {d.like(host, '(?:' + '|'.join(x.replace('.', '[.]') for x in LENIENT.allowed_suffixes) + ')$')})"
    blocked = d.like(email, "|".join(w.replace(".", "[.]") for w in SOCIAL_BLOCK_SUBSTRINGS))
    return f"coalesce(position('@' IN {email}) > 0 AND NOT {blocked} AND {local} <> '' AND {d.like(host, '[.]')} AND NOT {d.like(host, f'(?:^|[.])(?:{words})(?:[.]|$)')} AND {allowed}, false)"


def social_email_verdicts(d):
    """Which candidates the looser rule for social pages takes."""
    return f"SELECT doc_id, email, {social_ok(d)} AS social_ok FROM ({candidates(d, 'documents', 'doc_id', 'text')}) c"


# The looser rule's words, and labels that generated hosts have. The sample tables' own domain is left out.
SOCIAL_BLOCK_SUBSTRINGS = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", "wixpress.com", "sentry.io", "noreply", "no-reply", "abuse", "subscribe", "mailer-daemon",
    "domain.com", "email.com", "yourname", "wix.com", ".js", ".css", ".html", ".php", ".asp", "-", "order", "call", "phone",
)
FAKE_LABELS = ("last", "schedule", "first", "next", "previous", "temp", "tmp", "placeholder")


def _valid(d, rules=LENIENT):
    """Valid candidates of pages with the parts of their domain, and the page's host."""
    found = candidates(d, mailed(d), "page_id", "html")
    parts = C.email_parts(d, f"(SELECT c.page_id, c.email, h.host FROM ({found}) c JOIN ({hosts(d)}) h ON h.page_id = c.page_id) j", "email", rules)
    return f"SELECT *, {C.verdict(d, 'email', rules)} AS verdict FROM ({parts}) p"


def preferred_emails(d):
    """A page's valid e-mails of its own business if it has any, else all valid ones. The verdict is a part of `own`: as a filter it would move down and be made again."""
    same = C.same_business(d, "host", LENIENT)
    seen = f"SELECT page_id, email, CASE WHEN verdict <> 'ok' THEN -1 WHEN {same} THEN 1 ELSE 0 END AS own FROM ({_valid(d)}) v"
    return f"SELECT page_id, email, own FROM (SELECT *, max(own) OVER (PARTITION BY page_id) AS any_own FROM ({seen}) s) w WHERE own = any_own AND own >= 0"


def page_text(d, x="html"):
    """Text of a page without scripts, styles and tags."""
    return d.rep(d.rep(x, "(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " "), "<[^>]*>", " ")


def fallback_emails(d):
    """A page's e-mail by where it stands: the first of mailto links, else of the text, else of the whole page; each as written and with "at" and "dot" read as signs."""
    mailto = d.join(d.all("html", "(?i)href=[\"']mailto:[^\"']*"), " ")
    source = lambda rank, x: f"SELECT page_id, source_rank, email FROM (SELECT page_id, {rank} AS source_rank, email FROM ({candidates(d, f'(SELECT page_id, {x} AS body FROM {mailed(d)}) s', 'page_id', 'body')}) c) n"
    every = f"({source(1, mailto)} UNION ALL {source(2, page_text(d))} UNION ALL {source(3, 'html')}) u"
    return keep_first(f"(SELECT * FROM {every} WHERE email <> '') k", "page_id", "source_rank, email", "page_id, email, source_rank")


def contact_candidates(d):
    """All distinct candidates of a business over its pages, numbered as sorted; a row each, however many they are."""
    rows = f"SELECT DISTINCT h.host, c.email FROM ({candidates(d, mailed(d), 'page_id', 'html')}) c JOIN ({hosts(d)}) h ON h.page_id = c.page_id WHERE c.email <> ''"
    return f"SELECT host, email, row_number() OVER (PARTITION BY host ORDER BY email) AS place, count(*) OVER (PARTITION BY host) AS n FROM ({rows}) r"


_QUOTED = '"(?:[^"\\\\]|\\\\.)*"'


def linked_emails(d, pages, key="page_id", text="html"):
    """Texts under the key email, in any case and depth, of a page's blocks of linked data; blocks that aren't JSON are left out.

    In JSON without blanks every quote outside a text opens one, so a scan from
    text to text meets each key with its value, and no recursion is needed.
    """
    blocks = f"SELECT {key}, {d.explode}({d.all(text, LINKED_DATA, 1)}) AS block FROM {pages} WHERE {d.like(text, '(?i)ld[+]json')}"
    compact = f"SELECT {key}, {d.compact_json('block')} AS block FROM ({blocks}) b"
    pairs = f"SELECT {key}, {d.explode}({d.all('block', f'{_QUOTED}(?::{_QUOTED})?')}) AS pair FROM ({compact}) c WHERE block IS NOT NULL"
    quoted = f"SELECT {key}, regexp_extract(pair, {d.s(f'^' + chr(34) + '(?i:email)' + chr(34) + f':({_QUOTED})$')}, 1) AS quoted FROM ({pairs}) p"
    said = f"SELECT {key}, {d.json_text('quoted')} AS email FROM ({quoted}) q WHERE quoted <> ''"
    return f"SELECT DISTINCT {key}, {C.older_email(d, 'email')} AS email FROM ({said}) s WHERE {C.older_email(d, 'email')} <> ''"


LINKED_DATA = "(?is)<script[^>]*type\\s*=\\s*[\"']?application/ld[+]json[\"']?[^>]*>(.*?)</script>"


def linked_data_emails(d):
    """E-mails of pages' linked data; the sample pages get blocks of several shapes, as they hold none."""
    shapes = ['{"contact":[{"Email":"Desk@acmefix.com"}], "n": 1.50}', '{"@graph":[{"a":{"EMAIL":"mailto:info@acmefix.com?x=1"}},["email","x"],{"email":["no@list.com"]}]}', '{"say":"she said \\"email\\":\\"no@text.com\\"","email":"a\\u0040acmefix.com"}', '{"email": broken}', '{"email":null,"b":{"email":""}}']
    block = "CASE page_id % 6 " + " ".join(f"WHEN {i} THEN {d.s(x)}" for i, x in enumerate(shapes)) + " ELSE '' END"
    made = f"(SELECT page_id, concat(html, '<script type=\"application/ld+json\">', {block}, '</script>') AS html FROM pages) m"
    return linked_emails(d, made)


def older_email_forms(d):
    """Raw candidates in the older normal form beside the newer."""
    return f"SELECT DISTINCT doc_id, {C.older_email(d, 'raw')} AS older, {C.email(d, 'raw')} AS email FROM (SELECT doc_id, {d.explode}({d.all('text', C.EMAIL + '[.,;?&%=a-z]*')}) AS raw FROM documents WHERE position('@' IN text) > 0) r"


def _protected(text: str, key: int) -> str:
    return f"{key:02x}" + "".join(f"{ord(c) ^ key:02x}" for c in text)


def protected_emails(d):
    """The e-mails behind hex texts by exclusive or, from attributes and from protected links; texts that aren't hex give none."""
    kinds = [_protected("info@acmefix.com", 0x2A), "/cdn-cgi/l/email-protection#" + _protected("Sales@AcmeFix.com", 0x7F), "zz11", "4", _protected("a@b.org", 0x01) + "0"]
    coded = "CASE page_id % 5 " + " ".join(f"WHEN {i} THEN {d.s(x)}" for i, x in enumerate(kinds)) + " END"
    inner = f"SELECT page_id, {d.rep('coded', '^.*/cdn-cgi/l/email-protection#', '')} AS hex FROM (SELECT page_id, {coded} AS coded FROM pages) c"
    return f"SELECT page_id, CASE WHEN {d.like('hex', '^[0-9a-fA-F]{2,}$')} THEN {d.unhex_xor('hex')} ELSE '' END AS email FROM ({inner}) p"


# -- contacts --------------------------------------------------------------


def usable_contacts(d):
    """Contacts with a host to look at, from the first of domain, website and URL that is there."""
    raw = f"SELECT ord, CASE WHEN ord % 4 = 0 THEN concat('shop', ord % 9, '.net') ELSE '' END AS domain, website, CASE WHEN ord % 2 = 0 THEN url ELSE '' END AS url FROM ({LISTING}) l"
    return f"SELECT ord, host FROM (SELECT ord, {C.domain(d, C.picked('domain', 'website', 'url'))} AS host FROM ({raw}) r) h WHERE host IS NOT NULL AND host <> ''"


def contact_key_sets(d):
    """The names of a contact's fields that hold something, further ones with a prefix, in order."""
    own = [(c, f"nullif({C.cleaned(d, c)}, '')") for c in ("name", "stars", "website", "url", "address", "category", "phone")]
    more = [("source_data.hours", "nullif(" + C.cleaned(d, "hours") + ", '')"), ("source_data.plus_code", "CASE WHEN ord % 2 = 0 THEN plus_code END")]
    return f"SELECT ord, {d.join(d.keys(d.entries(*own, *more)), ',')} AS keys FROM ({details(d)}) x"


def place_fields(d):
    """Text without escaped quotes, the id of a place in a URL, and a website's origin."""
    quoted = f"SELECT ord, website, concat({d.s(chr(92) + chr(34))}, name, {d.s(chr(92) + chr(34))}) AS name, place_url FROM ({details(d)}) x"
    origin = L.origin(d, "trim(website)")
    site = f"CASE WHEN website IN ('', 'N/A') THEN 'N/A' WHEN {origin} <> '' THEN {origin} ELSE trim(website) END"
    return f"SELECT ord, {C.stripped(d, 'name')} AS bare, {C.place_id(d, 'place_url')} AS place_id, {site} AS canonical FROM ({quoted}) q"


def website_forms(d):
    """A contact's website as a URL: relative ones against the page, bare hosts with https, redirects unwrapped, one inside another too."""
    once = "https://l.facebook.com/l.php?u=https%3A%2F%2Fshop', ord, '.com%2Fa%2F&h=1"
    twice = "https://l.facebook.com/l.php?h=2&u=https%3A%2F%2Fl.facebook.com%2Fl.php%3Fu%3Dhttps%253A%252F%252Fshop', ord, '.com%252Fb%252F%26h%3D1"
    raw = f"""CASE ord % 7 WHEN 0 THEN concat('shop', ord, '.com/') WHEN 1 THEN concat('//shop', ord, '.com/x/') WHEN 2 THEN '/about/'
WHEN 3 THEN concat('{once}') WHEN 4 THEN ' n/a ' WHEN 5 THEN concat('{twice}') ELSE website END"""
    return f"SELECT ord, raw, site FROM ({C.websites(d, f'(SELECT ord, url, {raw} AS raw FROM (SELECT ord, url, website FROM ({LISTING}) l) k) r', 'url', 'raw', 'site')}) s"


def hours_text(d):
    """Opening hours, a row for each day, as one text; blank rows are left out."""
    rows = d.array("concat('Mon: ', ord % 9, '-18')", "CASE WHEN ord % 2 = 0 THEN '  ' ELSE 'Tue: closed' END", "concat(' Wed: ', ord % 5, ' ')")
    kept = d.filter(d.map(rows, "trim(v)"), "v <> ''")
    return f"SELECT ord, {d.join(kept, '; ')} AS hours FROM ({LISTING}) l"


def block_detail(d):
    """Each block with its detail page's values over its own; of detail rows with one key the first counts."""
    key = C.url_key(d, "url")
    block = f"SELECT ord, {key} AS k, name, {d.entries(('hours', 'hours'), ('plus', 'plus_code'))} AS source_data FROM ({details(d)}) l"
    new = d.entries(("hours", "CASE WHEN ord % 2 = 0 THEN hours_detail END"), ("booking", "nullif(booking_link, '')"))
    detail = keep_first(f"(SELECT {key} AS k, ord, upper(name) AS name, {new} AS source_data FROM ({details(d)}) l WHERE ord % 3 = 0) q", "k", "ord", "k, name, source_data")
    empty = f"map_filter(b.source_data, (k, v) -> false)" if d.explode == "explode" else "MAP {}"  # noqa: F541
    merged = d.laid_over("b.source_data", f"coalesce(t.source_data, {empty})") if d.explode == "explode" else f"CASE WHEN t.k IS NULL THEN b.source_data ELSE {d.laid_over('b.source_data', 't.source_data')} END"
    return f"SELECT ord, name, {d.shown('source_data')} AS source_data FROM (SELECT b.ord, coalesce({C.picked('t.name')}, b.name) AS name, {merged} AS source_data FROM ({block}) b LEFT JOIN ({detail}) t ON t.k = b.k) m"


def detail_url_fallback(d):
    """Where a contact's detail page is: the first of its fields that looks like a URL, and which field that is."""
    fields = {"facebook": "CASE WHEN ord % 9 = 0 THEN 'https://facebook.com/shop/' END", "fb_link": "''", "profile_url": "CASE WHEN ord % 4 = 1 THEN 'by phone' ELSE '' END", "url": "CASE WHEN ord % 3 = 0 THEN 'N/A' ELSE url END", "website": "website",
              "domain": "NULL", "www": "NULL", "source_data.facebook": "NULL", "source_data.fb_link": "CASE WHEN ord % 2 = 0 THEN '/pages/shop/' ELSE 'nothing here' END"}
    rows = ", ".join(f"{C.cleaned(d, x)} AS f{i}" for i, x in enumerate(fields.values()))
    test = lambda i: f"f{i} <> '' AND ({L.looks_like_url(d, f'f{i}')} OR f{i} LIKE '//%')"
    pick = lambda to: "CASE " + " ".join(f"WHEN {test(i)} THEN {to(i, n)}" for i, n in enumerate(fields)) + " ELSE '' END"
    chosen = f"SELECT ord, base, {pick(lambda i, n: d.s(n))} AS label, {pick(lambda i, n: f'f{i}')} AS raw FROM (SELECT ord, base, {rows} FROM (SELECT *, 'https://maps.example.net/list' AS base FROM ({LISTING}) l) k) r"
    return f"SELECT ord, label, CASE WHEN raw = '' THEN '' ELSE {L.slashless(d, 'full_url')} END AS detail_url FROM (SELECT ord, label, raw, {L.joined(d, 'base', 'raw')} AS full_url FROM ({chosen}) c) f"


# -- requests, campaigns, runs ----------------------------------------------

_REQUESTS = """SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 23 = 0 THEN ' ' ELSE concat('q', o_orderkey) END AS id, concat('c', o_custkey % 50) AS campaign,
  CASE o_orderkey % 5 WHEN 0 THEN 'Pending' WHEN 1 THEN '' WHEN 2 THEN 'INUSE' ELSE 'completed' END AS status,
  CASE WHEN o_orderkey % 10 = 0 THEN '  ' ELSE concat(' plumber ', o_orderkey, ' ') END AS req_text FROM orders"""


def request_scan(d, include_inuse=False):
    """A campaign's requests with an id, status in lower case; those in use only on demand."""
    keep = "" if include_inuse else " AND lower(trim(status)) <> 'inuse'"
    return f"SELECT campaign, trim(id) AS id, trim(req_text) AS req_text, lower(trim(status)) AS status FROM ({_REQUESTS}) r WHERE trim(id) <> ''{keep}"


def blank_requests(d):
    """Requests as they go on: those without a text are completed and not processed."""
    return f"SELECT campaign, id, CASE WHEN req_text = '' THEN 'completed' ELSE status END AS status, req_text <> '' AS processed FROM ({request_scan(d, True)}) s"


def request_status_update(d):
    """A new snapshot of the requests' states: the last change of each request wins, unknown ids change nothing."""
    changes = "SELECT l_orderkey AS ord, l_linenumber AS seq, CASE l_linenumber % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'inuse' ELSE 'pending' END AS state FROM lineitem WHERE l_orderkey % 2 = 0"
    last = keep_first(f"({changes}) c", "ord", "seq DESC", "ord, state")
    return f"SELECT r.ord, r.id, coalesce(u.state, lower(r.status)) AS status FROM ({_REQUESTS}) r LEFT JOIN ({last}) u ON u.ord = r.ord"


def missing_email_pull(d, batch=10):
    """The next contacts of each campaign that lack an e-mail, a batch at most."""
    rows = f"SELECT ord, campaign_id, CASE WHEN ord % 3 = 0 THEN 'a@b.com' WHEN ord % 3 = 1 THEN '' END AS email FROM ({LISTING}) l"
    return keep_first(f"(SELECT * FROM ({rows}) r WHERE email IS NULL OR email = '') m", "campaign_id", "ord", "campaign_id, ord", batch)


def slow_place_urls(d):
    """Places to open, each once: the first request that lists a place owns it; requests without a text list none."""
    return keep_first(f"(SELECT * FROM ({LISTING}) l WHERE trim(request_id) <> '') r", "url", "request_id, ord", "url, request_id, ord")


def unqueued_exact(d):
    """Campaigns without a job file of exactly their name; files that were moved aside don't count here."""
    queued = "SELECT DISTINCT concat('c', c_nationkey % 4, CASE WHEN c_nationkey % 4 = 2 THEN '.json.17' ELSE '.json' END) AS job FROM customer"
    return f"SELECT DISTINCT l.campaign_id FROM ({LISTING}) l LEFT ANTI JOIN ({queued}) q ON q.job = concat(l.campaign_id, '.json')" if d.explode == "explode" else f"SELECT DISTINCT l.campaign_id FROM ({LISTING}) l ANTI JOIN ({queued}) q ON q.job = concat(l.campaign_id, '.json')"


def queue_depth(d):
    """Files that wait in each queue; hidden ones don't count."""
    names = "SELECT concat('queue', c_nationkey % 3) AS folder, concat(CASE WHEN c_custkey % 7 = 0 THEN '.' ELSE '' END, 'campaign_', c_custkey, '.json') AS name FROM customer"
    return f"SELECT folder, CAST(sum(CASE WHEN name LIKE '.%' THEN 0 ELSE 1 END) AS BIGINT) AS depth FROM ({names}) f GROUP BY folder"


def discovery_stats(d):
    """Active campaigns, those now queued, and those without a contact that lacks an e-mail."""
    rows = "SELECT n_nationkey AS id, max(CASE WHEN c_custkey % 9 = 0 AND c_nationkey % 4 <> 0 THEN 1 ELSE 0 END) AS lacking FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey"
    n = lambda x: f"CAST(sum(CASE WHEN {x} THEN 1 ELSE 0 END) AS BIGINT)"
    return f"SELECT count(*) AS active, {n('lacking = 1 AND id % 5 <> 0')} AS queued, {n('lacking = 0')} AS no_nomail FROM ({rows}) r"


_SENT = """SELECT ord, campaign_id, request_id, CAST(floor(ord / 20) AS BIGINT) AS batch_no, ord % 20 NOT IN (3, 7) OR floor(ord / 20) % 3 <> 1 AS accepted FROM ({0}) l"""


def resend_split(d):
    """What becomes of each contact: a batch that fails is sent again row by row, and what fails then is a dead letter."""
    rows = f"SELECT *, min(CASE WHEN accepted THEN 1 ELSE 0 END) OVER (PARTITION BY campaign_id, request_id, batch_no) AS whole FROM ({_SENT.format(LISTING)}) s"
    return f"SELECT ord, campaign_id, request_id, batch_no, CASE WHEN whole = 1 THEN 'batch' WHEN accepted THEN 'individual' ELSE 'dead letter' END AS outcome FROM ({rows}) r"


def resend_counts(d):
    n = lambda x: f"CAST(sum(CASE WHEN outcome = '{x}' THEN 1 ELSE 0 END) AS BIGINT)"
    return f"SELECT campaign_id, request_id, {n('batch')} AS sent, {n('individual')} AS recovered, {n('dead letter')} AS failed FROM ({resend_split(d)}) r GROUP BY campaign_id, request_id"


def email_payloads(d, batch=25):
    """Updates as they go out: one JSON text of ids and e-mails a batch."""
    rows = f"SELECT o_orderkey AS id, concat('box', o_orderkey % 100, '@shop.com') AS email, CAST(floor(o_orderkey / {batch}) AS BIGINT) AS batch_no FROM orders WHERE o_orderkey % 4 = 0"
    return f"SELECT batch_no, {d.payload('contacts', 'id', 'email')} AS payload FROM ({rows}) r GROUP BY batch_no"


_CLAIM_TEXTS = """SELECT event_id, CASE event_id % 8
WHEN 0 THEN concat('{"claimed":true,"run_id":"r', event_id, '","stage":"email_fast","campaign_id":"', user_id, '"}')
WHEN 1 THEN concat('{"status":"Claimed","run":{"id":"r', event_id, '","current_stage":"finalize","campaign":', user_id, '}}')
WHEN 2 THEN concat('{"claimed":"yes","run":{"run_id":"r', event_id, '"}}')
WHEN 3 THEN '{"claimed":false,"reason":"empty"}'
WHEN 4 THEN concat('{"run_id":" N/A ","run":{"run_id":"r', event_id, '","stage":"maps_scrape"},"campaign_id":"', user_id, '"}')
WHEN 5 THEN concat('{"claimed":0,"run_id":"r', event_id, '","current_stage":"cleanup_contacts","campaign_id":"', user_id, '"}')
WHEN 6 THEN concat('{"run_id":"r', event_id, '","stage":"none","run":{"current_stage":"email_fallback"},"campaign_id":"nil"}') ELSE '{}' END AS answer FROM events"""


def _chain(d, *paths):
    one = lambda p: f"trim(coalesce({d.json('answer', p)}, ''))"
    return "coalesce(" + ", ".join(f"CASE WHEN lower({one(p)}) IN ('', 'none', 'null', 'nil', 'n/a') THEN NULL ELSE {one(p)} END" for p in paths) + ", '')"


def claim_acceptance(d):
    """Whether an answer to a claim holds a run: by its identifiers, under any of their names; a claim without them is malformed."""
    parts = f"""SELECT event_id, {_chain(d, '$.run_id', '$.run.run_id', '$.run.id')} AS run_id, {_chain(d, '$.stage', '$.current_stage', '$.run.stage', '$.run.current_stage')} AS stage,
{_chain(d, '$.campaign_id', '$.run.campaign_id', '$.run.campaign')} AS campaign_id, lower(trim(coalesce({d.json('answer', '$.claimed')}, ''))) IN ('true', '1', 'yes') OR lower(trim(coalesce({d.json('answer', '$.status')}, ''))) = 'claimed' AS said FROM ({_CLAIM_TEXTS}) a"""
    whole = "run_id <> '' AND stage <> '' AND campaign_id <> ''"
    return f"SELECT event_id, run_id, stage, campaign_id, {whole} AS claimed, said AND NOT ({whole}) AS malformed FROM ({parts}) p"


def campaign_progress(d):
    """A campaign's counts of requests in a status document; 0 where a level is missing or not of its kind."""
    doc = "CASE event_id % 3 WHEN 0 THEN concat('{\"campaigns\":{\"c1\":{\"requests\":{\"unfinished\":', event_id, ',\"total\":9}}}}') WHEN 1 THEN '{\"campaigns\":{\"c1\":7}}' ELSE '[]' END"
    n = lambda k: f"coalesce(TRY_CAST({d.json('doc', f'$.campaigns.c1.requests.{k}')} AS BIGINT), 0)"
    return f"SELECT event_id, {n('unfinished')} AS unfinished, {n('total')} AS total FROM (SELECT event_id, {doc} AS doc FROM events) e"


STAGES = ("maps_scrape", "cleanup_contacts", "email_fast", "email_fallback", "finalize")

_RUNS = """SELECT user_id AS run_id, event_id AS seq, CASE event_id % 7 WHEN 0 THEN 'maps_scrape' WHEN 1 THEN 'cleanup_contacts' WHEN 2 THEN 'email_fast' WHEN 3 THEN 'email_fallback'
WHEN 4 THEN 'finalize' WHEN 5 THEN 'polish' ELSE 'maps_scrape' END AS stage, CASE WHEN event_id % 11 = 0 THEN 'fail' ELSE 'complete' END AS event FROM events"""


def run_states(d):
    """Where each run stands after its last stage event, and the stage that comes next."""
    names = ", ".join(map(d.s, STAGES))
    state = f"CASE WHEN stage NOT IN ({names}) THEN 'unsupported' WHEN event = 'fail' THEN 'failed' WHEN stage = '{STAGES[-1]}' THEN 'done' ELSE 'open' END"
    after = "CASE stage " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(STAGES, STAGES[1:])) + " END"
    return f"SELECT run_id, seq, stage, {state} AS state, CASE WHEN {state} = 'open' THEN {after} END AS next_stage FROM ({keep_first(f'({_RUNS}) r', 'run_id', 'seq DESC', 'run_id, seq, stage, event')}) l"


def empty_checks(d, n=3):
    """How each campaign's polling ends: complete at an empty answer with nothing unfinished, an error at the n-th empty one in a row that isn't so."""
    polls = "SELECT user_id AS campaign, event_id AS seq, CASE WHEN event_id % 4 <> 0 THEN 0 ELSE 3 END AS listed, CASE WHEN event_id % 13 = 0 THEN 0 WHEN event_id % 5 = 0 THEN NULL ELSE 4 END AS unfinished FROM events"
    runs = f"SELECT *, sum(CASE WHEN listed > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY campaign ORDER BY seq ROWS UNBOUNDED PRECEDING) AS spell FROM ({polls}) p"
    counted = f"SELECT *, row_number() OVER (PARTITION BY campaign, spell ORDER BY seq) AS nth FROM ({runs}) r WHERE listed = 0"
    ends = f"(SELECT campaign, seq, CASE WHEN unfinished = 0 THEN 'complete' ELSE 'error' END AS outcome FROM ({counted}) c WHERE unfinished = 0 OR nth >= {n}) e"
    return keep_first(ends, "campaign", "seq", "campaign, seq, outcome")


def stage_titles(d):
    """The text that tells a worker's current work."""
    stage = d.title("replace(trim(stage), '_', ' ')")
    named = "coalesce(nullif(campaign_name, ''), concat('Campaign ', campaign_id))"
    rows = "SELECT event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'email_fast' WHEN 1 THEN ' maps_scrape ' ELSE 'finalize' END AS stage, CASE event_id % 4 WHEN 0 THEN concat('Shop ', user_id) WHEN 1 THEN '' END AS campaign_name, user_id AS campaign_id, event_id % 6 = 5 AS failed FROM events"
    shown = f"CASE WHEN failed THEN concat('Campaign #', campaign_id, ' · Failed (', {stage}, ')') WHEN campaign_name IS NULL THEN concat('Campaign #', campaign_id, ' · ', {stage}) ELSE concat({named}, ' (#', campaign_id, ') · ', {stage}) END"
    return f"SELECT seq, {stage} AS stage, {shown} AS work FROM ({rows}) r"


# -- settings, text, numbers -------------------------------------------------


def device_stats(d):
    """Mean use, memory and its share over devices, from comma-separated lines; lines that don't parse are left out."""
    lines = "SELECT user_id, CASE event_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN concat(event_id % 100, ', x, 100') ELSE concat(event_id % 100, ', ', event_id % 700, ' , 1000.5') END AS line FROM events"
    parts = f"SELECT user_id, {d.split('line', ',')} AS p FROM ({lines}) l WHERE line LIKE '%,%,%'"
    at = lambda i: f"TRY_CAST(trim(p[{i if d.explode == 'explode' else i + 1}]) AS DOUBLE)"
    rows = f"SELECT * FROM (SELECT user_id, {at(0)} AS util, {at(1)} AS used, {at(2)} AS total FROM ({parts}) s) t WHERE util IS NOT NULL AND used IS NOT NULL AND total IS NOT NULL"
    share = "CASE WHEN sum(total) > 0 THEN round(sum(used) / sum(total) * 100.0e0, 1) ELSE 0.0e0 END"
    return f"SELECT user_id, round(avg(util), 1) AS percent, round(sum(used), 1) AS used, round(sum(total), 1) AS total, {share} AS share FROM ({rows}) r GROUP BY user_id"


def extension_lists(d):
    """Settings that list file extensions, in normal form: a row for each, once, as first named."""
    raw = d.s(".PNG, *.jpg;webp\nsvg") , d.s("mp4 ,, .mp4;a/b;x?y"), d.s("*"), d.s("")
    setting = f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN {raw[0]} WHEN 1 THEN {raw[1]} WHEN 2 THEN {raw[2]} ELSE {raw[3]} END AS setting FROM events"
    items = f"SELECT event_id, {d.posexplode(d.split('setting', '[,;' + chr(10) + ']'), 'item')} FROM ({setting}) s"
    bare = f"SELECT event_id, pos, {d.rep('lower(trim(item))', '^[*]+', '')} AS ext FROM ({items}) i WHERE trim(item) <> ''"
    dotted = f"SELECT event_id, pos, CASE WHEN ext LIKE '.%' THEN ext ELSE concat('.', ext) END AS ext FROM ({bare}) b"
    return f"SELECT event_id, ext, min(pos) AS pos FROM ({dotted}) t WHERE NOT {d.like('ext', '[/?#' + chr(92) * 2 + ']')} GROUP BY event_id, ext"


def pause_ranges(d):
    """Pauses as an ordered range of numbers from 0 up; a default where a bound is missing or no number."""
    rows = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN '-2' ELSE CAST(event_id % 9 AS {0}) END AS lo, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 5 AS {0}) END AS hi FROM events".format("STRING" if d.explode == "explode" else "VARCHAR")
    n = lambda x, default: f"greatest(0.0e0, coalesce(TRY_CAST({x} AS DOUBLE), {default}))"
    a, b = n("lo", "1.5e0"), n("hi", "3.0e0")
    return f"SELECT event_id, least({a}, {b}) AS low, greatest({a}, {b}) AS high FROM ({rows}) r"


def iso_times(d):
    return f"SELECT event_id, {d.iso('ts')} AS created_at FROM events"


def _values(d):
    """A page's values: the texts between its tags, in order."""
    texts = d.filter(d.map(d.split("html", "<[^>]*>"), d.rep("trim(v)", "\\s+", " ")), "v <> ''")
    return f"SELECT page_id, {texts} AS vals FROM pages"


#: A pattern with one group, and one without.
PATTERNS = ("(?is)([a-z0-9._-]+)@[a-z0-9.-]+", "(?is)[0-9]{3,}")


def regex_attempts(d, pattern=PATTERNS[0], group=1, limit=12):
    """What a pattern finds in each of a page's first values: its group, or the whole match without one."""
    rows = f"SELECT page_id, {d.posexplode('vals', 'v')} FROM ({_values(d)}) x"
    got = C.cleaned(d, f"regexp_extract(v, {d.s(pattern)}, {group})")
    return f"SELECT page_id, pos + 1 AS attempt, hit <> '' AS matched, hit, substring(v, 1, 300) AS preview FROM (SELECT page_id, pos, v, {got} AS hit FROM (SELECT page_id, pos, {C.cleaned(d, 'v')} AS v FROM ({rows}) r) c WHERE pos < {limit}) h"


def first_matched(d):
    """The number of the first attempt that matched, 0 without one."""
    return f"SELECT page_id, coalesce(min(CASE WHEN matched THEN attempt END), 0) AS matched_index, count(*) AS attempts FROM ({regex_attempts(d)}) a GROUP BY page_id"


def regex_field_values(d, pattern=PATTERNS[1], group=0):
    """A field's value: what the pattern finds in the first value that has it, else in all values joined."""
    hit = lambda x: C.cleaned(d, f"regexp_extract({x}, {d.s(pattern)}, {group})")
    each = d.filter(d.map("vals", hit("v")), "v <> ''")
    whole = C.cleaned(d, d.join("vals", " "))
    first = "hits[0]" if d.explode == "explode" else "hits[1]"
    some = "size(hits) > 0" if d.explode == "explode" else "len(hits) > 0"
    return f"SELECT page_id, CASE WHEN {some} THEN {first} ELSE {hit('joined')} END AS field_value FROM (SELECT page_id, {each} AS hits, {whole} AS joined FROM ({_values(d)}) x) y"


# -- windows over time: extensions, not operators of the contact rules ------------


def q_sliding(d):
    """Events of each type in windows of an hour that begin every half hour."""
    half = "1800"
    second = "unix_timestamp(ts)" if d.explode == "explode" else "CAST(floor(epoch(ts)) AS BIGINT)"
    slot = f"CAST(floor({second} / {half}) AS BIGINT)"
    if d.explode == "explode":
        return "SELECT CAST(unix_timestamp(window.start) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY window(ts, '1 hour', '30 minutes'), event_type"
    return f"SELECT s * {half} AS start, event_type, count(*) AS n FROM (SELECT unnest([{slot} - 1, {slot}]) AS s, event_type FROM events) e GROUP BY s, event_type"


def q_session(d):
    """Sessions of each user: events less than half an hour apart."""
    if d.explode == "explode":
        return "SELECT user_id, CAST(unix_timestamp(session_window.start) AS BIGINT) AS start, count(*) AS n FROM events GROUP BY session_window(ts, '30 minutes'), user_id"
    gap = "SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)"
    return f"SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM ({gap}) g) h GROUP BY user_id, s"


PLANS = {f.__name__: f for f in (
    link_sites, crawl_links_topk, link_scores, block_ordinals, social_email_verdicts, preferred_emails, fallback_emails, contact_candidates, linked_data_emails, older_email_forms, protected_emails,
    usable_contacts, contact_key_sets, place_fields, website_forms, hours_text, block_detail, detail_url_fallback, request_scan, blank_requests, request_status_update,
    missing_email_pull, slow_place_urls, unqueued_exact, queue_depth, discovery_stats, resend_split, resend_counts, email_payloads, claim_acceptance, campaign_progress,
    run_states, empty_checks, stage_titles, device_stats, extension_lists, pause_ranges, iso_times, regex_attempts, first_matched, regex_field_values, q_sliding, q_session,
)}
