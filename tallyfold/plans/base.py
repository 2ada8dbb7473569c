"""What several plans read: hosts, links and candidates of pages, and listings that stand in for contacts."""

from __future__ import annotations

from tallyfold.functions import contacts as C
from tallyfold.functions import links as L
from tallyfold.functions.rules import LENIENT, POLICIES


def hosts(d):
    return f"SELECT page_id, url, {C.domain(d, 'url')} AS host FROM pages"


def mailed(d):
    """Pages with made-up addresses at their ends, as the sample pages hold none: of the page's business, of others and of public providers."""
    own = C.domain(d, "url")
    made = f"""CASE page_id % 4 WHEN 0 THEN concat('<a href="mailto:Info@', {own}, '?subject=x">w</a> jane@gmail.com sales@othershop', page_id % 7, '.com')
WHEN 1 THEN concat(' owner@gmail.com bob@', {own}) WHEN 2 THEN concat(' <p>jane@othershop.com, or jane (at) ', {own}, '</p>') ELSE '' END"""
    return f"(SELECT page_id, url, concat(html, {made}) AS html FROM pages) mailed"


def candidates(d, table, key, text):
    """Distinct (key, email) from the text and from its deobfuscated form; the cheap test comes first."""
    found = f"SELECT {key}, {d.explode}({d.all(text, C.EMAIL)}) AS raw FROM {table} WHERE position('@' IN {text}) > 0"
    plain = f"SELECT {key}, {d.explode}({d.all(C.deobfuscate(d, text), C.EMAIL)}) AS raw FROM {table} WHERE {d.like(text, '(?i)@|at')}"
    return f"SELECT DISTINCT {key}, {C.email(d, 'raw')} AS email FROM ({found} UNION ALL {plain}) c"


def ranked(d, policy, pages="pages", rules=LENIENT, key="page_id"):
    """Candidates of pages with their verdict, tier and place in their page's order; tier 9 isn't allowed. key "host": those of all pages of a business, each once, in its order.

    Each stage names what the next one reads, so no expression holds another's
    text. The filter on verdicts is a part of the tier: as a filter, it would
    move down to the texts with all that it is made of.
    """
    columns = "c.page_id, c.email, h.host" if key == "page_id" else "DISTINCT c.email, h.host"
    found = f"SELECT {columns} FROM ({candidates(d, pages, 'page_id', 'html')}) c JOIN ({hosts(d)}) h ON c.page_id = h.page_id"
    parts = C.email_parts(d, f"({found}) f", "email", rules)
    checked = f"SELECT *, {C.verdict(d, 'email', rules)} AS verdict, {C.registrable(d, 'host', rules)} AS host_reg FROM ({parts}) p"
    named = f"SELECT *, {C.token(d, 'host_reg')} AS bt, {C.token(d, 'reg')} AS et, {d.rep('local', '[^a-z0-9]+', '')} AS lt, {C.same_business(d, 'host', rules, 'host_reg')} AS same FROM ({checked}) k"
    tier, keys = C.best_order(d, "email", "host", rules, POLICIES[policy])
    tiers = f"SELECT *, CASE WHEN verdict = 'ok' THEN {tier} ELSE 9 END AS tier FROM ({named}) n"
    ordered = f"SELECT *, {', '.join(f'{k} AS k{i}' for i, k in enumerate(keys))} FROM ({tiers}) t"
    return f"SELECT {'page_id, ' if key == 'page_id' else ''}host, email, verdict, tier, row_number() OVER (PARTITION BY {key} ORDER BY tier, {', '.join(f'k{i}' for i in range(len(keys)))}, email) AS rn FROM ({ordered}) o"


def anchors(d, marked=False):
    """Every anchor of each page: its absolute link, the link's path and its text without tags. marked: and a row with mark for the page itself, all from one scan."""
    found = f"{d.all('html', _ANCHOR)} || {d.array(d.s(''))}" if marked else d.all("html", _ANCHOR)
    tags = f"SELECT page_id, url, {d.explode}({found}) AS tag FROM pages"
    bare = lambda x: d.rep(f"trim({x})", "^[\"']|[\"']$", "")
    href = f"replace(trim({bare(f'regexp_extract(tag, {d.s(_HREF)}, 1)')}), '&amp;', '&')"
    cut = f"SELECT page_id, url, tag = '' AS mark, {href} AS href, {d.rep('tag', '<[^>]*>', '')} AS text FROM ({tags}) t"
    full = f"SELECT page_id, url, mark, text, {L.joined(d, 'url', 'href')} AS link FROM ({cut}) c WHERE NOT {d.like('href', '^(?i:mailto):')}"
    return f"SELECT page_id, url, {'mark, ' if marked else ''}text, link, {d.rep(L.path(d, 'link'), ';[^/]*$', '')} AS path FROM ({full}) f"


_ANCHOR = "(?is)<a(?:\\s[^>]*)?>(?:.*?</a>|.*)"
_HREF = "(?is)^<a(?:\\s[^>]*?)?\\shref\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s>\"']+)"

#: Contacts and requests aren't tables here; customers and orders stand in, by one text on both sides.
LISTING = """SELECT c_custkey AS ord, concat('c', c_nationkey % 5) AS campaign_id, concat('r', c_custkey % 7) AS request_id,
  CASE WHEN c_custkey % 11 = 0 THEN 'N/A' ELSE concat('Shop ', c_custkey % 40) END AS name, CASE WHEN c_custkey % 3 = 0 THEN concat(c_acctbal, ' stars') WHEN c_custkey % 3 = 1 THEN 'N/A' ELSE '4.5' END AS stars,
  concat(c_custkey, ' (1,', 100 + c_custkey % 900, ')') AS reviews, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('https://www.shop', c_custkey % 40, '.com/a?b=1') END AS website,
  concat('https://maps.example.net/p/', c_custkey % 60, '/') AS url, concat(c_custkey % 13, ' Main St') AS address, lower(c_mktsegment) AS category, concat('+1 555 ', c_custkey % 17) AS phone FROM customer"""


#: The listing with the fields that only place pages have, some categories that are lists, and URLs with a place's id.
def details(d):
    both = d.json_list(d.array("category", "concat('sub ', ord % 3)"))
    return f"""SELECT l.*, CASE WHEN ord % 6 = 0 THEN {both} ELSE category END AS categories, CASE WHEN ord % 2 = 0 THEN concat(url, '?q=place_id:ChIJ', ord, '/x') ELSE url END AS place_url,
{d.rep('reviews', '^[^(]*', '')} AS review_text, {d.rep('stars', '^-', '')} AS star_text, concat('Mall ', ord % 4) AS located_in, CASE WHEN ord % 4 = 0 THEN 'N/A' ELSE 'Open' END AS hours,
concat('Mon: ', ord % 9, '-18') AS hours_detail, concat('9F', ord % 8, '+2X') AS plus_code, CASE WHEN ord % 3 = 0 THEN '' ELSE concat('https://book.example.net/', ord) END AS booking_link FROM ({LISTING}) l"""
