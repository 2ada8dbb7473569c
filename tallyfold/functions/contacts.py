"""Scalar contact functions as SQL expressions over a dialect: domains, e-mails, URLs, record fields."""

from __future__ import annotations

from tallyfold.functions.rules import Rules

EMAIL = "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}"


def _any(words) -> str:
    return "|".join(w.replace(".", "[.]") for w in words)


def domain(d, x: str) -> str:
    """Host of a URL or bare domain: lower case, without user, port, edge dots and one leading www."""
    host = f"regexp_extract(lower(trim({x})), {d.s('^(?:[^:/?#]*://)?([^/?#]*)')}, 1)"
    return d.rep(d.rep(d.rep(d.rep(host, "^.*@", ""), ":.*$", ""), "^[.]+|[.]+$", ""), "^www[.]", "")


def registrable(d, host: str, rules: Rules) -> str:
    """The last two labels of a normalized host, three under a second-level word, all of a single label."""
    three = f"regexp_extract({host}, {d.s('[^.]+[.](?:' + '|'.join(rules.second_level) + ')[.][^.]+$')}, 0)"
    two = f"regexp_extract({host}, {d.s('[^.]+[.][^.]+$')}, 0)"
    return f"coalesce(nullif({three}, ''), nullif({two}, ''), {host})"


def url_key(d, x: str) -> str:
    """Key for equal pages: lower scheme and host, path without trailing slashes, query kept, fragment dropped."""
    whole = d.rep(f"trim({x})", "#.*$", "")
    head = f"lower(regexp_extract({whole}, {d.s('^[^/?]*//[^/?]*')}, 0))"
    path = d.rep(f"regexp_extract({whole}, {d.s('^[^/?]*//[^/?]*([^?]*)')}, 1)", "/+$", "")
    return f"concat({head}, {path}, regexp_extract({whole}, {d.s('[?].*$')}, 0))"


def email(d, x: str) -> str:
    """A candidate in normal form: unquoted, stripped of wrapping, mailto: and trailing parameters, lower case."""
    y = d.rep(f"trim({d.unquote(x)})", "^[<>\"']+|[<>\"']+$", "")
    y = d.rep(d.rep(y, "^(?i:mailto:)", ""), "[?#&,;].*$", "")
    return f"lower({d.rep(f'trim({y})', chr(94) + chr(91) + EDGE + chr(93) + '+|[' + EDGE + ']+$', '')})"


def older_email(d, x: str) -> str:
    """A candidate in the older normal form: not unquoted, no punctuation off the ends."""
    y = d.rep(f"trim({x})", "^[<>\"']+|[<>\"']+$", "")
    return f"lower(trim({d.rep(d.rep(y, '^(?i:mailto:)', ''), '[?#&,;].*$', '')}))"


EDGE = "()\\[\\]{}<>\"'.,:"


def deobfuscate(d, x: str) -> str:
    """ "at" and "dot", bracketed or not, as @ and a dot; words that contain them change too, as the rule has it."""
    y = f"concat(' ', {x}, ' ')"
    for pattern, to in (("(?i)\\s*[(\\[]?at[)\\]]?\\s*", "@"), ("(?i)\\s*[(\\[]?dot[)\\]]?\\s*", "."), ("\\s+@\\s+", "@"), ("\\s*[.]\\s*", ".")):
        y = d.rep(y, pattern, to)
    return y


def email_parts(d, source: str, e: str, rules: Rules) -> str:
    """source with an e-mail's local part, raw domain, normalized domain and registrable domain, each made once."""
    cut = f"SELECT *, regexp_extract({e}, '^([^@]*)@', 1) AS local, regexp_extract({e}, '@(.*)$', 1) AS raw FROM {source}"
    return f"SELECT *, {registrable(d, 'dom', rules)} AS reg FROM (SELECT *, {domain(d, 'raw')} AS dom FROM ({cut}) cut) named"


def verdict(d, e: str, rules: Rules) -> str:
    """Why a normalized e-mail is rejected, or ok; the first rule that applies. It reads the columns of email_parts()."""
    local, raw, dom, reg = "local", "raw", "dom", "reg"
    allowed = f"{dom} IN ({', '.join(map(d.s, rules.public_providers))}) OR {d.like(dom, '(?:' + _any(rules.allowed_suffixes) + ')$')}"
    tests = [
        ("empty", f"{e} IS NULL OR {e} = ''"),
        ("blocked_pattern", d.like(e, _any(rules.block_substrings))),
        ("malformed", f"NOT {d.like(e, '^[^@]+@[^@]+$')} OR {d.like(raw, '^[.]|[.]$')} OR {dom} = ''"),
        ("blocked_domain", d.like(dom, "(?:^|[.])(?:" + _any(rules.blocked_domains) + ")$")),
        *([] if rules.allow_subdomains else [("subdomain", f"{dom} <> {reg}")]),
        ("short_root", f"length(regexp_extract({reg}, '^[^.]*', 0)) < {rules.min_root_letters}"),
        ("local_len_edge", f"length({local}) > 64 OR {d.like(local, '^[.-]|[.-]$')}"),
        ("local_short", f"length({local}) < 2"),
        ("local_chars", f"{d.like(local, '[.][.]')} OR NOT {d.like(local, '^[a-z0-9._%+-]+$')}"),
        ("asset_prefix", d.like(local, "^(?:www|cdn|img|js|css|static)[.]")),
        ("asset_local", d.like(local, "^(?:www|cdn|img|js|css|static)$")),
        ("domain_shape", f"length({dom}) > 253 OR {d.like(dom, '^-|-$|[.][.]')}"),
        ("phone_like", d.like(dom, "[0-9]+-[0-9]+")),
        ("label_shape", f"NOT {d.like(dom, '^[a-z0-9-]{1,63}(?:[.][a-z0-9-]{1,63})+$')} OR {d.like(dom, '[.]-|-[.]')}"),
        ("many_digits", f"length({d.rep(dom, '[^0-9]', '')}) > 4"),
        ("tld_shape", f"NOT {d.like(dom, '[.][a-z]{2,24}$')}"),
        ("tld_not_allowed", f"NOT ({allowed})"),
    ]
    return "CASE " + " ".join(f"WHEN {t} THEN '{name}'" for name, t in tests) + " ELSE 'ok' END"


def token(d, registrable_domain: str) -> str:
    """First label of a registrable domain, letters and digits only."""
    return d.rep(f"lower(regexp_extract({registrable_domain}, '^[^.]*', 0))", "[^a-z0-9]+", "")


def same_business(d, host: str, rules: Rules, host_reg: str | None = None) -> str:
    """Whether an e-mail's domain is a business's: its host, below it, or of one registrable domain. It reads the columns of email_parts()."""
    return f"({host} <> '' AND (dom = {host} OR right(dom, length({host}) + 1) = concat('.', {host}) OR reg = {host_reg or registrable(d, host, rules)}))"


def best_order(d, e: str, host: str, rules: Rules, policy: tuple[bool, bool]) -> tuple[str, list[str]]:
    """The tier of an e-mail, 9 where the policy doesn't allow it, and the keys that order e-mails within a tier.

    They read local, raw and the columns same, bt, et and lt: the same
    business, and the tokens of the business, the e-mail's domain and its local part.
    """
    within = lambda a, b: f"(position({a} IN {b}) > 0 OR position({b} IN {a}) > 0)"
    public = f"raw IN ({', '.join(map(d.s, rules.public_providers))})"
    tier = f"CASE WHEN same THEN 1 WHEN NOT {public} THEN {2 if policy[1] else 9} ELSE {3 if policy[0] else 9} END"
    box = "CASE " + " ".join(f"WHEN {e} LIKE '{p}%' THEN {i}" for i, p in enumerate(rules.preferred_mailboxes)) + " ELSE 999 END"
    relevance = f"CASE WHEN bt = '' OR lt = '' THEN 2 WHEN {within('bt', 'lt')} THEN 0 ELSE 2 END"
    other = f"CASE WHEN bt = '' OR et = '' THEN 2 WHEN bt = et THEN 0 WHEN {within('bt', 'et')} THEN 1 ELSE 2 END"
    generic = f"CASE WHEN local IN ({', '.join(map(d.s, rules.generic_locals))}) THEN 1 ELSE 0 END"
    by = lambda *keys: "CASE tier " + " ".join(f"WHEN {i + 1} THEN {k}" for i, k in enumerate(keys)) + " ELSE 0 END"
    exact = f"CASE WHEN raw = {host} THEN 0 ELSE 1 END"
    length = f"-length({e})"
    return tier, [by(box, other, relevance), by(relevance, relevance, generic), by(generic, generic, box), by(exact, box, length), by("0", length, "0")]


def priority(d, x: str, rules: Rules) -> str:
    """Contact relevance of a link's path or text: the score of the first listed word it contains, else 99."""
    return "CASE " + " ".join(f"WHEN position('{w}' IN lower({x})) > 0 THEN {n}" for w, n in rules.contact_priority) + " ELSE 99 END"


def cleaned(d, x: str) -> str:
    """White space collapsed; the words for missing become empty."""
    y = f"trim({d.rep(f'coalesce({x}, {d.s(str())})', chr(92) + 's+', ' ')})"
    return f"CASE WHEN upper({y}) IN ('N/A', 'NA', 'NONE', 'NULL') THEN '' ELSE {y} END"


def picked(*xs: str) -> str:
    """The first that is neither null, empty nor N/A."""
    return "coalesce(" + ", ".join(f"nullif(nullif({x}, ''), 'N/A')" for x in xs) + ")"


def rating(d, x: str) -> str:
    """The first number as text of a float, or 0."""
    n = f"regexp_extract(coalesce({x}, ''), {d.s('[0-9]+(?:[.][0-9]+)?')}, 0)"
    return f"CASE WHEN {n} = '' THEN '0' ELSE CAST(CAST({n} AS DOUBLE) AS {'STRING' if d.explode == 'explode' else 'VARCHAR'}) END"


def count_of(d, x: str) -> str:
    """The digits of the first run of digits and commas, as a number; 0 without."""
    n = d.rep(f"regexp_extract(coalesce({x}, ''), {d.s('[0-9,]+')}, 0)", "[^0-9]", "")
    return f"coalesce(TRY_CAST({n} AS BIGINT), 0)"


def stripped(d, x: str) -> str:
    """Text without an escaped quote at either end and white space around it; null becomes empty."""
    return d.rep(d.rep(f"coalesce({x}, '')", '^\\\\"|\\\\"$', ""), "^\\s+|\\s+$", "")


def site_or_none(d, x: str) -> str:
    """A website as it stands, or none where it is missing or a page of the maps."""
    y = stripped(d, x)
    maps = " OR ".join(f"position('{m}' IN lower({y})) > 0" for m in ("google.com/maps/place", "google.com/maps/search", "maps.google.com"))
    return f"CASE WHEN lower({y}) IN ('', 'n/a', 'na', 'none', 'null') OR {maps} THEN 'none' ELSE {y} END"


def place_id(d, url: str) -> str:
    """What follows place_id: in a URL, up to a backslash, quote or slash."""
    return f"regexp_extract({stripped(d, url)}, {d.s('place_id:([^' + chr(92) * 2 + chr(34) + '/]+)')}, 1)"


#: Redirects inside redirects that SQL unwraps; templates unwrap them all.
REDIRECTS = 3


def websites(d, source: str, base: str, x: str, into: str) -> str:
    """source with a contact's website as a URL without slashes at its end, relative ones against the page; what is behind Facebook redirects.

    Each step is a subquery that names what the next one reads, so no expression holds another's text.
    """
    from tallyfold.functions import links as L

    redirect = d.s("^https?://[^/?#]*l[.]facebook[.]com/l[.]php[^?#]*[?](?:[^#]*&)?u=([^&#]+)")
    q = f"SELECT *, {cleaned(d, x)} AS site_0 FROM {source}"
    for i in range(REDIRECTS):
        q = f"SELECT *, regexp_extract(site_{i}, {redirect}, 1) AS to_{i} FROM ({q}) a{i}"
        q = f"SELECT *, {d.unquote(f'replace(to_{i}, chr(43), chr(32))')} AS read_{i} FROM ({q}) b{i}"
        q = f"SELECT *, CASE WHEN to_{i} <> '' THEN {cleaned(d, f'read_{i}')} ELSE site_{i} END AS site_{i + 1} FROM ({q}) c{i}"
    raw = f"site_{REDIRECTS}"
    tests = [(f"{raw} = ''", "''"), (f"{raw} LIKE '//%'", f"concat('https:', {raw})"), (d.like(raw, "^https?://"), raw), (d.like(raw, "^(?i:[a-z0-9][a-z0-9.-]*[.][a-z]{2,}(?:/.*)?)$"), f"concat('https://', {raw})")]
    whole = "CASE " + " ".join(f"WHEN {t} THEN {to}" for t, to in tests) + f" ELSE {L.joined(d, base, raw)} END"
    return f"SELECT *, {L.slashless(d, 'site_url')} AS {into} FROM (SELECT *, {whole} AS site_url FROM ({q}) w) z"
