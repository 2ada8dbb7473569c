"""Link functions as SQL expressions over a dialect: shapes, cleaning, blocked resources, social pages."""

from __future__ import annotations

# Fixed values.
BLOCKED_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".webp", ".gif", ".svg", ".ico", ".avif", ".apng",
    ".mp4", ".webm", ".mov", ".m4v", ".avi", ".m3u8", ".ts", ".mp3", ".wav", ".ogg",
    ".woff", ".woff2", ".ttf", ".otf", ".eot",
)
SOCIAL_HOSTS = ("facebook.com", "m.facebook.com", "mbasic.facebook.com")
SOCIAL_BLOCKED = ("/sharer", "/share", "/dialog", "/plugins", "/tr", "/login", "/events", "/photo", "/watch", "/reel")
SOCIAL_LOOSE_BLOCKED = ("facebook.com/sharer", "facebook.com/tr", "facebook.com/login")

_ORIGIN = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"


def _any(words) -> str:
    return "|".join(w.replace(".", "[.]") for w in words)


def path(d, x: str) -> str:
    """The path of an absolute or relative URL."""
    return f"regexp_extract({x}, {d.s('^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)')}, 1)"


def origin(d, x: str) -> str:
    """Scheme and host of an absolute URL, as written; empty for others."""
    return f"regexp_extract({x}, {d.s(_ORIGIN)}, 0)"


def site(d, x: str) -> str:
    """The host (with port) of an absolute URL in lower case, without a leading www."""
    return d.rep(f"lower(regexp_extract({x}, {d.s('^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)')}, 1))", "^www[.]", "")


def joined(d, base: str, x: str) -> str:
    """A link as an absolute URL against the page's; dot segments stay as written."""
    folder = f"CASE WHEN {path(d, base)} LIKE '%/%' THEN {d.rep(path(d, base), '[^/]*$', '')} ELSE '/' END"
    tests = [
        (f"{x} = ''", base),
        (d.like(x, "^[A-Za-z][A-Za-z0-9+.-]*:"), x),
        (f"{x} LIKE '//%'", f"concat(regexp_extract({base}, '^[^:/?#]*:', 0), {x})"),
        (f"{x} LIKE '/%'", f"concat({origin(d, base)}, {x})"),
        (f"{x} LIKE '?%'", f"concat({d.rep(base, '[?#].*$', '')}, {x})"),
        (f"{x} LIKE '#%'", f"concat({d.rep(base, '#.*$', '')}, {x})"),
    ]
    return "CASE " + " ".join(f"WHEN {t} THEN {to}" for t, to in tests) + f" ELSE concat({origin(d, base)}, {folder}, {x}) END"


def contact_like(d, x: str, words) -> str:
    """Whether a path or an anchor text holds one of the target paths."""
    return d.like(f"lower({x})", _any(words))


def blocked_resource(d, x: str, extensions=BLOCKED_EXTENSIONS) -> str:
    """Whether the decoded path ends with a media or font extension."""
    return d.like(f"lower({d.unquote(path(d, x))})", f"(?:{_any(extensions)})$") if extensions else "false"


def looks_like_url(d, x: str) -> str:
    """Whether a trimmed text starts like a URL or is a bare domain."""
    return d.like(f"trim({x})", "^(?:https?://|/|(?i:[a-z0-9.-]+[.][a-z]{2,}(?:/|$)))")


def slashless(d, x: str) -> str:
    """A URL without slashes at the end of its path; query and fragment stay."""
    p = f"regexp_extract({x}, {d.s(_ORIGIN + '([^?#]*)')}, 1)"
    tail = f"regexp_extract({x}, {d.s('[?#].*$')}, 0)"
    whole = f"concat(regexp_extract({x}, {d.s(_ORIGIN)}, 0), {d.rep(p, '/+$', '')}, {tail})"
    return f"CASE WHEN {d.like(x, _ORIGIN)} THEN {whole} ELSE {d.rep(x, '/+$', '')} END"


def clean_url(d, x: str) -> str:
    """A URL without quotes around it, https where no scheme is given; empty without a host."""
    bare = d.rep(f"trim({x})", '^"+|"+$', "")
    full = f"CASE WHEN {d.like(bare, '^(?i:https?)://')} THEN {bare} ELSE concat('https://', {bare}) END"
    return f"CASE WHEN {d.like(full, '^(?i:https?)://[^/?#]')} THEN concat(lower(regexp_extract({full}, '^[^:]*', 0)), regexp_extract({full}, ':.*$', 0)) ELSE '' END"


def social_loose(d, x: str) -> str:
    low = f"lower({x})"
    return f"({d.like(low, 'facebook[.]com/')} AND NOT {d.like(low, _any(SOCIAL_LOOSE_BLOCKED))})"


def social_strict(d, x: str) -> str:
    """A page of a known host with a path of its own that holds none of the blocked parts."""
    host = d.rep(f"lower(regexp_extract({x}, {d.s('^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)')}, 1))", "^www[.]", "")
    p = f"lower({path(d, x)})"
    hosts = ", ".join(f"'{h}'" for h in SOCIAL_HOSTS)
    return f"({host} IN ({hosts}) AND {p} NOT IN ('', '/', '/home.php') AND NOT {d.like(p, _any(SOCIAL_BLOCKED))})"
