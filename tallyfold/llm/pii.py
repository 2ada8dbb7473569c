"""Personal data in texts: patterns propose, checksums confirm, nearby words adjust the score.

Only DataFrame functions are used. Positions come from split(): the lengths of
the pieces between matches and of the matches add up to each match's start.

Kinds in order: email, ip, card (Luhn), phone are the base, which context
never removes; iban (mod 97) and national_id (context needed) are added. Context is
what stands within CONTEXT_CHARS before or after a match. An iban ends at its
country's length; under other codes the longest valid run of groups counts.

Edge cases: a null or empty text has no spans; repeated rows are each scanned;
an empty table gives an empty result; further columns stay as they are, except
that find_spans replaces one named like its output column, and redact the text. Texts are scanned whole. The patterns use possessive runs,
which match the same text as the plain ones in linear time and constant stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import fresh, table

#: Length of a country's IBAN: its codes.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = "(?:" + "|".join(IBAN_LENGTHS.values()).replace(" ", "|") + ")"


def _iban() -> str:
    """Country by country as long as its IBANs are, and any length for codes that aren't listed."""
    rest = lambda n: rf"(?:\x20?[A-Z0-9]{{4}}){{{n // 4}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    known = [f"(?:{codes.replace(' ', '|')})[0-9]{{2}}{rest(n - 4)}" for n, codes in IBAN_LENGTHS.items()]
    other = rf"(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?"
    return f"(?<![A-Za-z0-9])(?:{'|'.join([*known, other])})(?![A-Za-z0-9])"


_OCTET = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
#: kind: (cheap test that a match needs, pattern, base score, context words)
KINDS = {
    "email": (r"@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact|write"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.7, "ip|host|server|address"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){15}", r"[0-9](?:[\x20-]?[0-9])++", 0.8, "card|credit|visa|payment|karte|tarjeta|carte"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|tel|call|mobile|fax"),
    "iban": (r"[A-Z]{2}[0-9]{2}", _iban(), 0.8, "iban|bank|account|konto|cuenta|compte"),
    "national_id": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, "ssn|social|security|identity|passport"),
}
BASE = ("email", "ip", "card", "phone")
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.3
THRESHOLD = 0.5


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    n = F.length(d)
    digit = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    term = lambda i: F.when((n - i) % 2 == 0, digit(i)).otherwise(F.when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + term(i)) % 10 == 0


def _mod97(m: Column) -> Column:
    c = F.regexp_replace(m, " ", "")
    moved = F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4))
    value = lambda x: F.when(x.rlike("[0-9]"), x.cast("int")).otherwise(F.ascii(x) - 55)
    step = lambda acc, x: F.when(value(x) > 9, acc * 100 + value(x)).otherwise(acc * 10 + value(x)) % 97
    return F.length(c).between(15, 34) & (F.aggregate(F.filter(F.split(moved, ""), lambda x: x != ""), F.lit(0), step) == 1)


def _iban_cut(m: Column) -> Column:
    """Under a code without a known length, the longest run of a match's groups that mod 97 confirms; else the match."""
    parts = F.split(m, " ")
    shorter = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, F.size(parts) - i), " "))
    return F.when(m.rlike(f"^{_KNOWN}"), m).otherwise(F.coalesce(F.get(F.filter(shorter, _mod97), F.lit(0)), m))


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(m)).between(16, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        return _mod97(m)
    return F.lit(True)


_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"
_FOUND = "array<struct<start:int,m:string>>"
#: Items that a scan gathers before it adds them to its result, and characters of a text's pieces.
GATHER, PIECE = 128, 512


def _with(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scan(items: Column, made: str, step) -> Column:
    """All that step adds along an array, of type `made`. step: (state, item) to (new state, item to add or null); states are integers from 0.

    An array is copied whenever it grows, so items are gathered by GATHER at a
    time: the work stays near the number of items.
    """
    held = lambda state, out: F.struct(state.alias("s"), out.alias("out"))
    none = lambda array: F.expr(f"cast(array() as {array})")

    def one(acc, x):
        state, more = step(acc["s"], x)
        return held(state, F.when(more.isNull(), acc["out"]).otherwise(F.array_append(acc["out"], more)))

    def many(whole):
        def part(acc, i):
            inner = F.aggregate(F.slice(whole, i * GATHER + 1, GATHER), held(acc["s"], none(made)), one)
            return _with(inner, lambda r: held(r["s"], F.array_append(acc["out"], r["out"])))

        parts = F.sequence(F.lit(0), F.floor(F.size(whole) / GATHER).cast("int"))
        return F.aggregate(parts, held(F.lit(0), none(f"array<{made}>")), part, lambda acc: F.flatten(acc["out"]))

    return _with(items, many)


def _pieces(text: Column) -> Column:
    """The text cut into pieces of PIECE characters: a place in a text is found without reading all before it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _cut(pieces: Column, start: Column, length: Column) -> Column:
    """`length` characters of the text from `start` on, as far as it goes."""
    first = F.floor(start / PIECE).cast("int")
    held = F.array_join(F.slice(pieces, first + 1, F.floor((start % PIECE + length) / PIECE).cast("int") + 1), "")
    return F.substring(held, start % PIECE + 1, length)


def _spans(kind: str, text: Column, pieces: Column) -> Column:
    """The confirmed spans of one kind, by start; offsets count code points, the end is exclusive."""
    guard, pattern, base, words = KINDS[kind]
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def step(pos, x):
        at = pos + F.length(x["piece"])
        return at + F.coalesce(F.length(x["m"]), F.lit(0)), F.when(x["m"].isNotNull(), F.struct(at.alias("start"), x["m"].alias("m")))

    def near(x):
        first = F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0))
        before = _cut(pieces, first, x["start"] - first)
        after = _cut(pieces, x["start"] + F.length(x["m"]), F.lit(CONTEXT_CHARS))
        return F.lower(before).rlike(f"(?:{words})") | F.lower(after).rlike(f"(?:{words})")

    found = _scan(pairs, _FOUND, step)
    if kind == "iban":
        found = F.transform(found, lambda x: F.struct(x["start"].alias("start"), _iban_cut(x["m"]).alias("m")))
    made = lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end"), F.least(F.lit(1.0), F.lit(base) + F.when(near(x), CONTEXT_BONUS).otherwise(0.0)).alias("score"))
    kept = F.transform(F.filter(found, lambda x: _valid(kind, x["m"])), made)
    if kind not in BASE:
        kept = F.filter(kept, lambda s: s["score"] >= THRESHOLD)
    guarded = text.contains(guard) if kind == "email" else text.rlike(guard)
    return F.when(guarded, kept).otherwise(F.expr(f"cast(array() as {_SPAN})")).cast(_SPAN)


def find_spans(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """docs with the column `into`: array<struct<kind, start, end, score>> by kind as listed, then start."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(into, _with(_pieces(whole), lambda pieces: F.concat(*[_spans(k, whole, pieces) for k in KINDS])))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span in `text` replaced by its kind in brackets; of overlapping spans the earlier, then longer names the mark. Other columns stay."""
    spans = fresh(docs, "spans")
    found = find_spans(docs, text, spans)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))
    whole = F.col(text)

    def step(pos, s):
        """The end of what is covered, and for a span that begins beyond it the clear text before it: from, to, kind."""
        clear = F.struct(pos.alias("start"), s["start"].alias("end"), s["kind"].alias("kind"))
        return F.greatest(pos, -s["less"]), F.when(s["start"] >= pos, clear)

    def marked(pieces):
        parts = lambda x: F.concat(_cut(pieces, x["start"], x["end"] - x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        kept = F.transform(_scan(ordered, "array<struct<start:int,end:int,kind:string>>", step), parts)
        return F.concat(F.array_join(kept, ""), F.substring(whole, end + 1, F.length(whole)))

    new = F.when(F.size(spans) > 0, _with(_pieces(whole), marked)).otherwise(whole)
    return found.withColumn(text, new).select(*docs.columns)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_pii(spark, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[n(k) for k in BASE], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


QUERIES = {"op6_pii": op6_pii}
ORACLES = {}
