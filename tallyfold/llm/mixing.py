"""Mixing sources to target weights by cube-method balanced sampling.

A source's documents all have the same inclusion count target / source_size;
its whole part is taken for certain, and the fraction is settled by the cube
method: groups of three fractional units move through the null space of the
constraints (token total, document total) until each is 0 or 1. The flight
runs in blocks of a source, then once more over what the blocks left (at most
fourteen units each: two that no group of three could move, and a reserve of
all sizes), and the last fourteen units of a source land by the rounding
nearest to the totals.

Edge cases: null text has size 0; a null source is a source of its own, last
in order; sources of size 0 have target 0 and nothing taken; repeated rows are
units of their own; an empty table gives an empty mix; further columns are not
read. Draws come from hashes of (seed, block, doc_id order): reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import fresh, stored, table

#: Rows of one flight block.
BLOCK_ROWS = 20_000
#: Units of a block, of all its sizes, that its flight leaves open for the landing.
RESERVE = 12
#: No document is taken more often.
MAX_REPEAT = 3
#: The table of sources is broadcast up to this many rows, joined by shuffle beyond.
BROADCAST_SOURCES = 10_000
_EPS = 1e-9


def _ranked(rows: DataFrame, *by) -> DataFrame:
    """rows with `rank` from 0 by those columns, stored: sorted over all tasks, numbered in each, and shifted by the rows of those before."""
    sorted_ = rows.orderBy(*by).withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
    sorted_ = stored(sorted_, "mix-sorted")
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    before = sorted_.groupBy("part").agg(F.count("*").alias("n_part")).withColumn("before", F.coalesce(F.sum("n_part").over(order), F.lit(0))).drop("n_part")
    own = F.row_number().over(Window.partitionBy("part").orderBy("place")) - 1
    return stored(sorted_.withColumn("own", own).join(F.broadcast(before), "part").withColumn("rank", F.col("own") + F.col("before")).drop("part", "place", "own", "before"), "mix-ranked")


def source_targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, n, target) from (source, size): weights 1, 2, 3 by code point order, filled up to max_repeat times a source's size.

    The excess of capped sources flows to the others by weight until none is
    above its cap: rounds raise the level L of sum(min(w * L, cap)) = total,
    each from sums over all sources. Sums are integers, so reruns agree.
    """
    s = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n"))
    s = _ranked(s, F.col("source").isNull(), F.col("source")).withColumn("w", F.col("rank") % 3 + 1).withColumn("cap", F.col("source_size") * max_repeat)
    over = lambda level: F.col("w") * level > F.col("cap")
    level, full = 0.0, -1
    while True:
        capped = F.col("cap") == 0 if full < 0 else over(level)
        now = s.agg(F.sum("source_size").alias("total"), F.count_if(capped).alias("full"), F.sum(F.when(capped, F.col("cap"))).alias("held"), F.sum(F.when(~capped, F.col("w"))).alias("w")).first()
        if now.full == full or not now.w:
            break
        full = now.full
        level = (now.total - (now.held or 0)) / now.w
    return s.select("source", "source_size", "n", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("cap").cast("double"), F.col("w") * level)).alias("target"))


def _unit(key: str) -> float:
    """A draw in (0, 1) from a key."""
    import xxhash

    return (xxhash.xxh64_intdigest(key) + 0.5) / 2.0**64


def flight(sizes: list[int], p: list[float], key: str) -> list[float]:
    """Move probabilities until at most two are fractional, keeping sum(p) and sum(size * p) but for rounding."""
    p = list(p)
    held: list[int] = []
    draw = 0
    for i in [*range(len(p)), None]:
        if i is not None:
            if not _EPS < p[i] < 1 - _EPS:
                p[i] = float(round(p[i]))
                continue
            held.append(i)
            if len(held) < 3:
                continue
        elif len(held) < 2:
            break
        if len(held) == 3:
            a, b, c = (sizes[k] for k in held)
            u = [float(c - b), float(a - c), float(b - a)]
            if u == [0.0, 0.0, 0.0]:
                u = [1.0, -1.0, 0.0]
        elif sizes[held[0]] == sizes[held[1]]:
            u = [1.0, -1.0]
        else:
            break
        up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(held, u) if x)
        down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(held, u) if x)
        draw += 1
        step = up if _unit(f"{key}:{draw}") * (up + down) < down else -down
        for k, x in zip(held, u):
            p[k] = min(1.0, max(0.0, p[k] + step * x))
            if p[k] < _EPS or p[k] > 1 - _EPS:
                p[k] = float(round(p[k]))
        held = [k for k in held if 0 < p[k] < 1]
    return p


def land(sizes: list[int], p: list[float]) -> list[float]:
    """Round the few units that are still open: of all choices the one nearest to both totals they stand for."""
    import numpy as np

    open_ = [i for i, x in enumerate(p) if 0 < x < 1]
    if not open_:
        return p
    size = np.array([sizes[i] for i in open_], dtype=float)
    share = np.array([p[i] for i in open_])
    picks = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    off = np.abs(picks @ size - size @ share) / max(1.0, size.mean()) + 0.02 * np.abs(picks.sum(axis=1) - share.sum())
    p = list(p)
    for i, x in zip(open_, picks[int(np.argmin(off))].tolist()):
        p[i] = float(x)
    return p


def reserve(sizes: list[int], p: list[float]) -> set[int]:
    """A few fractional units of all sizes that the flight leaves for the landing."""
    by = sorted((i for i, x in enumerate(p) if 0 < x < 1 and sizes[i]), key=lambda i: (sizes[i], i))
    return {by[k * (len(by) - 1) // (RESERVE - 1)] for k in range(RESERVE)} if by else set()


_FLOWN = "doc_id long, h long, unit long, source string, size long, source_size long, target double, whole long, p double"


def _fly(last: bool, seed: int):
    def run(key, pdf):
        pdf = pdf.sort_values(["size", "doc_id", "h", "unit"], ascending=[False, True, True, True], kind="stable", na_position="last")
        sizes = [int(x) for x in pdf["size"]]
        p = [float(x) for x in pdf["p"]]
        kept = reserve(sizes, p)
        rest = [i for i in range(len(p)) if i not in kept]
        for i, x in zip(rest, flight([sizes[i] for i in rest], [p[i] for i in rest], f"{seed}:{last}:{key[0]}:{key[-1]}")):
            p[i] = x
        return pdf.assign(p=land(sizes, p) if last else p)[[c.split()[0] for c in _FLOWN.split(", ")]]

    return run


def word_count(text):
    """How many runs of other than ASCII white space a text has; null has none."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(marks) - F.length(F.regexp_replace(marks, "x", "")), F.lit(0)).cast("long")


def mix(sizes: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, h, unit, source, size, source_size, target, copies) from (doc_id, h, unit, source, size); h and unit tell rows with the same doc_id apart."""
    spark = sizes.sparkSession
    targets = stored(source_targets(sizes), "mix-targets")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(MAX_REPEAT)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    rows = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rows = rows.withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + _EPS)).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    rows = rows.withColumn("p", F.when(F.col("p") < _EPS, 0.0).otherwise(F.col("p")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "h", "unit", F.lit(seed)), F.ceil(F.col("n") / BLOCK_ROWS)))
    cols = [c.split()[0] for c in _FLOWN.split(", ")]
    flown = stored(rows.select(*cols, "block").groupBy("source", "block").applyInPandas(_fly(False, seed), _FLOWN), "mix-flown")
    # at most RESERVE + 2 rows a block go on; groups of blocks merge again until one is left
    done, rest = flown.where("p = 0 or p = 1"), flown.where("p > 0 and p < 1")
    width = BLOCK_ROWS // 2
    blocks = rest.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    while blocks > BLOCK_ROWS:
        merged = rest.withColumn("block", F.pmod(F.xxhash64("doc_id", "h", "unit", F.lit(seed + blocks)), F.lit(math.ceil(blocks / width))))
        flown = stored(merged.groupBy("source", "block").applyInPandas(_fly(False, seed), _FLOWN), "mix-flown")
        done, rest = done.unionByName(flown.where("p = 0 or p = 1")), flown.where("p > 0 and p < 1")
        blocks = rest.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    landed = rest.withColumn("block", F.lit(0)).groupBy("source", "block").applyInPandas(_fly(True, seed), _FLOWN)
    return done.unionByName(landed).withColumn("copies", F.col("whole") + F.round("p").cast("long")).drop("whole", "p")


_KEY = ("doc_id", "source", "size", "h")


def _numbered(rows: DataFrame, part, count) -> DataFrame:
    """Rows by _KEY and a part of the input, with `before`: the key's rows in the parts before. A key has a row for each part at most."""
    held = rows.groupBy(*_KEY, part.alias("part")).agg(count.alias("n"))
    order = Window.partitionBy(*_KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return held.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))


def doc_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, h, source, size, unit), stored; h is a hash of the text, and unit numbers rows with the same id, text, size and source from 0."""
    s = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("h"))
    s = _numbered(s, F.spark_partition_id(), F.count("*"))
    return stored(s.select(*_KEY, F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)).alias("unit")), "mix-sizes")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(doc_sizes(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")


def remix(docs: DataFrame) -> DataFrame:
    """docs with each row repeated as often as the mix takes it, in its own columns.

    Of a key's equal rows any will do: the mix only says how many are taken at
    least once, twice and so on, and rows of keys that occur more than once are
    stored and numbered part by part.
    """
    found = mix(doc_sizes(docs))
    taken = found.groupBy(*_KEY).agg(F.count("*").alias("rows"), F.array(*[F.count_if(F.col("copies") >= k) for k in range(1, MAX_REPEAT + 1)]).alias("least"))
    taken = stored(taken, "mix-taken")
    row = fresh(docs, "row")
    named = docs.select(F.struct(*docs.columns).alias(row), F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("h"))
    same = lambda x, y: [x[c].eqNullSafe(y[c]) for c in _KEY]
    one = taken.where("rows = 1 and least[0] > 0")
    out = named.join(one, same(named, one)).select(row, "least", F.lit(0).cast("long").alias("at"))
    many = taken.where("rows > 1")
    if not many.isEmpty():
        held = named.join(many, same(named, many)).select(row, *[named[c] for c in _KEY], "least").withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
        held = stored(held, "mix-repeated")
        before = _numbered(held, F.col("part"), F.count("*")).drop("n")
        own = F.row_number().over(Window.partitionBy(*_KEY, "part").orderBy("place")) - 1
        held = held.withColumn("own", own)
        at = (held["own"] + before["before"]).cast("long").alias("at")
        out = out.unionByName(held.join(before, [*same(held, before), held["part"] == before["part"]]).select(row, "least", at))
    copies = F.size(F.filter("least", lambda t: t > F.col("at")))
    return out.withColumn("copies", copies).where("copies > 0").select(row, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(f"{row}.*")


QUERIES = {"op9_mixing": op9_mixing}
ORACLES = {}
