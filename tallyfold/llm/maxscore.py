"""Ranked lexical search by MaxScore over shards of an inverted index.

Terms are runs of letters and digits of ASCII and of all characters beyond it,
A-Z lowered. One pass over the documents builds shards in the shared folder:
posting lists of the terms that some item asks for (a document that has none of
them can't score and is only counted), the documents' sizes, and the shard's
share of the corpus counts. Spark adds up the counts; a second pass searches the
shards where they lie. In a shard each list has an upper bound, the best score
that any of its postings gives. Lists are taken in descending order of it: as
long as the bounds of the rest together reach the kth score, a document met
only there could qualify, so the list is essential and merges whole; after that
only documents met so far that can still reach the kth score are probed in the
remaining, non-essential lists, each time fewer. A task carries every item's
kth score from shard to shard and returns k documents an item at most; the best
k of all tasks remain. Bounds only skip what can't be among the best, so ranks
are exact.

A term is held as a 64-bit hash (`hashing`); a document's term is taken for a
different asked one about once in 2^64 / asked terms lookups.

Edge cases: a null or empty text and one without terms count nowhere and never
rank; a null or empty item asks nothing and returns nothing; equal scores by
ascending id, a null id last; repeated rows rank each; an item id that repeats
is asked once, with the smallest of its texts; empty tables give no rows;
further columns are not read. Texts are read whole. Items are asked in blocks of
about BLOCK_TERMS terms, so what a task is sent doesn't grow with their number.
"""

from __future__ import annotations

from math import floor, log

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import release_memory, small_batches, stored, table
from tallyfold.llm.hashing import word_hashes

#: Documents and postings of a shard (a document's place takes 16 bits), and items' terms asked together.
SHARD_DOCS, SHARD_POSTINGS, BLOCK_TERMS = 32_768, 4_000_000, 2_000_000
_ALNUM = bytes(i if i >= 128 or chr(i).isdigit() or chr(i).islower() else i + 32 if 65 <= i <= 90 else 32 for i in range(256))
_NO_ID = 2**63 - 1


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the texts one after another, and how many each text has."""
    return word_hashes(texts, _ALNUM)


def _bytes_of(batch, name: str) -> list[bytes]:
    import pyarrow as pa

    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def _asked(batches):
    """Of items (item_id, text): their distinct terms."""
    import pyarrow as pa

    for b in batches:
        h, n = terms(_bytes_of(b, "text"))
        parts = np.split(h, np.cumsum(n)[:-1]) if len(n) else []
        yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([np.unique(p).view(np.int64) for p in parts], pa.list_(pa.int64()))], names=["item_id", "terms"])


_SHARD = "docs array<long>, sizes binary, terms array<int>, dfs array<long>, places binary, tfs binary, counted long, tokens long"


def _shards(asked):
    """Of documents (doc_id, text): shards of posting lists of the asked terms, sorted hashes in a broadcast."""

    def packed(held: list, counted: int, tokens: int):
        import pyarrow as pa

        ids, sizes, place, term, tf = (np.concatenate([h[i] for h in held]) if held else np.zeros(0, np.int64) for i in range(5))
        by = np.lexsort((place, term))
        found, dfs = np.unique(term, return_counts=True)
        kinds = [pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        values = [
            [None if n else i for i, n in zip(ids.tolist(), np.concatenate([h[5] for h in held]).tolist())] if held else [],
            sizes.tobytes(), found.tolist(), dfs.tolist(), place[by].astype(np.uint16).tobytes(), tf[by].astype(np.uint32).tobytes(), counted, tokens,
        ]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["docs", "sizes", "terms", "dfs", "places", "tfs", "counted", "tokens"])

    def run(batches):
        keys = np.frombuffer(asked.value, np.uint64)
        held, docs, postings, counted, tokens = [], 0, 0, 0, 0
        for b in batches:
            texts, all_ids, at = _bytes_of(b, "text"), b.column("doc_id"), 0
            while at < len(texts):
                part = texts[at : at + SHARD_DOCS - docs]
                h, n = terms(part)
                counted += int((n > 0).sum())
                tokens += len(h)
                if len(keys):
                    where = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    hit = keys[where] == h
                    pair, tf = np.unique((np.repeat(np.arange(len(part)), n)[hit] << 32) | where[hit], return_counts=True)
                    doc, term = pair >> 32, pair & 0xFFFFFFFF
                    own, place = np.unique(doc, return_inverse=True)
                    if len(own):
                        ids = all_ids.slice(at, len(part)).take(_array(own))
                        held.append((ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False), n[own].astype(np.int64), docs + place, term, tf, ids.is_null().to_numpy(zero_copy_only=False)))
                        docs += len(own)
                        postings += len(pair)
                at += len(part)
                if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield packed(held, counted, tokens)
                    held, docs, postings, counted, tokens = [], 0, 0, 0, 0
        if counted:
            yield packed(held, counted, tokens)
        release_memory()

    return run


def _array(x):
    import pyarrow as pa

    return pa.array(x)


class Shard:
    """A shard's lists with the score that each posting gives, and each list's upper bound."""

    def __init__(self, row: dict, weights: np.ndarray, total: int, tokens: int):
        sizes = np.frombuffer(row["sizes"], np.int64)
        if total * 50 * int(sizes.max(initial=0)) >= 2**63:
            sizes = sizes.astype(object)
        m = (100 - 50 + (50 * sizes * total) // tokens).astype(np.int64)
        self.ids = np.array([_NO_ID if d is None else d for d in row["docs"]], np.int64)
        self.null = np.array([d is None for d in row["docs"]], bool)
        self.place = np.frombuffer(row["places"], np.uint16)
        tf = np.frombuffer(row["tfs"], np.uint32).astype(np.int64)
        self.terms, dfs = np.array(row["terms"], np.int64), np.array(row["dfs"], np.int64)
        self.value = np.repeat(weights[self.terms], dfs) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[self.place]))
        self.end = np.cumsum(dfs)
        self.start = self.end - dfs
        self.bound = np.maximum.reduceat(self.value, self.start) if len(dfs) else np.zeros(0, np.int64)
        self.sums = np.zeros(len(self.ids), np.int64)

    def list(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.place[self.start[i] : self.end[i]], self.value[self.start[i] : self.end[i]]

    def search(self, asked: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of documents that score `least` or more, the k best and their ties among them."""
        at = np.minimum(np.searchsorted(self.terms, asked), len(self.terms) - 1)
        lists = at[self.terms[at] == asked]
        lists = lists[np.argsort(-self.bound[lists], kind="stable")]
        rest = np.append(np.cumsum(self.bound[lists][::-1])[::-1], 0)  # what the lists from here on can add
        sums = self.sums
        sums[:] = 0
        done = 0
        while done < len(lists) and rest[done] >= least:
            place, value = self.list(lists[done])
            sums[place] += value
            done += 1
            if k <= len(sums) and done < len(lists) and (done & (done - 1) == 0 or done % 8 == 0):
                least = max(least, int(np.partition(sums, -k)[-k]))
        place = np.flatnonzero(sums + rest[done] >= least)
        score = sums[place]
        for i in range(done, len(lists)):
            other, value = self.list(lists[i])
            to = np.minimum(np.searchsorted(other, place.astype(np.uint16)), len(other) - 1)
            score = score + np.where(other[to] == place, value[to], 0)
            if k <= len(score):
                least = max(least, int(np.partition(score, -k)[-k]))
            could = score + rest[i + 1] >= least
            place, score = place[could], score[could]
        good = score >= least
        return place[good], score[good]


_FOUND = "item_id long, doc_id long, score long"


def _searched(items, weights, total: int, tokens: int, k: int):
    """Of shards: the k best documents of each item in this task."""

    def run(batches):
        import pyarrow as pa

        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(items.value)
        for b in batches:
            for row in b.to_pylist():
                if not row["terms"]:
                    continue
                shard = Shard(row, weights.value, total, tokens)
                for i, (_, asked) in enumerate(items.value):
                    score, null, ids = best[i]
                    place, more = shard.search(asked, k, int(score[-1]) if len(score) == k else 1)
                    if len(place):
                        score, null, ids = np.concatenate([score, more]), np.concatenate([null, shard.null[place]]), np.concatenate([ids, shard.ids[place]])
                        by = np.lexsort((ids, null, -score))[:k]
                        best[i] = score[by], null[by], ids[by]
        for (item, _), (score, null, ids) in zip(items.value, best):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(score), pa.int64()), pa.array(ids, mask=null), pa.array(score)], names=["item_id", "doc_id", "score"])
        release_memory()

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best of docs (doc_id, text) for each of items (item_id, text)."""
    spark = docs.sparkSession
    context = spark.sparkContext
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))
    asked = stored(items.mapInArrow(_asked, "item_id long, terms array<long>").where(F.size("terms") > 0), "search-items")
    blocks = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS))
    best = None
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect()  # about BLOCK_TERMS terms
        each = [np.array(r.terms, np.int64).view(np.uint64) for r in mine]
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *each]))
        shards = stored(docs.mapInArrow(_shards(context.broadcast(keys.tobytes())), _SHARD), "search-shards")
        whole = shards.agg(F.sum("counted"), F.sum("tokens")).first()
        df = np.zeros(len(keys), np.int64)
        for r in shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy("t.terms").agg(F.sum("t.dfs").alias("df")).collect():  # a row for each asked term
            df[r.terms] = r.df
        total, tokens = whole[0] or 0, whole[1] or 0
        weights = np.array([floor(1000 * log((2 * total + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        known = context.broadcast([(r.item_id, np.searchsorted(keys, h)) for r, h in zip(mine, each)])
        found = shards.mapInArrow(_searched(known, context.broadcast(weights), total, tokens, k), _FOUND)
        best = found if best is None else best.unionByName(found)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_maxscore(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_maxscore": op13_maxscore}
ORACLES = {
    "op13_maxscore": r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), q AS MATERIALIZED (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), c AS (
  SELECT CAST(count(*) AS BIGINT) AS N, CAST(sum(len(t)) AS BIGINT) AS L FROM d WHERE len(t) > 0
), p AS MATERIALIZED (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term
), w AS MATERIALIZED (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * N + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, N
), m AS MATERIALIZED (
  SELECT r, doc_id, 50 + ((50 * len(t) * N) // L) AS m FROM d, c WHERE len(t) > 0
), s AS (
  SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, r
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s JOIN m USING (r) WHERE score > 0 QUALIFY rank <= 50
"""
}
