"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, rerank with the vectors themselves.

Rotations learnt on a bounded sample turn each unit vector into balanced bits.
The bits are cut into chunks, one table each; vectors of one label that share
a chunk meet in a bucket, as whole codes without their components, and are
compared by Hamming distance. Only rows that have a near code in a bucket are
sent there with their vectors, and these are compared by cosine in double
precision. A pair that shares several chunks counts in the first table alone.
Equal vectors are one class, compared once. Buckets of more than BLOCK rows are
dealt out as pairs of blocks, so a task holds two blocks at most.

A task returns, for each vector, how many others it links with and one edge to
the smallest of its component within the block: rows in proportion to vectors,
whatever the number of pairs.

Edge cases: a vector that is null, empty, zero or holds null or non-finite
components, or has no label or id, links with nothing; vectors of different
length don't link; rows with equal vectors are linked with each other,
repeated ids included; an empty table gives no rows; further columns are not
read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import by_key, components, stored, table

#: Vectors that the rotations are learnt from, the first by a hash of their id.
SAMPLE = 20_000
#: The least bits of a chunk, the most, learning steps.
CHUNK, LONGEST, STEPS, SEED = 16, 24, 30, 5
#: Share of pairs at cosine 0.98 that agree in a chunk of 16 bits, as measured (longer chunks by its power), and of those that may meet in no table.
AGREE, MISSED = 0.36, 0.001
BLOCK, TILE = 8192, 512
#: How much more often than by angle alone a bit of a pair at the threshold may differ, and standard deviations on top, before its codes are far apart.
LOOSE, DEVIATIONS = 1.6, 6


def plan(n: int, dim: int) -> tuple[int, int]:
    """(rotations, bits of a chunk) for n vectors: chunks grow with the logarithm of n so that buckets don't, and tables follow from the chunk."""
    bits = min(64, dim)
    chunk = min(bits, LONGEST, max(CHUNK, n.bit_length() - 4))
    tables = math.ceil(math.log(MISSED) / math.log(1 - AGREE ** (chunk / 16)))
    return math.ceil(tables / (bits // chunk)), chunk


def far(bits: int, threshold: float) -> int:
    """The Hamming distance of codes of so many bits beyond which a pair isn't compared: well above what an angle at the threshold gives, well below half of the bits."""
    p = min(0.5, LOOSE * math.acos(min(1.0, max(-1.0, threshold))) / math.pi)
    return math.ceil(p * bits + DEVIATIONS * math.sqrt(p * (1 - p) * bits))


def learn(sample: np.ndarray, rotations: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(projection with rotation, thresholds) for each rotation: principal directions, turned so that signs lose least."""
    dim = sample.shape[1]
    mean = sample.mean(axis=0)
    x = sample - mean
    bits = min(64, dim)
    if len(sample) > dim:
        _, axes = np.linalg.eigh(x.T @ x)
        axes = axes[:, ::-1][:, :bits]
    else:
        axes = np.eye(dim)[:, :bits]
    rng = np.random.default_rng(SEED)
    out = []
    for _ in range(rotations):
        turn, _ = np.linalg.qr(rng.normal(size=(bits, bits)))
        v = x @ axes
        for _ in range(STEPS if len(sample) > dim else 0):
            u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (u @ w).T
        out.append((axes @ turn, np.array([_threshold(side) for side in (sample @ (axes @ turn)).T]) if len(sample) else np.zeros(bits)))
    return out


def _threshold(x: np.ndarray) -> float:
    """Where a bit's values are cut: near their median, but not through a crowd such as a large group of near copies, whose bits would be noise.

    Of windows of a twentieth of the values, the widest by its distance from the median's rank.
    """
    x = np.sort(x)
    w = max(1, len(x) // 20)
    if len(x) <= w:
        return float(np.median(x))
    at = np.arange(len(x) - w)
    best = int(np.argmax((x[w:] - x[:-w]) * (1 - 2 * np.abs((at + w / 2) / (len(x) - 1) - 0.5)).clip(0)))
    return float((x[best] + x[best + w]) / 2)


def codes(model: list, x: np.ndarray) -> np.ndarray:
    """Each unit vector's bits, 64 or fewer of each rotation in a word."""
    out = []
    for turn, middle in model:
        bit = (x @ turn > middle).astype(np.uint64)
        out.append(np.bitwise_or.reduce(bit << np.arange(bit.shape[1], dtype=np.uint64), axis=1))
    return np.stack(out, axis=1)


def chunks(words: np.ndarray, dim: int, chunk: int) -> np.ndarray:
    """The chunks of codes, one for each table; bits that fill no chunk are left out."""
    cut = np.arange(min(64, dim) // chunk, dtype=np.uint64) * np.uint64(chunk)
    return ((words[:, :, None] >> cut) & np.uint64((1 << chunk) - 1)).astype(np.int32).reshape(len(words), -1)


def _rows(column) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _encode(models: dict):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == d))
                words = codes(models[d][0], _unit(_rows(part.column("embedding"))))
                c = chunks(words, d, models[d][1])
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (words.view(np.int64), c)]
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in ("rep", "label", "dim")), *lists], names=["rep", "label", "dim", "words", "codes"])

    return run


def _join(low: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Tie rows i and j: low holds each row's smallest known companion, and each of these its own."""
    while True:
        a, b = low[i], low[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while (low[low] != low).any():
            low[:] = low[low]


_BUCKET = ("t", "label", "dim", "code", "lo", "hi")
_MET = "rep long, links long, root long"


def _pairs(x: dict, close, tile: int):
    """Pairs of rows of a block, or of one in each of two blocks, that are close and have this table as the first that they share, a tile at a time. close(rows, rows) tells which."""
    block, c = x["block"], x["codes"]
    apart = x["lo"][0] != x["hi"][0]
    for p in range(0, len(block), tile):
        for q in range(p, len(block), tile):
            i, j = np.nonzero(close(slice(p, p + tile), slice(q, q + tile)))
            i, j = i + p, j + q
            keep = i < j if p == q else np.ones(len(i), dtype=bool)
            if apart:
                keep &= block[i] != block[j]
            i, j = i[keep], j[keep]
            keep = (c[i] == c[j]).argmax(axis=1) == x["t"][0]
            yield i[keep], j[keep]


def _near(x: dict, limit: int, tile: int) -> np.ndarray:
    """Which rows of a bucket's blocks have another whose whole code is within `limit` bits of theirs."""
    words, seen = x["words"], np.zeros(len(x["block"]), dtype=bool)

    def close(a: slice, b: slice) -> np.ndarray:
        away = np.zeros((len(words[a]), len(words[b])), np.int32)
        for w in words.T:
            away += np.bitwise_count(w[a, None] ^ w[None, b])
        return away <= limit

    for i, j in _pairs(x, close, tile):
        seen[i] = seen[j] = True
    return seen


def _met(x: dict, threshold: float, tile: int):
    """One pair of blocks of a bucket: (rep, links, root) of the rows that link. Work is done in tiles of rows, so memory stays near the rows'."""
    rep, mult, v = x["rep"], x["mult"], x["embedding"]
    unit = _unit(v)
    links, low = np.zeros(len(rep), np.int64), np.arange(len(rep))
    for i, j in _pairs(x, lambda a, b: unit[a] @ unit[b].T >= threshold - 1e-9, tile):
        if not len(i):
            continue
        # pairs near the threshold are decided from the vectors as given
        near = np.flatnonzero(np.abs(np.einsum("ij,ij->i", unit[i], unit[j]) - threshold) < 1e-6)
        a, b = v[i[near]], v[j[near]]
        cos = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
        drop = near[~(cos >= threshold)]
        i, j = np.delete(i, drop), np.delete(j, drop)
        np.add.at(links, i, mult[j])
        np.add.at(links, j, mult[i])
        _join(low, i, j)
    some = np.flatnonzero(links)
    return rep[some], links[some], rep[low[some]]


def _in_buckets(columns: tuple, lists: tuple, chunk: dict, of, names: list[str]):
    """Of rows in order of their bucket and blocks: what of(rows as arrays) finds in each. chunk: bits of a chunk by length of vector."""

    def run(batches):
        import pyarrow as pa

        def arrays(batch):
            out = {}
            for name in lists:
                column = batch.column(name)
                flat, cut = np.asarray(column.flatten()), np.asarray(column.offsets)
                out[name] = np.empty(batch.num_rows, dtype=object)
                for k, (a, b) in enumerate(zip((cut - cut[0]).tolist(), (cut - cut[0])[1:].tolist())):
                    out[name][k] = flat[a:b]
            return out

        def told(out):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(len(names))], names=names)

        out = []
        for x in by_key(batches, _BUCKET, columns, arrays):
            by = np.argsort(x["rep"], kind="stable")
            x = {k: v[by] for k, v in x.items()}
            x["words"] = np.stack(x["words"]).view(np.uint64)
            x["codes"] = chunks(x["words"], int(x["dim"][0]), chunk[int(x["dim"][0])])
            if "embedding" in x:
                x["embedding"] = np.stack(x["embedding"]).astype(float)
            out.append(of(x))
            if len(out) == 1024:
                yield told(out)
                out = []
        if out:
            yield told(out)

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id) of every row of vectors (vec_id, embedding, label)."""
    double = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), double.alias("embedding"))
    h = [F.xxhash64("embedding", F.lit(k)).alias(f"h{k}") for k in (1, 2)]
    keyed = rows.withColumn("good", good).select("*", *h)
    valid = keyed.where("good")
    classes = valid.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("mult"), F.first("embedding").alias("embedding"))
    # rows may share an id, so classes have a number of their own
    classes = stored(classes.withColumn("dim", F.size("embedding")).withColumn("rep", F.monotonically_increasing_id()), "near-classes")
    sample = classes.select("dim", "embedding").orderBy(F.xxhash64("id"), "id", "h1", "h2", "label").limit(SAMPLE).toPandas()
    sizes = {r.dim: plan(r["count"], r.dim) for r in classes.groupBy("dim").count().collect()}  # a row for each length of vector
    seen = {int(d): _unit(np.stack(g["embedding"].to_list())) for d, g in sample.groupby("dim")}
    models = {d: (learn(seen.get(d, np.zeros((0, d))), rotations), bits) for d, (rotations, bits) in sizes.items()}
    chunk = {d: bits for d, (_, bits) in sizes.items()}
    coded = stored(classes.select("rep", "label", "dim", "embedding").mapInArrow(_encode(models), "rep long, label long, dim int, words array<long>, codes array<int>"), "near-codes")
    slots = coded.select("rep", "label", "dim", "words", F.posexplode("codes").alias("t", "code"))
    bucket = ["t", "label", "dim", "code"]
    full = slots.groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1").withColumn("k", F.ceil(F.col("size") / BLOCK).cast("int"))
    live = slots.join(full, bucket).withColumn("block", F.pmod(F.xxhash64("rep"), "k").cast("int"))
    live = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "size", "k")

    def survivors(x: dict) -> list[np.ndarray]:
        words = x["words"].shape[1] * min(64, int(x["dim"][0]))
        at = np.flatnonzero(_near(x, far(words, threshold), tile))
        return [x[c][at] for c in (*_BUCKET, "block", "rep")]

    tile = TILE
    ordered = lambda rows: rows.repartition(*_BUCKET).sortWithinPartitions(*_BUCKET)
    kept = ordered(live).mapInArrow(_in_buckets(("rep", "block"), ("words",), chunk, survivors, [*_BUCKET, "block", "rep"]), "t int, label long, dim int, code int, lo int, hi int, block int, rep long")
    kept = stored(kept, "near-survivors")
    held = classes.select("rep", "mult", "embedding").join(coded.select("rep", "words"), "rep")
    met = ordered(kept.join(held, "rep")).mapInArrow(_in_buckets(("rep", "mult", "block"), ("words", "embedding"), chunk, lambda x: _met(x, threshold, tile), ["rep", "links", "root"]), _MET)
    met = stored(met, "near-links")
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    label = components(met.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    label = classes.select("rep", "id").join(label, F.col("rep") == F.col("node")).select("rep", "id", "component")
    label = label.join(label.groupBy("component").agg(F.min("id").alias("least")), "component").select("rep", "least")
    told = classes.select("label", "h1", "h2", "rep", "id", "mult").join(links, "rep", "left").join(label, "rep", "left")
    told = told.select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    linked = valid.select("vec_id", "label", "h1", "h2").join(told, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = keyed.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone)


def op1_near_vectors(spark, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


QUERIES = {"op1_near_vectors": op1_near_vectors}
ORACLES = {
    "op1_near_vectors": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (SELECT a AS vec_id, a AS c FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.c = l.a),
m AS (SELECT vec_id, min(c) AS c FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(m.c, e.vec_id) AS component_id, e.vec_id = coalesce(m.c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN m ON m.vec_id = e.vec_id LEFT JOIN n ON n.vec_id = e.vec_id
"""
}
