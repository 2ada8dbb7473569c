"""Exact top-k by inner product: a KD-tree per shard, best-first, with the kth score passed on.

Median splits learnt on a bounded sample, the top of one KD-tree, deal all
candidates to regions; a region of more than SHARD rows, as of equal vectors,
is several shards. A shard is packed once as a row of the shared folder: ids,
components in as few bytes as they need, and its tight box; regions have the box
of their shards. A query goes first to one shard of the region whose box allows
the best score, which gives it a kth score to start from, and then only to
shards whose box can reach that score. In each of these two passes a shard is
moved once, to its queries, which follow it in order a batch at a time: its
KD-tree is built once, however many ask it, and a task holds one shard and one
batch. A shard that more than QUERY_BLOCK queries ask is moved once for so many.
The tree is searched from the query's score down: nodes in the order of the best
score their box allows, until no box can reach the kth score. Each shard returns
at most k rows a query, and the k best of all shards remain. Scores are
integers, computed in float64 where that is exact and as Python integers
elsewhere.

Edge cases: vectors that are null or hold null or non-finite components take
no part; a shorter vector counts as padded with zeros; ties go to the smaller
id; rows with the query's own id are not its candidates; a query id that
repeats is asked once, with the smallest of its vectors; a candidate row that
repeats counts each time; a score beyond 64 bits counts as the nearest number
of 64 bits; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import release_memory, small_batches, stored, table

#: Rows of a shard, queries for which a shard is moved once, rows of a tree's leaf; the sample that regions are learnt from, the most regions, and bytes of all their boxes.
SHARD, QUERY_BLOCK, LEAF = 8192, 65_536, 64
SAMPLE, REGIONS, BOX_BYTES = 20_000, 4096, 64 << 20
#: Shards up to which the list of those that are asked is broadcast, as narrow rows.
LISTED = 100_000
#: Queries whose bounds are in memory at once.
_ASKED = 1024
_LEAST, _MOST = -(2**63), 2**63 - 1


class KDTree:
    """Median splits on the widest side, with the tight box of each node."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        low, high, self.child, self.span = [], [], [], []
        todo = [(0, len(points), None)]
        while todo:
            a, b, parent = todo.pop()
            node = len(low)
            own = points[self.order[a:b]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            self.child.append([])
            self.span.append((a, b))
            if parent is not None:
                self.child[parent].append(node)
            if b - a > LEAF:
                side = int(np.argmax(high[-1] - low[-1]))
                m = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, side], m)]
                todo += [(a, a + m, node), (a + m, b, node)]
        self.low, self.high = np.stack(low), np.stack(high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product a node's box allows, by query and node."""
        return bounds(queries, self.low, self.high)


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def search(tree: KDTree, ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floor: list, k: int) -> list[tuple]:
    """(query, id, score) of the k best of each query among ids and points in the tree's order; scores below its floor may be left out."""
    out = []
    for q, (own, query) in enumerate(zip(query_ids.tolist(), queries)):
        if q % _ASKED == 0:
            bound = np.minimum(np.maximum(tree.bounds(queries[q : q + _ASKED]), _LEAST), _MOST)
        kth, best, row = floor[q], [], bound[q % _ASKED]
        heap = [(-row[0], 0)]
        while heap:
            top, node = heapq.heappop(heap)
            if -top < kth:
                break
            if tree.child[node]:
                for c in tree.child[node]:
                    if row[c] >= kth:
                        heapq.heappush(heap, (-row[c], c))
                continue
            a, b = tree.span[node]
            score = points[a:b] @ query
            if score.dtype == object:
                score = np.minimum(np.maximum(score, _LEAST), _MOST)
            for i in np.flatnonzero(score >= kth).tolist():
                if ids[a + i] == own:
                    continue
                entry = (score[i], -ids[a + i])
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
                if len(best) == k:
                    kth = max(kth, best[0][0])
        out += [(own, -int(i), int(s)) for s, i in best]
    return out


def _matrix(column, dim: int, exact: bool = False) -> np.ndarray:
    """Lists as rows of a matrix, shorter ones padded with zeros."""
    import pyarrow.compute as pc

    if len(column) and pc.all(pc.equal(pc.list_value_length(column), dim)).as_py():
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(object if exact else float)
    out = np.zeros((len(column), dim), dtype=object if exact else float)
    for i, r in enumerate(column.to_pylist()):
        out[i, : len(r)] = r
    return out


_SHARD = "region long, shard long, ids binary, points binary, width int, low binary, high binary"


def _pack(dim: int):
    """Of a shard's rows (vec_id, v): one row with all of them."""

    def run(key, got):
        import pyarrow as pa

        got = got.combine_chunks()
        points = _matrix(got.column("v").combine_chunks(), dim, True)
        large = int(max(points.max(initial=0), -points.min(initial=0)))
        width = next(w for w in (2, 4, 8) if large < 1 << (8 * w - 1) or w == 8)
        points = points.astype(f"<i{width}")
        box = [f(points, axis=0).astype(float).tobytes() for f in (np.min, np.max)]
        values = [key[0].as_py(), key[1].as_py(), got.column("vec_id").to_numpy().astype("<i8").tobytes(), points.tobytes(), width, *box]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array([x], t) for x, t in zip(values, kinds)], names=[x.split()[0] for x in _SHARD.split(", ")])

    return run


class Shard:
    """A packed shard, with its tree over float64 and, once a query asks for it, over Python integers."""

    def __init__(self, ids: bytes, points: bytes, width: int, dim: int):
        self.ids, self.points, self.trees = np.frombuffer(ids, "<i8"), np.frombuffer(points, f"<i{width}").reshape(-1, dim), {}
        self.large = int(max(int(self.points.max(initial=0)), -int(self.points.min(initial=0))))

    def search(self, query_ids: np.ndarray, column, floor: list, k: int) -> list[tuple]:
        import pyarrow.compute as pc

        dim = self.points.shape[1]
        ends = pc.min_max(column.flatten())
        asked = max((abs(x.as_py()) for x in ends.values() if x.is_valid), default=0)
        exact = self.large * asked * max(dim, 1) >= 2**53 or self.large >= 2**53 or asked >= 2**53
        if exact not in self.trees:
            points = self.points.astype(object if exact else float)
            tree = KDTree(points)
            self.trees[exact] = tree, self.ids[tree.order], points[tree.order]
        return search(*self.trees[exact], query_ids, _matrix(column, dim, exact), floor, k)


_FOUND = "query_id long, vec_id long, score long"


def _searched(dim: int, k: int):
    """Of shards, each followed by its queries in order: what the queries find."""

    def run(batches):
        import pyarrow as pa

        shard = held = None
        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in ("region", "shard", "part")], axis=1)
            role = b.column("role").to_numpy()
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1) | (role[1:] != role[:-1])) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            found: list = []
            for i, j in zip(cut, cut[1:]):
                name, part = tuple(key[i].tolist()), b.slice(i, j - i)
                if role[i] == 0:
                    row = part.slice(0, 1).to_pylist()[0]
                    held, shard = name, Shard(row["ids"], row["points"], row["width"], dim)
                elif held == name:
                    floor = [_LEAST if x is None else x for x in part.column("floor").to_pylist()]
                    found += shard.search(part.column("vec_id").to_numpy(), part.column("v"), floor, k)
            q, x, score = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(x, pa.int64()), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])
        release_memory()

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Regions:
    """The top of a KD-tree: `depth` levels of median splits."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, nodes = depth, (1 << depth) - 1
        self.side, self.value = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        rows = {0: sample}
        for node in range(nodes):
            own = rows.pop(node)
            if len(own) and own.shape[1]:
                self.side[node] = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                self.value[node] = np.median(own[:, self.side[node]])
            right = own[:, self.side[node]] >= self.value[node] if own.shape[1] else np.zeros(len(own), bool)
            rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.side[node]] >= self.value[node])
        return node - len(self.side)


def _dealt(regions: Regions, dim: int):
    """Of rows (vec_id, v): their region."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(regions.of(_matrix(b.column("v"), dim)))], names=["vec_id", "v", "region"])

    return run


def _region_box(key, got):
    """Of a region's shards: its box."""
    import pyarrow as pa

    low, high = (np.stack([np.frombuffer(x, float) for x in got.column(c).to_pylist()]) for c in ("low", "high"))
    return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([low.min(axis=0).tobytes()], pa.binary()), pa.array([high.max(axis=0).tobytes()], pa.binary()), pa.array([got.num_rows], pa.int64())], names=["region", "low", "high", "shards"])


def _asks(names: list[int], low: np.ndarray, high: np.ndarray, best: bool):
    """Of queries (vec_id, v, floor): the regions to ask, either the one with the best bound or all that can reach the floor."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            bound = bounds(_matrix(b.column("v"), low.shape[1]), low, high)
            bound = bound + np.abs(bound) * 1e-9 + 1  # beyond 2^53 float64 rounds
            floor = np.array([-np.inf if f is None else f for f in b.column("floor").to_pylist()], float)
            top = bound.argmax(axis=1)
            q, r = (np.arange(len(bound)), top) if best else np.nonzero(bound >= floor[:, None])
            out = b.take(pa.array(q)).select(["vec_id", "v", "floor"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.array(names, np.int64)[r]), pa.array(r == top[q])], names=["vec_id", "v", "floor", "region", "first"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of vectors (vec_id, v array<long>) for each id of queries (vec_id, v)."""
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    queries = stored(queries.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("floor", F.lit(None).cast("long")), "kd-queries")
    asked = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    dim = max(size.dim or 1, asked.dim or 1, 1)
    small_batches(vectors.sparkSession)
    most = max(1, min(REGIONS, BOX_BYTES // (16 * dim)))
    depth = min(max(0, -(-size.n // SHARD) - 1).bit_length(), most.bit_length() - 1)
    sample = vectors.select("v").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE if depth else 1).toArrow().column("v").combine_chunks()
    told = vectors.select("vec_id", "v").mapInArrow(_dealt(Regions(_matrix(sample, dim), depth), dim), "vec_id long, v array<long>, region long")
    told = stored(told.withColumn("row", F.monotonically_increasing_id()), "kd-regions")
    counts = F.broadcast(told.groupBy("region").agg(F.ceil(F.count("*") / SHARD).alias("shards")))  # a narrow row a region
    rows = told.join(counts, "region").withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")))
    packed = stored(rows.select("region", "shard", "vec_id", "v").groupBy("region", "shard").applyInArrow(_pack(dim), _SHARD), "kd-shards")
    boxes = packed.select("region", "low", "high").groupBy("region").applyInArrow(_region_box, "region long, low binary, high binary, shards long").toArrow().to_pylist()  # BOX_BYTES or less
    if not boxes:
        return _best(vectors.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0).cast("long").alias("score")).where("false"), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    boxes.sort(key=lambda r: r["region"])
    names = [r["region"] for r in boxes]
    low, high = (np.stack([np.frombuffer(r[c], float) for r in boxes]) for c in ("low", "high"))
    listed = F.broadcast if sum(r["shards"] for r in boxes) <= LISTED else lambda rows: rows
    key = ["region", "shard", "part"]

    def pass_(queries: DataFrame, best: bool, which: str) -> DataFrame:
        ask = queries.select("vec_id", "v", "floor").mapInArrow(_asks(names, low, high, best), "vec_id long, v array<long>, floor long, region long, first boolean")
        ask = ask.join(counts, "region").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).drop("shards")
        ask = stored(ask.where(which).drop("first"), "kd-asked")
        parts = ask.groupBy("region", "shard").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("parts"))
        asked = ask.join(listed(parts), ["region", "shard"]).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("parts"))).withColumn("role", F.lit(1))
        there = packed.drop("low", "high").join(listed(parts), ["region", "shard"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("role", F.lit(0))
        both = there.drop("parts").unionByName(asked.drop("parts"), allowMissingColumns=True)
        return stored(both.repartition(*key).sortWithinPartitions(*key, "role", "vec_id").mapInArrow(_searched(dim, k), _FOUND), "kd-found")

    seed = pass_(queries, True, "shard = 0")  # each query's first shard
    floors = seed.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), F.col("s").alias("floor"))
    found = seed.unionByName(pass_(queries.drop("floor").join(floors, "vec_id", "left"), False, "NOT (first AND shard = 0)"))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(1024 * x) of each component, for vectors that are whole and finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024)).alias("v"))


def op3_kd_search(spark, sf_dir: str) -> DataFrame:
    rows = stored(integer_vectors(table(spark, sf_dir, "embeddings")), "kd-vectors")
    return top_k(rows, rows.where("vec_id % 100 = 0"))


QUERIES = {"op3_kd_search": op3_kd_search}
ORACLES = {
    "op3_kd_search": """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
}
