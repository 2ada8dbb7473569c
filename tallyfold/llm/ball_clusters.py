"""Centroid clustering (Lloyd's rounds) in exact integers, filtered by ball trees.

Each task builds metric trees over its own vectors, BLOCK at a time, and keeps
them in the shared folder: the vectors in tree order, and for every node its
span, children, radius, count and integer sum. A round walks all trees, level by
level, with the centroids that can still be nearest to some vector of a ball:
by the triangle inequality a centroid is out when its distance to the ball's
centre less the radius is above another's distance plus the radius. A ball with
one centroid left gives its count and sum whole; a leaf with more compares its
vectors exactly. Tasks return one row a centroid and component, Spark adds them
up, and the driver divides k x components numbers. Distances in bounds are
rounded outwards, so no rounding decides an assignment.

Edge cases: vectors that are null, of another size than asked, or hold null or
non-finite components take no part; ties go to the smaller centroid; equal
vectors make a ball of radius 0, which is given whole; a null id takes part and
can't be a first centroid before all others; repeated rows count each; fewer
vectors than centroids make as many centroids as there are vectors; an empty
table gives no rows; further columns are not read. Components and distances
beyond 64 bits count as the nearest number of 64 bits, and arithmetic that
float64 can't do exactly is done in Python integers.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import stored, table

#: Vectors of a tree, and of a leaf.
BLOCK, LEAF = 8192, 32
_MOST = 2**63 - 1
_TREE = "ids array<long>, points binary, span binary, child binary, radius binary, n binary, total array<string>, wide boolean"


def _square(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances by point and centre: both float64 below 2^53, or both Python integers."""
    return (points * points).sum(axis=1)[:, None] - 2 * (points @ centers.T) + (centers * centers).sum(axis=1)[None, :]


def _exact(points: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """Integer arrays as float64 where every squared distance between them is exact, else as Python integers."""
    arrays = (points, *others)
    large = max((max(abs(int(a.max())), abs(int(a.min()))) for a in arrays if a.size), default=0)
    dim = max(points.shape[1], 1)
    kind = float if dim * (2 * large) ** 2 < 2**53 else object
    return [a.astype(kind) for a in arrays]


def _root(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(float))


class BallTree:
    """Nodes in level order: span in `order`, children (0: none), radius about the floor of the mean, count, integer sum."""

    def __init__(self, points: np.ndarray):
        dim = points.shape[1]
        self.order = np.arange(len(points))
        self.span, self.child, self.radius, self.total = [], [], [], []
        todo, at = [(0, len(points))], 0
        self.span.append(todo[0])
        while at < len(todo):
            a, b = todo[at]
            own = points[self.order[a:b]]
            total = own.astype(object).sum(axis=0) if own.dtype == object or abs(own).max(initial=0) > 2**40 else own.sum(axis=0)
            center = total // (b - a)
            near, mid = _exact(own, center[None, :])
            far = _square(near, mid)[:, 0]
            self.total.append(total)
            self.radius.append(float(_root(far).max(initial=0)) * (1 + 1e-9))
            self.child.append(0)
            if b - a > LEAF and self.radius[-1] > 0 and dim:
                # towards the two vectors farthest apart, as two passes find them
                one = near[int(np.argmax(far))]
                other = near[int(np.argmax(_square(near, one[None, :])[:, 0]))]
                side = (near @ (other - one)).astype(float)
                m = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(side, m)]
                self.child[at] = len(todo)
                todo += [(a, a + m), (a + m, b)]
            at += 1
        self.span = todo
        self.n = [b - a for a, b in todo]


def _trees(dim: int):
    """Of rows (vec_id, v): a row for each block of them, with its tree."""

    def packed(ids: list, points: np.ndarray):
        import pyarrow as pa

        tree = BallTree(points)
        wide = bool(abs(points).max(initial=0) > 2**31 - 1)
        as_ = np.int64 if wide else np.int32
        total = [",".join(map(str, t.tolist())) for t in tree.total]
        blobs = [points[tree.order].astype(as_).tobytes(), np.array(tree.span, np.int32).tobytes(), np.array(tree.child, np.int32).tobytes(), np.array(tree.radius).tobytes(), np.array(tree.n, np.int32).tobytes()]
        kinds = [pa.list_(pa.int64()), *[pa.binary()] * 5, pa.list_(pa.string()), pa.bool_()]
        values = [[ids[i] for i in tree.order.tolist()], *blobs, total, wide]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds)], names=["ids", "points", "span", "child", "radius", "n", "total", "wide"])

    def run(batches):
        ids, parts, n = [], [], 0
        for b in batches:
            ids += b.column("vec_id").to_pylist()
            parts.append(b.column("v").flatten().to_numpy().reshape(-1, dim))
            n += b.num_rows
            while n >= BLOCK:
                whole = np.concatenate(parts)
                yield packed(ids[:BLOCK], whole[:BLOCK])
                ids, parts, n = ids[BLOCK:], [whole[BLOCK:]], n - BLOCK
        if n:
            yield packed(ids, np.concatenate(parts))

    return run


class Stored:
    """A block's tree, read back."""

    def __init__(self, row: dict, dim: int):
        self.points = np.frombuffer(row["points"], np.int64 if row["wide"] else np.int32).reshape(-1, dim).astype(np.int64)
        self.span = np.frombuffer(row["span"], np.int32).reshape(-1, 2).astype(np.int64)
        self.child = np.frombuffer(row["child"], np.int32).astype(np.int64)
        self.radius = np.frombuffer(row["radius"], float)
        self.n = np.frombuffer(row["n"], np.int32).astype(np.int64)
        self.total = np.array([[int(x) for x in t.split(",")] if t else [] for t in row["total"]], dtype=object).reshape(len(self.n), dim)

    def walk(self, centroids: np.ndarray):
        """(whole balls: node, centroid), (vectors of open leaves: place, centroid)."""
        center = self.total // self.n.astype(object)[:, None]
        points, centers, to = _exact(self.points, center, centroids)
        nodes, open_ = np.zeros(1, np.int64), np.ones((1, len(to)), bool)
        balls, leaves = [], []
        while len(nodes):
            d = _root(_square(centers[nodes], to))
            slack = 1e-6 + d * 1e-9
            r = self.radius[nodes][:, None]
            upper = np.where(open_, d + r + slack, np.inf).min(axis=1)
            open_ = open_ & (d - r - slack <= upper[:, None])
            one = open_.sum(axis=1) == 1
            balls.append(np.stack([nodes[one], open_[one].argmax(axis=1)]))
            leaf = ~one & (self.child[nodes] == 0)
            for node, could in zip(nodes[leaf].tolist(), open_[leaf]):
                a, b = self.span[node].tolist()
                who = np.flatnonzero(could)
                leaves.append(np.stack([np.arange(a, b), who[_square(points[a:b], to[who]).argmin(axis=1)]]))
            down = ~one & ~leaf
            first = self.child[nodes[down]]
            nodes, open_ = np.concatenate([first, first + 1]), np.concatenate([open_[down], open_[down]])
        none = np.zeros((2, 0), np.int64)
        return np.concatenate([none, *balls], axis=1), np.concatenate([none, *leaves], axis=1)


_SUMS = "cluster int, side int, n long, total decimal(38,0)"


def _sums(centroids: np.ndarray):
    """Of trees: for each centroid and component, how many vectors it gets and their sum."""
    dim = centroids.shape[1]

    def run(batches):
        import pyarrow as pa

        n, total = defaultdict(int), defaultdict(lambda: np.zeros(dim, dtype=object))
        for b in batches:
            for row in b.to_pylist():
                tree = Stored(row, dim)
                balls, leaves = tree.walk(centroids)
                for node, c in balls.T.tolist():
                    n[c] += int(tree.n[node])
                    total[c] += tree.total[node]
                for c in np.unique(leaves[1]).tolist():
                    at = leaves[0][leaves[1] == c]
                    n[c] += len(at)
                    total[c] += tree.points[at].astype(object).sum(axis=0)
        rows = [(c, i, n[c], Decimal(int(x))) for c in n for i, x in enumerate(total[c].tolist())]
        c, i, m, t = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(i, pa.int32()), pa.array(m, pa.int64()), pa.array(t, pa.decimal128(38, 0))], names=["cluster", "side", "n", "total"])

    return run


def _assigned(centroids: np.ndarray):
    """Of trees: each vector's centroid and squared distance."""
    dim = centroids.shape[1]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                tree = Stored(row, dim)
                balls, leaves = tree.walk(centroids)
                cluster = np.zeros(len(tree.points), np.int64)
                for node, c in balls.T.tolist():
                    cluster[slice(*tree.span[node].tolist())] = c
                cluster[leaves[0]] = leaves[1]
                points, to = _exact(tree.points, centroids)
                away = points - to[cluster]
                square = [min(int(x), _MOST) for x in (away * away).sum(axis=1).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(cluster, pa.int32()), pa.array(square, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, first: list[list[int]], rounds: int = 5) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of vectors (vec_id, v array<long>, all as long as the centroids), and the last centroids.

    The centroids start as `first`; each round moves every centroid that has
    vectors to the floor of their mean. Ends early when none moves.
    """
    centroids = np.array(first, dtype=np.int64)
    dim = centroids.shape[1]
    trees = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInArrow(_trees(dim), _TREE), "ball-trees")
    for _ in range(rounds):
        sums = trees.mapInArrow(_sums(centroids), _SUMS).groupBy("cluster", "side").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # a row for each centroid and component
        was = centroids.copy()
        for s in sums:
            centroids[s.cluster, s.side] = int(s.total) // s.n
        if (was == centroids).all():
            break
    return stored(trees.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), "ball-clusters"), centroids.tolist()


def integer_vectors(vectors: DataFrame, dim: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, for vectors of dim components that are whole and finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.where((F.size("embedding") == dim) & F.col("embedding").isNotNull()).where(finite)
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """found with its clusters' and the whole's summed distances, and a digest of each vector's last centroid."""
    spark = found.sparkSession
    digest = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    most = F.lit(_MOST).cast("decimal(38,0)")
    summed = lambda x: F.least(F.sum(x), most)
    each = found.groupBy("cluster").agg(summed(F.col("distance").cast("decimal(38,0)")).alias("cluster_inertia")).collect()  # a row a centroid
    whole = min(sum(int(r.cluster_inertia) for r in each), _MOST)
    own = {r.cluster: int(r.cluster_inertia) for r in each}
    facts = spark.createDataFrame([(i, own.get(i, 0), whole, h) for i, h in digest], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_ball_clusters(spark, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    mark = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = vectors.orderBy(mark.asc_nulls_last(), "v").limit(40).select("v").collect()
    if not first:
        return vectors.select("vec_id", *(F.lit(0).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"))), F.lit("").alias("centroid_sha256")).where("false")
    return with_inertia(*cluster(vectors, [r.v for r in first]))


def _oracle(rounds: int = 5, k: int = 40) -> str:
    nearest = """
a{r} AS MATERIALIZED (
  SELECT r, vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT e.r, e.vec_id, e.v, k.c, CAST(list_sum(list_transform(list_zip(e.v, k.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM e CROSS JOIN k{r} k
  ) GROUP BY r, vec_id, v
)"""
    moved = """
k{n} AS MATERIALIZED (
  SELECT k.c, coalesce(m.v, k.v) AS v FROM k{r} k LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
      SELECT c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, 65) AS x(i) GROUP BY c, i
    ) GROUP BY c
  ) m USING (c)
)"""
    steps = [x.format(r=r, n=r + 1) for r in range(rounds) for x in (nearest, moved)] + [nearest.format(r=rounds)]
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), k0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT v, sha256('2:' || vec_id) AS h FROM e ORDER BY h LIMIT {k})
),{",".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN k{rounds} k USING (c)
"""


QUERIES = {"op12_ball_clusters": op12_ball_clusters}
ORACLES = {"op12_ball_clusters": _oracle()}
