"""N-gram Jaccard join by grouped prefixes.

Every document is the set of its word shingles under one global order: those
found often come last, so prefixes are made of rare shingles. Documents with
equal sets are one class; classes with equal prefixes and size are one group.
Groups meet in the buckets of their prefix shingles.

Round 1 pairs each bucket's groups, by size, with a hub: few pairs, in
proportion to the rows, which pass an exact bitmap bound and are verified on the
whole sets from the texts. Round 2 takes the buckets that still hold more than
one component. Each gathers, from the same size, position and bitmap filters,
its clusters: classes that can link with a class of another component, told as
one row a class and never as pairs. Clusters that share a class are one, but
for long chains of them; each class's text, where wide bitmaps don't take it
out again, then goes once to its cluster (to each of its block pairs, where a
cluster is large), which verifies whole sets and skips only pairs that already
lie in one component. So components are exact, although a group of thousands of
near copies never yields all its pairs.

Set sizes, filters and verdicts use exact integers; shingles are 64-bit
hashes, so a document's set can differ only if two shingles of one pair
collide. Edge cases: a null or empty text has an empty set and no links; a
text of fewer words is one shingle; rows that share a doc_id count as one
document; a null doc_id links with nothing and has a null component; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import by_key, components, discard, fresh, release_memory, small_batches, stored, table
from tallyfold.llm.hashing import mix, shingle_sets

#: How many of the most frequent shingles the order puts last; it only steers the order, so results don't depend on it.
FREQUENT = 65_536
#: A partition reports shingles that it sees in so many documents.
LOCAL_MIN = 4
#: Rows above which a bucket or a cluster is dealt out as pairs of blocks, and members verified with one copy of a hub's text.
SPLIT, MEMBERS = 8192, 500
#: Shingles in memory at once, in each of a cluster's two blocks.
SHINGLES = 4_000_000
#: Bits of a set's narrow bitmap, a power of two; a set of more than half as many shingles also has a wide one of twice its size or more.
BITS = 2048
#: Classes of a bucket up to which its pairs are compared at one stroke.
SMALL = 256
#: Rows of the verification's list up to which it is broadcast; beyond, the texts are shuffled to it.
BROADCAST = 1_000_000
_BYTES = 4 << 20
_KEY = ("key", "lo", "hi")


def _parts(texts: list[bytes]):
    """Slices of at most a few MB of text."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _BYTES:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _texts(column) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def frequent_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """The shingles that most documents have, most frequent last, from counts over all documents."""

    def run(batches):
        import pyarrow as pa

        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            texts = _texts(b.column("text"))
            for i, j in _parts(texts):
                k, c = np.unique(np.concatenate(shingle_sets(texts[i:j], words)), return_counts=True)
                keys = np.concatenate([keys, k[c > 1]])
                counts = np.concatenate([counts, c[c > 1]])
                if len(keys) > 1 << 21:
                    keys, at = np.unique(keys, return_inverse=True)
                    counts = np.bincount(at, counts).astype(np.int64)
        keys, at = np.unique(keys, return_inverse=True)
        counts = np.bincount(at, counts, len(keys)).astype(np.int64)
        often = counts >= LOCAL_MIN
        yield pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(counts[often])], names=["s", "n"])
        del keys, counts, often, at
        release_memory()

    seen = docs.select("text").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    top = seen.orderBy(F.desc("n"), "s").limit(FREQUENT).select("s").toPandas()["s"].to_numpy(np.int64)
    return top.view(np.uint64)[::-1].copy()


_SIGNATURE = "doc_id long, n long, d1 long, d2 long, prefix array<long>, bits binary, wide binary"


def bitmap(s: np.ndarray, width: int = BITS) -> bytes:
    """A set's shingles as bits. A bit that one set has and the other has not stands for a shingle at least that they don't share."""
    bits = np.zeros(width, dtype=bool)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def wide(s: np.ndarray) -> bytes:
    """The bitmap of a set that would fill most of a narrow one, else nothing."""
    return bitmap(s, 1 << (2 * len(s) - 1).bit_length()) if 2 * len(s) > BITS else b""


def signatures(docs: DataFrame, words: int, percent: int, last: np.ndarray) -> DataFrame:
    """Set size, 128-bit set digest and ordered prefix of each document."""
    by = np.argsort(last)
    known = last[by]

    def ordered(s: np.ndarray) -> np.ndarray:
        if not len(known) or not len(s):
            return s
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        often = known[at] == s
        return np.concatenate([s[~often], s[often][np.argsort(by[at[often]])]]) if often.any() else s

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts, rows = _texts(b.column("text")), []
            for i, j in _parts(texts):
                for s in shingle_sets(texts[i:j], words):
                    n = len(s)
                    keep = n - -(-percent * n // 100) + 1 if n else 0
                    rows.append((n, int(np.add.reduce(mix(s)).view(np.int64)) if n else 0, int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)) if n else 0, ordered(s)[:keep].view(np.int64), bitmap(s), wide(s)))
            cut = np.cumsum([0, *(len(r[3]) for r in rows)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate([r[3] for r in rows]) if rows else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), lists, *(pa.array([r[k] for r in rows], pa.binary()) for k in (4, 5))], names=["doc_id", "n", "d1", "d2", "prefix", "bits", "wide"])
            del texts, rows, lists
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(run, _SIGNATURE)


_BUCKET = "kind int, a long, b long, n long, pos int"


def _hubs(percent: int):
    def run(batches):
        """Of rows by (token, n, grp): edges of each bucket to its hubs (kind 0: hub, group) and the rows of buckets that round 2 may need (kind 1: token, group, n, pos)."""
        import pyarrow as pa

        token, hub, hub_n, first = None, 0, 0, None
        for batch in batches:
            tok, n, grp, pos, many = (batch.column(c).to_numpy() for c in ("token", "n", "grp", "pos", "many"))
            if not len(tok):
                continue
            same = tok[1:] == tok[:-1]
            live = np.concatenate([[True], same]) | np.concatenate([same, [True]]) | ((many > 0) & (pos == 0))
            out = []
            at = np.flatnonzero(live)
            for t, k, g, p, m in zip(tok[at].tolist(), n[at].tolist(), grp[at].tolist(), pos[at].tolist(), many[at].tolist()):
                if t != token:
                    token, hub, hub_n = t, g, k
                    first = (1, t, g, k, p)
                    if m and p == 0:
                        out.append(first)
                        first = None
                    continue
                if first:
                    out.append(first)
                    first = None
                out.append((1, t, g, k, p))
                if 100 * hub_n >= percent * k:
                    out.append((0, hub, g, 0, 0))
                else:
                    hub, hub_n = g, k
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["kind", "a", "b", "n", "pos"])

    return run


def _bits(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), -1)


def _possible(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes and bitmaps can reach the similarity: the bound never excludes a pair that does."""
    both = np.minimum(na - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), nb - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
    return both * (100 + percent) >= percent * (na + nb)


def plausible(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids that their bitmaps (doc_id, n, bits, wide) don't exclude."""

    def folded(x: np.ndarray, width: int) -> np.ndarray:
        return np.bitwise_or.reduce(x.reshape(-1, width), axis=0)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            ends = [[np.frombuffer(x, dtype=np.uint64) for x in batch.column(c).to_pylist()] for c in ("bits_a", "bits_b")]
            width = np.array([min(len(x), len(y)) for x, y in zip(*ends)], dtype=np.int64)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                for part in np.split(at, range(_BYTES // (8 * w), len(at), _BYTES // (8 * w)) if _BYTES > 8 * w else range(1, len(at))):
                    a, b = (np.stack([folded(end[i], w) for i in part]) for end in ends)
                    keep[part] = _possible(na[part], nb[part], a, b, percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
        release_memory()

    best = F.when(F.length("wide") > 0, F.col("wide")).otherwise(F.col("bits"))
    for end in ("a", "b"):
        pairs = pairs.join(bits.select(F.col("doc_id").alias(end), F.col("n").alias(f"n{end}"), best.alias(f"bits_{end}")), end)
    return pairs.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(run, "a long, b long").distinct()


def _first_of_size(n: np.ndarray, percent: int) -> np.ndarray:
    """Of sizes in order: the first place whose size can reach the similarity with each."""
    return np.searchsorted(n, -(-percent * n // 100))


class _Folded:
    """Bitmaps of several widths: two are compared at the narrower one's, to which the wider is folded."""

    def __init__(self, bits: np.ndarray):
        self.width = np.array([len(b) for b in bits], dtype=np.int64)
        self.of = {}
        for w in np.unique(self.width).tolist():
            self.of[w] = np.zeros((len(bits), w), np.uint64)
            for i in np.flatnonzero(self.width >= w).tolist():
                self.of[w][i] = np.bitwise_or.reduce(bits[i].reshape(-1, w), axis=0)

    def possible(self, n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        out, width = np.zeros(len(i), dtype=bool), np.minimum(self.width[i], self.width[j])
        for w, bits in self.of.items():
            at = np.flatnonzero(width == w)
            step = max(1, _BYTES // (8 * w))
            for p in range(0, len(at), step):
                q = at[p : p + step]
                out[q] = _possible(n[i[q]], n[j[q]], bits[i[q]], bits[j[q]], percent)
        return out


def _clusters(percent: int, small: int, column: str):
    def run(batches):
        """Of rows by (key, lo, hi, n): (a, b) with a the smallest of a cluster's classes and b another. A cluster ties the classes of different components that the filters leave."""
        import pyarrow as pa

        def bitmaps(batch):
            if column == "bits":  # all of one width
                return {"bits": _bits(batch.column(column))}
            out = np.empty(batch.num_rows, dtype=object)
            for i, b in enumerate(batch.column(column).to_pylist()):
                out[i] = np.frombuffer(b, np.uint64)
            return {"bits": out}

        out, size = [], 0
        for x in by_key(batches, _KEY, ("n", "rep", "pos", "comp", "block"), bitmaps):
            n, pos, comp, block, bits, m = x["n"], x["pos"], x["comp"], x["block"], x["bits"], len(x["n"])
            apart = x["lo"][0] != x["hi"][0]
            first, root = _first_of_size(n, percent), np.arange(m)
            folded = _Folded(bits) if bits.dtype == object else None

            def left(i, j):
                """Which of the pairs of places the filters leave."""
                rest = 1 + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1)
                ok = rest * (100 + percent) >= percent * (n[i] + n[j])
                i, j = i[ok], j[ok]
                ok[ok] = folded.possible(n, i, j, percent) if folded else _possible(n[i], n[j], bits[i], bits[j], percent)
                return ok

            if m <= small:
                i, j = np.nonzero(np.triu(comp[:, None] != comp[None, :], 1) & (np.arange(m)[:, None] >= first[None, :]))
                if apart:
                    i, j = (k[block[i] != block[j]] for k in (i, j))
                ok = left(i, j)
                for a, b in zip(i[ok].tolist(), j[ok].tolist()):
                    if root[a] != root[b]:
                        root[root == root[a]] = root[b]
            else:
                for j in range(1, m):
                    at = slice(first[j], j)
                    see = (comp[at] != comp[j]) & (root[at] != root[j])
                    if apart:
                        see &= block[at] != block[j]
                    i = np.flatnonzero(see) + first[j]
                    for p in range(0, len(i), 1 << 14):
                        part = i[p : p + (1 << 14)]
                        part = part[left(part, np.full(len(part), j))]
                        if len(part):
                            root[np.isin(root, root[part])] = root[j]
            by = np.lexsort((x["rep"], root))
            same = root[by][1:] == root[by][:-1]
            if same.any():
                start = np.concatenate([[0], np.flatnonzero(~same) + 1])
                head = np.repeat(x["rep"][by][start], np.diff(np.append(start, m)))[1:][same]
                out.append(np.stack([head, x["rep"][by][1:][same]], axis=1))
                size += len(head)
            if size > 1 << 16:
                yield told(pa, out)
                out, size = [], 0
        yield told(pa, out)
        release_memory()

    def told(pa, out):
        p = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *out]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    return run


def _settle(words: int, percent: int, count: bool = False):
    def run(batches):
        """Of rows by (key, lo, hi, n) with texts: links (a, b) that tie all components of a cluster which any link ties; or, to count them, each class and its copies' links with others (a: class, b: links), where comp is how many copies it has."""
        import pyarrow as pa

        def sets(batch):
            texts, out = _texts(batch.column("text")), np.empty(batch.num_rows, dtype=object)
            for i, j in _parts(texts):
                for k, s in enumerate(shingle_sets(texts[i:j], words)):
                    out[i + k] = s
            return {"set": out}

        for x in by_key(batches, _KEY, ("rep", "comp", "block"), sets):
            size = np.array([len(s) for s in x["set"]], dtype=np.int64)
            by = np.argsort(size, kind="stable")
            n, rep, block, whole = size[by], x["rep"][by], x["block"][by], x["set"][by]
            root, first = np.arange(len(by)) if count else np.unique(x["comp"][by], return_inverse=True)[1], _first_of_size(n, percent)
            copies, links = x["comp"][by], np.zeros(len(by), np.int64)
            apart, out = x["lo"][0] != x["hi"][0], []
            bits = np.stack([np.frombuffer(bitmap(s), np.uint64) for s in whole]) if len(n) > 8 else None
            for j in range(1, len(n)):
                at = slice(first[j], j)
                see = root[at] != root[j]
                if apart:
                    see &= block[at] != block[j]
                i = np.flatnonzero(see) + first[j]
                for p in range(0, len(i), 1 << 14):
                    part = i[p : p + (1 << 14)]
                    if bits is not None:
                        part = part[_possible(n[part], np.full(len(part), n[j]), bits[part], bits[np.full(len(part), j)], percent)]
                    for k in part.tolist():
                        if root[k] != root[j] and _linked(whole[k], whole[j], percent):
                            if count:
                                links[k] += copies[j]
                                links[j] += copies[k]
                                continue
                            out.append((int(rep[k]), int(rep[j])))
                            root[root == root[k]] = root[j]
            if count:
                out = [(int(r), int(k)) for r, k in zip(rep, links) if k]
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        release_memory()

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    if not len(x) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * same >= percent * (len(both) - same)


def _in_blocks(rows: DataFrame, blocks) -> DataFrame:
    """rows (key, rep, ..., k) once for each pair (lo, hi) of their key's k blocks that holds their own."""
    rows = rows.withColumn("k", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), "k").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("k", "other")


def _to_clusters(rows: DataFrame, *columns) -> DataFrame:
    return rows.select("key", "lo", "hi", "n", "rep", "comp", "block", *columns).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "n", "rep")


def _clustered(stars: DataFrame, classes: DataFrame, label: DataFrame, merged: bool = False) -> DataFrame:
    """The classes of clusters once for each pair of blocks, with their component in label (node, component) or themselves.

    Clusters that share a class are one, so that each text goes out once; where
    that makes a chain of more than SPLIT classes, its stars (a, all b) stay
    clusters of their own: a pair that a bucket suspects lies in that bucket's
    star, so work grows with the stars and not with the square of the chain.
    merged: keep chains whole, for those who count each pair once.
    """
    near = stored(components(stars).withColumnRenamed("component", "key"), "jaccard-clusters")
    long = near.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > SPLIT).select("key")
    if not merged and not long.isEmpty():
        in_long = near.join(long, "key", "left_semi").select(F.col("node").alias("a"))
        own = stars.join(in_long, "a", "left_semi")
        apart = own.select(F.col("a").alias("key"), F.col("b").alias("node")).unionByName(own.select(F.col("a").alias("key"), F.col("a").alias("node"))).distinct()
        near = stored(near.join(long, "key", "left_anti").select("key", "node").unionByName(apart), "jaccard-stars-apart")
    near = near.join(classes.select(F.col("rep").alias("node"), "n"), "node").join(label.withColumnRenamed("component", "comp"), "node", "left")
    near = near.select("key", F.col("node").alias("rep"), "n", F.coalesce("comp", "node").alias("comp"))
    size = near.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / SPLIT, F.sum("n") / SHINGLES)).cast("int").alias("blocks"))
    need = stored(_in_blocks(near.join(size, "key"), F.col("blocks")).select("key", "lo", "hi", "n", "rep", "comp", "block"), "jaccard-need")
    return F.broadcast(need) if need.count() <= BROADCAST else need


def _suspects(rows: DataFrame, bits: DataFrame, classes: DataFrame, label: DataFrame, percent: int, merged: bool = False) -> DataFrame | None:
    """Clusters (a, b) of the classes in rows (key, rep, n, pos, comp, size) that may link with one of another component; none at all is None."""
    # one exchange serves both the distinct and the join
    narrow = bits.select(F.col("doc_id").alias("rep"), "n", "bits").repartition("rep", "n").distinct()
    rows = _in_blocks(rows, F.ceil(F.col("size") / SPLIT).cast("int")).join(narrow, ["rep", "n"])
    stars = stored(_to_clusters(rows, "pos", "bits").mapInArrow(_clusters(percent, SMALL, "bits"), "a long, b long").distinct(), "jaccard-stars")
    if stars.isEmpty():
        return None
    # narrow bitmaps tell little of large sets: wide ones look again before any text moves
    best = F.when(F.length("wide") > 0, F.col("wide")).otherwise(F.col("bits"))
    rows = _to_clusters(_clustered(stars, classes, label, merged).join(bits.select(F.col("doc_id").alias("rep"), "n", best.alias("best")), ["rep", "n"]), F.lit(0).alias("pos"), "best")
    stars = stored(rows.mapInArrow(_clusters(percent, SMALL, "best"), "a long, b long").distinct(), "jaccard-stars")
    return None if stars.isEmpty() else stars


def verify(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids that link, stored; pairs is a stored table and is deleted. A hub's text travels once for each MEMBERS of its partners."""
    salt = F.floor((F.row_number().over(Window.partitionBy("a").orderBy("b")) - 1) / MEMBERS).cast("int")
    dealt = pairs.withColumn("salt", salt)
    hubs = dealt.select(F.col("a").alias("doc"), F.col("a").alias("hub"), "salt", F.lit(0).alias("role")).distinct()
    need = stored(dealt.select(F.col("b").alias("doc"), F.col("a").alias("hub"), "salt", F.lit(1).alias("role")).unionByName(hubs), "jaccard-need")

    def run(batches):
        import pyarrow as pa

        key, sets = None, []
        for batch in batches:
            texts = _texts(batch.column("text"))
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("hub", "salt", "role", "doc"))))
            out = []
            for i, j in _parts(texts):
                for (hub, salt, role, doc), s in zip(rows[i:j], shingle_sets(texts[i:j], words)):
                    if (hub, salt) != key:
                        key, sets = (hub, salt), []
                    if role == 0:
                        sets.append(s)
                        continue
                    if any(_linked(h, s, percent) for h in sets):
                        out.append((hub, doc))
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        sets = []
        release_memory()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    wanted = F.broadcast(need) if need.count() <= BROADCAST else need
    dealt = wanted.join(texts, "doc").repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")
    out = stored(dealt.mapInArrow(run, "a long, b long"), "jaccard-links")
    discard(pairs)
    discard(need)
    return out


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text): 100 * intersection >= percent * union links."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = stored(signatures(docs, words, percent, frequent_shingles(docs, words)), "jaccard-signatures")
    full = sig.where("n > 0 and doc_id is not null")
    marked = full.withColumn("h1", F.xxhash64("prefix")).withColumn("h2", F.xxhash64("prefix", F.lit(1)))
    # the prefix follows from the set: any of a class's copies will do, and it moves once, for the groups
    classes = stored(marked.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("h1").alias("h1"), F.first("h2").alias("h2")), "jaccard-classes")
    groups = stored(classes.groupBy("n", "h1", "h2").agg(F.min("rep").alias("doc_id"), F.count("*").alias("reps")), "jaccard-groups")
    members = stored(classes.join(groups.where("reps > 1"), ["n", "h1", "h2"]).select(F.col("doc_id").alias("grp"), "rep"), "jaccard-members")
    once = marked.select("doc_id", "n", "h1", "h2", "prefix").dropDuplicates(["doc_id", "n", "h1", "h2"])
    tokens = once.join(groups, ["doc_id", "n", "h1", "h2"]).select(F.posexplode("prefix").alias("pos", "token"), F.col("doc_id").alias("grp"), "n", (F.col("reps") > 1).cast("int").alias("many"))
    buckets = stored(tokens.repartition("token").sortWithinPartitions("token", "n", "grp").mapInArrow(_hubs(percent), _BUCKET), "jaccard-buckets")

    bits = full.select("doc_id", "n", "bits", "wide")
    near = buckets.where("kind = 0").select("a", "b").unionByName(members.where("grp != rep").select(F.col("grp").alias("a"), F.col("rep").alias("b"))).where("a != b").distinct()
    links = verify(docs, stored(plausible(near, bits, percent), "jaccard-near"), words, percent)
    label = stored(components(links), "jaccard-label")

    rows = buckets.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("grp"), "n", "pos")
    rows = rows.join(members, "grp", "left").select("key", F.coalesce("rep", "grp").alias("rep"), "n", "pos")
    rows = rows.join(label, rows["rep"] == label["node"], "left").select("key", "rep", "n", "pos", F.coalesce("component", "rep").alias("comp"))
    open_ = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 != c1").select("key", "size")
    stars = _suspects(rows.join(open_, "key"), bits, classes, label, percent)
    discard(buckets)
    if stars is not None:
        rows = _to_clusters(_clustered(stars, classes, label).join(docs.select(F.col("doc_id").alias("rep"), "text"), "rep"), "text")
        found = stored(rows.mapInArrow(_settle(words, percent), "a long, b long"), "jaccard-links")
        if not found.isEmpty():
            label = stored(components(links.unionByName(found)), "jaccard-label")

    ends = classes.join(label, classes["rep"] == label["node"], "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    linked = full.select("doc_id", "n", "d1", "d2").join(ends, ["n", "d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sig.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def _once_a_group(rows: DataFrame) -> DataFrame:
    """Buckets (key, rep, comp, n, pos) of two rows or more with their size; those of the same members as one, at each one's least place.

    Near copies share many shingles, each a bucket of the same classes. A least
    place loosens the filter by places, so no pair is lost; should two groups'
    hashes meet, they are one bucket, which loses none either.
    """
    size = rows.groupBy("key").agg(F.count("*").alias("size"), F.expr("bit_xor(xxhash64(rep))").alias("h1"), F.expr("bit_xor(xxhash64(rep, 1))").alias("h2")).where("size > 1")
    return rows.join(size, "key").groupBy(F.xxhash64("size", "h1", "h2").alias("key"), "rep", "comp", "n").agg(F.min("pos").alias("pos"), F.max("size").alias("size"))


def jaccard_links(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, n_links) of docs (doc_id, text) with distinct ids: how many others each links with.

    No pair is skipped for lying in one component: a cluster compares all its
    classes, but tells counts, a row a class. Equal sets are compared once.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = stored(signatures(docs, words, percent, frequent_shingles(docs, words)), "jaccard-signatures")
    full = sig.where("n > 0 and doc_id is not null")
    classes = stored(full.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "jaccard-classes")
    rows = full.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), F.col("doc_id").alias("comp"), "n", F.posexplode("prefix").alias("pos", "key"))
    rows = stored(rows, "jaccard-buckets")
    rows = stored(_once_a_group(rows), "jaccard-buckets")
    none = classes.select(F.col("rep").alias("node"), F.col("rep").alias("component")).where("false")
    stars = _suspects(rows, full.select("doc_id", "n", "bits", "wide"), classes, none, percent, True)
    linked = classes.select("rep", F.lit(0).cast("long").alias("outer")).where("false")
    if stars is not None:
        near = _clustered(stars, classes, none, True).drop("comp").join(classes.select("rep", F.col("copies").alias("comp")), "rep")
        near = _to_clusters(near.join(docs.select(F.col("doc_id").alias("rep"), "text"), "rep"), "text")
        found = stored(near.mapInArrow(_settle(words, percent, True), "a long, b long"), "jaccard-links")
        linked = found.groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("outer"))
    counts = classes.join(linked, "rep", "left").select("n", "d1", "d2", (F.col("copies") - 1 + F.coalesce("outer", F.lit(0))).alias("n_links"))
    found = full.join(counts, ["n", "d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), "n_links")
    return found.unionByName(sig.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(0).cast("long").alias("n_links")))


def op8_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def ngram_links(spark, sf_dir: str) -> DataFrame:
    """How many other documents each one links with, under op8's rule."""
    return jaccard_links(table(spark, sf_dir, "documents"), words=4, percent=85)


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each near-duplicate group: the smallest id, of an id's texts the first. Rows with a null id stay.

    Different texts that share an id are documents of their own, so that one's group doesn't pull in the other's.
    """
    texts = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.xxhash64("text")).alias("h0"), F.max(F.xxhash64("text")).alias("h1"))
    seen = texts.agg(F.max("n").alias("n"), F.max(F.col("h0") != F.col("h1")).alias("many")).first()
    if not seen.many:
        gone = stored(jaccard_components(docs).where("component_id != doc_id").select("doc_id").distinct(), "jaccard-gone")
        left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
        if (seen.n or 0) <= 1:
            return left
        row = fresh(docs, "row")  # any row of an id, as its texts are equal; partial sums keep a hot id's rows apart
        once = left.where("doc_id is not null").groupBy("doc_id").agg(F.first(F.struct(*docs.columns)).alias(row)).select(f"{row}.*")
        return once.unionByName(left.where("doc_id is null"))
    row, name = fresh(docs, "row"), fresh(docs, "id")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "jaccard-rows")  # stored, so that the numbers stay
    named = rows.where("doc_id is not null").groupBy("doc_id", "text").agg(F.min(row).alias(row))
    named = stored(named.select(row, F.col("doc_id").alias(name), "text"), "jaccard-named")
    found = jaccard_components(named.select(F.col(row).alias("doc_id"), "text"))
    first = named.join(found.select(F.col("doc_id").alias(row), "component_id"), row).groupBy("component_id").agg(F.min(F.struct(name, "text", row)).alias("m"))
    kept = stored(first.select(f"m.{row}"), "jaccard-kept")
    return rows.join(kept, row, "left_semi").select(*docs.columns).unionByName(rows.where("doc_id is null").select(*docs.columns))


QUERIES = {"op8_ngram_join": op8_ngram_join, "ngram_links": ngram_links}
_LINKED_PAIRS = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [md5(array_to_string(words, ' ') || ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: md5(array_to_string(words[i:i + 3], ' '))) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 85 * (x.n + y.n - both_)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l)
"""
ORACLES = {
    "op8_ngram_join": _LINKED_PAIRS.rstrip() + """,
r AS (SELECT a AS doc_id, a AS c FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m ON m.doc_id = d.doc_id
""",
    "ngram_links": _LINKED_PAIRS + "SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM e GROUP BY 1) k ON k.doc_id = d.doc_id",
}
