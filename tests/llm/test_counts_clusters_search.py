"""Token counts, ball-tree clusters and MaxScore search against the library and plain versions, on odd rows and tiny limits."""

import hashlib
import re
from collections import Counter, defaultdict
from math import floor, inf, log, nan

import numpy as np
import pytest

from tallyfold.llm import ball_clusters, bpe, maxscore, token_counts

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " \n\t ", "one", "One two, ONE", "x" * 5000, "word wörd " * 3000, "a<|endoftext|>b <|endoftext|>", "é  　漢字 I'll don't 12 345", "one", "  two\n\n three"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 7, "clash") for i, t in enumerate(TEXTS)] + [(3, "one", 7, "clash"), (None, "null id one", 7, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, score string").repartition(3)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


def counted(library, text, limit=token_counts.LIMIT):
    n = len(library.encode(text or "", add_special_tokens=False).ids)
    return len((text or "").encode()), n, n > limit


@pytest.mark.parametrize("limits", [{}, {"CHUNK_CHARS": 64, "PIECES": 5, "CACHE": 3, "FREQUENT": 4, "LONGEST": 5, "LONG_PIECE": 2}])
def test_token_counts(monkeypatch, docs, library, limits):
    for k, v in limits.items():
        monkeypatch.setattr(token_counts, k, v)
    lengths = token_counts.Lengths(bpe.default_tokenizer(), {" two": 1})
    assert [lengths.count(t or "") for t in TEXTS] == [counted(library, t)[1] for t in TEXTS]
    found = token_counts.count_tokens(docs, limit=3)
    assert found.columns == ["doc_id", "text", "score", "n_bytes", "n_tokens", "over_limit"]
    got = found.collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        assert (r.n_bytes, r.n_tokens, r.over_limit) == counted(library, r.text, 3)


def test_token_count_tiers(spark, docs, library):
    texts = spark.createDataFrame([("the cat the cat the sat",), (None,), ("the mat",)], "text string")
    tier = token_counts._opened(token_counts.frequent_lengths(texts))
    assert tier == {" the": 1, " cat": 1, "the": 1}
    lengths = token_counts.Lengths(bpe.default_tokenizer(), tier)
    assert (lengths.count("the cat"), lengths.count("the cat the cat"), lengths.misses) == (2, 4, 0)
    assert (lengths.count("the dog"), lengths.count("the dog"), lengths.misses) == (2, 2, 1) and len(lengths) == len(tier) + 1
    slow = bpe.load(bpe.default_tokenizer())
    assert all(lengths.encode(p) == len(slow.encode_distinct([p.encode()])[0]) for p in (" unbelievable", "漢字", "x" * 99, "x" * 5000, "\n\n\t"))
    empty = token_counts.count_tokens(docs.where("false"))
    assert empty.count() == 0 and "n_tokens" in empty.columns


def test_token_counts_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = token_counts.op11_token_counts(spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {i: counted(library, t) for i, t in texts.items()} and len(got) == len(texts)


def lloyd(rows, first, rounds):
    """Plain rounds in Python integers: ({place: (centroid, distance)}, centroids)."""
    centroids = [list(c) for c in first]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((away(v, c), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        got = defaultdict(list)
        for v in rows:
            got[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(got[i]) for x in zip(*got[i])] if i in got else c for i, c in enumerate(centroids)]
    return [nearest(v)[::-1] for v in rows], centroids


@pytest.mark.parametrize("kind", ["spread", "clumps", "equal", "ties", "large"])
def test_ball_clusters(monkeypatch, spark, kind):
    monkeypatch.setattr(ball_clusters, "BLOCK", 60)
    monkeypatch.setattr(ball_clusters, "LEAF", 4)
    rng = np.random.default_rng(5)
    rows = {
        "spread": rng.integers(-300, 300, (200, 5)),
        "clumps": rng.integers(-9, 9, (6, 5)).repeat(40, axis=0) * 100 + rng.integers(-3, 4, (240, 5)),
        "equal": np.ones((150, 5), np.int64) * 7,
        "ties": rng.integers(0, 3, (150, 2)),
        "large": rng.integers(-(2**60), 2**60, (80, 3)),
    }[kind].tolist()
    first = rows[:7]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, v array<long>").repartition(3)
    found, centroids = ball_clusters.cluster(frame, first, 5)
    expected, plain = lloyd(rows, first, 5)
    assert centroids == plain
    assert {r.vec_id: (r.cluster, r.distance) for r in found.collect()} == {i: (c, min(d, 2**63 - 1)) for i, (c, d) in enumerate(expected)}


def test_ball_tree_gives_balls_whole():
    points = np.array([[0, 0]] * 50 + [[1000, 1000], [1001, 1000], [1000, 1003]] * 40)
    tree = ball_clusters.BallTree(points)
    row = {"wide": False, "points": points[tree.order].astype(np.int32).tobytes(), "span": np.array(tree.span, np.int32).tobytes(), "child": np.array(tree.child, np.int32).tobytes()}
    row |= {"radius": np.array(tree.radius).tobytes(), "n": np.array(tree.n, np.int32).tobytes(), "total": [",".join(map(str, t)) for t in tree.total]}
    balls, leaves = ball_clusters.Stored(row, 2).walk(np.array([[0, 0], [1000, 1000]]))
    # every vector once, and one by one only those of the leaf that lies in both clumps
    assert sum(tree.n[i] for i in balls[0]) + leaves.shape[1] == len(points) and leaves.shape[1] <= ball_clusters.LEAF and balls.shape[1] < 8


def test_ball_clusters_odd_rows(spark):
    vec = [float(x) / 256 for x in range(64)]
    rows = [(1, vec, 1), (2, vec, 2), (3, None, 1), (4, vec[:63], 1), (5, [nan, *vec[1:]], 1), (6, [inf, *vec[1:]], 1), (7, [None, *vec[1:]], 1), (None, vec, 1), (2, vec, 2), (8, [], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    kept = ball_clusters.integer_vectors(frame)
    assert sorted(r.vec_id or -1 for r in kept.collect()) == [-1, 1, 2, 2] and kept.first().v == list(range(64))
    got = ball_clusters.with_inertia(*ball_clusters.cluster(kept, [list(range(64)), list(range(1, 65))])).collect()
    digest = hashlib.sha256(",".join(map(str, range(64))).encode()).hexdigest()
    assert len(got) == 4 and all(tuple(r)[1:] == (0, 0, 0, 0, digest) for r in got)


def test_ball_clusters_empty(spark, tmp_path):
    spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = ball_clusters.op12_ball_clusters(spark, str(tmp_path))
    assert got.collect() == [] and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(docs, items, k):
    """Plain scores: {(item, rank): (doc, score)}."""
    split = [(i, Counter(TERM.findall((t or "").translate(LOW)))) for i, t in docs]
    split = [(i, c, sum(c.values())) for i, c in split if c]
    total, tokens = len(split), sum(n for _, _, n in split)
    df = Counter(t for _, c, _ in split for t in c)
    out = {}
    for item, text in items:
        asked = set(TERM.findall((text or "").translate(LOW)))
        found = []
        for i, c, n in split:
            m = 100 - 50 + (50 * n * total) // tokens
            score = sum(floor(1000 * log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        for rank, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out[item, rank] = (i, -s)
    return out


@pytest.mark.parametrize("limits", [{}, {"SHARD_DOCS": 7, "SHARD_POSTINGS": 30, "BLOCK_TERMS": 10}])
@pytest.mark.parametrize("k", [1, 3, 50])
def test_maxscore(monkeypatch, spark, limits, k):
    for name, v in limits.items():
        monkeypatch.setattr(maxscore, name, v)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)] + ["É1", "漢字", "Ab"]
    share = 1 / np.arange(1, len(words) + 1)
    docs = [(i, " ,.".join(rng.choice(words, rng.integers(1, 60), p=share / share.sum()))) for i in range(150)]
    docs += [(900, None), (901, ""), (902, "., !"), (3, docs[3][1]), (904, docs[3][1]), (None, docs[3][1]), (905, "w1 " * 70_000), (906, "AB ab aB  é1")]
    items = [(1, "w0 W1 w39 w20"), (2, "ab AB É1 nothing"), (3, None), (4, "..."), (5, "unseen"), (None, "w3 w4 w5 w6 w7"), (7, " ".join(words)), (7, "zzz")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.item_id, r.rank): (r.doc_id, r.score) for r in maxscore.search(frame, asked, k).collect()}
    assert got == ranked(docs, items[:-1], k)
    assert maxscore.search(frame.where("false"), asked).count() == 0 and maxscore.search(frame, asked.where("false")).count() == 0


def test_maxscore_skips_what_cannot_qualify():
    # One rare term decides; the frequent term's list is probed for its documents only.
    row = {"docs": list(range(1000)), "sizes": np.full(1000, 10, np.int64).tobytes(), "terms": [0, 1], "dfs": [60, 1000], "tokens": 10_000}
    row |= {"places": np.concatenate([np.arange(60), np.arange(1000)]).astype(np.uint16).tobytes(), "tfs": np.ones(1060, np.uint32).tobytes()}
    shard = maxscore.Shard(row, np.array([5000, 1]), 1000, 10_000)
    seen = []
    take = shard.list
    shard.list = lambda i: seen.append(i) or take(i)
    place, score = shard.search(np.array([0, 1]), 50, 1)
    assert sorted(place.tolist()) == list(range(60)) and len(set(score.tolist())) == 1
    assert not shard.sums[60:].any()  # never merged whole
