"""The operators against plain versions, on small tables with nulls, empty and long texts, ties, repeated rows, clashing columns and no rows."""

import hashlib
import time
import zlib
from collections import Counter
from math import log10

import duckdb
import numpy as np
import pytest
from brute_pii import BASE_TEXTS, base_spans, digest

from tallyfold.llm import bpe, chat, kd_search, kneser_ney, mixing, near_vectors, ngram_join, pii, quality, registry, warc
from tallyfold.llm.common import stored

SF = "/root/testdata/sf0.001"
LOW = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
TEXTS = [None, "", " \n\t", "one", "One two", "a b c d e f g h", "A B C D E F G H", "x" * 5000, "word " * 4000, "<|endoftext|> I'll don't", *BASE_TEXTS]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ["s1", None, "s2"][i % 3], 1, "clash") for i, t in enumerate(TEXTS)] + [(3, "one", "en", "s1", 1, "clash"), (None, "null id", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    found = con.sql(registry.oracle_sql()[name])
    at = [list(found.columns).index(c) for c in cols]
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in found.fetchall())


def test_pii(docs):
    for r in pii.find_spans(docs).collect():
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE] == base_spans(r.text)
    for r in pii.redact(docs).select("doc_id", "text").collect():
        assert not base_spans(r.text)


def test_pii_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = pii.op6_pii(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        base = base_spans(texts[r.doc_id])
        kinds = Counter(k for k, _, _ in base)
        assert r.base_sha256 == digest(base) and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in pii.BASE)
        listed = [x.split(":") for x in r.spans.split(",") if x]
        assert [(k, int(a), int(b)) for k, a, b in listed if k in pii.BASE] == base


def test_pii_many_matches(spark):
    # Work near the number of matches: no array is copied whole at each one, no place is found from the text's start.
    text = "é " + "".join(f"ssn a{i}@b.com {i % 7}23-45-6789, " for i in range(30_000))
    frame = spark.createDataFrame([(1, text, "own")], "doc_id long, text string, spans string")
    began = time.time()
    r = pii.find_spans(frame, into="found").first()
    assert [(s.kind, s.start, s.end) for s in r.found if s.kind in pii.BASE] == base_spans(text) and len(r.found) == 60_000 and r.spans == "own"
    out = pii.redact(frame).first()
    assert time.time() - began < 180
    assert out.spans == "own" and out.text == "é " + "ssn [EMAIL] [NATIONAL_ID], " * 30_000


#: Text: the added kinds' spans in it.
ADDED_TEXTS = {
    "SSN: 123-45-6789, 987-65-4321": [("national_id", 5, 16), ("national_id", 18, 29)],
    "123-45-6789 (SSN)": [("national_id", 0, 11)],
    "é 123-45-6789" + " " * 35 + "ssn": [("national_id", 2, 13)],
    "123-45-6789" + " " * 40 + "ssn": [],
    "ssn" + " " * 40 + "123-45-6789": [],
    "ES91 2100 0418 4502 0005 1332 BIC": [("iban", 0, 29)],
    "ES9121000418450200051332 BANK NOW": [("iban", 0, 24)],
    "ES91 2100 0418 4502 0005 1332 DE89 3704 0044 0532 0130 00 EUR": [("iban", 0, 29), ("iban", 30, 57)],
    "GB82 WEST 1234 5698 7654 32": [("iban", 0, 27)],
    "ES91 2100 0418 4502 0005 1333 BIC": [],
    "ES91 2100 0418 4502 0005": [],
    "ZZ75 2100 0418 4502 0005 1332 BIC": [("iban", 0, 29)],
}


def test_pii_added_kinds(spark):
    frame = spark.createDataFrame([(t,) for t in ADDED_TEXTS], "text string")
    for r in pii.find_spans(frame).collect():
        assert (r.text, [(s.kind, s.start, s.end) for s in r.spans if s.kind not in pii.BASE]) == (r.text, ADDED_TEXTS[r.text])
    assert "BIC" in [r.text for r in pii.redact(frame).collect()][5] and "1332" not in [r.text for r in pii.redact(frame).collect()][5]


def test_bpe(docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_tokenizer())
    for r in bpe.decode(bpe.encode(docs)).collect():
        assert r.token_ids == lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == lib.decode(r.token_ids, skip_special_tokens=False)
    for r in bpe.round_trip(docs.where("doc_id is not null")).collect():
        ids = lib.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def plain_targets(sizes):
    """Targets of sources by rounds: capped at three times their size, the rest reshared by weight."""
    weight = {x: i % 3 + 1 for i, x in enumerate(sorted(sizes, key=lambda x: (x is None, x or "")))}
    target, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[x] for x in open_)
        full = {x for x in open_ if weight[x] * level > 3 * sizes[x]}
        for x in full or open_:
            target[x] = 3.0 * sizes[x] if full else weight[x] * level
            left -= target[x]
        open_ -= full or set(open_)
    return target


def test_mix(docs):
    got = mixing.mix(mixing.doc_sizes(docs)).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        assert 0 <= r.copies <= 3
    total = {r.source: r.source_size for r in got}
    want = plain_targets(total)
    assert all(abs(r.target - want[r.source]) < 1e-6 * max(1, r.target) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(mixing.doc_sizes(docs)).collect()))
    assert mixing.remix(docs).count() == sum(r.copies for r in got)


@pytest.mark.parametrize("limits", [{}, {"BLOCK_ROWS": 40, "BROADCAST_SOURCES": 0}])
def test_mix_many_sources_and_hot_rows(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(mixing, name, value)
    rng = np.random.default_rng(9)
    words = lambda n: " ".join(["w"] * n)
    rows = [(i, words(int(rng.integers(0, 30))), f"s{i % 23}", 7) for i in range(700)] + [(None, words(11), None, i) for i in range(300)] + [(5, words(4), "s5", 1), (5, words(4), "s5", 2), (5, "four other words here", "s5", 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int").repartition(5)
    got = mixing.mix(mixing.doc_sizes(frame)).collect()
    sizes = Counter()
    for _, t, source, _ in rows:
        sizes[source] += len(t.split())
    want = plain_targets(sizes)
    assert len(got) == len(rows) and all(abs(r.target - want[r.source]) < 1e-6 * max(1, r.target) and r.source_size == sizes[r.source] for r in got)
    taken = Counter()
    for r in got:
        taken[r.source] += r.size * r.copies
    assert all(abs(taken[x] - want[x]) <= 30 for x in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(mixing.doc_sizes(frame.repartition(2))).collect()))
    out = mixing.remix(frame).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in out) == Counter({k: v for k, v in Counter({}).items()}) + sum((Counter({(r.doc_id, t, r.source): r.copies}) for r, t in _texts_of(got, rows)), Counter())
    assert max(Counter(map(str, out)).values()) <= 3 and {r.copies for r in out} >= {1, 7}


def _texts_of(units, rows):
    """Units of a mix beside a text of their id, source and size; the rows of this test with one id and size differ in text only under id 5."""
    by = {}
    for i, t, source, _ in rows:
        by.setdefault((i, source, len(t.split())), []).append(t)
    seen = {}
    for r in sorted(units, key=lambda r: (str(r.doc_id), str(r.source), r.size, r.h, r.unit)):
        texts = by[r.doc_id, r.source, r.size]
        if len(set(texts)) == 1:
            yield r, texts[0]
            continue
        same = Counter(texts)
        n = sum(x.h == r.h and x.doc_id == r.doc_id and x.source == r.source and x.size == r.size for x in units)
        yield r, next(t for t, k in same.items() if k == n)
        seen[r.h] = n


def test_mix_lands_near_target(spark):
    rows = mixing.op9_mixing(spark, "/root/testdata/sf0.01").toPandas()
    by = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by.taken - by.target).abs() / by.target).max() < 0.02
    assert (rows.taken <= 3 * rows["size"]).all()


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), *[(1, i, ["assistant", "user"][i % 2], f"turn {i} " * (60 * (i % 4))) for i in range(1, 12)], (2, 0, None, None), (2, 0, None, None), (None, 1, "assistant", "<|im_end|> <\\|"), (3, None, "assistant", "w " * 3000)]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, loss string")
    windows = chat.format_windows(turns)
    assert all(r.n_tokens <= chat.BUDGET or r.n_new == 1 for r in windows.collect())
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t for _, role, t in own if role == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_windows(turns.where("false"))).count() == 0


def test_chat_query(spark):
    """The registered query with its own conversation, against turns read from the table."""
    tricky = "<|im_end|><|im_start|>assistant ok"
    convs = {-1: [(0, "user", tricky), (1, "assistant", tricky)]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        convs.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    got = {r.conv_id: r for r in chat.op5_chat(spark, SF).collect()}
    assert got.keys() == convs.keys()
    for i, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[i].n_turns == len(turns) and got[i].turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert (got[i].loss_chars, got[i].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    one = "".join(f"<|im_start|>{role}\n" + tricky.replace("<|", "<\\|") + "<|im_end|>\n" for role in ("user", "assistant"))
    assert got[-1].formatted_chars == len(one) and sum(r.formatted_chars for r in chat.op5_chat(spark, SF).collect()) == sum(len(r.text) for r in chat.format_windows(spark.read.parquet(f"{SF}/conversations.parquet")).collect()) + len(one)


def test_bpe_query(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_tokenizer())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = bpe.op7_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    rows = spark.createDataFrame([(1, [], "x"), (1, [], "x"), (2, None, None)], "doc_id long, token_ids array<int>, decoded string")
    assert [r.decoded for r in bpe.decode(rows).collect()] == ["", "", None]


def plain_scores(spark, sf):
    """Scores of all documents by the same statistics, with the fit done in one place: features, ridge, isotonic steps."""
    docs = {r.doc_id: quality.text_stats((r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None and r.doc_id in docs and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    fold = {r.doc_id: r.f for r in spark.createDataFrame([(i,) for i, _ in labels], "doc_id long").selectExpr("doc_id", f"pmod(xxhash64(doc_id, {quality.SEED}), 5) AS f").collect()}
    x, y, f = np.array([docs[i] for i, _ in labels]), np.array([float(q) for _, q in labels]), np.array([fold[i] for i, _ in labels])
    mean, scale = x.mean(axis=0), np.sqrt(np.maximum(x.var(axis=0), 1e-8))
    rng = np.random.default_rng(quality.SEED)
    turn = rng.normal(size=(x.shape[1], quality.FEATURES)) / quality.WIDTH
    phase = rng.uniform(0, 2 * np.pi, quality.FEATURES)
    z = lambda v: np.hstack([np.cos(np.clip((v - mean) / scale, -6, 6) @ turn + phase) * (2 / quality.FEATURES) ** 0.5, np.ones((len(v), 1))])
    a, b = z(x[f > 0]), y[f > 0]
    pull = quality.RIDGE * len(a) * np.diag([1.0] * quality.FEATURES + [0.0]) + 1e-9 * len(a) * np.eye(quality.FEATURES + 1)
    weights = np.linalg.solve(a.T @ a + pull, a.T @ b)
    cell = lambda v: np.clip((z(v) @ weights + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1).astype(int)
    held = sorted(zip(cell(x[f == 0]).tolist(), y[f == 0].tolist()))
    pools = [[[c], [v]] for c, v in held]
    done = False
    while not done:  # pool neighbours until means rise
        done = True
        for i in range(len(pools) - 1):
            if pools[i][0][-1] == pools[i + 1][0][0] or np.mean(pools[i][1]) >= np.mean(pools[i + 1][1]):
                pools[i] = [pools[i][0] + pools[i + 1][0], pools[i][1] + pools[i + 1][1]]
                del pools[i + 1]
                done = False
                break
    at = [c for p in pools for c in (p[0][0], p[0][-1])]
    steps = np.interp(np.arange(quality.BINS), at, [np.mean(p[1]) for p in pools for _ in range(2)])
    ids = list(docs)
    return dict(zip(ids, np.clip(steps, 0, 1)[cell(np.array([docs[i] for i in ids]))]))


def test_quality_plain(spark):
    want = plain_scores(spark, "/root/testdata/sf0.01")
    got = quality.op4_quality(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(want)
    far = [r for r in got if abs(r.score - want[r.doc_id]) > 1e-6]
    assert len(far) <= 0.005 * len(got)  # a raw score on the edge of a bin may round to its neighbour
    assert all(r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_quality_edges(spark, docs, monkeypatch):
    stats = quality.document_stats(docs)
    label = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, label int")
    assert {r.score for r in quality.score(stats, quality.fit(stats, label((3, 1), (5, 1), (6, None), (None, 0)))).collect()} == {1.0}
    assert quality.score(stats.where("false"), quality.fit(stats, label((3, 1), (3, 1), (5, 0)))).count() == 0
    monkeypatch.setattr(quality, "MAX_TRAINING_ROWS", 3)
    seen = []
    monkeypatch.setattr(quality, "stored", lambda df, name: seen.append(df) or stored(df, name))
    quality.fit(quality.document_stats(docs.where("doc_id is not null").dropDuplicates(["doc_id"])), label(*[(i, i % 2) for i in range(12)]))
    assert 1 <= seen[0].count() <= 3


def test_quality(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = quality.op4_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out and quality is not null").toPandas()
    assert (held.predicted == held.quality).mean() > 0.95
    stats = quality.document_stats(docs)
    none = quality.fit(stats, labels.selectExpr("doc_id", "quality as label").where("false"))
    assert quality.score(stats, none).where("score = 0.5").count() == docs.count()


def shingles(text, k):
    w = (text or "").encode().translate(LOW).split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("limits", [{}, {"SPLIT": 7, "MEMBERS": 2, "BROADCAST": 0, "SMALL": 3, "SHINGLES": 2000}, {"SPLIT": 5, "SMALL": 1000, "MEMBERS": 1}])
def test_jaccard(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ngram_join, name, value)
    rng = np.random.default_rng(3)
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    for g, (size, copies, step) in enumerate([(300, 60, 6), (40, 30, 9), (90, 80, 14), (3000, 40, 1)]):
        base = [f"w{i}" for i in rng.integers(0, 5000, size)]
        for i in range(copies):  # near copies at many similarities
            w = list(base)
            for at in rng.integers(0, size, i // step):
                w[at] = f"n{i}"
            rows.append((100 + 200 * g + i, " ".join(w)))
    rows += [(900, rows[-1][1]), (None, "one")]
    frame = spark.createDataFrame([(*r, 5, "clash") for r in rows], "doc_id long, text string, n int, component_id string")
    got = {r.doc_id: r for r in ngram_join.jaccard_components(frame, words=4, percent=85).collect()}
    sets = {i: shingles(t, 4) for i, t in rows if i is not None}
    low = {i: i for i in sets}
    ids, changed = sorted(sets), True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= (low[a], low[b]) != (m, m)
            low[a] = low[b] = m
    assert {i: (got[i].n_shingles, got[i].component_id) for i in ids} == {i: (len(sets[i]), low[i]) for i in ids}
    assert got[None].component_id is None


def test_clusters_keep_every_class_that_can_link():
    # Two components whose only link is between their second classes: the first ones look alike too.
    import pyarrow as pa

    same = np.packbits(np.ones(ngram_join.BITS, bool)).tobytes()
    cols = {"key": [1] * 4, "lo": [0] * 4, "hi": [0] * 4, "n": [50] * 4, "rep": [1, 2, 3, 4], "pos": [0] * 4, "comp": [1, 1, 3, 3], "block": [0] * 4}
    batch = pa.RecordBatch.from_pydict(cols | {"bits": [same] * 4})
    batch = batch.append_column("best", pa.array([same, same * 2, same * 4, same]))
    for small in (1, 100):
        for column in ("bits", "best"):
            found = [tuple(r.values()) for b in ngram_join._clusters(85, small, column)([batch.slice(0, 2), batch.slice(2)]) for r in b.to_pylist()]
            assert found == [(1, 2), (1, 3), (1, 4)]


def test_word_hashes():
    from tallyfold.llm.hashing import word_hashes

    one = "a"  # Thue-Morse words and their swaps meet in any polynomial hash modulo 2^64
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    texts = [f"{one} {other}", "", " x\tyy ABCDEFGHI abcdefghi abcdefghij", "z" * (3 << 20), "b a aa abcdefgh abcdefgh\0"]
    h, n = word_hashes([t.encode() for t in texts])
    words = [w for t in texts for w in t.encode().translate(LOW).split()]
    assert n.tolist() == [2, 0, 5, 1, 5] and len(set(h.tolist())) == len(set(words)) == len(h) - 1 and h[4] == h[5 - 1]
    assert h[words.index(b"abcdefghi")] == h[words.index(b"abcdefghi") + 1]


def test_kneser_ney(docs):
    told = docs.where("doc_id is not null").selectExpr("doc_id", "text", "crc32(cast(cast(doc_id as string) as binary)) % 5 = 1 as held_out")
    got = kneser_ney.score(told, kneser_ney.train(told.where("not held_out"))).collect()
    toks = [(i, t) for i, t in [*enumerate(TEXTS), (3, "one")]]
    split = lambda t: (t or "").encode().translate(LOW).split() + [None]
    c = Counter(w for i, t in toks if zlib.crc32(str(i).encode()) % 5 != 1 for w in split(t))
    n, v = sum(c.values()), len(c)
    for r in got:
        w = split(TEXTS[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) < 1e-6 * max(1, len(w))
        assert r.score < 0
    keys, counts = np.array([0, 5, 2**63], np.uint64), np.array([1, 255, 70000], np.uint64)
    assert all((a == b).all() for a, b in zip(kneser_ney.unpack(kneser_ney.pack(keys, counts)), (keys, counts)))
    nothing = kneser_ney.train(told.where("false"))
    assert kneser_ney.score(told, nothing).where("base_score = 0").count() == len(got)


def plain_kneser_ney(texts, order):
    """p(word, history) of an interpolated modified Kneser-Ney model in dicts of word tuples, and its vocabulary."""
    grams = {m: Counter() for m in range(1, order + 1)}
    vocab = set()
    for t in texts:
        vocab |= set(t)
        w = ["<s>", *t]
        grams[order].update(tuple(w[i : i + order]) for i in range(len(w) - order + 1))
        for m in range(2, order):
            if len(w) >= m:
                grams[m][tuple(w[:m])] += 1
    for m in range(order, 1, -1):
        grams[m - 1].update(g[1:] for g in grams[m])
    d = {m: kneser_ney.discounts(*(sum(c == k for c in g.values()) for k in (1, 2, 3, 4))) for m, g in grams.items()}
    by = {}
    for m, g in grams.items():
        for k, c in g.items():
            by.setdefault((m, k[:-1]), []).append(c)

    def p(word, history):
        out = 1 / (len(vocab) + 1)
        for m in range(1, min(order, len(history) + 1) + 1):
            h = tuple(history[len(history) - m + 1 :])
            got = by.get((m, h))
            if got:
                less = lambda c: d[m][min(c, 3) - 1]
                c = grams[m][(*h, word)]
                out = (max(c - less(c), 0) if c else 0) / sum(got) + sum(map(less, got)) / sum(got) * out
        return out

    return p, vocab


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_plain(spark, order):
    rng = np.random.default_rng(order)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.4, rng.integers(0, 40)) % 60) for _ in range(120)] + ["a b " * 300, "", None]
    frame = spark.createDataFrame([(i, t, i % 4 == 1) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean")
    model = kneser_ney.train(frame.where("not held_out"), order)
    words = lambda t: [*(t or "").split(), "</s>"]
    p, vocab = plain_kneser_ney([words(t) for i, t in enumerate(texts) if i % 4 != 1], order)
    for r in kneser_ney.score(frame, model).collect():
        w = ["<s>", *words(texts[r.doc_id])]
        assert abs(r.score - sum(log10(p(w[i], w[:i])) for i in range(1, len(w)))) < 1e-9 * len(w)
    for history in ([], ["a"], ["a", "b"], ["w1", "w2", "w1"], ["w1", "w1", "w1"], ["never", "w1"]):
        # over the vocabulary, one unknown word and the end, from the scorer itself
        scorer = kneser_ney.Scorer(model)

        def last(word):
            known = [" ".join([*history, word])] if word != "</s>" else [" ".join(history)]
            h, n = kneser_ney.tokens([x.encode() for x in known])
            before = h[: len(history)]
            one = lambda x: scorer.score(x, np.array([len(x)]))[2][0] if len(x) else 0.0
            return 10 ** (one(h[: len(history) + 1]) - one(before))

        assert abs(sum(last(x) for x in [*vocab, "unheard"]) - 1) < 1e-9


def test_kneser_ney_open_files(spark, monkeypatch):
    """A model of 128 partitions' buckets is scored under a limit of 256 open files, with the scores of one of 2 partitions."""
    import os
    import resource

    texts = [" ".join(f"w{(i * j) % 97}" for j in range(i % 23)) for i in range(400)]
    frame = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean")
    model, small = kneser_ney.train(frame.repartition(128), 3), kneser_ney.train(frame.coalesce(2), 3)
    assert sum(b.bit_count() for x in model["there"].values() for b in x) > 600
    h, n = kneser_ney.tokens([t.encode() for t in texts])
    scorer = kneser_ney.Scorer(model)
    opened = lambda: len(os.listdir("/proc/self/fd"))
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    began = opened()
    resource.setrlimit(resource.RLIMIT_NOFILE, (256, hard))
    try:
        full = scorer.score(h, n)[2]
        assert opened() - began <= 2 * kneser_ney.POOL + 2
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
    assert np.allclose(full, kneser_ney.Scorer(small).score(h, n)[2], rtol=1e-12)
    monkeypatch.setattr(kneser_ney, "POOL", 1)
    assert (kneser_ney.Scorer(model).score(h, n)[2] == full).all()
    # a task that runs again writes its files again
    for name in os.listdir(model["folder"].removeprefix("file://")):
        assert name.endswith(".bin")


def test_kneser_ney_word_numbers():
    kneser_ney.check_numbers(2**32 - 3)
    with pytest.raises(ValueError):
        kneser_ney.check_numbers(2**32 - 2)


def test_kneser_ney_arrays():
    rng = np.random.default_rng(5)
    for m in (1, 2, 3, 4):
        cols = [rng.integers(0, 2**32 if i % 2 else 50, 5000, dtype=np.uint64).astype(np.uint32) for i in range(m)]
        counts = rng.zipf(1.3, 5000).astype(np.uint64)
        want = Counter()
        for *row, c in zip(*(x.tolist() for x in cols), counts.tolist()):
            want[tuple(row)] += c
        grouped = kneser_ney._grouped(cols, counts)
        assert dict(zip(zip(*(x.tolist() for x in grouped[0])), grouped[1].tolist())) == want and len(grouped[1]) == len(want)
        assert Counter(zip(*(x.tolist() for x in cols))) == dict(zip(zip(*(x.tolist() for x in kneser_ney._grouped(cols)[0])), kneser_ney._grouped(cols)[1].tolist()))
        got, c = kneser_ney.unpack_rows(kneser_ney.pack_rows(cols, counts), m)
        assert sorted(zip(*(x.tolist() for x in cols), counts.tolist())) == sorted(zip(*(x.tolist() for x in got), c.tolist()))
    for n, columns in ((0, 1), (1, 1), (5000, 1), (70_000, 4)):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        plain = np.array([1, 1, 0, 0][:columns], np.uint64)
        values = np.where(rng.random((len(keys), 1)) < 0.6, plain, rng.zipf(1.2, (len(keys), columns)).astype(np.uint64) % 10**9 + 1)
        table = kneser_ney.Table(kneser_ney._coded(keys[::-1], values[::-1]), columns)
        assert (table.find(keys) == values).all()
        assert not table.find(rng.integers(0, 2**64, 1000, dtype=np.uint64)).any()


@pytest.mark.parametrize(("hot", "gather"), [(0.0, 50), (1e9, 200), (0.25, 4_000_000)])
def test_kneser_ney_split_words(spark, monkeypatch, hot, gather):
    # The same scores whichever words are dealt further, and however many tokens a task gathers.
    monkeypatch.setattr(kneser_ney, "HOT", hot)
    monkeypatch.setattr(kneser_ney, "GATHER", gather)
    texts = [" ".join(f"w{(i * j) % 7}" for j in range(i % 11)) for i in range(60)]
    frame = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean").repartition(3)
    p, _ = plain_kneser_ney([[*t.split(), "</s>"] for t in texts], 3)
    for r in kneser_ney.score(frame, kneser_ney.train(frame, 3)).collect():
        w = ["<s>", *texts[r.doc_id].split(), "</s>"]
        assert abs(r.score - sum(log10(p(w[i], w[:i])) for i in range(1, len(w)))) < 1e-9 * len(w)


@pytest.mark.parametrize("limits", [{}, {"SPLIT": 5, "SMALL": 2, "BROADCAST": 0}])
def test_jaccard_links(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ngram_join, name, value)
    rng = np.random.default_rng(3)
    texts = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(40)]
        for _ in range(9):
            w = list(base)
            for i in rng.choice(40, rng.integers(0, 4), replace=False):
                w[i] = f"r{rng.integers(0, 5)}"
            texts.append(" ".join(w))
    texts += [texts[0], texts[0], "", None, "a b"]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set()) for w in ((t or "").split() for t in texts)]
    links = lambda i: sum(j != i and bool(x) and 100 * len(x & sets[i]) >= 70 * len(x | sets[i]) for j, x in enumerate(sets))
    got = ngram_join.jaccard_links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=3, percent=70).collect()
    assert {r.doc_id: (r.n_shingles, r.n_links) for r in got} == {i: (len(x), links(i)) for i, x in enumerate(sets)}
    assert max(r.n_links for r in got) > 2


def test_keep_one_shared_ids(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(1, one, "a"), (1, two, "b"), (2, two + " end", "c"), (3, one + " end", "d"), (4, three, "e"), (4, three, "f"), (None, one, "g"), (None, one, "h"), (5, "", "i"), (6, None, "j")]
    got = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    # Id 1's texts stand for two groups, and each keeps one; equal rows of id 4 collapse.
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(1, one), (1, two), (4, three), (0, one), (0, one), (5, ""), (6, "")])
    unique = spark.createDataFrame([(1, one), (2, one + " end"), (3, two), (3, two), (None, one)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in ngram_join.keep_one(unique).collect()) == sorted([(1, one), (3, two), (0, one)])


def test_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 64))
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(100 + i, (x + rng.normal(size=64) * 0.02).tolist(), 0) for i, x in enumerate(v)] + [(200, v[0].tolist(), 0), (201, v[0].tolist(), 1), (202, None, 0), (203, [0.0] * 64, 0), (204, [float("nan")] * 64, 0), (205, [1.0, None], 0), (206, v[1].tolist(), None), (207, [], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in near_vectors.near_vectors(frame).collect()}
    for i in range(40):
        assert got[100 + i].component_id == i and got[i].n_links == (2 if i == 0 else 1)
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(201, 208))
    ints = kd_search.integer_vectors(frame)
    best = kd_search.top_k(ints, ints.where("vec_id % 100 = 0"), 3).toPandas()
    x = {r[0]: np.floor(1024 * np.array(r[1], float)) for r in rows if r[1] is not None and r[0] not in (204, 205)}
    for q, g in best.groupby("query_id"):
        want = sorted((-int(y[: len(x[q])] @ x[q][: len(y)]), i) for i, y in x.items() if i != q)[:3]
        assert [(-s, i) for s, i in zip(g.sort_values("rank").score, g.sort_values("rank").vec_id)] == want
    assert near_vectors.near_vectors(frame.where("false")).count() == 0


@pytest.mark.parametrize("limits", [{}, {"SHARD": 16, "QUERY_BLOCK": 4, "LEAF": 3}, {"SHARD": 5, "REGIONS": 4, "QUERY_BLOCK": 1}])
def test_top_k(spark, monkeypatch, limits):
    """Ties, repeated rows and queries, equal vectors in a crowd, short vectors, scores beyond 64 bits: as brute force has it."""
    for name, value in limits.items():
        monkeypatch.setattr(kd_search, name, value)
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.integers(-3, 4, 5).tolist(), "clash") for i in range(150)] + [(900 + i, [1, 1, 1, 1, 1], "clash") for i in range(60)] + [(100, [2, 0, 1], "x"), (0, rng.integers(-3, 4, 5).tolist(), "x"), (7, [9] * 5, "x"), (7, [9] * 5, "x")]
    frame = spark.createDataFrame(rows, "vec_id long, v array<long>, rank string")
    asked = spark.createDataFrame([r for r in rows if r[0] % 100 == 0] * 2 + [(33, [], "x")], "vec_id long, v array<long>, rank string")
    first = {}
    for i, v, _ in sorted([r for r in rows if r[0] % 100 == 0] + [(33, [], "x")], key=lambda r: (r[0], r[1])):
        first.setdefault(i, v)
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {q: sorted(((-score(v, w), i) for i, w, _ in rows if i != q))[:10] for q, v in first.items()}
    got = {}
    for r in sorted(kd_search.top_k(frame, asked).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert got == want
    assert kd_search.top_k(frame.where("false"), asked).count() == kd_search.top_k(frame, asked.where("false")).count() == 0
    far = spark.createDataFrame([(0, [2**62, 2**62]), (1, [2**62, 2**62]), (2, [-(2**62), 5]), (3, [1, 2**53 + 1])], "vec_id long, v array<long>")
    assert [(r.vec_id, r.score) for r in sorted(kd_search.top_k(far, far.where("vec_id = 0")).collect(), key=lambda r: r["rank"])] == [(1, 2**63 - 1), (3, 2**63 - 1), (2, -(2**63))]


@pytest.mark.parametrize("dim", [2, 3, 8, 12, 16, 32, 64])
def test_near_vectors_recall(spark, dim):
    """Of pairs at a cosine just above the threshold, beside vectors of their kind: the share that is found."""
    rng = np.random.default_rng(dim)
    v = rng.normal(size=(1500 if dim > 8 else 300, dim)) * np.linspace(2, 0.5, dim)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    w = rng.normal(size=v.shape)
    w -= (w * v).sum(axis=1, keepdims=True) * v
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    cos = rng.uniform(0.9801, 0.985, (len(v), 1))
    rows = [(i, x.tolist(), 0) for i, x in enumerate(np.concatenate([v, cos * v + np.sqrt(1 - cos**2) * w]))]
    x = np.array([r[1] for r in rows])
    near = np.argwhere(np.triu(x @ x.T >= 0.98, 1))
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).toPandas()
    assert len(near) >= len(v) and 2 * len(near) >= got.n_links.sum() >= 2 * 0.95 * len(near)


def test_near_vectors_hamming():
    """Codes of pairs at the threshold are near, those of unrelated vectors far: only near rows are sent on with their vectors."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(4000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    w = rng.normal(size=v.shape)
    w -= (w * v).sum(axis=1, keepdims=True) * v
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    model = near_vectors.learn(v, 4)
    a, b = near_vectors.codes(model, v), near_vectors.codes(model, 0.98 * v + np.sqrt(1 - 0.98**2) * w)
    limit = near_vectors.far(256, 0.98)
    away = np.bitwise_count(a ^ b).sum(axis=1)
    assert a.shape == (4000, 4) and (away <= limit).mean() > 0.999 and (np.bitwise_count(a ^ np.roll(a, 1, axis=0)).sum(axis=1) > limit).all()
    assert near_vectors.chunks(a, 64, 16).shape == (4000, 16) and near_vectors.chunks(a, 64, 24).shape == (4000, 8)
    words = np.concatenate([a[:300], b[:20]])
    # every row in one bucket of the first table: the twenty pairs' rows stay
    x = {"block": np.zeros(320, np.int64), "lo": [0], "hi": [0], "t": [0], "codes": np.zeros((320, 1), np.int32), "words": words}
    assert set(np.flatnonzero(near_vectors._near(x, limit, 64)).tolist()) == {*range(20), *range(300, 320)}


def test_near_vectors_blocks(spark, monkeypatch):
    """Buckets in blocks and tiles of a few rows give the links of one comparison; repeated ids and clashing columns."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3, 32))
    # three crowds, each a fourth of the rows: no bit may be cut through one
    rows = [(i, (base[i % 3] + rng.normal(size=32) * 0.02 if i < 240 else rng.normal(size=32)).tolist(), i % 2, "c") for i in range(320)]
    rows += [(0, rows[5][1], 0, "c"), (0, rows[5][1], 1, "c"), (9, rows[9][1], 1, "c"), (500, rows[9][1], 1, "c")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, links string")
    plain = sorted(map(str, near_vectors.near_vectors(frame).collect()))
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    linked = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    low = np.arange(len(rows))
    for _ in range(len(rows)):
        low = np.where(linked, low[None, :], len(rows)).min(axis=1)
    least = {c: min(rows[i][0] for i in np.flatnonzero(low == c)) for c in set(low.tolist())}
    want = sorted((rows[i][0], int(linked[i].sum()) - 1, least[int(low[i])]) for i in range(len(rows)))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors.near_vectors(frame).collect()) == want
    monkeypatch.setattr(near_vectors, "BLOCK", 7)
    monkeypatch.setattr(near_vectors, "TILE", 3)
    assert sorted(map(str, near_vectors.near_vectors(frame).collect())) == plain
    assert near_vectors.plan(1000, 64) == (4, 16) and near_vectors.plan(1000, 16)[0] == 16 and near_vectors.plan(10**9, 64)[1] == 24 and near_vectors.plan(10, 2)[1] == 2


def test_warc(spark):
    long = "x<p>" * 700_000
    rows = [(1, "http://a/ b", "é" * 200), (2, None, "é" * 200), (None, "u", "é" * 200), (3, "u", None), (4, "u", "short"), (5, "u", "short"), (6, "u", long), (7, "u", long), (6, "u", long)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, first int")
    manifest = warc.write_archives(pages)
    back = warc.read_archives(manifest).collect()
    assert len(back) == len(rows) and Counter((r.page_id, r.record_type, r.refers_to) for r in back) == Counter({(1, "response", None): 1, (2, "revisit", 1): 1, (None, "revisit", 1): 1, (3, "response", None): 1, (4, "response", None): 1, (5, "response", None): 1, (6, "response", None): 2, (7, "revisit", 6): 1})
    one = {r.page_id: r for r in back}
    assert one[1].payload == "é" * 200 and one[1].url == "http://a/ b" and one[2].payload_bytes == 400 and one[6].payload == long and one[7].payload_bytes == len(long)
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(b"WARC/1.1\r\nWARC-Block-Digest: sha1:x\r\nContent-Length: 1\r\n\r\na\r\n\r\n")


@pytest.mark.parametrize(("broadcast", "size"), [(0, 1 << 20), (100, 1 << 20), (100, 10)])
def test_warc_archives(spark, monkeypatch, broadcast, size):
    """Every record has the headers that the format asks for; archives end at a size; the list of revisits is broadcast or not, by its rows and bytes."""
    monkeypatch.setattr(warc, "BROADCAST", broadcast)
    monkeypatch.setattr(warc, "BROADCAST_BYTES", size)
    rows = [(i, f"http://h/{i}", "same" * 100 if i % 2 else f"page {i}" * 50) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    paths = [r.path for r in warc.write_archives(pages, roll=1500).collect()]
    assert len(paths) > 4
    ids, n = set(), 0
    for path in paths:
        fs, at = warc.file_system(path)
        with fs.open_input_stream(at, compression=None) as raw:
            for _, data in warc.read_members(raw):
                h, block = warc.parse_record(data)
                assert {"warc-type", "warc-record-id", "warc-date", "content-length"} <= h.keys() and h["warc-date"].endswith("Z")
                ids.add(h["warc-record-id"])
                n += 1
                if h["warc-type"] == "revisit":
                    assert h["warc-refers-to-target-uri"] == "http://h/1" and h["x-refers-to-page-id"] == "1" and h["warc-refers-to-date"] == h["warc-date"]
    assert len(ids) == n == 40 + len(paths)


def test_empty_tables(docs, spark):
    none = docs.where("false")
    assert pii.redact(none).count() == bpe.encode(none).count() == bpe.round_trip(none).count() == ngram_join.jaccard_components(none).count() == mixing.remix(none).count() == 0
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_buckets_of_one_group_are_one(spark):
    """The counts compare a group's classes once, however many shingles they share, at each one's least place."""
    from tallyfold.llm.ngram_join import _once_a_group

    rows = [(k, r, r, 10 * r, (k + r) % 5) for k in range(9) for r in (1, 2)] + [(20, r, r, 10 * r, 4) for r in (1, 2, 3)] + [(30, 4, 4, 40, 0)]
    got = _once_a_group(spark.createDataFrame(rows, "key long, rep long, comp long, n long, pos int")).collect()
    groups = {k: sorted((r.rep, r.comp, r.n, r.pos, r.size) for r in got if r.key == k) for k in {r.key for r in got}}
    assert sorted(groups.values()) == [[(1, 1, 10, 0, 2), (2, 2, 20, 0, 2)], [(1, 1, 10, 4, 3), (2, 2, 20, 4, 3), (3, 3, 30, 4, 3)]]
