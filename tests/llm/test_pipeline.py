"""The pipeline's rows, stage by stage, against plain versions of what each stage decides."""

from collections import Counter

import pytest
from brute_pii import base_spans
from pyspark.sql import functions as F

import corpus_pipeline
from tallyfold.llm import bpe, quality
from tallyfold.llm.common import held_out, stored, table

SF = "/root/testdata/sf0.001"
LOW = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first stage and after each."""
    docs = table(spark, SF, "documents")
    out = [("documents", docs.columns, docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs.columns, docs.collect()))
    return out


def words(text):
    return (text or "").encode().translate(LOW).split()


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_stage_names_and_columns(stages):
    assert [n for n, _, _ in stages] == ["documents", "quality", "near_duplicates", "pii", "mix", "encode"]
    assert all(columns == stages[0][1] for _, columns, _ in stages[1:-1])


def test_quality_keeps_what_its_operator_predicts(spark, stages):
    good = {r.doc_id for r in quality.op4_quality(spark, SF).where("predicted = 1").collect()}
    assert sorted(map(str, stages[1][2])) == sorted(str(r) for r in stages[0][2] if r.doc_id in good)


def test_quality_agrees_with_held_out_labels(spark):
    larger = "/root/testdata/sf0.01"
    kept = {r.doc_id for r in corpus_pipeline.keep_good(spark, table(spark, larger, "documents"), larger).select("doc_id").collect()}
    held = table(spark, larger, "labels").where(held_out(F.col("doc_id"), 3) & F.col("quality").isNotNull()).collect()
    assert sum((r.doc_id in kept) == (r.quality == 1) for r in held) > 0.95 * len(held)


def test_one_copy_of_each_group_stays(stages):
    before = stages[1][2]
    sets = {r.doc_id: shingles(r.text) for r in before}
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    assert sorted(map(str, stages[2][2])) == sorted(str(r) for r in before if root(r.doc_id) == r.doc_id)


def test_personal_data_goes_and_clean_texts_stay(stages):
    before, after = ({r.doc_id: r for r in rows} for _, _, rows in stages[2:4])
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert not base_spans(r.text) and r.n_chars == len(r.text or "")
        if base_spans(before[i].text):
            assert r.text != before[i].text
        elif "[" not in (r.text or ""):
            assert r.text == before[i].text


def test_mix_repeats_whole_rows_near_the_targets(stages):
    before, after = stages[3][2], stages[4][2]
    known = Counter(map(str, before))
    assert set(map(str, after)) <= set(known)
    assert max(Counter(map(str, after)).values()) <= 3
    size, taken = Counter(), Counter()
    for rows, into in ((before, size), (after, taken)):
        for r in rows:
            into[r.source] += len((r.text or "").encode().split())
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(size.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * size[s]}
        for s in full or open_:
            target[s] = 3.0 * size[s] if full else weight[s] * level
            left -= target[s]
        open_ -= full or set(open_)
    for s in order:
        assert abs(taken[s] - target[s]) <= 0.1 * target[s] + max(len(words(r.text)) for r in before if r.source == s) / 2


def test_encode_gives_the_tokenizers_ids(stages):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_tokenizer())
    want = Counter((r.doc_id, tuple(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in stages[4][2])
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in stages[5][2]) == want
    assert all(r.n_tokens == len(r.token_ids) for r in stages[5][2])


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, stages[5][2]))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows, shared ids and columns named like the stages' own."""
    folder = str(tmp_path_factory.mktemp("odd"))
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, None, "en", None, None), (3, long, "en", "a", 1), (3, long, "en", "a", 1), (4, long + " end", None, "b", 1), (5, "mail a@b.com now", "en", "b", 1), (5, "another text of id five", "en", "b", 1), (None, "mail a@b.com now", "en", None, 1)]
    rows += [(100 + i, f"plain words number {i} stand here and say little", "en", f"s{i % 3}", 1) for i in range(60)]
    names = "spans string, row string, row_ string, id string, copies string, size int, h int, least int, at int, unit int, _size int, _row int, component_id int, score double, decoded string"
    extra = [n.split()[0] for n in names.split(", ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.selectExpr("*", *[f"CAST({i} AS {n.split()[1]}) AS {n.split()[0]}" for i, n in enumerate(names.split(", "))]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(100 + i, None if i % 7 == 0 else 1, 0) for i in range(60)] + [(None, 1, None), (3, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, extra


def test_odd_documents_pass_every_stage(spark, odd):
    folder, rows, extra = odd
    docs = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, folder), f"odd-{name}")
        if name != "encode":
            assert docs.columns == before.columns
            assert all(docs.where(f"{c} <> {i} OR {c} IS NULL").isEmpty() for i, c in enumerate(extra))
        if name == "quality":  # every label is 1, so all stay
            assert docs.count() == len(rows)
        if name == "near_duplicates":  # one long text stays, and both texts of id 5, whose first equals one with a null id
            left = Counter((r.doc_id, (r.text or "")[:7]) for r in docs.collect())
            assert left[3, "w0 w1 w"] == 1 and left[4, "w0 w1 w"] == 0 and left[5, "mail a@"] == left[5, "another"] == 1 and left[None, ""] == left[None, "mail a@"] == 1
        if name == "pii":
            assert docs.where("text LIKE '%@%'").isEmpty() and docs.where("text = 'mail [EMAIL] now'").count() == 2
    assert docs.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids"] and docs.count() > 0


def test_pipeline_over_no_documents(spark, odd, tmp_path):
    for name in ("documents", "labels"):
        table(spark, odd[0], name).where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
