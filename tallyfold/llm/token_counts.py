"""Token counts by a map-side lookup in two tiers: a broadcast table of frequent pre-tokens, and a cache in each worker.

The first tier is learnt once from a bounded sample: its most frequent
pre-tokens with their numbers of tokens, one string of bytes and two byte
arrays, at most FREQUENT entries of at most LONGEST bytes, so what is broadcast
doesn't grow with the data. A task splits its texts, looks every pre-token up
and encodes only those that neither the table nor its worker's cache knows. The
table and the cache save work and decide nothing: each count is what encoding the
whole text gives. Nothing is shuffled; one scan reads the text once.

Edge cases: a null or empty text has no bytes and no tokens; an added token's
string inside a text is one token, as in the tokenizers library; repeated rows
and null ids are counted each; an empty table stays empty; further columns
stay, except ones named like the outputs, which are replaced. Texts are counted
whole: a very long one is split piece by piece, never held as a list, and its
longest pre-token must fit in memory.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.llm import bpe
from tallyfold.llm.common import release_memory, small_batches, table

#: Entries of the broadcast table, and the most bytes of a pre-token in it or in a cache.
FREQUENT, LONGEST = 32_768, 64
#: The sample that the table is learnt from: at most so many files, about so many rows, in so many tasks.
SAMPLE_FILES, SAMPLE_ROWS, SAMPLE_TASKS = 32, 20_000, 8
#: Pre-tokens that a worker's cache holds beside the table, characters from which a text is long, pre-tokens of a long text held at once, characters of a pre-token that the index encodes.
CACHE, CHUNK_CHARS, PIECES, LONG_PIECE = 1_000_000, 4_000_000, 500_000, 2_000
#: Tokens from which a document is over the limit.
LIMIT = 1024


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(bpe.PRE_TOKENS)


def _pieces(model: bpe.ByteBPE, text: str) -> Iterator[list]:
    """The pre-tokens and added tokens of a text, in lists of bounded length."""
    if len(text) <= CHUNK_CHARS:
        yield model.pieces(text)
        return
    at, ends = 0, [m.span() for m in model.special.finditer(text)] if model.special else []
    for a, b in [*ends, (len(text), len(text))]:
        found = (m[0] for m in _pattern().finditer(text[at:a]))
        while part := list(islice(found, PIECES)):
            yield part
        if b > a:
            yield [("added", text[a:b])]
        at = b


def _encoder(model: bpe.ByteBPE):
    """The number of tokens of one pre-token: by tiktoken's merge loop where the vocabulary's ids are in merge order, by the index elsewhere and for a very long one."""
    one = lambda piece: len(model.encode_distinct([piece.encode()])[0])
    if (np.diff(model.result) <= 0).any() or not len(model.result) or model.result[0] < 256:
        return one
    import tiktoken

    added = set(model.added.values())
    fast = tiktoken.Encoding("tallyfold", pat_str=r"[\s\S]+", mergeable_ranks={b: i for i, b in model.bytes.items() if i not in added}, special_tokens={}).encode_ordinary
    return lambda piece: len(fast(piece)) if len(piece) <= LONG_PIECE else one(piece)


class Lengths(dict):
    """Numbers of tokens by pre-token: the frequent ones for good, and as this worker's cache those met since, while there is room."""

    def __init__(self, path: str, frequent: dict[str, int]):
        super().__init__(frequent)
        self.model, self.frequent, self.misses = bpe.load(path), frequent, 0
        self.encode = _encoder(self.model)

    def __missing__(self, piece) -> int:
        self.misses += 1
        if isinstance(piece, tuple):  # an added token
            return 1
        n = self.encode(piece)
        if len(piece) <= LONGEST:
            if len(self) >= len(self.frequent) + CACHE:
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        return sum(sum(map(self.__getitem__, part)) for part in _pieces(self.model, text))


def _top(path: str):
    """Of texts: the task's most frequent pre-tokens with their counts."""

    def run(batches):
        import pyarrow as pa

        model, seen = bpe.load(path), Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                for part in _pieces(model, text or ""):
                    seen.update(p for p in part if len(p) <= LONGEST and not isinstance(p, tuple))
            if len(seen) > 8 * FREQUENT:
                seen = Counter(dict(seen.most_common(4 * FREQUENT)))
        best = seen.most_common(FREQUENT)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], names=["piece", "n"])

    return run


def sample(docs: DataFrame) -> DataFrame:
    """About SAMPLE_ROWS texts from at most SAMPLE_FILES of the files behind docs, spread over all of them."""
    files = sorted(docs.inputFiles())
    if len(files) > SAMPLE_FILES:
        docs = docs.sparkSession.read.schema(docs.schema).parquet(*(files[i * len(files) // SAMPLE_FILES] for i in range(SAMPLE_FILES)))
    rows = docs.count()  # of a table, from its files' footers
    return docs.select("text") if rows <= SAMPLE_ROWS else docs.select("text").sample(SAMPLE_ROWS / rows, seed=11)


def frequent_lengths(texts: DataFrame, path: str | None = None) -> tuple[bytes, bytes, bytes]:
    """The first tier, from a bounded frame of `text`: pre-tokens end to end, their sizes in bytes and their numbers of tokens.

    At most SAMPLE_TASKS tasks count and each returns FREQUENT rows or fewer.
    """
    path = path or bpe.default_tokenizer()
    small_batches(texts.sparkSession)
    got = texts.coalesce(SAMPLE_TASKS).mapInArrow(_top(path), "piece string, n long").toArrow()
    seen: Counter = Counter()
    for piece, n in zip(got.column("piece").to_pylist(), got.column("n").to_pylist()):
        seen[piece] += n
    best = [p.encode() for p, n in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if n > 1][:FREQUENT]
    best = [p for p in best if len(p) <= LONGEST]
    return b"".join(best), bytes(map(len, best)), bytes(map(len, bpe.load(path).encode_distinct(best)))


def _opened(tier: tuple[bytes, bytes, bytes]) -> dict[str, int]:
    blob, sizes, lengths = tier
    end = np.cumsum(np.frombuffer(sizes, np.uint8), dtype=np.int64).tolist()
    return {blob[a:b].decode(): n for a, b, n in zip([0, *end], end, lengths)}


#: The worker's own tables, by tokenizer and broadcast: a worker that runs several tasks keeps its cache.
_WORKER: dict = {}


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text", limit: int = LIMIT, learn_from: DataFrame | None = None, keep_text: bool = True) -> DataFrame:
    """docs, with or without the text, and n_bytes, n_tokens and over_limit; learn_from: a bounded frame of `text` for the first tier (default: SAMPLE_ROWS rows of docs)."""
    path = path or bpe.default_tokenizer()
    if learn_from is None:
        learn_from = docs.select(docs[text].alias("text")).limit(SAMPLE_ROWS)
    tier = docs.sparkSession.sparkContext.broadcast(frequent_lengths(learn_from, path))
    name = (path, uuid.uuid4().hex)
    added = {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType()}
    out = T.StructType([f for f in docs.schema.fields if f.name.lower() not in added and (keep_text or f.name != text)] + [T.StructField(k, v) for k, v in added.items()])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        if name not in _WORKER:
            _WORKER.clear()
            _WORKER[name] = Lengths(path, _opened(tier.value))
        count = _WORKER[name].count
        for b in batches:
            texts = b.column(text)
            n = pa.array([count(x or "") for x in texts.to_pylist()], pa.int64())
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            mine = {"n_bytes": size, "n_tokens": n, "over_limit": pc.greater(n, limit)}
            yield pa.RecordBatch.from_arrays([mine[f.name] if f.name in mine else b.column(f.name) for f in out], names=out.names)
        release_memory()

    small_batches(docs.sparkSession)
    return docs.drop(*(c for c in docs.columns if c.lower() in added and c != text)).mapInArrow(run, out)


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return count_tokens(ids, learn_from=sample(docs), keep_text=False)


QUERIES = {"op11_token_counts": op11_token_counts}
ORACLES = {}
