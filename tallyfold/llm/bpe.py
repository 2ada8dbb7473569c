"""Byte-level BPE by a pair occurrence index, and its inverse.

A partition's texts come in chunks. Their distinct pre-tokens are laid end to
end as one array of symbols; every adjacent pair with a rank is indexed under
that rank by its positions. Active ranks are taken in ascending order: all
positions of the rank that still hold its pair merge at once, and the pairs
that the merges create join the lists of their own ranks. A pair with a merged
symbol always ranks after the merge that made the symbol, so this order gives
the same result as merging each pre-token by itself.

Edge cases: a null or empty text has no tokens; an added token's string inside
a text is that token, as in the tokenizers library; repeated rows are encoded
each; an empty table stays empty; further columns stay, except ones named like
the outputs, which are replaced. Texts are encoded whole; a very long
pre-token is one long run of the array.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyfold.llm.common import release_memory, small_batches, table

#: Characters of text whose distinct pre-tokens are indexed together.
CHUNK_CHARS = 16_000_000

#: Byte-level pre-tokens. Words come first: no other branch but blanks can match where one begins.
PRE_TOKENS = r" ?\p{L}+| ?\p{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
#: The same over Latin-1, where the standard library's faster engine can express it.
LATIN_PRE_TOKENS = rf" ?[{_L}]+| ?[{_N}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(other)) for b in range(256)]


class ByteBPE:
    """Encoder and decoder for a tokenizers JSON file of the ByteLevel BPE kind."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        self.first = np.array([vocab[c] for c in letters], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.result = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        key = left << 32 | right
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]
        self.left, self.right = left, right
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.bytes |= {i: s.encode() for s, i in self.added.items()}
        self._any = regex.compile(PRE_TOKENS).findall
        self._latin = re.compile(LATIN_PRE_TOKENS).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._any(text)
        return self._latin(text)

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and added tokens of a text; an added token is a tuple."""
        if self.special is None or not any(s in text for s in self.added):
            return self.split(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.split(text[at : m.start()])
            out.append(("added", m[0]))
            at = m.end()
        return out + self.split(text[at:])

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def encode_distinct(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word, by the pair occurrence index over all of them."""
        if not words:
            return []
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        n = int(size.sum())
        end = np.cumsum(size)
        sym = np.full(n + 1, -1, dtype=np.int32)  # -1: swallowed by a merge, or the sentinel at n
        sym[:n] = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        nxt = np.arange(1, n + 2, dtype=np.int32)
        prv = np.arange(-1, n, dtype=np.int32)
        nxt[end[size > 0] - 1] = n
        prv[(end - size)[size > 0]] = n
        merged = np.zeros(n + 1, dtype=bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(pos: np.ndarray) -> None:
            """Put positions under the ranks of the pairs that begin there."""
            rank = self._ranks(sym[pos].astype(np.int64), sym[nxt[pos]].astype(np.int64))
            ranked = np.flatnonzero(rank >= 0)
            if not len(ranked):
                return
            rank = rank[ranked]
            by = np.argsort(rank, kind="stable")
            pos, rank = pos[ranked[by]], rank[by]
            cut = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
            for r, a, b in zip(rank[cut[:-1]].tolist(), cut, cut[1:]):
                if r in index:
                    index[r].append(pos[a:b])
                else:
                    index[r] = [pos[a:b]]
                    heapq.heappush(active, r)

        add(np.arange(n, dtype=np.int32))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            pos = lists[0] if len(lists) == 1 else np.concatenate(lists)
            pos = pos[(sym[pos] == self.left[r]) & (sym[nxt[pos]] == self.right[r])]
            if self.left[r] == self.right[r] and len(pos) > 1:
                # runs of one symbol: every other position of a run, from its start
                pos = np.sort(pos)
                start = np.concatenate([[True], prv[pos[1:]] != pos[:-1]])
                start = np.maximum.accumulate(np.where(start, np.arange(len(pos)), 0))
                pos = pos[(np.arange(len(pos)) - start) % 2 == 0]
            if not len(pos):
                continue
            gone = nxt[pos]
            after = nxt[gone]
            sym[pos] = self.result[r]
            sym[gone] = -1
            nxt[pos] = after
            prv[after] = pos  # the sentinel's is never read
            merged[pos] = True
            before = prv[pos]
            before = before[(before != n) & ~merged[before]]
            merged[pos] = False
            add(np.concatenate([before, pos[after != n]]))
        alive = np.flatnonzero(sym[:n] >= 0)
        counts = np.diff(np.searchsorted(alive, np.concatenate([[0], end])))
        ids, out, at = sym[alive].tolist(), [], 0
        for c in counts.tolist():
            out.append(ids[at : at + c])
            at += c
        return out

    def encode_chunk(self, texts: list[str], told=tuple) -> Iterator[list]:
        """For each text, told(token ids) of its pieces in order; each distinct piece of the chunk is encoded once."""
        number: dict = defaultdict(count().__next__)
        cut = [np.fromiter(map(number.__getitem__, self.pieces(t)), dtype=np.int32) for t in texts]
        plain = [p for p in number if not isinstance(p, tuple)]
        ids = iter(self.encode_distinct([p.encode() for p in plain]))
        found = [told([self.added[p[1]]] if isinstance(p, tuple) else next(ids)) for p in number]
        return (list(map(found.__getitem__, c.tolist())) for c in cut)

    def decode(self, ids) -> str:
        """The text of token ids; bytes that are not UTF-8 become replacement characters."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def _chunks(values: list[str]) -> Iterator[list[str]]:
    part, n = [], 0
    for v in values:
        part.append(v)
        n += len(v)
        if n >= CHUNK_CHARS:
            yield part
            part, n = [], 0
    if part:
        yield part


def _gathered(batches, text: str) -> Iterator[list]:
    """Runs of non-empty record batches with CHUNK_CHARS bytes of text or more together."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.column(text).nbytes
        if n >= CHUNK_CHARS:
            yield held
            held, n = [], 0
    if held:
        yield held


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """docs with `token_ids`: array<int>."""
    path = path or default_tokenizer()
    out = T.StructType([f for f in docs.schema.fields if f.name != "token_ids"] + [T.StructField("token_ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        import pyarrow as pa

        bpe = load(path)
        for held in _gathered(batches, text):
            texts = [x or "" for b in held for x in b.column(text).to_pylist()]
            ids = (np.fromiter((i for p in pieces for i in p), dtype=np.int32) for pieces in bpe.encode_chunk(texts))
            for b in held:
                own = [next(ids) for _ in range(b.num_rows)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own)))
                yield pa.RecordBatch.from_arrays([lists if f.name == "token_ids" else b.column(f.name) for f in out], names=out.names)
            del held, texts, ids, own, lists, b
            release_memory()

    small_batches(docs.sparkSession)
    return docs.drop("token_ids").mapInArrow(run, out)


def decode(docs: DataFrame, path: str | None = None, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """docs with the text of `ids` in a column."""
    path = path or default_tokenizer()
    out = T.StructType([f for f in docs.schema.fields if f.name != into] + [T.StructField(into, T.StringType())])

    def run(batches):
        import pyarrow as pa

        bpe = load(path)
        for b in batches:
            texts = pa.array([None if x is None else bpe.decode(x) for x in b.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if f.name == into else b.column(f.name) for f in out], names=out.names)

    return docs.drop(into).mapInArrow(run, out)


_DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode, decode and digest in one pass: what encode() and decode() give, without ids or texts leaving the worker.

    Digests are fed piece by piece from each distinct pre-token's ids, their
    decimal text and the bytes they decode to.
    """
    path = path or default_tokenizer()

    def run(batches):
        import pyarrow as pa

        bpe = load(path)
        told = lambda ids: (",".join(map(str, ids)), b"".join(map(bpe.bytes.__getitem__, ids)))
        for b in batches:
            rows = []
            for part in _chunks([x or "" for x in b.column("text").to_pylist()]):
                for pieces in bpe.encode_chunk(part, told):
                    ids = ",".join([x[0] for x in pieces]).encode()
                    back = b"".join([x[1] for x in pieces]).decode("utf-8", errors="replace")
                    rows.append((ids.count(b",") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
            n, i, d = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, _DIGEST)


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES = {"op7_bpe": op7_bpe}
ORACLES = {}
