"""Interpolated modified Kneser-Ney model of any order from two up: counted in Spark, kept as sorted hash arrays, memory-mapped by scorers.

Two passes over the training texts. The first counts words; each word gets a
number, smaller ones to words seen often. The second counts the distinct runs
of each task in numpy and sends them, as numbers packed column by column, to
buckets of their inner words: there meet all that precede and all that follow
an inner word, so a bucket has whole contexts and, of the next lower order,
whole counts of what precedes a run. Words seen very often are dealt further by
one more word of the run; what they give the lower order is then summed by
another shuffle. Buckets are written as arrays into the shared folder: hashes of
runs in order and counts, hashes of contexts with their totals. A scorer maps
them, looks up a batch's distinct words and runs, and never holds the model.
Counts cover every training row.

Keys are 64-bit hashes of word numbers. In a file their first bits are the
place in a directory, and the next 32 are kept: a run that isn't there is taken
for one that is with a chance of about 8 / 2^32, whatever the model's size.
Words keep all 64 bits. A text's history starts with one begin token; runs that
start there keep their plain counts at lower orders, as nothing precedes them.
A file is written under its task attempt's name and then takes its bucket's:
attempts of one bucket write the same, so a task that runs again does no harm.
Names follow from kind and bucket, and which buckets have a file is a bitmap in
the model; there is no list of files. A scorer holds at most POOL files open,
the ones used last, whatever the size of the model.

Edge cases: null and empty texts are one end token; a null id is a training
row; with no training rows every probability is that of one unknown word, 1;
repeated rows count each; an empty table gives no rows; further columns are not
read.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections import OrderedDict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import file_system, held_out, new_path, release_memory, table
from tallyfold.llm.hashing import mix, word_hashes

#: Tokens that a task gathers before it sorts them; so many are in memory at once.
GATHER = 2_000_000
_TEXT_BYTES = 4 << 20
END = mix(np.array([0x1F3D5B79A1C3E5F7], dtype=np.uint64))[0]
ORDER = 3
#: Numbers of the begin of a text and of a word that training didn't see.
BEGIN, UNKNOWN = np.uint32(0), np.uint32(2**32 - 1)
_MORE, _FIRST = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15)
#: Kinds of rows: RAW words, runs of n words as n (1: words by what precedes them), totals of words as CONTEXTS, and what is written of kind k as DONE + k.
RAW, CONTEXTS, DONE = 0, 50, 100
#: A word is dealt further when it has more than this share of a bucket's mean.
HOT = 0.25
#: Classes of words by the length of their count in bits.
_CLASSES = 64
#: Buckets of words, at most, in bits; files of the model that a worker has open at once.
WORD_BITS, POOL = 14, 64
#: Pairs that the order above holds whole, as a kind of files; the files' names by kind.
WHOLE = 51
_NAMES = {RAW: "words", CONTEXTS: "contexts", WHOLE: "whole-pairs"}
#: Keys for one entry of a file's directory, about, and values in its list of frequent ones.
_SLOT, _LISTED = 8, 254

_COUNTED = "kind int, bucket int, blob binary"
_REDUCED = "kind int, bucket int, blob binary, n long, total long, n1 long, n2 long, n3 long, n4 long, classes array<long>"


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct keys as steps of as few bytes as the largest needs, then counts; byte planes lie together so that they compress."""
    step = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    planes = step.view(np.uint8).reshape(-1, 8)[:, :width].T
    small = np.minimum(counts, 255).astype(np.uint8)
    large = counts[counts >= 255].astype(np.uint64)
    return bytes([width]) + len(keys).to_bytes(8, "little") + planes.tobytes() + small.tobytes() + large.tobytes()


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    width, n = blob[0], int.from_bytes(blob[1:9], "little")
    step = np.zeros((n, 8), dtype=np.uint8)
    step[:, :width] = np.frombuffer(blob, np.uint8, width * n, 9).reshape(width, n).T
    keys = np.cumsum(step.view(np.uint64).ravel(), dtype=np.uint64)
    counts = np.frombuffer(blob, np.uint8, n, 9 + width * n).astype(np.uint64)
    counts[counts == 255] = np.frombuffer(blob, np.uint64, -1, 9 + width * n + n)
    return keys, counts


def pack_rows(cols: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Rows of numbers with counts; a number that follows equal ones is kept as a step from the one above, so rows in order take little."""
    import pyarrow as pa

    same, planes = np.zeros(len(counts), dtype=bool), []
    same[1:] = True
    for i in _sorted_by(len(cols)):
        step = np.diff(cols[i], prepend=cols[i][:1])
        planes.append(np.where(same, step, cols[i]).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())
        same = same & (step == 0)
    raw = b"".join([*planes, np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts >= 255].astype(np.uint64).tobytes()])
    return len(counts).to_bytes(8, "little") + len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _starts(new: np.ndarray) -> np.ndarray:
    """Places where groups begin, from whether each row but the first differs from the one above."""
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _grouped(cols: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in the order of pack_rows(), the inner word first, and the sums of their counts (how many they are without)."""
    if not len(cols[0]):
        return cols, np.zeros(0, np.uint64)
    by = [cols[i] for i in _sorted_by(len(cols))]
    names, width = None, [int(c.max()).bit_length() for c in by]
    if sum(width) > 64:  # the first column has few values in a bucket
        names, by[0] = np.unique(by[0], return_inverse=True)
        width[0] = len(names).bit_length()
    if sum(width) <= 64:
        key = by[0].astype(np.uint64)
        for c, w in zip(by[1:], width[1:]):
            key = (key << np.uint64(w)) | c
        if counts is None:
            key.sort()
        else:
            order = np.argsort(key)
            key, counts = key[order], counts[order]
        first = _starts(key[1:] != key[:-1])
        size, key, out = len(key), key[first], []
        for w in reversed(width[1:]):
            out.append((key & np.uint64((1 << w) - 1)).astype(np.uint32))
            key = key >> np.uint64(w)
        out.append(key.astype(np.uint32) if names is None else names[key.astype(np.int64)])
        out = out[::-1]
    else:
        order = np.lexsort(by[::-1])
        by = [c[order] for c in by]
        counts = counts[order] if counts is not None else None
        first = _starts(np.logical_or.reduce([c[1:] != c[:-1] for c in by]))
        size, out = len(order), [c[first] for c in by]
        if names is not None:
            out[0] = names[out[0]]
    sums = np.diff(np.append(first, size)).astype(np.uint64) if counts is None else np.add.reduceat(counts, first)
    back = [np.zeros(0, np.uint32)] * len(cols)
    for i, c in zip(_sorted_by(len(cols)), out):
        back[i] = c.astype(np.uint32)
    return back, sums


def _sorted_by(columns: int) -> list[int]:
    return [1, 0, *range(2, columns)] if columns > 2 else list(range(columns))


def unpack_rows(blob: bytes, columns: int) -> tuple[list[np.ndarray], np.ndarray]:
    import pyarrow as pa

    n, size = (int.from_bytes(blob[i : i + 8], "little") for i in (0, 8))
    raw = pa.Codec("zstd").decompress(blob[16:], size, asbytes=True)
    out, same = [np.zeros(0, np.uint32)] * columns, np.arange(n) > 0
    for k, i in enumerate(_sorted_by(columns)):
        x = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 4 * n * k).reshape(4, n).T).view("<u4").ravel().astype(np.uint32)
        start = np.maximum.accumulate(np.where(same, 0, np.arange(n))) if n else np.zeros(0, int)
        total = np.cumsum(x, dtype=np.uint32)
        out[i] = total - (total[start] - x[start])
        same = same & (x == 0)
    counts = np.frombuffer(raw, np.uint8, n, 4 * n * columns).astype(np.uint64)
    counts[counts == 255] = np.frombuffer(raw, np.uint64, -1, (4 * columns + 1) * n)
    return out, counts


def _merged(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    by = np.argsort(keys)
    keys, counts = keys[by], counts[by]
    first = _starts(keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, one after another, and how many tokens each text has."""
    h, n = word_hashes(texts)
    return np.insert(h, np.cumsum(n), END), n + 1


def chain(cols: list[np.ndarray]) -> np.ndarray:
    """Hash of rows of word numbers."""
    out = mix(cols[0].astype(np.uint64) + _FIRST)
    for c in cols[1:]:
        out = mix(out * _MORE + c)
    return out


def runs(words: np.ndarray, n: np.ndarray, order: int):
    """(m, place of each token in its text, function of tokens to their m words' numbers, begin among them) for m from 2 to order."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
    for m in range(2, order + 1):
        yield m, place, lambda at, m=m: [np.where(place[at] >= back, words[at - back], BEGIN) for back in range(m - 1, -1, -1)]


def bucket_of(cols: list[np.ndarray], hot: int, bits: int) -> np.ndarray:
    """The bucket of runs: by their inner words, the first word of a pair; runs around a hot word by one more."""
    inner, more = (cols[1:-1], cols[0]) if len(cols) > 2 else (cols[:1], cols[1])
    h = chain(inner)
    split = inner[0] < hot
    h[split] = mix(h[split] * _MORE + more[split])
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _gathered(batches, columns=()):
    """(texts' tokens, tokens per text, other columns) of up to GATHER tokens at a time, hashed a few MB at once."""
    held, n, size, rest = [], [], 0, []

    for b in batches:
        texts = [(t or "").encode() for t in b.column("text").to_pylist()]
        other = list(zip(*(b.column(c).to_pylist() for c in columns))) if columns else [()] * len(texts)
        at = room = 0
        for i, t in enumerate(texts):
            room += len(t)
            if room < _TEXT_BYTES and i + 1 < len(texts):
                continue
            h, k = tokens(texts[at : i + 1])
            held.append(h)
            n.append(k)
            rest += other[at : i + 1]
            size += len(h)
            at, room = i + 1, 0
            if size >= GATHER:
                yield np.concatenate(held), np.concatenate(n), rest
                held, n, size, rest = [], [], 0, []
    if held:
        yield np.concatenate(held), np.concatenate(n), rest


def _sliced(keys: np.ndarray, bits: int):
    """(bucket, from, to) of sorted keys."""
    cut = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).tolist()
    return [(b, i, j) for b, (i, j) in enumerate(zip(cut, cut[1:])) if j > i]


def _dealt(kind: int, cols: list[np.ndarray], counts: np.ndarray, bucket: np.ndarray):
    """Rows (kind, bucket, blob) of runs, which stay in order within a bucket."""
    return [(kind, b, pack_rows([c[at] for c in cols], counts[at])) for b, at in _places(bucket)]


def _places(bucket: np.ndarray):
    """(bucket, places) of each bucket that has any."""
    if not len(bucket):
        return
    by = np.argsort(bucket.astype(np.uint16) if int(bucket.max()) < 1 << 16 else bucket, kind="stable")
    first = _starts(np.diff(bucket[by]) != 0).tolist()
    for i, j in zip(first, [*first[1:], len(by)]):
        yield int(bucket[by[i]]), by[i:j]


def _batch(rows):
    import pyarrow as pa

    kinds, buckets, blobs = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], names=["kind", "bucket", "blob"])


def _count_words(bits: int):
    def run(batches):
        for h, _, _ in _gathered(batches):
            k, c = _merged(h)
            yield _batch([(RAW, b, pack(k[i:j], c[i:j])) for b, i, j in _sliced(k, bits)])
        release_memory()

    return run


def _count_runs(model: dict):
    def run(batches):
        words, order = Words(model), model["order"]
        for h, n, _ in _gathered(batches):
            word, back = np.unique(h, return_inverse=True)
            numbers = words.find(word)[1][back]
            for m, place, of in runs(numbers, n, order):
                use = np.flatnonzero(place >= m - 2 if m == order else place == m - 2)
                cols = of(use)
                rows = [(m, b, pack_rows(*_grouped([c[at] for c in cols]))) for b, at in _places(bucket_of(cols, model["hot"], model["bits"]))]
                yield _batch(rows)
                del use, cols, rows
        release_memory()

    return run


def _file(folder: str, kind: int, bucket: int) -> str:
    return f"{folder}/{_NAMES.get(kind, f'runs{kind}')}-{bucket:07d}.bin"


def _write(path: str, arrays: list[np.ndarray]) -> None:
    """Write arrays one after another, each at a multiple of 8 bytes, after a list of their types and sizes."""
    fs, at = file_system(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], np.uint64)
    with fs.open_output_stream(at, compression=None) as f:
        for a in (head, *arrays):
            f.write(a.tobytes())
            f.write(b"\0" * (-a.nbytes % 8))


def _save(folder: str, kind: int, bucket: int, arrays: list[np.ndarray]) -> None:
    """Write a bucket's file: whole under another name first, as another attempt may write it too."""
    from pyspark import TaskContext

    path = _file(folder, kind, bucket)
    own = f"{path}-{TaskContext.get().taskAttemptId()}"
    _write(own, arrays)
    (fs, here), (_, there) = file_system(own), file_system(path)
    try:
        fs.move(here, there)
    except OSError:  # a store whose move doesn't replace: another attempt's file, the same, is there
        if not fs.get_file_info(there).is_file:
            raise
        fs.delete_file(here)


def _small(x: np.ndarray) -> list[np.ndarray]:
    """Counts as single bytes, and the places and values of those that don't fit."""
    wide = np.flatnonzero(x >= 255)
    return [np.minimum(x, 255).astype(np.uint8), wide.astype(np.uint64), x[wide].astype(np.uint64)]


def _shelf(keys: np.ndarray) -> list[np.ndarray]:
    """Sorted keys as a directory of their first bits and the 32 bits after these."""
    bits = max(0, (len(keys) // _SLOT).bit_length())
    slot = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    return [np.searchsorted(slot, np.arange((1 << bits) + 1)).astype(np.uint32), ((keys >> np.uint64(32 - bits)) & np.uint64(2**32 - 1)).astype(np.uint32)]


def _coded(keys: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    """A table as arrays: keys in order, a byte for each that names its values in a list of frequent ones, or 255 for those kept apart."""
    by = np.argsort(keys)
    keys, values = keys[by], values[by]
    if values.shape[1] == 1:
        listed, code = np.arange(1, _LISTED + 1, dtype=np.uint64)[:, None], np.minimum(values[:, 0] - 1, 255).astype(np.uint8)
        code[values[:, 0] > _LISTED] = 255
    else:
        plain = np.array([1, 1, 0, 0], np.uint64)  # most contexts: one run, seen once
        code = np.zeros(len(keys), np.uint8)
        other = np.flatnonzero((values != plain).any(axis=1))
        small = (values[other] < 1 << 16).all(axis=1)
        one = np.where(small, np.bitwise_or.reduce([values[other, i] << np.uint64(16 * i) for i in range(4)]), np.uint64(0))
        named, back, count = np.unique(one, return_inverse=True, return_counts=True)
        top = np.argsort(-np.where(named == 0, 0, count), kind="stable")[: _LISTED - 1]
        name = np.full(len(named), 255, np.uint8)
        name[top] = np.arange(1, len(top) + 1)
        name[named == 0] = 255
        code[other] = name[back]
        listed = np.vstack([plain, *([(named[top, None] >> (np.arange(4, dtype=np.uint64) * np.uint64(16))) & np.uint64(0xFFFF)] if len(top) else [])]).astype(np.uint64)
    apart = np.flatnonzero(code == 255)
    return [*_shelf(keys), code, listed.ravel(), apart.astype(np.uint64), values[apart].astype(np.uint64).ravel()]


class Table:
    """What _coded() made: values by key, zeros for keys that aren't there."""

    ARRAYS = 6

    def __init__(self, arrays: list[np.ndarray], columns: int):
        self.directory, self.rest, self.code, listed, self.apart, wide = arrays
        self.listed, self.wide, self.columns = listed.reshape(-1, columns).astype(float), wide.reshape(-1, columns), columns

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros((len(keys), self.columns))
        if not len(self.rest) or not len(keys):
            return out
        bits = (len(self.directory) - 2).bit_length()
        slot = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        want = ((keys >> np.uint64(32 - bits)) & np.uint64(2**32 - 1)).astype(np.uint32)
        low, high = self.directory[slot].astype(np.int64), self.directory[slot + 1].astype(np.int64)
        end, open_ = high.copy(), np.flatnonzero(low < high)
        while len(open_):  # halves of what is left of each slot
            a, b = low[open_], high[open_]
            middle = (a + b) >> 1
            less = self.rest[middle] < want[open_]
            low[open_], high[open_] = np.where(less, middle + 1, a), np.where(less, b, middle)
            open_ = open_[low[open_] < high[open_]]
        hit = np.flatnonzero((low < end) & (self.rest[np.minimum(low, len(self.rest) - 1)] == want))
        code = self.code[low[hit]]
        named = code < 255
        out[hit[named]] = self.listed[code[named]]
        if not named.all():
            out[hit[~named]] = self.wide[np.searchsorted(self.apart, low[hit[~named]].astype(np.uint64))]
        return out


def _row(kind, bucket, blob=None, counts=None, classes=None):
    c = counts if counts is not None else np.zeros(0, np.uint64)
    return (kind, bucket, blob, len(c), int(c.sum()), *(int((c == k).sum()) for k in (1, 2, 3, 4)), classes)


def _told(rows):
    import pyarrow as pa

    kinds = (pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 6, pa.list_(pa.int64()))
    names = [x.split()[0] for x in _REDUCED.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)


def _class_of(counts: np.ndarray) -> np.ndarray:
    """0 for the largest counts, one more for each bit less."""
    return _CLASSES - np.frexp(counts.astype(float))[1]


def _reduce_words(folder: str):
    def run(key, got):
        bucket = key[1].as_py()
        k, c = _merged(*(np.concatenate(x) for x in zip(*(unpack(b.as_py()) for b in got.column("blob")))))
        kind = _class_of(c)
        rank = np.empty(len(k), np.uint32)
        rank[np.argsort(kind, kind="stable")] = np.arange(len(k), dtype=np.uint32)
        _save(folder, RAW, bucket, [k, *_small(c), rank])
        return _told([_row(DONE + RAW, bucket, None, c, np.bincount(kind, minlength=_CLASSES + 1).tolist())])

    return run


def _totals(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of contexts whose runs lie together: their total, and runs seen once, twice and more often."""
    return np.stack([np.add.reduceat(x.astype(np.uint64), first) for x in (counts, counts == 1, counts == 2, counts >= 3)], axis=1)


def _reduce(model: dict, level: int):
    """Merge and save the buckets of one order, and send on the next lower order's counts; rows of other kinds pass."""
    folder, bits, hot = model["folder"], model["bits"], model["hot"]

    def pairs(a: np.ndarray, b: np.ndarray, c: np.ndarray, as_kind: int, bucket: int):
        """Save whole pairs of words, which lie in order; rows for the words that follow and, as contexts, for those that stand first."""
        if not len(a):
            return []
        _save(folder, as_kind, bucket, _coded(chain([a, b]), c[:, None]))
        first = _starts(a[1:] != a[:-1])
        sums, a = _totals(first, c), a[first]
        (b,), f = _grouped([b])
        deal = lambda x: (chain([x]) >> np.uint64(64 - bits)).astype(np.int64)
        sent = _dealt(1, [b], f, deal(b)) + _dealt(CONTEXTS, [a, *(sums[:, i].astype(np.uint32) for i in (1, 2, 3))], sums[:, 0], deal(a))
        return [_row(DONE + as_kind, bucket, None, c), *(_row(*r) for r in sent)]

    def run(key, got):
        kind, bucket = (x.as_py() for x in key)
        if kind != level and not (level == 1 and kind == CONTEXTS):
            return got
        parts = [unpack_rows(b.as_py(), {CONTEXTS: 4}.get(kind, kind)) for b in got.column("blob")]
        cols, c = [np.concatenate(x) for x in zip(*(p[0] for p in parts))], np.concatenate([p[1] for p in parts])
        del parts
        if kind == CONTEXTS:
            by = np.argsort(cols[0])
            word = cols[0][by]
            first = _starts(word[1:] != word[:-1])
            sums = np.stack([np.add.reduceat(x[by].astype(np.uint64), first) for x in (c, *cols[1:])], axis=1)
            _save(folder, CONTEXTS, bucket, _coded(chain([word[first]]), sums))
            return _told([_row(DONE + CONTEXTS, bucket)])
        cols, c = _grouped(cols, c)
        if kind == 1:
            _save(folder, 1, bucket, _coded(chain(cols), c[:, None]))
            return _told([_row(DONE + 1, bucket, None, c)])
        if kind == 2:
            return _told(pairs(cols[0], cols[1], c, 2, bucket))
        first = _starts(np.logical_or.reduce([x[1:] != x[:-1] for x in cols[:-1]]))
        context, sums = chain([x[first] for x in cols[:-1]]), _totals(first, c)
        _save(folder, kind, bucket, [*_coded(chain(cols), c[:, None]), *_coded(context, sums)])
        out = [_row(DONE + kind, bucket, None, c)]
        del context, sums, first
        lower, f = _grouped(cols[1:])
        whole = lower[0] >= hot if kind == 3 else np.zeros(len(f), dtype=bool)
        if whole.any():  # all that precedes these pairs is here
            out += pairs(lower[0][whole], lower[1][whole], f[whole], WHOLE, bucket)
        lower, f = [x[~whole] for x in lower], f[~whole]
        out += [_row(*r) for r in _dealt(kind - 1, lower, f, bucket_of(lower, hot, bits) if len(f) else np.zeros(0, np.int64))]
        del cols, lower
        release_memory()
        return _told(out)

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts of counts 1, 2, 3 and more; where counts of counts are missing, half a count less each."""
    if not (n1 and n2):
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2 if n2 else d1
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return min(max(d1, 0.05), 1.0), min(max(d2, 0.05), 2.0), min(max(d3, 0.05), 3.0)


def _summed(found: DataFrame) -> tuple[dict[int, dict], dict[int, bytes]]:
    """Of the rows of written files: each kind's totals, and a bitmap of its buckets; a few rows, each of 32,768 buckets."""
    at = F.col("bucket").cast("long") + 1
    sums = [F.sum(x).alias(x) for x in ("n", "total", "n1", "n2", "n3", "n4")]
    told = found.where(F.col("kind") >= DONE).groupBy("kind", F.bitmap_bucket_number(at).alias("part")).agg(*sums, F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("there"))
    totals: dict[int, dict] = {}
    there: dict[int, bytes] = {}
    for r in sorted(told.collect(), key=lambda r: (r.kind, r.part)):
        kind = r.kind - DONE
        own = totals.setdefault(kind, dict.fromkeys(("n", "total", "n1", "n2", "n3", "n4"), 0))
        for x in own:
            own[x] += r[x]
        before = there.get(kind, b"")
        there[kind] = before + bytes((r.part - 1) * 4096 - len(before)) + bytes(r.there)
    return totals, there


def train(docs: DataFrame, order: int = ORDER) -> dict:
    """Count all texts of docs; returns the model: totals, discounts, and in which folder and for which buckets its files are.

    Words have 32-bit numbers: a corpus of 2^32 - 2 distinct words or more raises.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    bits = max(4, (docs.rdd.getNumPartitions() - 1).bit_length() + 1)
    model = {"order": order, "bits": bits, "word_bits": min(bits, WORD_BITS), "folder": new_path(spark, "kneser-ney"), "there": {}}
    empty = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in _REDUCED.split(", ")[3:]]
    dealt = lambda rows: rows.groupBy("kind", "bucket")
    counted = dealt(docs.select("text").mapInArrow(_count_words(model["word_bits"]), _COUNTED)).applyInArrow(_reduce_words(model["folder"]), _REDUCED)
    words = counted.select("bucket", "n", "total", "classes").collect()  # at most 2^WORD_BITS rows of a few numbers
    model |= {"tokens": sum(f.total for f in words), "words": sum(f.n for f in words)}
    check_numbers(model["words"])
    classes = np.zeros((1 << model["word_bits"], _CLASSES + 1), np.int64)
    held = np.zeros(len(classes), bool)
    for f in words:
        classes[f.bucket], held[f.bucket] = f.classes, True
    model["there"][RAW] = np.packbits(held, bitorder="little").tobytes()
    before = np.cumsum(classes.T.ravel()) - classes.T.ravel()  # words of larger classes, then of buckets before
    model["numbers"] = f"{model['folder']}/numbers.bin"
    _write(model["numbers"], [(before.reshape(_CLASSES + 1, -1).T + 1).astype(np.uint64).ravel(), classes.astype(np.uint64).ravel()])
    often = _CLASSES - int(HOT * model["tokens"] / (1 << bits)).bit_length()
    model["hot"] = 1 + int(classes[:, : max(0, often)].sum())
    found = docs.select("text").mapInArrow(_count_runs(model), _COUNTED).select("*", *empty)
    for level in range(order, 0, -1):
        found = dealt(found).applyInArrow(_reduce(model, level), _REDUCED)
    totals, there = _summed(found)
    model["there"] |= there
    sums = lambda m, *names: [sum(totals.get(k, {}).get(x, 0) for k in ((2, WHOLE) if m == 2 else (m,))) for x in names]
    model["pairs"] = sums(1, "total")[0]
    model["d"] = {m: discounts(*sums(m, "n1", "n2", "n3", "n4")) for m in range(1, order + 1)}
    once, twice, n = sums(1, "n1", "n2", "n")
    d = model["d"][1]
    model["rest"] = (d[0] * once + d[1] * twice + d[2] * (n - once - twice)) / max(1, model["pairs"])
    return model


def check_numbers(words: int) -> None:
    """Word numbers are 32 bits, two of them taken."""
    if words >= 2**32 - 2:
        raise ValueError(f"{words} distinct words are more than 32-bit numbers hold")


@lru_cache(maxsize=1)
def _copies() -> str:
    folder = tempfile.mkdtemp(prefix="tallyfold-model-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def _mapped(path: str) -> list[np.ndarray]:
    """The arrays of a file, mapped; the map closes when none of them is used any more.

    A file in a store that can't be mapped is copied first; the copy's name is
    removed at once, so its disk is free again when the map closes.
    """
    from pyarrow import fs as F_

    fs, at = file_system(path)
    local = isinstance(fs, F_.LocalFileSystem)
    if not local:
        mine = f"{_copies()}/{at.rpartition('/')[2]}"
        F_.copy_files(at, mine, source_filesystem=fs, destination_filesystem=F_.LocalFileSystem())
        at = mine
    whole = np.memmap(at, dtype=np.uint8, mode="r")
    if not local:
        os.unlink(at)
    head = whole[: 8 * (1 + 2 * int(whole[:8].view(np.uint64)[0]))].view(np.uint64)[1:].tolist()
    out, pos = [], 8 * (1 + len(head))
    for item, n in zip(head[::2], head[1::2]):
        out.append(whole[pos : pos + item * n].view({1: np.uint8, 4: np.uint32, 8: np.uint64}[item]))
        pos += item * n + -item * n % 8
    return out


class _Files:
    """The tables of a model's files by kind and bucket; at most POOL are mapped, and the one not used for longest goes first."""

    def __init__(self, model: dict):
        self.model, self.open = model, OrderedDict()

    def _one(self, kind: int, bucket: int):
        there = self.model["there"].get(kind, b"")
        if bucket >> 3 >= len(there) or not there[bucket >> 3] >> (bucket & 7) & 1:
            return None
        if (kind, bucket) in self.open:
            self.open.move_to_end((kind, bucket))
        else:
            while len(self.open) >= POOL:
                self.open.popitem(last=False)
            self.open[kind, bucket] = _mapped(_file(self.model["folder"], kind, bucket))
        return self.open[kind, bucket]

    def of(self, kind: int, bucket: int):
        """The arrays of the bucket's files, one after another."""
        for k in (2, WHOLE) if kind == 2 else (kind,):
            found = self._one(k, bucket)
            if found is not None:
                yield found


class Words(_Files):
    """Counts and numbers of words."""

    def __init__(self, model: dict):
        super().__init__(model)
        self.numbers = None

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted distinct hashes: their count in training, and their number."""
        c, numbers = np.zeros(len(h)), np.full(len(h), UNKNOWN)
        if self.numbers is None:
            self.numbers = [x.reshape(-1, _CLASSES + 1) for x in _mapped(self.model["numbers"])]
        first, classes = self.numbers
        for b, i, j in _sliced(h, self.model["word_bits"]):
            for keys, small, places, values, rank in self.of(RAW, b):
                at = np.minimum(np.searchsorted(keys, h[i:j]), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == h[i:j])
                at = at[hit]
                count = small[at].astype(float)
                wide = np.flatnonzero(count == 255)
                if len(wide):
                    count[wide] = values[np.searchsorted(places, at[wide].astype(np.uint64))]
                before = np.cumsum(np.append(0, classes[b].astype(np.int64)))
                kind = np.searchsorted(before, rank[at], side="right") - 1
                c[i + hit] = count
                numbers[i + hit] = first[b].astype(np.int64)[kind] + rank[at] - before[kind]
        return c, numbers


def _per_count(d: tuple, c: np.ndarray) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3).astype(np.int64)]


class Scorer(_Files):
    def __init__(self, model: dict):
        super().__init__(model)
        self.known = Words(model)

    def values(self, kind: int, columns: int, bucket: np.ndarray, keys: np.ndarray, first: int = 0) -> np.ndarray:
        """Values of keys in their buckets' tables; a file's table that begins at its array `first`."""
        out = np.zeros((len(keys), columns))
        for b, at in _places(bucket):
            for arrays in self.of(kind, b):
                out[at] += Table(arrays[first : first + Table.ARRAYS], columns).find(keys[at])
        return out

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sorted distinct words: their count in training, their number, and their continuation probability."""
        m = self.model
        c, numbers = self.known.find(h)
        keys = chain([numbers])
        f = self.values(1, 1, (keys >> np.uint64(64 - m["bits"])).astype(np.int64), keys)[:, 0]
        p = np.maximum(f - _per_count(m["d"][1], f), 0) / max(1, m["pairs"])
        return c, numbers, p + (m["rest"] if m["pairs"] else 1.0) / (m["words"] + 1)

    def runs(self, cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of runs: the discounted share of the run in its context, and the context's weight of the lower order (1 if unseen)."""
        m, bits = len(cols), self.model["bits"]
        d, bucket = self.model["d"][m], bucket_of(cols, self.model["hot"], bits)
        count = self.values(m, 1, bucket, chain(cols))[:, 0]
        context = chain(cols[:-1])
        where = bucket if m > 2 else (context >> np.uint64(64 - bits)).astype(np.int64)
        sums = self.values(m if m > 2 else CONTEXTS, 4, where, context, Table.ARRAYS if m > 2 else 0)
        total = sums[:, 0]
        seen = np.maximum(total, 1)
        return np.maximum(count - _per_count(d, count), 0) / seen, np.where(total > 0, (sums[:, 1:] @ np.array(d)) / seen, 1.0)

    def score(self, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and model score (log10) of each text."""
        model = self.model
        start = np.cumsum(n) - n
        word, at = np.unique(h, return_inverse=True)
        c, numbers, low = self.words(word)
        base = np.log10((c + 0.5) / (model["tokens"] + 0.5 * (model["words"] + 1)))
        known = np.add.reduceat((c > 0).astype(np.int64)[at], start)
        base = np.add.reduceat(base[at], start)
        low, numbers = low[at], numbers[at]
        del word, at
        for m, place, of in runs(numbers, n, model["order"]):
            use = np.flatnonzero(place >= m - 2)
            p, g = self.runs(of(use))
            low[use] = p + g * low[use]
        return known, base, np.add.reduceat(np.log10(low), start)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of docs (doc_id, held_out, text); perplexity is 10 ** (-score / n_tokens)."""

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(model)
        for h, n, rest in _gathered(batches, ("doc_id", "held_out")):
            known, base, full = scorer.score(h, n)
            ids, held = zip(*rest)
            cols = [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(n), pa.array(known), pa.array(np.full(len(n), model["tokens"], np.int64)), pa.array(base), pa.array(full)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
            del h, n, rest, known, base, full, ids, held, cols
        release_memory()

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_kneser_ney(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out(F.col("doc_id"), 5))
    return score(docs, train(docs.where("not held_out")))


QUERIES = {"op10_kneser_ney": op10_kneser_ney}
ORACLES = {}
