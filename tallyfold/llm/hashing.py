"""Hashes of words and of word runs, a batch of texts at a time in numpy.

Words are runs of bytes other than ASCII white space, with A-Z lowered. A
word's hash sums its lanes of eight bytes, each mixed with its place by a
bijection that isn't linear, so no word becomes a Python object and words of up
to eight bytes and of one length never share a hash.
"""

from __future__ import annotations

import numpy as np

_LOWER = bytes((32 if i in (9, 10, 11, 12, 13) else i + 32 if 65 <= i <= 90 else i) for i in range(256))
WINDOW = 1 << 20
_LANE, _PLACE, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher, a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of one buffer that begins and ends with a blank."""
    blank = buf == 32
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, size = edge[::2], edge[1::2] - edge[::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    wide = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=wide.data, strides=(1,))
    lanes = (size + 7) >> 3
    first = np.cumsum(lanes) - lanes
    many = len(start) < int(lanes.sum())
    place = np.arange(int(lanes.sum())) - np.repeat(first, lanes) if many else np.zeros(len(start), np.int64)
    at = (np.repeat(start, lanes) if many else start) + 8 * place
    left = np.minimum((np.repeat(size, lanes) if many else size) - 8 * place, 8)
    lane = eight[at] & (np.uint64(2**64 - 1) >> ((8 - left) << 3).astype(np.uint64))
    h = mix(lane * _LANE + (place + 1).astype(np.uint64) * _PLACE)
    if many:
        h = np.add.reduceat(h, first)
    return mix(h + size.astype(np.uint64) * _LENGTH), start


def word_hashes(texts: list[bytes], letters: bytes = _LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts one after another, and how many words each text has; letters: what each byte counts as, a blank between words.

    The buffer is hashed in windows that end at a blank, so memory beside the
    result is bounded by the window or by the longest word.
    """
    data = (b" " + b" ".join(texts) + b" ").translate(letters)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    first = 1 + np.concatenate([[0], np.cumsum(sizes)])
    hashes, starts, at = [], [], 0
    while at < len(data) - 1:
        to = len(data) - 1
        if to - at >= WINDOW:
            to = data.rfind(b" ", at + 1, at + WINDOW)
            if to < 0:
                to = data.find(b" ", at + WINDOW - 1)
        h, s = _words(np.frombuffer(data, dtype=np.uint8, count=to + 1 - at, offset=at))
        hashes.append(h)
        starts.append(s + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    where = np.searchsorted(np.concatenate(starts), first)
    return np.concatenate(hashes), np.diff(where)


_MULT = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)]


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of `size` words of each text; a shorter text is one shingle, an empty one has none."""
    h, counts = word_hashes(texts)
    n = max(0, len(h) - size + 1)
    run = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        run += mix(h[i : i + n] ^ _MULT[i % 6]) * _MULT[(i + 1) % 6] * np.uint64(2 * (i // 6) + 1)
    run = mix(run)
    out, at = [], 0
    for c in counts.tolist():
        if c >= size:
            s = np.sort(run[at : at + c - size + 1])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            out.append(s)
        elif c:
            w = h[at : at + c]
            one = np.uint64(0)
            with np.errstate(over="ignore"):
                for i in range(c):
                    one += mix(w[i : i + 1] ^ _MULT[i % 6])[0] * _MULT[(i + 2) % 6]
                one = mix(np.array([one ^ np.uint64(c)]))[0]
            out.append(np.array([one], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += c
    return out
