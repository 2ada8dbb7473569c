"""Quality classifier: random Fourier features of document statistics, ridge by normal equations, isotonic calibration.

Statistics are computed once over all whole texts and stored narrow. Labelled
training rows are dealt to a fixed number of partitions, each of which sums
its own normal equations; the sums meet on the driver, whose size depends on
the number of features alone. Calibration pools a fixed grid of score bins.

Edge cases: null and empty texts have all-zero statistics and get a score like
any other; null labels teach nothing; a repeated label counts each time; with
no usable label, or labels of one value, every score is that value (0.5 with
none); null ids are scored and never held out; further columns stay out of the
score.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import held_out, release_memory, small_batches, stored, table

#: Training rows at most, the smallest by a hash of their id; far more than the ridge needs.
MAX_TRAINING_ROWS = 1_000_000
FEATURES, RIDGE, WIDTH, BINS, SEED, PARTS = 256, 1e-3, 4.0, 1024, 11, 24

STATS = (
    "log_bytes log_words mean_word long_words short_words upper digit space punct symbol bang pipe hash brace high "
    "upper_words distinct_words top_word symbol_end log_lines repeated_lines mean_line entropy letters_start"
).split()
_SYMBOLS = b"$%&*#@^~=_<>{}[]\\/+"


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """For each byte value, membership in the counted classes."""
    out = np.zeros((256, 10))
    for i, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n", b".,;:'\"-()", _SYMBOLS, b"!?", b"|", b"#*", b"{}[]<>")):
        out[list(chars), i] = 1
    out[128:, 9] = 1
    return out


def text_stats(text: bytes) -> list[float]:
    """The statistics of one whole text, in the order of STATS."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * len(STATS)
    byte = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    share = byte @ _classes() / n
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    m = len(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=m)
    lines = text.split(b"\n")
    p = byte[byte > 0] / n
    upper = sum(map(bytes.isupper, words)) / m
    ends = sum(w[-1] in b"$%&*#@!|" for w in words) / m
    start = sum(w[:1].isalpha() for w in words) / m
    return [
        math.log1p(n), math.log1p(m), float(sizes.mean()), float((sizes > 14).mean()), float((sizes < 4).mean()), *share.tolist(),
        upper, len(seen) / m, max(seen.values()) / m, ends, math.log1p(len(lines)), 1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)), float(-(p * np.log2(p)).sum()), start,
    ]


def document_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, stats array<double>) of every row."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            stats = np.array([text_stats((t or "").encode()) for t in b.column("text").to_pylist()]).reshape(-1, len(STATS))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(stats) + 1, dtype=np.int32) * len(STATS)), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), lists], names=["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, stats array<double>")


def _matrix(column) -> np.ndarray:
    flat = column.flatten() if hasattr(column, "flatten") else column
    return np.asarray(flat, dtype=float).reshape(len(column), len(STATS))


class Model:
    """Standardization, feature map, ridge weights and calibration steps; picklable."""

    def __init__(self, mean, scale):
        self.mean, self.scale = mean, scale
        rng = np.random.default_rng(SEED)
        self.turn = rng.normal(size=(len(STATS), FEATURES)) / WIDTH
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.low, self.high, self.steps = 0.0, 1.0, None
        self.constant = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.turn + self.phase) * math.sqrt(2 / FEATURES)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def bins(self, raw: np.ndarray) -> np.ndarray:
        return np.clip((raw - self.low) / (self.high - self.low) * BINS, 0, BINS - 1).astype(int)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(stats), self.constant)
        return self.steps[self.bins(self.raw(stats))]


def pool_adjacent(total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The isotonic fit of total / weight by weight; empty bins take the line between their neighbours."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(weight):
        blocks.append([total[i], weight[i], i, i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, w, _, last = blocks.pop()
            blocks[-1][0] += t
            blocks[-1][1] += w
            blocks[-1][3] = last
    x = [k for b in blocks for k in (b[2], b[3])]
    y = [b[0] / b[1] for b in blocks for _ in range(2)]
    return np.interp(np.arange(len(total)), x, y)


def _sums(rows: DataFrame, per_part, width: int) -> np.ndarray:
    """The sum over partitions of per_part(stats, label) -> vector of `width`."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(width)
        for b in batches:
            if b.num_rows:
                total += per_part(_matrix(b.column("stats")), np.asarray(b.column("label"), dtype=float))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    parts = rows.mapInArrow(run, "v binary").collect()  # PARTS rows of fixed size
    return np.sum([np.frombuffer(p.v) for p in parts], axis=0) if parts else np.zeros(width)


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Fit on stats (doc_id, stats) joined with labels (doc_id, label 0/1): four fifths for the ridge, the rest for calibration."""
    h = F.xxhash64("doc_id", F.lit(SEED))
    train = labels.where("label in (0, 1) and doc_id is not null").select("doc_id", F.col("label").cast("double").alias("label"))
    n = train.count()
    if n > MAX_TRAINING_ROWS:
        part = h.bitwiseAND(F.lit((1 << 62) - 1))
        train = train.where(part < int((1 << 62) * min(1.0, 1.1 * MAX_TRAINING_ROWS / n + 1e-3))).orderBy(part, "doc_id", "label").limit(MAX_TRAINING_ROWS)
    train = stored(stats.join(train, "doc_id").withColumn("fold", F.pmod(h, F.lit(5))).repartition(PARTS), "quality-train")
    d = len(STATS)
    s = _sums(train, lambda x, y: np.concatenate([x.sum(0), (x * x).sum(0), [len(x), y.sum()]]), 2 * d + 2)
    n, ones = s[-2], s[-1]
    mean = s[:d] / max(n, 1)
    model = Model(mean, np.sqrt(np.maximum(s[d : 2 * d] / max(n, 1) - mean**2, 1e-8)))
    if n == 0 or ones in (0, n):
        model.constant = 0.5 if n == 0 else float(ones / n)
        return model
    m = FEATURES + 1

    def normal(x, y):
        z = model.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y, [y.size]])

    a = _sums(train.where("fold > 0"), normal, m * m + m + 1)
    k = max(a[-1], 1)
    model.weights = np.linalg.solve(a[: m * m].reshape(m, m) / k + RIDGE * np.eye(m) * np.append(np.ones(m - 1), 0) + 1e-9 * np.eye(m), a[m * m : -1] / k)
    model.low, model.high = -0.5, 1.5

    def binned(x, y):
        b = model.bins(model.raw(x))
        return np.concatenate([np.bincount(b, y, BINS), np.bincount(b, minlength=BINS)])

    c = _sums(train.where("fold = 0"), binned, 2 * BINS)
    if not c[BINS:].any():
        c = _sums(train, binned, 2 * BINS)
    model.steps = np.clip(pool_adjacent(c[:BINS], c[BINS:]), 0, 1)
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score double, predicted int) of every row of (doc_id, stats)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            s = model.score(_matrix(b.column("stats"))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, score double, predicted int")


def train_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from: not held out."""
    return labels.where(~held_out(F.col("doc_id"), 3)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    stats = stored(document_stats(table(spark, sf_dir, "documents")), "quality-stats")
    scored = score(stats, fit(stats, train_labels(table(spark, sf_dir, "labels"))))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those the classifier rejects; texts are scored where they lie, so no text is shuffled."""
    small_batches(docs.sparkSession)
    model = fit(stored(document_stats(docs), "quality-stats"), train_labels(labels))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            stats = np.array([text_stats((t or "").encode()) for t in b.column("text").to_pylist()]).reshape(-1, len(STATS))
            yield b.filter(pa.array(model.score(stats) >= 0.5))
        release_memory()

    return docs.mapInArrow(run, docs.schema)


QUERIES = {"op4_quality": op4_quality}
ORACLES = {}
