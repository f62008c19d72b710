"""Document quality by random Fourier features, ridge regression and isotonic calibration.

A text gives some thirty statistics (lengths, kinds of characters, words, repeated lines and words). Standardised, they
go through random Fourier features, which approximate a Gaussian kernel. Each partition sums its part of the normal
equations over all training labels; the sums meet in ever fewer tasks, and the driver solves one small system. Raw
scores are calibrated by isotonic regression over counts in score bins, with straight lines between its steps. Nothing
of a document but its text enters a score.

Null text counts as empty; an empty text has all statistics 0 and gets a score like any other. Rows come out one for
one. Labels that are null, or whose id is null or has no document, are not learned from; an id labelled twice counts
twice. Without any usable label every score is 0.5. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .shared import free_names, map_slices, materialize
from .textops import Words, crc32_mod, text_bytes

FEATURES, SEED, WIDTH, RIDGE, BINS = 256, 7, 1.5, 1.0, 4096
HELD_MOD, HELD = 3, 1

#: Groups of bytes whose shares are statistics.
_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b"\t", b",", b".", b"!", b"?", b"'\"", b"()[]{}", b"<>", b"|", b"#$%&*", b"@", b"/\\", b"=+-_~^`", b":;", bytes(range(0x80, 0x100))]
_CLASS = np.zeros((256, len(_GROUPS)))
for _i, _g in enumerate(_GROUPS):
    _CLASS[list(_g), _i] = 1
N_STATS = len(_GROUPS) + 10


def statistics(data: np.ndarray, ofs: np.ndarray) -> np.ndarray:
    """One row of N_STATS numbers for each text."""
    n = len(ofs) - 1
    out = np.zeros((n, N_STATS))
    words = Words(data, ofs)
    upper = np.concatenate([[0], np.cumsum((data >= 0x41) & (data <= 0x5A))])
    for i in range(n):
        a, b = ofs[i], ofs[i + 1]
        if a == b:
            continue
        text = data[a:b]
        size = b - a
        out[i, : len(_GROUPS)] = np.sqrt(np.bincount(text, minlength=256) @ _CLASS / size)
        row = out[i, len(_GROUPS) :]
        row[0] = math.log1p(size)
        lines = text.tobytes().split(b"\n")
        row[1] = len(set(lines)) / len(lines)
        row[2] = math.log1p(size / len(lines))
        u, v = words.first[i], words.first[i + 1]
        if v > u:
            h, lens = words.hash[u:v], words.ends[u:v] - words.starts[u:v]
            _, counts = np.unique(h, return_counts=True)
            m = v - u
            row[3] = math.log1p(m)
            row[4] = len(counts) / m
            row[5] = counts.max() / m
            row[6] = lens.mean()
            row[7] = lens.std()
            big = upper[words.ends[u:v]] - upper[words.starts[u:v]]
            row[8] = np.count_nonzero(big == lens) / m
            row[9] = np.count_nonzero(h[1:] == h[:-1]) / m
    return out


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_STATS, pa.int32()), pa.array(x.ravel()))


def statistics_table(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) for each row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(statistics(*text_bytes(batch.column("text"))))], ["doc_id", "stats"])

    return map_slices(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, stats array<double>")


def _stats(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), N_STATS)


class Fourier:
    """cos(x W + b) after standardising, with a constant."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.normal(size=(N_STATS, features)) / (width * math.sqrt(N_STATS))
        self.b = rng.uniform(0, 2 * math.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        out = np.ones((len(x), self.w.shape[1] + 1 + N_STATS))
        out[:, : self.w.shape[1]] = np.cos(z @ self.w + self.b) * math.sqrt(2 / self.w.shape[1])
        out[:, self.w.shape[1] : -1] = z * 0.1
        return out


def _tree_sum(df: DataFrame, width: int) -> np.ndarray:
    """The sum of rows of one column `part`, each the bytes of `width` doubles: by partition, then by ever fewer tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column("part"):
                x = np.frombuffer(x.as_buffer(), np.float64)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    n = df.rdd.getNumPartitions()
    while n > 16:
        n = max(1, math.isqrt(n))
        df = df.repartition(n).mapInArrow(run, "part binary")
    total = np.zeros(width)
    for r in df.collect():
        total = total + np.frombuffer(r["part"], np.float64)
    return total


def _sums(df: DataFrame, fn, width: int) -> np.ndarray:
    """Sum over partitions of fn(stats, y) -> array of `width`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = fn(_stats(b.column("stats")), b.column("y").to_numpy(zero_copy_only=False).astype(np.float64))
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    return _tree_sum(df.mapInArrow(run, "part binary"), width)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over bins ascending in x: mean x and mean y of the pooled blocks."""
    blocks: list[list[float]] = []
    for xi, yi, ni in zip(x, y, n, strict=True):
        blocks.append([xi * ni, yi * ni, ni])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            a = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], a, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


class Model:
    def __init__(self, fourier: Fourier | None, beta: np.ndarray | None, knots: tuple[np.ndarray, np.ndarray] | None):
        self.fourier, self.beta, self.knots = fourier, beta, knots

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.fourier is None:
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        # a sliver of the raw score keeps the order within the flat steps
        flat = np.interp(raw, *self.knots)
        return np.clip(flat * 0.998 + 0.002 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def fit(labelled: DataFrame, ridge: float = RIDGE) -> Model:
    """labelled: (stats, y). Three passes of sums over all its rows: moments, normal equations, calibration counts."""
    labelled = materialize(labelled, "rff-labelled")
    m = _sums(labelled, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * N_STATS)
    n, pos = m[0], m[1]
    if n == 0:
        return Model(None, None, None)
    mean = m[2 : 2 + N_STATS] / n
    fourier = Fourier(mean, np.sqrt(np.maximum(0, m[2 + N_STATS :] / n - mean * mean)))
    d = FEATURES + 1 + N_STATS
    # both classes weigh the same in the fit
    weight = (n / (2 * max(1.0, n - pos)), n / (2 * max(1.0, pos)))

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(d * d + d)
        for i in range(0, len(x), 4096):
            phi, t = fourier(x[i : i + 4096]), y[i : i + 4096]
            w = np.where(t > 0.5, weight[1], weight[0])
            out[: d * d] += ((phi * w[:, None]).T @ phi).ravel()
            out[d * d :] += phi.T @ (w * t)
        return out

    s = _sums(labelled, normal, d * d + d)
    beta = np.linalg.solve(s[: d * d].reshape(d, d) + ridge * np.eye(d), s[d * d :])
    bare = Model(fourier, beta, None)

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        raw = bare.raw(x)
        at = np.clip((raw + 1) / 3 * BINS, 0, BINS - 1).astype(int)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, raw, BINS), np.bincount(at, y, BINS)])

    c = _sums(labelled, binned, 3 * BINS).reshape(3, BINS)
    has = c[0] > 0
    k, sx, sy = c[:, has]
    return Model(fourier, beta, isotonic(sx / k, sy / k, k))


def _labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """(stats, y) of the labels that may be learned from."""
    own = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("double").alias("y")).where(F.col("__id").isNotNull() & F.col("y").isNotNull() & (crc32_mod("__id", HELD_MOD) != HELD))
    return stats.join(own, F.col("doc_id") == F.col("__id")).select("stats", "y")


def score_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted. Labels of held-out ids are never seen."""
    stats = materialize(statistics_table(docs), "rff-stats")
    model = fit(_labelled(stats, labels))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                score = model.score(_stats(b.column("stats")))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return stats.withColumn("held_out", crc32_mod("doc_id", HELD_MOD) == HELD).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs whose text scores at least the threshold.

    The rows are written once along with their statistics, so that no text is read twice by Python and none is shuffled.
    """
    (name,) = free_names(docs, "stats")

    def put(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.append_column(name, _lists(statistics(*text_bytes(batch.column("text")))))

    wide = materialize(map_slices(docs, put, StructType([*docs.schema.fields, StructField(name, ArrayType(DoubleType()))])), "rff-documents")
    model = fit(_labelled(wide.select("doc_id", F.col(name).alias("stats")), labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = batch.schema.get_field_index(name)
                good = model.score(_stats(batch.column(at))) >= threshold
                yield batch.select([c for c in batch.schema.names if c != name]).filter(pa.array(good))

    return wide.mapInArrow(run, docs.schema)
