"""Quality classifier: random Fourier features, ridge regression from summed normal equations, isotonic calibration.

Every whole text becomes a vector of statistics (sizes, shares of character classes, repetition of words and
lines). Random Fourier features approximate a Gaussian kernel over the standardised statistics. Each partition
adds up its rows' normal equations, the sums are added level by level, and the driver solves one small system.
Raw scores are calibrated by pooling adjacent violators over a histogram of fixed bins of the learning rows.

Learned from labelled rows outside the held-out fold; standardisation and kernel width come from a bounded
sample of them (SAMPLE rows by hash of doc_id and text statistics), everything else from all of them.

Defined results: null and empty texts have the statistics of an empty text; a label that is null or not 0 or 1
teaches nothing; several labels of a doc_id all count; without labels, or with one class alone, the score is the
share of label 1 (0.5 without any); repeated rows each keep a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.op3_language import held_out
from lectern.llm.textkit import column_bytes, row_chunks, small_batches, stored, thinned

SAMPLE, FEATURES, RIDGE, CUT = 4096, 256, 1e-3, 0.3
#: Calibration bins over raw scores from LOW to HIGH; partition sums added in one task.
BINS, LOW, HIGH, FAN_IN = 400, -0.5, 1.5, 32
#: The character classes whose shares are statistics, by byte.
_CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": (32, 9), "line": (10,),
    "stop": (46, 63), "shout": (33,), "comma": (44, 59, 58), "bar": (124,), "mark": tuple(b"#$%&*@^~<>{}[]\\/=+_"),
    "quote": tuple(b"\"'`()-"), "wide": range(128, 256), "control": (*range(9), *range(11, 32), 127),
}
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _k, _bytes in enumerate(_CLASSES.values()):
    _CLASS[list(_bytes)] = _k
_SPACE = np.isin(np.arange(256), (9, 10, 13, 32))
STATISTICS = len(_CLASSES) + 13


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many distinct keys each owner has."""
    order = np.lexsort((keys, owner))
    new = np.ones(len(keys), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    return np.bincount(owner[order][new], minlength=n).astype(float)


def _segments(flat: np.ndarray, breaks: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs between breaks and row ends: their starts, sizes, row and a hash of their bytes."""
    stop = breaks.copy()
    first = np.zeros(len(flat) + 1, bool)
    first[offsets] = True
    begin = ~stop & (np.concatenate([[True], stop[:-1]]) | first[:-1])
    starts = np.flatnonzero(begin)
    run = np.cumsum(begin) - 1
    inside = ~stop
    sizes = np.bincount(run[inside], minlength=len(starts))
    place = np.arange(len(flat)) - starts[np.maximum(run, 0)] if len(starts) else np.zeros(len(flat), np.int64)
    step = (flat.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (step ^ ((place.astype(np.uint64) + np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    mixed[stop] = 0
    hashes = np.add.reduceat(mixed, starts) if len(starts) else np.zeros(0, np.uint64)
    return starts, sizes, np.searchsorted(offsets, starts, side="right") - 1, hashes


def statistics(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistics of every row of a flat byte array."""
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)
    out = np.zeros((n, STATISTICS))
    if not len(flat):
        return out
    some = np.maximum(size, 1)
    kind = _CLASS[flat]
    for k in range(len(_CLASSES)):
        out[:, k] = _sums(kind == k, offsets) / some
    at = len(_CLASSES)
    starts, sizes, row, keys = _segments(flat, _SPACE[flat], offsets)
    words = np.bincount(row, minlength=n).astype(float)
    many = np.maximum(words, 1)
    ends = flat[np.minimum(starts + sizes - 1, len(flat) - 1)]
    same = np.zeros(len(starts), bool)
    same[1:] = (keys[1:] == keys[:-1]) & (row[1:] == row[:-1])
    pairs = keys.copy()
    pairs[1:] = pairs[1:] * np.uint64(31) + keys[:-1]
    out[:, at] = np.log1p(size)
    out[:, at + 1] = np.log1p(words)
    out[:, at + 2] = np.bincount(row, sizes, n) / many
    out[:, at + 3] = np.sqrt(np.maximum(0, np.bincount(row, sizes.astype(float) ** 2, n) / many - out[:, at + 2] ** 2))
    out[:, at + 4] = _distinct(keys, row, n) / many
    out[:, at + 5] = np.bincount(row, same, n) / many
    out[:, at + 6] = _distinct(pairs, row, n) / many
    out[:, at + 7] = np.bincount(row, sizes == 1, n) / many
    out[:, at + 8] = np.bincount(row, np.isin(_CLASS[ends], [9, 6, 8]), n) / many
    out[:, at + 9] = np.bincount(row, (_CLASS[flat[starts]] == 1) & (_CLASS[ends] == 1) & (sizes > 1), n) / many
    _, lengths, line_row, line_keys = _segments(flat, flat == 10, offsets)
    lines = np.bincount(line_row, minlength=n).astype(float)
    out[:, at + 10] = np.log1p(lines)
    out[:, at + 11] = np.log1p(np.bincount(line_row, lengths, n) / np.maximum(lines, 1))
    out[:, at + 12] = _distinct(line_keys, line_row, n) / np.maximum(lines, 1)
    return out


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row: the statistics as bytes of doubles."""
    out = T.StructType([docs.schema["doc_id"]]).add("x", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = column_bytes(batch.column(1))
            for a, b in row_chunks(offsets, 2 << 20):
                made = statistics(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([r.tobytes() for r in made], pa.binary())], names=out.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(run, out)


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), STATISTICS)


def normal_equations(z: np.ndarray, n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """[ZZ | Zy] of rows that have `n` labels each, `ones` of them 1."""
    return np.hstack([(z * n[:, None]).T @ z, (z.T @ ones)[:, None]])


class Model:
    """Standardisation, Fourier features, ridge weights and calibration."""

    def __init__(self, sample: np.ndarray, seed: int = 17) -> None:
        random = np.random.default_rng(seed)
        self.mean, self.spread = sample.mean(axis=0), sample.std(axis=0) + 1e-6
        x = self.standard(sample)
        a, b = random.integers(0, len(x), (2, 4000))
        distance = np.sqrt(((x[a] - x[b]) ** 2).sum(axis=1))
        width = np.median(distance[distance > 0]) if (distance > 0).any() else 1.0
        self.way, self.phase = random.normal(0, 1 / width, (STATISTICS, FEATURES)), random.uniform(0, 2 * np.pi, FEATURES)
        self.weight = np.zeros(FEATURES + STATISTICS + 1)
        self.steps: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    def expand(self, x: np.ndarray) -> np.ndarray:
        x = self.standard(x)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ self.way + self.phase), 0.1 * x, np.ones((len(x), 1))])

    def solve(self, sums: np.ndarray) -> None:
        """Ridge weights from the summed normal equations [ZZ | Zy]."""
        size = len(self.weight)
        both = sums.reshape(size, size + 1)
        rows = both[size - 1, size - 1]  # the last feature is 1
        self.weight = np.linalg.solve(both[:, :size] + RIDGE * rows / FEATURES * np.eye(size), both[:, size])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.expand(x) @ self.weight, LOW, HIGH - 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)

    def calibrate(self, bins: np.ndarray, count: np.ndarray, ones: np.ndarray) -> None:
        """Pools adjacent violators over the bins; scores between pooled centres are interpolated."""
        centre = LOW + (bins + 0.5) * (HIGH - LOW) / BINS
        pooled: list[list[float]] = []
        for c, n, k in sorted(zip(centre.tolist(), count.tolist(), ones.tolist(), strict=True)):
            pooled.append([c * n, n, k])
            while len(pooled) > 1 and pooled[-2][2] / pooled[-2][1] >= pooled[-1][2] / pooled[-1][1]:
                last = pooled.pop()
                pooled[-1] = [p + q for p, q in zip(pooled[-1], last, strict=True)]
        where, height = np.array([p[0] / p[1] for p in pooled]), np.array([p[2] / p[1] for p in pooled])
        # The ends lead on to 0 and 1, so that scores beyond the outer pools still differ.
        self.steps = (np.concatenate([[LOW], where, [HIGH]]), np.concatenate([[height[0] / 2], height, [(1 + height[-1]) / 2]]))


def _added(frame: DataFrame, parts: int) -> np.ndarray | None:
    """The sum of one binary row of doubles for each partition, added FAN_IN at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0):
                values = np.frombuffer(raw.as_py(), np.float64)
                total = values.copy() if total is None else total + values
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    while parts > 1:
        parts = -(-parts // FAN_IN)
        frame = frame.repartition(parts).mapInArrow(add, "sums binary")
    rows = frame.collect()
    return sum((np.frombuffer(r.sums, np.float64) for r in rows[1:]), np.frombuffer(rows[0].sums, np.float64).copy()) if rows else None


def _sampled(rows: DataFrame, total: int, size: int = SAMPLE) -> list:
    """At most `size` of `total` rows by hash: thinned first, and unthinned if a few repeated rows all fell out."""
    key = F.xxhash64("doc_id", "x")
    first = lambda frame: frame.orderBy(key, "doc_id", "x").limit(size).select("x").collect()
    return first(rows.where(thinned(key, size, total))) or first(rows.distinct())


def learn(facts: DataFrame, labels: DataFrame) -> Model | float:
    """A model from (doc_id, x) and labels (doc_id, quality); a bare share of label 1 where there is one class.

    The labels of a doc_id are added up first, so that repeated ids on both sides don't multiply."""
    spark = facts.sparkSession
    marks = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id")
    marks = marks.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("quality").cast("double")).alias("ones"))
    rows = stored(facts.join(marks.where(~held_out(0, 5)), "doc_id").select("doc_id", "x", "n", "ones"), "labelled")
    weight, ones, total = rows.agg(F.sum("n"), F.sum("ones"), F.count(F.lit(1))).first()
    if not total or ones in (0.0, weight):
        return float(ones / weight) if total else 0.5
    model = Model(np.stack([np.frombuffer(r.x, np.float64) for r in _sampled(rows, total)]))
    shared = spark.sparkContext.broadcast(model)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for a in range(0, len(batch), 2048):
                part = batch.slice(a, 2048)
                found = normal_equations(shared.value.expand(_unpacked(part.column(0))), *(part.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    learning = rows.select("x", "n", "ones")
    model.solve(_added(learning.mapInArrow(sums, "sums binary"), learning.rdd.getNumPartitions()))
    shared = spark.sparkContext.broadcast(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = shared.value.raw(_unpacked(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(((raw - LOW) / (HIGH - LOW) * BINS).astype(np.int32)), batch.column(1), batch.column(2)], names=["bin", "n", "ones"])

    bins = learning.mapInArrow(binned, "bin int, n double, ones double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).collect()
    model.calibrate(*(np.array([r[k] for r in bins], float) for k in range(3)))
    return model


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document row: doc_id, held_out, score and predicted."""
    small_batches(docs.sparkSession)
    facts = stored(described(docs), "facts")
    shared = docs.sparkSession.sparkContext.broadcast(learn(facts, labels))
    out = T.StructType([docs.schema["doc_id"]]).add("held_out", "boolean").add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            x = _unpacked(batch.column(2))
            score = np.full(len(x), model) if isinstance(model, float) else model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=out.fieldNames())

    return facts.select("doc_id", held_out(0, 5).alias("held_out"), "x").mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 over the whole documents table."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
