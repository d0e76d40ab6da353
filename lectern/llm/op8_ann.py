"""Approximate nearest neighbours by learned partitions (largest inner product).

A bounded sample of vectors is joined to its nearest neighbours; that graph is cut into balanced parts, and a
small neural classifier learns which part's neighbourhood a vector belongs to. Every vector is indexed in its
most probable part; a query is routed to its several most probable parts and reranked there exactly. How many
parts a query visits is measured on the sample, as the fewest that reach the recall asked for.

Parts are dealt in blocks of bounded size and queries in blocks too, so neither a large part, nor a vector that
a third of the rows share, nor many queries meet in one task; nothing is capped. Blocks keep the best `k` each,
which are ranked together.

Tables of every size are routed; there is a single part only where the sample has too few distinct vectors to be
cut in two. Queries whose parts held fewer than `k` distinct candidates are searched again in all parts.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component, rows without vec_id,
and vectors of another length than most take no part; equal scores go to the smaller vec_id; rows that repeat a
vec_id count once, with their best score; a query never finds its own vec_id; with fewer than `k` candidates in
the table it gets all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.op5_jaccard import _Groups
from lectern.llm.textkit import small_batches, stored, thinned

#: Vectors the index is fitted on: at least, for each part, at most; queries that recall is measured with, recall asked for.
SAMPLE, PART_SAMPLE, SAMPLE_MOST, PROBES, RECALL = 8192, 32, 16384, 512, 0.97
#: Rows a part should hold, most parts, distinct sample vectors a part needs, rows and queries in one block.
PART_ROWS, PARTS, PART_VECTORS, BLOCK, QUERY_BLOCK = 2048, 512, 16, 4096, 2048
NEIGHBOURS, HIDDEN, EPOCHS = 10, 96, 30


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """The k rows of largest inner product with each row, itself left out; in blocks."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for a in range(0, len(x), 1024):
        score = x[a : a + 1024] @ x.T
        score[np.arange(len(score)), np.arange(a, a + len(score))] = -np.inf
        out[a : a + 1024] = np.argpartition(-score, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, slack: float = 1.1, sweeps: int = 6) -> np.ndarray:
    """Parts of the neighbour graph, none larger than `slack` times the mean: halved along principal directions,
    then moved, vertex by vertex, to where most neighbours are and room is."""
    label, depth = np.zeros(len(x), np.int64), int(np.log2(parts))
    random = np.random.default_rng(5)
    for _ in range(depth):
        for part in range(label.max() + 1):
            rows = np.flatnonzero(label == part)
            centred = x[rows] - x[rows].mean(axis=0)
            way = random.normal(size=x.shape[1])
            for _ in range(8):
                way = centred.T @ (centred @ way)
                way /= np.linalg.norm(way) + 1e-12
            upper = np.argsort(centred @ way, kind="stable")[len(rows) // 2 :]
            label[rows] *= 2
            label[rows[upper]] += 1
    room = int(np.ceil(slack * len(x) / parts))
    both = [list(map(int, n)) for n in near]
    for i, n in enumerate(near):
        for j in n:
            both[j].append(i)
    load = np.bincount(label, minlength=parts)
    for _ in range(sweeps):
        moved = 0
        for i in random.permutation(len(x)):
            votes = np.bincount(label[both[i]], minlength=parts).astype(float)
            votes[(load >= room) & (np.arange(parts) != label[i])] = -1
            best = int(np.argmax(votes))
            if votes[best] > votes[label[i]]:
                load[label[i]] -= 1
                load[best] += 1
                label[i] = best
                moved += 1
        if moved < len(x) // 200:
            break
    return label


class Router:
    """A network of one hidden layer from vectors to part probabilities."""

    def __init__(self, x: np.ndarray, target: np.ndarray, seed: int = 9) -> None:
        random = np.random.default_rng(seed)
        self.scale = 1 / (np.sqrt((x * x).sum(axis=1)).mean() / np.sqrt(x.shape[1]) + 1e-12)
        self.w = [random.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, (HIDDEN, target.shape[1])), np.zeros(target.shape[1])]
        first, second, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(EPOCHS):
            order = random.permutation(len(x))
            for a in range(0, len(x), 256):
                rows, step = order[a : a + 256], step + 1
                inner = np.maximum(x[rows] * self.scale @ self.w[0] + self.w[1], 0)
                error = (self._soft(inner @ self.w[2] + self.w[3]) - target[rows]) / len(rows)
                back = (error @ self.w[2].T) * (inner > 0)
                grads = [(x[rows] * self.scale).T @ back, back.sum(axis=0), inner.T @ error, error.sum(axis=0)]
                for k, g in enumerate(grads):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.w[k] -= 0.004 * (1 - epoch / EPOCHS) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def order(self, x: np.ndarray) -> np.ndarray:
        """The parts of each row, most probable first."""
        score = np.maximum(x * self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]
        return np.argsort(-score, axis=1, kind="stable")


def fitted(x: np.ndarray, parts: int, k: int, recall: float = RECALL) -> tuple[Router, int]:
    """A router for `parts` parts, and the fewest visits that find `recall` of the k nearest within the sample."""
    near = neighbour_graph(x)
    label = balanced_parts(x, near, parts)
    target = np.full((len(x), parts), 1e-3)
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), label[near].ravel()), 1.0)
    target[np.arange(len(x)), label] += 1
    router = Router(x, target / target.sum(axis=1, keepdims=True))
    order = router.order(x)
    some = np.random.default_rng(1).permutation(len(x))[:PROBES]
    score = x[some] @ x.T
    score[np.arange(len(some)), some] = -np.inf
    best = np.argpartition(-score, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)]
    place = (order[some][:, None, :] == order[best, 0][:, :, None]).argmax(axis=2)
    shares = [(place < m).mean() for m in range(1, parts + 1)]
    return router, next(m for m, share in enumerate(shares, 1) if share >= recall or m == parts)


def clean_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part; v is array<double>."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bound = float("inf")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < bound)) & F.exists("v", lambda c: c != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    size = rows.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").first()
    return rows.where(F.size("v") == size.s) if size else rows


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _index(rows: DataFrame, total: int, k: int, recall: float) -> tuple[Router | None, int]:
    """A router fitted on a bounded sample of `total` vectors, and how many parts a query visits; no router where
    the sample's distinct vectors do not make two parts."""
    if not total:
        return None, 1
    wanted = min(PARTS, 1 << max(1, round(np.log2(total / PART_ROWS))))
    size = min(SAMPLE_MOST, max(SAMPLE, PART_SAMPLE * wanted))
    key = F.xxhash64("vec_id", "v")
    first = lambda frame: frame.orderBy(key, "vec_id", "v").limit(size).select("v").collect()
    picked = first(rows.where(thinned(key, size, total))) or first(rows.distinct())
    sample = np.unique(np.array([r.v for r in picked]), axis=0)
    parts = min(wanted, 1 << max(0, int(np.log2(max(1, len(sample) / PART_VECTORS)))))
    return fitted(sample, parts, k, recall) if parts > 1 else (None, 1)


def _searched(known: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best of the rows `known` (vec_id, v, part) for the queries `asked` (vec_id, v,
    part, a row for each part they visit), block by block; at least `k` of each query if its parts have them."""
    load = known.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    asks = asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("q_blocks"))
    plan = F.broadcast(load.join(asks, "part").limit(PARTS))  # a row for each part
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n)).cast("int")
    held = known.join(plan, "part").select("part", own("blocks", 1).alias("block"), spread("q_blocks").alias("q_block"), F.lit(0).alias("role"), "vec_id", "v")
    queries = asked.join(plan, "part").select("part", spread("blocks").alias("block"), own("q_blocks", 2).alias("q_block"), F.lit(1).alias("role"), "vec_id", "v")
    dealt = held.unionByName(queries).repartition("part", "block", "q_block").sortWithinPartitions("part", "block", "q_block", "role", "vec_id")
    out = T.StructType().add("query_id", "long").add("vec_id", "long").add("score", "double")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, starts in _Groups(batches, 3):
            ends = np.append(starts[1:], len(group))
            ids, role = group.column("vec_id").to_numpy(), group.column("role").to_numpy()
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                x = np.frombuffer(b"".join(group.column("v").slice(a, b - a).to_pylist()), np.float64).reshape(b - a, -1)
                cut = int((role[a:b] == 0).sum())
                found = _best(ids[a : a + cut], x[:cut], ids[a + cut : b], x[cut:], k)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], names=out.fieldNames())

    return dealt.mapInArrow(search, out).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def nearest(table: DataFrame, every: int = 20, k: int = 20, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose vec_id is divisible by `every`, against all rows."""
    spark = table.sparkSession
    small_batches(spark)
    rows = clean_vectors(table)
    router, visits = _index(rows, rows.count(), k, recall)
    shared = spark.sparkContext.broadcast(router)
    routed = T.StructType().add("vec_id", "long").add("v", "binary").add("parts", T.ArrayType(T.IntegerType()))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.ascontiguousarray(_matrix(batch.column(1)))
            order = shared.value.order(x)[:, :visits] if shared.value else np.zeros((len(x), 1), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(list(order.astype(np.int32)), pa.list_(pa.int32()))], names=routed.fieldNames())

    known = stored(rows.mapInArrow(route, routed), "routed")
    held = known.select("vec_id", "v", F.col("parts")[0].alias("part"))
    asks = known.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0)
    pairs = stored(_searched(held, asks.select("vec_id", "v", F.explode("parts").alias("part")), k), "pairs")
    enough = pairs.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    short = stored(asks.select("vec_id", "v").join(enough, "vec_id", "left_anti"), "short")
    if not short.isEmpty():
        everywhere = F.explode(F.sequence(F.lit(0), F.lit(len(router.w[3]) - 1 if router else 0))).alias("part")
        pairs = pairs.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(_searched(held, short.select("vec_id", "v", everywhere), k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query in a block: picked by matrix product, then scored by sums whose order
    does not depend on a row's place, so that equal vectors score equally. The cut is the k-th best of distinct ids."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(ids) and len(query_ids):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        for a in range(0, len(query_ids), 256):
            score = queries[a : a + 256] @ x.T
            for j in range(len(score)):
                row = np.where(ids == query_ids[a + j], -np.inf, score[j])
                each = np.maximum.reduceat(row, starts) if len(starts) < len(row) else row
                least = np.partition(each, len(each) - k)[len(each) - k] if len(each) > k else -np.inf
                slack = 1e-9 * (1 + abs(least)) if np.isfinite(least) else 0
                some = np.flatnonzero((row >= least - slack) & (row > -np.inf))
                exact = (x[some] * queries[a + j]).sum(axis=1)
                order = np.lexsort((ids[some], -exact))
                _, first = np.unique(ids[some][order], return_index=True)
                order = order[np.sort(first)][:k]
                found.append((np.full(len(order), query_ids[a + j]), ids[some][order], exact[order]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 over the whole embeddings table."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
