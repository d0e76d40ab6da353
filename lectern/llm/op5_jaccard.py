"""Similarity join on sets of five-word shingles (Jaccard 0.8 or more) with Bayesian candidate pruning.

1. Every text becomes a copy key (a strong digest of its folded words), MinHash values and bands of them.
   Texts of equal folded words are one class of copies, represented once from here on.
2. Representatives that share a band are candidates. Within a band bucket, MinHash values are compared a few at
   a time; a pair is dropped as soon as the posterior probability that its similarity reaches the threshold
   falls below a tolerance. What stays is kept as a spanning forest, linear in the bucket, never as all pairs.
3. Inside each connected component of that forest, every pair of different texts is pruned in the same way and
   what stays is verified exactly on the shingle sets. Per text come the number of linked documents and a
   spanning forest of the links.

Buckets and components are dealt in blocks of bounded size, and pairs of blocks are compared, so a group of any
size spreads over tasks; nothing is capped. Only bands are probabilistic: a pair at the threshold is missed by
all 20 bands of 4 values with a probability below 3e-5, and pruned wrongly with one of the order of the tolerance.

Defined results: a text of fewer than five words has one shingle, all its words; a text without words (or null)
is linked to none and is its own class; a text that only rows of null doc_id have is linked to its copies
alone; repeated rows are copies of each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.components import components, local_roots
from lectern.llm.textkit import FOLD, KeyFilter, column_bytes, row_chunks, small_batches, stored

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-9
BANDS, ROWS, STEP = 20, 4, 16
HASHES = BANDS * ROWS
#: Members of a bucket in one block; texts and bytes of shingles of a component in one block; pairs compared at once.
BUCKET_BLOCK, TEXT_BLOCK, BYTE_BLOCK, PAIRS = 1024, 512, 4 << 20, 1 << 18
_random = np.random.default_rng(20240501)
_BYTE, _FACTOR = _random.integers(1, 2**63, 256).astype(np.uint64), np.uint64(0x9E3779B97F4A7C15)
_PLACE = _random.integers(1, 2**63, SHINGLE).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_A = _random.integers(1, 2**63, HASHES).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(1, 2**63, HASHES).astype(np.uint64)
_BAND = _random.integers(1, 2**63, (BANDS, ROWS)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, hashes: int = HASHES) -> np.ndarray:
    """For n compared values, the fewest equal ones whose posterior probability of reaching the threshold is not
    below the tolerance: uniform prior, eight bits of each value, so unequal values agree once in 256."""
    grid = (np.arange(4000) + 0.5) / 4000
    chance = grid + (1 - grid) / 256
    out = np.zeros(hashes + 1, np.int64)
    for n in range(1, hashes + 1):
        for m in range(n + 1):
            log = m * np.log(chance) + (n - m) * np.log1p(-chance)
            weight = np.exp(log - log.max())
            if weight[grid >= threshold].sum() >= tolerance * weight.sum():
                out[n] = m
                break
    return out


_LEAST = least_matches()


def shingles(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit shingle hashes of folded documents (words joined by one blank, none empty), and their offsets."""
    raw = np.frombuffer(b" ".join(docs) + b" ", np.uint8)
    stops = np.flatnonzero(raw == 32)
    starts = np.concatenate([[0], stops[:-1] + 1])
    sizes = stops - starts + 1
    power = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(int(sizes.max()), _FACTOR))])
    within = np.arange(len(raw)) - np.repeat(starts, sizes)
    word = _mix(np.add.reduceat(_BYTE[raw] * power[within], starts))
    lengths = np.array([len(d) + 1 for d in docs])
    head = np.searchsorted(starts, np.cumsum(lengths) - lengths)
    words = np.diff(np.append(head, len(starts)))
    count = np.maximum(words - SHINGLE + 1, 1)
    offsets = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(head - offsets[:-1], count) + np.arange(offsets[-1])
    padded = np.concatenate([word, np.zeros(SHINGLE, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        out += padded[at + k] * _PLACE[k]
    for d in np.flatnonzero(words < SHINGLE):  # all its words are one shingle
        part = word[head[d] : head[d] + words[d]]
        out[offsets[d]] = (part * _PLACE[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))
    return _mix(out), offsets


def minhashes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, HASHES) MinHash values of 32 bits."""
    out = np.empty((HASHES, len(offsets) - 1), np.uint64)
    for a, b in row_chunks(offsets, 1 << 15):
        part, starts = values[offsets[a] : offsets[b]], offsets[a:b] - offsets[a]
        work = np.empty_like(part)
        for k in range(HASHES):
            np.multiply(part, _A[k], out=work)
            work += _B[k]
            np.minimum.reduceat(work, starts, out=out[k, a:b])
    return (out >> np.uint64(32)).T


def _folded(column: pa.Array) -> Iterator[list[bytes]]:
    flat, offsets = column_bytes(column)
    for a, b in row_chunks(offsets, 1 << 20):
        data = flat[offsets[a] : offsets[b]].tobytes().translate(FOLD)
        cuts = (offsets[a : b + 1] - offsets[a]).tolist()
        yield [b" ".join(data[x:y].split()) for x, y in zip(cuts, cuts[1:], strict=False)]


def _digest(folded: bytes) -> bytes | None:
    return hashlib.blake2b(folded, digest_size=16).digest() if folded else None


def signed(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, tid (md5 of the text), key, n (distinct shingles), sig (a byte of each MinHash value), bands."""
    out = T.StructType().add("doc_id", "long").add("tid", "string").add("key", "binary").add("n", "long").add("sig", "binary").add("bands", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for folded in _folded(batch.column(2)):
                full = [d for d in folded if d]
                keys = [_digest(d) for d in folded]
                sizes: list[int | None] = [None] * len(folded)
                sigs: list[bytes | None] = [None] * len(folded)
                bands: list[np.ndarray | None] = [None] * len(folded)
                if full:
                    values, offsets = shingles(full)
                    low = minhashes(values, offsets)
                    parts = _mix((low.reshape(len(full), BANDS, ROWS) * _BAND).sum(axis=2, dtype=np.uint64) + _BAND[:, 0]).view(np.int64)
                    short = low.astype(np.uint8)
                    for k, i in enumerate(i for i, d in enumerate(folded) if d):
                        sizes[i], sigs[i], bands[i] = len(np.unique(values[offsets[k] : offsets[k + 1]])), short[k].tobytes(), parts[k]
                part = [batch.column(j).slice(at, len(folded)) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*part, pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=out.fieldNames(),
                )
                at += len(folded)

    return docs.select(F.col("doc_id").cast("long"), F.md5("text").alias("tid"), "text").mapInArrow(run, out)


class _Groups:
    """Cuts a stream of batches, sorted by a group column, into tables of whole groups."""

    def __init__(self, batches: Iterator[pa.RecordBatch], columns: int) -> None:
        self.batches, self.columns = batches, columns

    def __iter__(self) -> Iterator[tuple[pa.Table, np.ndarray]]:
        rest: pa.Table | None = None
        for batch in self.batches:
            table = pa.Table.from_batches([batch])
            if rest is not None and len(rest):
                table = pa.concat_tables([rest, table])
            starts = self._starts(table)
            if len(starts) > 1:
                yield table.slice(0, starts[-1]).combine_chunks(), starts[:-1]
            rest = table.slice(starts[-1]) if len(starts) else table
        if rest is not None and len(rest):
            rest = rest.combine_chunks()
            yield rest, self._starts(rest)

    def _starts(self, table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        new[:1] = True
        for k in range(self.columns):
            column = table.column(k).to_pandas().to_numpy()
            new[1:] |= column[1:] != column[:-1]
        return np.flatnonzero(new)


def _pairs(starts: np.ndarray, n: int, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs to compare inside groups, about PAIRS at once: all of a group, or those between its two sides."""
    sizes = np.diff(np.append(starts, n))
    ahead = np.repeat(starts + sizes, sizes) - np.arange(n) - 1  # partners after each row
    total = np.concatenate([[0], np.cumsum(ahead)])
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, side="right")) - 1)
        rows = np.arange(at, end)
        a = np.repeat(rows, ahead[at:end])
        b = a + 1 + np.arange(len(a)) - np.repeat(total[at:end] - total[at], ahead[at:end])
        fits = (side[a] != side[b]) | (side[a] < 0)
        yield a[fits], b[fits]
        at = end


def prune(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The positions of the pairs that incremental comparison keeps."""
    left, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k in range(0, HASHES, STEP):
        equal = equal + (sig[a[left], k : k + STEP] == sig[b[left], k : k + STEP]).sum(axis=1)
        stay = equal >= _LEAST[k + STEP]
        left, equal = left[stay], equal[stay]
    return left


def _signatures(table: pa.Table, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), np.uint8).reshape(len(table), HASHES)


def _dealt(frame: DataFrame, keys: list[str], blocks: str) -> DataFrame:
    """Rows dealt to pairs of blocks: each row meets every block once; side is -1 where a block meets itself."""
    own = F.pmod(F.xxhash64("key", F.lit(5)), F.col(blocks)).cast("int")
    met = frame.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    return met.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).withColumn(
        "side", F.when(F.col("x") == F.col("y"), -1).when(F.col("own") == F.col("x"), 0).otherwise(1)
    )


def candidates(reps: DataFrame) -> DataFrame:
    """Forest edges (a, b) of the representatives that share a band and survive pruning."""
    spread = reps.select("key", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = shared.select("band", F.ceil(F.col("m") / BUCKET_BLOCK).alias("blocks"))
    rows = spread.join(shared, "band").join(reps.select("key", "sig"), "key")
    dealt = _dealt(rows, ["band"], "blocks").select("band", "x", "y", "side", "key", "sig")
    dealt = dealt.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")
    out = T.StructType().add("a", "binary").add("b", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _Groups(batches, 3):
            sig, side, found = _signatures(table, "sig"), table.column("side").to_numpy(), []
            for a, b in _pairs(starts, len(table), side):
                left = prune(sig, a, b)
                found.append(np.stack([a[left], b[left]]))
            a, b = np.concatenate(found, axis=1)
            root = local_roots(len(table), a, b)
            moved = np.flatnonzero(root != np.arange(len(table)))
            key = table.column("key").combine_chunks()
            yield pa.RecordBatch.from_arrays([key.take(pa.array(moved)), key.take(pa.array(root[moved]))], names=["a", "b"])

    return dealt.mapInArrow(run, out)


def _verify(table: pa.Table, a: np.ndarray, b: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """The exact Jaccard similarity of pairs of rows."""
    size = np.array([len(s) for s in sets])
    used = np.unique(np.concatenate([a, b]))
    if len(a) <= 2 * len(used) or len(used) <= 4:
        both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    else:
        row = np.repeat(np.arange(len(used)), size[used])
        values, column, count = np.unique(np.concatenate([sets[x] for x in used]), return_inverse=True, return_counts=True)
        shared = count[column] > 1
        row, column = row[shared], (np.cumsum(count > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(used), len(used)), np.float32)
        width = max(1, (1 << 22) // len(used))
        for low in range(0, int((count > 1).sum()), width):
            s, e = np.searchsorted(column, [low, low + width])
            part = np.zeros((len(used), width), np.float32)
            part[row[s:e], column[s:e] - low] = 1
            common += part @ part.T
        place = np.searchsorted(used, np.stack([a, b]))
        both = common[place[0], place[1]].astype(np.int64)
    return both / (size[a] + size[b] - both)


def links(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, links, root, whole) from the components of candidates: weighted verified links and forest edges.

    `members` has key, comp, rep (a document of that key), copies, n and sig. A row's root is the least linked
    row of its task; `whole` tells that the task saw the whole component.
    """
    size = members.groupBy("comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n_all"))
    blocks = F.greatest(F.ceil(F.col("m") / TEXT_BLOCK), F.ceil(F.col("n_all") * 8 / BYTE_BLOCK))
    size = size.select("comp", blocks.alias("blocks"))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.md5("text").alias("tid"), "text")
    maybe, _ = KeyFilter(members, "rep", "tid").split(texts)  # so that texts without candidates are not shuffled
    rows = maybe.join(members, ["rep", "tid"])
    middle = T.StructType().add("key", "binary").add("comp", "binary").add("copies", "long").add("sig", "binary").add("shingles", "binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for folded in _folded(batch.column(4)):
                values, offsets = shingles(folded)
                sets = [np.unique(values[offsets[k] : offsets[k + 1]]).tobytes() for k in range(len(folded))]
                yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(at, len(folded)) for j in range(4)), pa.array(sets, pa.binary())], names=middle.fieldNames())
                at += len(folded)

    cut_rows = rows.select("key", "comp", "copies", "sig", "text").mapInArrow(cut, middle).join(size, "comp")
    dealt = _dealt(cut_rows, ["comp"], "blocks").select("comp", "x", "y", "side", "key", "copies", "sig", "shingles", (F.col("blocks") == 1).alias("whole"))
    dealt = dealt.repartition("comp", "x", "y").sortWithinPartitions("comp", "x", "y", "key")
    out = T.StructType().add("key", "binary").add("links", "long").add("root", "binary").add("whole", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _Groups(batches, 3):
            key, first = table.column("key").to_pylist(), np.zeros(len(table), bool)
            first[starts] = True
            again = [k > 0 and not first[k] and key[k] == key[k - 1] for k in range(len(key))]
            if any(again):  # repeated rows of one document
                table = table.filter(pa.array([not x for x in again]))
                starts = starts - np.cumsum(again)[starts]
            sig, side, copies = _signatures(table, "sig"), table.column("side").to_numpy(), table.column("copies").to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
            total, found = np.zeros(len(table), np.int64), []
            for a, b in _pairs(starts, len(table), side):
                left = prune(sig, a, b)
                a, b = a[left], b[left]
                if len(a):
                    group = np.searchsorted(starts, a, side="right")
                    for g in np.unique(group):
                        x, y = a[group == g], b[group == g]
                        linked = _verify(table, x, y, sets) >= THRESHOLD
                        found.append(np.stack([x[linked], y[linked]]))
            if found:
                a, b = np.concatenate(found, axis=1)
                np.add.at(total, a, copies[b])
                np.add.at(total, b, copies[a])
                root = local_roots(len(table), a, b)
            else:
                root = np.arange(len(table))
            key = table.column("key").combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [key, pa.array(total), key.take(pa.array(root)), table.column("whole").combine_chunks()], names=out.fieldNames()
            )

    return dealt.mapInArrow(run, out)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, tid, class_id (least doc_id among all that links join), n_links (other documents
    of similarity 0.8 or more, copies included), copy_id (least doc_id of its copies)."""
    return _classed(docs).drop("head_tid")


def _classed(docs: DataFrame) -> DataFrame:
    """`near_duplicates` with head_tid: with class_id it names the row that heads the class, even where rows of one
    doc_id head several."""
    small_batches(docs.sparkSession)
    rows = stored(signed(docs), "signed")
    full = rows.where("key IS NOT NULL")
    reps = full.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "tid")).alias("r"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    reps = stored(reps.select("key", "copies", F.col("r.doc_id").alias("rep"), F.col("r.tid").alias("tid"), "n", "sig", "bands"), "reps")
    parts = components(candidates(reps)).select(F.col("node").alias("key"), F.col("root").alias("comp"))
    members = reps.drop("bands").join(parts, "key").where("rep IS NOT NULL")
    pieces = stored(links(members, docs.where("doc_id IS NOT NULL")), "links")
    summed = pieces.where("whole").select("key", "links", "root")
    split = pieces.where("NOT whole")
    if not split.isEmpty():
        roots = components(split.select(F.col("key").alias("a"), F.col("root").alias("b")))
        counts = split.groupBy("key").agg(F.sum("links").alias("links"))
        summed = summed.unionByName(counts.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "links", F.coalesce("root", "key").alias("root")))
    summed = summed.groupBy("key").agg(F.max("links").alias("links"), F.min("root").alias("root"))
    known = reps.select("key", "copies", "rep", "tid").join(summed, "key", "left").select("key", "copies", "rep", "tid", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "key").alias("root"))
    heads = known.groupBy("root").agg(F.min(F.struct("rep", "tid")).alias("head"))
    known = known.join(heads, "root").select("key", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("head.rep").alias("class_id"), F.col("rep").alias("copy_id"), F.col("head.tid").alias("head_tid"))
    linked = full.select("doc_id", "tid", "key").join(known, "key").select("doc_id", "tid", "class_id", "n_links", "copy_id", "head_tid")
    alone = rows.where("key IS NULL").select("doc_id", "tid", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("copy_id"), F.col("tid").alias("head_tid"))
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document rows, all columns, with one of each class: that of the least doc_id (of repeated rows, one; rows
    of one doc_id that head different classes all stay). Only rows that others repeat or join are shuffled."""
    found = stored(_classed(docs), "classed")
    own = F.coalesce(F.md5("text"), F.lit(""))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("keep_id"), own.alias("keep_tid"))
    lone = row.where("keep_id IS NULL")
    key = [F.col("doc_id").alias("keep_id"), F.coalesce("tid", F.lit("")).alias("keep_tid")]
    heads = F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("tid").eqNullSafe(F.col("head_tid"))
    judged = found.where("doc_id IS NOT NULL").select(*key, heads.alias("stays")).groupBy("keep_id", "keep_tid").agg(F.count(F.lit(1)).alias("n"), F.max("stays").alias("stays"))
    changed = stored(judged.where("n > 1 OR NOT stays"), "changed")
    some, rest = KeyFilter(changed, "keep_id", "keep_tid").split(row.where("keep_id IS NOT NULL"))
    once = Window.partitionBy("keep_id", "keep_tid").orderBy("keep_id")
    firsts = some.withColumn("nth", F.row_number().over(once)).where("nth = 1")  # tasks drop repeats before they shuffle
    kept = firsts.join(changed, ["keep_id", "keep_tid"], "left").where(F.coalesce("stays", F.lit(True)))
    return rest.select("row.*").unionByName(kept.select("row.*")).unionByName(lone.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 over the whole documents table: every document with its class, its copies' class and its links."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("tid")
