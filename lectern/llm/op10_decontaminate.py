"""Benchmark decontamination by Wu-Manber multi-pattern search.

Test items become windows of 13 consecutive folded words. Window strings are searched in the folded
documents: a block shift table skips positions at which no window can end, a suffix-hash bucket selects the
windows that may end there, and a direct comparison confirms each occurrence. Many cursors advance at once,
so every step is a numpy operation over one flat byte array.

The benchmark is gathered in blocks of bounded size, one on the driver and in a worker at a time. All blocks but
the last are jobs of their own, which write what they found by the text's digest, for texts that are hit alone; the
last one joins that to the rows it may belong to. So a larger benchmark costs passes over the texts and not memory,
and no pass rewrites the documents.

Defined results: a null or wordless text has no words and no hits; items without a word are no items; the windows
of an item with a null id hit, but it is not among the items found; equal item ids count once; repeated document
rows each keep a row; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.textkit import FOLD, KeyFilter, column_bytes, fold_words, row_chunks, small_batches, stored

WINDOW = 13
#: Bytes of item text that one pass searches, and bytes of document text in one flat array.
BLOCK_BYTES, CHUNK_BYTES, SEGMENT = 4 << 20, 4 << 20, 2048
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WindowClass:
    """Shift and bucket tables of windows of similar length."""

    def __init__(self, text: bytes, start: np.ndarray, length: np.ndarray, owner: list[np.ndarray]) -> None:
        self.text, self.m = text, int(length.min())
        self.block = max(1, min(16, self.m // 2))
        flat = np.frombuffer(text, np.uint8)
        bits = int(np.clip(np.ceil(np.log2(4.0 * len(start) * max(1, self.m - self.block + 1))), 10, 22))
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, self.m - self.block + 1, np.int32)
        for j in range(self.block, self.m + 1):  # ascending, so that the smallest shift is written last
            self.shift[self._slot(self.key(flat, start + j))] = self.m - j
        suffix = self.key(flat, start + self.m)
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.start, self.length = suffix[order], start[order], length[order]
        self.owner = [owner[i] for i in order]
        self.head = self._head(flat, self.start)

    def key(self, flat: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the block of bytes before each position."""
        b = self.block
        got = np.zeros((len(end), 16 if b > 8 else 8), np.uint8)
        got[:, :b] = flat[(end - b)[:, None] + np.arange(b)]
        words = got.view(np.uint64)
        out = words[:, 0] * _MIX
        if b > 8:
            out = (out ^ (out >> np.uint64(29)) ^ words[:, 1]) * _MIX
        return out ^ (out >> np.uint64(32))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * _MIX) >> self.down).astype(np.int64)

    def _head(self, flat: np.ndarray, start: np.ndarray) -> np.ndarray:
        width = min(8, self.m)
        got = np.zeros((len(start), 8), np.uint8)
        got[:, :width] = flat[start[:, None] + np.arange(width)]
        return got.view(np.uint64)[:, 0]

    def find(self, raw: bytes, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start byte and window number of every occurrence in `flat`."""
        n = len(flat)
        if n < self.m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low = np.arange(self.m, n + 1, SEGMENT, dtype=np.int64)
        at, stop = low.copy(), np.minimum(low + SEGMENT, n + 1)
        places, windows = [], []
        while len(at):
            key = self.key(flat, at)
            step = self.shift[self._slot(key)]
            here = np.flatnonzero(step == 0)
            if len(here):
                first = np.searchsorted(self.suffix, key[here], side="left")
                count = np.searchsorted(self.suffix, key[here], side="right") - first
                pick = np.repeat(np.arange(len(here)), count)
                if len(pick):
                    rank = np.arange(len(pick)) - np.repeat(np.cumsum(count) - count, count)
                    window, place = first[pick] + rank, at[here][pick] - self.m
                    fits = np.flatnonzero((place + self.length[window] <= n) & (self._head(flat, place) == self.head[window]))
                    for p, w in zip(place[fits].tolist(), window[fits].tolist(), strict=True):
                        s, size = int(self.start[w]), int(self.length[w])
                        if raw[p : p + size] == self.text[s : s + size]:
                            places.append(p)
                            windows.append(w)
            at = at + np.maximum(step, 1)
            alive = at < stop
            at, stop = at[alive], stop[alive]
        return np.array(places, np.int64), np.array(windows, np.int64)


class Matcher:
    """The windows of one block of test items, in classes by the power of two of their length."""

    def __init__(self, items: list[tuple[str | None, str | None]]) -> None:
        parts, size = [], 0
        spans: dict[bytes, tuple[int, set[int]]] = {}
        self.items: list[str] = []
        number: dict[str, int] = {}
        for item_id, text in items:
            words = fold_words(text)
            if not words:
                continue
            if item_id is not None and item_id not in number:
                number[item_id] = len(self.items)
                self.items.append(item_id)
            flat = b" " + b" ".join(words) + b" "
            ends = np.cumsum([0] + [len(w) + 1 for w in words])
            width = min(WINDOW, len(words))
            for i in range(len(words) - width + 1):
                a, b = int(ends[i]), int(ends[i + width]) + 1
                owners = spans.setdefault(hashlib.blake2b(flat[a:b], digest_size=16).digest() + (b - a).to_bytes(8, "little"), (size + a, set()))[1]
                if item_id is not None:
                    owners.add(number[item_id])
            parts.append(flat)
            size += len(flat)
        text = b"".join(parts)
        groups: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        for key, (start, owners) in spans.items():
            length = int.from_bytes(key[16:], "little")
            groups.setdefault(min(length.bit_length(), 6), []).append((start, length, np.array(sorted(owners), np.int64)))
        self.classes = [
            WindowClass(text, np.array([g[0] for g in group]), np.array([g[1] for g in group]), [g[2] for g in group])
            for group in groups.values()
        ]

    def search(self, docs: list[bytes]) -> tuple[list[int], list[np.ndarray], list[list[str]]]:
        """For folded documents, each ` w1 w2 ... `: words, hit word ranges (start, end) and item ids."""
        raw = b"\n".join(docs) + b"\n"
        flat = np.frombuffer(raw, np.uint8)
        spaces = np.flatnonzero(flat == 32)
        ends = np.cumsum([len(d) + 1 for d in docs])
        first = np.searchsorted(spaces, ends - np.array([len(d) + 1 for d in docs]))
        count = np.maximum(np.diff(np.append(first, len(spaces))) - 1, 0)
        ranges: list[list[tuple[int, int]]] = [[] for _ in docs]
        items: list[set[str]] = [set() for _ in docs]
        for group in self.classes:
            place, window = group.find(raw, flat)
            if not len(place):
                continue
            doc = np.searchsorted(ends, place, side="right")
            a = np.searchsorted(spaces, place) - first[doc]
            b = np.searchsorted(spaces, place + group.length[window] - 1) - first[doc]
            for d, x, y, w in zip(doc.tolist(), a.tolist(), b.tolist(), window.tolist(), strict=True):
                ranges[d].append((x, y))
                items[d].update(self.items[i] for i in group.owner[w])
        return count.tolist(), [np.array(r, np.int64).reshape(-1, 2) for r in ranges], [sorted(x) for x in items]


def covered(ranges: np.ndarray) -> int:
    """How many words lie in any of the ranges."""
    if not len(ranges):
        return 0
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    before = np.concatenate([[ranges[0, 0]], reach[:-1]])
    return int(np.maximum(0, ranges[:, 1] - np.maximum(ranges[:, 0], before)).sum())


def folded(column: pa.Array) -> Iterator[list[bytes]]:
    """The folded documents of a text column, in chunks of bounded size."""
    flat, offsets = column_bytes(column)
    for a, b in row_chunks(offsets, CHUNK_BYTES):
        data = flat[offsets[a] : offsets[b]].tobytes().translate(FOLD)
        cuts = (offsets[a : b + 1] - offsets[a]).tolist()
        docs = (data[x:y].split() for x, y in zip(cuts, cuts[1:], strict=False))
        yield [b" " + b" ".join(words) + b" " if words else b"" for words in docs]


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list[tuple[str | None, str | None]], bool]]:
    """The test items in blocks of about `block_bytes`, by a hash of the item id (or else the text), and whether a block is the last;
    one block is on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("t IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64(F.coalesce("i", "t")), F.lit(blocks)) == k)
        yield [(r.i, r.t) for r in part.toLocalIterator()], k == blocks - 1


FOUND = T.StructType().add("ranges", "binary").add("items", T.ArrayType(T.StringType()))


def _search(column: pa.Array, matcher: Matcher) -> tuple[list[int], list[np.ndarray], list[list[str]]]:
    """Words, hit word ranges and item ids of every text of a column."""
    words: list[int] = []
    ranges: list[np.ndarray] = []
    names: list[list[str]] = []
    for docs in folded(column):
        for all_, some in zip((words, ranges, names), matcher.search(docs), strict=True):
            all_ += some
    return words, ranges, names


def _hits(docs: DataFrame, items: list[tuple[str | None, str | None]]) -> DataFrame:
    """(tid, ranges, items) of the distinct texts that one block's windows hit, written to the shared folder."""
    shared = docs.sparkSession.sparkContext.broadcast(Matcher(items))
    out = T.StructType([T.StructField("tid", T.StringType()), *FOUND.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, ranges, names = _search(batch.column(1), shared.value)
            hit = [k for k, r in enumerate(ranges) if len(r)]
            tid = batch.column(0).take(pa.array(hit, pa.int64()))
            yield pa.RecordBatch.from_arrays([tid, pa.array([ranges[k].tobytes() for k in hit], pa.binary()), pa.array([names[k] for k in hit], pa.list_(pa.string()))], names=out.fieldNames())

    texts = docs.where("text IS NOT NULL").select(F.md5("text").alias("tid"), "text")
    found = stored(texts.mapInArrow(run, out).dropDuplicates(["tid"]), "hits")
    shared.unpersist()
    return found


def searched(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    schema: T.StructType,
    finish: Callable[[pa.StructArray, list[int], list[int], list[list[str]]], list[pa.Array]],
    block_bytes: int,
) -> DataFrame:
    """Hands the columns `keep`, with the words, the hit words and the items found of each row, to `finish`, which
    makes the columns of `schema`."""
    context = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    frame = docs.select(row, F.col("text").alias("body"), F.lit(None).cast(T.ArrayType(FOUND)).alias("found"))
    before: list[DataFrame] = []
    for items, last in benchmark_blocks(benchmark, block_bytes):
        if not last:
            before.append(_hits(docs, items))
    if before:
        every = reduce(DataFrame.unionByName, before).groupBy("tid").agg(F.collect_list(F.struct("ranges", "items")).alias("found"))
        every = stored(every, "hits")
        some, rest = KeyFilter(every, "tid").split(frame.drop("found").withColumn("tid", F.coalesce(F.md5("body"), F.lit(""))))
        frame = some.join(every, "tid", "left").select("row", "body", "found").unionByName(rest.select("row", "body", F.lit(None).cast(T.ArrayType(FOUND)).alias("found")))
    shared = context.broadcast(Matcher(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ranges, names = _search(batch.column(1), shared.value)
            for k, old in enumerate(batch.column(2).to_pylist()):
                if old:
                    ranges[k] = np.concatenate([*(np.frombuffer(o["ranges"], np.int64).reshape(-1, 2) for o in old), ranges[k]])
                    names[k] = sorted({*names[k], *(i for o in old for i in o["items"])})
            yield pa.RecordBatch.from_arrays(finish(batch.column(0), words, [covered(r) for r in ranges], names), names=schema.fieldNames())

    return frame.mapInArrow(run, schema)


def is_contaminated(words: int, hit: int) -> bool:
    """Whether any word is hit, and at least one in twenty."""
    return hit > 0 and 20 * hit >= words


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the item ids found."""
    out = T.StructType([docs.schema["doc_id"]]).add("n_words", "long").add("n_hit", "long").add("n_items", "long")
    out = out.add("items_sha256", "string").add("contaminated", "boolean").add("items", T.ArrayType(T.StringType()))

    def finish(row: pa.StructArray, words: list[int], hit: list[int], items: list[list[str]]) -> list[pa.Array]:
        return [
            row.flatten()[0],
            pa.array(words, pa.int64()),
            pa.array(hit, pa.int64()),
            pa.array([len(i) for i in items], pa.int64()),
            pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()),
            pa.array([is_contaminated(w, h) for w, h in zip(words, hit, strict=True)], pa.bool_()),
            pa.array(items, pa.list_(pa.string())),
        ]

    return searched(docs, benchmark, ["doc_id"], out, finish, block_bytes)


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The document rows, all columns, in which fewer than one word in twenty lies in a test window."""

    def finish(row: pa.StructArray, words: list[int], hit: list[int], items: list[list[str]]) -> list[pa.Array]:
        return row.filter(pa.array([not is_contaminated(w, h) for w, h in zip(words, hit, strict=True)], pa.bool_())).flatten()

    return searched(docs, benchmark, docs.columns, docs.schema, finish, block_bytes)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 over the whole documents and benchmark tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
