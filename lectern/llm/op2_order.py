"""Training-order materialisation into fixed-stride binary shards.

Documents become token ids in sequences that fill a record. Sequences are numbered by input file, place of the
document in it, and place in the document; a keyed Feistel permutation, walked along its cycle until it lands among
the M numbers in use, gives each a global slot. Numbers do not depend on how files are split among tasks, so the same
files and key give the same order on any cluster. Slots are a permutation, so contiguous ranges of them are equally
large whatever the documents: each range becomes one partition, sorted by slot, and is written as shards of a bounded
number of records.

Ids are of a `Codec`: BYTES takes a text's UTF-8 bytes; `vocabulary_codec` takes the ids that op9 makes, two or four
bytes each. A record is STRIDE bytes: slot, doc_id (little-endian signed 64 bits), sequence number (32), ids in use
(16), the ids, and a line feed that the writer adds. A shard's first slot and a slot's offset are therefore
arithmetic: `read_shards` from a slot on opens only the shards that hold it and later ones. Files go through Spark's
own writer, so any store and a lost executor are handled; its text source writes the bytes of a string as they are.

Records are shuffled deflated and written whole. Frames that are not read from files are written first.

Defined results: a null text has no sequence, an empty one has one that only ends; a null doc_id is written as
the least 64-bit number and read back as null; repeated rows each have their sequences; an empty table has no
records, and reading its folder gives none.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.textkit import column_bytes, row_chunks, shared_dir, small_batches, stored

STRIDE, HEAD, NO_ID = 512, 22, np.iinfo(np.int64).min
#: Records in a shard, at least and at most (32 MB); partitions that write, each one or more whole shards.
LEAST_RECORDS, MOST_RECORDS, WRITERS, ROUNDS = 8192, 65_536, 10_000, 6


_LAYOUT = "total long, in_shard long, each long, source string, width int, end long, pad long"


@dataclass(frozen=True)
class Codec:
    """Ids of `width` bytes each, from the column `source`; `end` follows a document and `pad` fills its last record."""

    source: str
    width: int
    end: int
    pad: int

    @property
    def tokens(self) -> int:
        """Ids in a record."""
        return (STRIDE - HEAD - 1) // self.width

    @property
    def record(self) -> np.dtype:
        """The layout of a record; a byte that ids of two or four bytes leave over is zero."""
        spare = STRIDE - HEAD - 1 - self.tokens * self.width
        fields = [("slot", "<i8"), ("doc_id", "<i8"), ("seq_no", "<u4"), ("n_tokens", "<u2"), ("ids", f"<u{self.width}", self.tokens)]
        return np.dtype([*fields, ("spare", "u1", spare)])

    def packed(self, record: bytes, used: int) -> bytes:
        """A record as it is shuffled: head, and deflated ids in use."""
        return record[:HEAD] + zlib.compress(record[HEAD : HEAD + used * self.width], 6, -15)

    def unpacked(self, record: bytes) -> bytes:
        """The whole record."""
        ids = zlib.decompress(record[HEAD:], -15)
        pads = self.pad.to_bytes(self.width, "little") * (self.tokens - len(ids) // self.width)
        return (record[:HEAD] + ids + pads).ljust(STRIDE - 1, b"\0")


BYTES = Codec("text", 1, 255, 254)


def vocabulary_codec(size: int) -> Codec:
    """The codec of op9's ids (column `ids`, unsigned 32-bit) for a vocabulary of `size` tokens."""
    width = 2 if size <= 65_534 else 4
    return Codec("ids", width, (1 << 8 * width) - 1, (1 << 8 * width) - 2)


class Permutation:
    """A keyed permutation of the numbers below `size`."""

    def __init__(self, size: int, key: int) -> None:
        self.size, bits = size, max(2, int(max(1, size - 1)).bit_length())
        self.half = np.uint64((bits + 1) // 2)
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = np.random.default_rng(key).integers(1, 2**63, ROUNDS).astype(np.uint64)

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys[::-1] if back else self.keys:
            left, right = (right ^ self._round(left, key), left) if back else (right, left ^ self._round(right, key))
        return (left << self.half) | right

    def _walk(self, numbers: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(numbers.astype(np.uint64), back)
        while len(far := np.flatnonzero(out >= self.size)):
            out[far] = self._once(out[far], back)
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        """The slots of sequence numbers."""
        return self._walk(numbers, False)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        """The sequence numbers of slots."""
        return self._walk(slots, True)


def _placed(docs: DataFrame, codec: Codec) -> DataFrame:
    """(file, start, split, doc_id, ids): every document with the part of a file that it is read from, in file order."""
    ids = F.col(codec.source).cast("binary").alias("ids")
    try:
        place = docs.metadataColumn("_metadata")
        rows = docs.select(place["file_path"].alias("file"), place["file_block_start"].alias("start"), F.col("doc_id").cast("long").alias("doc_id"), ids)
    except AnalysisException:  # not read from files
        return _placed(stored(docs.select("doc_id", codec.source), "unordered"), codec)
    return rows.where("ids IS NOT NULL").withColumn("split", F.xxhash64("file", "start"))


def records(docs: DataFrame, key: int, codec: Codec = BYTES) -> tuple[DataFrame, int, int]:
    """(shard, slot, packed record) of every sequence, the number of sequences, and the records in a shard."""
    spark = docs.sparkSession
    small_batches(spark)
    rows, per_id = _placed(docs, codec), 1 if codec.source == "text" else 4
    count = F.ceil((F.octet_length("ids") / per_id + 1) / codec.tokens)
    sizes = rows.groupBy("file", "start", "split").agg(F.sum(count).alias("n")).orderBy("file", "start").collect()  # a row per part of a file
    first, total = {}, 0
    for r in sizes:
        first[r.split], total = total, total + int(r.n)
    if len(first) < len(sizes):
        raise ValueError("two parts of the input have the same hash")
    in_shard = min(MOST_RECORDS, max(LEAST_RECORDS, -(-total // WRITERS)))
    shared = spark.sparkContext.broadcast((first, Permutation(total, key) if total else None))
    out = T.StructType().add("shard", "integer").add("slot", "long").add("record", "binary")
    layout, tokens, width = codec.record, codec.tokens, codec.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, permutation = shared.value
        at = dict(starts)
        for batch in batches:
            split = batch.column(0).to_numpy()
            flat, offsets = column_bytes(batch.column(2), pa.large_binary())
            ids = batch.column(1).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(split[1:] != split[:-1]) + 1, [len(split)]]).tolist()
            ranges = ((x + a, x + b) for x, y in pairwise(cuts) for a, b in row_chunks(offsets[x : y + 1], 4 << 20))
            for a, b in ranges:
                part = int(split[a])
                size = np.diff(offsets[a : b + 1]) // per_id + 1
                many = -(-size // tokens)
                doc = np.repeat(np.arange(b - a), many)
                made = np.zeros(len(doc), layout)
                made["seq_no"] = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                made["doc_id"] = ids[a:b][doc]
                made["n_tokens"] = np.minimum(tokens, size[doc] - made["seq_no"].astype(np.int64) * tokens)
                made["slot"] = permutation.slots(np.arange(at[part], at[part] + len(doc)))
                filled = np.full(len(doc) * tokens, codec.pad, f"<u{width}")
                base = np.cumsum(many * tokens) - many * tokens
                text = flat[offsets[a] : offsets[b]].tobytes()
                given = np.frombuffer(text, "u1" if per_id == 1 else "<u4")
                lead = np.concatenate([[0], np.cumsum(size - 1)[:-1]])
                filled[np.arange(len(given)) + np.repeat(base - lead, size - 1)] = given
                filled[base + size - 1] = codec.end
                made["ids"] = filled.reshape(-1, tokens)
                raw, used = made.tobytes(), made["n_tokens"].tolist()
                value = pa.array([codec.packed(raw[k * layout.itemsize : (k + 1) * layout.itemsize], n) for k, n in enumerate(used)], pa.binary())
                slot = made["slot"].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((slot // in_shard).astype(np.int32)), pa.array(slot), value], names=out.fieldNames())
                at[part] += len(doc)

    return rows.select("split", "doc_id", "ids").mapInArrow(run, out), total, in_shard


def write_shards(docs: DataFrame, folder: str, key: int = 42, codec: Codec = BYTES) -> tuple[int, int]:
    """Writes the shards and their layout under `folder`; returns the number of sequences and the records in a shard."""
    spark = docs.sparkSession
    made, total, in_shard = records(docs, key, codec)
    shards = -(-total // in_shard)
    each = max(1, -(-shards // WRITERS))
    layout = [(total, in_shard, each, codec.source, codec.width, codec.end, codec.pad)]
    spark.createDataFrame(layout, _LAYOUT).coalesce(1).write.json(f"{folder}/layout")
    if total:
        dealt = made.repartitionById(-(-shards // each), F.expr(f"cast(shard div {each} as int)")).sortWithinPartitions("slot")

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([codec.unpacked(r.as_py()) for r in batch.column(0)], pa.binary())], names=["record"])

        lines = dealt.select("record").mapInArrow(whole, "record binary").select(F.col("record").cast("string").alias("value"))
        lines.write.option("lineSep", "\n").option("maxRecordsPerFile", in_shard).text(f"{folder}/shards")
    return total, in_shard


def read_shards(spark: SparkSession, folder: str, first: int = 0) -> DataFrame:
    """(slot, file, byte_offset, doc_id, seq_no, n_tokens, ids_sha256, ids) from slot `first` on; shards before it are
    not opened."""
    out = T.StructType().add("slot", "long").add("file", "string").add("byte_offset", "long").add("doc_id", "long")
    out = out.add("seq_no", "long").add("n_tokens", "long").add("ids_sha256", "string").add("ids", "binary")
    small_batches(spark)
    known = spark.read.schema(_LAYOUT).json(f"{folder}/layout").first()
    if first >= known.total:
        return spark.createDataFrame([], out)
    codec, layout = Codec(known.source, known.width, known.end, known.pad), Codec(known.source, known.width, known.end, known.pad).record

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                file = batch.column(0)[k].as_py().rsplit("/", 1)[-1]
                raw = np.frombuffer(batch.column(1)[k].as_buffer(), np.uint8).reshape(-1, STRIDE)
                lead = int(raw[0, :8].copy().view("<i8")[0]) if len(raw) else 0
                for a in range(max(0, first - lead), len(raw), 4096):
                    got = np.ascontiguousarray(raw[a : a + 4096, : STRIDE - 1]).view(layout)[:, 0]
                    ids = [np.ascontiguousarray(r[:n]).tobytes() for r, n in zip(got["ids"], got["n_tokens"].tolist(), strict=True)]
                    doc = got["doc_id"].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(got["slot"].astype(np.int64)),
                            pa.array([file] * len(got)),
                            pa.array((a + np.arange(len(got))) * STRIDE),
                            pa.array(doc, mask=doc == NO_ID),
                            pa.array(got["seq_no"].astype(np.int64)),
                            pa.array(got["n_tokens"].astype(np.int64)),
                            pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                            pa.array(ids, pa.binary()),
                        ],
                        names=out.fieldNames(),
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/shards").where("length > 0")
    if first:
        part, nth = (F.regexp_extract("path", r"part-([0-9]+)-.*-c([0-9]+)[^/]*$", k).cast("long") for k in (1, 2))
        later = files.where(part * known.each + nth >= first // known.in_shard).select("path")  # names alone are read
        files = spark.read.format("binaryFile").load([r.path for r in later.collect()])
    return files.select("path", "content").mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2 over the whole documents table: shards written to the shared folder, then read back in full."""
    folder = f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    _, in_shard = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    rows = read_shards(spark, folder)
    return rows.select("slot", F.expr(f"slot div {in_shard}").alias("shard"), "byte_offset", "doc_id", "seq_no", "n_tokens", "ids_sha256")
