"""Line dedup by distinct-site spread.

How many sites a line appears on is estimated by a HyperLogLog sketch per line hash, merged by aggregation. A
line clearly above the threshold is boilerplate, one clearly below is not, and a line near it gets an exact
distinct count. Lines that occur fewer times than the threshold cannot reach it.

In the pipeline boilerplate lines are removed from every document that keeps a line of its own; a text all of whose
lines are boilerplate is left alone, for removal would empty it. The query `op1_lines` follows its SQL twin, which
also leaves alone a document in which boilerplate holds more than half of the characters (`spare_most`).

Defined results: a site is a non-null source; a blank line (spaces only) counts for nothing and stays; a null
text stays null with no lines; repeated rows each keep a row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.textkit import KeyFilter, free_name, small_batches, stored

#: Sites that make a line boilerplate; relative band around it that is counted exactly; sketch size (error 2.3 %).
SITES, BAND, LOG_REGISTERS = 10, 0.15, 11
#: Boilerplate lines that are broadcast (16 bytes each); a larger set is joined.
BROADCAST_LINES = 200_000


def _lines(docs: DataFrame, *keep: str) -> DataFrame:
    line = F.explode(F.split("text", "\n", -1)).alias("line")
    return docs.select(*keep, line).where("trim(line) <> ''").select(*keep, F.unhex(F.md5("line")).alias("line"))


def boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """The digests (md5) of lines that appear on `sites` sites or more.

    Counts and sketches of a line are added up within tasks before they are shuffled, so a line of any frequency
    costs its reducer a row a task; the same holds for the pairs of line and site behind the exact counts."""
    lines = _lines(docs.where("source IS NOT NULL"), "source")
    sketch = F.hll_sketch_agg("source", F.lit(LOG_REGISTERS))
    counted = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_estimate(sketch).alias("spread"))
    spread = stored(counted.where((F.col("n") >= sites) & (F.col("spread") >= sites * (1 - BAND))).drop("n"), "spread")
    sure = spread.where(F.col("spread") > sites * (1 + BAND)).select("line")
    near = spread.where(F.col("spread") <= sites * (1 + BAND)).select("line")
    maybe, _ = KeyFilter(near, "line").split(lines)
    pairs = maybe.distinct().join(near, "line", "left_semi")
    exact = pairs.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= sites)
    return sure.unionByName(exact.select("line"))


def _cleaned(text: str | None, known: set[bytes] | frozenset[bytes], spare_most: bool = False) -> tuple[str | None, int, int]:
    """The text without known lines, its lines that aren't blank, and how many were removed; unchanged if all are
    known, or, with `spare_most`, if known lines hold more than half of the characters."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    full = [bool(line.strip(" ")) for line in lines]
    drop = [f and hashlib.md5(line.encode("utf-8", "surrogatepass")).digest() in known for f, line in zip(full, lines, strict=True)]
    gone = sum(len(line) for line, d in zip(lines, drop, strict=True) if d)
    most = 2 * gone > sum(len(line) for line, f in zip(lines, full, strict=True) if f)
    if not gone or sum(drop) == sum(full) or (spare_most and most):
        return text, sum(full), 0
    return "\n".join(line for line, d in zip(lines, drop, strict=True) if not d), sum(full), sum(drop)


def cleaned(docs: DataFrame, sites: int = SITES, broadcast_lines: int = BROADCAST_LINES, spare_most: bool = False) -> tuple[DataFrame, str]:
    """`docs` with cleaned texts and a struct column (n_lines, n_removed); returns the frame and the struct's name."""
    spark = docs.sparkSession
    small_batches(spark)
    known = stored(boilerplate(docs, sites), "boilerplate")
    name = free_name(docs, "cleaning")
    at = docs.columns.index("text")
    out = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType().add("n_lines", "long").add("n_removed", "long"))])
    everywhere = known.count() <= broadcast_lines
    shared = spark.sparkContext.broadcast(frozenset(bytes(r.line) for r in known.toLocalIterator()) if everywhere else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            own = [shared.value] * len(texts) if everywhere else [set(x or ()) for x in batch.column(batch.num_columns - 1).to_pylist()]
            got = [_cleaned(t, k, spare_most) for t, k in zip(texts, own, strict=True)]
            columns = batch.columns[: len(out) - 1]
            columns[at] = pa.array([g[0] for g in got], pa.string())
            counts = [pa.array([g[k] for g in got], pa.int64()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.StructArray.from_arrays(counts, names=["n_lines", "n_removed"])], names=out.fieldNames())

    if everywhere:
        return docs.mapInArrow(run, out), name
    tid, found = free_name(docs, "tid"), free_name(docs, "found")
    marked = docs.withColumn(tid, F.md5("text"))
    texts = marked.select(tid, "text").where(f"`{tid}` IS NOT NULL")
    held = _lines(texts, tid).join(known, "line", "left_semi").groupBy(tid).agg(F.collect_set("line").alias(found))
    return marked.join(held, tid, "left").select(*docs.columns, found).mapInArrow(run, out), name


def without_boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """The document rows, all columns, with cleaned texts; n_chars, if there, is counted anew."""
    frame, name = cleaned(docs, sites)
    frame = frame.drop(name)
    return frame.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else frame


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 over the whole documents table: per document its lines, those removed, and the digest of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    frame, name = cleaned(docs, spare_most=True)
    return frame.select("doc_id", F.col(f"{name}.n_lines"), F.col(f"{name}.n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = f"""
WITH lines AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents),
known AS (SELECT list(line) AS known FROM (
    SELECT line FROM lines WHERE trim(line, ' ') <> '' GROUP BY line HAVING count(DISTINCT source) >= {SITES})),
split AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts, coalesce(known, []) AS known FROM documents, known),
counted AS (SELECT *,
    list_filter(parts, lambda x: trim(x, ' ') <> '') AS filled,
    list_filter(parts, lambda x: trim(x, ' ') <> '' AND list_contains(known, x)) AS dropped FROM split),
judged AS (SELECT *, len(dropped) > 0 AND 2 * coalesce(list_sum(list_transform(dropped, lambda x: length(x))), 0)
    <= coalesce(list_sum(list_transform(filled, lambda x: length(x))), 0) AS cut FROM counted)
SELECT doc_id, coalesce(len(filled), 0) AS n_lines, CASE WHEN cut THEN len(dropped) ELSE 0 END AS n_removed,
    sha256(coalesce(CASE WHEN cut THEN array_to_string(list_filter(parts, lambda x: trim(x, ' ') = '' OR NOT list_contains(known, x)), chr(10))
        ELSE text END, '')) AS kept_sha256
FROM judged
"""
