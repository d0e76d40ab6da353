"""Queries behind kernels, layout, settings, manifests and streams. Driver tables and small fixtures stand in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import kernels
from lectern.functions import text as X
from lectern.operators import config, layout, normalizing
from lectern.plans.text_queries import LINES, WORDS, registry
from lectern.session import shared_folder, table
from lectern.streaming import progress as stream

QUERIES, ORACLE, query = registry()


@query()
def number_forms(spark, sf_dir):
    """Digit forms of number phrases, over documents and a phrase made of each part's size."""
    words = F.element_at(F.array(*[F.lit(w) for w in kernels.ONES.split()]), (F.col("p_size") % 20) + 1)
    tens = F.element_at(F.array(*[F.lit(w) for w in kernels.TENS.split()]), (F.col("p_partkey") % 8).cast("int") + 1)
    phrase = F.concat(tens, F.lit(" "), words, F.lit(" thousand and "), words, F.lit(" percent"))
    rows = table(spark, sf_dir, "part").select("p_partkey", phrase.alias("phrase"))
    return rows.select("p_partkey", "phrase", F.array_join(kernels.number_forms("phrase"), " ").alias("forms"))


#: DuckDB: a text as a JSON string body with non-ASCII characters escaped, as far as the tables' characters go.
_JSON = "array_to_string(list_transform(string_split(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), ''), lambda c: CASE WHEN c = chr(9) THEN '\\t' WHEN ord(c) > 65535 THEN '\\u' || printf('%04x', 55296 + (ord(c) - 65536) // 1024) || '\\u' || printf('%04x', 56320 + (ord(c) - 65536) % 1024) WHEN ord(c) > 126 OR ord(c) < 32 THEN '\\u' || printf('%04x', ord(c)) ELSE c END), '')"


@query(f"""SELECT doc_id, sha256('{{"engine":"gemini","model":"m","sample_rate":24000,"speed":1.0,"style":"","text":"' || {_JSON} || '","v":1,"voice":"Charon"}}') AS cache_key FROM documents""")
def cache_keys(spark, sf_dir):
    """Keys of requests for all texts."""
    one = [F.lit(x) for x in ("gemini", "m", "Charon", "")]
    return table(spark, sf_dir, "documents").select("doc_id", kernels.cache_key(*one, F.lit(1.0), F.lit(24000), "text").alias("cache_key"))


@query()
def markup_clean(spark, sf_dir):
    """Leftover markup removed from every document, with what was found."""
    rows = table(spark, sf_dir, "documents").select("doc_id", kernels.cleaned_markup("text").alias("c"))
    return rows.select("doc_id", F.sha2("c.text", 256).alias("text_sha256"), F.col("c.touched").alias("touched"))


@query()
def match_forms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", kernels.match_form("text").alias("form"))


@query()
def page_outline(spark, sf_dir):
    return normalizing.headings(table(spark, sf_dir, "pages"))


@query()
def short_article_gate(spark, sf_dir):
    return normalizing.article_words(table(spark, sf_dir, "pages"))


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as Markdown sources: roles as headings, turns as paragraphs, lists, tables and fences."""
    body = (
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit("# "), F.col("role"), F.lit("\n\n"), F.col("text")))
        .when(F.col("turn") % 4 == 1, F.concat(F.lit("## "), F.col("role"), F.lit("\n\n- "), F.replace("text", F.lit("\n"), F.lit("\n- "))))
        .when(F.col("turn") % 4 == 2, F.concat(F.lit("### "), F.col("role"), F.lit("\n\n| a | b |\n|---|---|\n| one | two |\n\n```sql\nselect 1\n```\n\n"), F.col("text")))
        .otherwise(F.concat(F.lit("## Sources\n\n"), F.col("text")))
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("part"))
    return rows.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "\n\n").alias("text"))


@query()
def normalize_markdown(spark, sf_dir):
    spoken, _ = normalizing.normalised(_markdown(spark, sf_dir))
    return spoken


@query()
def normalize_omissions(spark, sf_dir):
    _, omitted = normalizing.normalised(_markdown(spark, sf_dir))
    return omitted.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("omissions"))


def _pdf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines as lines of a page, placed by arithmetic on their numbers."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    n = F.col("line_no")
    top = 800.0 - 75.0 * (n % 10)
    return rows.select("doc_id", "line_no", F.floor(n / 10).cast("int").alias("page"), F.floor(n / 3).cast("int").alias("box"), (n % 7 * 40.0).alias("x0"), (top - 10).alias("y0"), top.alias("y1"), (9.0 + n % 3).alias("size"), (n % 5 == 0).alias("bold"), "text")


def _boxes(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(600.0).alias("x1"), F.lit(800.0).alias("y1"))


_PDF = f"l AS (SELECT doc_id, line - 1 AS line_no, text, (line - 1) // 10 AS page, (line - 1) // 3 AS box, (line - 1) % 7 * 40.0 AS x0, 800.0 - 75.0 * ((line - 1) % 10) AS y1, 9.0 + (line - 1) % 3 AS size FROM {LINES})"


@query(f"""WITH {_PDF}, w AS (SELECT doc_id, size, sum(greatest(1, {WORDS.format('text')})) AS n, min(line_no) AS first FROM l GROUP BY doc_id, size)
    SELECT doc_id, size::DOUBLE AS body FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1""")
def font_mode(spark, sf_dir):
    return layout.body_size(_pdf_lines(spark, sf_dir))


@query(rf"""WITH {_PDF}, b AS (SELECT *, y1 >= 736 OR y1 - 10 <= 64 AS band, regexp_replace(lower(text), '[^a-z]', '', 'g') AS letters FROM l)
    SELECT doc_id, line_no, band AND ((length(letters) >= 4 AND count(*) OVER (PARTITION BY doc_id, band, letters) >= 2) OR regexp_full_match(trim(text), '([Pp]age\s+)?\d+(\s*(/|of)\s*\d+)?')) AS dropped FROM b""")
def header_footer(spark, sf_dir):
    lines = _pdf_lines(spark, sf_dir)
    return layout.running_heads(lines, _boxes(lines)).select("doc_id", "line_no", "dropped")


@query()
def reading_order(spark, sf_dir):
    return layout.reading_order(_pdf_lines(spark, sf_dir)).select("doc_id", "line_no", "column", "rank")


@query()
def font_headings(spark, sf_dir):
    return layout.font_headings(_pdf_lines(spark, sf_dir))


@query("""WITH l AS (SELECT 'env' AS layer, s_name AS key, CASE WHEN s_suppkey % 3 = 0 THEN 'e' || s_suppkey END AS value, 0 AS rank FROM supplier
    UNION ALL SELECT 'file', s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'f' || s_suppkey END, 1 FROM supplier UNION ALL SELECT 'default', s_name, 'd', 2 FROM supplier)
    SELECT key, arg_min(value, rank) AS value, arg_min(layer, rank) AS origin FROM l WHERE value IS NOT NULL GROUP BY key""")
def config_layers(spark, sf_dir):
    """Suppliers' names stand for setting names."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("key"), F.col("s_suppkey").alias("n"))
    env = rows.select(F.lit("env").alias("layer"), "key", F.when(F.col("n") % 3 == 0, F.concat(F.lit("e"), "n")).alias("value"))
    file = rows.select(F.lit("file").alias("layer"), "key", F.when(F.col("n") % 2 == 0, F.concat(F.lit("f"), "n")).alias("value"))
    return config.resolved(env.unionByName(file).unionByName(rows.select(F.lit("default").alias("layer"), "key", F.lit("d").alias("value"))))


@query("""WITH v AS (SELECT p_partkey, p_size AS a, p_partkey % 50 AS b FROM part)
    SELECT p_partkey, CASE WHEN b = 0 THEN 'remote_unknown' WHEN a > b THEN 'remote_older' WHEN a < b THEN 'local_older' ELSE 'same' END AS outcome FROM v""")
def build_compare(spark, sf_dir):
    """Part sizes and numbers stand for minor versions."""
    minor = F.col("p_partkey") % 50
    local, remote = F.concat(F.lit("1."), F.col("p_size"), F.lit(".0")), F.when(minor > 0, F.concat(F.lit("1."), minor, F.lit(".0")))
    return table(spark, sf_dir, "part").select("p_partkey", config.compared(local, remote, F.lit("abc"), F.lit("abc")).alias("outcome"))


@query()
def manifest_build(spark, sf_dir):
    """Nested manifests: each conversation's chapters as an ordered array of structs, and as JSON."""
    rows = table(spark, sf_dir, "conversations").withColumn("words", X.word_count(F.col("text")))
    parts = F.array_sort(F.collect_list(F.struct(F.col("turn").alias("index"), F.col("role").alias("title"), "words")))
    made = rows.groupBy("conv_id").agg(parts.alias("chapters"), F.sum("words").alias("words"))
    manifest = F.struct(F.lit(1).alias("schema_version"), F.col("conv_id").cast("string").alias("episode_id"), "chapters", "words")
    return made.select("conv_id", F.to_json(manifest).alias("manifest"), F.size("chapters").alias("chapters"))


@query("SELECT user_id AS run, event_type AS stage, max(event_id) AS seq, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def progress_stream(spark, sf_dir):
    """The streaming twin of progress_latest, run to the end of what is there."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.drained(stream.latest(source), f"{shared_folder(spark)}/progress-{uuid.uuid4().hex}", "complete")
