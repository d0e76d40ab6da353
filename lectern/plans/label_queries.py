"""Queries on what is shown, published or reused. Driver tables stand in for episodes and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import labels as L
from lectern.plans.text_queries import registry
from lectern.session import table

QUERIES, ORACLE, query = registry()


@query("""WITH s AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'docs/' || page_id || '.PDF' WHEN 2 THEN 'note:2024/' || page_id ELSE 'notes/' || page_id || '.md' END AS source FROM pages)
    SELECT page_id, CASE WHEN regexp_matches(source, '(?i)^https?://') THEN 'url' WHEN ends_with(lower(source), '.pdf') THEN 'pdf' WHEN regexp_matches(source, '^[A-Za-z_][\\w+.\\-]*:.+') THEN 'reference' ELSE 'path' END AS kind FROM s""")
def source_kinds(spark, sf_dir):
    n = F.col("page_id") % 4
    source = F.when(n == 0, F.col("url")).when(n == 1, F.concat(F.lit("docs/"), "page_id", F.lit(".PDF"))).when(n == 2, F.concat(F.lit("note:2024/"), "page_id")).otherwise(F.concat(F.lit("notes/"), "page_id", F.lit(".md")))
    return table(spark, sf_dir, "pages").select("page_id", L.source_kind(source).alias("kind"))


@query("""SELECT page_id, (page_id % 7 = 0) OR (CASE page_id % 3 WHEN 0 THEN 403 WHEN 1 THEN 200 ELSE 503 END IN (403, 429, 503)
    AND (contains(lower(left(html, 262144)), 'footer') OR contains(lower(left(html, 262144)), 'captcha'))) AS challenged FROM pages""")
def bot_challenges(spark, sf_dir):
    status = F.when(F.col("page_id") % 3 == 0, 403).when(F.col("page_id") % 3 == 1, 200).otherwise(503)
    header = F.when(F.col("page_id") % 7 == 0, "Challenge")
    return table(spark, sf_dir, "pages").select("page_id", L.challenged(status, header, F.col("html"), ["footer", "captcha"]).alias("challenged"))


@query("""WITH d AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS asked, c_custkey % 2 = 0 AS automatic,
        CASE c_custkey % 3 WHEN 0 THEN 'research' WHEN 1 THEN 'document' END AS kind FROM customer)
    SELECT c_custkey, coalesce(asked, automatic AND (kind IS NULL OR kind IN ('research', 'article'))) AS publish FROM d""")
def publish_decision(spark, sf_dir):
    key = F.col("c_custkey")
    asked, kind = F.when(key % 5 == 0, True).when(key % 5 == 1, False), F.when(key % 3 == 0, "research").when(key % 3 == 1, "document")
    return table(spark, sf_dir, "customer").select("c_custkey", L.publishes(asked, key % 2 == 0, kind).alias("publish"))


@query("""WITH s AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS n, o_orderkey % 9000 AS t FROM orders)
    SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' bytes' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) ELSE printf('%.1f MB', n / 1048576) END AS size,
    CASE WHEN t < 10 THEN printf('%.1fs', t::DOUBLE) WHEN t < 60 THEN t || 's' WHEN t < 3600 THEN printf('%dm %02ds', t // 60, t % 60) ELSE printf('%dh %02dm', t // 3600, t // 60 % 60) END AS lasts,
    printf('%d:%02d', t // 60, t % 60) AS clock FROM s""")
def display_values(spark, sf_dir):
    seconds = (F.col("o_orderkey") % 9000).cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", L.byte_size(F.floor("o_totalprice").cast("long")).alias("size"), L.duration(seconds).alias("lasts"), L.clock(seconds).alias("clock"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S +0000') AS published FROM orders")
def feed_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", L.mail_date(F.col("o_orderdate")).alias("published"))


@query("""SELECT user_id, event_type, count(*) AS events, round(sum(json_extract(props, '$.k')::DOUBLE), 4) AS total FROM events GROUP BY 1, 2""")
def json_objects(spark, sf_dir):
    """Paths read out of the last JSON object of a text; the lines before it are noise."""
    noisy = F.concat(F.lit("noise {\n"), "props")
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.try_variant_get(L.last_object(noisy), "$.k", "double").alias("k"))
    return rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("k"), 4).alias("total"))


@query("""SELECT o_custkey AS feed, sum(length('<item><title>' || o_orderpriority || '</title><guid isPermaLink="false">' || o_orderkey || '@' || left(sha256(o_orderstatus), 8) || '</guid>')) AS length FROM orders GROUP BY 1""")
def feed_heads(spark, sf_dir):
    """Lengths of the opening of every feed item, which names its title and id."""
    item = L.feed_item(F.col("o_orderpriority"), F.concat(F.col("o_orderkey").cast("string"), F.lit("@"), F.substring(F.sha2("o_orderstatus", 256), 1, 8)), L.mail_date(F.col("o_orderdate")), F.lit("about"), F.lit("https://h/x.mp3"), F.lit(1))
    return table(spark, sf_dir, "orders").withColumn("item", F.substring_index(item, "<pubDate>", 1)).groupBy(F.col("o_custkey").alias("feed")).agg(F.sum(F.length("item")).alias("length"))


@query()
def feed_xml(spark, sf_dir):
    """A feed for each conversation: its turns as chapters of one item, in an RSS document."""
    starts = F.array_sort(F.collect_list(F.struct(F.col("turn").alias("n"), (F.col("turn") * 61_500).alias("start_ms"), F.col("role").alias("title"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(starts.alias("chapters"))
    title = F.concat(F.lit("Talk <"), F.col("conv_id").cast("string"), F.lit(">"))
    item = L.feed_item(title, F.concat(F.col("conv_id").cast("string"), F.lit("@x")), F.lit("Mon, 01 Jan 2024 00:00:00 +0000"), L.description(title, F.col("chapters"), F.lit("https://h/a?b=1&c=2")), F.lit("https://h/a.mp3"), F.lit(7))
    return rows.select("conv_id", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel>'), item, F.lit("</channel></rss>")).alias("xml"))


@query("""WITH w AS (SELECT o_custkey AS source, o_orderpriority AS edition, o_orderstatus AS model, max(o_orderkey) AS run FROM orders GROUP BY ALL),
    a AS (SELECT c_custkey AS source, '1-URGENT' AS edition, 'F' AS model FROM customer) SELECT source, run FROM a LEFT JOIN w USING (source, edition, model)""")
def writer_reuse(spark, sf_dir):
    """Scripts reused only where source, edition and model all match; null where they are to be written."""
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source"), F.col("o_orderpriority").alias("edition"), F.col("o_orderstatus").alias("model")).agg(F.max("o_orderkey").alias("run"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source"), F.lit("1-URGENT").alias("edition"), F.lit("F").alias("model"))
    return asked.join(runs, ["source", "edition", "model"], "left").select("source", "run")


@query("""SELECT o_orderkey, o_orderkey % 5 + 1 AS stages, CASE WHEN sum(CASE WHEN l_quantity < 5 THEN 1 ELSE 0 END) > 0 THEN 'failed' ELSE 'done' END AS outcome,
    min(CASE WHEN l_quantity < 5 THEN l_linenumber END) AS first_failed FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def episode_gates(spark, sf_dir):
    """Gates in order, the first failure named; order lines stand for gates, small quantities for failures."""
    failed = F.when(F.col("l_quantity") < 5, F.col("l_linenumber"))
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("o_orderkey").agg((F.first("o_orderkey") % 5 + 1).alias("stages"), F.when(F.count(failed) > 0, "failed").otherwise("done").alias("outcome"), F.min(failed).alias("first_failed"))
