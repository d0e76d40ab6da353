"""Queries on credits, dates, links, runs and feed removals. Driver tables stand in for sources, attempts and episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import credits as C
from lectern.operators import delivery as D
from lectern.plans.text_queries import registry
from lectern.session import table

QUERIES, ORACLE, query = registry()

_STALE = "Podcast apps keep audio they already downloaded: in AntennaPod, delete this episode''s download and download it again."


@query("""WITH r AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN c_name WHEN 2 THEN c_name || ' and  Bo' WHEN 3 THEN 'A, B, ' || c_name WHEN 4 THEN c_name || '; B and C ; D;' ELSE ' ; X, ' || c_name END AS raw FROM customer),
    g AS (SELECT c_custkey, list_filter(list_transform(flatten(list_transform(string_split(raw, ';'), lambda p: string_split_regex(trim(p), '\\s+and\\s+'))), lambda x: trim(x)), lambda x: x <> '') AS given FROM r),
    a AS (SELECT c_custkey, CASE WHEN len(given) = 1 AND len(given[1]) - len(replace(given[1], ',', '')) >= 2 THEN list_filter(list_transform(string_split(given[1], ','), lambda x: trim(x)), lambda x: x <> '') ELSE given END AS names FROM g)
    SELECT c_custkey, len(names) AS n, CASE len(names) WHEN 0 THEN '' WHEN 1 THEN names[1] WHEN 2 THEN names[1] || ' and ' || names[2]
        WHEN 3 THEN names[1] || ', ' || names[2] || ', and ' || names[3] ELSE names[1] || ' and colleagues' END AS credit FROM a""")
def author_credits(spark, sf_dir):
    key, name = F.col("c_custkey") % 6, F.col("c_name")
    raw = (
        F.when(key == 0, "").when(key == 1, name).when(key == 2, F.concat(name, F.lit(" and  Bo"))).when(key == 3, F.concat(F.lit("A, B, "), name))
        .when(key == 4, F.concat(name, F.lit("; B and C ; D;"))).otherwise(F.concat(F.lit(" ; X, "), name))
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", C.authors(raw).alias("names"))
    return rows.select("c_custkey", F.size("names").alias("n"), C.credit(F.col("names")).alias("credit"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS made,
    CASE o_orderkey % 4 WHEN 3 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS stamped,
    CASE o_orderkey % 5 WHEN 4 THEN '2024-02-31' WHEN 3 THEN 'spring' ELSE strftime(o_orderdate, '%B %-d, %Y') END AS shown FROM orders""")
def source_dates(spark, sf_dir):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    made = F.when(key % 3 == 0, F.concat(F.lit(" D:"), F.date_format(day, "yyyyMMdd"), F.lit("093000Z"))).when(key % 3 == 1, F.date_format(day, "yyyy-MM-dd'T'HH")).otherwise("D:2024")
    stamped = F.when(key % 4 == 3, "on 4 Abc 2024").otherwise(F.concat(F.lit("v1 [x] "), F.date_format(day, "d  MMM yyyy"), F.lit(" 3 Jan 1999")))
    shown = F.when(key % 5 == 4, "2024-02-31").when(key % 5 == 3, " 'spring' ").when(key % 5 == 2, F.date_format(day, "yyyyMMdd")).otherwise(F.concat(F.lit('"'), F.date_format(day, "yyyy-MM-dd"), F.lit('"')))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.document_date(made).alias("made"), C.stamp_date(stamped).alias("stamped"), C.shown_date(shown).alias("shown"))


@query("""WITH s AS (SELECT page_id, url, page_id % 5 AS k FROM pages)
    SELECT page_id, CASE k WHEN 0 THEN url WHEN 1 THEN 'https://notes.test/a' || page_id || '?x={}' ELSE '' END AS link, replace(url, 'e', '****') AS masked,
        regexp_replace(lower(url), '[^a-z0-9]', '', 'g') AS letters, k = 2 AS keyed,
        trim(left(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 60), '-') || '-' || left(sha256(page_id::VARCHAR), 6) AS folder FROM s""")
def source_links(spark, sf_dir):
    page, k = F.col("page_id").cast("string"), F.col("page_id") % 5
    ref = F.when(k == 1, F.concat(F.lit("note:a"), page)).when(k == 2, F.concat(F.lit("other:"), page)).when(k == 3, F.concat(F.lit("odd:"), page)).when(k == 4, page)
    link = C.source_link(F.when(k == 0, F.col("url")), ref, {"note": "https://notes.test/{path}?x={{}}", "odd": "https://odd.test/{name}"})
    key = F.when(k == 2, F.sha2("url", 256)).when(k == 3, F.upper(F.sha2("url", 256))).otherwise(F.md5("url"))
    return table(spark, sf_dir, "pages").select("page_id", link.alias("link"), C.masked(F.col("url"), F.lit("e")).alias("masked"), C.letters_digits(F.col("url")).alias("letters"), C.valid_key(key).alias("keyed"), C.source_folder(F.col("url"), page).alias("folder"))


@query("""SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ' (Brief)' WHEN 1 THEN ' (Full)' WHEN 2 THEN ' (Reading)' ELSE '' END AS title,
    CASE p_partkey % 4 WHEN 0 THEN 'A short narrated briefing: the article''s question, answer, and deciding evidence.'
        WHEN 1 THEN 'A full-length narrated adaptation of the whole article — not a word-for-word reading.'
        WHEN 2 THEN 'The article text read aloud; code, tables, and figures are omitted.' ELSE '' END AS coverage FROM part""")
def edition_texts(spark, sf_dir):
    edition = F.element_at(F.array(*map(F.lit, ("brief", "full", "verbatim", "digest"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", C.edition_title(F.col("p_name"), edition).alias("title"), C.coverage(edition).alias("coverage"))


@query("""SELECT p_brand AS lexicon, sha256(string_agg(term || chr(9) || p_type, chr(10) ORDER BY term)) AS sha256
    FROM (SELECT p_brand, p_name || ' ' || p_partkey AS term, p_type FROM part) GROUP BY p_brand""")
def lexicon_digests(spark, sf_dir):
    return D.lexicon_digests(table(spark, sf_dir, "part").select(F.col("p_brand").alias("lexicon"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("term"), F.col("p_type").alias("spoken")))


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'pdf' ELSE 'path' END AS kind, CASE o_orderkey % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'verbatim' WHEN 2 THEN 'brief' END AS edition,
        o_orderkey % 5 = 0 AS dry, o_orderkey % 7 < 3 AS publish FROM orders)
    SELECT o_orderkey, 'source' || CASE WHEN kind <> 'path' AND coalesce(edition, 'brief') <> 'verbatim' THEN ',write' ELSE '' END || ',plan'
        || CASE WHEN dry THEN '' ELSE ',synthesize,gates,master,save' || CASE WHEN publish THEN ',publish' ELSE '' END END AS stages FROM r""")
def run_stages(spark, sf_dir):
    key = F.col("o_orderkey")
    kind = F.when(key % 3 == 0, "url").when(key % 3 == 1, "pdf").otherwise("path")
    edition = F.when(key % 4 == 0, "full").when(key % 4 == 1, "verbatim").when(key % 4 == 2, "brief")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(D.stages(kind, edition, key % 5 == 0, key % 7 < 3), ",").alias("stages"))


@query("""SELECT l_orderkey, l_linenumber, greatest(0, l_discount * least(60, pow(2, l_linenumber)), CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS wait,
    CASE WHEN l_linestatus = 'O' THEN 4 ELSE least(16, ceil(0.9::DOUBLE * (l_quantity * 100)::INT / 150)) END::INT AS minutes,
    abs(l_quantity - (l_quantity + l_tax * 30)) <= 1 + 0.005::DOUBLE * (l_quantity + l_tax * 30) AS fits FROM lineitem""")
def run_targets(spark, sf_dir):
    asked, expected = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")), F.col("l_quantity") + F.col("l_tax") * 30
    edition = F.when(F.col("l_linestatus") == "O", "brief").otherwise("full")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", D.wait_seconds(F.col("l_linenumber"), asked, F.col("l_discount")).alias("wait"),
        D.target_minutes(edition, (F.col("l_quantity") * 100).cast("int")).alias("minutes"), D.length_fits(F.col("l_quantity"), expected).alias("fits"))


@query()
def tone_pitches(spark, sf_dir):
    """The pitch of every part's name; the checksum is not in the SQL dialect."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", D.tone_pitch(F.col("p_name")).alias("pitch"))


@query("""SELECT l_orderkey AS episode, count_if(l_returnflag = 'A') AS cached, count_if(l_returnflag <> 'A') AS made,
    sum(CASE WHEN l_returnflag = 'A' THEN 0 ELSE greatest(0, l_linenumber - 2) END) AS retries FROM lineitem GROUP BY 1""")
def synthesis_counts(spark, sf_dir):
    return D.synthesis_counts(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode"), (F.col("l_returnflag") == "A").alias("cached"), (F.col("l_linenumber") - 1).alias("attempts")))


@query("""SELECT o_custkey AS script, count(*) AS attempts, sum(o_orderkey % 1000) AS input_tokens, sum(o_orderkey % 77) AS output_tokens FROM orders GROUP BY 1""")
def token_usage(spark, sf_dir):
    return D.token_usage(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("script"), (F.col("o_orderkey") % 1000).alias("input_tokens"), (F.col("o_orderkey") % 77).alias("output_tokens")))


@query("""SELECT count(DISTINCT l_orderkey) AS files, sum(l_partkey) AS bytes FROM lineitem
    WHERE l_linenumber < 3 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'N')""")
def cache_stats(spark, sf_dir):
    """Entries of the cache: an order's first line is its audio (where it is N), its second line the sidecar."""
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber < 3")
    kind = F.when((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "N"), "wav").otherwise("json")
    return D.cache_stats(rows.select(F.col("l_orderkey").alias("key"), kind.alias("kind"), F.col("l_partkey").alias("bytes")))


@query("""SELECT o_orderkey AS episode_id, 'kept' AS state FROM orders WHERE o_orderkey NOT IN (SELECT l_partkey * 20 FROM lineitem)
    UNION ALL SELECT DISTINCT l_partkey * 20, 'unknown' FROM lineitem WHERE l_partkey * 20 NOT IN (SELECT o_orderkey FROM orders)""")
def feed_removals(spark, sf_dir):
    """What stays in the feed once the episodes that order lines name are removed, and names that the feed lacks."""
    episodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("episode_id"))
    kept, unknown = D.unpublished(episodes, table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 20).alias("episode_id")).distinct())
    return kept.withColumn("state", F.lit("kept")).unionByName(unknown.withColumn("state", F.lit("unknown")))


@query("""SELECT o_orderkey AS episode_id, o_orderstatus, coalesce(o_orderstatus = 'P' OR o_orderkey IN (SELECT l_partkey FROM lineitem), false) AS published FROM orders""")
def marked_published(spark, sf_dir):
    manifests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("episode_id"), "o_orderstatus", F.when(F.col("o_orderstatus") == "P", True).alias("published"))
    return D.marked_published(manifests, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("episode_id")))


@query(f"""WITH e AS (SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ', ' ORDER BY o_orderkey::VARCHAR) FILTER (o_orderstatus = 'F') AS gone, count_if(o_orderstatus = 'F') AS n, max(o_orderstatus = 'P') AS again FROM orders GROUP BY 1)
    SELECT o_custkey, CASE WHEN n > 0 THEN 'Superseded ' || n || ' same-title feed episode(s): ' || gone || '. {_STALE}' WHEN again THEN 'Replaced this episode''s earlier feed audio. {_STALE}' ELSE '' END AS notice FROM e""")
def replacement_notices(spark, sf_dir):
    gone = F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey").cast("string"))))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(gone.alias("gone"), F.max(F.col("o_orderstatus") == "P").alias("again"))
    return rows.select("o_custkey", D.replacement_notice(F.col("gone"), F.col("again")).alias("notice"))


@query("""SELECT user_id AS run, event_type AS stage, (epoch_us(max(CASE WHEN event_id % 2 = 1 THEN ts END)) - epoch_us(min(CASE WHEN event_id % 2 = 0 THEN ts END))) / 1000000 AS seconds
    FROM events GROUP BY 1, 2""")
def stage_seconds(spark, sf_dir):
    return D.stage_seconds(table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("stage"), "ts", (F.col("event_id") % 2 == 0).alias("started")))
