"""Queries on plans, catalogs, signals and progress. Driver tables stand in for episodes, attempts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.functions import text as X
from lectern.operators import catalog, gates, packing, pricing, progress, signal
from lectern.plans.text_queries import SENTENCES, WORDS, registry
from lectern.session import table

QUERIES, ORACLE, query = registry()
MODEL, DAY = "gemini-3.8-flash-tts", "2026-11-26"
CHARS, TARGET = P.LIMITS["gemini"]


def _packed(source: str, key: str) -> str:
    """DuckDB: the chunk of every unit, by a recursive walk over the units of each key."""
    return f"""
paragraphs AS (SELECT {key}, generate_subscripts(p, 1) AS pos, unnest(p) AS unit FROM
    (SELECT {key}, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS p FROM {source})),
fitted AS (SELECT {key}, pos, CASE WHEN length(unit) <= {CHARS} THEN [unit] ELSE {SENTENCES.format('unit')} END AS parts FROM paragraphs),
pieces AS (SELECT {key}, pos, generate_subscripts(parts, 1) AS sub, unnest(parts) AS unit FROM fitted),
tokens AS (SELECT {key}, pos, sub, generate_subscripts(t, 1) AS i, unnest(t) AS token FROM
    (SELECT {key}, pos, sub, list_filter(string_split_regex(unit, '\\s+'), lambda w: w <> '') AS t FROM pieces WHERE length(unit) > {CHARS})),
hard AS (SELECT {key}, pos, sub, i, token, 1 AS part, length(token) AS size FROM tokens WHERE i = 1 UNION ALL
    SELECT t.{key}, t.pos, t.sub, t.i, t.token, CASE WHEN h.size + 1 + length(t.token) > {CHARS} THEN h.part + 1 ELSE h.part END,
        CASE WHEN h.size + 1 + length(t.token) > {CHARS} THEN length(t.token) ELSE h.size + 1 + length(t.token) END
    FROM hard h JOIN tokens t ON t.{key} = h.{key} AND t.pos = h.pos AND t.sub = h.sub AND t.i = h.i + 1),
split AS (SELECT {key}, pos, sub, 0 AS part, unit FROM pieces WHERE length(unit) <= {CHARS} UNION ALL
    SELECT {key}, pos, sub, part, string_agg(token, ' ' ORDER BY i) FROM hard GROUP BY {key}, pos, sub, part),
units AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY pos, sub, part) AS n, unit, {WORDS.format('unit')} AS w, length(unit) AS c FROM split),
walk AS (SELECT {key}, n, unit, w, c, 1 AS chunk FROM units WHERE n = 1 UNION ALL
    SELECT u.{key}, u.n, u.unit, CASE WHEN k.w + u.w > {TARGET} OR k.c + u.c + 2 > {CHARS} THEN u.w ELSE k.w + u.w END,
        CASE WHEN k.w + u.w > {TARGET} OR k.c + u.c + 2 > {CHARS} THEN u.c ELSE k.c + u.c + 2 END,
        CASE WHEN k.w + u.w > {TARGET} OR k.c + u.c + 2 > {CHARS} THEN k.chunk + 1 ELSE k.chunk END
    FROM walk k JOIN units u ON u.{key} = k.{key} AND u.n = k.n + 1)"""


@query(f"""WITH RECURSIVE {_packed('documents', 'doc_id')}, counted AS (SELECT doc_id, max(chunk) AS chunks FROM walk GROUP BY doc_id)
    SELECT doc_id, {WORDS.format('text')} AS words, len({SENTENCES.format('text')}) AS sentences, coalesce(chunks, 0) AS chunks,
    round({WORDS.format('text')} * 60.0 / {P.WORDS_PER_MINUTE}, 6) AS est_seconds, round({WORDS.format('text')} * 0.0135 / {P.WORDS_PER_MINUTE}, 6) AS est_cost
    FROM documents LEFT JOIN counted USING (doc_id)""")
def doc_plan(spark, sf_dir):
    """The flagship: words, sentences, chunks, seconds at 150 words a minute, and cost on a day, of every document."""
    text = F.col("text")
    seconds = F.col("words") * 60.0 / P.WORDS_PER_MINUTE
    rate = pricing.rate_on(MODEL, F.lit(DAY).cast("date"))
    counted = table(spark, sf_dir, "documents").select("doc_id", "text", X.word_count(text).alias("words"))
    return counted.select(
        "doc_id", "words", F.size(X.sentences(text)).alias("sentences"), F.size(packing.chunks(text, TARGET, CHARS)).alias("chunks"),
        F.round(seconds, 6).alias("est_seconds"), F.round(pricing.cost(rate, seconds), 6).alias("est_cost"),
    )


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.posexplode(packing.chunks(F.col("text"), TARGET, CHARS)).alias("pos", "chunk"))


@query(f"""WITH RECURSIVE c AS (SELECT conv_id * 1000 + turn AS k, text FROM conversations), {_packed('c', 'k')}
    SELECT k // 1000 AS conv_id, k % 1000 AS turn, chunk - 1 AS pos, sha256(string_agg(unit, chr(10) || chr(10) ORDER BY n)) AS chunk_sha256 FROM walk GROUP BY k, chunk""")
def chunk_pack(spark, sf_dir):
    return _chunked(spark, sf_dir).select("conv_id", "turn", "pos", F.sha2("chunk", 256).alias("chunk_sha256"))


@query(f"""WITH RECURSIVE c AS (SELECT conv_id * 1000 + turn AS k, text FROM conversations), {_packed('c', 'k')},
    parts AS (SELECT DISTINCT k // 1000 AS conv_id, 1 AS phase, k % 1000 AS turn, chunk - 1 AS pos FROM walk
        UNION ALL SELECT DISTINCT conv_id, 0, -1, 0 FROM conversations UNION ALL SELECT DISTINCT conv_id, 2, -1, 0 FROM conversations)
    SELECT conv_id, CASE phase WHEN 0 THEN 'intro' WHEN 1 THEN 'content' ELSE 'outro' END AS kind, turn, pos,
        row_number() OVER (PARTITION BY conv_id ORDER BY phase, turn, pos) - 1 AS chunk_index FROM parts""")
def chunk_index(spark, sf_dir):
    """Intro, content and outro in one dense order."""
    content = _chunked(spark, sf_dir).select("conv_id", F.lit(1).alias("phase"), F.lit("content").alias("kind"), "turn", "pos")
    ends = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    edge = lambda n, kind: ends.select("conv_id", F.lit(n).alias("phase"), F.lit(kind).alias("kind"), F.lit(-1).cast("long").alias("turn"), F.lit(0).alias("pos"))
    rows = content.unionByName(edge(0, "intro")).unionByName(edge(2, "outro"))
    order = Window.partitionBy("conv_id").orderBy("phase", "turn", "pos")
    return rows.select("conv_id", "kind", "turn", "pos", (F.row_number().over(order) - 1).alias("chunk_index"))


@query(f"""SELECT conv_id, count(*) AS chapters, sum({WORDS.format('text')} + 1) AS words, sha256(string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS script_sha256
    FROM conversations GROUP BY conv_id""")
def conversation_script(spark, sf_dir):
    """Turns as chapters of a script: serialised in order, with words of headings and bodies."""
    part = F.concat(F.lit("## "), "role", F.lit("\n\n"), "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))), lambda x: x["part"]), "\n\n")
    rows = table(spark, sf_dir, "conversations").withColumn("w", X.word_count(F.col("text")) + 1)
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("chapters"), F.sum("w").alias("words"), F.sha2(joined, 256).alias("script_sha256"))


_PARAGRAPH_KEYS = "SELECT doc_id, sha256(l) AS cache_key FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> ''"


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("l")).where("trim(l) <> ''")
    return lines.select("doc_id", F.sha2("l", 256).alias("cache_key"))


@query(f"WITH k AS ({_PARAGRAPH_KEYS}), c AS (SELECT DISTINCT cache_key FROM k WHERE doc_id % 2 = 0) SELECT doc_id, count(*) AS hits FROM k JOIN c USING (cache_key) WHERE doc_id % 2 = 1 GROUP BY doc_id")
def cache_hits(spark, sf_dir):
    """Two halves of the documents stand for a plan and what the cache holds from another."""
    keys = _keys(spark, sf_dir)
    hits, _ = catalog.cache_plan(keys.where("doc_id % 2 = 1"), keys.where("doc_id % 2 = 0").select("cache_key").distinct())
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))


@query(f"WITH k AS ({_PARAGRAPH_KEYS}), c AS (SELECT DISTINCT cache_key FROM k WHERE doc_id % 2 = 0) SELECT doc_id, cache_key FROM k ANTI JOIN c USING (cache_key) WHERE doc_id % 2 = 1")
def cache_misses(spark, sf_dir):
    keys = _keys(spark, sf_dir)
    _, misses = catalog.cache_plan(keys.where("doc_id % 2 = 1"), keys.where("doc_id % 2 = 0").select("cache_key").distinct())
    return misses.select("doc_id", "cache_key")


@query("""WITH e AS (SELECT o_orderkey AS key, o_orderdate AS last_used, (o_totalprice)::BIGINT AS bytes FROM orders),
    s AS (SELECT *, sum(bytes) OVER (ORDER BY last_used DESC, key DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kept FROM e)
    SELECT key, kept > 500000000 OR last_used < TIMESTAMP '1993-06-01' AS removed FROM s""".replace("(o_totalprice)::BIGINT", "floor(o_totalprice)::BIGINT"))
def cache_prune(spark, sf_dir):
    """Orders stand for cache entries; what is left fits 500 MB and is no older than a day."""
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("last_used"), F.floor("o_totalprice").cast("long").alias("bytes"))
    return catalog.pruned(entries, 500_000_000, F.lit("1993-06-01").cast("timestamp_ntz")).select("key", "removed")


@query(f"""WITH p(model, valid_from, rate) AS (VALUES {", ".join(f"('{m}', DATE '{d}', {r})" for m, d, r in P.PRICES)}),
    o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'gemini-3.8-flash-tts' WHEN o_orderkey % 3 = 1 THEN 'gpt-4o-mini-tts-2025-12-15' ELSE 'unknown' END AS model,
        (o_orderdate + INTERVAL 31 YEAR)::DATE AS day FROM orders)
    SELECT o_orderkey, coalesce((SELECT arg_max(rate, valid_from) FROM p WHERE p.model = o.model AND valid_from <= day), (SELECT arg_min(rate, valid_from) FROM p WHERE p.model = o.model), 0)::DOUBLE AS rate FROM o""")
def price_asof(spark, sf_dir):
    """Order dates, moved by 31 years, stand for render days."""
    model = F.when(F.col("o_orderkey") % 3 == 0, "gemini-3.8-flash-tts").when(F.col("o_orderkey") % 3 == 1, "gpt-4o-mini-tts-2025-12-15").otherwise("unknown")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", model.alias("model"), F.to_date(F.add_months("o_orderdate", 12 * 31)).alias("day"))
    return pricing.priced(orders, pricing.price_table(spark), "o_orderkey").select("o_orderkey", "rate")


@query(f"""SELECT doc_id, w * 9600 + e * 7200 AS samples, round((w * 9600 + e * 7200) / 24000.0, 6) AS seconds FROM (SELECT doc_id, {WORDS.format('text')} AS w,
    len(list_filter(string_split_regex(text, '\\s+'), lambda x: regexp_matches(x, '[.?!;:]$'))) AS e FROM documents)""")
def tone_duration(spark, sf_dir):
    samples = signal.tone_samples(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", samples.cast("long").alias("samples"), F.round(samples / 24000.0, 6).alias("seconds"))


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines stand for attempts: quantity for seconds, part number for words, discount for silence."""
    rows = table(spark, sf_dir, "lineitem")
    wpm = gates.pace(F.col("l_partkey") % 200 + 1, F.col("l_quantity"))
    return rows.select(F.col("l_orderkey").alias("episode"), F.col("l_linenumber").alias("chunk"), wpm.alias("wpm"), (F.col("l_discount") * 50).alias("silence"), (F.col("l_suppkey") % 7).alias("size"))


_ATTEMPTS = """a AS (SELECT l_orderkey AS episode, l_linenumber AS chunk, CASE WHEN l_quantity > 0 THEN (l_partkey % 200 + 1) / (l_quantity / 60) ELSE 0 END AS wpm,
    l_discount * 50 AS silence, l_suppkey % 7 AS size FROM lineitem)"""


@query(f"""WITH {_ATTEMPTS} SELECT episode, chunk, CASE WHEN size <= 0 OR size % 2 <> 0 THEN 'pcm' WHEN wpm < 60 OR wpm > 300 THEN 'pace' WHEN silence > 4 THEN 'silence' END AS reason FROM a""")
def hard_gate(spark, sf_dir):
    return _attempts(spark, sf_dir).select("episode", "chunk", gates.hard_reason(F.col("wpm"), F.col("silence"), F.col("size")).alias("reason"))


@query(f"""WITH {_ATTEMPTS}, m AS (SELECT *, CASE WHEN count(*) OVER w >= 3 THEN median(wpm) OVER w END AS med FROM a WINDOW w AS (PARTITION BY episode))
    SELECT episode, chunk, CASE WHEN wpm < 90 OR wpm > 240 THEN 'pace' WHEN med > 0 AND (wpm < 0.65 * med OR wpm > 1.5 * med) THEN 'median' END AS soft FROM m""")
def soft_gate(spark, sf_dir):
    return gates.soft_gated(_attempts(spark, sf_dir)).select("episode", "chunk", "soft")


@query(f"""WITH {_ATTEMPTS} SELECT episode, chunk % 3 AS chunk, chunk AS attempt FROM a QUALIFY row_number() OVER (PARTITION BY episode, chunk % 3 ORDER BY abs(wpm - 150), chunk) = 1""")
def best_attempt(spark, sf_dir):
    rows = _attempts(spark, sf_dir).select("episode", (F.col("chunk") % 3).alias("chunk"), F.col("chunk").alias("attempt"), "wpm")
    return gates.best_attempts(rows).select("episode", "chunk", "attempt")


@query(f"""WITH c AS (SELECT conv_id, turn, {WORDS.format('text')} * 9600 AS samples FROM conversations),
    s AS (SELECT *, coalesce(sum(samples + 28800) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_sample FROM c)
    SELECT conv_id, turn, start_sample, coalesce(lead(start_sample) OVER (PARTITION BY conv_id ORDER BY turn), start_sample + samples) AS end_sample FROM s""")
def chapter_offsets(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("episode"), F.col("turn").alias("chapter"), (X.word_count(F.col("text")) * 9600).cast("long").alias("samples"))
    return signal.chapter_offsets(rows).select(F.col("episode").alias("conv_id"), F.col("chapter").alias("turn"), "start_sample", "end_sample")


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("samples"))


_LEVELS = """x AS (SELECT vec_id AS id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
    f AS (SELECT id, i // 8 AS frame, sqrt(sum(v * v) / 8) AS rms FROM x GROUP BY id, i // 8)"""


@query(f"WITH {_LEVELS} SELECT id, frame, rms < 0.12 AS silent FROM f")
def silence_mask(spark, sf_dir):
    """Embeddings stand for signals, in frames of eight."""
    return signal.frame_levels(_signals(spark, sf_dir), 8).select("id", "frame", (F.col("rms") < 0.12).alias("silent"))


@query(f"""WITH {_LEVELS}, r AS (SELECT id, frame, frame - row_number() OVER (PARTITION BY id ORDER BY frame) AS run FROM f WHERE rms < 0.12)
    SELECT id, min(frame) AS first_frame, count(*) AS frames FROM r GROUP BY id, run""")
def silence_runs(spark, sf_dir):
    return signal.silent_runs(signal.frame_levels(_signals(spark, sf_dir), 8), 0.12)


@query("""WITH p AS (SELECT vec_id AS id, embedding AS s, unnest(range(41)) AS k FROM embeddings), q AS (SELECT *, k * (len(s) - 1) / 40.0 AS place FROM p)
    SELECT id, k, round(s[floor(place)::INT + 1]::DOUBLE + (s[least(floor(place)::INT + 2, len(s))]::DOUBLE - s[floor(place)::INT + 1]::DOUBLE) * (place - floor(place)), 6) AS value FROM q""")
def resample_linear(spark, sf_dir):
    return signal.resampled(_signals(spark, sf_dir), 41).select("id", F.col("k").cast("long").alias("k"), F.round("value", 6).alias("value"))


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("feed"), F.col("o_orderkey").alias("episode_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("publish_seq")
    )


@query("""WITH e AS (SELECT o_custkey AS feed, o_orderkey AS episode_id, o_orderdate AS created_at, date_diff('microsecond', o_orderdate, TIMESTAMP '1998-08-02') / 86400000000.0 <= 1500 AS young FROM orders)
    SELECT episode_id, young AND row_number() OVER (PARTITION BY feed, young ORDER BY created_at DESC, episode_id) <= 5 AS kept FROM e""")
def feed_retention(spark, sf_dir):
    """Orders of a customer stand for a feed's episodes."""
    return catalog.retained(_episodes(spark, sf_dir), F.lit("1998-08-02").cast("timestamp"), 1500, 5, "feed").select("episode_id", "kept")


@query("SELECT o_orderkey AS episode_id, row_number() OVER (PARTITION BY o_custkey, trim(o_orderpriority) ORDER BY o_orderkey DESC) > 1 AS superseded FROM orders")
def feed_supersede(spark, sf_dir):
    return catalog.superseded(_episodes(spark, sf_dir), "feed").select("episode_id", "superseded")


@query("SELECT o_orderkey, o_orderkey || '@' || left(sha256(o_orderpriority), 8) AS guid FROM orders")
def feed_guid(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", catalog.guid(F.col("o_orderkey").cast("string"), F.sha2("o_orderpriority", 256)).alias("guid"))


@query("""SELECT o_custkey AS feed, count(*) AS episodes, sum(floor(o_totalprice)::BIGINT)::BIGINT AS bytes, strftime(max(o_orderdate), '%Y-%m-%d') AS last_build,
    arg_max(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS latest FROM orders GROUP BY o_custkey""")
def feed_status(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return rows.groupBy(F.col("o_custkey").alias("feed")).agg(
        F.count(F.lit(1)).alias("episodes"), F.sum(F.floor("o_totalprice").cast("long")).alias("bytes"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_build"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest")
    )


@query("""WITH l AS (SELECT user_id AS episode_id, ts, event_id, event_type <> 'error' AS ok, props FROM events),
    d AS (SELECT *, max(ok::INT) OVER (PARTITION BY episode_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS done FROM l)
    SELECT episode_id, count(*) AS attempts, arg_max(props, event_id) AS last_error FROM d WHERE done = 0 GROUP BY episode_id""")
def outbox_state(spark, sf_dir):
    """Events of a user stand for an episode's deliveries; errors for failures."""
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"), F.col("props").alias("error"))
    return catalog.outbox(log).select("episode_id", "attempts", "last_error")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("stage"), "ts", F.col("event_id").alias("seq"), "value")


@query("SELECT user_id AS run, event_type AS stage, max(event_id) AS seq, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def progress_latest(spark, sf_dir):
    return progress.latest(_events(spark, sf_dir)).select("run", "stage", "seq", "value")


_DELTA = "CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END"


@query(f"""WITH o AS (SELECT user_id AS run, event_id, sum({_DELTA}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS open FROM events)
    SELECT run, max(greatest(open, 0)) AS max_parallel, greatest(arg_max(open, event_id), 0) AS in_flight FROM o GROUP BY run""")
def progress_concurrency(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("delta", F.when(F.col("stage").isin("click", "view"), 1).otherwise(-1))
    return progress.concurrency(rows)


@query("""WITH s AS (SELECT user_id AS run, avg(value) AS mean, count(*) FILTER (event_type = 'view') AS queued, count(*) FILTER (event_type = 'click') AS parallel, avg(value) FILTER (event_type = 'error') AS live FROM events GROUP BY 1)
    SELECT run, round(queued * mean / greatest(parallel, 1) + greatest(0.0, mean - coalesce(live, 0)), 4) AS eta FROM s""")
def progress_eta(spark, sf_dir):
    rows = _events(spark, sf_dir).groupBy("run").agg(F.avg("value").alias("mean"), F.count_if(F.col("stage") == "view").alias("queued"), F.count_if(F.col("stage") == "click").alias("parallel"), F.avg(F.when(F.col("stage") == "error", F.col("value"))).alias("live"))
    eta = progress.eta_seconds(F.col("queued"), F.col("mean"), F.col("parallel"), F.coalesce("live", F.lit(0.0)))
    return rows.select("run", F.round(eta, 4).alias("eta"))


@query("""WITH g AS (SELECT user_id AS run, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY run ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT run, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS events, round(sum(value), 4) AS total FROM s GROUP BY run, n""")
def session_rollup(spark, sf_dir):
    """Beyond the rules: sessions as corpus telemetry."""
    rows = progress.sessions(_events(spark, sf_dir))
    return rows.select("run", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "events", F.round("total", 4).alias("total"))
