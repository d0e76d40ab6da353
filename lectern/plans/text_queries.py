"""Queries on texts: words, sentences, lint, numbers, names and URLs. Driver tables stand in for scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.functions import text as X
from lectern.operators import linting
from lectern.session import table

def registry():
    """A table of queries, one of their DuckDB twins, and the decorator that adds to both."""
    queries, oracle = {}, {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return queries, oracle, query


QUERIES, ORACLE, query = registry()


#: DuckDB forms of the helpers.
WORDS = r"len(list_filter(string_split_regex({0}, '\s+'), lambda w: w <> ''))"
SENTENCES = r"list_filter(string_split(regexp_replace(trim({0}, e' \n\t\r'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')"
LINES = "(SELECT doc_id, generate_subscripts(p, 1) AS line, unnest(p) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"


@query(f"SELECT doc_id, {WORDS.format('text')} AS words FROM documents")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.word_count(F.col("text")).alias("words"))


@query(f"""SELECT lang, count(*) AS documents, sum(n) AS sentences, max(n) AS most FROM
    (SELECT lang, len({SENTENCES.format('text')}) AS n FROM documents) GROUP BY lang""")
def sentence_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", F.size(X.sentences(F.col("text"))).alias("n"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("sentences"), F.max("n").alias("most"))


@query(f"""WITH b(edition, over_words, under_words) AS (VALUES {", ".join(f"('{e}', {b[1]}, {b[2]})" for e, b in P.BUDGETS.items())}),
    c AS (SELECT conv_id, sum({WORDS.format('text')}) AS words FROM conversations GROUP BY conv_id)
    SELECT conv_id, edition, words, CASE WHEN words > over_words THEN 'W011' WHEN words < under_words AND words > 0 THEN 'W012' END AS rule FROM c, b""")
def budget_check(spark, sf_dir):
    """A fixed dimension of three editions is unfolded in place rather than joined."""
    words = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(X.word_count(F.col("text"))).alias("words"))
    editions = F.explode(F.array(*[F.struct(F.lit(e).alias("edition"), F.lit(b[1]).alias("over"), F.lit(b[2]).alias("under")) for e, b in P.BUDGETS.items()]))
    rows = words.withColumn("b", editions)
    rule = F.when(F.col("words") > F.col("b.over"), "W011").when((F.col("words") < F.col("b.under")) & (F.col("words") > 0), "W012")
    return rows.select("conv_id", F.col("b.edition").alias("edition"), "words", rule.alias("rule"))


_TOKENS = r"list_transform(list_filter(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?%?'), lambda n: length(regexp_replace(n, '\D', '', 'g')) >= 2 OR contains(n, '.') OR contains(n, '%')), lambda n: replace(n, ',', ''))"


@query(f"SELECT doc_id, n AS number, count(*) AS times FROM (SELECT doc_id, unnest({_TOKENS}) AS n FROM documents) GROUP BY doc_id, n")
def number_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(linting.number_tokens(F.col("text"))).alias("number"))
    return rows.groupBy("doc_id", "number").agg(F.count(F.lit(1)).alias("times"))


@query("""SELECT doc_id FROM documents SEMI JOIN (SELECT DISTINCT split_part(text, chr(10), 1) AS first_line FROM benchmark) b ON contains(text, first_line)
    """.replace("ON contains(text, first_line)", "ON split_part(text, chr(10), 1) = first_line") + " UNION SELECT doc_id FROM labels WHERE toxic = 1")
def contamination_semi(spark, sf_dir):
    """Documents that open as a test item does, or are marked: a semi join and a set union."""
    first = F.split("text", "\n", -1)[0]
    items = table(spark, sf_dir, "benchmark").select(first.alias("first_line")).distinct()
    opened = table(spark, sf_dir, "documents").withColumn("first_line", first).join(items, "first_line", "left_semi").select("doc_id")
    return opened.union(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")).distinct()


@query(r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '§\s*(\d+)', 'section \1', 'g'), 'https?://\S+|www\.\S+', '', 'g'), '\(\s*\)|\[\s*\]', '', 'g'), ',\s*([.,;:!?])', '\1', 'g'), '\s+([.,;:!?])', '\1', 'g'), '[ \t]{2,}', ' ', 'g'))) AS spoken_sha256 FROM pages""")
def spoken_text_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(X.spoken(F.col("html")), 256).alias("spoken_sha256"))


@query(r"""SELECT p_partkey, trim(regexp_replace(translate(p_brand, '_-#', '  '), '([a-z0-9])([A-Z])', '\1 \2', 'g')) AS words FROM part""".replace("'_-#', '  '", "'_-', '  '"))
def identifier_words(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.identifier_words(F.col("p_brand")).alias("words"))


@query()
def spoken_codes(spark, sf_dir):
    """Inline-code spans for reading aloud; event properties and names stand in for them."""
    events = table(spark, sf_dir, "events").select("event_id", X.spoken_code(F.col("event_type")).alias("type"), X.spoken_code(F.col("props")).alias("props"))
    return events


_LEX = {"the": "thee", "of": "ov", "de": "duh", "la": "lah", "der": "dare", "und": "oont", "los": "lohs", "Und": "Oont"}


@query(f"""WITH m AS (SELECT MAP {{{", ".join(f"'{k}': '{v}'" for k, v in _LEX.items())}}} AS known)
    SELECT doc_id, sha256(array_to_string(list_transform(string_split(text, ' '), lambda w: coalesce(known[w], w)), ' ')) AS said FROM documents, m""")
def lexicon_apply(spark, sf_dir):
    """Whole blank-parted words replaced in one pass, which a token map and the pattern form agree on here."""
    known = F.create_map(*[F.lit(x) for pair in _LEX.items() for x in pair])
    words = F.transform(F.split("text", " ", -1), lambda w: F.coalesce(F.try_element_at(known, w), w))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.array_join(words, " "), 256).alias("said"))


@query()
def lexicon_pattern(spark, sf_dir):
    """The pattern form, for words beside punctuation."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.pronounced(F.col("text"), _LEX), 256).alias("said"))


@query(r"""SELECT p_partkey, coalesce(nullif(trim(left(coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'episode'), 60), '-'), ''), 'episode')
    || '-' || left(sha256(p_type), 6) AS episode_id FROM part""")
def slug_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.keyed_slug(F.col("p_name"), F.col("p_type")).alias("episode_id"))


@query(r"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages),
    q AS (SELECT *, list_transform(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_') AND NOT list_contains(['fbclid', 'gclid', 'mc_cid', 'mc_eid'], lower(split_part(p, '=', 1)))),
        lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END) AS kept FROM u)
    SELECT page_id, CASE WHEN scheme IN ('http', 'https') AND host <> '' THEN scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END ||
        CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS url FROM q""")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.normal_url(F.col("url")).alias("url"))


@query(r"""SELECT o_orderkey, regexp_extract(u, '(\d{4}\.\d{4,5})', 1) AS paper, 'https://arxiv.org/pdf/' || regexp_extract(u, '(\d{4}\.\d{4,5})', 1) AS pdf FROM
    (SELECT o_orderkey, 'https://arxiv.org/abs/' || strftime(o_orderdate, '%y%m') || '.' || lpad((o_custkey % 100000)::varchar, 5, '0') AS u FROM orders)""")
def arxiv_ids(spark, sf_dir):
    """Order dates and customers stand in for paper numbers."""
    url = F.concat(F.lit("https://ARXIV.org/abs/"), F.date_format("o_orderdate", "yyMM"), F.lit("."), F.lpad((F.col("o_custkey") % 100000).cast("string"), 5, "0"))
    paper = X.paper_id(url)
    return table(spark, sf_dir, "orders").select("o_orderkey", paper.alias("paper"), F.concat(F.lit("https://arxiv.org/pdf/"), paper).alias("pdf"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%B ') || day(o_orderdate) || ', ' || year(o_orderdate) AS spoken FROM orders")
def spoken_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.spoken_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("spoken"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN ', by ' || c_name || ' at ' || c_mktsegment WHEN c_custkey % 4 = 1 THEN ', by ' || c_name
    WHEN c_custkey % 4 = 2 THEN ', from ' || c_mktsegment ELSE '' END AS kind_phrase FROM customer""")
def intro_phrases(spark, sf_dir):
    """The byline part of an article's intro; customers stand in for authors and segments for sites."""
    n = F.col("c_custkey") % 4
    author, site = F.when(n < 2, F.col("c_name")).otherwise(""), F.when(n.isin(0, 2), F.col("c_mktsegment")).otherwise("")
    phrase = (
        F.when((author != "") & (site != ""), F.concat(F.lit(", by "), author, F.lit(" at "), site))
        .when(author != "", F.concat(F.lit(", by "), author)).when(site != "", F.concat(F.lit(", from "), site)).otherwise("")
    )
    return table(spark, sf_dir, "customer").select("c_custkey", phrase.alias("kind_phrase"))
