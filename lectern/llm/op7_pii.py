"""Sanitising personal data: base patterns, then terms that disclose them by corpus co-occurrence.

Base spans are emails, IP addresses, card and phone numbers. A protected entity is a distinct base value; its
context is the words within REACH characters of an occurrence. Over the whole corpus, n_e counts the documents
with entity e, n_t those with term t, n_et those with t in a context of e, and N all documents. t discloses e
to the degree PMI(e; t) / IC(e) = log(N n_et / (n_e n_t)) / log(N / n_e), which is 1 when t never occurs without
e. A term whose degree reaches DISCLOSURE for any entity is itself a span (kind `term`) wherever it occurs, and is
generalised or removed with the rest. Entities of every frequency count: most personal data is in one document.

Everything is a DataFrame expression; counts are pre-aggregated, so a common entity or term costs no more than
others. A rare term with n_et = n_t is in no other documents than those of e's contexts, and these are known from
the contexts; only other terms are looked up in all texts.

Spans: leftmost non-overlapping per kind, in code points, end exclusive. Base spans of different kinds may
overlap; a term that overlaps a base span adds none. Defined results: a null text counts as empty; repeated
rows each keep a row and count as documents; without co-occurrence only base spans remain.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.textkit import KeyFilter, stored

#: Characters on either side of an entity that are its context; documents a pair needs (1: any); degree that discloses.
REACH, SUPPORT, DISCLOSURE = 1000, 1, 0.95
#: Disclosing terms that are broadcast to be looked up in all texts; a larger set is joined by shuffling.
BROADCAST_TERMS = 100_000
#: Documents of a term that may be taken from the contexts; so few that no key of that join is large.
RARE = 100
KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
#: Linear forms of the contract's patterns: possessive, and begun only where a run of local characters begins or
#: the last match ended, since a run that fails from its start fails from everywhere within.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"[\p{L}\p{N}]++"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    each = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    if kind == "card":
        size = F.length(_digits(value))
        return F.when(size.between(12, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _matches(text: Column, pattern: str, rank: int, kind: str, keep: Callable[[Column], Column]) -> Column:
    """Array of (start, rank, end, kind, value) of the matches to keep: a match's start is the pieces and matches
    before it, summed. The fold carries a number for most matches and grows the array for the kept ones alone."""
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.array().cast(SPANS)
    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(keep(pair["value"]), F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    pairs = F.zip_with(values, F.slice(gaps, F.lit(1), F.size(values)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    return F.when(F.size(values) > 0, F.aggregate(pairs, zero, step, lambda s: s["out"])).otherwise(empty)


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_spans(text: Column) -> Column:
    """Array of the valid base spans of all kinds, by start and then kind; a cheap test spares most texts the patterns."""
    need = {"email": F.instr(text, "@") > 0, "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][\x20-]?[0-9][\x20-]?[0-9]"), "phone": text.rlike(r"\+[0-9]")}
    empty = F.array().cast(SPANS)
    found = []
    for rank, kind in enumerate(KINDS):
        spans = _matches(text, PATTERNS[kind], rank, kind, partial(_valid, kind))
        found.append(F.when(need[kind], spans).otherwise(empty))
    return F.array_sort(F.concat(*found))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _rendered(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def contexts(found: DataFrame) -> DataFrame:
    """(tid, entity, term) for every document of `found` (tid, text, spans), distinct per document."""
    entity = F.explode(F.array_distinct(F.transform("spans", lambda s: F.concat(s["kind"], F.lit(":"), s["value"])))).alias("entity")
    around = F.filter("spans", lambda s: F.concat(s["kind"], F.lit(":"), s["value"]) == F.col("entity"))

    def near(s: Column) -> Column:
        before = F.substring(F.col("text"), F.greatest(s["start"] - REACH, F.lit(0)) + 1, F.least(s["start"], F.lit(REACH)))
        after = F.substring(F.col("text"), s["end"] + 1, F.lit(REACH))
        whole_before = F.when(s["start"] > REACH, F.regexp_replace(before, rf"^{WORD}", "")).otherwise(before)
        whole_after = F.when(s["end"] + REACH < F.length("text"), F.regexp_replace(after, rf"{WORD}$", "")).otherwise(after)
        masked = whole_before
        other = whole_after
        for kind in KINDS:  # what is protected itself is no term
            masked, other = F.regexp_replace(masked, PATTERNS[kind], " "), F.regexp_replace(other, PATTERNS[kind], " ")
        return F.regexp_extract_all(F.lower(F.concat_ws(" ", masked, other)), F.lit(WORD), F.lit(0))

    held = found.select("tid", "text", "spans", entity)
    own = F.array_intersect(F.flatten(F.transform(around, near)), _words(F.col("text")))  # a mask may cut a word in two
    pairs = held.select("tid", "entity", F.explode(own).alias("term"))
    return pairs.where(F.length("term") > 2)


def disclosing_terms(found: DataFrame, seen: DataFrame, words: DataFrame, total: int, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(term, here): the terms that disclose an entity, from `found` (spans), its contexts `seen` and `words` (term of
    every document, distinct per document); here: rare, and in no documents but those that have it in `seen`."""
    entity = F.explode(F.array_distinct(F.transform("spans", lambda s: F.concat(s["kind"], F.lit(":"), s["value"])))).alias("entity")
    known = found.select(entity).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e") >= support)
    pairs = seen.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et")).where(F.col("n_et") >= support)
    pairs = stored(pairs.join(known, "entity").select("term", "n_e", "n_et").distinct(), "pairs")
    counted = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))  # added up within tasks first, then met with the pairs
    whole = F.lit(float(total))
    pmi = F.log(whole * F.col("n_et") / (F.col("n_e") * F.col("n_t").cast("double")))
    degree = pmi / F.log(whole / F.col("n_e"))
    here = (F.col("n_et") == F.col("n_t")) & (F.col("n_t") <= RARE)
    return pairs.join(counted, "term").where((F.col("n_e") < total) & (degree >= disclosure - 1e-9)).groupBy("term").agg(F.max(here).alias("here"))


def _named(text: Column, base: Column, terms: Column) -> Column:
    """The occurrences of `terms` in a text that overlap no base span."""
    free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return F.filter(_matches(text, WORD, len(KINDS), "term", lambda v: F.array_contains(terms, F.lower(v))), free)


def sanitised(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """Every row of `docs` as doc_id, text (null: empty), spans (base), spans_found (all) and sanitised, the text with
    base spans generalised to their kind in brackets and disclosing terms removed; other columns are left out.

    The base patterns run over all texts once. Texts that may hold a span (and, for a hash filter of bounded size, a few
    more) are shuffled to meet what was found in them; all others pass as they are."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # A row's own key, for equal ids may repeat: id and digest, the same for rows that are the same anyway.
    rows = docs.select("doc_id", text.alias("text")).withColumn("tid", F.md5("text"))
    kept = stored(rows.select("tid", "text", base_spans(F.col("text")).alias("spans")).where(F.size("spans") > 0), "entities")
    total = docs.count()
    words = rows.select("tid", F.explode(F.array_distinct(_words(F.col("text")))).alias("term")).where(F.length("term") > 2)
    seen = stored(contexts(kept), "contexts")
    terms = stored(disclosing_terms(kept, seen, words, total, support, disclosure), "terms")
    here, wide = terms.where("here").select("term"), terms.where("NOT here").select("term")
    many = wide.count()
    held = seen.select("tid", "term").join(here, "term", "left_semi")
    if many:
        held = held.unionByName(words.join(F.broadcast(wide) if many <= BROADCAST_TERMS else wide, "term", "left_semi"))
    held = held.groupBy("tid").agg(F.collect_set("term").alias("terms"))
    known = stored(kept.select("tid", "spans").dropDuplicates(["tid"]).join(held, "tid", "full"), "found")
    some, rest = KeyFilter(known, "tid").split(rows)
    none = F.array().cast(SPANS)
    met = some.join(known, "tid", "left").withColumn("spans", F.coalesce("spans", none))
    more = F.when(F.size("terms") > 0, _named(F.col("text"), F.col("spans"), F.col("terms"))).otherwise(none)
    met = met.withColumn("spans_found", F.array_sort(F.concat("spans", more))).drop("terms")
    every = met.unionByName(rest.withColumn("spans", none).withColumn("spans_found", none))
    clean = F.when(F.size("spans_found") > 0, sanitised_text(F.col("text"), F.col("spans_found"))).otherwise(F.col("text"))
    return every.select("doc_id", "text", "spans", "spans_found", clean.alias("sanitised"))


def sanitised_text(text: Column, spans: Column) -> Column:
    """The text with spans replaced; of overlapping spans the first decides and the rest are swallowed."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        between = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        mark = F.when((s["kind"] == "term") | (s["start"] < state["at"]), "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(F.greatest(s["end"], state["at"]).alias("at"), F.concat(state["out"], between, mark).alias("out"))

    return F.aggregate(spans, zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7 over the whole documents table: the contract's columns, then how many terms were found and the digest of
    the sanitised text."""
    rows = sanitised(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [_count(F.col("spans"), k).alias(f"n_{k}") for k in KINDS]
    digests = [F.sha2(_rendered(F.col("spans")), 256).alias("base_sha256"), _rendered(F.col("spans_found")).alias("spans")]
    return rows.select("doc_id", *counts, *digests, _count(F.col("spans_found"), "term").alias("n_term"), F.sha2("sanitised", 256).alias("sanitised_sha256"))
