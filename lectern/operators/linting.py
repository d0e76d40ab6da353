"""Lint of narration scripts: every rule as an expression over the lines, paragraphs and chapters of one row.

The text is scanned once and nothing is shuffled; findings come out as an array in order, one row a script, or as
rows. Number fidelity (W013) is judged against the script's own `source_text`, where it has one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import kernels
from lectern.functions import patterns as P
from lectern.functions.text import sentences, word_count
from lectern.operators.scripts import chosen, frontmatter, is_first_version, with_chapters, with_lines, with_paragraphs

_FOUND = "array<struct<line:int,col:int,rule:string,key:string,detail:string>>"


def _found(key: str, when: Column, line: Column, col: Column | int = 1, detail: Column | None = None) -> Column:
    """A finding where `when` holds, else null; its fields are in the order that findings are sorted by."""
    place = F.lit(col) if isinstance(col, int) else col
    parts = [line.cast("int").alias("line"), place.cast("int").alias("col"), F.lit(key[:4]).alias("rule"), F.lit(key).alias("key"), (F.lit("") if detail is None else detail.cast("string")).alias("detail")]
    return F.when(when, F.struct(*parts))


def _kept(findings: list[Column]) -> Column:
    return F.filter(F.array(*findings), lambda f: f.isNotNull()).cast(_FOUND)


def _at(text: Column, pattern: str) -> Column:
    """The place of a pattern's first match, in characters; 0 if there is none."""
    return F.when(text.rlike(pattern), F.length(F.element_at(F.split(text, pattern, 2), 1)) + 1).otherwise(0)


def line_findings(x: Column) -> Column:
    """What is wrong with one line, by itself."""
    text, line, head = x["text"], x["line"], x["level"] > 0
    fence = _kept([_found("R003", F.lit(True), line, F.instr(text, "`"))])
    base = F.when(x["level"] == 2, 4).otherwise(1)
    checked = F.when(x["level"] == 2, x["title"]).otherwise(text)
    # A cheap look for the marks that a pattern needs spares most lines the pattern.
    has = lambda *marks: reduce(Column.__and__, (text.contains(m) for m in marks))
    sha = F.when(text.rlike("[0-9a-fA-F]{7}"), F.regexp_extract(text, P.SHA, 0)).otherwise("")
    file_line, path = (F.when(has(mark), _at(text, p)).otherwise(0) for mark, p in ((":", P.FILE_LINE), ("/", P.PATH)))
    around = F.substring(text, F.greatest(path - 6, F.lit(1)), F.least(path - 1, F.lit(6)) + F.length(F.regexp_extract(text, P.PATH, 0)))
    emphasis = text.contains("**") | text.contains("__") | text.contains("~~") | (has("*") & text.rlike(P.STAR_EMPHASIS)) | (has("_") & text.rlike(P.LINE_EMPHASIS))
    symbol = F.element_at(F.filter(F.array(*[F.when(checked.contains(s), F.lit(s)) for s in P.SYMBOLS]), lambda s: s.isNotNull()), 1)
    rules = [
        _found("S006", head & (x["level"] != 2), line, 1, F.repeat(F.lit("#"), x["level"])),
        _found("S007", ~head & (x["chapter"] == 0), line),
        _found("R001", ~head & text.rlike(P.LIST_ITEM), line),
        _found("R002", ~head & text.contains("|"), line, F.instr(text, "|")),
        _found("R004", text.contains("`"), line, F.instr(text, "`")),
        _found("R005", has("[") & text.rlike(P.LINK), line, _at(text, P.LINK)),
        _found("R006", has("<") & text.rlike(P.HTML_TAG) & ~text.rlike(P.AUTOLINK), line, _at(text, P.HTML_TAG)),
        _found("R007", emphasis, line, base),
        _found("W001", text.rlike("://|www") & text.rlike(P.URL), line, _at(text, P.URL)),
        _found("W003", file_line > 0, line, file_line),
        _found("W002", (file_line == 0) & (path > 0) & ~around.contains("://"), line, path),
        _found("W004", sha.rlike("[a-fA-F]"), line, _at(text, P.SHA)),
        _found("W005", has(":", "/") & text.rlike(P.REFERENCE), line, _at(text, P.REFERENCE)),
        _found("W006", text.contains("§"), line, F.instr(text, "§")),
        _found("W007", checked.rlike("[" + "".join(P.SYMBOLS) + "]"), line, F.instr(checked, symbol) - 1 + base, symbol),
    ]
    live = ~x["fenced"] & text.rlike(r"(?U)\S")
    return F.when(x["marker"], fence).when(live, _kept(rules)).otherwise(F.array().cast(_FOUND))


def number_tokens(text: Column) -> Column:
    """Numbers of two digits or more, or with a point or percent sign, without commas."""
    return F.transform(F.filter(F.regexp_extract_all(text, F.lit(P.NUMBER), F.lit(0)), _tells), lambda n: F.translate(n, ",_", ""))


def _tells(number: Column) -> Column:
    return (F.length(F.regexp_replace(number, r"(?U)\D", "")) >= 2) | number.contains(".") | number.contains("%")


def _unsourced(x: Column, spelled: bool) -> Column:
    """W013 for a line: the numbers that neither stand in the source nor, if `spelled` counts, are spelled there."""
    gaps, numbers = F.split(x["text"], P.NUMBER, -1), F.regexp_extract_all(x["text"], F.lit(P.NUMBER), F.lit(0))
    before = lambda i: F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda n, g: n + F.length(g)) + F.aggregate(F.slice(numbers, F.lit(1), i), F.lit(0), lambda n, g: n + F.length(g))
    placed = F.transform(numbers, lambda n, i: F.struct(n.alias("n"), (before(i) + 1).alias("col"), F.translate(n, ",_", "").alias("plain")))
    stands = lambda p: F.contains(F.col("source_plain"), p["plain"])
    known = (lambda p: stands(p) | F.array_contains("source_forms", p["plain"])) if spelled else stands
    missing = F.filter(placed, lambda p: _tells(p["n"]) & ~known(p))
    found = F.transform(missing, lambda p: _found("W013", F.lit(True), x["line"], p["col"], p["n"])).cast(_FOUND)
    checked = F.col("source_plain").isNotNull() & ~x["marker"] & x["text"].rlike(r"[0-9]")
    return F.when(checked, found).otherwise(F.array().cast(_FOUND))


def findings(scripts: DataFrame, spelled: bool = True) -> DataFrame:
    """(script_id, findings) of scripts (script_id, text and, if there, source_text): an array in the order line,
    column, rule of (line, col, rule, key, detail). A null text is empty; a null source_text checks no numbers.
    Without `spelled`, a number must stand in the source in digits."""
    sourced = "source_text" in scripts.columns
    rows = scripts.select("script_id", "text", *(["source_text"] if sourced else []))
    if sourced:
        rows = rows.withColumn("source_plain", F.translate("source_text", ",_", ""))
    if sourced and spelled:
        rows = rows.withColumn("source_forms", kernels.number_forms("source_text"))
    rows = with_chapters(with_paragraphs(with_lines(frontmatter(rows))))
    meta, two, first = F.col("meta"), F.lit(2), F.lit(1)
    edition_at = F.greatest(F.coalesce(F.array_position(F.transform("all_lines", lambda x: x.rlike(P.EDITION_LINE)), F.lit(True)), F.lit(1)), F.lit(1))
    sound = F.col("fault").isNull()
    unknown = lambda key, known: sound & ~chosen(meta, key).isin(*known)
    total = F.aggregate("chapters", F.lit(0), lambda n, c: n + c["words"])
    edition = F.when(sound, chosen(meta, "edition")).otherwise("verbatim")
    budget = lambda at: F.coalesce(*[F.when(edition == e, F.lit(b[at])) for e, b in P.BUDGETS.items()])
    told = F.concat(F.lit("'"), edition, F.lit("' has "), total, F.lit(" words (budget "), budget(0))
    some = F.size("chapters") > 0
    script = _kept(
        [
            _found("S001", F.col("fault") == "missing", first),
            _found("S001y", ~sound & (F.col("fault") != "missing"), first, 1, F.col("fault")),
            _found("S002", sound & ~is_first_version(meta), two),
            _found("S003", sound & (F.trim(chosen(meta, "title")) == ""), two),
            _found("S001a", unknown("kind", P.KINDS), two, 1, chosen(meta, "kind")),
            _found("S001b", unknown("edition", P.EDITIONS), edition_at, 1, chosen(meta, "edition")),
            _found("S001c", unknown("producer", P.PRODUCERS), two, 1, chosen(meta, "producer")),
            _found("S004", ~some, F.col("head") + 1),
            _found("W011", some & (total > budget(1)), edition_at, 1, told),
            _found("W012", some & (total < budget(2)) & (total > 0), edition_at, 1, told),
        ]
    )
    chapter = lambda c: _kept([_found("S005", F.size(c["paragraphs"]) == 0, c["line"]), _found("W008", c["words"] > P.CHAPTER_WORDS, c["line"], 1, c["words"])])
    long = lambda p: (p["words"] > P.SENTENCE_WORDS) & F.exists(sentences(p["text"]), lambda s: word_count(s) > P.SENTENCE_WORDS)
    block = lambda p: _kept([_found("W009", p["words"] > P.PARAGRAPH_WORDS, p["line"], 1, p["words"]), _found("W010", long(p), p["line"])])
    spoken = F.filter("paragraphs", lambda p: p["chapter"] > 0)
    parts = [script, *(F.flatten(F.transform(rows_, f)) for rows_, f in (("lines", line_findings), ("chapters", chapter), (spoken, block)))]
    if sourced:
        parts.append(F.flatten(F.transform("lines", lambda x: _unsourced(x, spelled))))
    return rows.select("script_id", F.array_sort(F.concat(*parts)).alias("findings"))


def _named(at: int, key: Column) -> Column:
    known = F.create_map(*[F.lit(x) for k, row in P.FINDINGS.items() for x in (k, row[at])])
    return F.element_at(known, key)


def lint(scripts: DataFrame, spelled: bool = True) -> DataFrame:
    """All findings of scripts as rows: script_id, nth (from 1, by line, column and rule), line, col, rule, severity,
    message and hint; `spelled` as in `findings`."""
    # The outer form: for an inner one the optimizer would evaluate the whole array again as a filter below it.
    rows = findings(scripts, spelled).select("script_id", F.posexplode_outer("findings").alias("nth", "f")).where("nth IS NOT NULL")
    message = F.replace(_named(1, F.col("f.key")), F.lit("{}"), F.col("f.detail"))
    return rows.select("script_id", (F.col("nth") + 1).alias("nth"), "f.line", "f.col", "f.rule", _named(0, F.col("f.key")).alias("severity"), message.alias("message"), _named(2, F.col("f.key")).alias("hint"))


def gate(scripts: DataFrame, strict: bool = False) -> DataFrame:
    """(script_id, errors, warnings, ok, structural, residue): a script fails on an error, or with `strict` on any
    finding; structural errors refuse to render, residue is cleaned when it is planned. Rules by name, comma-joined."""
    rows = findings(scripts)
    rules = lambda letter: F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("findings", lambda f: f["rule"].startswith(letter)), lambda f: f["rule"]))), ",")
    warnings = F.size(F.filter("findings", lambda f: f["rule"].startswith("W")))
    errors = F.size("findings") - warnings
    return rows.select("script_id", errors.alias("errors"), warnings.alias("warnings"), (((errors == 0) & (warnings == 0)) if strict else (errors == 0)).alias("ok"), rules("S").alias("structural"), rules("R").alias("residue"))


def repair_set(found: DataFrame, under_budget: bool = False) -> DataFrame:
    """The findings (rows of `lint`) that a writer is asked to repair: errors, numbers without a source, too many words,
    and with `under_budget` too few."""
    rules = P.REPAIRED_RULES + (("W012",) if under_budget else ())
    return found.where((F.col("severity") == "error") | F.col("rule").isin(*rules))
