"""Text, packing, number and markup rules on cases of our own."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import kernels, markup
from lectern.functions import text as X
from lectern.operators import catalog, config, gates, layout, linting, normalizing, packing, pricing, signal


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize(("text", "n"), [("  a b  c", 3), ("", 0), ("a b", 2), ("\n\t", 0)])
def test_word_count(spark, text, n):
    assert one(spark, X.word_count(F.col("t")), t=text) == n


def test_sentences_keep_their_ends(spark):
    assert one(spark, X.sentences(F.col("t")), t=" One here. Two there!  Three?  ") == ["One here.", "Two there!", "Three?"]


@pytest.mark.parametrize(("units", "words", "chars", "packed"), [(["a b", "c d", "e f"], 4, 100, ["a b\n\nc d", "e f"]), (["xxx", "yyy"], 9, 5, ["xxx", "yyy"]), (["xxx", "yyy"], 9, 8, ["xxx\n\nyyy"]), ([], 5, 5, [])])
def test_packing(spark, units, words, chars, packed):
    rows = spark.createDataFrame([(units,)], "u array<string>")
    assert rows.select(packing.pack(F.col("u"), words, chars)).first()[0] == packed


def test_hard_split_and_fit(spark):
    assert one(spark, packing.hard_split(F.col("t"), 5), t="pp qq rr") == ["pp qq", "rr"]
    assert one(spark, packing.hard_split(F.col("t"), 4), t="ab incomprehensible z") == ["ab", "inco", "mpre", "hens", "ible", "z"]
    assert one(spark, packing.fit(F.col("t"), 12), t="Short one. And longish words here.") == ["Short one.", "And longish", "words here."]


def test_packing_keeps_text_and_limits(spark):
    r = random.Random(4)
    rows = [(k, "\n".join(" ".join("w" * r.randint(1, 9) for _ in range(r.randint(1, 60))) + "." for _ in range(r.randint(0, 12)))) for k in range(60)]
    for row in spark.createDataFrame(rows, "k long, t string").select("t", packing.chunks(F.col("t"), 50, 200).alias("c")).collect():
        assert all(len(c) <= 200 for c in row.c) and " ".join(row.c).split() == row.t.split()


@pytest.mark.parametrize(("title", "slug"), [("Hello, World!", "hello-world"), ("---", "episode"), ("", "episode"), ("A" * 59 + " bcd", "a" * 59), ("Ünï x", "n-x")])
def test_slug(spark, title, slug):
    assert one(spark, X.slug(F.col("t")), t=title) == slug


def test_names_dates_and_codes(spark):
    assert one(spark, X.spoken_date(F.col("t")), t="2026-09-04") == "September 4, 2026"
    assert one(spark, X.spoken_date(F.col("t")), t="2026-13-40") == "2026-13-40"
    assert one(spark, X.identifier_words(F.col("t")), t="parseHTTPResponse_now") == "parse HTTP Response now"
    assert one(spark, X.file_title(F.col("t")), t="/x/my_notes-two.md") == "My Notes Two"
    for code, said in {"x": "the x key", "1.2.3": "1.2.3", "a/b.py": "", "cafe1234": "", "cache.get(key)": "cache get key", "https://a.b": ""}.items():
        assert one(spark, X.spoken_code(F.col("t")), t=code) == said
    assert one(spark, X.canonical_title(F.col("t")), t=" “A” — b ") == '"A" - b'


def test_lexicon_is_one_pass_and_longest_first(spark):
    lexicon = {"a": "b", "b": "c", "ab": "x", "a-b": "y"}
    assert one(spark, X.pronounced(F.col("t"), lexicon), t="a b ab a-b abc é_a") == "b c x y abc é_a"


@pytest.mark.parametrize(("url", "normal"), [("HTTP://Ex.COM", "http://ex.com/"), ("https://u:p@h.org:8080/p?utm_x=1&b=2&FBCLID=3&c#f", "https://u:p@h.org:8080/p?b=2&c="), ("ftp://a/b", None), ("nonsense", None)])
def test_urls(spark, url, normal):
    assert one(spark, X.normal_url(F.col("t")), t=url) == normal


@pytest.mark.parametrize(("url", "paper"), [("https://arxiv.org/abs/2101.00001v2", "2101.00001v2"), ("http://www.arxiv.org/pdf/2101.00001.pdf", "2101.00001"), ("https://arxiv.org/abs/2101.00001.pdf", None), ("https://export.arxiv.org/html/math.GT/0309136", "math.GT/0309136"), ("https://example.org/abs/2101.00001", None)])
def test_paper_ids(spark, url, paper):
    assert one(spark, X.paper_id(F.col("t")), t=url) == paper


@pytest.mark.parametrize(("text", "forms"), [("nineteen eighty four", {"103", "84", "4"}), ("two hundred and five", {"205", "105", "5"}), ("a thousand", {"1000", "1001"} & {"1000"}), ("3.5 percent", {"3.5%"}), ("twelve per cent", {"12", "12%"}), ("no numbers", set()), ("1,200 million", {"1200000000", "1000000"})])
def test_number_forms(text, forms):
    assert forms <= set(kernels.number_forms_of(text))


def test_cache_keys_escape_and_sort():
    import hashlib

    text = '{"engine":"e","model":"m","sample_rate":1,"speed":1.0,"style":"s","text":"\\u00e9","v":1,"voice":"v"}'
    assert kernels.cache_key_of("e", "m", "v", "s", 1.0, 1, "é") == hashlib.sha256(text.encode()).hexdigest()


def test_markup_is_removed_in_order():
    assert kernels.without_markup("**bold _it_** `code` [a](b) ![](c) <b>x</b> <https://u>") == ("bold it code a x https://u", ["autolink", "link", "code", "emphasis", "html"])
    assert kernels.match_form_of("## ＡB **c** [d](e)") == "ab c d"


def script(body: str, **meta) -> str:
    facts = {"narration": 1, "title": "T", "kind": "article", "edition": "full"} | meta
    return "---\n" + "\n".join(f"{k}: {v}" for k, v in facts.items()) + "\n---\n" + body


CASES = {
    "S001": "no frontmatter", "S002": script("## A\nx", narration=2), "S003": script("## A\nx", title=""), "S004": script("just text"), "S005": script("## A\n## B\ntext"),
    "S006": script("## A\n### b\nx"), "S007": script("early\n## A\nx"), "R001": script("## A\n- item"), "R002": script("## A\na | b"), "R003": script("## A\n```\nx\n```\ny"),
    "R004": script("## A\na `b`"), "R005": script("## A\n[a](b)"), "R006": script("## A\n<b>x"), "R007": script("## A\n*x* y"), "W001": script("## A\nhttps://a.b"),
    "W002": script("## A\nsee ./a/b now"), "W003": script("## A\nx.py:12"), "W004": script("## A\nat deadbeef1"), "W005": script("## A\nnote:202401/abc"), "W006": script("## A\n§ 3"),
    "W007": script("## A\na → b"), "W008": script("## A\n" + "\n\n".join(["w " * 150] * 7)), "W009": script("## A\n" + "w " * 181), "W010": script("## A\n" + "w " * 46),
    "W011": script("## A\n" + "w " * 300, edition="digest"), "W012": script("## A\nfew", edition="full"),
}


def test_each_lint_rule_finds_its_case_and_a_clean_script_none(spark):
    clean = script("## Opening\n\nPlain words here. More words.\n\n## Close\n\nThe end.", edition="verbatim")
    rows = [(k, t) for k, t in enumerate([*CASES.values(), clean])]
    found: dict[int, set[str]] = {}
    for r in linting.lint(spark.createDataFrame(rows, "script_id long, text string")).collect():
        found.setdefault(r.script_id, set()).add(r.rule)
    for k, rule in enumerate(CASES):
        assert rule in found[k], rule
    assert len(CASES) not in found


def test_numbers_are_sourced_by_digits_or_unless_told_otherwise_by_words(spark):
    rows = spark.createDataFrame([(1, "## A\n205 and 70 and 12", "two hundred and five, 69a8320, 12"), (2, "## A\n205", None)], "script_id int, text string, source_text string")
    found = lambda **how: [(r.script_id, r.line, r.col) for r in linting.lint(rows, **how).where("rule = 'W013'").collect()]
    assert found() == [] and found(spelled=False) == [(1, 2, 1), (1, 2, 9)]


MARKDOWN = """# Title

Intro *text* with `code_name`.

## First

- item one
- item two

| a | b |
|---|---|
| x | y |

```python
print(1)
```

<!-- hidden -->

## Sources

gone

## Last

### Sub

End.
"""


def test_markdown_becomes_chapters_and_omissions(spark):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, None), (3, "")], "doc_id long, text string")
    spoken, omitted = normalizing.normalised(docs)
    every = spoken.orderBy("pos", "nth").collect()
    rows = [(r.title, r.text) for r in every if r.doc_id == 1]
    assert [(r.title, r.text) for r in every if r.doc_id != 1] == [("Notes", "No spoken content found.")] * 2
    assert rows == [("Title", "Intro text with code name."), ("First", "item one."), ("First", "item two."), ("First", "x: b y."), ("Last", "Sub."), ("Last", "End.")]
    assert sorted(r.type for r in omitted.collect()) == ["fence", "html_comment", "sources_section"]


def test_outline_skips_navigation_and_finds_prose(spark):
    html = "<nav><h2>No</h2></nav><article><h2>Yes <b>bold</b></h2><p>short</p><p>" + "long prose " * 6 + "</p><h3>Next</h3></article>"
    assert [x[0] for x in markup.outline_of(html)] == ["h2", "h2", "p", "p", "h3"]
    rows = normalizing.headings(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("pos").collect()
    assert [(r.heading, r.following[:10]) for r in rows] == [("Yes bold", "long prose"), ("Next", "")]


def test_prices_fall_back_to_the_oldest(spark):
    rows = spark.createDataFrame([(1, "gemini-3.8-flash-tts", "2020-01-01"), (2, "gemini-3.8-flash-tts", "2027-01-01"), (3, "none", "2026-01-01")], "k long, model string, day string").withColumn("day", F.to_date("day"))
    assert {r.k: r.rate for r in pricing.priced(rows, pricing.price_table(spark), "k").collect()} == {1: 0.0135, 2: 0.027, 3: 0.0}


@pytest.mark.parametrize(("wpm", "hard"), [(60.0, None), (59.9, "pace"), (300.0, None), (300.1, "pace"), (0.0, "pace")])
def test_hard_gate_bounds_are_inclusive(spark, wpm, hard):
    assert one(spark, gates.hard_reason(F.col("w"), F.lit(4.0), F.lit(2)), w=wpm) == hard


def test_soft_gate_needs_three_chunks(spark):
    rows = [("a", 1, 100.0), ("a", 2, 200.0), ("b", 1, 100.0), ("b", 2, 100.0), ("b", 3, 160.0)]
    got = gates.soft_gated(spark.createDataFrame(rows, "episode string, chunk int, wpm double")).collect()
    assert {(r.episode, r.chunk): r.soft for r in got} == {("a", 1): None, ("a", 2): None, ("b", 1): None, ("b", 2): None, ("b", 3): "median"}


def test_pruning_leaves_at_most_the_limit(spark):
    r = random.Random(1)
    rows = [(k, r.randint(1, 50), f"2024-01-{r.randint(1, 9):02d} 00:00:{r.randint(0, 59):02d}") for k in range(200)]
    entries = spark.createDataFrame(rows, "key long, bytes long, last_used string").withColumn("last_used", F.to_timestamp("last_used"))
    got = catalog.pruned(entries, 1500, None).collect()
    kept = [x for x in got if not x.removed]
    assert sum(x.bytes for x in kept) <= 1500 and min(x.last_used for x in kept) >= max(x.last_used for x in got if x.removed)


def test_outbox_and_supersede(spark):
    log = [("a", 1, False, "x"), ("a", 2, False, "y"), ("b", 1, False, "z"), ("b", 2, True, None), ("c", 1, True, None), ("c", 2, False, "w")]
    rows = spark.createDataFrame([(e, s, s, ok, x) for e, s, ok, x in log], "episode_id string, at long, seq long, ok boolean, error string")
    assert sorted((r.episode_id, r.attempts, r.queued_at, r.last_error) for r in catalog.outbox(rows).collect()) == [("a", 2, 1, "y"), ("c", 1, 2, "w")]
    feed = spark.createDataFrame([("f", 1, " “T” ", 1), ("f", 2, '"T"', 2), ("f", 3, " ", 3), ("f", 4, "", 4)], "feed string, episode_id long, title string, publish_seq long")
    assert {r.episode_id: r.superseded for r in catalog.superseded(feed, "feed").collect()} == {1: True, 2: False, 3: False, 4: False}


def test_columns_measure_from_the_last_start(spark):
    rows = spark.createDataFrame([([10.0, 50.0, 65.0, 120.0, 200.0],)], "x array<double>")
    assert rows.select(layout.column_starts(F.col("x"))).first()[0] == [10.0, 120.0, 200.0]


def test_layers_and_builds(spark):
    layers = [("env", "a", "1"), ("file", "a", "2"), ("default", "a", "3"), ("env", "b", None), ("default", "b", "4")]
    assert sorted(map(tuple, config.resolved(spark.createDataFrame(layers, "layer string, key string, value string")).collect())) == [("a", "1", "env"), ("b", "4", "default")]
    cases = {("1.2", "1.10", "", ""): "local_older", ("2.0", "1.9.9", "", ""): "remote_older", ("1.0", None, "", ""): "remote_unknown", ("x", "1", "", ""): "differ", ("1.0", "1.0", "a", "b"): "differ", ("1.0", "1.0", "a", ""): "same"}
    for (a, b, c, d), outcome in cases.items():
        assert one(spark, config.compared(F.lit(a), F.lit(b).cast("string"), F.lit(c), F.lit(d))) == outcome


def test_signal_rules(spark):
    assert one(spark, signal.tone_samples(F.col("t")), t="Two words.") == 2 * 9600 + 7200
    rows = spark.createDataFrame([(1, [0.0, 2.0, 4.0])], "id long, samples array<float>")
    assert [r.value for r in signal.resampled(rows, 5).orderBy("k").collect()] == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_windowed_stream_equals_batch(spark, tmp_path):
    from lectern.streaming import progress

    rows = [(k, f"2024-01-01 0{k % 5}:{k % 60:02d}:00", k % 7, "view" if k % 2 else "click", float(k)) for k in range(200)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts").cast("timestamp_ntz"))
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = progress.windowed(progress.event_stream(spark, str(tmp_path / "events")))
    got = progress.drained(stream, str(tmp_path / "cp"), "complete")
    batch = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").start.alias("start"), F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
