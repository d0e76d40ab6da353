"""Credits, dates, links and run rules on cases of our own."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F
from test_functions import one

from lectern.functions import credits as C
from lectern.operators import delivery as D


@pytest.mark.parametrize(("raw", "names"), [("", []), ("A B", ["A B"]), ("A, B", ["A, B"]), ("A,B , C", ["A", "B", "C"]), ("A and B; C\tand D", ["A", "B", "C", "D"]), (" and A;;", ["and A"]), ("A, B, C; D", ["A, B, C", "D"])])
def test_authors(spark, raw, names):
    assert one(spark, C.authors(F.col("t")), t=raw) == names


@pytest.mark.parametrize(("names", "said"), [([], ""), (["A"], "A"), (["A", "B"], "A and B"), (["A", "B", "C"], "A, B, and C"), (["A", "B", "C", "D"], "A and colleagues")])
def test_credit(spark, names, said):
    assert spark.createDataFrame([(names,)], "n array<string>").select(C.credit(F.col("n"))).first()[0] == said


def test_dates(spark):
    for rule, cases in (
        (C.stamp_date, {"[cs] 4 SEP 2026": "2026-09-04", "4 Septem 2026": "", "x": "", "12 Foo 2020 1 Jan 2021": ""}),
        (C.document_date, {" D:20260904120000": "2026-09-04", "2026-09-04T1": "2026-09-04", "x 2026-09-04": "", "D:2026": ""}),
        (C.shown_date, {"'2026-09-04'": "September 4, 2026", "20260904": "September 4, 2026", "2026-02-30": "2026-02-30", "0000-01-01": "0000-01-01", ' "May" ': "May", "2026-09-04 x": "2026-09-04 x"}),
    ):
        for raw, want in cases.items():
            assert one(spark, rule(F.col("t")), t=raw) == want, raw


def test_links_and_keys(spark):
    link = lambda url, ref, **t: one(spark, C.source_link(F.col("u").cast("string"), F.col("r").cast("string"), t), u=url, r=ref)
    assert link("https://a", "n:b", n="x{path}") == "https://a" and link(" ", "n:b:c", n="x{path}y{path}") == "xb:cyb:c"
    assert link(None, "nb", n="x{path}") == link(None, "m:b", n="x{path}") == link(None, "n:b", n="{other}") == link(None, "n:b", n="{") == link(None, None, n="x") == ""
    assert one(spark, C.masked(F.col("u"), F.col("k")), u="/f/tok/x", k="tok") == "/f/****/x" and one(spark, C.masked(F.col("u"), F.col("k")), u="/f", k="") == "/f"
    assert [one(spark, C.valid_key(F.col("k").cast("string")), k=k) for k in ("a" * 64, "A" * 64, "a" * 64 + "\n", "a" * 63, None)] == [True, False, False, False, False]
    assert one(spark, C.source_folder(F.col("t"), F.col("k")), t="¡!", k="x").startswith("article-")


def test_waits_targets_and_pitch(spark):
    wait = lambda n, asked, draw: one(spark, D.wait_seconds(F.col("n"), F.col("a").cast("double"), F.col("d")), n=n, a=asked, d=draw)
    assert wait(3, None, 0.5) == 4.0 and wait(20, None, 1.0) == 60.0 and wait(0, 9.0, 0.5) == 9.0 and wait(1, -3.0, 0.0) == 0.0
    minutes = lambda e, n: one(spark, D.target_minutes(F.col("e"), F.col("n")), e=e, n=n)
    assert minutes("brief", 9000) == 4 and minutes("full", 500) == 3 and minutes("full", 9000) == 16 and minutes("full", 0) == 0
    for word in ("a", "naïve", ""):
        assert one(spark, D.tone_pitch(F.col("w")), w=word) == 330.0 + zlib.crc32(word.encode()) % 8 * 55.0
    assert one(spark, D.length_fits(F.col("a"), F.col("e")), a=102.0, e=100.5) and not one(spark, D.length_fits(F.col("a"), F.col("e")), a=102.1, e=100.0)


def test_outline_warning(spark):
    rows = spark.createDataFrame([(3, [], ["x"]), (3, ["y"], ["x"]), (2, [], ["x"]), (5, None, None), (None, [], ["x"])], "f int, r array<string>, m array<string>")
    assert [r[0] for r in rows.select(D.outline_warns(F.col("f"), F.col("r"), F.col("m"))).collect()] == [True, False, False, False, False]
