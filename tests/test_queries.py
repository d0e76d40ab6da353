"""Every query gives rows, and those that SQL can express equal DuckDB on the same tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

from lectern.queries import ORACLE, QUERIES

DATA = Path(os.environ.get("LECTERN_TESTDATA", "/root/testdata/sf0.01"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
#: Tables as small as these may leave a rule without a finding.
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in sorted(DATA.glob("*.parquet")):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return connection


def plain(value) -> str:
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, tables, name):
    frame, sql = QUERIES[name](spark, str(DATA)), tables.sql(ORACLE[name])
    names = sorted(frame.columns)
    assert names == sorted(sql.columns)
    got = sorted(tuple(plain(r[n]) for n in names) for r in frame.collect())
    at = [sql.columns.index(n) for n in names]
    assert got == sorted(tuple(plain(r[k]) for k in at) for r in sql.fetchall())
    assert got or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, str(DATA)).limit(1).count() == 1


def test_scans_are_pruned_and_filters_pushed(spark):
    plan = QUERIES["lint_documents"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan and plan.count("FileScan") == 1


#: A code that without its 7 reads as the phrase "69 a" for 70, numbers spelled in their source, lines that look like
#: frontmatter, and digits and blanks that are such only beyond ASCII.
FIDELITY = [
    "token 845d70e69a8320", "77 and 17, seventy-seven and 17", "a thousand 1,000 7,000 seven thousand", "fifty percent 57% 50%", "---\ntitle: 77\n---\n## A\n\n77", "1\u0663 7\u0663 \u0663\u0667 17\u0663",
    "\u3000```77\n17", "\x0b```77\n17", " \t```77\n17\n```\n7.5", "7 7. 7% 0.7 7,7", "17_000\r\n77\r1", "plain 12", "", None,
]


def test_number_fidelity_equals_sql_on_codes_and_odd_lines(spark, tmp_path):
    rows = [(n, t) for n, t in enumerate([*FIDELITY, "17"])] + [(len(FIDELITY), "77\n17"), (None, "77")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {(k, line): n for k, line, n in connection.sql(ORACLE["number_fidelity"]).fetchall()}
    got = {(r.script_id, r.line): r.missing for r in QUERIES["number_fidelity"](spark, str(tmp_path)).collect()}
    assert got == want and got[0, 1] == 1


def test_entry_point_names_every_oracle():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "doc_plan" in entry.queries()
