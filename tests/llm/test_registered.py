"""The registered queries and the pipeline over whole tables, against DuckDB where SQL can express them."""

from __future__ import annotations

import hashlib

import duckdb
import pytest
from brute import contaminated, near_classes
from test_operators import benchmark_items, near_rows, prose, table

import corpus_pipeline
from lectern.llm import op9_bpe, op10_decontaminate
from lectern.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", QUERIES)
def test_query_over_the_given_tables(spark, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    assert rows
    if name in ORACLE:
        with duckdb.connect() as db:
            for t in ("documents", "pages"):
                db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
            want = db.execute(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        key = lambda r: tuple(map(str, r))
        columns = sorted(got.columns)
        clean = want[columns].astype(object).where(want[columns].notna(), None).values.tolist()
        as_int = lambda r: tuple(int(x) if isinstance(x, float) else x for x in r)
        assert sorted((tuple(r[c] for c in columns) for r in rows), key=key) == sorted(map(as_int, clean), key=key)


@pytest.mark.parametrize("name", QUERIES)
def test_query_over_empty_tables(spark, tmp_path, name):
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def _plain_pipeline(rows, items, sites=10):
    """What the stages after language ID do, on (doc_id, text, source)."""
    spread: dict[str, set[str]] = {}
    for _, text, source in rows:
        for line in (text or "").split("\n"):
            if line.strip(" ") and source is not None:
                spread.setdefault(line, set()).add(source)
    known = {line for line, s in spread.items() if len(s) >= sites}
    cleaned = []
    for i, text, source in rows:
        lines = (text or "").split("\n")
        full = [x for x in lines if x.strip(" ")]
        keep = [x for x in lines if not (x.strip(" ") and x in known)]
        cleaned.append((i, text if all(x in known for x in full) else "\n".join(keep), source))
    heads, seen, one = near_classes([(i, t) for i, t, _ in cleaned]), set(), []
    for (i, text, _), (_, head, _) in zip(cleaned, heads, strict=True):
        if i == head and i not in seen:
            seen.add(i)
            one.append((i, text))
    judged = contaminated([t for _, t in one], items)
    return {i: t for (i, t), (w, h, _) in zip(one, judged, strict=True) if not (h > 0 and 20 * h >= w)}


def test_the_pipeline_equals_plain_stages(spark, tmp_path):
    rows = [r for r in near_rows() if r[0] is not None]
    rows += [(2000 + k, f"{prose(50, 2000 + k)}\nRights reserved by the site\n{prose(9, 2100 + k)}", "en", f"t{k}") for k in range(12)]
    rows += [(2100, prose(40, 900), "en", "s1"), (2101, prose(200, 3000) + " " + prose(13, 901), "en", "s1"), (2102, "Rights reserved by the site", "en", "s1")]
    table(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(benchmark_items(), "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    lettered = [(i, t, s) for i, t, _, s in rows if t and any(map(str.isalpha, t))]
    want = _plain_pipeline(lettered, benchmark_items())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(want)
    model = op9_bpe.WordBpe(op9_bpe.vocabulary())
    for i, text in want.items():
        raw, name = model.encode_batch([text])[0]
        assert got[i].n_tokens == len(raw) // 4 and got[i].ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(name).hexdigest()


def test_stages_keep_the_columns_and_bear_odd_rows(spark, tmp_path):
    spark.createDataFrame(benchmark_items(), "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = table(spark, near_rows())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, str(tmp_path))
        assert made.schema.names == docs.schema.names, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontamination", "bpe"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_items_found_are_those_of_whole_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = docs.select("doc_id", "text").collect()
    want = contaminated([r.text for r in texts], [(r.item_id, r.text) for r in bench.collect()])
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in op10_decontaminate.contamination(docs, bench).collect()}
    assert got == {r.doc_id: w for r, w in zip(texts, want, strict=True)}
