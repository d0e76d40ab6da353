"""Repeated ids, hot groups, small tables, long words, block passes and reads from the middle."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from brute import all_spans, disclosing
from test_operators import benchmark_items, contamination_rows, prose, table

from lectern.llm import op1_lines, op2_order, op3_language, op5_jaccard, op6_quality, op7_pii, op8_ann, op9_bpe, op10_decontaminate
from lectern.llm.textkit import KeyFilter


@pytest.mark.parametrize("ids", [(1, 2), (7, 8)])
def test_quality_with_repeated_ids(spark, ids):
    rows = [(ids[k % 2], prose(30 + k, k) if k % 2 else "| # |" * k, "en", "s") for k in range(200)]
    labels = spark.createDataFrame([(ids[k % 2], k % 2) for k in range(200)], "doc_id long, quality int")
    got = op6_quality.scored(table(spark, rows), labels).collect()
    assert len(got) == 200 and all(0 <= r.score <= 1 for r in got)


def test_normal_equations_equal_plain_ridge():
    random_ = np.random.default_rng(1)
    x, y = random_.normal(size=(300, op6_quality.STATISTICS)), random_.integers(0, 2, 300).astype(float)
    model = op6_quality.Model(x)
    z = model.expand(x)
    n = random_.integers(1, 4, 300).astype(float)
    parts = [op6_quality.normal_equations(z[a : a + 70], n[a : a + 70], (n * y)[a : a + 70]) for a in range(0, 300, 70)]
    model.solve(sum(parts).ravel())
    again, answers = np.repeat(z, n.astype(int), axis=0), np.repeat(y, n.astype(int))
    penalty = op6_quality.RIDGE * len(again) / op6_quality.FEATURES
    stacked = np.vstack([again, np.sqrt(penalty) * np.eye(z.shape[1])])
    want = np.linalg.lstsq(stacked, np.concatenate([answers, np.zeros(z.shape[1])]), rcond=None)[0]
    assert np.allclose(model.weight, want, atol=1e-6)


def test_calibration_equals_plain_isotonic_regression():
    random_ = np.random.default_rng(2)
    bins = np.sort(random_.choice(op6_quality.BINS, 60, replace=False))
    count = random_.integers(1, 30, 60).astype(float)
    ones = np.minimum(count, random_.poisson(count * bins / op6_quality.BINS)).astype(float)
    model = op6_quality.Model(random_.normal(size=(50, op6_quality.STATISTICS)))
    order = random_.permutation(60)
    model.calibrate(bins[order].astype(float), count[order], ones[order])
    mean = ones / count
    # The least-squares fit has a max-min form: the largest lower average of the smallest upper ones.
    average = lambda a, b: ones[a : b + 1].sum() / count[a : b + 1].sum()
    want = np.array([max(min(average(a, b) for b in range(k, 60)) for a in range(k + 1)) for k in range(60)])
    centre = op6_quality.LOW + (bins + 0.5) * (op6_quality.HIGH - op6_quality.LOW) / op6_quality.BINS
    where, height = model.steps
    for pool in np.unique(want):
        rows = want == pool
        middle = (centre * count)[rows].sum() / count[rows].sum()
        assert np.isclose(np.interp(middle, where, height), pool), (mean, pool)


def test_statistics_equal_plain_counts():
    texts = ["", "Hello, World! ABC 123", "a a a b\nb b\n\nx y", "é ünï ###", " " * 9, prose(500, 4)]
    raw = [t.encode() for t in texts]
    got = op6_quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    at = len(op6_quality._CLASSES)
    for k, r in enumerate(raw):
        words, lines = r.split(), [x for x in r.split(b"\n") if x]
        many = max(1, len(words))
        assert np.isclose(got[k, 0], sum(97 <= b <= 122 for b in r) / max(1, len(r)))
        assert np.isclose(got[k, at], np.log1p(len(r))) and np.isclose(got[k, at + 1], np.log1p(len(words)))
        assert np.isclose(got[k, at + 2], sum(map(len, words)) / many)
        assert np.isclose(got[k, at + 4], len(set(words)) / many)
        assert np.isclose(got[k, at + 5], sum(a == b for a, b in zip(words, words[1:], strict=False)) / many)
        assert np.isclose(got[k, at + 7], sum(len(w) == 1 for w in words) / many)
        assert np.isclose(got[k, at + 10], np.log1p(len(lines))) and np.isclose(got[k, at + 12], len(set(lines)) / max(1, len(lines)))


def test_the_network_equals_a_scalar_one():
    net = op3_language.Network(["a", "b"], units=2, seed=4)
    codes = np.random.default_rng(1).integers(97, 123, (7, 3))
    got, w, u = net.label(codes), net.weights, 2
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for n in range(3):
        states = {}
        for way in "fb":
            h = [0.0] * u
            for t in range(7) if way == "f" else range(6, -1, -1):
                turn = [sum(float(w[f"{way}U"][r, j]) * h[j] for j in range(u)) for r in range(3 * u)]
                seen = [float(w[f"{way}E"][r, codes[t, n]]) for r in range(3 * u)]
                reset, update = ([sigmoid(seen[g * u + i] + turn[g * u + i]) for i in range(u)] for g in (0, 1))
                reset, update = list(reset), list(update)
                new = [np.tanh(seen[2 * u + i] + reset[i] * turn[2 * u + i]) for i in range(u)]
                h = [update[i] * h[i] + (1 - update[i]) * new[i] for i in range(u)]
                states[way, t] = h
        for t in range(7):
            logits = [sum(float(w[f"{way}V"][k, i]) * states[way, t][i] for way in "fb" for i in range(u)) + float(w["c"][k, 0]) for k in range(2)]
            want = np.exp(logits) / np.exp(logits).sum()
            assert np.allclose(got[:, t, n], want, atol=1e-5)


@pytest.mark.parametrize("pair", [(1, 2), (8, 9)])
def test_a_language_of_few_ids_teaches(spark, pair):
    rows = [(pair[k % 2], f"de {prose(5, k)}", "de", "s") for k in range(4000)] + [(100 + k, f"en {k}", "en", "s") for k in range(200)]
    taught = lambda rows, languages=9: {lang for lang, _ in op3_language._excerpts(table(spark, rows), 50, languages)}
    assert taught(rows) == {"de", "en"} and taught(rows, 1) == {"de"}
    assert taught([(pair[k % 2], "immer das", "de", "s") for k in range(1800)] + rows[4000:]) == {"de", "en"}
    assert all(text.startswith(lang) for lang, text in op3_language._excerpts(table(spark, rows), 50, 9))


@pytest.mark.parametrize("rows", [5, 40, 700])
def test_small_tables_are_routed_and_every_query_gets_its_neighbours(spark, monkeypatch, rows):
    x = np.random.default_rng(rows).normal(size=(rows, 8))
    used, fit = [], op8_ann.fitted
    monkeypatch.setattr(op8_ann, "fitted", lambda *a: used.append(a[1]) or fit(*a))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict[int, list[int]] = {}
    for r in op8_ann.nearest(docs, every=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert sorted(got) == list(range(0, rows, 5)) and {len(g) for g in got.values()} == {min(20, rows - 1)}
    assert bool(used) == (rows > 31)
    hit = 0
    for q, found in got.items():
        score = np.where(np.arange(rows) == q, -np.inf, x @ x[q])
        hit += len(set(np.argsort(-score)[: min(20, rows - 1)].tolist()) & set(found))
    assert hit >= 0.9 * sum(map(len, got.values()))


def test_queries_of_small_parts_are_searched_everywhere(spark, monkeypatch):
    monkeypatch.setattr(op8_ann, "PART_ROWS", 32)
    monkeypatch.setattr(op8_ann, "fitted", lambda x, parts, k, recall: (op8_ann.Router(x, np.eye(parts)[np.arange(len(x)) % parts]), 1))
    x = np.random.default_rng(1).normal(size=(400, 6))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    counts = op8_ann.nearest(docs, k=150).groupBy("query_id").count().collect()
    assert len(counts) == 20 and {r["count"] for r in counts} == {150}


def test_long_words_merge_alike():
    model, r = op9_bpe.WordBpe(op9_bpe.vocabulary()), random.Random(8)
    for alphabet in ("ab", "etaoinshr", "aé日0"):
        for size in (1, 2, 30, 260, 900):
            word = "".join(r.choice(alphabet) for _ in range(size)).encode()
            assert model.merge_long(word).tolist() == model.merge([word])[0].tolist()


def test_long_words_equal_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    known, model, r = tokenizers.Tokenizer.from_file(op9_bpe.vocabulary()), op9_bpe.WordBpe(op9_bpe.vocabulary()), random.Random(9)
    text = "".join(r.choice("etaoinshrdlu") for _ in range(20_000))
    for raw, name in model.encode_batch([f"{text} and {text[:300]}", text]):
        ids = np.frombuffer(raw, "<u4").tolist()
        assert known.decode(ids, skip_special_tokens=False) == name.decode()
    assert np.frombuffer(model.encode_batch([text])[0][0], "<u4").tolist() == known.encode(text, add_special_tokens=False).ids
    assert not [p for p in model.memo if len(p) > op9_bpe.LONG]


def test_the_sanitised_text_holds_no_span(spark):
    texts = [f"{prose(20, k)} ends" for k in range(30)] + ["ask clerkname at one@a.example now", "card 4111 1111 1111 1111 end", "plain", None, ""]
    terms = disclosing(texts, op7_pii.REACH, 1, op7_pii.DISCLOSURE)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in op7_pii.sanitised(docs).collect()}
    assert set(op7_pii.sanitised(docs).columns) == {"doc_id", "text", "spans", "spans_found", "sanitised"}
    for k, text in enumerate(texts):
        want, at = "", 0
        for start, _, end, kind, _ in all_spans(text, terms):
            want += (text or "")[at:start] + ("" if kind == "term" else f"[{kind.upper()}]")
            at = end
        assert got[k].sanitised == want + (text or "")[at:]
    assert "clerkname" not in got[30].sanitised and "[EMAIL]" in got[30].sanitised


@pytest.mark.parametrize("block_bytes", [60, 200])
def test_earlier_blocks_are_jobs_of_their_own(spark, block_bytes):
    bench = spark.createDataFrame(benchmark_items(), "item_id string, text string")
    frame = op10_decontaminate.contamination(table(spark, contamination_rows()), bench, block_bytes)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 2  # one for each branch of the rows that may have been hit before
    assert len(list(op10_decontaminate.benchmark_blocks(bench, block_bytes))) > 1


def test_a_key_filter_loses_no_key(spark):
    keys, rows = spark.range(0, 3000, 3).withColumnRenamed("id", "k"), spark.range(3000).withColumnRenamed("id", "k")
    for values in (1, 64, 1 << 20):
        some, rest = KeyFilter(keys, "k", values=values).split(rows)
        assert some.join(keys, "k", "left_semi").count() == 1000 and some.count() + rest.count() == 3000
        assert rest.join(keys, "k", "left_semi").count() == 0


def test_common_lines_do_not_meet_in_one_task(spark):
    rows = [(k, f"{prose(6, k)}\nThe same line everywhere\n", "en", f"s{k % 40}") for k in range(2000)]
    rows += [(5000 + k, f"near the threshold\n{prose(6, 5000 + k)}", "en", f"n{k % 10}") for k in range(500)]
    found = {bytes(r.line) for r in op1_lines.boilerplate(table(spark, rows)).collect()}
    assert found == {hashlib.md5(x).digest() for x in (b"The same line everywhere", b"near the threshold")}


def _written(spark, path, rows=300):
    docs = table(spark, [(k, prose(30 + 5 * k, k), "en", "s") for k in range(rows)] + [(None, "no id", "en", "s"), (7000, "", "en", "s"), (7001, None, "en", "s")])
    docs.coalesce(2).write.option("parquet.block.size", 20_000).option("parquet.page.size", 4000).parquet(path)
    return spark.read.parquet(path)


def test_the_order_does_not_depend_on_splits(spark, tmp_path):
    docs = _written(spark, str(tmp_path / "docs"))
    kept, orders = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for size in ("128MB", "60KB", "25KB"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            op2_order.write_shards(spark.read.parquet(str(tmp_path / "docs")), str(tmp_path / size))
            orders.append({(r.doc_id, r.seq_no): r.slot for r in op2_order.read_shards(spark, str(tmp_path / size)).collect()})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert orders[0] == orders[1] == orders[2] and len(orders[0]) > docs.count()


def test_reads_from_the_middle_open_later_shards_alone(spark, tmp_path, monkeypatch):
    for name in ("LEAST_RECORDS", "MOST_RECORDS"):
        monkeypatch.setattr(op2_order, name, 64)
    monkeypatch.setattr(op2_order, "WRITERS", 3)
    total, in_shard = op2_order.write_shards(_written(spark, str(tmp_path / "docs")), str(tmp_path / "w"))
    assert in_shard == 64 and total > 640
    every = op2_order.read_shards(spark, str(tmp_path / "w")).collect()
    files: dict[str, list[int]] = {}
    for r in every:
        files.setdefault(r.file, []).append(r.slot)
        assert r.byte_offset == r.slot % 64 * op2_order.STRIDE
    assert len(files) == -(-total // 64) and all(sorted(s) == list(range(min(s), min(s) + len(s))) and min(s) % 64 == 0 for s in files.values())
    late = op2_order.read_shards(spark, str(tmp_path / "w"), 500)
    assert sorted(r.slot for r in late.collect()) == list(range(500, total)) and len(late.inputFiles()) == -(-total // 64) - 500 // 64
    assert op2_order.read_shards(spark, str(tmp_path / "w"), total).count() == 0


def test_token_ids_are_materialised_and_decode(spark, tmp_path):
    texts = {k: prose(40 + 30 * k, k) for k in range(12)} | {50: "", 51: "é 日本 x"}
    docs = table(spark, [(k, t, "en", "s") for k, t in texts.items()])
    model = op9_bpe.WordBpe(op9_bpe.vocabulary())
    codec = op2_order.vocabulary_codec(model.size)
    assert codec.width == 2 and op2_order.vocabulary_codec(100_000).width == 4
    op2_order.write_shards(op9_bpe.encode(docs, op9_bpe.vocabulary()), str(tmp_path / "t"), 7, codec)
    found: dict[int, dict[int, list[int]]] = {}
    for r in op2_order.read_shards(spark, str(tmp_path / "t")).collect():
        found.setdefault(r.doc_id, {})[r.seq_no] = np.frombuffer(r.ids, "<u2").tolist()
    for k, text in texts.items():
        ids = [i for n in sorted(found[k]) for i in found[k][n]]
        assert ids[-1] == codec.end and ids[:-1] == np.frombuffer(model.encode_batch([text])[0][0], "<u4").tolist()


def test_shards_of_an_empty_table(spark, tmp_path):
    assert op2_order.write_shards(table(spark, []), str(tmp_path / "e"))[0] == 0
    assert op2_order.read_shards(spark, str(tmp_path / "e")).count() == 0


def test_links_survive_repeated_rows_of_a_class(spark):
    base = prose(100, 5)
    rows = [(1, base, "en", "s")] * 400 + [(2, base + " more", "en", "s")] * 300 + [(k, base, "en", "s") for k in range(10, 400)]
    got = op5_jaccard.near_duplicates(table(spark, rows)).select("doc_id", "class_id", "n_links").distinct().collect()
    assert {r.class_id for r in got} == {1} and {r.n_links for r in got} == {400 + 300 + 390 - 1}
    assert op5_jaccard.one_of_each(table(spark, rows)).count() == 1
