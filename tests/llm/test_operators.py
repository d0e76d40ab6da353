"""Operators against plain models, on small tables with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from brute import all_spans, contaminated, disclosing, near_classes, pii, rendered
from pyspark.sql import functions as F

from lectern.llm import op1_lines, op2_order, op3_language, op4_warc, op5_jaccard, op6_quality, op7_pii, op8_ann, op9_bpe, op10_decontaminate
from lectern.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, found string"
RANDOM = random.Random(5)
VOCABULARY = ["".join(RANDOM.choice("abcdefghij") for _ in range(RANDOM.randint(2, 9))) for _ in range(400)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def changed(text: str, places: list[int]) -> str:
    words = text.split()
    for p in places:
        words[p] = "zzz" + str(p)
    return " ".join(words)


def table(spark, rows):
    full = [(i, t, lang, source, None if t is None else len(t), "clash", "clash") for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows():
    """Null ids and texts, blanks, a very long text, repeated rows."""
    return [(900, None, None, None), (901, "", "en", "s1"), (902, "  \n \n", None, "s2"), (None, "no id here", "en", "s3"), (903, prose(20000, 3), "en", "s4"), (903, prose(20000, 3), "en", "s4"), (904, "!!! ... ???", "de", None), (905, "é" * 5000, "fr", "s5")]


def near_rows():
    base = prose(120, 1)
    rows = [(1, base, "en", "s0"), (2, base, "en", "s1"), (3, base.upper(), "en", "s2")]
    rows += [(10 + k, changed(base, [k]), "en", f"s{k % 5}") for k in range(40)]
    rows += [(100 + k, changed(base, [5 * k, 60, 100]), "en", "s9") for k in range(12)]
    rows += [(200 + k, prose(60, 50 + k), "en", "s3") for k in range(20)] + [(300, "two words", "en", "s"), (301, "Two, words!", "en", "s"), (302, "word", "en", "s")]
    return rows + odd_rows()


def test_near_duplicates_equal_all_pairs(spark):
    rows = near_rows()
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in op5_jaccard.near_duplicates(table(spark, rows)).collect() if r.doc_id is not None)
    assert got == sorted(near_classes([(i, t) for i, t, *_ in rows if i is not None]))


def test_blocks_of_buckets_and_components_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(op5_jaccard, "BUCKET_BLOCK", 7)
    monkeypatch.setattr(op5_jaccard, "TEXT_BLOCK", 9)
    rows = [r for r in near_rows() if r[0] is not None]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in op5_jaccard.near_duplicates(table(spark, rows)).collect())
    assert got == sorted(near_classes([(i, t) for i, t, *_ in rows]))


def test_one_of_each_class_stays_with_all_columns(spark):
    rows = near_rows()
    docs = table(spark, rows)
    kept = op5_jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    heads = sorted({c for _, c, _ in near_classes([(i, t) for i, t, *_ in rows if i is not None])})
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == heads


def test_classes_that_share_a_doc_id_each_keep_a_row(spark):
    one, two, three = prose(80, 21), prose(80, 22), prose(80, 23)
    rows = [(5, one, "en", "s"), (5, two, "en", "s"), (5, two, "en", "s"), (6, one, "en", "s"), (7, changed(two, [3]), "en", "s"), (8, three, "en", "s"), (9, "!!", "en", "s"), (9, None, "en", "s")]
    docs = table(spark, rows)
    kept = [(r.doc_id, r.text) for r in op5_jaccard.one_of_each(docs).collect()]
    assert sorted(kept, key=str) == sorted([(5, one), (5, two), (8, three), (9, "!!"), (9, None)], key=str)
    assert op5_jaccard.near_duplicates(docs).columns == ["doc_id", "tid", "class_id", "n_links", "copy_id"]


@pytest.mark.parametrize("rows", [1, 4, 1000])
def test_components_with_hubs_of_every_size(spark, monkeypatch, rows):
    monkeypatch.setattr("lectern.llm.components.HUB_ROWS", rows)
    monkeypatch.setattr("lectern.llm.components.HUB_PARTS", 3)
    r = np.random.default_rng(rows)
    pairs = [(500, k) for k in range(501, 560)] + [(k, 700) for k in range(600, 640)] + r.integers(0, 90, (60, 2)).tolist()
    root = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in pairs:
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame([tuple(map(int, p)) for p in pairs], "a long, b long"))
    assert {x.node: x.root for x in got.collect()} == root and got.count() == len(root)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def benchmark_items():
    return [("a", prose(40, 900)), ("b", "short item here"), ("c", prose(13, 901)), ("a", prose(20, 902)), ("d", None), ("e", "..."), (None, prose(15, 903)), ("f", "x")]


def contamination_rows():
    item = prose(40, 900)
    rows = [(1, prose(50, 1) + " " + item + " " + prose(30, 2), "en", "s"), (2, item.upper().replace(" ", ", "), "en", "s"), (3, prose(300, 4) + " " + prose(13, 901), "en", "s")]
    rows += [(4, " ".join(item.split()[:12]), "en", "s"), (5, "a Short, item; HERE x", "en", "s"), (6, item + " " + item, "en", "s"), (7, "x", "en", "s"), (8, "y", "en", "s")]
    return rows + odd_rows()


@pytest.mark.parametrize("block_bytes", [1 << 22, 60])
def test_contamination_equals_plain_search(spark, block_bytes):
    rows, items = contamination_rows(), benchmark_items()
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id string, text string, doc_id string")
    got = op10_decontaminate.contamination(table(spark, rows), bench, block_bytes).collect()
    want = contaminated([t for _, t, *_ in rows], items)
    seen = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got)
    assert seen == sorted((str(i), w, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0 and 20 * h >= w) for (i, *_), (w, h, x) in zip(rows, want, strict=True))
    clean = op10_decontaminate.decontaminate(table(spark, rows), bench, block_bytes)
    assert clean.columns == table(spark, rows).columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for (i, *_), (w, h, _) in zip(rows, want, strict=True) if not (h > 0 and 20 * h >= w))


@pytest.mark.parametrize("block_bytes", [1 << 22, 60])
def test_items_without_id_contaminate(spark, block_bytes):
    rows = [(1, prose(15, 903), "en", "s"), (2, prose(15, 904), "en", "s"), (3, prose(15, 903) + " " + prose(40, 900), "en", "s")]
    bench = spark.createDataFrame(benchmark_items(), "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in op10_decontaminate.contamination(table(spark, rows), bench, block_bytes).collect()}
    assert got == {1: (15, 0, True), 2: (0, 0, False), 3: (55, 1, True)}
    assert [r.doc_id for r in op10_decontaminate.decontaminate(table(spark, rows), bench, block_bytes).collect()] == [2]


def test_empty_benchmark_hits_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert op10_decontaminate.contamination(table(spark, contamination_rows()), bench).where("n_hit > 0").count() == 0


def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(op9_bpe.vocabulary())


def test_bpe_equals_the_library(spark):
    known = library()
    texts = ["don't it'S we'LL", "ΑΣ ΣΑΣ Σ", "<|endoftext|>x<|startoftext|> y <|ENDOFTEXT|>", "a" * 300, "é́ é   \x1c \x85", "日本語 한국어 🙂🙃!!??", "1234 5a6b ² ½ Ⅷ", "x" * 4000, "\x00\x01 \x7f", "İ ŉ ß ẞ"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + odd_rows()
    for r in op9_bpe.encode(table(spark, rows), op9_bpe.vocabulary()).collect():
        text = next((t for i, t, *_ in rows if i == r.doc_id), None) or ""
        ids = known.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(known.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_merging_in_batches_equals_one_by_one():
    model = op9_bpe.WordBpe(op9_bpe.vocabulary())
    words = [w.encode() for w in (*VOCABULARY, "aaaaa", "banana", "a", "é", "zzzzzzzz")]
    ids, offsets = model.merge(words)
    for k, w in enumerate(words):
        assert model.merge([w])[0].tolist() == ids[offsets[k] : offsets[k + 1]].tolist()


def test_lines_keep_what_is_not_boilerplate(spark):
    rows = [(k, f"{prose(40, k)}\nAll rights reserved here\n{prose(30, 500 + k)}", "en", f"s{k}") for k in range(15)]
    rows += [(50 + k, f"{prose(40, 50 + k)}\nOn nine sites only\n", "en", f"s{k % 9}") for k in range(30)]
    rows += [(90, "All rights reserved here", "en", "s1"), (91, "All rights reserved here\nAll rights reserved here", None, None)] + odd_rows()
    docs = table(spark, rows)
    for bound in (op1_lines.BROADCAST_LINES, 0):
        frame, name = op1_lines.cleaned(docs, broadcast_lines=bound)
        got = {r.doc_id: (r.text, r[name]) for r in frame.collect()}
        assert got[3][0] == f"{prose(40, 3)}\n{prose(30, 503)}" and tuple(got[3][1]) == (3, 1)
        assert "nine sites" in got[50][0] and got[90] == ("All rights reserved here", got[90][1])
        assert got[91][1].n_removed == 0 and got[900][0] is None and got[901][0] == ""
        assert frame.count() == len(rows)


def test_short_documents_of_mostly_boilerplate_are_cleaned(spark):
    furniture = ["All rights reserved by whoever runs the site you read", "Sign up for our weekly letter and never miss a thing"]
    rows = [(k, f"{furniture[0]}\n{prose(40, k)}\n{furniture[1]}", "en", f"s{k}") for k in range(12)]
    rows += [(50, f"{furniture[0]}\nown line\n{furniture[1]}", "en", "s1"), (51, "\n \n".join(furniture), "en", "s1"), (52, f"{furniture[0]}\nx", None, None)]
    for bound in (op1_lines.BROADCAST_LINES, 0):
        frame, name = op1_lines.cleaned(table(spark, rows), broadcast_lines=bound)
        got = {r.doc_id: (r.text, *r[name]) for r in frame.collect()}
        assert got[50] == ("own line", 3, 2) and got[52] == ("x", 2, 1) and got[51] == ("\n \n".join(furniture), 2, 0)
    texts = {r.doc_id: (r.text, r.n_chars) for r in op1_lines.without_boilerplate(table(spark, rows)).collect()}
    assert texts[50] == ("own line", 8) and texts[51][0] == "\n \n".join(furniture) and texts[3][0] == prose(40, 3)


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(100 * n + k, f"line of {n} sites\n{prose(30, 100 * n + k)}", "en", f"t{k}") for n in range(8, 13) for k in range(n)]
    found = op1_lines.boilerplate(table(spark, rows), 10).collect()
    assert {bytes(r.line) for r in found} == {hashlib.md5(f"line of {n} sites".encode()).digest() for n in (10, 11, 12)}


def test_pii_equals_plain_patterns(spark):
    texts = ["a@b.co, x.y+z@mail-1.example.com.", "a@b.c+d@e.f @@ a@ @b.c", "1.2.3.4.5 300.1.1.1 0255.1.1.01", "4537960215852590 4111 1111 1111 1111 1234567890123", "+1 (773) 555-3030 and +4 9 +12 (", "é 47.129.145.209 ü x@é.fr", "a" * 30000 + "@", "9" * 20000, "1-2-3 4 5", "+1" * 500]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + odd_rows()
    found = op7_pii.sanitised(table(spark, rows)).select("doc_id", "text", op7_pii._rendered(F.col("spans")).alias("r"), op7_pii.sanitised_text(F.col("text"), F.col("spans_found")).alias("clean"))
    for r in found.collect():
        assert r.r == rendered(pii(r.text)), r.text[:80]
        assert not [s for s in pii(r.clean) if s[3] == "email"]


def test_disclosing_terms_equal_plain_counts(spark):
    texts = [f"{prose(20, k)} write to boss@corp.example about projectzeta now {prose(10, 100 + k)}" for k in range(6)]
    texts += [f"{prose(20, 200 + k)} common word about {prose(5, 300 + k)}" for k in range(20)] + ["projectzeta alone? no", "mail x@y.zz", None, ""]
    terms = disclosing(texts, op7_pii.REACH, op7_pii.SUPPORT, op7_pii.DISCLOSURE)
    assert "write" in terms and "common" not in terms
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in op7_pii.sanitised(docs).select("doc_id", op7_pii._rendered(F.col("spans_found")).alias("r")).collect():
        assert r.r == rendered(all_spans(texts[r.doc_id], terms))


@pytest.mark.parametrize("broadcast_terms", [op7_pii.BROADCAST_TERMS, 0])
def test_entities_of_one_document_disclose_terms(spark, monkeypatch, broadcast_terms):
    monkeypatch.setattr(op7_pii, "BROADCAST_TERMS", broadcast_terms)
    monkeypatch.setattr(op7_pii, "RARE", 2)
    texts = [f"{prose(20, k)} ends" for k in range(30)] + ["ask clerkname at one@a.example " + prose(5, 41), "ask twofold two@b.example", "twofold two@b.example again"]
    texts += [f"thrice {prose(3, 50 + k)} three@c.example" for k in range(3)] + ["clerkname2 ends " + "x " * 1200 + "four@d.example"]
    terms = disclosing(texts, op7_pii.REACH, 1, op7_pii.DISCLOSURE)
    assert {"clerkname", "twofold", "thrice"} <= terms and not {"ends", "clerkname2"} & terms
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in op7_pii.sanitised(docs).select("doc_id", op7_pii._rendered(F.col("spans_found")).alias("r")).collect():
        assert r.r == rendered(all_spans(texts[r.doc_id], terms))


def test_a_part_of_a_masked_word_is_no_term(spark):
    texts = [f"{prose(20, k)} ends" for k in range(30)] + ["mail me@a.example 4111111111111111zed", "zed alone"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.r for r in op7_pii.sanitised(docs).select("doc_id", op7_pii._rendered(F.col("spans_found")).alias("r")).collect()}
    assert got[31] == "" and got[30] == "term:0:4,email:5:17,card:18:34"


def test_sequences_make_up_the_texts(spark, tmp_path):
    rows = [(k, prose(40 * k, k), "en", "s") for k in range(30)] + odd_rows()
    table(spark, rows).repartition(5).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    total, in_shard = op2_order.write_shards(docs, str(tmp_path / "shards"))
    got = op2_order.read_shards(spark, str(tmp_path / "shards")).collect()
    assert sorted(r.slot for r in got) == list(range(total)) and all(r.byte_offset == r.slot % in_shard * op2_order.STRIDE for r in got)
    for i, text, *_ in rows:
        if text is not None:
            parts = sorted((r.seq_no, r.slot, bytes(r.ids)) for r in got if r.doc_id == i)
            copies = sum(1 for x in rows if x[:2] == (i, text))
            assert b"".join(p for k, (_, _, p) in enumerate(parts) if k % copies == 0) == text.encode() + b"\xff"
    assert sorted(r.slot for r in op2_order.read_shards(spark, str(tmp_path / "shards"), 17).collect()) == list(range(17, total))


@pytest.mark.parametrize("size", [1, 2, 3, 1000, 65537])
def test_the_permutation_is_one(size):
    p = op2_order.Permutation(size, 3)
    slots = p.slots(np.arange(size))
    assert sorted(slots) == list(range(size)) and (p.numbers(slots) == np.arange(size)).all()


def test_archive_round_trip(spark, tmp_path):
    page = "<html>" + prose(300, 1) + "é</html>"
    rows = [(1, "http://a/1", page), (2, "http://a/2", page), (5, None, page), (3, "http://a\r\n/3", "x"), (4, "u", "x"), (6, "u", None), (7, "u", ""), (None, "u", page), (8, "u", page + "!"), (8, "u", page + "!")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    op4_warc.write_archive(pages, str(tmp_path / "w"))
    got = op4_warc.read_records(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(rows)
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert kinds == {1: ("revisit", 5), 2: ("revisit", 5), None: ("revisit", 5), 5: ("response", None), 3: ("response", None), 4: ("response", None), 6: ("response", None), 7: ("response", None), 8: ("response", None)}
    for r in got:
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")).split()[1])
        assert block == (bytes(r.payload) if r.record_type == "response" else b"") + b"\r\n\r\n" and size == len(block) - 4
        assert bytes(r.payload).decode() in {h or "" for _, _, h in rows}
    index = {r.page_id: r for r in op4_warc.read_index(spark, str(tmp_path / "w")).collect()}
    assert index[1].payload_digest == hashlib.sha1(page.encode()).hexdigest() and index[1].payload_bytes == len(page.encode())


def test_the_archive_query_rebuilds_records(spark, tmp_path, monkeypatch):
    page = "<html>" + prose(300, 1) + "é</html>"
    rows = [(1, "u", page), (2, "u", page), (3, "u", "x"), (4, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    used, read = [], op4_warc.read_records
    monkeypatch.setattr(op4_warc, "read_records", lambda *a: used.append(a) or read(*a))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op4_warc.query(spark, str(tmp_path)).collect()}
    facts = {i: (len(h := (html or "").encode()), hashlib.sha1(h).hexdigest()) for i, _, html in rows}
    assert used and got == {i: (*facts[i], "revisit" if i == 1 else "response", 2 if i == 1 else None) for i in facts}


def languages(n: int):
    made = {"en": "the and of tion ing with that er".split(), "de": "der und ein sch keit ung zu über".split(), "fr": "le de que eau ion é aux tre".split()}
    return [(1000 * j + k, " ".join(random.Random(1000 * j + k).choices(parts, k=60)), lang, "s") for j, (lang, parts) in enumerate(made.items()) for k in range(n)]


def test_languages_are_told_apart(spark):
    docs = table(spark, languages(80) + odd_rows())
    got = op3_language.identify(docs, op3_language.learn(docs))
    rows = got.join(docs.where("n_chars > 60 AND doc_id > 0 AND source = 's'").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 30 and sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    odd = {r.doc_id: r.lang_pred for r in got.where("doc_id >= 900 AND doc_id < 950").collect()}
    assert odd[900] == odd[901] == odd[902] == odd[904] == "und" and odd[903] != "und"
    assert all(0 <= r.score <= 1 for r in got.collect())


def test_gradients_are_right():
    net = op3_language.Network(["a", "b", "c"], units=3)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    codes, answer = np.random.default_rng(0).integers(97, 102, (6, 5)), np.array([0, 1, 2, 0, 1])
    loss = lambda: -np.log(net.label(codes)[answer, :, np.arange(5)]).mean()
    grads = net.gradients(codes, answer)
    for name, at in (("fU", (1, 2)), ("bE", (4, 99)), ("fE", (7, 98)), ("bV", (2, 1)), ("bU", (8, 0)), ("c", (1, 0))):
        kept, step = net.weights[name][at], 1e-2
        net.weights[name][at] = kept + step
        up = loss()
        net.weights[name][at] = kept - step
        down = loss()
        net.weights[name][at] = kept
        assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-4


def test_quality_is_learned_and_calibrated(spark):
    r = random.Random(2)
    rows = [(k, prose(80, k) + "." if k % 3 else " | ".join(prose(40, k).split()) + " ###", "en", "s") for k in range(400)] + odd_rows()
    labels = spark.createDataFrame([(k, int(k % 3 > 0) if r.random() > 0.02 else 0) for k in range(400)] + [(None, 1), (5000, 0), (3, None)], "doc_id long, quality int")
    got = op6_quality.scored(table(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 400]
    assert len(held) > 40 and sum(x.predicted == int(x.doc_id % 3 > 0) for x in held) >= 0.97 * len(held)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {x.score for x in op6_quality.scored(table(spark, rows), none).collect()} == {0.5}


def test_nearest_neighbours(spark, monkeypatch):
    random_ = np.random.default_rng(0)
    centres = random_.normal(size=(30, 16))
    x = (centres[random_.integers(0, 30, 6000)] + 0.3 * random_.normal(size=(6000, 16))).astype(np.float32)
    x[:1500] = x[0]
    monkeypatch.setattr(op8_ann, "BLOCK", 500)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(7000, None, 1), (7020, [0.0] * 16, 1), (7040, [float("nan")] * 16, 1), (7060, [1.0] * 3, 1), (None, [1.0] * 16, 1), (7080, [None] * 16, 1), (7100, [float("inf")] + [0.0] * 15, 1), (5999, x[5999].tolist(), 1)]
    got: dict[int, list] = {}
    for r in op8_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    exact, hit = x.astype(np.float64), 0
    assert sorted(got) == list(range(0, 6000, 20))
    for q, found in got.items():
        score = (exact * exact[q]).sum(axis=1)
        score[q] = -np.inf
        best = np.lexsort((np.arange(6000), -score))[:20]
        hit += len(set(best) & {v for v, _ in found})
        assert all(s == score[v] for v, s in found) and q not in [v for v, _ in found] and len({v for v, _ in found}) == 20
    assert hit >= 0.9 * 20 * len(got)
    small = spark.createDataFrame([(20 * i, [float(i), 1.0], 0) for i in range(1, 6)], "vec_id long, embedding array<float>, label int")
    assert op8_ann.nearest(small).count() == 20
    assert op8_ann.nearest(small.limit(0)).count() == 0


def test_a_vector_repeated_often_hides_no_neighbours(spark):
    x = np.random.default_rng(3).normal(size=(400, 8))
    ids, rows = np.arange(400), x.copy()
    best = int(np.lexsort((ids, -np.where(ids == 0, -np.inf, x @ x[0])))[0])
    ids, rows = np.concatenate([ids, np.full(60, best)]), np.concatenate([rows, np.repeat(x[best : best + 1], 60, axis=0)])
    for order in (np.arange(460), np.random.default_rng(4).permutation(460)):
        _, found, _ = op8_ann._best(ids[order], rows[order], np.array([0]), x[:1], 20)
        score = np.where(np.arange(400) == 0, -np.inf, (x * x[0]).sum(axis=1))
        assert found.tolist() == np.lexsort((np.arange(400), -score))[:20].tolist()
    docs = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, rows, strict=True)], "vec_id long, embedding array<double>")
    assert op8_ann.nearest(docs).groupBy("query_id").count().where("count <> 20").count() == 0


def test_empty_tables(spark):
    docs = table(spark, [])
    bench = spark.createDataFrame([("a", "x y z")], "item_id string, text string")
    assert op5_jaccard.near_duplicates(docs).count() == 0 and op5_jaccard.one_of_each(docs).count() == 0
    assert op10_decontaminate.contamination(docs, bench).count() == 0 and op9_bpe.encode(docs, op9_bpe.vocabulary()).count() == 0
    assert op1_lines.without_boilerplate(docs).count() == 0 and op7_pii.sanitised(docs).count() == 0
    assert op3_language.identify(docs, op3_language.learn(docs)).count() == 0
    assert op6_quality.scored(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
