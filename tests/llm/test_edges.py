"""Cases that once went wrong: odd ids, long texts, rows that repeat an id, values of any length."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinpane.llm import decontaminate, jaccard, language, licenses, lm, mixing, quality, secrets, topk
from twinpane.llm.common import crc_fold, marked

WORDS13 = "one two three four five six seven eight nine ten eleven twelve thirteen"


def test_items_without_an_id_have_the_empty_id(spark):
    items = spark.createDataFrame([(None, WORDS13), ("b", WORDS13 + " fourteen"), ("b", None)], "item_id string, text string")
    docs = spark.createDataFrame([(1, WORDS13 + " fourteen"), (2, "clean")], "doc_id long, text string")
    got = {r.doc_id: r.contamination for r in decontaminate.find_contamination(docs, items).collect()}
    assert got[1]["items"] == ["", "b"] and got[1]["n_hit"] == 14 and got[2]["items"] == []
    assert decontaminate.find_contamination(docs.limit(0), items).count() == 0


def test_flat_automaton_of_many_words():
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(300)]
    items = [(str(i), " ".join(rng.choices(vocab, k=rng.choice([4, 13, 60]))).encode()) for i in range(200)]
    auto = decontaminate.Automaton(items, 13)
    assert auto.next == [] and len(auto.token) == len(auto.link) == len(auto.window_item)
    found, intervals = set(), []
    ids = [auto.words.index(w.encode()) for w in items[7][1].decode().split()]
    auto.stream(ids, 0, intervals, found)
    assert "7" in {auto.names[i] for i in found}


def test_folds_of_ids_that_are_text_or_null(spark):
    import zlib

    rows = [("doc-1",), (None,), ("7",)]
    got = spark.createDataFrame(rows, "doc_id string").select(crc_fold("doc_id", 7).alias("f")).collect()
    assert [r.f for r in got] == [zlib.crc32((x or "").encode()) % 7 for (x,) in rows]
    assert spark.createDataFrame([(7,)], "doc_id long").select(crc_fold("doc_id", 7).alias("f")).first().f == zlib.crc32(b"7") % 7


def test_bitmap_semi_join_keeps_all_matches(spark):
    keys = spark.createDataFrame([(1, 5), (None, 6)], "a long, b long")
    rows = spark.createDataFrame([(1, 5), (1, 6), (None, 6), (None, None), (2, 7)], "a long, b long")
    got = {(r.a, r.b) for r in marked(rows, keys, ["a", "b"], "maybe").where("maybe").collect()}
    assert {(1, 5), (None, 6)} <= got and len(got) <= 3


def test_bitmaps_bound_what_sets_have_in_common():
    rng = np.random.Generator(np.random.PCG64(5))
    for _ in range(200):
        n, m, both = rng.integers(1, 400, 3).tolist()
        both = min(n, m, both)
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        y = np.concatenate([x[:both], rng.integers(0, 1 << 63, m - both, dtype=np.uint64)])
        for factor in (1, 2, 8):
            assert jaccard.most_common(jaccard.bitmap(x, factor), n, jaccard.bitmap(y, factor), m) >= both


@pytest.mark.parametrize("cell", [200, 1 << 20])
def test_one_row_of_each_component_stays(spark, monkeypatch, cell):
    for name in ("CELL_STRAYS", "CELL_ROWS", "TEXT_STRAYS", "TEXT_ROWS"):
        monkeypatch.setattr(jaccard, name, cell)
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    base = [f"w{i}" for i in range(60)]
    near = [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(30)]
    rows = [(5, " ".join(base)), *((i, t) for i, t in enumerate(near, 5)), (None, " ".join(base)), (None, near[3]), (5, "alone in the world of many words"), (5, "alone in the world of many words"), (9, None), (9, None), (8, "")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, source string, node int").repartition(4)
    got = sorted(((r.doc_id, r.text) for r in jaccard.deduplicate(docs).collect()), key=str)
    alike = [r for r in got if r[1] and "w1" in r[1].split()]
    assert len(alike) == 1 and alike[0][0] == 5
    assert [r for r in got if r[1] and r[1].startswith("alone")] == [(5, "alone in the world of many words")]
    assert [r for r in got if not r[1]] == [(8, ""), (9, None), (9, None)]
    assert jaccard.deduplicate(docs).columns == docs.columns and jaccard.deduplicate(docs.limit(0)).count() == 0


def test_cells_read_every_batch():
    words = lambda k: " ".join(f"a{k}{i}" for i in range(9))
    one = lambda ids, roots, texts, p="": pa.table([pa.array(ids, pa.int64()), pa.array(roots, pa.int64()), pa.array(texts)], names=[p + "id", p + "root", p + "text"])
    left = one([1], [1], [words(7)])
    right = pa.concat_tables([one([i], [i], [words(i)], "r_") for i in range(2, 12)])
    assert right.column("r_id").num_chunks == 10
    assert jaccard._cell(5, 80)(left, right).to_pylist() == [{"a": 1, "b": 7}]


def test_long_weak_values_and_far_links():
    name = "u" * 300
    text = f"username: {name} " + "filler words here " * 40 + "password = hunter2hunter2"
    kinds = {k: text[s:e] for s, e, k in secrets.spans_of(text)}
    assert kinds["weakid"] == f"username: {name}" and kinds["assign"].startswith("password")
    assert {k for _, _, k in secrets.spans_of(text.replace("filler words here ", "\n\n", 1))} == {"assign"}
    spaced = "login" + " " * 9 + ":  admin  pwd" + " " * 7 + "= secretive"
    assert {k for _, _, k in secrets.spans_of(spaced)} >= {"weakid", "weaksecret"}


def test_mixing_keeps_a_column_named_hash(spark):
    docs = spark.createDataFrame([(i, "a b", "s", i) for i in range(4)], "doc_id long, text string, source string, hash long")
    assert "hash" in mixing.mix(docs).columns and mixing.mix(docs.limit(0)).count() == 0


def test_markup_and_whole_licence_files(spark):
    text = "MIT License\nCopyright (c) 2020 Jane\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows = [("a/x", "<p>Licensed under the <b>MIT</b> License.</p>"), ("b/LICENSE", text), ("b/c/d", "code"), ("c/long", "word " * 200_000 + "Released under the MIT License. " + "word " * 200_000), ("d/german", "mit " * 50_000)]
    got = {r.path: (r.license, r.inherited_from) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a/x": ("MIT", None), "b/LICENSE": ("MIT", None), "b/c/d": ("MIT", "b"), "c/long": ("MIT", None), "d/german": (None, None)}


def test_a_text_above_the_sample_is_passed_over(spark):
    docs = spark.createDataFrame([(i, ("good words " if i % 2 else "bad ~~ ## ") * (4000 if i == 0 else 5)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    net = quality.train(docs, labels, sample_bytes=5000)
    got = {r.doc_id: r.score for r in quality.score(docs, net, keep=["doc_id"]).collect()}
    assert min(got[i] for i in got if i % 2) > max(got[i] for i in got if not i % 2 and i)


def test_long_texts_are_scored_in_pieces_as_in_one():
    net = quality.Network(np.random.Generator(np.random.PCG64(1)))
    data = np.random.Generator(np.random.PCG64(2)).integers(1, 256, 300_001).astype(np.uint8)
    whole, _ = net.forward(data, np.array([0, len(data)]))
    assert np.allclose(whole, net.long_features(data, 5), rtol=1e-4) and np.allclose(net.features(data, np.array([0, len(data)])), whole, rtol=1e-4)


def test_hashes_travel_whole():
    values = np.unique(np.random.Generator(np.random.PCG64(3)).integers(0, 1 << 64, 5000, dtype=np.uint64))
    assert (lm.unpack_hashes(lm.pack_hashes(values)) == values).all() and len(lm.unpack_hashes(lm.pack_hashes(values[:0]))) == 0


# Language


def plain_counts(rows):
    words, grams = {}, {}
    for text, lang in rows:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            words.setdefault(w, {}).setdefault(lang, 0)
            words[w][lang] += 1
            for order in language.ORDERS:
                padded = f" {w} " if order > 1 else w
                for i in range(len(padded) - order + 1):
                    g = grams.setdefault(order, {}).setdefault(padded[i : i + order], {})
                    g[lang] = g.get(lang, 0) + 1
    return words, grams


def plain_score(text, rows, languages):
    """Word first, then five characters down to one, with a penalty a step, by dictionaries."""
    words, grams = plain_counts(rows)
    total = lambda table: {x: max(1, sum(v.get(x, 0) for v in table.values())) for x in languages}
    word_total, gram_total = total(words), {o: total(grams.get(o, {})) for o in language.ORDERS}
    log = lambda found, x, totals: math.log((found.get(x) or 0.5) / totals[x])
    n = {x: sum(r[1] == x for r in rows) for x in languages}
    points = {x: math.log(n[x] / len(rows)) for x in languages}
    tokens = re.findall(r"[^\W\d_]+", (text or "").lower())
    for w in tokens:
        if w in words:
            for x in languages:
                points[x] += log(words[w], x, word_total)
            continue
        for step, order in enumerate(language.ORDERS):
            padded = f" {w} " if order > 1 else w
            known = [grams[order][g] for i in range(len(padded) - order + 1) if (g := padded[i : i + order]) in grams.get(order, {})]
            if known:
                for x in languages:
                    points[x] += sum(log(g, x, gram_total[order]) for g in known) / len(known) * max(len(w) / order, 1) - step
                break
    if not tokens:
        return "und", 0.0
    top = max(points.values())
    share = {x: math.exp(v - top) for x, v in points.items()}
    best = max(sorted(share), key=share.get)
    return best, share[best] / sum(share.values())


def test_scores_against_a_plain_scorer(spark):
    rng = random.Random(4)
    stems = {"de": ["haus", "der", "und", "straße", "grün"], "en": ["house", "the", "and", "street", "green"], "fr": ["maison", "le", "et", "rue", "vert"]}
    rows = [(" ".join(rng.choices(v, k=rng.randint(1, 9))) + rng.choice([".", "!", " 12"]), k) for k, v in stems.items() for _ in range(15)]
    asked = [t for t, _ in rows] + ["hausen streets", "zzz", "HOUSE-und x", "grünes maisonette", "日本", "", "123", None, "\U000e0020\U000e0041", "a" * 40]
    model = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    got = list(zip(*model.score(asked)))
    for text, (lang, score) in zip(asked, got, strict=True):
        want = plain_score(text, rows, sorted(stems))
        assert lang == want[0] and abs(score - want[1]) < 1e-4, (text, lang, score, want)


def test_long_texts_and_bounded_samples(spark):
    rows = [(f"wort{i % 7} der die das", "de") for i in range(300)] + [(f"word{i % 5} the of and", "en") for i in range(20)]
    frame = spark.createDataFrame(rows, "text string, lang string")
    small = language.learn(frame, sample_bytes=2000)
    whole = language.learn(frame)
    assert small.languages == whole.languages and (small.prior == whole.prior).all()
    assert small.score(["der die das"])[0] == ["de"] and small.score(["the of and"])[0] == ["en"]
    long = "der die das " * 60_000
    assert len(list(language.pieces(long))) == 3 and "".join(language.pieces(long)) == long and "".join(language.pieces("x" * 600_000)) == "x" * 600_000
    total, words = whole.points([long[:120]])
    lang, score = whole.score([long])
    assert lang == ["de"] and score[0] > 0.999 and words[0] == 30


def test_cells_of_vectors_cover_the_space():
    rng = np.random.Generator(np.random.PCG64(6))
    sample = np.floor(rng.normal(0, 50, (800, 5)))
    tree, n = topk.cells(sample, 16)
    assert n > 8 and set(topk.cell_of(np.floor(rng.normal(0, 90, (4000, 5))), tree)) <= set(range(n))
    same, n = topk.cells(np.ones((500, 3)), 16)
    assert n == 1 and set(topk.cell_of(np.ones((9, 3)), same)) == {0}


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline as p

    rows = [(1, "the house and the street " * 3, "en", "a"), (None, "the house and the street " * 3, "en", "a"), (3, None, None, None), (4, "", "de", "b"), (5, "der und das haus " * 4, "de", None), (5, "der und das haus " * 4, "de", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, hash string")
    kept = p.language_stage(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == {1, None, 5} and kept.columns == docs.columns
    once = p.duplicates_stage(spark, kept, "")
    assert sorted((r.doc_id for r in once.collect()), key=str) == [1, 5] and once.columns == docs.columns
    mixed = p.mixing_stage(spark, p.secrets_stage(spark, once, ""), "")
    assert {"hash", "taken", "target"} <= set(mixed.columns) and mixed.select(F.sum("taken")).first()[0] > 0
    for name, stage in p.STAGES[:2]:
        assert stage(spark, docs.limit(0), "").count() == 0, name
