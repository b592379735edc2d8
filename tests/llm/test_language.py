import zlib

from twinpane.llm import language as m

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = m.op9_language(spark, SF).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_counts_match_a_plain_count():
    texts, langs = ["Ab c'ab ÉÉ", None, "abc ab", ""], ["x", "x", "y", "y"]
    learner = m._Learner({"x": 0, "y": 1})
    learner.add(texts, langs)
    got = {}
    for b in learner.rows():
        for n, h, lang, c in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            got[n, lang, h] = got.get((n, lang, h), 0) + c
    for order in (0, *m.ORDERS):
        for lang in (0, 1):
            plain = {}
            for t, name in zip(texts, langs, strict=True):
                if "xy".index(name) != lang:
                    continue
                for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split():
                    padded = w if order < 2 else f" {w} "
                    for g in [w] if order == 0 else [padded[i : i + order] for i in range(len(padded) - order + 1)]:
                        plain[g] = plain.get(g, 0) + 1
            assert sorted(plain.values()) == sorted(c for (n, x, _), c in got.items() if (n, x) == (order, lang))


def test_edges(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", "p"), (2, "le chat et le chien", "fr", "p"), (3, None, "en", "p"), (4, "le chat et le chien", "fr", None), (5, "the cat and the dog", None, "p"), (6, "the cat", "en", "p")], "doc_id long, text string, lang string, lang_pred string")
    model = m.learn(docs)
    ask = spark.createDataFrame([(1, "THE CAT " * 40_000, "q"), (2, "le chien", "q"), (3, None, "q"), (4, "", "q"), (5, "123 !? — €", "q"), (6, "ж", "q"), (2, "le chien", "q"), (7, "chiens", "q"), (8, "\x00dog퟿", "q")], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in m.identify(ask, model).collect()}
    assert [got[i].lang_pred for i in range(1, 8)] == ["en", "fr", "und", "und", "und", "en", "fr"]
    assert got[3].score == 0.0 and 0 < got[7].score <= 1
    assert m.identify(ask, model).columns == ["doc_id", "text", "lang_pred", "score"]
    assert m.identify(ask.limit(0), model).count() == 0
    empty = m.learn(docs.limit(0))
    assert {r.lang_pred for r in m.identify(ask, empty).collect()} == {"und"}
