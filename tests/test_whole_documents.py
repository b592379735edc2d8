"""Queries that must read whole documents and pages, compared with plain Python."""

import html

from twinpane.plans import catalog

TEXTS = ["Grüße an alle", "Grusse an alle", "日本語 текст ß", "日本 text", None, "", "emoji 😀 x", "emoji 😁 x"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_neighbours_with_non_ascii_texts(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.distance, r.jaccard) for r in catalog.queries()["f02_f03_jaccard_and_edit_distance"](spark, str(tmp_path)).collect()}
    assert set(got) == set(range(len(TEXTS) - 1))
    for i, (a, b) in enumerate(zip(TEXTS, TEXTS[1:])):
        if a is None or b is None:
            assert got[i][0] is None
            continue
        low = [{w for w in x.translate({c: c + 32 for c in range(65, 91)}).split(" ") if w} for x in (a, b)]
        assert got[i][0] == distance(a[:200], b[:200])
        assert abs(got[i][1] - (len(low[0] & low[1]) / len(low[0] | low[1]) if low[0] | low[1] else 1.0)) < 1e-12


def test_evidence_is_escaped_to_its_end(spark, tmp_path):
    page = "<p title=\"a\">it's & more</p>" * 40
    spark.createDataFrame([(1, page), (2, None)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.raw, r.safe) for r in catalog.queries()["f24_escaped_evidence"](spark, str(tmp_path)).collect()}
    assert got == {1: (page, html.escape(page).replace("&#x27;", "&#39;")), 2: (None, None)}
