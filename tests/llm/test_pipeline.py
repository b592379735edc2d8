"""The pipeline against a brute-force version of its stages; the language model itself is tested elsewhere."""

import test_decontaminate
import test_jaccard

import corpus_pipeline as p
from twinpane.llm import decontaminate, language, secrets

SF = "/root/testdata/sf0.001"


def cut(text, items):
    """text without the hit passages, by the words of brute force."""
    lower = text.translate(test_decontaminate.LOWER)  # capitals aren't word characters
    spans = [m.span() for m in test_decontaminate.WORD.finditer(lower)]
    low = [lower[a:b] for a, b in spans]
    wins = set()
    for _, t in items:
        w = test_decontaminate.WORD.findall((t or "").translate(test_decontaminate.LOWER))
        wins |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    hit = {i + k for n in {len(x) for x in wins} for i in range(len(low) - n + 1) if tuple(low[i : i + n]) in wins for k in range(n)}
    out, at = [], 0
    for i in sorted(hit):
        start = spans[i - 1][1] if i - 1 in hit else spans[i][0]
        out.append(text[at:start])
        at = spans[i][1]
    return "".join(out) + text[at:], len(hit), len(spans)


def test_pipeline(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = language.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    names, scores = model.score([r.text for r in docs.values()])
    texts = {d: docs[d].text for d, n, s in zip(docs, names, scores, strict=True) if n != "und" and s >= p.LEAST_SCORE}
    texts = {d: texts[d] for d, _, c in test_jaccard.brute(list(texts.items())) if d == c}
    clean = {}
    for d, t in texts.items():
        rest, n_hit, n_words = cut(t, items)
        if not (n_hit and 20 * n_hit >= n_words):
            clean[d] = rest
    for d, t in clean.items():
        parts, at = [], 0
        for s, e, _ in secrets.spans_of(t):
            if s >= at:
                parts += [t[at:s], "[secret]"]
            at = max(at, e)
        clean[d] = "".join(parts) + t[at:]
    got = {r.doc_id: r for r in p.run(spark, SF).collect()}
    assert set(got) <= set(clean)
    assert [d for d in got if got[d].text != clean[d]] == []
    assert [(d, got[d].n_chars, len(clean[d]), docs[d].n_chars, len(docs[d].text)) for d in got if got[d].n_chars != (len(clean[d]) if clean[d] != docs[d].text else docs[d].n_chars)] == []
    assert 0 < len(texts) < len(docs) and decontaminate.WINDOW == 13
    sizes = {d: len(test_jaccard.WORD.findall(t)) for d, t in clean.items()}
    by: dict = {}
    for d, n in sizes.items():
        by[docs[d].source] = by.get(docs[d].source, 0) + n
    assert [(d, r.size, sizes[d], r.source_size, by[r.source], r.taken) for d, r in got.items() if not (r.size == sizes[d] and r.source_size == by[r.source] and 0 < r.taken <= 2 * r.size)] == []
    for source in by:
        taken = sum(r.taken for r in got.values() if r.source == source)
        target = next((r.target for r in got.values() if r.source == source), 0)
        assert abs(taken - target) <= max(n for d, n in sizes.items() if docs[d].source == source)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, SF).count() == 0
