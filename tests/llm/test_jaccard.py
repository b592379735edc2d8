import random
import re

import pytest

from twinpane.llm import jaccard as j

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, size=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, percent=80):
    """(doc_id, n_shingles, component_id) by comparing all pairs of texts that share a shingle."""
    sets = {t: frozenset(shingles(t)) for _, t in rows}
    kinds = sorted(set(sets.values()), key=len)
    root = {s: s for s in kinds}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if len(a) and 100 * len(a) >= percent * len(b):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    root[find(a)] = find(b)
    least = {}
    for d, t in rows:
        if sets[t] and d is not None:
            r = find(sets[t])
            least[r] = min(d, least.get(r, d))
    return sorted(((d, len(sets[t]), least.get(find(sets[t])) if sets[t] else d) for d, t in rows), key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize(("small", "pivots", "hot"), [(40, 8, 16), (4, 1, 2), (3, 2, 10**9)])
def test_against_brute_force(spark, monkeypatch, small, pivots, hot):
    monkeypatch.setattr(j, "SMALL", small)
    monkeypatch.setattr(j, "PIVOTS", pivots)
    monkeypatch.setattr(j, "HOT_MIN", hot)
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(500)] + ["É", "a,b"]
    text = lambda n: rng.choices(vocab, k=n)
    rows, passage = [], text(60)
    for _ in range(4):
        base = text(rng.choice([30, 60, 150]))
        for _ in range(40):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 2)] = text(rng.randint(0, 2))
            rows.append(" ".join(t))
    for _ in range(60):  # a passage that many different documents share, some almost nothing but it
        rows.append(" ".join(text(rng.choice([2, 8, 100])) + passage + text(rng.choice([0, 3, 100]))))
    rows += [" ".join(text(rng.randint(1, 8))) for _ in range(30)] + ["one two", "ONE\t two", "one  two\n", "one two three", None, None, "", " \n", " ".join(text(20_000))]
    rows += rng.choices(rows, k=60)
    rng.shuffle(rows)
    pairs = [(i * 7 % 1009, t) for i, t in enumerate(rows)]
    pairs += [(None, "one two"), (None, "alone in the world of words"), (pairs[5][0], pairs[9][1]), (pairs[5][0], pairs[5][1]), (-4, "one two")]
    frame = spark.createDataFrame(pairs, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as node").repartition(5)
    assert got(j.near_duplicates(frame)) == brute(pairs)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = got(j.op5_jaccard(spark, sf))
    assert found == brute(rows)
    assert len({r[2] for r in found}) < len(rows)


def test_no_links_and_empty(spark):
    frame = spark.createDataFrame([(1, "a b c d e f"), (2, "g h")], "doc_id long, text string")
    assert got(j.near_duplicates(frame)) == [(1, 2, 1), (2, 1, 2)]
    assert j.near_duplicates(frame.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 2000), (2000, 1000)], "a long, b long")
    want = {**{i: 0 for i in range(1, n + 1)}, 2000: 1000}
    assert {r.node: r.root for r in j.components(links).collect()} == want


def test_large_buckets_that_outlast_a_batch():
    import numpy as np
    import pyarrow as pa

    sizes = [1, 2, 90, 3, 250_000, 2, 45]
    tok = np.repeat(np.arange(len(sizes)), sizes)
    ids = np.arange(len(tok))
    table = pa.table({"tok": tok, "band": np.zeros(len(tok), np.int32), "id": ids, "n": np.full(len(tok), 10, np.int32)})
    out = pa.Table.from_batches(list(j._bucket_pairs(80)(iter(table.to_batches(max_chunksize=10_000))))).to_pandas()
    large = out[out.b.isna()]
    assert large.groupby("tok").size().to_dict() == {2: 90, 4: 250_000, 6: 45}
    pairs = out[out.b.notna()]
    within = tok[pairs.a.to_numpy()] == tok[pairs.b.astype(int).to_numpy()]
    assert within.all()
    count = np.bincount(tok[pairs.a.to_numpy()], minlength=len(sizes)).tolist()
    assert count[:2] == [0, 1] and count[3] == 3 and count[5] == 1 and count[4] == (250_000 - 1) * j.PIVOTS
