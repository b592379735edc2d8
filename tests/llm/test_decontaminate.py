import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from twinpane.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, window=13):
    def split(text):
        return WORD.findall((text or "").translate(LOWER))

    wins = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = split(text)
        hit, found = set(), set()
        for size in {len(k) for k in wins}:
            for i in range(len(w) - size + 1):
                if (names := wins.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    found |= names
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def rows(found):
    c = F.col("contamination")
    return sorted(tuple(r) for r in found.select("doc_id", c.n_words, c.n_hit, F.size(c.items), F.sha2(F.array_join(c.items, ","), 256), d.contaminated()).collect())


@pytest.mark.parametrize("shard_words", [60, 100_000])
def test_against_brute_force(spark, shard_words):
    rng = random.Random(5)
    vocab = ["a", "B", "ç", "d9", "É", "zz"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 5, 13, 14, 20, 40])))) for i in range(12) if i != 3]
    items += [(3, None), (50, items[4][1]), (51, "q x " + items[7][1])]
    items = [x for x in items if x[1] is None or len(WORD.findall(x[1])) != 1] + [(90, "Solo"), (2, items[2][1])]
    docs = []
    for i in range(150):
        parts = [" ".join(rng.choices(vocab + ["w1", "w2", "solo"], k=rng.randint(0, 60)))]
        if i % 3 == 0:
            t = rng.choice(items)[1] or ""
            parts.insert(rng.randint(0, 1), t.upper().replace(" ", rng.choice([" ", "\n", "--"])))
        docs.append((i, " ".join(parts)))
    docs += [(200, None), (201, ""), (202, "..."), (203, ("w1 " * 50_000) + (items[-3][1] or "")), (5, docs[3][1]), (5, docs[3][1])]
    got = d.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), keep=["doc_id"], shard_words=shard_words)
    assert rows(got) == sorted(brute(docs, items))


def test_whole_small_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted(tuple(r) for r in d.op1_decontamination(spark, sf).collect())
    assert got == sorted(brute(docs, items))
    assert any(r[5] for r in got)


def test_removal_empty_tables_and_names(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")], "item_id long, text string")
    passage = "One, two three four five six seven eight nine ten eleven twelve THIRTEEN"
    text = "ü " * 400 + passage + " end"
    docs = spark.createDataFrame([(1, text, "x", 7), (2, passage, "x", 7), (3, "clean", "x", 7), (4, None, None, None)], "doc_id long, text string, _contamination string, n_chars int")
    got = {r.doc_id: r for r in d.decontaminate(docs, items).collect()}
    assert set(got) == {1, 3, 4}
    assert got[1].text == "ü " * 400 + " end" and got[1].n_chars == len(got[1].text)
    assert got[3].text == "clean" and got[3].n_chars == 7 and got[4].text is None
    assert d.decontaminate(docs.limit(0), items).count() == 0
    assert d.decontaminate(docs, items.limit(0)).count() == 4
