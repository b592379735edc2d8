import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pyarrow.dataset
import pytest
from pyspark.sql import functions as F

from twinpane.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def split(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]  # None: the end


def bucket(c):
    return 0 if c == 0 else 1 + math.floor(math.log2(c))


def brute(rows, iterations=lm.ITERATIONS):
    """(doc_id, held_out, n_tokens, n_known, N, base, score), with EM over single held-out tokens."""
    uni, pair = Counter(), Counter()
    for _, text, train in rows:
        if train:
            t = split(text)
            uni.update(t)
            pair.update(zip([None, *t[:-1]], t, strict=True))  # the start's context is counted by the ends
    n, v = sum(uni.values()), len(uni)
    held: dict = {}
    for _, text, train in rows:
        if train:
            t = split(text)
            for u, w in zip([None, *t[:-1]], t, strict=True):
                c1 = uni[u] - 1
                held.setdefault(bucket(c1), []).append(((pair[u, w] - 1) / max(c1, 1) if c1 else 0.0, (uni[w] - 1) / max(n - 1, 1), 1 / (v + 1)))
    lam = {}
    for b, tokens in held.items():
        x = [1 / 3] * 3
        for _ in range(iterations):
            new = [1.0, 1.0, 1.0]
            for p in tokens:
                s = sum(a * q for a, q in zip(x, p, strict=True))
                for i in range(3):
                    new[i] += x[i] * p[i] / s
            x = [y / sum(new) for y in new]
        lam[b] = x if b else [0, x[1] + x[0] / 2, x[2] + x[0] / 2]
    out = []
    for d, text, train in rows:
        t = split(text)
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for u, w in zip([None, *t[:-1]], t, strict=True):
            b = bucket(uni[u])
            x = lam.get(b) or (lam[max((k for k in lam if k < b), default=0)] if b and any(k < b for k in lam) else lam.get(0, (0, 0.5, 0.5)))
            score += math.log10(x[0] * pair[u, w] / max(uni[u], 1) + x[1] * uni[w] / max(n, 1) + x[2] / (v + 1)) if n else 0
        out.append((d, not train, len(t), sum(uni[w] > 0 for w in t), n, base, score))
    return out


def close(got, want, score_tolerance=2e-3):
    got, want = sorted(got, key=str), sorted(want, key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=score_tolerance)


COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


@pytest.mark.parametrize(("block", "entries"), [(400, 5), (8 << 20, 2_000_000)])
def test_small_against_brute_force(spark, block, entries):
    texts = ["a b c a b", "A B\tc d é", None, "", "x", "a b c a b", "the end", "a " * 3000, "b c\n\x0b d É"] * 3 + [f"w{i} a b w{i % 7}" for i in range(60)]
    rows = [(i % 70, t, i % 4 != 1) for i, t in enumerate(texts)] + [(None, "a b", True), (3, "a b", False)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, train boolean").withColumn("score", F.lit("x")).repartition(4)
    got = lm.score_corpus(frame, F.col("train"), block_bytes=block, slice_entries=entries).select(*COLUMNS)
    close([tuple(r) for r in got.collect()], brute(rows))


def test_whole_table_and_held_out_likelihood(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in lm.op10_lm(spark, sf).select(*COLUMNS).collect()]
    close(got, brute(rows, 100))
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_spark_rows_hold_no_texts(spark):
    texts = [f"word{i} " * 500 for i in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    found = lm.score_corpus(frame, F.lit(True), block_bytes=8000)
    kept = spark.read.parquet(*found.inputFiles())
    assert "binary" not in {kind for _, kind in kept.dtypes}
    assert kept.agg(F.sum("size")).first()[0] == sum(map(len, texts))
    assert kept.count() * lm.BLOCKS_A_FILE * 8000 < 2 * sum(map(len, texts))
    assert found.count() == 200


def test_answers_of_a_file_are_read_once(tmp_path, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["a b", "b c", "c"], "train": [True, True, True]})
    files = list(lm._pack(f"file://{tmp_path}/texts", 3)([batch]))
    assert [x.num_rows for x in files] == [1]
    asked = [x for y in lm._asks(f"file://{tmp_path}/texts", 1)(files) for x in y.to_pylist()]
    for kind in (1, 2):
        got = lm._answers(pa.Table.from_pylist([x for x in asked if x["kind"] == kind], lm_schema()))
        pyarrow.dataset.write_dataset(got, f"{tmp_path}/answers", basename_template=f"{kind}-{{i}}.parquet", format="parquet", partitioning=["file"], partitioning_flavor="hive", existing_data_behavior="overwrite_or_ignore")
    opened, real = [], pyarrow.dataset.dataset
    monkeypatch.setattr(pyarrow.dataset, "dataset", lambda *a, **b: opened.append(a) or real(*a, **b))
    shelf = lm._Shelf(f"file://{tmp_path}/answers", 1)
    totals = [shelf.totals(block := lm.Block(row), row["block"], file)[0][block.word].tolist() for file, row in lm.blocks_of(f"file://{tmp_path}/texts", files)]
    assert totals == [[1, 2, 3], [2, 2, 3], [2, 3]]  # words and the end of each text, over all blocks
    assert len(opened) == 1


def lm_schema():
    return pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("file", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])


def test_no_training_and_empty(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in lm.score_corpus(frame, F.lit(False)).select(*COLUMNS).collect())
    assert got == [(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)]
    assert lm.score_corpus(frame.limit(0), F.lit(True)).count() == 0
