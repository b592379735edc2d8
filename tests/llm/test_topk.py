import math
import random

import duckdb
import pytest

from twinpane.llm import topk as t

SF = "/root/testdata/sf0.01"


def test_equals_sql_on_the_whole_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(tuple(r) for r in t.op3_topk(spark, SF).collect()) == sorted(con.execute(t.OP3_SQL).fetchall())


def brute(rows, k, every):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(whole):
        if i % every == 0:
            found = sorted(((-sum(a * b for a, b in zip(v, c, strict=True)), j) for m, (j, c) in enumerate(whole) if m != n and len(c) == len(v)))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [7, 1000])
def test_against_brute_force(spark, shard_rows):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    rows += [(i, [0.5] * 6) for i in range(400, 560)]  # ties and a hot vector
    rows += [(50, [0.25] * 6), (50, [0.25] * 6), (50, rows[3][1])]  # repeated ids
    rows += [(600, None), (650, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (651, [float("nan")] * 6), (652, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(700, [1.0, 2.0]), (701, [3.0, -1.0]), (750, []), (800, [9.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = t.top_k(frame.selectExpr("*", "1 as rank", "2 as score").repartition(4), k=5, every=50, shard_rows=shard_rows)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, 50)


def test_large_components_are_exact(spark):
    rows = [(i, [2.0**40 + i * 2.0**-8, float(3 - i)]) for i in range(0, 12)]
    rows = [(i, [x / 2.0**20, y]) for i, (x, y) in rows]
    rows += [(50, [float(2**21 + 1), 1.0]), (100, [float(2**21), 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in t.top_k(frame).collect()) == brute(rows, 5, 50)


def test_empty(spark):
    frame = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert t.top_k(frame).count() == 0 and t.top_k(frame.limit(0)).count() == 0
    assert t.top_k(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).count() == 0
