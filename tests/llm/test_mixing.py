import duckdb

from twinpane.llm import mixing as m

SF = "/root/testdata/sf0.01"


def test_equals_sql_on_the_whole_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(m.OP6_SQL).fetchall())
    got = m.op6_mixing(spark, SF)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sorted(tuple(r) for r in m.op6_mixing(spark, SF).collect()) == want


def fill(sizes, weights):
    """Shares by repeated capping."""
    left, open_, out = 1.5 * sum(sizes), set(range(len(sizes))), {}
    while open_:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / whole > 2 * sizes[i]]
        if not over:
            return {**out, **{i: left * weights[i] / whole for i in open_}}
        for i in over:
            out[i] = 2 * sizes[i]
            left -= out[i]
            open_.remove(i)
    return out


def test_targets_nulls_ties_and_names(spark):
    rows = [(i % 40, "w " * (i % 17), ["b", "a", None, "é", "Z", "one", "none"][0 if i % 3 == 0 else i % 6], "x", 5) for i in range(600)]
    rows += [(None, "a b c", "b", "x", 5), (None, "a b c", "b", "x", 5), (7, None, "none", "x", 5), (8, "", "none", "x", 5), (9, "word " * 20_000, "one", "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string, hash int")
    got = m.mix(docs).collect()
    assert len(got) == len(rows)
    names = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    sizes = [sum(len((r[1] or "").split()) for r in rows if r[2] == n) for n in names]
    want = fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    for i, n in enumerate(names):
        mine = [r for r in got if r.source == n]
        assert {r.source_size for r in mine} == {sizes[i]}
        assert abs(mine[0].target - want[i]) < 1e-6 * max(1, want[i])
        hashes: dict = {}
        for r in mine:
            hashes[r.doc_id] = hashes.get(r.doc_id, 0) + r.size
        assert abs(sum(r.taken for r in mine) - want[i]) <= max(hashes.values())
        assert all(r.taken <= 2 * r.size for r in mine)
    assert m.mix(docs.limit(0)).count() == 0


def test_plan_has_no_python(spark):
    plan = m.op6_mixing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
