import duckdb

from twinpane.llm import licenses as li

SF = "/root/testdata/sf0.1"


def test_equals_sql_on_the_whole_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(li.OP2_SQL).fetchall(), key=str)
    got = sorted((tuple(r) for r in li.op2_licenses(spark, SF).collect()), key=str)
    assert got == want
    assert any(r[2] for r in got) and any(r[5] for r in got)


def test_inheritance_ties_and_edges(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        ("a/LICENSE", mit + "\n" + "long text " * 900), ("a/b/c/x.py", "code"), ("a/b/COPYING", gpl), ("a/b/y.py", "code"), ("a/z.py", gpl + "\ncode " * 99),
        ("top.py", "code"), ("q/w.py", None), ("a2/x.py", "code"), (None, mit), (None, None), ("a/z.py", "other row of the file"), ("a/LICENSE.txt", gpl),
        ("e/f", ""), ("LICENSED/none", "license license license of nothing known"), ("/abs/LICENSE", gpl), ("/abs/x", "x"),
    ]
    files = spark.createDataFrame([(p, t, "clash", 1) for p, t in rows], "path string, text string, license string, dir int")
    got = {(r.path, r.license, r.inherited_from, r.own_license) for r in li.scan(files).collect()}
    assert got == {
        ("a/LICENSE", "MIT", None, "MIT"), ("a/b/c/x.py", "GPL-3.0", "a/b", None), ("a/b/COPYING", "GPL-3.0", None, "GPL-3.0"), ("a/b/y.py", "GPL-3.0", "a/b", None),
        ("a/z.py", "GPL-3.0", None, "GPL-3.0"), ("top.py", None, None, None), ("q/w.py", None, None, None), ("a2/x.py", None, None, None), (None, None, None, None),
        ("a/LICENSE.txt", "GPL-3.0", None, "GPL-3.0"), ("e/f", None, None, None), ("LICENSED/none", None, None, None), ("/abs/LICENSE", "GPL-3.0", None, "GPL-3.0"), ("/abs/x", "GPL-3.0", "/abs", None),
    }
    assert li.scan(files).count() == len(rows) and li.scan(files.limit(0)).count() == 0
    assert set(li.scan(files).columns) == {"path", "text", "dir", *li.RESULTS}
    root = spark.createDataFrame([("LICENSE", mit), ("a/b.py", "x")], "path string, text string")
    assert {r.license for r in li.scan(root).collect()} == {"MIT"}


def test_plan_has_no_python(spark):
    plan = li.op2_licenses(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
