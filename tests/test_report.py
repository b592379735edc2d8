import pytest
from pyspark.sql import functions as F

from twinpane.operators import ancestors as a
from twinpane.operators import report as r

ISSUE = "page_id long, id string, type string, severity string, message string, landmark string, heading string, fix_value double, ord int"


def issues(spark, rows):
    return spark.createDataFrame(rows, ISSUE)


@pytest.fixture(scope="module")
def few(spark):
    return issues(
        spark,
        [
            (1, "a", "missing_link", "warning", "x|y", "main", "Top", 2.0, 3),
            (1, "b", "missing_link", "error", "x|y", "main", "Top", 4.0, 1),
            (1, "c", "missing_text", "info", "two\nlines", "main", "Top", 1.0, 2),
            (1, "d", "missing_text", "error", "long " * 40, None, None, 9.0, 4),
            (1, "e", "page_gone", "critical", "gone", "main", None, 8.0, 0),
            (1, "f", "style_changed", "warning", "claimed", "banner", None, 3.0, 5),
            (2, "g", "missing_h1", "error", "o'k", "it's", None, 3.0, 0),
        ],
    )


def test_sections_and_budget(spark, few):
    claimed = spark.createDataFrame([(1, "f")], "page_id long, id string")
    got = {(x.page_id, x.place): x for x in r.outline(few, claimed, ["page_id"], ceiling=150).collect()}
    first, second, other = got[1, 1], got[1, 2], got[2, 1]
    assert set(got) == {(1, 1), (1, 2), (2, 1)}
    assert (first.landmark, first.heading, first.collapsed, second.collapsed) == ("(page)", "—", True, False)
    assert second.head == "### main › Top (3 issues) — show --section 'main' --heading 'Top'\n"
    assert second.lines == "- [error] missing_link ×2 — x\\|y\n- [info] missing_text ×1 — two lines\n"
    assert second.size == len((second.head + second.lines).encode()) and second.severity == "error"
    assert "(1 issue)" in other.head


def test_the_budget_ends_at_the_first_section_that_does_not_fit(spark):
    rows = [(1, str(i), "t", "error", "m" * n, f"l{i}", None, 10.0 - i, i) for i, n in enumerate((10, 900, 10))]
    frame = issues(spark, rows)
    none = frame.where("false")
    collapsed = lambda **k: [x.collapsed for x in r.outline(frame, none, ["page_id"], **k).orderBy("place").collect()]
    assert collapsed() == [False, False, False]
    assert collapsed(budget=500) == [False, True, True]
    assert collapsed(budget=500, ceiling=800) == [False, True, False]
    assert collapsed(budget=0) == [True, True, True]


def test_markdown(spark, few):
    regions = spark.createDataFrame([(1, "banner", "warning", ["f"], 0.875)], "page_id long, landmark string, severity string, members array<string>, saturation double")
    claimed = regions.select("page_id", F.explode("members").alias("id"))
    got = {x.page_id: x.report for x in r.markdown(few, claimed, regions, ["page_id"], ceiling=150).collect()}
    assert got[1] == (
        "## Critical defects\n\n- [critical] page_gone — gone — drill: show --issue e\n\n"
        "## Regions\n\n- [warning] banner — 1 issues, saturation 0.88 — drill: show --region 'banner'\n\n"
        "## Issues (table of contents)\n\n### main › Top (3 issues) — show --section 'main' --heading 'Top'\n- [error] missing_link ×2 — x\\|y\n- [info] missing_text ×1 — two lines\n"
        "- [error] (page) › — — 1 issues — drill: show --section '(page)'\n"
    )
    assert got[2].startswith("## Issues (table of contents)\n\n### it's › — (1 issue)")
    assert r.markdown(few.where("false"), claimed, regions.where("false"), ["page_id"]).count() == 0


def test_show(spark, few):
    ids = lambda frame: sorted(x.id for x in frame.collect())
    assert ids(r.show(few, ["page_id"], section="main")) == ["a", "b", "c", "e"]
    assert ids(r.show(few, ["page_id"], section="main", heading="—")) == ["e"]
    assert ids(r.show(few, ["page_id"], section="(page)")) == ["d"]
    assert ids(r.show(few, ["page_id"], issue="g")) == ["g"]
    assert ids(r.show(few, ["page_id"], members=few.where("id = 'f'"))) == ["f"]


def test_explain(spark):
    node = "pair_id string, viewport string, side string, id string, text string, role string, href string, cssSelector string, seqIndex int, bbox struct<x:int,y:int,w:int,h:int>, anchors struct<text:string,role:string,href:string,nearestHeading:string>"
    at = lambda side, id_, seq, y, anchors=None: ("p", "d", side, id_, "Buy now", None, None, "a.cta", seq, (0, y, 9, 9), anchors)
    nodes = spark.createDataFrame([at("old", "n9", 1, 5), at("old", "n2", 1, 4), at("old", "n1", 2, 3), at("new", "m1", 0, 7, (None, None, None, "Top"))], node)
    styles = spark.createDataFrame([("p", "d", "old", "n2", "color", "red"), ("p", "d", "new", "m1", "color", "red"), ("p", "d", "old", "n2", "gap", "1px"), ("p", "d", "old", "n1", "top", "2px")], "pair_id string, viewport string, side string, element_id string, prop string, value string")
    rows = lambda *x, **k: {(y.prop, y.old_value, y.new_value, y.changed) for y in r.explain(nodes, styles, *x, **k).collect()}
    assert rows("text", "Buy") == {("gap", "1px", "<absent>", True), ("bbox.y", "4", "7", True)}
    assert rows("selector", "cta", props=["color", "width"]) == {("color", "red", "red", False), ("width", "<absent>", "<absent>", False)}
    assert ("bbox.x", "<absent>", "0", True) in rows("nearestHeading", "Top")
    assert rows("id", "nothing") == set()
    with pytest.raises(ValueError):
        r.located(nodes, "colour", "x")


def test_ancestor_pairs(spark):
    k = "pair_id string, viewport string, "
    pairs = spark.createDataFrame([("p", "d", "o1", "n1"), ("p", "d", "o2", "n2")], k + "old_id string, new_id string")
    nodes = spark.createDataFrame([("p", "d", s, f"{s[0]}{i}") for s in ("old", "new") for i in (1, 2, 3)], k + "side string, id string")
    chain = lambda s, node, *up: [("p", "d", s, node, i, x) for i, x in enumerate(up)]
    chains = spark.createDataFrame(
        chain("old", "o1", "oa", "ob", "oc") + chain("old", "o2", "oc", "o1") + chain("new", "n1", "nb", "na", "nc") + chain("new", "n2", "nc") + chain("old", "o3", "ob") + chain("new", "n3", "nz"),
        k + "side string, node_id string, pos int, ancestor_id string",
    )
    ancestors = spark.createDataFrame([("p", "d", s, s[0] + x, t) for s, x, t in [("old", "a", "div"), ("old", "b", "div"), ("old", "c", "main"), ("new", "a", "div"), ("new", "b", "p"), ("new", "c", "section"), ("new", "z", "div")]], k + "side string, id string, tag string")
    looks = {"oa": {"color": "red", "gap": "1px"}, "ob": {"color": "blue", "gap": "1px", "unknown": "1"}, "oc": {"color": "red", "gap": "1px"}, "na": {"color": "red", "gap": "1px"}, "nb": {"color": "#ff0000", "gap": "1.04px"}, "nc": {"color": "blue", "gap": "1px"}}
    styles = spark.createDataFrame([("p", "d", "old" if e[0] == "o" else "new", e, prop, v) for e, all_ in looks.items() for prop, v in all_.items()], k + "side string, element_id string, prop string, value string")
    got = {(x.old_id, x.new_id, x.similarity, x.base, x.bonus) for x in a.ancestor_pairs(pairs, chains, nodes, ancestors, styles).collect()}
    # oa and na agree best; ob and nb share half of their properties, too little; oc and nc contain both nodes but differ in half as well
    assert got == {("oa", "na", 1.0, 1.0, 0.05)}
    assert a.ancestor_pairs(pairs.where("false"), chains, nodes, ancestors, styles).count() == 0
