import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from twinpane.operators import content as c

NODE = "pair_id string, viewport string, side string, id string, kind string, text string, headingLevel int, href string, rawHref string, imageAlt string, loaded boolean, naturalWidth int, naturalHeight int, seqIndex int, bbox struct<x:int,y:int,w:int,h:int>, anchors struct<text:string,ariaLabel:string>"


def node(side, id_, kind, text=None, level=None, href=None, alt=None, loaded=None, size=(None, None), seq=0, box=(0, 0, 10, 10)):
    return ("p", "d", side, id_, kind, text, level, href, None, alt, loaded, *size, seq, box, (text, None))


@pytest.fixture(scope="module")
def tables(spark):
    rows = [
        node("old", "a", "heading", "One", 1), node("new", "a2", "heading", "Two", 1),
        node("old", "b", "heading", "Sub", 2), node("new", "b2", "heading", "Sub", 3),
        node("old", "c", "text", "x"), node("new", "c2", "text", "y"),
        node("old", "d", "link", "Go", href="https://old.com/x", seq=4), node("new", "d2", "link", "Go", href="https://new.com/x", seq=4),
        node("old", "e", "link", "Go", href="/e"), node("new", "e2", "link", "Went", href="/f#z", seq=5),
        node("old", "f", "image", alt="A", loaded=True, size=(100, 100)), node("new", "f2", "image", alt="", loaded=True, size=(80, 100)),
        node("old", "g", "image", alt="A", loaded=None), node("new", "g2", "image", alt="B", loaded=False),
        node("old", "h", "image", alt="A", loaded=True), node("new", "h2", "image", alt="B", loaded=True),
        node("new", "t", "text", " went ", box=(1, 1, 8, 8)), node("new", "u", "text", "went", box=(50, 50, 8, 8)),
    ]
    nodes = spark.createDataFrame(rows, NODE)
    pages = spark.createDataFrame([("p", "d", "old", "https://old.com/"), ("p", "d", "new", "https://new.com/")], "pair_id string, viewport string, side string, url string")
    pairs = spark.createDataFrame([("p", "d", x, f"{x}2", "matched", 0.9) for x in "abcdefgh"], "pair_id string, viewport string, old_id string, new_id string, band string, score double")
    return nodes, pages, pairs


def test_attribute_changes(tables):
    nodes, pages, pairs = tables
    got = {(r.old_id, r.type) for r in c.attribute_changes(pairs, nodes, pages).collect()}
    assert got == {("a", "changed_h1"), ("b", "heading_structure_changed"), ("c", "changed_text"), ("e", "changed_link_target"), ("e", "changed_link_text"), ("f", "missing_alt_text"), ("f", "changed_image_dimensions"), ("g", "broken_image"), ("h", "changed_alt_text")}


def test_probes(spark, tables):
    nodes, pages, pairs = tables
    schema = "pair_id string, viewport string, side string, url string, redirectChain array<string>, status int, skipped string, error string"
    rows = [("new", "https://new.com/f", [], 404, None, None), ("new", "https://new.com/x", ["a", "b"], 404, None, None), ("old", "https://old.com/x", [], 500, None, None), ("old", "https://old.com/e", [], 200, None, None), ("new", "https://new.com/zzz", ["a", "b"], 404, "cap", None)]
    probes = spark.createDataFrame([("p", "d", *r) for r in rows], schema)
    assert [(r.new_id, r.url) for r in c.broken_links(pairs, probes, nodes, pages).collect()] == [("e2", "https://new.com/f")]
    assert [r.url for r in c.redirect_chains(probes).collect()] == ["https://new.com/x"]


def test_labels_and_regions(spark, tables):
    nodes, _, _ = tables
    assert [r.id for r in c.duplicate_labels(nodes).collect()] == ["t"]
    regions = spark.createDataFrame([("p", "d", 50, 50, 100, 100), ("p", "d", 500, 500, 9, 9)], "pair_id string, viewport string, x int, y int, w int, h int")
    assert [(r.x, r.node_id) for r in c.region_links(regions, nodes).collect()] == [(50, "u")]


def test_capture_state_and_warnings(spark):
    d = lambda **k: Row(**{**dict.fromkeys(["animationsDisabled", "reducedMotion", "timeFrozen", "randomStubbed", "fontsReady", "imagesDecoded", "lazyLoadPass", "settle"], "ran"), "retriedWithoutTimeFreeze": False, "quiescence": "ok", "settleGrowthCapped": False, "integrity": Row(pre=Row(headingCount=1, imageCount=10), post=Row(headingCount=1, imageCount=12)), **k})
    env = lambda os: Row(os=os, chromiumBuild="1", dsf=1.0)
    rows = [Row(pair_id="p", viewport="d", side="old", environment=env("l"), determinism=d(), has_hit_tests=True), Row(pair_id="p", viewport="d", side="new", environment=env("m"), determinism=d(timeFrozen="failed", quiescence="timeout"), has_hit_tests=False), Row(pair_id="q", viewport="d", side="old", environment=env("l"), determinism=d(integrity=Row(pre=Row(headingCount=1, imageCount=10), post=Row(headingCount=1, imageCount=13))), has_hit_tests=True)]
    frame = spark.createDataFrame(rows)
    assert {(r.pair_id, r.environment_differs, r.penalty) for r in c.capture_state(frame).collect()} == {("p", True, True), ("q", False, False)}
    assert {(r.pair_id, r.side, r.code) for r in c.run_warnings(frame).collect()} == {("p", "new", "capture_step_failed"), ("p", "new", "settle_quiescence_timeout"), ("p", "new", "capability_mismatch"), ("q", "old", "capture_integrity_delta")}
    assert [(r.pair_id, r.missing) for r in c.load_errors(frame).collect()] == [("q", "new")]
    got = spark.range(1).select(c.confidence(F.lit(0.9), F.lit(True), F.lit(True)).alias("x")).first().x
    assert got == pytest.approx(0.36)
