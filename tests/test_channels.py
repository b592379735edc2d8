import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from twinpane.functions import css
from twinpane.operators import channels as c
from twinpane.sources import bundles as b


def bundle(url, nodes, styles, **page):
    return {
        "schemaVersion": "1.1", "capturedAt": "x", "viewport": {"name": "desktop", "width": 1, "height": 1, "dsf": 1.0}, "environment": {"os": "linux"},
        "determinism": {"timeFrozen": "ran"}, "computedStyles": styles,
        "page": {"finalUrl": url, "statusCode": 200, "title": "t", "nodes": nodes, "network": {"requests": page.get("requests", [])}, "console": page.get("console", []), "a11y": {"violations": page.get("violations", [])}, "linkProbes": []},
        "hitTests": {"n1": {"status": "sampled", "gridSize": 5, "points": page.get("points", [])}},
    }


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("bundles")
    node = {"id": "n1", "kind": "link", "text": "Go", "bbox": [1, 2, 3, 4], "seqIndex": 0, "anchors": {"text": "Go", "landmark": "main"}}
    hit, miss = {"o": "hit"}, lambda w: {"o": "miss", "winner": w}
    old = bundle("https://old.com/p/", [node], {"n1": {"color": "#ff0000", "line-height": "normal", "font-size": "10px", "padding": "1px 2px", "background-image": "linear-gradient(red, blue)", "gone": "1"}}, points=[hit] * 10, requests=[{"url": "https://old.com/p/a.png", "status": 404, "failed": False}], console=[{"level": "error", "text": "same"}], violations=[{"id": "contrast"}, {"id": "label"}])
    new = bundle("https://new.com/p/", [node], {"n1": {"color": "rgb(255, 0, 0)", "line-height": "12.04px", "font-size": "10px", "padding": "1px 4px", "background-image": "none"}}, points=[hit] * 5 + [miss("b")] * 3 + [miss("a"), {"o": "excluded"}], requests=[{"url": "https://new.com/p/a.png", "status": 404, "failed": False}, {"url": "https://new.com/p/b.png", "status": 200, "failed": True}, {"url": "https://new.com/p/b.png", "status": 500, "failed": False}], console=[{"level": "error", "text": "same"}, {"level": "error", "text": "new"}, {"level": "error", "text": "Failed to load resource x"}, {"level": "log", "text": "chat"}], violations=[{"id": "label"}, {"id": "alt"}])
    for side, doc in (("old", old), ("new", new)):
        (root / "p1" / side).mkdir(parents=True)
        (root / "p1" / side / "b.json").write_text(json.dumps(doc))
    return b.read_bundles(spark, str(root / "*" / "*" / "*.json")).cache(), root


def test_tables_and_detectors(spark, loaded):
    bundles, _ = loaded
    assert {(r.pair_id, r.side, r.url, r.has_hit_tests) for r in b.captures(bundles).collect()} == {("p1", "old", "https://old.com/p/", True), ("p1", "new", "https://new.com/p/", True)}
    assert b.nodes(bundles).first().bbox.h == 4
    pairs = spark.createDataFrame([("p1", "desktop", "n1", "n1", "matched", 0.9)], "pair_id string, viewport string, old_id string, new_id string, band string, score double")
    assert {(r.prop, r.type, r.severity) for r in c.style_changes(pairs, b.styles(bundles)).collect()} == {("padding", "style_changed", "warning"), ("background-image", "background_gradient_lost", "warning")}
    tally = c.hit_tally(pairs, b.hit_points(bundles))
    r = tally.first()
    assert (r.denominator, r.old_hits, r.new_hits, r.winners) == (9, 9, 5, "b (x3); a (x1)")
    assert c.clickable_regressions(tally).count() == 1
    assert [(r.key, r.status) for r in c.network_errors(b.requests(bundles), b.captures(bundles)).collect()] == [("b.png", 200)]
    assert [r.text for r in c.console_errors(b.console(bundles)).collect()] == ["new"]
    assert {(r.rule_id, r.type) for r in c.accessibility(b.violations(bundles)).collect()} == {("alt", "accessibility_regression"), ("contrast", "accessibility_improved")}


def test_bad_inputs_raise(spark, loaded, tmp_path):
    (tmp_path / "p" / "old").mkdir(parents=True)
    (tmp_path / "p" / "old" / "b.json").write_text('{"capturedAt": "x"}')
    with pytest.raises(PySparkException):
        b.read_bundles(spark, str(tmp_path / "p" / "old" / "b.json")).collect()
    (tmp_path / "m.json").write_text('{"types": {"missing_link": "warning"}, "properties": {"color": "info"}}')
    assert {(r.scope, r.key, r.severity) for r in b.read_severity_map(spark, str(tmp_path / "m.json"), ["missing_link"], ["color"]).collect()} == {("types", "missing_link", "warning"), ("properties", "color", "info")}
    with pytest.raises(PySparkException):
        b.read_severity_map(spark, str(tmp_path / "m.json"), [], ["color"]).collect()
    (tmp_path / "base.json").write_text('[{"id": "a"}, {"note": "none"}, {"id": "a", "note": "again"}]')
    assert [r.id for r in b.read_baseline(spark, str(tmp_path / "base.json")).collect()] == ["a"]


@pytest.mark.parametrize(("value", "want"), [("#FFF", "rgb(255, 255, 255)"), ("#00ff0080", "rgba(0, 255, 0, 0.502)"), ("rgba(1,2,3,1)", "rgb(1, 2, 3)"), ("rgba(1, 2, 3, 0.5)", "rgba(1, 2, 3, 0.5)"), ("Navy", "rgb(0, 0, 128)"), ("transparent", "rgba(0, 0, 0, 0)"), ("var(--x)", "var(--x)")])
def test_colors(spark, value, want):
    assert spark.range(1).select(css.normalize_color(F.lit(value)).alias("x")).first().x == want


def test_values_and_gradients(spark):
    same = lambda a, b_: spark.range(1).select(css.values_equal(F.lit(a), F.lit(b_)).alias("x")).first().x
    assert same("1.04px solid", "1px solid") and not same("1px", "1em") and not same("1px", "1.2px") and not same("-1px", "1px")
    got = css.parse_gradients("linear-gradient(to right, rgba(0, 0, 0, 0.5), red 20%), url(a,b.png), radial-gradient(red")
    assert [(x["kind"], x["angle"], x["stops"]) for x in got] == [("linear-gradient", "to right", ["rgba(0, 0, 0, 0.5)", "red 20%"]), (None, None, []), (None, None, [])]
    frame = spark.createDataFrame([("conic-gradient(red, blue)",), (None,)], "v string").select(css.gradients("v").alias("g"))
    assert [len(r.g) if r.g else None for r in frame.collect()] == [1, None]


def test_visual_regions(spark):
    old = np.full((200, 300, 4), 255, np.uint8)
    new = old.copy()
    new[10:80, 20:100, :3] = 0
    new[90:95, 250:255, :3] = 0  # too small
    new[120:190, 200:280, 3] = 0  # transparent white over white: the same
    frame = spark.createDataFrame([("p", "desktop", 300, 200, bytearray(old.tobytes()), 300, 200, bytearray(new.tobytes())), ("q", "desktop", 300, 200, bytearray(old.tobytes()), 300, 200, bytearray(old.tobytes()))], "pair_id string, viewport string, old_w int, old_h int, old_data binary, new_w int, new_h int, new_data binary")
    got = {(r.pair_id, r.x, r.y, r.w, r.h, r.pixels) for r in c.visual_regions(frame).collect()}
    assert got == {("p", 20, 10, 80, 70, 5600), ("q", None, None, None, None, None)}
    corner = np.zeros((64, 64), bool)
    corner[0:16, 0:16] = corner[16:32, 16:32] = True
    assert c.regions_of(corner, least=1) == [(0, 0, 32, 32, 512)]
