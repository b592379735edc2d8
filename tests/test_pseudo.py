import json

from twinpane.operators import pseudo
from twinpane.sources import bundles as b


def bundle(entries, **more):
    return {
        "schemaVersion": "1.1", "capturedAt": "x", "viewport": {"name": "d", "width": 1, "height": 1, "dsf": 1.0}, "environment": {"os": "linux"}, "determinism": {}, "computedStyles": {},
        "styleCandidates": {"ancestors": [{"id": "a1", "tag": "div", "bbox": [0, 1, 2, 3], "depth": 4}], "chains": {"n1": ["a1"]}},
        "page": {"finalUrl": "https://x.com/", "statusCode": 200, "title": "t", "nodes": []}, "pseudoElements": entries, **more,
    }


def entry(tier, before=None, after=None, node=None):
    return {"ownerTier": tier, "ownerNodeId": node, "ownerSelector": "s", "landmark": "main"} | ({"before": before} if before else {}) | ({"after": after} if after else {})


def test_pseudo_elements(spark, tmp_path):
    tick = {"content": "'x'", "width": "10px", "bbox": [1.5, 2, 3, 4]}
    old = {"n1": entry("node", tick, tick, "n1"), "n9": entry("node", tick, node="n9"), "a1": entry("ancestor", tick), "a2": entry("ancestor", tick), "main::#q": entry("selector", tick), "main::#r": entry("selector", tick), "main::#s": entry("selector", {"content": '""'})}
    new = {"m1": entry("node", {"content": '"x"', "width": "10.04px", "top": "1px"}, node="m1"), "b1": entry("ancestor", {"content": "'y'", "width": "12px"}), "main::#r": entry("selector", after=tick), "main::#s": entry("selector", {"content": "''"}), "z": entry("node", tick, node="z")}
    for pair, was, now, more in (("p1", old, new, {}), ("p2", old, {}, {}), ("p3", {"a1": old["a1"], "k": entry("selector", tick), "n1": old["n1"]}, {"b1": entry("ancestor", after=tick)}, {"pseudoTruncated": {"dropped": 3}})):
        for side, found in (("old", was), ("new", now)):
            (tmp_path / pair / side).mkdir(parents=True)
            (tmp_path / pair / side / "b.json").write_text(json.dumps(bundle(found, **more)))
    bundles = b.read_bundles(spark, str(tmp_path / "*" / "*" / "*.json"))
    assert {(r.id, r.tag, r.bbox.w) for r in b.ancestors(bundles).collect()} == {("a1", "div", 2)}
    k = "pair_id string, viewport string, old_id string, new_id string"
    pairs = spark.createDataFrame([(p, "d", "n1", "m1", "matched") for p in ("p1", "p2", "p3")] + [("p1", "d", "n9", "m9", "uncertain")], k + ", band string")
    ancestors = spark.createDataFrame([(p, "d", "a1", "b1") for p in ("p1", "p2", "p3")], k)
    cut = b.captures(bundles).where("pseudo_truncated")
    assert {r.pair_id for r in cut.collect()} == {"p3"}
    got = {(r.pair_id, r.owner_key, r.slot, r.type, r.prop, r.severity, r.confidence) for r in pseudo.pseudo_issues(b.pseudo(bundles), pairs, ancestors, cut).collect()}
    gone = "pseudo_element_missing"
    assert got == {
        ("p1", "n1", "::after", gone, None, "warning", 0.9),
        ("p1", "a1", "::before", "style_changed", "::before.content", "warning", 0.9),
        ("p1", "a1", "::before", "style_changed", "::before.width", "warning", 0.9),
        ("p1", "main::#q", "::before", gone, None, "warning", 0.54),
        ("p1", "main::#r", "::before", gone, None, "warning", 0.9),
        ("p3", "a1", "::before", gone, None, "info", 0.9),
        ("p3", "k", "::before", gone, None, "info", 0.54),
        ("p3", "n1", "::before", gone, None, "warning", 0.9),
        ("p3", "n1", "::after", gone, None, "warning", 0.9),
    }
