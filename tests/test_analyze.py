"""From captures to issues, results and reports: one pair with a difference in every channel, and pairs that decide alone."""

import json

import pytest
from captures import capture, node, write

from twinpane import analyze as a
from twinpane.operators import pairing
from twinpane.operators.issues import Options
from twinpane.operators.sequence import moves

OLD = [
    node(0, "heading", "Welcome", level=1, heading="Welcome"), node(1, "link", "Read more about us", href="https://old.com/about", raw="/about", box=(0, 50, 100, 20)), node(2, "text", "Some plain text here"), node(3, "button", "Buy"),
    node(4, "image", alt="Logo", src="https://old.com/i/logo.png", size=(100, 100), loaded=True), node(5, "form", None, label="Search"), node(6, "field", None, label="Query"), node(7, "link", "Gone", href="https://old.com/gone", raw="/gone", landmark="navigation"),
    node(8, "heading", "Sub", level=2, heading="Sub"),
]
NEW = [
    node(0, "heading", "Welcome back", level=1, heading="Welcome back"), node(1, "link", "Read more about us!", href="https://new.com/about", raw="/about", box=(0, 50, 100, 20)), node(2, "text", "Some plain text there"),
    node(4, "image", alt="Logo", src="https://new.com/i/logo.png", size=(100, 100), loaded=False), node(6, "field", None, label="Query"), node(8, "heading", "Sub", level=3, heading="Sub"),
]
TWICE = [node(0, "link", "Same", href="https://old.com/s"), node(1, "link", "Same", href="https://old.com/s"), node(2, "text", "x"), node(3, "text", "Same", box=(1, 1, 5, 5))]
HIT = [{"o": "hit"}] * 10
MISS = [{"o": "hit"}] * 5 + [{"o": "miss", "winner": "b"}] * 3 + [{"o": "miss", "winner": "a"}, {"o": "excluded"}]


def ancestor(**anchors):
    return {"id": "anc_1", "tag": "div", "bbox": [0, 0, 1, 1], "depth": 1, "cssSelector": "div", "anchors": {"landmark": "main"} | anchors}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("captures")
    box = {"display": "block", "opacity": "1", "position": "static"}
    old = capture(
        "https://old.com/en/", OLD, styles={"node_1": {"color": "#ff0000", "font-size": "10px", "background-image": "linear-gradient(red, blue)"}, "anc_1": {"gap": "4px", **box}}, ancestors=[ancestor()], chains={"node_1": ["anc_1"]},
        hits={"node_1": {"status": "sampled", "points": HIT}}, pseudo={"k": {"ownerTier": "selector", "ownerSelector": "div.x", "landmark": "main", "before": {"content": '"a"'}}, "node_1": {"ownerTier": "node", "ownerNodeId": "node_1", "after": {"color": "red", "top": "1px"}}},
        linkProbes=[{"url": "https://old.com/about", "status": 200, "redirectChain": []}], a11y={"violations": [{"id": "old-rule", "impact": "minor", "nodes": []}]},
    )
    new = capture(
        "http://new.com/en_us/", NEW, height=1100, styles={"node_1": {"color": "rgb(0, 0, 255)", "font-size": "10.05px", "background-image": "none"}, "anc_1": {"gap": "8px", **box}}, ancestors=[ancestor()], chains={"node_1": ["anc_1"]},
        hits={"node_1": {"status": "sampled", "points": MISS}}, pseudo={"node_1": {"ownerTier": "node", "ownerNodeId": "node_1", "after": {"color": "red", "top": "9px"}}}, title="Other", metaDescription="", canonical="http://new.com/x", redirectChain=["http://a/", "http://b/"],
        network={"requests": [{"url": "http://new.com/en_us/a.js", "status": 500, "type": "script", "failed": False}]}, console=[{"level": "error", "text": "boom"}],
        a11y={"violations": [{"id": "alt", "impact": "serious", "helpUrl": "h", "nodes": [{"target": ["image:nth-of-type(4)"], "html": "<img>"}]}]}, linkProbes=[{"url": "http://new.com/about", "status": 404, "redirectChain": []}],
        landmarkRects=[{"path": "main", "role": "main", "heading": "H", "bbox": [0, 0, 10, 50]}],
    )
    write(root, "all", "old", old)
    write(root, "all", "new", new)
    write(root, "status", "old", capture("https://old.com/a", OLD))
    write(root, "status", "new", capture("https://old.com/a", NEW, status=404))
    write(root, "alone", "old", capture("https://old.com/a", OLD))
    for side in ("old", "new"):
        write(root, "same", side, capture("https://old.com/a", OLD), capture("https://old.com/a", TWICE, viewport="mobile"))
    write(root, "twice", "old", capture("https://old.com/a", TWICE))
    write(root, "twice", "new", capture("https://old.com/a", TWICE[1:3], determinism={"timeFrozen": "failed", "quiescence": "timeout"}, environment={"os": "mac"}))
    bundles = a.read_bundles(spark, f"{root}/*/*/*.json")
    made = a.analyze(bundles, Options(baseline=("issue_none",), types={"missing_button": "warning", "missing_form": "info"}, properties={"gap": "critical"}, run_id="r"))
    return made, made.issues.collect(), {r.pair_id: r for r in made.results.collect()}, bundles, root


def test_every_channel(found):
    _, issues, _, _, _ = found
    rows = {r.type: r for r in issues if r.pair_id == "all"}
    assert {(r.type, r.severity) for r in issues if r.pair_id == "all"} == {
        ("missing_meta_description", "error"), ("changed_title", "error"), ("changed_h1", "error"), ("changed_link_text", "error"), ("changed_text", "error"), ("broken_image", "error"), ("heading_structure_changed", "error"),
        ("missing_button", "warning"), ("missing_form", "critical"), ("missing_link", "error"), ("broken_link", "error"), ("style_changed", "warning"), ("style_changed", "critical"), ("background_gradient_lost", "warning"),
        ("clickable_area_regressed", "error"), ("pseudo_element_missing", "warning"), ("network_error", "error"), ("console_error", "warning"), ("accessibility_regression", "warning"), ("accessibility_improved", "info"),
        ("page_height_changed", "info"), ("url_trailing_slash", "error"), ("url_redirect_chain", "error"), ("url_protocol_downgrade", "error"), ("canonical_mismatch", "error"), ("locale_separator_invalid", "error"), ("locale_case_invalid", "error"),
    }
    assert rows["changed_title"].message == "Title changed from 'Title' to 'Other'" and rows["changed_title"].confidence == 0.97
    assert json.loads(rows["changed_title"].remediation) == {"action": "restore_text", "findBy": {"grep": ["Other"]}, "from": "Other", "to": "Title"}
    assert rows["changed_h1"].confidence == round(0.9 * 0.6, 4) and rows["changed_link_text"].confidence == 0.95 and rows["missing_link"].confidence == 0.765
    evidence = json.loads(rows["changed_h1"].evidence)
    assert evidence["match"]["stage"] == "assignment" and evidence["match"]["band"] == "uncertain" and evidence["old"] == {"text": "Welcome"}
    assert json.loads(rows["missing_button"].evidence) == {"match": {"band": "unmatched", "bestScore": json.loads(rows["missing_button"].evidence)["match"]["bestScore"], "stage": "assignment"}, "old": {"href": "", "text": "Buy"}}
    assert rows["clickable_area_regressed"].message == "Clickable area regressed: 100% -> 56% of sampled points hit (top overlap: b)"
    assert json.loads(rows["clickable_area_regressed"].evidence)["new"] == {"hitFraction": "0.5556", "missWinners": "b (x3); a (x1)", "rawHits": "5/9"}
    styles = {r.prop: r for r in issues if r.pair_id == "all" and r.category == "style"}
    assert set(styles) == {"color", "background-image", "gap", "::before", "::after.top"}
    assert styles["color"].message == "color changed from #ff0000 to rgb(0, 0, 255)" and json.loads(styles["color"].evidence)["old"] == {"color": "#ff0000"}
    assert json.loads(styles["gap"].evidence)["match"]["stage"] == "ancestor" and styles["::before"].confidence == 0.54
    assert json.loads(rows["broken_link"].evidence) == {"new": {"status": 404, "url": "http://new.com/about"}, "old": {"status": 200, "url": "https://old.com/about"}}
    assert json.loads(rows["page_height_changed"].evidence)["sectionDeltas"] == [{"delta": 50, "heading": "H", "newHeight": 50, "oldHeight": 0, "path": "main", "role": "main"}]
    assert json.loads(rows["accessibility_regression"].evidence)["new"]["nodes"] == [{"htmlSnippet": "<img>", "target": ["image:nth-of-type(4)"]}]
    assert json.loads(rows["locale_case_invalid"].remediation)["to"] == "/en-US/" and json.loads(rows["url_protocol_downgrade"].remediation)["to"] == "https://new.com/en_us/"
    assert json.loads(rows["canonical_mismatch"].evidence)["new"]["canonicalResolved"] == "http://new.com/x"


def test_pairs_that_decide_alone_and_repeats(found):
    _, issues, results, _, _ = found
    of = lambda pair: [(r.type, r.confidence, r.severity) for r in issues if r.pair_id == pair]
    assert of("status") == [("status_code_mismatch", 0.99, "critical")]
    assert of("alone") == [("load_error", 0.99, "critical")]
    assert of("same") == []
    # One of two equal links is gone, and its label in a text node around it does not count; the environments differ and a step failed.
    assert of("twice") == [("missing_link", 0.36, "error")]
    assert results["same"].status == "pass" and results["same"].exit_code == 0 and results["status"].exit_code == 1
    assert {w.code for w in results["twice"].warnings} == {"capture_step_failed", "settle_quiescence_timeout", "baseline_stale_ids", "severity_map_denied"}


def test_results_and_documents(spark, found, tmp_path):
    made, issues, results, _, _ = found
    r = results["all"]
    doc = json.loads(r.document)
    assert list(doc)[:6] == ["schemaVersion", "toolVersion", "runId", "oldUrl", "newUrl", "parityProfile"] and doc["severityMap"] == {"properties": {"gap": "critical"}, "types": {"missing_button": "warning"}}
    assert [i["id"] for i in doc["issues"]] == [i.id for i in sorted((i for i in issues if i.pair_id == "all"), key=lambda i: (-i.fix_value, i.id))]
    assert list(doc["issues"][0]) == ["id", "type", "category", "severity", "confidence", "viewport", "locale", "goal", "message", "locator", "evidence", "remediation"]
    clusters = {c["sharedLandmark"]: c for c in doc["clusters"]}
    worth = {i.id: i.fix_value for i in issues if i.pair_id == "all"}
    grouped = {x for c in doc["clusters"] for x in c["issueIds"]}
    queue = [(-v, k) for k, v in worth.items() if k not in grouped] + [(-max(worth[x] for x in c["issueIds"]), c["id"]) for c in doc["clusters"]]
    assert doc["agentSummary"]["topFixes"] == [k for _, k in sorted(queue)[:5]] and doc["agentSummary"]["byType"]["style_changed"] == 3
    assert set(clusters) == {"main"} and all(len(c["issueIds"]) >= 3 for c in doc["clusters"]) and doc["regions"] == []
    assert doc["scores"]["accessibility"] == 0.5 and doc["status"] == "fail" and doc["suppressed"] == {"count": 0, "ids": []}
    assert a.pretty(r.document).endswith("}\n")
    out = str(tmp_path / "out")
    for what in ("document", "markdown", "html"):
        a.write_results(made.results.where("pair_id = 'all'"), f"{out}/{what}", what)
    read = a.read_results(spark, f"{out}/document/pair_id=all")
    assert read.first().agentSummary.fixableNow == doc["agentSummary"]["fixableNow"]
    assert a.show(read, "section", "navigation").count() == 1 and a.show(read, "issue", doc["issues"][0]["id"]).count() == 1
    newer = tmp_path / "newer.json"
    newer.write_text(r.document.replace('"schemaVersion":"1.3"', '"schemaVersion":"2.0"'))
    with pytest.raises(Exception, match="newer schema"):
        a.read_results(spark, str(newer)).collect()
    text = "".join(p.read_text() for p in (tmp_path / "out" / "markdown" / "pair_id=all").glob("part*"))
    assert text.startswith("# Page parity report") and "## Scores" in text and "Clickable area regressed" in text
    page = "".join(p.read_text() for p in (tmp_path / "out" / "html" / "pair_id=all").glob("part*"))
    assert "<script" not in page and "Content-Security-Policy" in page and "&quot;" in page


def test_scope_baseline_and_viewports(spark, found):
    made, issues, _, bundles, _ = found
    known = [r.id for r in issues if r.pair_id == "all" and r.type == "changed_title"]
    r = a.issues.results(made.rows, made.issues, Options(baseline=tuple(known), scope=("navigation",))).where("pair_id = 'all'").first()
    assert r.suppressed == known and all(i.landmark in (None, "navigation") for i in r.kept) and len(r.outside) == sum(x.pair_id == "all" and x.landmark == "main" for x in issues)


def test_explain_and_self_check(spark, found):
    _, _, _, bundles, _ = found
    rows = {(r.prop, r.old_value, r.new_value) for r in a.explain(bundles.where("pair_id = 'all'"), "id", "node_1").collect()}
    assert ("color", "#ff0000", "rgb(0, 0, 255)") in rows
    assert [(r.prop, r.old_value, r.new_value) for r in a.explain(bundles.where("pair_id = 'all'"), "id", "node_1", slot="::after").collect()] == [("top", "1px", "9px")]


def test_moves_against_all_orders():
    assert moves([0, 1, 2]) == {"swaps": [], "moves": []}
    assert moves([2, 3, 0, 1])["swaps"] == [{"a": {"start": 0, "size": 2, "at": 2}, "b": {"start": 2, "size": 2, "at": 0}}]
    got = moves([5, 0, 6, 2, 1, 3, 4])
    assert got["swaps"] == [] or all(x["a"]["start"] < x["b"]["start"] for x in got["swaps"])
    far = moves([4, 0, 5, 1, 6, 2, 3])["moves"]
    assert all(abs(m["block"]["start"] - m["block"]["at"]) > 2 for m in far) and far


def test_assignment_prefers_the_larger_sum():
    cell = lambda o, n, s: {"o": o, "n": n, "block": "text", "identity": s, "combined": s}
    got = pairing.assigned([cell(0, 0, 0.8), cell(0, 1, 0.75), cell(1, 0, 0.78), cell(1, 1, 0.1)])
    assert {(p["o"], p["n"], p["band"]) for p in got} == {(0, 1, "matched"), (1, 0, "matched")}
    assert [p["stage"] for p in pairing.assigned([cell(0, 0, 0.9), cell(0, 1, 0.86)])] == ["assignment"]
