import numpy as np
from captures import capture, node, write
from pyspark.sql import functions as F

from twinpane import analyze as a
from twinpane.operators import channels, verify
from twinpane.sources import htmlscan, rasters


def issue(id_, type_, severity="error", **anchors):
    return {"id": id_, "type": type_, "severity": severity, "goal": "G2", "locator": {"anchors": anchors}, "evidence": {"old": "x"}}


def document(*issues, clusters=()):
    return {"status": "fail", "runId": "1", "issues": list(issues), "clusters": list(clusters), "regions": [], "viewports": [{"issues": [i["id"] for i in issues]}], "agentSummary": {"topFixes": [i["id"] for i in issues][:1]}, "suppressed": {"ids": []}}


def test_differences():
    assert verify.differences({"a": 1.0, "runId": 1, "l": [1, 2]}, {"a": 1.00001, "runId": 2, "l": [1, 2]}) == []
    assert verify.differences({"a": 1, "b": None, "l": [1]}, {"a": 2, "c": 0, "l": []}) == ["$.a: 1, now 2", "$.b: only in the old one", "$.c: only in the new one", "$.l: 1 items, now 0"]
    assert verify.differences(True, 1) and len(verify.differences(list(range(50)), list(range(1, 51)))) == 20


def test_expected_issues_and_renaming():
    doc = document(issue("i1", "missing_link", landmark="main", text="Get it"), issue("i2", "missing_link", text="Other"), issue("i3", "style_changed", "warning"), clusters=[{"issueIds": ["i1", "i2"]}])
    assert verify.evaluate(doc, {"status": "fail", "required": [{"type": "missing_*", "anchors": {"text": "get"}}, {"type": "missing_link"}], "forbidden": [{"type": "broken_link"}], "maxIssues": 3, "maxTopLevelItems": 2}) == []
    bad = verify.evaluate(doc, {"status": "pass", "required": [{"type": "missing_link"}] * 3, "forbidden": [{"anyOf": ["style_changed"], "maxSeverity": "warning"}], "maxIssues": 1})
    assert len(bad) == 4
    new = verify.migrated(doc, {"i1": "j1"})
    assert new["issues"][0]["id"] == "j1" and new["clusters"][0]["issueIds"] == ["j1", "i2"] and new["agentSummary"]["topFixes"] == ["j1"] and doc["issues"][0]["id"] == "i1"


def test_bundles_round_trip(spark, tmp_path):
    write(tmp_path / "in", "p", "old", capture("https://a.example/x", [node(0, "link", "Go", href="https://a.example/y")], console=[{"level": "log", "text": "ü"}]))
    first = a.read_bundles(spark, f"{tmp_path}/in/*/*/*.json")
    a.write_bundles(first, f"{tmp_path}/out")
    again = a.read_bundles(spark, f"{tmp_path}/out/*/*/*/*.txt", pair_id=F.lit("p"), side=F.lit("old"))
    assert again.select("page", "computedStyles", "determinism").collect() == first.select("page", "computedStyles", "determinism").collect()


def test_screenshots(spark, tmp_path):
    old = np.full((80, 100, 4), 255, np.uint8)
    new = old.copy()
    new[10:70, 20:90, :3] = 0
    for side, image in (("old", old), ("new", new)):
        (tmp_path / "p" / "desktop").mkdir(parents=True, exist_ok=True)
        (tmp_path / "p" / "desktop" / f"{side}.png").write_bytes(channels.png(image))
    pair = rasters.paired(rasters.read_rasters(spark, f"{tmp_path}/p/desktop"))
    r = channels.visual_summary(pair).first()
    assert r.ratio == 60 * 70 / 8000 and (r.old_h, r.new_h) == (80, 80) and [tuple(x) for x in r.regions] == [(20, 10, 70, 60, 4200)]
    found = spark.createDataFrame([("p", "desktop", "issue_1", "visual_region_changed", [20, 10, 70, 60])], "pair_id string, viewport string, id string, type string, bbox_old array<int>")
    assert {(x.name, bytes(x.data[:4])) for x in channels.crops(pair, found).collect()} == {(f"issue_1_{s}.png", b"\x89PNG") for s in ("old", "new", "diff")}


def test_page_scan_of_forms_sections_and_landmarks():
    html = """<html lang=en><head><title> A  B </title><meta name=description content="d"><link rel="canonical" href="/c"></head><body><header>Top</header><main>
    <section><p>before</p><h2>In section</h2><form aria-label=Search><input type=text aria-label=Query><input type=hidden><button>Go</button></form></section>
    <div hidden>never</div><img src="/i.png" alt="Pic" width=10 height=20><ul><li>one<li>two <a href="x#f">link</a></ul></main><footer role=contentinfo>End</footer></body></html>"""
    got = htmlscan.scan(html, "https://a.example/d/p")
    kinds = [(n["kind"], n["text"] or n["accName"], n["anchors"]["landmark"], n["anchors"]["nearestHeading"]) for n in got["page"]["nodes"]]
    assert kinds == [("text", "Top", None, None), ("text", "before", "main", "In section"), ("heading", "In section", "main", "In section"), ("form", "Go", "main", "In section"), ("field", "Query", "form", "In section"), ("button", "Go", "form", "In section"), ("image", "Pic", "main", "In section"), ("text", "one", "main", "In section"), ("text", "two link", "main", "In section"), ("link", "link", "main", "In section"), ("text", "End", None, "In section")]
    link = next(n for n in got["page"]["nodes"] if n["kind"] == "link")
    assert (link["href"], link["rawHref"], link["cssSelector"]) == ("https://a.example/d/x#f", "x#f", "ul:nth-of-type(1) > li:nth-of-type(2) > a:nth-of-type(1)")
    assert (got["page"]["title"], got["page"]["metaDescription"], got["page"]["canonical"], got["page"]["lang"]) == ("A B", "d", "/c", "en")
    assert [r["path"] for r in got["page"]["landmarkRects"]] == ["banner", "main", "form", "contentinfo", "main › section[1]"] and got["inventory"] == {"headingCount": 1, "imageCount": 1, "landmarkCount": 3}
    assert htmlscan.scan(None, "")["page"]["nodes"] == [] and htmlscan.scan("<p>a<p>b", "u")["page"]["nodes"][1]["text"] == "b"
