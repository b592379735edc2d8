"""Captures for tests: small pages with known differences."""

import copy
import json

DETERMINISM = {k: "ran" for k in ("animationsDisabled", "reducedMotion", "timeFrozen", "randomStubbed", "fontsReady", "imagesDecoded", "lazyLoadPass", "settled", "settle")} | {"quiescence": "stable", "clicked": [], "hidden": [], "masked": [], "retriedWithoutTimeFreeze": False}


def node(seq, kind, text=None, *, role=None, href=None, raw=None, alt=None, src=None, size=(None, None), loaded=None, level=None, box=(0, 0, 10, 10), landmark="main", heading=None, label=None):
    role = role or {"heading": "heading", "link": "link", "button": "button", "image": "img", "form": "form", "field": "input"}.get(kind)
    return {
        "id": f"node_{seq}", "kind": kind, "role": role, "text": text, "accName": label or alt or text, "href": href, "rawHref": raw or href, "imageAlt": alt, "src": src, "naturalWidth": size[0], "naturalHeight": size[1], "loaded": loaded, "headingLevel": level,
        "bbox": list(box), "seqIndex": seq, "cssSelector": f"{kind}:nth-of-type({seq})", "anchors": {"text": text, "role": role, "href": href, "alt": alt, "ariaLabel": label, "nearestHeading": heading, "landmark": landmark, "ordinalInLandmark": 1},
    }


def capture(url, nodes, *, viewport="desktop", status=200, height=1000, styles=None, determinism=None, environment=None, ancestors=(), chains=None, hits=None, pseudo=None, truncated=None, **page):
    facts = {"url": url, "finalUrl": url, "redirectChain": [url], "statusCode": status, "title": "Title", "metaDescription": "About", "canonical": None, "lang": "en", "pageHeight": height, "nodes": nodes, "landmarks": ["main"], "landmarkRects": [], "network": {"requests": []}, "console": [], "a11y": {"violations": []}, "linkProbes": []}
    return {
        "schemaVersion": "1.1", "capturedAt": "2024", "viewport": {"name": viewport, "width": 1440, "height": 1000, "dsf": 1.0}, "environment": {"os": "linux", "chromiumBuild": "1", "playwright": "1", "dsf": 1.0} | (environment or {}), "determinism": DETERMINISM | (determinism or {}),
        "page": facts | page, "computedStyles": styles or {}, "styleCandidates": {"ancestors": list(ancestors), "chains": chains or {}, "budget": 2000, "truncated": False, "droppedCount": 0}, "hitTests": hits, "pseudoElements": pseudo, "pseudoTruncated": truncated,
    }


def write(root, pair, side, *captures):
    folder = root / pair / side
    folder.mkdir(parents=True)
    for c in captures:
        (folder / f"{c['viewport']['name']}.json").write_text(json.dumps(c))


def copied(c):
    return copy.deepcopy(c)
