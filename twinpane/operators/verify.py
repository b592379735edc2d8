"""Result documents held against what was expected of them, and against earlier ones."""

from __future__ import annotations

TOLERANCE, MOST = 1e-4, 20
VOLATILE = ("runId", "toolVersion")
RANKS = ("info", "warning", "error", "critical")


def differences(old, new, *, skip: tuple[str, ...] = VOLATILE, tolerance: float = TOLERANCE, most: int = MOST, at: str = "$") -> list[str]:
    """Where two documents differ, the first ones by path; numbers may differ by the tolerance, members in `skip` are not looked at."""
    out: list[str] = []
    if isinstance(old, dict) and isinstance(new, dict):
        for key in sorted(old.keys() | new.keys()):
            if key not in skip:
                if key not in old or key not in new:
                    out.append(f"{at}.{key}: only in the {'new' if key in new else 'old'} one")
                else:
                    out += differences(old[key], new[key], skip=skip, tolerance=tolerance, most=most, at=f"{at}.{key}")
    elif isinstance(old, list) and isinstance(new, list):
        if len(old) != len(new):
            out.append(f"{at}: {len(old)} items, now {len(new)}")
        for i, (a, b) in enumerate(zip(old, new)):
            out += differences(a, b, skip=skip, tolerance=tolerance, most=most, at=f"{at}[{i}]")
    elif isinstance(old, (int, float)) and isinstance(new, (int, float)) and not isinstance(old, bool) and not isinstance(new, bool):
        if abs(old - new) > tolerance:
            out.append(f"{at}: {old}, now {new}")
    elif old != new or type(old) is not type(new):
        out.append(f"{at}: {old!r}, now {new!r}")
    return out[:most]


def fits(issue: dict, rule: dict) -> bool:
    """Does an issue fit a rule: type (with an asterisk at its end any that begins so) or anyOf, goal, anchors, evidence, severity?"""
    names = rule.get("anyOf") or [rule["type"]]
    named = any(issue["type"].startswith(n[:-1]) if n.endswith("*") else issue["type"] == n for n in names)
    anchors = issue["locator"]["anchors"] or {}
    placed = all(str(v).lower() in str(anchors.get(k) or "").lower() for k, v in (rule.get("anchors") or {}).items())
    said = all(part in str(issue.get("evidence")) for part in rule.get("evidence") or [])
    rank = RANKS.index(issue["severity"])
    banded = RANKS.index(rule.get("minSeverity", "info")) <= rank <= RANKS.index(rule.get("maxSeverity", "critical"))
    return named and placed and said and banded and rule.get("goal") in (None, issue.get("goal"))


def evaluate(document: dict, expected: dict) -> list[str]:
    """What a result lacks or has too much of: status, required issues (each its own), forbidden ones, and caps."""
    out, left = [], list(document["issues"])
    if expected.get("status") not in (None, document["status"]):
        out.append(f"status {document['status']}, not {expected['status']}")
    for rule in expected.get("required", []):
        found = next((i for i in left if fits(i, rule)), None)
        if found is None:
            out.append(f"nothing fits {rule}")
        else:
            left.remove(found)
    out += [f"{i['id']} ({i['type']}) is forbidden by {rule}" for rule in expected.get("forbidden", []) for i in document["issues"] if fits(i, rule)]
    for name, have in (("maxIssues", len(document["issues"])), ("maxTopLevelItems", len(document["regions"]) + len(document["clusters"]) + len(document["issues"]) - len({x for c in document["clusters"] for x in c["issueIds"]} | {x for r in document["regions"] for x in r["memberIssueIds"]}))):
        if expected.get(name) is not None and have > expected[name]:
            out.append(f"{have} above {name} {expected[name]}")
    return out


def migrated(document: dict, names: dict[str, str]) -> dict:
    """The document with issue ids renamed wherever they stand."""
    swap = lambda x: names.get(x, x)
    out = {**document, "issues": [{**i, "id": swap(i["id"])} for i in document["issues"]]}
    out["clusters"] = [{**c, "issueIds": [swap(x) for x in c["issueIds"]]} for c in document["clusters"]]
    out["regions"] = [{**r, "memberIssueIds": [swap(x) for x in r["memberIssueIds"]]} for r in document["regions"]]
    out["viewports"] = [{**v, "issues": [swap(x) for x in v["issues"]]} for v in document["viewports"]]
    out["agentSummary"] = {**document["agentSummary"], "topFixes": [swap(x) for x in document["agentSummary"]["topFixes"]]}
    out["suppressed"] = {**document["suppressed"], "ids": [swap(x) for x in document["suppressed"]["ids"]]}
    return out
