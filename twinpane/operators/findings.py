"""Detectors over matched page pairs: each gives an array of findings, made inside the row of its pair.

A finding is what one detector says about one element or page; severity, confidence factors and id come later, the same
way for all of them (operators.issues). Types, goals, actions, member names, messages and notes are fixed values, as
readers of results look for them. Evidence and remediation are JSON text with members in order of their names.

Rows are those of pairing.matched(): old, new (captures), o_nodes, n_nodes, pairs, missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import css, locales, urls
from ..functions import text as t
from ..functions.arrays import Optional, Raw, json_text, let, present
from ..sources.bundles import ANCHORS
from .ancestors import LEAST_SIMILARITY, STYLE_PROPERTIES, TAG_BONUS
from .pairing import box, raw_href
from .pseudo import PROPERTIES as PSEUDO_PROPERTIES

FINDING = (
    f"struct<grp:int,type:string,category:string,goal:string,base:double,flat:boolean,after:double,severity:string,uncertain:boolean,message:string,locale:string,"
    f"anchors:{ANCHORS},css_selector_old:string,css_selector_new:string,bbox_old:array<int>,bbox_new:array<int>,seq_old:int,seq_new:int,prop:string,evidence:string,remediation:string>"
)
#: What a detector is sure of before other factors (fixed values).
BASE = {
    "visual": 0.9, "height": 0.95, "load": 0.99, "hygiene": 0.98, "status": 0.99, "page": 0.97, "identity": 0.95, "assignment": 0.90,
    "broken_link": 0.98, "broken_image": 0.95, "style": 0.9, "gradient": 0.95, "network": 0.95, "console": 0.9, "a11y": 0.95, "clickable": 0.9, "pseudo": 0.9,
}
UNCERTAIN, CHROME, SETTLE, UNMATCHED = 0.6, 0.85, 0.7, 0.6
GROUPS = ["visual", "height", "content", "sequence", "style", "clickable", "pseudo", "network", "a11y", "hygiene"]
RATIO_FLOOR, ASPECT_TOLERANCE = 0.9, 0.02
PAIR_SCORE_FOR_STYLE, LEAST_RATIO, LINK_SHARE = 0.75, 0.005, 0.3
LEAST_POINTS, OLD_SHARE, DROP = 9, 0.9, 0.1


def page(side: str, name: str) -> Column:
    return F.col(f"{side}.page.{name}")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def anchors_of(**known) -> Column:
    names = ["text", "role", "href", "alt", "ariaLabel", "nearestHeading", "landmark", "ordinalInLandmark"]
    return F.struct(*((known.get(n, F.lit(None))).cast("int" if n == "ordinalInLandmark" else "string").alias(n) for n in names))


def finding(group: str, type_, category: str, goal: str | None, base, message: Column, *, flat: bool = False, after=1.0, severity=None, uncertain=False, anchors: Column | None = None, old: Column | None = None, new: Column | None = None, boxes: tuple | None = None, selectors: tuple | None = None, prop=None, evidence=None, remediation=None, locale: Column | None = None) -> Column:
    """One finding; old and new are the nodes that locate it."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    of = lambda node, name: node[name] if node is not None else F.lit(None)
    values = (
        F.lit(GROUPS.index(group)), lit(type_), F.lit(category), F.lit(goal), lit(base), F.lit(flat), lit(after), lit(severity), lit(uncertain), message, locale if locale is not None else page("new", "lang"),
        anchors if anchors is not None else F.lit(None).cast(ANCHORS), *(selectors or (of(old, "cssSelector"), of(new, "cssSelector"))), *(boxes or (of(old, "bbox"), of(new, "bbox"))), of(old, "seqIndex"), of(new, "seqIndex"), lit(prop),
        json_text(evidence) if evidence is not None else F.lit("null"), json_text(remediation) if remediation is not None else F.lit(None),
    )
    return F.struct(*(v.alias(f"c{i}") for i, v in enumerate(values))).cast(FINDING)


def none_found() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def when(condition: Column, found: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), found)


def say(template: str, *values: Column) -> Column:
    """The template with its {} filled in; nulls are empty."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for value, rest in zip(values, parts[1:], strict=True):
        out += [F.coalesce(value.cast("string"), F.lit("")), F.lit(rest)]
    return F.concat(*out)


def chrome(node: Column) -> Column:
    return F.when(F.coalesce(node["anchors"]["landmark"].isin("banner", "navigation", "contentinfo"), F.lit(False)), CHROME).otherwise(1.0)


def find_by(*grep, near=None) -> dict:
    return {"grep": list(grep)} if near is None else {"grep": list(grep), "near": near}


# Content


def page_facts() -> Column:
    """Titles and meta descriptions that are gone or differ, and a page whose h1 is gone."""
    out = []
    for name, field, label in (("title", "title", "Title"), ("meta_description", "metaDescription", "Meta description")):
        old, new = F.trim(text_or_empty(page("old", field))), F.trim(text_or_empty(page("new", field)))
        gone = say("Title removed: was '{}'", old) if name == "title" else F.lit("Meta description removed")
        changed = say("Title changed from '{}' to '{}'", old, new) if name == "title" else F.lit("Meta description changed")
        out.append(when((old != "") & (new == ""), finding("content", f"missing_{name}", "content", "G2", BASE["page"], gone, flat=True, evidence={"old": {field: old}, "new": None}, remediation={"action": "restore_text", "findBy": find_by(old), "from": None, "to": old})))
        out.append(when((old != "") & (new != "") & (old != new), finding("content", f"changed_{name}", "content", "G2", BASE["page"], changed, flat=True, evidence={"old": {field: old}, "new": {field: new}}, remediation={"action": "restore_text", "findBy": find_by(new), "from": new, "to": old})))
    first = lambda nodes: F.filter(nodes, lambda x: x["headingLevel"] == 1)
    h1 = F.array_min(F.transform(first(F.col("o_nodes")), lambda x: F.struct(x["seqIndex"].alias("seq"), x.alias("x"))))["x"]
    lost = let(h1, lambda x: finding("content", "missing_h1", "content", "G2", BASE["page"], say("H1 heading removed: was '{}'", x["text"]), flat=True, anchors=x["anchors"], old=x, evidence={"old": {"text": text_or_empty(x["text"])}, "new": None}, remediation={"action": "restore_content", "findBy": find_by(text_or_empty(x["text"])), "from": None, "to": text_or_empty(x["text"])}))
    out.append(when((F.size(first(F.col("o_nodes"))) > 0) & (F.size(first(F.col("n_nodes"))) == 0), lost))
    return present(*out)


def match_evidence(p: Column) -> Raw:
    return Raw(json_text({"band": p["band"], "score": t.round4(p["score"]), "signals": Raw(p["signals"]), "stage": p["stage"]}))


def pair_confidence(p: Column, new: Column, base: float | None = None) -> Column:
    """By stage (or the given base), less where the pair is uncertain or the node is page chrome."""
    stage = F.when(p["stage"] == "identity", BASE["identity"]).otherwise(BASE["assignment"]) if base is None else F.lit(base)
    return stage * F.when(p["band"] == "uncertain", UNCERTAIN).otherwise(1.0) * chrome(new)


def attribute_findings(p: Column, x: Column, y: Column, responsive: bool = False) -> Column:
    """What differs between two paired nodes: texts, levels, targets, images; forms and fields say nothing."""
    old_url, new_url = page("old", "finalUrl"), page("new", "finalUrl")
    match, confidence, near = match_evidence(p), pair_confidence(p, y), y["anchors"]["nearestHeading"]
    a, b = text_or_empty(x["text"]), text_or_empty(y["text"])
    kind, text_differs = x["kind"], text_or_empty(x["text"]) != text_or_empty(y["text"])
    first = F.coalesce((x["headingLevel"] == 1), F.lit(False)) | F.coalesce((y["headingLevel"] == 1), F.lit(False))

    def one(type_, goal, message, evidence, remediation, **more):
        return finding("content", type_, "content", goal, more.pop("base", confidence), message, anchors=y["anchors"], old=x, new=y, evidence={"match": match, **evidence}, remediation=remediation, **more)

    texts = {"evidence": {"old": {"text": a}, "new": {"text": b}}, "remediation": {"action": "restore_text", "findBy": find_by(b, near=near), "from": b, "to": a}}
    heading = kind == "heading"
    tag = lambda c: F.concat(F.lit("h"), F.coalesce(c.cast("string"), F.lit("?")))
    level = one("heading_structure_changed", "G2", say("Heading level changed for '{}'", a), {"old": {"level": x["headingLevel"], "text": a}, "new": {"level": y["headingLevel"], "text": b}}, {"action": "restore_heading_level", "findBy": find_by(b), "from": tag(y["headingLevel"]), "to": tag(x["headingLevel"])})
    link = kind.isin("link", "button")
    r, s = raw_href(x), raw_href(y)
    to = lambda c, own, other: urls.norm_href_cross_origin(c, own, other)
    moved = link & r.isNotNull() & s.isNotNull() & (r != s) & (to(r, old_url, new_url) != to(s, new_url, old_url))
    target = one("changed_link_target", "G2", say("Link target changed from '{}' to '{}'", r, s), {"old": {"href": r, "resolved": urls.norm_href(r, old_url)}, "new": {"href": s, "resolved": urls.norm_href(s, new_url)}}, {"action": "update_link_target", "findBy": find_by(s, a), "from": s, "to": r})
    image, was, now = kind == "image", F.coalesce(x["loaded"], F.lit(True)), F.coalesce(y["loaded"], F.lit(True))
    file = F.when(y["src"].isNull(), "").otherwise(urls.file_name(y["src"]))
    facts = lambda n, ok: {"src": n["src"], "naturalWidth": n["naturalWidth"], "naturalHeight": n["naturalHeight"], "loaded": ok}
    broken = one("broken_image", "G7", say("Image failed to load: {}", y["src"]), {"old": facts(x, True), "new": facts(y, False)}, {"action": "fix_image_asset", "findBy": find_by(file, text_or_empty(y["imageAlt"]), near=near), "from": text_or_empty(y["src"]), "to": None, "note": "Image asset failed to load on new page"}, base=pair_confidence(p, y, BASE["broken_image"]))
    whole = image & ~(was & ~now)
    alt_a, alt_b = text_or_empty(x["imageAlt"]), text_or_empty(y["imageAlt"])
    alts = {"evidence": {"old": {"alt": x["imageAlt"]}, "new": {"alt": y["imageAlt"]}}, "remediation": {"action": "restore_text", "findBy": find_by(file), "from": y["imageAlt"], "to": x["imageAlt"]}}
    ow, oh, nw, nh = x["naturalWidth"], x["naturalHeight"], y["naturalWidth"], y["naturalHeight"]
    small = F.least(F.least(ow, nw) / F.greatest(ow, nw), F.least(oh, nh) / F.greatest(oh, nh)) < RATIO_FLOOR
    sized = whole & was & now & (F.least(ow, oh, nw, nh) > 0) & small
    rendered = box(y, 2)
    verdict = F.when((nw > ow) | (nh > oh), "upscale").when(F.abs(ow / oh - nw / nh) / (ow / oh) > ASPECT_TOLERANCE, "aspect_changed").when((rendered > 0) & (nw < rendered), "undersized").otherwise("intentional_downscale")
    plain = {"old": {"naturalWidth": ow, "naturalHeight": oh}, "new": {"naturalWidth": nw, "naturalHeight": nh}}
    wide = verdict.isin("undersized", "intentional_downscale")
    judged = {**plain, "responsive": {"verdict": verdict, "renderedWidth": Optional(wide, F.when(rendered > 0, rendered))}} if responsive else plain
    dimensions = one("changed_image_dimensions", "G7", say("Image dimensions changed from {}x{} to {}x{}", ow, oh, nw, nh), judged, None, severity=F.when(verdict == "intentional_downscale", "info") if responsive else None)
    return present(
        when(heading & text_differs, one(F.when(first, "changed_h1").otherwise("changed_text"), "G2", say("Heading text changed from '{}' to '{}'", a, b), texts["evidence"], texts["remediation"])),
        when(heading & ~x["headingLevel"].eqNullSafe(y["headingLevel"]), level),
        when(kind.isin("text", "generic") & text_differs, one("changed_text", "G2", say("Text changed from '{}' to '{}'", a, b), texts["evidence"], texts["remediation"])),
        when(moved, target),
        when(link & text_differs, one("changed_link_text", "G2", say("Link text changed from '{}' to '{}'", a, b), texts["evidence"], texts["remediation"])),
        when(image & was & ~now, broken),
        when(whole & (alt_a != "") & (alt_b != "") & (alt_a != alt_b), one("changed_alt_text", "G2", say("Alt text changed from '{}' to '{}'", alt_a, alt_b), alts["evidence"], alts["remediation"])),
        when(whole & (alt_a != "") & (alt_b == ""), one("missing_alt_text", "G2", F.lit("Alt text removed from image"), alts["evidence"], alts["remediation"])),
        when(sized, dimensions),
    )


def changed_nodes(responsive: bool = False) -> Column:
    return F.flatten(F.transform("pairs", lambda p: let(F.struct(F.get("o_nodes", p["o"]).alias("x"), F.get("n_nodes", p["n"]).alias("y")), lambda both: attribute_findings(p, both["x"], both["y"], responsive))))


def repeats_label(x: Column, tolerance: int = 2) -> Column:
    """Is a text node only the label of a link or button around it?"""
    edge = lambda n: (box(n, 0), box(n, 1), box(n, 0) + box(n, 2), box(n, 1) + box(n, 3))
    a, b, c, d = edge(x)

    def around(w):
        e, f, g, h = edge(w)
        inside = (a >= e - tolerance) & (b >= f - tolerance) & (c <= g + tolerance) & (d <= h + tolerance)
        return w["kind"].isin("link", "button") & (t.label_text(w["text"]) == t.label_text(x["text"])) & F.coalesce(inside, F.lit(False))

    return (x["kind"] == "text") & (text_or_empty(t.label_text(x["text"])) != "") & F.exists("o_nodes", around)


def missing_finding(m: Column, x: Column) -> Column:
    """An old node without a partner, with the best score it had."""
    kind, near, text = x["kind"], x["anchors"]["nearestHeading"], text_or_empty(x["text"])
    href, src, alt = text_or_empty(raw_href(x)), text_or_empty(x["src"]), text_or_empty(x["imageAlt"])
    match = Raw(json_text({"band": "unmatched", "bestScore": t.round4(m["best"]), "stage": "assignment"}))
    of = lambda evidence, grep, to: (json_text({"match": match, "old": evidence}), json_text({"action": "restore_content", "findBy": find_by(*grep, near=near), "from": None, "to": to}))
    linked, pictured, plain = of({"text": text, "href": href}, [text, href], text), of({"src": src, "alt": alt}, [src, alt], src), of({"text": text}, [text], text)
    pick = lambda i: F.when(kind.isin("link", "button"), linked[i]).when(kind == "image", pictured[i]).otherwise(plain[i])
    type_ = F.when(kind.isin("link", "button", "image", "form"), F.concat(F.lit("missing_"), kind)).when(kind == "field", "missing_form_field").otherwise("missing_text")
    message = (
        F.when(kind == "link", say("Link removed: '{}'", F.coalesce(x["text"], x["href"])))
        .when(kind == "button", say("Button removed: '{}'", x["text"]))
        .when(kind == "image", say("Image removed: {}", x["src"]))
        .when(kind == "form", "Form removed")
        .when(kind == "field", say("Form field removed: '{}'", x["accName"]))
        .otherwise(say("Content removed: '{}'", x["text"]))
    )
    return finding("content", type_, "content", "G2", BASE["assignment"] * chrome(x), message, anchors=x["anchors"], old=x, evidence=Raw(pick(0)), remediation=Raw(pick(1)))


def missing_nodes() -> Column:
    real = F.filter("missing", lambda m: ~let(F.get("o_nodes", m["i"]), repeats_label))
    return F.transform(real, lambda m: let(F.get("o_nodes", m["i"]), lambda x: missing_finding(m, x)))


def resolved(node: Column, side: str) -> Column:
    """The reference of a node as an absolute URL without its fragment."""
    return urls.without_fragment(urls.resolve(raw_href(node), page(side, "finalUrl")))


def owner(url: Column, side: str) -> Column:
    """The first node (by position, then id) whose reference is the URL; null if none is."""
    nodes = F.col("o_nodes" if side == "old" else "n_nodes")
    linked = F.filter(nodes, lambda n: raw_href(n).isNotNull() & (resolved(n, side) == url))
    return F.array_min(F.transform(linked, lambda n: F.struct(n["seqIndex"].alias("seq"), n["id"].alias("id"), n.alias("node"))))["node"]


def broken_links() -> Column:
    """Links that answer 400 or more now, unless their partners were as broken; the first of those that would share an id."""
    bad = F.filter(page("new", "linkProbes"), lambda q: q["skipped"].isNull() & F.coalesce(q["status"] >= 400, F.lit(False)))

    def one(q):
        def about(y):
            mate = F.get(F.filter("pairs", lambda p: F.get("n_nodes", p["n"])["id"] == y["id"]), F.lit(0))
            before = let(mate, lambda p: F.when(p.isNotNull(), resolved(F.get("o_nodes", p["o"]), "old")))

            def with_before(url):
                was = F.get(F.filter(page("old", "linkProbes"), lambda w: w["url"] == url), F.lit(0))
                suppressed = F.coalesce((was["status"] >= 400) | was["error"].isNotNull(), F.lit(False))
                old = Raw(F.when(was.isNotNull(), json_text({"url": url, "status": was["status"]})))
                raw, label = text_or_empty(raw_href(y)), text_or_empty(y["text"])
                found = finding("content", "broken_link", "content", "G7", BASE["broken_link"], say("Broken link: {} returned {}", q["url"], q["status"]), flat=True, severity="error", anchors=y["anchors"], new=y, evidence={"new": {"url": q["url"], "status": q["status"]}, "old": old}, remediation={"action": "fix_broken_link", "findBy": find_by(raw, label), "from": raw, "to": None, "note": say("Link returned status {}", q["status"])})
                return F.when(~suppressed, F.struct(y["seqIndex"].alias("seq"), y["id"].alias("id"), q["url"].alias("url"), found.alias("f")))

            return let(before, with_before)

        return let(owner(q["url"], "new"), lambda y: F.when(y.isNotNull(), about(y)))

    ordered = F.array_sort(F.filter(F.transform(bad, one), lambda x: x.isNotNull()))
    found = F.transform(ordered, lambda x: x["f"])
    same = lambda f: F.struct(f["anchors"]["text"], f["anchors"]["role"], urls.id_stable_url(f["anchors"]["href"]), f["anchors"]["alt"], f["anchors"]["ariaLabel"], f["anchors"]["landmark"], f["anchors"]["nearestHeading"])
    unseen = lambda fs: F.filter(fs, lambda f, i: ~F.exists(F.slice(fs, F.lit(1), i), lambda g: same(g).eqNullSafe(same(f))))
    return F.coalesce(let(found, unseen), none_found())


# Order


def eligible() -> Column:
    """Pairs that tell the order of components: matched by identity."""
    return F.filter("pairs", lambda p: (p["band"] == "matched") & (p["stage"] == "identity"))


def label(node: Column) -> Column:
    """What a component is called: text, reference, alternative text or the node's own text, the first that is there."""
    a = node["anchors"]
    return t.truncate_bytes(F.coalesce(a["text"], a["href"], a["alt"], node["text"], F.lit("")))


def label_or_href(node: Column) -> Column:
    """The same, but empty ones don't count, and the own text comes before the alternative text."""
    a, some = node["anchors"], t.non_empty
    return t.truncate_bytes(F.coalesce(some(a["text"]), some(a["href"]), some(node["text"]), some(a["alt"]), F.lit("")))


def union_box(nodes: Column) -> Column:
    edge = lambda of: F.transform(nodes, of)
    x, y = F.array_min(edge(lambda n: box(n, 0))), F.array_min(edge(lambda n: box(n, 1)))
    right, low = F.array_max(edge(lambda n: box(n, 0) + box(n, 2))), F.array_max(edge(lambda n: box(n, 1) + box(n, 3)))
    return let(F.struct(x.alias("x"), y.alias("y"), right.alias("r"), low.alias("l")), lambda v: F.array(v["x"], v["y"], v["r"] - v["x"], v["l"] - v["y"]))


def both_sides(members: Column) -> tuple[Column, Column]:
    """The old and the new nodes of pairs."""
    return F.transform(members, lambda p: F.get("o_nodes", p["o"])), F.transform(members, lambda p: F.get("n_nodes", p["n"]))


def block_descriptor(members: Column, rep: Column) -> Raw:
    """What a block of pairs is: its first heading (or first node), where it stands, and how that node was matched."""
    olds, news = both_sides(members)
    seqs = lambda nodes, f: f(F.transform(nodes, lambda n: n["seqIndex"]))
    return Raw(
        json_text(
            {
                "anchors": F.get("o_nodes", rep["o"])["anchors"],
                "bboxOld": union_box(olds),
                "bboxNew": union_box(news),
                "seqIndexOldRange": [seqs(olds, F.array_min), seqs(olds, F.array_max)],
                "seqIndexNewRange": [seqs(news, F.array_min), seqs(news, F.array_max)],
                "nodeCount": F.size(members),
                "match": {"stage": rep["stage"], "score": t.round4(rep["score"]), "signals": Raw(rep["signals"])},
            }
        )
    )


def _members(block: Column) -> Column:
    return F.slice(eligible(), block["start"] + 1, block["size"])


def _rep(members: Column) -> Column:
    headings = F.filter(members, lambda p: F.get("o_nodes", p["o"])["kind"] == "heading")
    return F.coalesce(F.get(headings, F.lit(0)), F.get(members, F.lit(0)))


def _mean_score(members: Column) -> Column:
    return t.round4(F.aggregate(members, F.lit(0.0), lambda acc, p: acc + p["score"]) / F.size(members))


def _named(block: Column) -> Column:
    """The label of a block, null for none."""
    return F.when(block.isNotNull(), let(_members(block), lambda m: label(F.get("o_nodes", _rep(m)["o"]))))


def _located(members: Column, rep: Column) -> dict:
    olds, news = both_sides(members)
    x, y = F.get("o_nodes", rep["o"]), F.get("n_nodes", rep["n"])
    return {"anchors": x["anchors"], "old": x, "new": y, "boxes": (union_box(olds), union_box(news))}


def swap_finding(s: Column) -> Column:
    def say_it(m):
        (x, y), (a, b) = (F.get("o_nodes", m[r]["o"]) for r in ("ra", "rb")), (m["a"], m["b"])
        one, two = label(x), label(y)
        note = say('Restore original document order: "{}" must precede "{}". Grep targets may hit repo source or CMS content; the anchors identify the sections either way.', one, two)
        return finding(
            "sequence", "component_swapped", "structure", "G3", _mean_score(F.concat(a, b)), say('Components swapped: "{}" and "{}" exchanged document order; "{}" now renders before "{}".', one, two, two, one), flat=True, severity="error", **_located(a, m["ra"]),
            evidence={"blockA": block_descriptor(a, m["ra"]), "blockB": block_descriptor(b, m["rb"]), "oldOrder": [one, two], "newOrder": [two, one]},
            remediation={"action": "reorder_components", "findBy": find_by(label_or_href(x), label_or_href(y), near=F.coalesce(x["anchors"]["nearestHeading"], one)), "expectedOrder": [one, two], "note": note},
        )

    return let(F.struct(_members(s["a"]).alias("a"), _members(s["b"]).alias("b")), lambda m: let(F.struct(m["a"].alias("a"), m["b"].alias("b"), _rep(m["a"]).alias("ra"), _rep(m["b"]).alias("rb")), say_it))


def move_finding(s: Column) -> Column:
    block = s["block"]

    def say_it(m):
        x, rep = F.get("o_nodes", m["rep"]["o"]), m["rep"]
        name, after, before = label(x), m["after"], m["before"]
        order = F.filter(F.array(after, name, before), lambda v: v.isNotNull())
        return finding(
            "sequence", "component_reordered", "structure", "G3", _mean_score(m["members"]), say('Component moved: "{}" moved from document position {} to {} of {} matched components.', name, block["start"], block["at"], F.size(eligible())), flat=True, severity="error", **_located(m["members"], rep),
            evidence={"block": block_descriptor(m["members"], rep), "displacement": F.abs(block["start"] - block["at"]), "movedBefore": Optional(before.isNotNull(), before), "movedAfter": Optional(after.isNotNull(), after)},
            remediation={"action": "reorder_components", "findBy": find_by(label_or_href(x), near=F.coalesce(x["anchors"]["nearestHeading"], name)), "target": name, "after": Optional(after.isNotNull(), after), "before": Optional(before.isNotNull(), before), "expectedOrder": order},
        )

    return let(_members(block), lambda members: let(F.struct(members.alias("members"), _rep(members).alias("rep"), _named(s["before"]).alias("after"), _named(s["after"]).alias("before")), say_it))


def sequence_findings() -> Column:
    """Of the column `moved`: swaps first, then single moves."""
    return F.concat(F.transform("moved.swaps", swap_finding), F.transform("moved.moves", move_finding))


# Style


def near_part(anchors: Column) -> Column:
    heading = text_or_empty(anchors["nearestHeading"])
    return F.when(heading != "", say(' near "{}"', heading)).otherwise("")


def grep_targets(anchors: Column, *more: Column) -> Column:
    """Reference in quotes and text, else the nearest heading; then what else there is."""
    some = t.non_empty
    own = present(F.when(some(anchors["href"]).isNotNull(), say('"{}"', anchors["href"])), some(anchors["text"]))
    extra = F.filter(F.array(*more), lambda x: x.isNotNull()) if more else F.array().cast("array<string>")
    return F.concat(F.when(F.size(own) > 0, own).otherwise(present(some(anchors["nearestHeading"]))), extra)


_NOTE = "The tool does not name the component. Use the grep targets to locate it in source or CMS."


def style_finding(prop: Column, said: Column, old: Column, new: Column, anchors: Column, match: Raw, uncertain: Column, located: dict, group: str = "style") -> Column:
    """A property that differs, or a gradient that is lost or differs; `said` is the property's full name."""
    gradient = lambda c: c.rlike("gradient\\(")
    kind = F.when((prop == "background-image") & gradient(old) & F.lit(group == "style"), F.when(gradient(new), "background_gradient_changed").otherwise("background_gradient_lost")).otherwise("style_changed")
    plain = say("{} changed from {} to {}{}", said, old, new, near_part(anchors))
    message = F.when(kind == "background_gradient_lost", say("Background gradient lost on container{}", near_part(anchors))).when(kind == "background_gradient_changed", say("Background gradient changed on container{}", near_part(anchors))).otherwise(plain)
    pair = lambda v: Raw(F.concat(F.lit("{"), json_text(prop), F.lit(":"), json_text(v), F.lit("}")))
    base = F.when(kind == "style_changed", BASE["style"]).otherwise(BASE["gradient"])
    goal = F.when(kind == "style_changed", "G1").otherwise("G4")
    found = finding(group, kind, "style", "G1", base, message, uncertain=uncertain, anchors=anchors, prop=said, evidence={"old": pair(old), "new": pair(new), "match": match}, remediation={"action": "restore_css_property", "findBy": {"grep": grep_targets(anchors), "near": anchors["nearestHeading"]}, "property": said, "from": new, "to": old, "note": _NOTE}, **located)
    return found.withField("goal", goal)


def differing(a: Column, b: Column, properties: list[str], sizes: bool = True) -> Column:
    """(prop, old, new) of the properties on both sides that differ after all tolerances."""
    at = lambda m, p: F.try_element_at(m, p)
    size = lambda m: at(m, F.lit("font-size")) if sizes else F.lit(None).cast("string")
    old_url, new_url = page("old", "finalUrl"), page("new", "finalUrl")
    raw = F.filter(F.array(*map(F.lit, properties)), lambda p: F.coalesce(at(a, p) != at(b, p), F.lit(False)))
    real = F.filter(raw, lambda p: css.differs(p, at(a, p), at(b, p), old_url, new_url, size(a), size(b)))
    return F.transform(real, lambda p: F.struct(p.alias("prop"), at(a, p).alias("old"), at(b, p).alias("new")))


def leaf_styles() -> Column:
    """Paired nodes; what an uncertain pair says is information only."""

    def of(p):
        unsure = (p["band"] != "matched") | (p["score"] < PAIR_SCORE_FOR_STYLE)
        match = Raw(json_text({"band": p["band"], "score": t.round4(p["score"]), "signals": Raw(p["signals"]), "stage": p["stage"], "uncertainPairing": Optional(unsure, True)}))

        def both(x, y):
            a, b = F.try_element_at(F.col("old.computedStyles"), x["id"]), F.try_element_at(F.col("new.computedStyles"), y["id"])
            return let(F.struct(a.alias("a"), b.alias("b")), lambda m: F.transform(differing(m["a"], m["b"], STYLE_PROPERTIES), lambda d: style_finding(d["prop"], d["prop"], d["old"], d["new"], x["anchors"], match, unsure, {"old": x, "new": y})))

        return let(F.struct(F.get("o_nodes", p["o"]).alias("x"), F.get("n_nodes", p["n"]).alias("y")), lambda n: F.coalesce(both(n["x"], n["y"]), none_found()))

    return F.flatten(F.transform("pairs", of))


def ancestor_pairs() -> Column:
    """(old, new, sim, base, bonus) of ancestors that contain the same paired nodes, most alike by style first, one to one."""
    ids = lambda c: F.transform(c, lambda x: x["id"])
    sure = F.filter("pairs", lambda p: p["band"] == "matched")

    def held(side: str, key: str, nodes: str):
        chain = lambda p: F.coalesce(F.try_element_at(F.col(f"{side}.styleCandidates.chains"), F.get(nodes, p[key])["id"]), F.array().cast("array<string>"))
        links = F.flatten(F.transform(sure, lambda p: F.transform(chain(p), lambda a: F.struct(a.alias("a"), p["n"].alias("n")))))
        others = F.filter(F.coalesce(F.col(f"{side}.styleCandidates.ancestors"), F.array()), lambda a: ~F.array_contains(ids(nodes), a["id"]))
        of = lambda a, all_: F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform(F.filter(all_, lambda e: e["a"] == a["id"]), lambda e: e["n"]))), lambda n: n.cast("string")), ",")
        return let(links, lambda all_: F.transform(others, lambda a: F.struct(a.alias("a"), of(a, all_).alias("key"), F.try_element_at(F.col(f"{side}.computedStyles"), a["id"]).alias("styles"))))

    def scored(o, n):
        props = F.filter(F.array(*map(F.lit, STYLE_PROPERTIES)), lambda p: F.try_element_at(o["styles"], p).isNotNull() & F.try_element_at(n["styles"], p).isNotNull())
        value = lambda m, p, side: css.normalize_value(p, F.try_element_at(m, p), page(side, "finalUrl"))
        equal = F.filter(props, lambda p: (F.try_element_at(o["styles"], p) == F.try_element_at(n["styles"], p)) | css.values_equal(value(o["styles"], p, "old"), value(n["styles"], p, "new")))
        base = F.when(F.size(props) > 0, F.size(equal) / F.size(props)).otherwise(0.0)
        bonus = F.when(o["a"]["tag"] == n["a"]["tag"], TAG_BONUS).otherwise(0.0)
        return let(F.struct(base.alias("base"), bonus.alias("bonus")), lambda s: F.struct((-t.round4(s["base"] + s["bonus"])).alias("minus"), o["a"]["id"].alias("old"), n["a"]["id"].alias("new"), s["base"].alias("base"), s["bonus"].alias("bonus")))

    def greedy(candidates):
        kind = "array<struct<minus:double,old:string,new:string,base:double,bonus:double>>"
        free = lambda kept, c: ~F.exists(kept, lambda k: (k["old"] == c["old"]) | (k["new"] == c["new"]))
        return F.aggregate(candidates, F.array().cast(kind), lambda kept, c: F.when(free(kept, c), F.concat(kept, F.array(c))).otherwise(kept))

    def met(sides):
        cells = F.flatten(F.transform(F.filter(sides["o"], lambda o: o["key"] != ""), lambda o: F.transform(F.filter(sides["n"], lambda n: n["key"] == o["key"]), lambda n: scored(o, n))))
        return greedy(F.array_sort(F.filter(cells, lambda c: c["base"] + c["bonus"] >= LEAST_SIMILARITY)))

    found = let(F.struct(held("old", "o", "o_nodes").alias("o"), held("new", "n", "n_nodes").alias("n")), met)
    return F.transform(found, lambda c: F.struct(c["old"].alias("old"), c["new"].alias("new"), t.round4(F.least(c["base"] + c["bonus"], F.lit(1.0))).alias("sim"), t.round4(c["base"]).alias("base"), c["bonus"].alias("bonus")))


def _ancestor(side: str, id_: Column) -> Column:
    return F.get(F.filter(F.col(f"{side}.styleCandidates.ancestors"), lambda a: a["id"] == id_), F.lit(0))


def ancestor_styles() -> Column:
    """Of the column `ancestors`: their properties that differ."""

    def of(c):
        match = Raw(json_text({"stage": "ancestor", "score": c["sim"], "signals": {"descendantSet": 1.0, "styleSim": c["base"], "tagBonus": c["bonus"]}}))

        def both(n):
            located = {"selectors": (n["x"]["cssSelector"], n["y"]["cssSelector"]), "boxes": (n["x"]["bbox"], n["y"]["bbox"])}
            found = differing(F.try_element_at(F.col("old.computedStyles"), c["old"]), F.try_element_at(F.col("new.computedStyles"), c["new"]), STYLE_PROPERTIES)
            return F.transform(found, lambda d: style_finding(d["prop"], d["prop"], d["old"], d["new"], n["x"]["anchors"], match, F.lit(False), located))

        return let(F.struct(_ancestor("old", c["old"]).alias("x"), _ancestor("new", c["new"]).alias("y")), lambda n: F.coalesce(both(n), none_found()))

    return F.flatten(F.transform("ancestors", of))


# Hit tests


def settle_penalty() -> Column:
    """A capture that did not come to rest, on either side."""
    bad = lambda s: F.coalesce(F.col(f"{s}.determinism.quiescence") == "timeout", F.lit(False)) | F.coalesce(F.col(f"{s}.determinism.settle").isin("failed", "skipped"), F.lit(False))
    return bad("old") | bad("new")


def hit_tally(old: Column, new: Column) -> Column:
    """Points counted on both sides, hits, and the winners of new misses, commonest first."""
    counted = F.filter(F.transform(F.sequence(F.lit(0), F.size(old) - 1), lambda i: F.struct(F.get(old, i).alias("p"), F.get(new, i).alias("q"))), lambda z: (z["p"]["o"] != "excluded") & (z["q"]["o"] != "excluded"))

    def counts(zs):
        misses = F.transform(F.filter(zs, lambda z: z["q"]["o"] == "miss"), lambda z: z["q"]["winner"])
        each = F.transform(F.array_distinct(misses), lambda w: F.struct((-F.size(F.filter(misses, lambda m: m == w))).alias("minus"), w.alias("winner")))
        hits = lambda c: F.size(F.filter(zs, lambda z: z[c]["o"] == "hit"))
        return F.struct(F.size(zs).alias("n"), (F.size(old) - F.size(zs)).alias("excluded"), hits("p").alias("old"), hits("q").alias("new"), F.array_sort(each).alias("winners"))

    return let(counted, counts)


def clickable_findings() -> Column:
    """Targets that were free to click and are covered now."""

    def of(p):
        def both(n):
            a, b = F.try_element_at(F.col("old.hitTests"), n["x"]["id"]), F.try_element_at(F.col("new.hitTests"), n["y"]["id"])
            sampled = (a["status"] == "sampled") & (b["status"] == "sampled") & (F.size(a["points"]) == F.size(b["points"])) & (F.size(a["points"]) > 0)
            return F.when(sampled, let(hit_tally(a["points"], b["points"]), lambda k: judged(n["x"], n["y"], k)))

        return let(F.struct(F.get("o_nodes", p["o"]).alias("x"), F.get("n_nodes", p["n"]).alias("y")), both)

    def judged(x, y, k):
        old, new = k["old"] / k["n"], k["new"] / k["n"]
        anchors, top = x["anchors"], F.get(k["winners"], F.lit(0))["winner"]
        winners = F.array_join(F.transform(F.slice(k["winners"], 1, 3), lambda w: say("{} (x{})", w["winner"], -w["minus"])), "; ")
        percent = lambda c: F.format_string("%.0f", c * 100)
        message = say("Clickable area regressed{}: {}% -> {}% of sampled points hit{}", near_part(anchors), percent(old), percent(new), F.when(top.isNotNull(), say(" (top overlap: {})", top)).otherwise(""))
        note = F.when(top.isNotNull(), say('The element matching "{}" overlaps this target and is intercepting clicks. Check its position/size/z-index relative to the target. The tool does not name the source component — use the grep targets to locate it in source or CMS.', top)).otherwise("An overlapping element is intercepting clicks on this target. Check the position/size/z-index of nearby elements. The tool does not name the source component — use the grep targets to locate it in source or CMS.")
        share = lambda c: F.format_string("%.4f", t.round4(c))
        evidence = {"old": {"hitFraction": share(old), "rawHits": say("{}/{}", k["old"], k["n"])}, "new": {"hitFraction": share(new), "rawHits": say("{}/{}", k["new"], k["n"]), "missWinners": winners}, "excludedPoints": k["excluded"].cast("string")}
        found = finding("clickable", "clickable_area_regressed", "visual", None, BASE["clickable"], message, after=F.when(settle_penalty(), SETTLE).otherwise(1.0), anchors=anchors, old=x, new=y, evidence=evidence, remediation={"action": "restore_clickable_area", "findBy": {"grep": grep_targets(anchors, top), "near": anchors["nearestHeading"]}, "note": note})
        return F.when((k["n"] >= LEAST_POINTS) & (old >= OLD_SHARE) & (old - new > DROP), found)

    return F.filter(F.transform(F.filter("pairs", lambda p: p["band"] == "matched"), of), lambda f: f.isNotNull())


# Pseudo-elements


SLOTS = "struct<before:map<string,string>,after:map<string,string>>"
OWNER = f"struct<was:{SLOTS},now:{SLOTS},tier:string,anchors:{ANCHORS},css_old:string,css_new:string,bbox_old:array<int>,bbox_new:array<int>,seq_old:int,seq_new:int,aligned:boolean>"


def pseudo_owners() -> Column:
    """Old entries by key, each with its owner's entry on the new side: by paired node, paired ancestor, or selector."""
    entries = lambda: F.map_values(F.col("new.pseudoElements"))
    slots = lambda v: F.struct(v["before"].alias("before"), v["after"].alias("after"))
    null = F.lit(None)

    def owner(v, now, tier, anchors, css_old, css_new, bbox_old, bbox_new, seq_old, seq_new, aligned):
        values = (slots(v), slots(now), F.lit(tier), anchors, css_old, css_new, bbox_old, bbox_new, seq_old, seq_new, aligned)
        return F.struct(*(x.alias(f"c{i}") for i, x in enumerate(values))).cast(OWNER)

    def of(v):
        def ancestor(c):
            x, y = _ancestor("old", c["old"]), _ancestor("new", c["new"])
            return F.when(c.isNotNull(), owner(v["v"], F.try_element_at(F.col("new.pseudoElements"), c["new"]), "ancestor", x["anchors"], x["cssSelector"], y["cssSelector"], null, null, null, null, F.lit(True)))

        def selector(now):
            return owner(v["v"], now, "selector", anchors_of(landmark=v["v"]["landmark"]), v["v"]["ownerSelector"], now["ownerSelector"], null, null, null, null, now.isNotNull())

        k = v["k"]
        mate = F.get(F.filter("pairs", lambda p: (p["band"] == "matched") & (F.get("o_nodes", p["o"])["id"] == v["v"]["ownerNodeId"])), F.lit(0))
        kin = F.get(F.filter("ancestors", lambda c: c["old"] == k), F.lit(0))
        by_node = let(F.struct(mate.alias("p"), v["v"].alias("v")), lambda m: of_node(m["p"], m["v"]))
        return F.when(v["v"]["ownerTier"] == "node", by_node).when(v["v"]["ownerTier"] == "ancestor", let(kin, ancestor)).otherwise(let(F.try_element_at(F.col("new.pseudoElements"), k), selector))

    def of_node(p, v):
        def both(n):
            x, y = n["x"], n["y"]
            now = F.get(F.filter(entries(), lambda w: (w["ownerTier"] == "node") & (w["ownerNodeId"] == y["id"])), F.lit(0))
            return owner(v, now, "node", x["anchors"], x["cssSelector"], y["cssSelector"], x["bbox"], y["bbox"], x["seqIndex"], y["seqIndex"], F.lit(True))

        return F.when(p.isNotNull(), let(F.struct(F.get("o_nodes", p["o"]).alias("x"), F.get("n_nodes", p["n"]).alias("y")), both))

    some = lambda side: F.coalesce(F.size(F.map_keys(F.col(f"{side}.pseudoElements"))) > 0, F.lit(False))
    by_key = F.transform(F.array_sort(F.map_keys("old.pseudoElements")), lambda k: of(F.struct(k.alias("k"), F.try_element_at(F.col("old.pseudoElements"), k).alias("v"))))
    return F.when(some("old") & some("new"), F.filter(by_key, lambda o: o.isNotNull())).otherwise(F.array().cast(f"array<{OWNER}>"))


def pseudo_findings() -> Column:
    """Paints of ::before and ::after that are gone or look different."""
    cut = F.col("old.pseudoTruncated").isNotNull() | F.col("new.pseudoTruncated").isNotNull()
    some = t.non_empty

    def of(o):
        a = o["anchors"]
        near = F.coalesce(some(a["nearestHeading"]), some(a["landmark"]))
        located = {"selectors": (o["css_old"], o["css_new"]), "boxes": (o["bbox_old"], o["bbox_new"])}
        each = F.filter(F.array(*(F.struct(F.lit(f"::{n}").alias("slot"), o["was"][n].alias("was"), o["now"][n].alias("now")) for n in ("before", "after"))), lambda s: s["was"].isNotNull())

        def one(s):
            own = present(F.when(some(a["href"]).isNotNull(), say('"{}"', a["href"])), some(a["text"]), some(o["css_old"]))
            grep = F.when(F.size(own) > 0, own).otherwise(present(near))
            evidence = {"old": s["was"], "new": Raw(F.lit("{}")), "pseudo": s["slot"], "ownerTier": o["tier"], "alignmentTier": Optional(~o["aligned"], "selector-unmatched")}
            note = "The tool does not name the source component. Use the grep targets to locate the owning selector/rule in source or CMS."
            gone = finding("pseudo", "pseudo_element_missing", "style", "G4", BASE["pseudo"], say("{} pseudo-element is missing{}", s["slot"], F.when(near.isNotNull(), say(' near "{}"', near)).otherwise("")), after=F.when(o["aligned"], 1.0).otherwise(UNMATCHED), severity=F.when(cut & (o["tier"] != "node"), "info"), anchors=a, prop=s["slot"], evidence=evidence, remediation={"action": "restore_pseudo_element", "findBy": {"grep": grep, "near": near}, "pseudo": s["slot"], "note": note}, **located)
            match = Raw(json_text({"stage": "pseudo", "ownerTier": o["tier"], "pseudo": s["slot"]}))
            changed = F.transform(differing(s["was"], s["now"], PSEUDO_PROPERTIES, sizes=False), lambda d: style_finding(d["prop"], F.concat(s["slot"], F.lit("."), d["prop"]), d["old"], d["new"], a, match, F.lit(False), located, group="pseudo"))
            return F.when(s["now"].isNull(), F.array(gone)).otherwise(F.coalesce(changed, none_found()))

        found = F.flatten(F.transform(each, one))
        return F.transform(found, lambda f: f.withField("seq_old", o["seq_old"]).withField("seq_new", o["seq_new"]))

    return F.flatten(F.transform(pseudo_owners(), of))


# Network, console, accessibility


def network_findings() -> Column:
    """Requests that fail now and whose key did not fail before, the first of each key, by key."""
    keyed = lambda side: F.transform(page(side, "network.requests"), lambda r: F.struct(urls.request_key(r["url"], page(side, "finalUrl")).alias("key"), r.alias("r")))
    failing = lambda e: F.coalesce(e["r"]["failed"], F.lit(False)) | (F.coalesce(e["r"]["status"], F.lit(0)) >= 400)

    def fresh(s):
        bad_before = F.transform(F.filter(s["o"], failing), lambda e: e["key"])
        bad = F.filter(F.filter(s["n"], failing), lambda e: ~F.array_contains(bad_before, e["key"]))
        return F.transform(F.array_sort(F.array_distinct(F.transform(bad, lambda e: e["key"]))), lambda k: one(F.get(F.filter(bad, lambda e: e["key"] == k), F.lit(0))["r"], F.get(F.filter(s["o"], lambda e: e["key"] == k), F.lit(0))["r"]))

    def one(r, w):
        at = F.get(F.filter(page("new", "nodes"), lambda n: (n["src"] == r["url"]) | (n["href"] == r["url"])), F.lit(0))

        def about(y):
            note = F.when(r["status"].isNotNull(), say("Asset returned HTTP {} on the new page (it loaded on the old page). Restore the asset or fix its path. The grep target may hit repo source or CMS content; the anchors identify the element either way.", r["status"])).otherwise("Asset failed to load on the new page (it loaded on the old page). Restore the asset or fix its path. The grep target may hit repo source or CMS content; the anchors identify the element either way.")
            evidence = {"old": Raw(F.when(w.isNotNull(), json_text({"url": w["url"], "status": w["status"]}))), "new": {"url": r["url"], "status": r["status"], "failed": r["failed"], "type": r["type"]}}
            return finding("network", "network_error", "technical", "G7", BASE["network"], say("Network error: {} returned HTTP {} on the new page", r["url"], F.coalesce(r["status"].cast("string"), F.lit("unknown"))), anchors=y["anchors"], new=y, evidence=evidence, remediation={"action": "restore_asset", "findBy": {"grep": [urls.file_name(r["url"])], "near": y["anchors"]["nearestHeading"]}, "from": r["url"], "to": None, "note": note})

        return let(at, about)

    both = F.struct(keyed("old").alias("o"), keyed("new").alias("n"))
    return F.coalesce(let(both, fresh), none_found())


def console_findings() -> Column:
    """Error messages that only the new page logs, each once, by text."""
    errors = lambda side: F.transform(F.filter(page(side, "console"), lambda e: (e["level"] == "error") & ~e["text"].startswith("Failed to load resource")), lambda e: e["text"])
    fresh = F.array_sort(F.array_except(F.coalesce(errors("new"), F.array().cast("array<string>")), F.coalesce(errors("old"), F.array().cast("array<string>"))))
    note = "The new page logged a console error not present on the old page. The grep target is the message text; it may live in repo source or a bundled dependency. The tool does not name the component."
    return F.transform(fresh, lambda x: finding("network", "console_error", "technical", None, BASE["console"], say("Console error: {}", x), evidence={"old": None, "new": {"level": "error", "text": x}}, remediation={"action": "investigate_console_error", "findBy": find_by(x), "note": note}))


def accessibility_findings() -> Column:
    """Rules that one side violates alone: regressions, then improvements, each by rule."""
    rules = lambda side: F.coalesce(F.transform(page(side, "a11y.violations"), lambda v: v["id"]), F.array().cast("array<string>"))

    def one(rule, side, other, type_, nodes):
        v = F.get(F.filter(page(side, "a11y.violations"), lambda x: x["id"] == rule), F.lit(0))

        def about(v):
            target = F.get(F.get(v["nodes"], F.lit(0))["target"], F.lit(0))
            shown = F.transform(F.slice(v["nodes"], 1, 5), lambda n: F.struct(t.truncate_bytes(text_or_empty(n["html"]), 500).alias("htmlSnippet"), n["target"].alias("target")))
            seen = {"ruleId": rule, "impact": v["impact"], "nodeCount": F.size(v["nodes"]), "nodes": shown}
            evidence = {"ruleId": rule, "impact": v["impact"], "helpUrl": v["helpUrl"], side: seen, other: {"present": False}}
            at = F.get(F.filter(page(side, "nodes"), lambda n: n["cssSelector"] == target), F.lit(0))
            worse = type_ == "accessibility_regression"
            message = say("Accessibility regression: axe rule '{}' now fails ({})", rule, F.coalesce(v["impact"], F.lit("unknown"))) if worse else say("Accessibility improved: axe rule '{}' no longer fails", rule)
            remediation = {"action": "fix_accessibility_violation", "findBy": find_by(text_or_empty(target)), "ruleId": rule, "helpUrl": v["helpUrl"], "note": say("axe rule {} now fails on the new page (clean on old). See helpUrl.", rule)} if worse else None
            return finding("a11y", type_, "accessibility", "G8", BASE["a11y"], message, anchors=at["anchors"], evidence=evidence, remediation=remediation)

        return let(v, about)

    alone = lambda a, b: F.array_sort(F.array_except(rules(a), rules(b)))
    return F.concat(F.transform(alone("new", "old"), lambda r: one(r, "new", "old", "accessibility_regression", "n_nodes")), F.transform(alone("old", "new"), lambda r: one(r, "old", "new", "accessibility_improved", "o_nodes")))


# URLs


def status_findings() -> Column:
    """A page that answered 2xx and now does not; it decides alone."""
    a, b = page("old", "statusCode"), page("new", "statusCode")
    ok = lambda c: (c >= 200) & (c < 300)
    path = urls.path_query(page("new", "finalUrl"))
    note = "New page returns a non-2xx status while old page returned 2xx. Fix the route or content to return 200."
    found = finding("hygiene", "status_code_mismatch", "technical", None, BASE["status"], say("Status code mismatch: old={} new={}", a, b), flat=True, anchors=anchors_of(href=path), evidence={"old": {"statusCode": a, "url": page("old", "finalUrl")}, "new": {"statusCode": b, "url": page("new", "finalUrl")}}, remediation={"action": "fix_route", "findBy": find_by(path), "from": b.cast("string"), "to": "200", "note": note})
    return present(when(ok(a) & ~ok(b), found))


def hygiene(type_, goal, message, anchors, evidence, remediation, **more) -> Column:
    return finding("hygiene", type_, "hygiene", goal, BASE["hygiene"], message, flat=True, anchors=anchors, evidence=evidence, remediation=remediation, **more)


def slash_finding(url: Column, anchors: Column, policy: str = "never", **more) -> Column:
    """For pages and links: a path against the policy on trailing slashes."""
    path, query = urls.path(url), urls.query(url)
    bare = F.regexp_replace(path, "/+$", "")
    to = F.concat(bare, F.lit("/") if policy == "always" else F.lit(""), query)
    return hygiene("url_trailing_slash", "G5", say("URL has a trailing slash that should not be present: {}", path), anchors, {"new": {"url": url, "path": path}, "policy": policy}, {"action": "rewrite_url", "findBy": find_by(F.concat(path, query)), "from": F.concat(path, query), "to": to, "note": f"Trailing slash policy is '{policy}'. Rewrite the URL to conform."}, **more)


def redirect_finding(requested: Column, chain: Column, final: Column, anchors: Column, **more) -> Column:
    """For pages and probed links: more than one redirect."""
    note = "Update references to point directly to the final URL, avoiding the redirect chain."
    return hygiene("url_redirect_chain", "G5", say("URL redirect chain has {} hops: {}", F.size(chain), requested), anchors, {"new": {"requestedUrl": requested, "redirectChain": chain, "finalUrl": final, "hops": F.size(chain)}}, {"action": "update_link_target", "findBy": find_by(urls.path_query(requested)), "from": requested, "to": final, "note": note}, **more)


_LOCAL = {"action": "none", "note": "HTTP is expected for a local dev server; HTTPS on localhost would require a self-signed certificate. This issue will not appear once the candidate is served from a real HTTPS host."}


def downgrade_finding(was: Column, now: Column, message: Column, anchors: Column, note: str, **more) -> Column:
    """For pages and links: http where it was https; on a local server that is information only."""
    local = urls.is_loopback(now)
    fix = json_text({"action": "rewrite_url", "findBy": find_by(F.regexp_replace(now, "^(https?://)+", "")), "from": now, "to": F.regexp_replace(now, "^http://", "https://"), "note": note})
    said = F.concat(message, F.when(local, " (expected for a local development server)").otherwise(""))
    return hygiene("url_protocol_downgrade", "G5", said, anchors, {"old": {"url": was}, "new": {"url": now}}, Raw(F.when(local, json_text(_LOCAL)).otherwise(fix)), severity=F.when(local, "info"), **more)


def page_hygiene(languages: list[str], regions: list[str], policy: str = "never") -> Column:
    """Checks of the new page's URL: slash, redirects, protocol, canonical, locale."""
    old, new = page("old", "finalUrl"), page("new", "finalUrl")
    path = anchors_of(href=urls.path_query(new))
    chain = page("new", "redirectChain")
    requested = F.get(chain, F.lit(0))
    canonical = page("new", "canonical")
    there, here = urls.normalize_for_compare(urls.resolve(canonical, new), policy), urls.normalize_for_compare(new, policy)
    apart = canonical.isNotNull() & ~canonical.eqNullSafe(page("old", "canonical")) & (there != here)
    note = "The canonical URL does not match the final URL. Update the canonical tag to point to the correct URL."
    off = hygiene("canonical_mismatch", "G5", say("Canonical URL mismatch: canonical resolves to {} but final URL is {}", there, here), path, {"old": {"canonical": text_or_empty(page("old", "canonical"))}, "new": {"canonical": canonical, "canonicalResolved": there, "finalUrl": new}}, {"action": "update_canonical", "findBy": find_by(F.lit('rel="canonical"')), "from": there, "to": here, "note": note})
    slash = urls.slash_violation(new, policy) if policy != "preserve" else (urls.path(new).endswith("/") != (urls.path(old).endswith("/") & (urls.path(old) != "/"))) & (urls.path(new) != "/")
    return F.concat(
        present(
            when(slash, slash_finding(new, path, policy)),
            when(F.size(chain) > 1, redirect_finding(requested, chain, new, anchors_of(href=urls.path_query(requested)))),
            when((urls.scheme(old) == "https") & (urls.scheme(new) == "http"), downgrade_finding(old, new, say("Protocol downgrade: old={} new={}", old, new), path, "New page uses HTTP where old page used HTTPS. Update to HTTPS.")),
            when(apart, off),
        ),
        let(locales.judged(urls.path(new), languages, regions), locale_findings),
    )


def locale_findings(found: Column) -> Column:
    """What is wrong with the locale segment of the new page's path: separator, case, unknown codes."""
    new = page("new", "finalUrl")
    path = urls.path_query(new)
    segment, anchors = found["segment"], anchors_of(href=path)

    def one(type_, expected, message, note):
        return hygiene(type_, "G6", message, anchors, {"new": {"url": new, "localeSegment": segment, "expected": expected}}, {"action": "rewrite_url", "findBy": find_by(segment), "from": path, "to": F.replace(path, segment, expected), "note": note})

    hyphen = F.replace(segment, F.lit("_"), F.lit("-"))
    unknown = hygiene("locale_unknown", "G6", say("Unknown locale subtag '{}' in segment '{}'", found["unknown_subtag"], segment), anchors, {"new": {"url": new, "localeSegment": segment, "unknownSubtag": found["unknown_subtag"]}}, None)
    return present(
        when(found["separator_invalid"], one("locale_separator_invalid", hyphen, say("Locale separator invalid in segment '{}': use hyphen not underscore", segment), "Locale separator should be a hyphen (-), not underscore (_). Update all references.")),
        when(found["case_invalid"], one("locale_case_invalid", found["corrected"], say("Locale case invalid in segment '{}': expected '{}'", segment, found["corrected"]), "Locale segment case is invalid. Language code must be lowercase, region code must be uppercase (e.g. es-MX).")),
        when(found["unknown"], unknown),
    )


def link_hygiene(policy: str = "never") -> Column:
    """Checks of links within the new page's site: http where the old page had https, slashes, redirects of probes."""
    new = page("new", "finalUrl")
    absolute = lambda n: n["href"].isNotNull() & n["href"].rlike("^[A-Za-z][A-Za-z0-9+.-]*://")
    here = F.transform(F.array_sort(F.transform(F.filter("n_nodes", lambda n: absolute(n) & (urls.authority(n["href"]) == urls.authority(new))), lambda n: F.struct(n["seqIndex"].alias("seq"), n["id"].alias("id"), n.alias("n")))), lambda s: s["n"])
    before = F.filter("o_nodes", absolute)
    secure = F.transform(F.filter(before, lambda n: urls.scheme(n["href"]) == "https"), lambda n: urls.path_query(n["href"]))
    known = F.transform(before, lambda n: urls.path_query(n["href"]))

    def downgraded(links, https):
        bad = F.filter(links, lambda n: (urls.scheme(n["href"]) == "http") & F.array_contains(https, urls.path_query(n["href"])))
        return F.transform(bad, lambda n: downgrade_finding(F.regexp_replace(n["href"], "^http://", "https://"), n["href"], say("Per-link protocol downgrade: {} should be https", n["href"]), n["anchors"], "Link uses HTTP where old page had HTTPS for the same path. Update to HTTPS.", new=n))

    def slashed(links, old):
        bad = F.filter(links, lambda n: urls.slash_violation(n["href"], policy) & ~F.array_contains(old, urls.path_query(n["href"])))
        return F.transform(bad, lambda n: slash_finding(n["href"], n["anchors"], policy, new=n))

    probes = F.filter(page("new", "linkProbes"), lambda q: urls.egress_reason(q["url"], new).isNull() & q["skipped"].isNull() & q["error"].isNull() & (F.size(q["redirectChain"]) > 1))

    def redirected(q):
        def about(y):
            anchors = F.coalesce(y["anchors"], anchors_of(href=urls.path_query(q["url"])))
            return redirect_finding(q["url"], q["redirectChain"], F.coalesce(q["finalUrl"], q["url"]), anchors, selectors=(F.lit(None), y["cssSelector"]), boxes=(F.lit(None).cast("array<int>"), y["bbox"])).withField("seq_new", y["seqIndex"])

        return let(owner(urls.without_fragment(q["url"]), "new"), about)

    by_url = lambda qs: F.transform(F.array_sort(F.transform(qs, lambda q: F.struct(q["url"].alias("u"), q.alias("q")))), lambda s: s["q"])
    links = let(F.struct(here.alias("here"), secure.alias("https"), known.alias("old")), lambda v: F.concat(downgraded(v["here"], v["https"]), slashed(v["here"], v["old"])))
    return F.concat(links, F.coalesce(F.transform(by_url(probes), redirected), none_found()))


# Rasters


def region_link(r: Column) -> Column:
    """The first node with a telling anchor of which a region covers enough, the old side first: (side, node)."""
    def best(nodes, order):
        telling = lambda n: F.coalesce(t.non_empty(n["anchors"]["text"]), t.non_empty(n["href"]), t.non_empty(n["imageAlt"]), t.non_empty(n["anchors"]["ariaLabel"])).isNotNull()
        wide = lambda n: F.least(box(n, 0) + box(n, 2), r["x"] + r["w"]) - F.greatest(box(n, 0), r["x"])
        high = lambda n: F.least(box(n, 1) + box(n, 3), r["y"] + r["h"]) - F.greatest(box(n, 1), r["y"])
        space = lambda n: box(n, 2).cast("double") * box(n, 3)
        covered = lambda n: (space(n) > 0) & (F.greatest(wide(n), F.lit(0)) * F.greatest(high(n), F.lit(0)) / space(n) >= LINK_SHARE)
        met = F.filter(nodes, lambda n: telling(n) & F.coalesce(covered(n), F.lit(False)))
        return F.array_min(F.transform(met, lambda n: F.struct(n["seqIndex"].alias("seq"), n["id"].alias("id"), n.alias("node"))))["node"]

    return F.struct(best(F.col("o_nodes"), 0).alias("old"), best(F.col("n_nodes"), 1).alias("new"))


def visual_findings() -> Column:
    """Of the column `visual` (ratio, pixels, regions array<struct<x,y,w,h,pixels>>): regions of pages that changed enough."""

    def one(r):
        def about(k):
            anchors = F.coalesce(k["old"]["anchors"], k["new"]["anchors"])
            place = F.array(r["x"], r["y"], r["w"], r["h"]).cast("array<int>")
            linked_new = F.when(k["old"]["id"].isNull(), k["new"]["cssSelector"])
            evidence = {"visual": {"regionBbox": place, "changedPixels": r["pixels"], "regionChangedRatio": r["pixels"] / F.col("visual.area"), "pageChangedRatio": F.col("visual.ratio")}}
            found = finding("visual", "visual_region_changed", "visual", None, BASE["visual"], say("Visual region changed at ({}, {}) {}x{}", r["x"], r["y"], r["w"], r["h"]), anchors=anchors, evidence=evidence, selectors=(k["old"]["cssSelector"], linked_new), boxes=(place, place), locale=page("old", "lang"))
            return found.withField("seq_old", k["old"]["seqIndex"]).withField("seq_new", F.when(k["old"]["id"].isNull(), k["new"]["seqIndex"]))

        return let(region_link(r), about)

    return F.when(F.col("visual.ratio") >= LEAST_RATIO, F.transform("visual.regions", one)).otherwise(none_found())


def section_deltas(most: int = 8) -> Column:
    """Sections whose heights differ, the largest first: a full outer join of landmark paths within the row."""
    paths = F.array_distinct(F.concat(F.transform(page("old", "landmarkRects"), lambda r: r["path"]), F.transform(page("new", "landmarkRects"), lambda r: r["path"])))

    def one(p):
        last = lambda side: F.get(F.reverse(F.filter(page(side, "landmarkRects"), lambda r: r["path"] == p)), F.lit(0))
        return let(F.struct(last("old").alias("o"), last("new").alias("n")), lambda s: F.struct(p.alias("path"), s["o"].alias("o"), s["n"].alias("n"), F.coalesce(F.get(s["o"]["bbox"], F.lit(3)), F.lit(0)).alias("oldHeight"), F.coalesce(F.get(s["n"]["bbox"], F.lit(3)), F.lit(0)).alias("newHeight")))

    changed = F.filter(F.transform(paths, one), lambda d: d["oldHeight"] != d["newHeight"])
    ranked = F.array_sort(F.transform(changed, lambda d: F.struct((-F.abs(d["newHeight"] - d["oldHeight"])).alias("minus"), d["path"].alias("path"), d.alias("d"))))
    return F.slice(F.transform(ranked, lambda s: s["d"]), 1, most)


def height_findings() -> Column:
    """Pages of different heights (of their rasters, else as captured), with the sections that differ most."""
    a, b = F.coalesce(F.col("visual.old_h"), page("old", "pageHeight")), F.coalesce(F.col("visual.new_h"), page("new", "pageHeight"))

    def about(ds):
        rows = F.transform(ds, lambda d: F.struct((d["newHeight"] - d["oldHeight"]).alias("delta"), F.coalesce(d["o"]["heading"], d["n"]["heading"]).alias("heading"), d["newHeight"].alias("newHeight"), d["oldHeight"].alias("oldHeight"), d["path"].alias("path"), F.coalesce(d["o"]["role"], d["n"]["role"], F.lit("")).alias("role")))
        top = F.get(ds, F.lit(0))
        evidence = {"old": {"pageHeight": page("old", "pageHeight")}, "new": {"pageHeight": page("new", "pageHeight")}, "delta": page("new", "pageHeight") - page("old", "pageHeight"), "sectionDeltas": Optional(F.size(ds) > 0, rows)}
        return finding("height", "page_height_changed", "visual", None, BASE["height"], say("Page height changed from {} to {} px", a, b), evidence=evidence, boxes=(top["o"]["bbox"], top["n"]["bbox"]), locale=page("old", "lang"))

    return present(when(a != b, let(F.coalesce(section_deltas(), F.array().cast("array<struct<path:string,o:struct<path:string,role:string,heading:string,bbox:array<int>>,n:struct<path:string,role:string,heading:string,bbox:array<int>>,oldHeight:int,newHeight:int>>")), about)))


def all_findings(languages: list[str], regions: list[str], responsive: bool = False, policy: str = "never") -> Column:
    """Every detector's findings in the order of emission; a status that differs decides alone."""
    url_checks = F.concat(page_hygiene(languages, regions, policy), link_hygiene(policy))
    every = [visual_findings(), height_findings(), page_facts(), changed_nodes(responsive), missing_nodes(), broken_links(), sequence_findings(), leaf_styles(), ancestor_styles(), clickable_findings(), pseudo_findings(), network_findings(), console_findings(), accessibility_findings(), url_checks]
    joined = F.concat(*(F.coalesce(x, none_found()) for x in every))
    return let(status_findings(), lambda s: F.when(F.size(s) > 0, s).otherwise(joined))


def load_finding() -> Column:
    """A pair of which one side alone was captured."""
    side = F.when(F.col("old").isNull(), "old").otherwise("new")
    message = F.concat(side, F.lit(" capture missing"))
    return F.array(finding("hygiene", "load_error", "technical", None, BASE["load"], say("Page failed to load: {}", message), flat=True, evidence={"error": message}, locale=F.lit(None).cast("string")))
