"""From findings to issues: severity, confidence, content-addressed ids, fix values; and results of whole pairs.

A pair's issues are as many as its pages have elements, so results are made inside one row for each pair.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.arrays import InOrder, Optional, Raw, json_text, let
from . import assemble, findings, pairing
from .assemble import LANDMARKS, SEVERITIES, STRUCTURAL
from .pairing import PAIR

PROFILES = ("content-structure", "strict-visual")
#: Severities that hold whatever the profile (fixed values).
ALWAYS = {"accessibility_improved": "info", "console_error": "warning", "load_error": "critical", "status_code_mismatch": "critical", "missing_form": "critical"}
BUILTIN_TYPES = {"clickable_area_regressed": "error"}
BUILTIN_PROPERTIES = {"letter-spacing": "info", "line-height": "info"}
HARD_CRITICAL = ("load_error", "status_code_mismatch", "missing_form")
BY_CATEGORY = {"visual": ("info", "error"), "style": ("warning", "error"), "accessibility": ("warning", "warning")}
SCHEMA_VERSION, TOOL_VERSION = "1.3", "0.2.0"


@dataclass(frozen=True)
class Options:
    """What a user may choose: profile, severities by type and property, accepted ids, landmarks in scope, image and slash rules."""

    profile: str = "content-structure"
    types: dict[str, str] = field(default_factory=dict)
    properties: dict[str, str] = field(default_factory=dict)
    baseline: tuple[str, ...] = ()
    scope: tuple[str, ...] = ()
    responsive_images: bool = False
    trailing_slash: str = "never"
    fail_on: str = "error"
    run_id: str = ""

    def accepted_types(self) -> dict[str, str]:
        """The user's types without those that would make a hard critical one less than critical."""
        return {k: v for k, v in self.types.items() if not (k in HARD_CRITICAL and v != "critical")}

    def denied_types(self) -> dict[str, str]:
        return {k: v for k, v in self.types.items() if k not in self.accepted_types()}


def _lookup(values: dict[str, str], key: Column) -> Column:
    if not values:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*(F.lit(x) for k in sorted(values) for x in (k, values[k]))), key)


def severity(type_: Column, category: Column, prop: Column, options: Options) -> Column:
    """The user's property, the user's type, the built-in property, the built-in type, the profile: the first that says one."""
    strict = PROFILES.index(options.profile)
    profile = F.coalesce(_lookup(ALWAYS, type_), _lookup({k: v[strict] for k, v in BY_CATEGORY.items()}, category), F.lit("error"))
    return F.coalesce(_lookup(options.properties, prop), _lookup(options.accepted_types(), type_), _lookup(BUILTIN_PROPERTIES, prop), _lookup(BUILTIN_TYPES, type_), profile)


def capture_penalties() -> tuple[Column, Column]:
    """Do the environments differ? Did a step of either capture fail that detectors rely on?"""
    e = lambda s, c: F.col(f"{s}.environment.{c}")
    differ = ~(e("old", "os").eqNullSafe(e("new", "os")) & e("old", "chromiumBuild").eqNullSafe(e("new", "chromiumBuild")) & e("old", "dsf").eqNullSafe(e("new", "dsf")))
    ran = lambda s, c: F.coalesce(F.col(f"{s}.determinism.{c}") == "ran", F.lit(False))
    failed = lambda s: ~ran(s, "timeFrozen") | ~ran(s, "fontsReady") | ~(ran(s, "lazyLoadPass") | ran(s, "settle"))
    return differ, failed("old") | failed("new")


def prepared(bundles: DataFrame, visual: DataFrame | None = None) -> DataFrame:
    """Matched pairs with `ancestors` (their pairs) and `visual` (regions of rasters)."""
    rows = pairing.matched(bundles).withColumn("ancestors", findings.ancestor_pairs())
    shape = "struct<ratio:double,area:double,old_h:int,new_h:int,regions:array<struct<x:int,y:int,w:int,h:int,pixels:long>>>"
    if visual is None:
        return rows.withColumn("visual", F.lit(None).cast(shape))
    return rows.join(visual.select(*PAIR, F.struct("ratio", "area", "old_h", "new_h", "regions").cast(shape).alias("visual")), PAIR, "left")


def found_issues(rows: DataFrame, languages: list[str], regions: list[str], options: Options = Options()) -> DataFrame:
    """One row an issue, with its final id: (pair_id, viewport, id, type, category, severity, confidence, ..., fix_value, emit_ord)."""
    differ, penalty = capture_penalties()
    every = F.when(F.col("old").isNull() | F.col("new").isNull(), findings.load_finding()).otherwise(findings.all_findings(languages, regions, options.responsive_images, options.trailing_slash))
    one = rows.select(*PAIR, F.coalesce(differ, F.lit(False)).alias("differ"), F.coalesce(penalty, F.lit(False)).alias("penalty"), F.posexplode_outer(every).alias("emit_ord", "f")).where("f is not null")  # an inner one would be evaluated again, as a filter
    f, a = (lambda c: F.col(f"f.{c}")), (lambda c: F.col(f"f.anchors.{c}"))
    factor = F.when(F.col("differ"), 0.5).otherwise(1.0) * F.when(F.col("penalty"), 0.8).otherwise(1.0)
    confidence = F.when(f("flat"), f("base")).otherwise(t.round4(f("base") * factor))
    confidence = F.when(f("after") == 1, confidence).otherwise(t.round4(confidence * f("after")))
    plain = F.when(f("type") != "pseudo_element_missing", F.regexp_replace(f("prop"), "^::[a-z]+\\.", ""))
    sev = F.when(f("uncertain"), "info").otherwise(F.coalesce(f("severity"), severity(f("type"), f("category"), plain, options)))
    named = one.select(
        *PAIR, "emit_ord", f("type").alias("type"), f("category").alias("category"), sev.alias("severity"), confidence.alias("confidence"), f("locale").alias("locale"), f("goal").alias("goal"), f("message").alias("message"),
        f("anchors").alias("anchors"), a("landmark").alias("landmark"), a("nearestHeading").alias("heading"), f("css_selector_old").alias("css_selector_old"), f("css_selector_new").alias("css_selector_new"), f("bbox_old").alias("bbox_old"), f("bbox_new").alias("bbox_new"), f("seq_old").alias("seq_old"), f("seq_new").alias("seq_new"),
        f("prop").alias("prop"), f("evidence").alias("evidence"), f("remediation").alias("remediation"), f("uncertain").alias("uncertain"),
        assemble.issue_id(f("type"), F.col("viewport"), a("text"), a("role"), a("href"), a("alt"), a("ariaLabel"), a("landmark"), a("nearestHeading"), f("prop")).alias("id"),
        assemble.strength(a("text"), a("href"), a("landmark"), a("alt"), a("ariaLabel"), a("nearestHeading")).alias("strength"),
    )
    return assemble.suffixed(named, PAIR).withColumn("fix_value", assemble.fix_value(F.col("severity"), F.col("confidence"), F.col("strength")))


def issue_json(i: Column) -> Column:
    anchors = F.coalesce(i["anchors"], findings.anchors_of())
    locator = InOrder(anchors=anchors, cssSelectorOld=i["css_selector_old"], cssSelectorNew=i["css_selector_new"], bboxOld=i["bbox_old"], bboxNew=i["bbox_new"], seqIndexOld=i["seq_old"], seqIndexNew=i["seq_new"])
    return json_text(InOrder({"id": i["id"], "type": i["type"], "category": i["category"], "severity": i["severity"], "confidence": i["confidence"], "viewport": i["viewport"], "locale": i["locale"], "goal": i["goal"], "message": i["message"], "locator": locator, "evidence": Raw(i["evidence"]), "remediation": Raw(i["remediation"])}))


def rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), c) - 1


def worst(issues: Column) -> Column:
    return F.array_max(F.transform(issues, lambda i: rank(i["severity"])))


def status(issues: Column) -> Column:
    return let(worst(issues), lambda w: F.when(w >= 2, "fail").when(w == 1, "warn").otherwise("pass"))


def ids(issues: Column) -> Column:
    return F.transform(issues, lambda i: i["id"])


def region_rows(kept: Column, counts: Column) -> Column:
    """Landmarks of which most old nodes changed in structure, the most saturated first."""

    def one(name):
        members = F.filter(kept, lambda i: i["landmark"] == name)
        structural = F.size(F.filter(members, lambda i: i["type"].isin(*STRUCTURAL)))
        nodes = F.coalesce(F.try_element_at(counts, name), F.lit(0))
        return let(F.struct(members.alias("m"), structural.alias("s"), nodes.cast("int").alias("n")), made(name))

    def made(name):
        def inner(v):
            share = v["s"] / F.greatest(v["n"], v["s"])
            sev = F.get(F.array(*map(F.lit, SEVERITIES)), worst(v["m"]).cast("int"))
            summary = findings.say("{} region: {}/{} old nodes structurally changed, {} issues claimed", name, v["s"], v["n"], F.size(v["m"]))
            row = F.struct(t.content_id("region", F.lit("region"), name).alias("id"), name.alias("landmark"), share.alias("saturation"), v["s"].alias("structuralCount"), v["n"].alias("oldNodeCount"), F.array_sort(ids(v["m"])).alias("memberIssueIds"), sev.alias("severity"), summary.alias("summary"))
            return F.when((v["n"] >= assemble.REGION_NODES) & (share >= assemble.SATURATION), row)

        return inner

    found = F.filter(F.transform(F.array(*map(F.lit, LANDMARKS)), one), lambda r: r.isNotNull())
    return F.transform(F.array_sort(F.transform(found, lambda r: F.struct((-r["saturation"]).alias("minus"), r["id"].alias("id"), r.alias("r")))), lambda s: s["r"])


def cluster_rows(kept: Column, claimed: Column) -> Column:
    """Style issues of one type and property, then others of one type and landmark, three at least, the largest first."""

    def grouped(issues, field_, tag, words):
        keyed = F.filter(issues, lambda i: t.non_empty(i[field_]).isNotNull() & ((i["category"] == "style") & i["remediation"].isNotNull() & (i["type"] != "pseudo_element_missing") if tag == "prop" else F.lit(True)))
        keys = F.array_distinct(F.transform(keyed, lambda i: F.struct(i["type"].alias("type"), i[field_].alias("value"))))

        def one(k):
            members = F.array_sort(ids(F.filter(keyed, lambda i: (i["type"] == k["type"]) & (i[field_] == k["value"]))))
            null = F.lit(None).cast("string")
            shared = (k["value"], null) if tag == "prop" else (null, k["value"])
            return let(members, lambda m: F.struct(t.content_id("cluster", k["type"], F.lit(tag), k["value"]).alias("id"), m.alias("issueIds"), shared[0].alias("sharedProperty"), shared[1].alias("sharedLandmark"), findings.say(words, F.size(m), k["type"], k["value"]).alias("summary")))

        return F.filter(F.transform(keys, one), lambda c: F.size(c["issueIds"]) >= assemble.CLUSTER_LEAST)

    def both(free):
        def with_first(first):
            taken = F.flatten(F.transform(first, lambda c: c["issueIds"]))
            rest = F.filter(free, lambda i: ~F.array_contains(taken, i["id"]))
            return F.concat(first, grouped(rest, "landmark", "lm", "{} {} issues in {}"))

        return let(grouped(free, "prop", "prop", "{} {} issues share {}"), with_first)

    every = let(F.filter(kept, lambda i: ~F.array_contains(claimed, i["id"])), both)
    return F.transform(F.array_sort(F.transform(every, lambda c: F.struct((-F.size(c["issueIds"])).alias("minus"), c["id"].alias("id"), c.alias("c")))), lambda s: s["c"])


CATEGORIES = ["content", "structure", "style", "accessibility", "technical", "hygiene"]


def score(issues: Column, category: str) -> Column:
    """1 / (1 + issues that aren't information); accessibility counts regressions only."""
    counts = lambda i: (i["severity"] != "info") & ((i["type"] == "accessibility_regression") if category == "accessibility" else (i["category"] == category))
    return 1.0 / (1.0 + F.size(F.filter(issues, counts)))


def scores(issues: Column, visual: Column) -> dict[str, Column]:
    out = {"visual": visual} | {c: score(issues, c) for c in CATEGORIES}
    out["technical"] = F.when(F.exists(issues, lambda i: i["type"] == "status_code_mismatch"), 0.0).otherwise(out["technical"])
    return out


def landmark_scores(issues: Column) -> Column:
    """(landmark, scores without visual), by landmark, of issues without one under (none)."""
    name = lambda i: F.coalesce(i["landmark"], F.lit("(none)"))
    names = F.array_sort(F.array_distinct(F.transform(issues, name)))
    return F.transform(names, lambda n: let(F.filter(issues, lambda i: name(i) == n), lambda own: F.struct(n.alias("landmark"), *(score(own, c).alias(c) for c in CATEGORIES))))


def histogram(issues: Column, field_: str) -> Column:
    """{value: count} as JSON, by value."""
    values = F.transform(issues, lambda i: i[field_])
    pairs = F.transform(F.array_sort(F.array_distinct(values)), lambda v: F.concat(json_text(v), F.lit(":"), F.size(F.filter(values, lambda x: x == v)).cast("string")))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def fixable(issues: Column) -> Column:
    return F.size(F.filter(issues, lambda i: (rank(i["severity"]) >= 1) & (i["strength"] != "low") & i["remediation"].isNotNull()))


def top_fixes(kept: Column, regions: Column, clusters: Column, most: int = assemble.TOP) -> Column:
    """Regions, clusters, issues that neither claims, and critical ones that a region claims, by worth."""
    value = lambda members: F.array_max(F.transform(F.filter(kept, lambda i: F.array_contains(members, i["id"])), lambda i: i["fix_value"]))
    item = lambda v, id_: F.struct((-v).alias("minus"), id_.alias("id"))
    claimed = F.flatten(F.transform(regions, lambda r: r["memberIssueIds"]))
    grouped = F.flatten(F.transform(clusters, lambda c: c["issueIds"]))

    def queue(c):
        free = F.filter(kept, lambda i: (~F.array_contains(c["regions"], i["id"]) & ~F.array_contains(c["clusters"], i["id"])) | (F.array_contains(c["regions"], i["id"]) & (i["severity"] == "critical")))
        every = F.concat(F.transform(regions, lambda r: item(value(r["memberIssueIds"]), r["id"])), F.transform(clusters, lambda x: item(value(x["issueIds"]), x["id"])), F.transform(free, lambda i: item(i["fix_value"], i["id"])))
        return F.transform(F.slice(F.array_sort(every), 1, most), lambda q: q["id"])

    return let(F.struct(claimed.alias("regions"), grouped.alias("clusters")), queue)


STEPS = ["animationsDisabled", "reducedMotion", "timeFrozen", "randomStubbed", "fontsReady", "imagesDecoded", "lazyLoadPass", "settled"]


def merged_determinism(dets: Column) -> Column:
    """The worst of several captures: failed before skipped before ran; lists together; flags if any; the first integrity."""
    order = F.array(*map(F.lit, ("ran", "skipped", "failed")))
    step = lambda c: F.get(order, F.array_max(F.transform(dets, lambda d: F.array_position(order, d[c]) - 1)).cast("int"))
    late = lambda c: F.get(order, F.array_max(F.filter(F.transform(dets, lambda d: F.when(d[c].isNotNull(), F.array_position(order, d[c]) - 1)), lambda x: x.isNotNull())).cast("int"))
    names = lambda c: F.array_sort(F.array_distinct(F.flatten(F.transform(dets, lambda d: F.coalesce(d[c], F.array().cast("array<string>"))))))
    flag = lambda c: F.exists(dets, lambda d: F.coalesce(d[c], F.lit(False)))
    first = F.get(F.filter(F.transform(dets, lambda d: d["integrity"]), lambda x: x.isNotNull()), F.lit(0))
    quiet = F.when(F.exists(dets, lambda d: F.coalesce(d["quiescence"] == "timeout", F.lit(False))), "timeout").otherwise(F.get(F.filter(F.transform(dets, lambda d: d["quiescence"]), lambda x: x.isNotNull()), F.lit(0)))
    return F.struct(*(step(c).alias(c) for c in STEPS), late("settle").alias("settle"), late("hitTestProbe").alias("hitTestProbe"), quiet.alias("quiescence"), flag("settleScrollIneffective").alias("settleScrollIneffective"), flag("settleGrowthCapped").alias("settleGrowthCapped"), names("clicked").alias("clicked"), names("hidden").alias("hidden"), names("masked").alias("masked"), flag("retriedWithoutTimeFreeze").alias("retriedWithoutTimeFreeze"), first.alias("integrity"))


WARNING = "struct<code:string,message:string,context:string>"


def warning(code: str, message: Column, context) -> Column:
    return F.struct(F.lit(code).alias("code"), message.alias("message"), json_text(context).alias("context")).cast(WARNING)


def determinism_warnings(old: Column, new: Column) -> Column:
    """What the captures report about themselves, by kind, the old side first."""
    both = (("old", old), ("new", new))
    say, some = findings.say, lambda cond, w: F.when(F.coalesce(cond, F.lit(False)), w)
    out = []
    for side, d in both:
        out += [some(d[s] == "failed", warning("capture_step_failed", say(f"{side} capture: stabilizer step '{s}' failed; the capture may not reflect the page's true state"), {"side": side, "step": s})) for s in STEPS]
    for side, d in both:
        pre, post = d["integrity"]["pre"], d["integrity"]["post"]
        heads = pre["headingCount"] != post["headingCount"]
        images = (pre["imageCount"] > 0) & (F.abs(post["imageCount"] - pre["imageCount"]) > F.floor(pre["imageCount"] * 0.2))
        parts = F.concat_ws(", ", some(heads, say("headings {}→{}", pre["headingCount"], post["headingCount"])), some(images, say("images {}→{}", pre["imageCount"], post["imageCount"])))
        out.append(some(heads | images, warning("capture_integrity_delta", say(f"{side} capture: page inventory changed during stabilization ({{}}); the capture may include stabilizer-induced artifacts", parts), {"side": side, "pre": pre, "post": post})))
    told = [
        ("capture_retried_without_time_freeze", lambda d: d["retriedWithoutTimeFreeze"], "time-freeze broke page scripts; the capture was automatically retried with the clock freeze disabled"),
        ("settle_quiescence_timeout", lambda d: d["quiescence"] == "timeout", "the settle stage's quiescence wait hit its hard timeout without observing a stable DOM; the page may still have been mutating at capture time"),
        ("settle_growth_capped", lambda d: d["settleGrowthCapped"], "the settle stage's scroll-through hit its page-growth cap; the page kept growing under scroll and was not fully captured"),
    ]
    for code, rule, words in told:
        out += [some(rule(d), warning(code, F.lit(f"{side} capture: {words}"), {"side": side})) for side, d in both]
    return F.filter(F.array(*out), lambda w: w.isNotNull())


def capability_warnings(old: str = "old", new: str = "new") -> Column:
    """Channels that one capture of a viewport has and the other lacks; entries of pseudo-elements that were cut."""
    has = lambda s, c: F.coalesce(F.size(F.map_keys(F.col(f"{s}.{c}"))) > 0, F.lit(False))
    ran = lambda s: F.coalesce(F.col(f"{s}.determinism.settle") == "ran", F.lit(False))
    out = []
    for channel, a, b in (("hitTests", has(old, "hitTests"), has(new, "hitTests")), ("pseudoElements", has(old, "pseudoElements"), has(new, "pseudoElements")), ("settle", ran(old), ran(new))):
        lacks = F.when(a & ~b, "new").when(b & ~a, "old")
        out.append(F.when(lacks.isNotNull(), warning("capability_mismatch", findings.say("capability mismatch: the " + channel + " channel is missing on the {} capture; its detector is disabled", lacks), {"channel": channel, "missingOn": lacks})))
    cut = lambda s: F.coalesce(F.get_json_object(F.col(f"{s}.pseudoTruncated"), "$.droppedCount"), F.lit("0"))
    words = "the pseudo-element capture budget was exceeded on at least one side; tier-ancestor/selector pseudo_element_missing issues from this pass are demoted to info severity to avoid false positives from asymmetric drop order"
    out.append(F.when(F.col(f"{old}.pseudoTruncated").isNotNull() | F.col(f"{new}.pseudoTruncated").isNotNull(), warning("pseudo_budget_truncated", F.lit(words), {"droppedCountOld": cut(old), "droppedCountNew": cut(new)})))
    return F.filter(F.array(*out), lambda w: w.isNotNull())


def stale_warning(options: Options, suppressed: Column) -> Column:
    """Accepted ids that no issue has; the first twenty by name are shown."""
    accepted = F.array(*(F.lit(x) for x in sorted(set(options.baseline)))).cast("array<string>")
    stale = F.filter(accepted, lambda x: ~F.array_contains(suppressed, x))
    message = findings.say("{} baseline id(s) matched no issue in this run; the accept-list may be stale — regenerate it or switch to durable ids", F.size(stale))
    return F.when(F.size(stale) > 0, F.array(warning("baseline_stale_ids", message, {"staleCount": F.size(stale), "staleIds": F.slice(stale, 1, 20)}))).otherwise(F.array().cast(f"array<{WARNING}>"))


def denied_warning(options: Options) -> Column:
    """Entries of the user's map that would have made a hard critical type less."""
    denied = options.denied_types()
    if not denied:
        return F.array().cast(f"array<{WARNING}>")
    names = ", ".join(f"{k}={v}" for k, v in sorted(denied.items()))
    return F.array(warning("severity_map_denied", F.lit(f"severity map: types that are always critical can't be demoted: {names}"), {"denied": {k: denied[k] for k in sorted(denied)}}))


def results(rows: DataFrame, issues: DataFrame, options: Options = Options(), extra: Column | None = None) -> DataFrame:
    """One row a pair: kept issues, regions, clusters, scores, status, exit code, warnings and the result document."""
    listed = issues.groupBy("pair_id").agg(F.collect_list(F.struct("viewport", "emit_ord", *[c for c in issues.columns if c not in (*PAIR, "emit_ord")])).alias("all"))
    counts = lambda nodes: F.transform(nodes, lambda n: F.coalesce(n["anchors"]["landmark"], F.lit("(none)")))
    per_view = rows.select("pair_id", F.struct(F.col("viewport").alias("name"), counts(F.col("o_nodes")).alias("landmarks"), F.col("old.determinism").alias("od"), F.col("new.determinism").alias("nd"), F.col("old.page.finalUrl").alias("o"), F.col("new.page.finalUrl").alias("n"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce(F.col("visual.ratio"), F.lit(0.0)))).alias("visual"), capability_warnings().alias("warnings")).alias("v"))
    views = per_view.groupBy("pair_id").agg(F.array_sort(F.collect_list("v"), lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)).alias("views"))
    base = views.join(listed, "pair_id", "left").withColumn("all", F.coalesce("all", F.array().cast(listed.schema["all"].dataType)))
    accepted = F.array(*(F.lit(x) for x in sorted(set(options.baseline)))).cast("array<string>")
    scoped = F.array(*(F.lit(x) for x in sorted(set(options.scope)))).cast("array<string>")
    outside = lambda i: i["landmark"].isNotNull() & ~F.array_contains(scoped, i["landmark"]) if options.scope else F.lit(False)
    by_worth = lambda xs: F.array_sort(xs, lambda a, b: F.when(a["fix_value"] > b["fix_value"], -1).when(a["fix_value"] < b["fix_value"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    split = base.withColumn("suppressed", F.array_sort(ids(F.filter("all", lambda i: F.array_contains(accepted, i["id"]))))).withColumn("open", F.filter("all", lambda i: ~F.array_contains(accepted, i["id"])))
    split = split.withColumn("outside", F.array_sort(ids(F.filter("open", outside)))).withColumn("kept", by_worth(F.filter("open", lambda i: ~outside(i))))
    landmarks = F.flatten(F.transform("views", lambda v: v["landmarks"]))
    tally = F.map_from_entries(F.transform(F.array_distinct(landmarks), lambda n: F.struct(n, F.size(F.filter(landmarks, lambda x: x == n)))))
    made = split.withColumn("regions", region_rows(F.col("kept"), tally))
    made = made.withColumn("claimed", F.flatten(F.transform("regions", lambda r: r["memberIssueIds"])))
    made = made.withColumn("clusters", cluster_rows(F.col("kept"), F.col("claimed")))
    made = made.withColumn("top_fixes", top_fixes(F.col("kept"), F.col("regions"), F.col("clusters")))
    det = lambda c: merged_determinism(F.filter(F.transform("views", lambda v: v[c]), lambda d: d.isNotNull()))
    made = made.withColumns({"old_determinism": det("od"), "new_determinism": det("nd")})
    view_status = F.transform("views", lambda v: let(F.filter("kept", lambda i: i["viewport"] == v["name"]), lambda own: F.struct(v["name"].alias("name"), status(own).alias("status"), ids(own).alias("issues"))))
    made = made.withColumn("viewports", view_status).withColumn("status", status(F.col("kept")))
    by_channel = F.flatten(F.transform("views", lambda v: v["warnings"]))
    first_of = F.filter(by_channel, lambda w, i: ~F.exists(F.slice(by_channel, F.lit(1), i), lambda o: (o["code"] == w["code"]) & o["context"].eqNullSafe(w["context"])))
    warn = F.concat(determinism_warnings(F.col("old_determinism"), F.col("new_determinism")), stale_warning(options, F.col("suppressed")), first_of, denied_warning(options), extra if extra is not None else F.array().cast(f"array<{WARNING}>"))
    made = made.withColumn("warnings", warn).withColumn("exit_code", assemble.exit_code(worst(F.col("kept")), options.fail_on))
    visual = F.coalesce(F.array_min(F.transform("views", lambda v: v["visual"])), F.lit(1.0))
    made = made.withColumn("scores", F.struct(*(c.alias(n) for n, c in scores(F.col("kept"), visual).items()), landmark_scores(F.col("kept")).alias("by_landmark")))
    made = made.withColumns({"fixable": fixable(F.col("kept")), "by_type": histogram(F.col("kept"), "type"), "by_severity": histogram(F.col("kept"), "severity"), "old_url": F.get("views", F.lit(0))["o"], "new_url": F.get("views", F.lit(0))["n"]})
    return made.drop("open", "all", "claimed").withColumn("document", document(options))


def document(options: Options) -> Column:
    """The result of a pair as one JSON text with a fixed order of members."""
    c = F.col
    joined = lambda xs: Raw(F.concat(F.lit("["), F.array_join(xs, ","), F.lit("]")))
    by_landmark = F.concat(F.lit("{"), F.array_join(F.transform("scores.by_landmark", lambda s: F.concat(json_text(s["landmark"]), F.lit(":"), json_text(InOrder({k: s[k] for k in CATEGORIES})))), ","), F.lit("}"))
    summary = InOrder(fixableNow=c("fixable"), byType=Raw(c("by_type")), bySeverity=Raw(c("by_severity")), clusterCount=F.size("clusters"), regionCount=F.size("regions"), topFixes=c("top_fixes"))
    views = joined(F.transform("viewports", lambda v: json_text(InOrder(name=v["name"], status=v["status"], issues=v["issues"], artifacts=InOrder(old=F.concat(v["name"], F.lit("/old.png")), new=F.concat(v["name"], F.lit("/new.png")), diff=F.concat(v["name"], F.lit("/diff.png")))))))
    warnings = joined(F.transform("warnings", lambda w: json_text(InOrder(code=w["code"], message=w["message"], context=Raw(w["context"])))))
    first = F.get("viewports", F.lit(0))["name"]
    echo = {"types": options.accepted_types(), "properties": dict(options.properties)} if options.types or options.properties else None
    return json_text(
        InOrder(
            {
                "schemaVersion": SCHEMA_VERSION, "toolVersion": TOOL_VERSION, "runId": options.run_id, "oldUrl": c("old_url"), "newUrl": c("new_url"), "parityProfile": options.profile,
                "severityMap": Optional(F.lit(echo is not None), echo), "status": c("status"), "agentSummary": summary,
                "scores": InOrder({"visual": c("scores.visual"), **{k: c(f"scores.{k}") for k in CATEGORIES}, "byLandmark": Raw(by_landmark)}),
                "viewports": views, "issues": joined(F.transform("kept", issue_json)), "clusters": c("clusters"), "regions": c("regions"),
                "suppressed": InOrder(count=F.size("suppressed"), ids=c("suppressed")), "warnings": warnings, "scopedTo": sorted(set(options.scope)) if options.scope else None,
                "outOfScope": InOrder(count=F.size("outside"), ids=c("outside")), "determinism": InOrder(old=c("old_determinism"), new=c("new_determinism")),
                "artifacts": InOrder(old=F.concat(first, F.lit("/old.png")), new=F.concat(first, F.lit("/new.png")), diff=F.concat(first, F.lit("/diff.png"))),
            }
        )
    )
