"""Content detectors on paired nodes of captures, link probes and run warnings.

pairs: (pair_id, viewport, old_id, new_id, band, score); nodes, probes and captures as in sources.bundles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import non_empty

PAIR = ["pair_id", "viewport"]
RATIO_FLOOR = 0.9


def both_sides(pairs: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """pairs with the columns of either node as o_... and n_..."""
    side = lambda s, name: nodes.where(F.col("side") == name).select(*PAIR, F.col("id").alias(f"{name}_id"), *(F.col(c).alias(f"{s}_{c}") for c in columns))
    return pairs.join(side("o", "old"), [*PAIR, "old_id"]).join(side("n", "new"), [*PAIR, "new_id"])


def attribute_changes(pairs: DataFrame, nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(pair_id, viewport, old_id, new_id, type, old, new): texts, levels, link targets, alternative texts, images."""
    p = both_sides(pairs, nodes, ["kind", "text", "headingLevel", "href", "rawHref", "imageAlt", "loaded", "naturalWidth", "naturalHeight"])
    page = lambda s: pages.where(F.col("side") == s).select(*PAIR, F.col("url").alias(f"{s}_page"))
    p = p.join(page("old"), PAIR).join(page("new"), PAIR)
    o, n = (lambda c: F.col(f"o_{c}")), (lambda c: F.col(f"n_{c}"))
    e = lambda c: F.coalesce(c, F.lit(""))
    heading, link, image = n("kind") == "heading", n("kind").isin("link", "button"), n("kind") == "image"
    first = (o("headingLevel") == 1) | (n("headingLevel") == 1)
    text = e(o("text")) != e(n("text"))
    to = lambda c, own, other: urls.norm_href_cross_origin(c, F.col(own), F.col(other))
    target = link & o("href").isNotNull() & n("href").isNotNull() & (F.coalesce(o("rawHref"), o("href")) != F.coalesce(n("rawHref"), n("href"))) & (to(o("href"), "old_page", "new_page") != to(n("href"), "new_page", "old_page"))
    broken = image & F.coalesce(o("loaded"), F.lit(True)) & ~F.coalesce(n("loaded"), F.lit(True))
    whole = image & ~broken
    ratio = lambda c: F.least(o(c), n(c)) / F.greatest(o(c), n(c))
    shrunk = whole & F.coalesce(o("loaded") & n("loaded"), F.lit(False)) & (F.least(ratio("naturalWidth"), ratio("naturalHeight")) < RATIO_FLOOR)
    rules: list[tuple[str, Column, str]] = [
        ("changed_h1", heading & F.coalesce(first, F.lit(False)) & text, "text"),
        ("heading_structure_changed", heading & (o("headingLevel") != n("headingLevel")), "headingLevel"),
        ("changed_text", (heading & ~F.coalesce(first, F.lit(False)) | n("kind").isin("text", "generic")) & text, "text"),
        ("changed_link_target", target, "href"),
        ("changed_link_text", link & text, "text"),
        ("broken_image", broken, "loaded"),
        ("changed_alt_text", whole & (e(o("imageAlt")) != "") & (e(n("imageAlt")) != "") & (o("imageAlt") != n("imageAlt")), "imageAlt"),
        ("missing_alt_text", whole & (e(o("imageAlt")) != "") & (e(n("imageAlt")) == ""), "imageAlt"),
        ("changed_image_dimensions", shrunk, "naturalWidth"),
    ]
    found = [F.when(rule, F.struct(F.lit(name).alias("type"), o(c).cast("string").alias("old"), n(c).cast("string").alias("new"))) for name, rule, c in rules]
    return p.select(*PAIR, "old_id", "new_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select(*PAIR, "old_id", "new_id", "x.*")


def probe_owners(probes: DataFrame, nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Probes with the first node whose resolved reference is the probe's URL."""
    links = nodes.where("href is not null").join(pages.select(*PAIR, "side", F.col("url").alias("page")), [*PAIR, "side"])
    resolved = links.select(*PAIR, "side", urls.without_fragment(urls.resolve(F.col("href"), F.col("page"))).alias("url"), F.struct(F.col("seqIndex").alias("seq"), F.col("id").alias("id")).alias("owner"))
    return probes.join(resolved.groupBy(*PAIR, "side", "url").agg(F.min("owner").alias("owner")), [*PAIR, "side", "url"])


def broken_links(pairs: DataFrame, probes: DataFrame, nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """New probes of 400 or more that weren't skipped, unless the partner of their node was as broken before."""
    owned = probe_owners(probes, nodes, pages)
    new = owned.where("side = 'new' and skipped is null and status >= 400").select(*PAIR, "url", "status", F.col("owner.id").alias("new_id"))
    bad = F.coalesce(F.col("status") >= 400, F.lit(False)) | F.col("error").isNotNull()
    old = owned.where("side = 'old'").groupBy(*PAIR, F.col("owner.id").alias("old_id")).agg(F.bool_or(bad).alias("old_bad"))
    joined = new.join(pairs.select(*PAIR, "old_id", "new_id"), [*PAIR, "new_id"], "left").join(old, [*PAIR, "old_id"], "left")
    return joined.where(~F.coalesce("old_bad", F.lit(False))).select(*PAIR, "new_id", "url", "status")


def redirect_chains(probes: DataFrame) -> DataFrame:
    """New probes that took more than one redirect."""
    return probes.where("side = 'new' and skipped is null and error is null and size(redirectChain) > 1").select(*PAIR, "url", "redirectChain")


def duplicate_labels(nodes: DataFrame, tolerance: int = 2) -> DataFrame:
    """Text nodes that only repeat the label of a link or button around them: a semi-join on text and a range."""
    from ..functions.text import label_text

    t = nodes.where("kind = 'text'").withColumn("label", label_text(F.col("text"))).alias("t")
    w = nodes.where("kind in ('link', 'button')").withColumn("label", label_text(F.col("text"))).alias("w")
    x = lambda s, c: F.col(f"{s}.bbox.{c}")
    inside = (x("t", "x") >= x("w", "x") - tolerance) & (x("t", "y") >= x("w", "y") - tolerance) & (x("t", "x") + x("t", "w") <= x("w", "x") + x("w", "w") + tolerance) & (x("t", "y") + x("t", "h") <= x("w", "y") + x("w", "h") + tolerance)
    same = reduce(lambda a, b: a & b, [F.col(f"t.{c}") == F.col(f"w.{c}") for c in (*PAIR, "side", "label")])
    return t.join(w, same & inside, "left_semi").select(*PAIR, "side", "id")


def confidence(base: Column, environment_differs: Column, penalty: Column) -> Column:
    """Half where the environments differ, four fifths where a capture step failed; four decimals."""
    return F.round(base * F.when(environment_differs, 0.5).otherwise(1.0) * F.when(penalty, 0.8).otherwise(1.0) * 10000) / 10000


def capture_state(captures: DataFrame) -> DataFrame:
    """(pair_id, viewport, environment_differs, penalty) of two captures."""
    e, d = F.col("environment"), F.col("determinism")
    ran = lambda c: F.coalesce(d[c] == "ran", F.lit(False))
    rows = captures.select(*PAIR, "side", F.concat_ws("|", e["os"], e["chromiumBuild"], e["dsf"]).alias("env"), (~ran("timeFrozen") | ~ran("fontsReady") | ~(ran("lazyLoadPass") | ran("settle"))).alias("penalty"))
    return rows.groupBy(*PAIR).agg((F.countDistinct("env") > 1).alias("environment_differs"), F.bool_or("penalty").alias("penalty"))


def run_warnings(captures: DataFrame) -> DataFrame:
    """(pair_id, viewport, side, code): what a capture reports about itself."""
    d = F.col("determinism")
    step = lambda c: d[c].isin("failed")
    steps = ("animationsDisabled", "reducedMotion", "timeFrozen", "randomStubbed", "fontsReady", "imagesDecoded", "lazyLoadPass")
    pre, post = d["integrity"]["pre"], d["integrity"]["post"]
    images = F.abs(pre["imageCount"] - post["imageCount"]) > F.floor(pre["imageCount"] * 0.2)
    rules = [
        ("capture_step_failed", reduce(lambda a, b: a | b, [F.coalesce(step(s), F.lit(False)) for s in steps])),
        ("capture_integrity_delta", F.coalesce((pre["headingCount"] != post["headingCount"]) | images, F.lit(False))),
        ("capture_retried_without_time_freeze", F.coalesce(d["retriedWithoutTimeFreeze"], F.lit(False))),
        ("settle_quiescence_timeout", F.coalesce(d["quiescence"] == "timeout", F.lit(False))),
        ("settle_growth_capped", F.coalesce(d["settleGrowthCapped"], F.lit(False))),
        ("capability_mismatch", ~F.col("has_hit_tests")),
    ]
    found = F.filter(F.array(*(F.when(rule, F.lit(code)) for code, rule in rules)), lambda x: x.isNotNull())
    return captures.select(*PAIR, "side", F.explode(found).alias("code"))


def load_errors(captures: DataFrame) -> DataFrame:
    """Pairs of which one side alone was captured."""
    rows = captures.groupBy(*PAIR).agg(F.collect_set("side").alias("sides"))
    return rows.where(F.size("sides") == 1).select(*PAIR, F.when(F.array_contains("sides", "old"), "new").otherwise("old").alias("missing"))


def region_links(regions: DataFrame, nodes: DataFrame, least: float = 0.3) -> DataFrame:
    """The first node with a telling anchor of which a region covers enough; the old side first, else the new one.

    regions: (pair_id, viewport, x, y, w, h). The join is on the pair; a page has few regions.
    """
    a = F.col("anchors")
    telling = F.coalesce(*(non_empty(c) for c in (a["text"], F.col("href"), F.col("imageAlt"), a["ariaLabel"]))).isNotNull()
    n, r = nodes.where(telling).alias("n"), regions.alias("r")
    x = lambda c: F.col(f"n.bbox.{c}")
    wide = F.least(x("x") + x("w"), F.col("r.x") + F.col("r.w")) - F.greatest(x("x"), F.col("r.x"))
    high = F.least(x("y") + x("h"), F.col("r.y") + F.col("r.h")) - F.greatest(x("y"), F.col("r.y"))
    share = F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0)) / (x("w") * x("h"))
    joined = r.join(n, (F.col("r.pair_id") == F.col("n.pair_id")) & (F.col("r.viewport") == F.col("n.viewport")) & (x("w") * x("h") > 0) & (share >= least))
    best = F.struct(F.when(F.col("n.side") == "old", 0).otherwise(1).alias("order"), F.col("n.seqIndex").alias("seq"), F.col("n.id").alias("id"))
    return joined.groupBy("r.pair_id", "r.viewport", "r.x", "r.y", "r.w", "r.h").agg(F.min(best)["id"].alias("node_id"))
