"""From issues to results: ids, collision suffixes, scores, clusters, saturated regions, fix lists, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_id, non_empty
from ..functions.urls import id_stable_url

CLUSTER_LEAST, SATURATION, REGION_NODES, TOP = 3, 0.6, 10, 5
LANDMARKS = ["banner", "complementary", "contentinfo", "form", "main", "navigation"]
#: Issue types that count towards the saturation of a region (fixed values).
STRUCTURAL = [
    "missing_title",
    "missing_meta_description",
    "missing_h1",
    "missing_text",
    "missing_link",
    "missing_image",
    "missing_form",
    "missing_form_field",
    "missing_submit",
    "missing_button",
    "missing_alt_text",
    "broken_link",
    "broken_image",
    "heading_structure_changed",
    "component_reordered",
    "component_swapped",
]
SEVERITIES = ["info", "warning", "error", "critical"]
WEIGHTS = {"info": 1.0, "warning": 2.0, "error": 4.0, "critical": 8.0}


def severity_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), c) - 1


def issue_id(type_: Column, viewport: Column, text: Column, role: Column, href: Column, alt: Column, aria: Column, landmark: Column, heading: Column, prop: Column) -> Column:
    """The nearest heading counts only where nothing else tells the element."""
    stable = id_stable_url(href)
    known = F.coalesce(non_empty(text), non_empty(stable), non_empty(alt), non_empty(aria)).isNotNull()
    return content_id("issue", type_, viewport, text, role, stable, alt, aria, landmark, F.when(known, "").otherwise(heading), prop)


def suffixed(issues: DataFrame, by: list[str]) -> DataFrame:
    """Equal ids within `by` get -2, -3 ... in order of old position, new position and emission, nulls last."""
    w = Window.partitionBy(*by, "id").orderBy(F.col("seq_old").asc_nulls_last(), F.col("seq_new").asc_nulls_last(), "emit_ord")
    n = F.row_number().over(w)
    return issues.withColumn("n", n).withColumn("id", F.when(F.col("n") > 1, F.concat_ws("-", "id", F.col("n").cast("string"))).otherwise(F.col("id"))).drop("n")


def strength(text: Column, href: Column, landmark: Column, alt: Column | None = None, aria: Column | None = None, heading: Column | None = None) -> Column:
    """How well anchors tell an element: by itself, by what is near it, or not."""
    known = lambda *columns: F.coalesce(*(non_empty(c) for c in columns if c is not None)).isNotNull()
    return F.when(known(text, href, alt, aria), "high").when(known(heading, landmark), "medium").otherwise("low")


def fix_value(severity: Column, confidence: Column, anchor: Column) -> Column:
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv)), severity)
    bonus = F.when(anchor == "high", 1.0).when(anchor == "medium", 0.7).otherwise(0.4)
    return weight * confidence * bonus


def short_circuit(issues: DataFrame, by: list[str]) -> DataFrame:
    """Where a status differs, only that issue stays."""
    decisive = issues.where("type = 'status_code_mismatch'")
    rest = issues.where("type <> 'status_code_mismatch'").join(decisive.select(*by).distinct(), by, "left_anti")
    return decisive.unionByName(rest)


def landmark_counts(nodes: DataFrame, by: list[str]) -> DataFrame:
    return nodes.groupBy(*by, F.coalesce("landmark", F.lit("(none)")).alias("landmark")).agg(F.count("*").alias("nodes"))


def category_scores(issues: DataFrame, by: list[str]) -> DataFrame:
    """1 / (1 + n) over the issues of a category that aren't information; technical is 0 where a status differs."""
    n = lambda c: F.count_if((F.col("category") == c) & (F.col("severity") != "info"))
    score = lambda c: 1 / (1 + n(c))
    technical = F.when(F.count_if(F.col("type") == "status_code_mismatch") > 0, 0.0).otherwise(score("technical"))
    return issues.groupBy(*by).agg(score("content").alias("content"), score("structure").alias("structure"), score("style").alias("style"), technical.alias("technical"), score("hygiene").alias("hygiene"))


def regions(issues: DataFrame, counts: DataFrame, by: list[str], least: float = SATURATION) -> DataFrame:
    """Landmarks of which most old nodes changed in structure."""
    found = issues.where(F.col("landmark").isin(*LANDMARKS)).groupBy(*by, "landmark").agg(F.count_if(F.col("type").isin(*STRUCTURAL)).alias("structural"), F.max(severity_rank(F.col("severity"))).alias("worst"), F.array_sort(F.collect_list("id")).alias("members"))
    joined = found.join(counts, [*by, "landmark"]).withColumn("saturation", F.col("structural") / F.greatest("nodes", "structural"))
    kept = joined.where((F.col("saturation") >= least) & (F.col("nodes") >= REGION_NODES))
    worst = F.element_at(F.array(*map(F.lit, SEVERITIES)), (F.col("worst") + 1).cast("int"))
    return kept.select(*by, "landmark", "structural", "nodes", "saturation", worst.alias("severity"), "members", content_id("region", F.lit("region"), F.col("landmark")).alias("id"))


def clusters(issues: DataFrame, claimed: DataFrame, by: list[str]) -> DataFrame:
    """Issues of one type in one landmark, three at least, that no region claims."""
    free = issues.join(claimed, [*by, "id"], "left_anti").where(non_empty(F.col("landmark")).isNotNull())
    found = free.groupBy(*by, "type", "landmark").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return found.where(F.size("members") >= CLUSTER_LEAST).withColumn("n", F.size("members"))


def status(rank: Column) -> Column:
    """Of the worst severity rank."""
    return F.when(rank >= 2, "fail").when(rank == 1, "warn").otherwise("pass")


def exit_code(rank: Column, fail_on: str = "error") -> Column:
    if fail_on == "never":
        return F.lit(0)
    return F.when(F.coalesce(rank, F.lit(-1)) >= SEVERITIES.index(fail_on), 1).otherwise(0)


def baseline_split(issues: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept issues, suppressed ones, and accepted ids that no issue has."""
    ids = accepted.where("id is not null").select("id").distinct()
    return issues.join(ids, "id", "left_anti"), issues.join(ids, "id", "left_semi"), ids.join(issues.select("id"), "id", "left_anti")
