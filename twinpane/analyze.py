"""The library's entry points: compare captures, look at results, write them.

    bundles = read_bundles(spark, "captures/*/*/*.json")
    found = analyze(bundles, Options(profile="strict-visual"))
    found.issues, found.results

A run is one job over any number of page pairs.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import locales
from .operators import channels, issues, report
from .operators.issues import Options
from .operators.pairing import PAIR
from .sources.bundles import read_baseline, read_bundles, read_severity_map, write_bundles

__all__ = ["Found", "Options", "analyze", "explain", "probe_plan", "read_bundles", "read_results", "self_check", "show", "with_files", "write_bundles", "write_results", "write_self_check"]


@dataclass(frozen=True)
class Found:
    """rows: matched pairs; issues: one row each; results: one row a pair, with the result document."""

    rows: DataFrame
    issues: DataFrame
    results: DataFrame


def analyze(bundles: DataFrame, options: Options = Options(), *, rasters: DataFrame | None = None, extra: Column | None = None) -> Found:
    """Issues and results of captures (as of read_bundles); rasters (see channels.visual_regions) add the visual channel."""
    visual = channels.visual_summary(rasters) if rasters is not None else None
    rows = issues.prepared(bundles, visual)
    found = issues.found_issues(rows, *locales.known_codes(bundles.sparkSession), options)
    return Found(rows, found, issues.results(rows, found, options, extra))


def with_files(spark: SparkSession, options: Options, *, baseline: str | None = None, severity_map: str | None = None) -> Options:
    """Options with the accepted ids and the severities of files; both are small lists a user wrote."""
    from dataclasses import replace

    from .operators.ancestors import STYLE_PROPERTIES

    if baseline is not None:
        options = replace(options, baseline=tuple(r["id"] for r in read_baseline(spark, baseline).collect()))
    if severity_map is not None:
        rows = read_severity_map(spark, severity_map, ISSUE_TYPES, STYLE_PROPERTIES).collect()
        pick = lambda scope: {r["key"]: r["severity"] for r in rows if r["scope"] == scope}
        options = replace(options, types=pick("types"), properties=pick("properties"))
    return options


#: Every issue type (fixed values).
ISSUE_TYPES = [
    "visual_region_changed", "page_height_changed", "missing_title", "changed_title", "missing_meta_description", "changed_meta_description", "missing_h1", "changed_h1", "heading_structure_changed",
    "missing_text", "changed_text", "duplicate_text", "missing_link", "changed_link_target", "changed_link_text", "broken_link", "missing_button", "changed_cta", "missing_image", "broken_image",
    "changed_alt_text", "missing_alt_text", "changed_image_dimensions", "missing_form", "changed_form", "missing_form_field", "changed_required_field", "missing_submit", "component_swapped",
    "component_reordered", "style_changed", "background_gradient_lost", "background_gradient_changed", "pseudo_element_missing", "clickable_area_regressed", "network_error", "console_error",
    "status_code_mismatch", "load_error", "accessibility_regression", "accessibility_improved", "url_trailing_slash", "url_redirect_chain", "url_protocol_downgrade", "canonical_mismatch",
    "locale_separator_invalid", "locale_case_invalid", "locale_unknown",
]


def self_check(bundles: DataFrame, options: Options = Options()) -> DataFrame:
    """(pair_id, document, warning) of two captures of the same page, the second with side `old-selfcheck`.

    What differs between them is volatile: the warning counts it by type, without covered targets and pseudo-elements.
    """
    sides = bundles.where(F.col("side").isin("old", "old-selfcheck")).withColumn("side", F.when(F.col("side") == "old", "old").otherwise("new"))
    found = analyze(sides, options).results
    kept = F.filter("kept", lambda i: ~i["type"].isin("clickable_area_regressed", "pseudo_element_missing"))
    message = F.concat(F.lit("self-check: "), F.size(kept).cast("string"), F.lit(" issue(s) appeared when diffing two captures of the old page against each other; treat similar issues in the main result with suspicion (capture volatility, e.g. rotating content)"))
    context = F.concat(F.lit('{"byType":'), issues.histogram(kept, "type"), F.lit(',"issueCount":'), F.size(kept).cast("string"), F.lit("}"))
    told = F.when(F.size(kept) > 0, F.struct(F.lit("volatile_capture").alias("code"), message.alias("message"), context.alias("context")))
    return found.select("pair_id", "document", told.alias("warning"))


def write_self_check(checked: DataFrame, folder: str) -> None:
    """The documents of self_check, one text file a pair below folder/pair_id=..."""
    checked.select("pair_id", F.col("document").alias("value")).repartition("pair_id").write.partitionBy("pair_id").text(folder)


def probe_plan(nodes: DataFrame, pages: DataFrame, most: int = 50) -> DataFrame:
    """(*PAIR, side, url, skipped): the distinct links of each page by URL, those out of scope or above the cap with the reason."""
    from pyspark.sql import Window

    from .functions import urls

    by = [*PAIR, "side"]
    linked = nodes.where("href is not null").select(*by, "href").join(pages.select(*by, F.col("url").alias("page")), by)
    target = urls.redact(urls.without_fragment(urls.resolve(F.col("href"), F.col("page"))))
    each = linked.select(*by, "page", target.alias("url")).where(urls.scheme(F.col("url")).isin("http", "https")).distinct()
    reason = urls.probe_reason(F.col("url"), F.col("page"))
    scoped = each.withColumn("outside", reason.isNotNull())
    place = F.row_number().over(Window.partitionBy(*by, "outside").orderBy("url"))
    return scoped.withColumn("n", place).select(*by, "url", F.when(F.col("outside"), "external-scope").when(F.col("n") > most, "cap-exceeded").alias("skipped"))


def write_results(results: DataFrame, folder: str, what: str = "document") -> None:
    """One text file a pair below folder/pair_id=...: `document` (JSON), `markdown` or `html`."""
    made = {"document": F.col("document"), "markdown": report.full_markdown(), "html": report.html_report()}[what]
    results.select("pair_id", made.alias("value")).repartition("pair_id").write.partitionBy("pair_id").text(folder)


def pretty(document: str) -> str:
    """A result document as indented text with a newline at its end."""
    return json.dumps(json.loads(document), indent=2, ensure_ascii=False) + "\n"


RESULT = (
    "schemaVersion string, toolVersion string, runId string, oldUrl string, newUrl string, parityProfile string, status string, "
    "agentSummary struct<fixableNow:int,byType:map<string,int>,bySeverity:map<string,int>,clusterCount:int,regionCount:int,topFixes:array<string>>, "
    "scores struct<visual:double,content:double,structure:double,style:double,accessibility:double,technical:double,hygiene:double,byLandmark:map<string,map<string,double>>>, "
    "viewports array<struct<name:string,status:string,issues:array<string>>>, "
    "issues array<struct<id:string,type:string,category:string,severity:string,confidence:double,viewport:string,locale:string,goal:string,message:string,locator:struct<anchors:struct<text:string,role:string,href:string,alt:string,ariaLabel:string,nearestHeading:string,landmark:string,ordinalInLandmark:int>,cssSelectorOld:string,cssSelectorNew:string,bboxOld:array<int>,bboxNew:array<int>,seqIndexOld:int,seqIndexNew:int>,evidence:string,remediation:string>>, "
    "clusters array<struct<id:string,issueIds:array<string>,sharedProperty:string,sharedLandmark:string,summary:string>>, "
    "regions array<struct<id:string,landmark:string,saturation:double,structuralCount:int,oldNodeCount:int,memberIssueIds:array<string>,severity:string,summary:string>>, "
    "suppressed struct<count:int,ids:array<string>>, warnings array<struct<code:string,message:string,context:string>>, scopedTo array<string>, outOfScope struct<count:int,ids:array<string>>"
)


def read_results(spark: SparkSession, paths: str | list[str], newest: int = 1) -> DataFrame:
    """Result documents, one row each; a schema version with a newer major number is an error."""
    raw = spark.read.option("wholetext", True).text(paths).select(F.from_json("value", RESULT, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    major = F.get(F.split("schemaVersion", "\\."), F.lit(0)).cast("int")
    good = F.when(major <= newest, True).otherwise(F.raise_error(F.concat(F.lit("a newer schema version than this library reads: "), F.coalesce("schemaVersion", F.lit("none")))).cast("boolean"))
    return raw.where(good)


def show(results: DataFrame, handle: str, value: str, heading: str | None = None) -> DataFrame:
    """(oldUrl, newUrl, issue fields) of a region, section, cluster or issue of result documents (as of read_results)."""
    inside = {"region": lambda i: F.array_contains(F.flatten(F.transform(F.filter("regions", lambda r: r["landmark"] == value), lambda r: r["memberIssueIds"])), i["id"]), "cluster": lambda i: F.array_contains(F.flatten(F.transform(F.filter("clusters", lambda c: c["id"] == value), lambda c: c["issueIds"])), i["id"]), "issue": lambda i: i["id"] == value}
    landmark = lambda i: F.coalesce(i["locator"]["anchors"]["landmark"], F.lit(report.PAGE)) == value
    own = lambda i: F.coalesce(i["locator"]["anchors"]["nearestHeading"], F.lit(report.NONE)) == heading
    if handle == "section":
        rule = (lambda i: landmark(i) & own(i)) if heading is not None else landmark
    elif handle in inside:
        rule = inside[handle]
    else:
        raise ValueError(f"a handle is region, section, cluster or issue, not {handle}")
    return results.select("oldUrl", "newUrl", F.explode(F.filter("issues", rule)).alias("i")).select("oldUrl", "newUrl", "i.*")


def explain(bundles: DataFrame, key: str, value: str, props: list[str] | None = None, slot: str | None = None) -> DataFrame:
    """Styles and box of the elements that a locator finds, side by side; with slot ::before or ::after those of a pseudo-element."""
    from .sources import bundles as b

    if slot is not None:
        return report.explain_pseudo(b.nodes(bundles), b.pseudo(bundles), key, value, slot.removeprefix("::"), props)
    return report.explain(b.nodes(bundles), b.styles(bundles), key, value, props)
