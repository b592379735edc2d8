"""What a reader gets: sections within a budget, a Markdown report, and two elements side by side.

Issues are (*by, id, type, severity, message, landmark, heading, fix_value, ord), where `ord` tells which came first;
`by` names a pair of pages, so lists of its issues and lines stay as small as a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.text import escape_html, markdown_cell, shell_quote
from .assemble import SEVERITIES, severity_rank
from .channels import PAIR, sides

BUDGET, CEILING = 3000, 1500
NONE, PAGE = "—", "(page)"
ABSENT = "<absent>"


def folded(issues: DataFrame, by: list[str]) -> DataFrame:
    """Issues of a section that say the same, as one row: how many, the worst severity, the first place."""
    where = (F.coalesce(c, F.lit(none)).alias(c) for c, none in (("landmark", PAGE), ("heading", NONE)))
    read = issues.select(*by, *where, "type", "message", "severity", "fix_value", "ord")
    return read.groupBy(*by, "landmark", "heading", "type", "message").agg(F.count("*").alias("n"), F.max(severity_rank(F.col("severity"))).alias("rank"), F.max("fix_value").alias("fix_value"), F.min("ord").alias("ord"))


def _severity(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, SEVERITIES)), rank.cast("int"))


def _handle() -> Column:
    heading = F.when(F.col("heading") != NONE, F.concat(F.lit(" --heading "), shell_quote(F.col("heading")))).otherwise("")
    return F.concat(F.lit("show --section "), shell_quote(F.col("landmark")), heading)


def outline(issues: DataFrame, claimed: DataFrame, by: list[str], budget: int = BUDGET, ceiling: int = CEILING) -> DataFrame:
    """Sections of the issues that are neither critical nor claimed (*by, id) by a region or cluster.

    In order of worth a section is shown in full while the sum of the sizes stays in the budget; after the first that
    does not fit, none is. A section above the ceiling is never shown in full and takes nothing from the budget.
    """
    open_ = issues.where("severity <> 'critical'").join(claimed.select(*by, "id"), [*by, "id"], "left_anti")
    line = F.concat(F.lit("- ["), _severity(F.col("rank")), F.lit("] "), markdown_cell(F.col("type")), F.lit(" ×"), F.col("n").cast("string"), F.lit(f" {NONE} "), markdown_cell(F.col("message")), F.lit("\n"))
    lines = F.array_sort(F.collect_list(F.struct("ord", "type", "message", line.alias("line"))))
    found = folded(open_, by).groupBy(*by, "landmark", "heading").agg(F.sum("n").alias("n"), F.max("rank").alias("rank"), F.max("fix_value").alias("fix_value"), F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("lines"))
    head = F.concat(F.lit("### "), markdown_cell(F.col("landmark")), F.lit(" › "), markdown_cell(F.col("heading")), F.lit(" ("), F.col("n").cast("string"), F.when(F.col("n") == 1, " issue").otherwise(" issues"), F.lit(f") {NONE} "), _handle(), F.lit("\n"))
    sized = found.withColumn("head", head).withColumn("size", F.octet_length("head") + F.octet_length("lines")).withColumn("forced", F.col("size") > ceiling)
    order = Window.partitionBy(*by).orderBy(F.desc("fix_value"), "landmark", "heading")
    spent = F.sum(F.when(F.col("forced"), 0).otherwise(F.col("size"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return sized.select(*by, F.row_number().over(order).alias("place"), "landmark", "heading", "n", _severity(F.col("rank")).alias("severity"), "fix_value", "size", (F.col("forced") | (spent > budget)).alias("collapsed"), "head", "lines")


def markdown(issues: DataFrame, claimed: DataFrame, regions: DataFrame, by: list[str], budget: int = BUDGET, ceiling: int = CEILING) -> DataFrame:
    """(*by, report): critical issues, regions (*by, landmark, severity, members, saturation), sections shown in full, pointers to the others.

    Pages with neither issues nor regions have no row.
    """
    row = lambda part, at, line: (*by, F.lit(part).alias("part"), at.alias("at"), line.alias("line"))
    join = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    cell = lambda c: markdown_cell(F.col(c))
    critical = issues.where("severity = 'critical'").select(*row(1, F.col("id"), join("- [critical] ", cell("type"), " — ", cell("message"), " — drill: show --issue ", F.col("id"), "\n")))
    area = join("- [", F.col("severity"), "] ", cell("landmark"), " — ", F.size("members").cast("string"), " issues, saturation ", F.format_string("%.2f", "saturation"), " — drill: show --region ", shell_quote(F.col("landmark")), "\n")
    saturated = regions.select(*row(2, F.col("landmark"), area))
    pointer = join("- [", F.col("severity"), "] ", cell("landmark"), " › ", cell("heading"), " — ", F.col("n").cast("string"), " issues — drill: ", _handle(), "\n")
    at = join(F.col("collapsed").cast("string"), F.lpad(F.col("place").cast("string"), 9, "0"))
    sections = outline(issues, claimed, by, budget, ceiling).select(*row(3, at, F.when(F.col("collapsed"), pointer).otherwise(F.concat("head", "lines"))))
    every = critical.unionByName(saturated).unionByName(sections)
    found = every.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("part", "at", "line"))).alias("parts"))
    said = lambda n: F.array_join(F.transform(F.filter("parts", lambda x: x["part"] == n), lambda x: x["line"]), "")
    titled = lambda n, title: F.when(said(n) != "", join(f"## {title}\n\n", said(n), "\n")).otherwise("")
    return found.select(*by, join(titled(1, "Critical defects"), titled(2, "Regions"), "## Issues (table of contents)\n\n", said(3)).alias("report"))


def show(issues: DataFrame, by: list[str], *, section: str | None = None, heading: str | None = None, issue: str | None = None, members: DataFrame | None = None) -> DataFrame:
    """The issues of a handle: a section (of any heading, if none is given), an issue, or members (*by, id) of a region or cluster."""
    if members is not None:
        return issues.join(members.select(*by, "id"), [*by, "id"], "left_semi")
    if issue is not None:
        return issues.where(F.col("id") == issue)
    found = issues.where(F.coalesce("landmark", F.lit(PAGE)) == section)
    return found if heading is None else found.where(F.coalesce("heading", F.lit(NONE)) == heading)


def located(nodes: DataFrame, key: str, value: str) -> DataFrame:
    """The first node (by position, then id) of each page and side that a locator finds.

    id: equal; selector, text, role, href, nearestHeading: contained, in the node or its anchors.
    """
    has = lambda *columns: F.coalesce(*(F.when(F.contains(F.col(c), F.lit(value)), True) for c in columns), F.lit(False))
    match = {
        "id": F.col("id") == value,
        "selector": has("cssSelector"),
        "text": has("anchors.text", "text"),
        "role": has("anchors.role", "role"),
        "href": has("anchors.href", "href"),
        "nearestHeading": has("anchors.nearestHeading"),
    }
    if key not in match:
        raise ValueError(f"a locator is one of {', '.join(match)}, not {key}")
    found = nodes.where(match[key]).groupBy(*PAIR, "side").agg(F.min_by(F.struct("id", "bbox"), F.struct("seqIndex", "id")).alias("x"))
    return found.select(*PAIR, "side", "x.*")


def explain(nodes: DataFrame, styles: DataFrame, key: str, value: str, props: list[str] | None = None) -> DataFrame:
    """Styles and box of the located elements, side by side: those that differ, or `props` whether or not they do."""
    found = located(nodes, key, value)
    boxes = found.select(*PAIR, "side", F.explode(F.array(*(F.struct(F.lit(f"bbox.{c}").alias("prop"), F.col(f"bbox.{c}").cast("string").alias("value")) for c in "xywh"))).alias("x")).select(*PAIR, "side", "x.*").where("value is not null")
    own = styles.join(found.select(*PAIR, "side", F.col("id").alias("element_id")), [*PAIR, "side", "element_id"], "left_semi").select(*PAIR, "side", "prop", "value")
    every = own.unionByName(boxes)
    old, new = (sides(every, s, {"prop": "prop", "value": f"{s}_value"}) for s in ("old", "new"))
    rows = old.join(new, [*PAIR, "prop"], "full_outer")
    if props is not None:
        asked = found.select(*PAIR).distinct().withColumn("prop", F.explode(F.array(*(F.lit(p) for p in sorted(props)))))
        rows = asked.join(rows, [*PAIR, "prop"], "left")
    rows = rows.fillna(ABSENT, ["old_value", "new_value"]).withColumn("changed", F.col("old_value") != F.col("new_value"))
    return rows if props is not None else rows.where("changed")


# Reports of results (rows of issues.results)


def _sections(kept: Column) -> Column:
    """(landmark, heading, members) of the issues that are sure and unclaimed, the largest section first."""
    key = lambda i: F.struct(F.coalesce(i["landmark"], F.lit(PAGE)).alias("landmark"), F.coalesce(i["heading"], F.lit(NONE)).alias("heading"))
    keys = F.array_distinct(F.transform(kept, key))
    each = F.transform(keys, lambda k: let(F.filter(kept, lambda i: key(i) == k), lambda own: F.struct((-F.size(own)).alias("minus"), k["landmark"].alias("landmark"), k["heading"].alias("heading"), F.transform(own, lambda i: F.struct(i["severity"].alias("severity"), i["type"].alias("type"), i["message"].alias("message"), i["id"].alias("id"))).alias("members"))))
    return F.array_sort(each)


def _open() -> Column:
    members = F.flatten(F.concat(F.transform("regions", lambda r: r["memberIssueIds"]), F.transform("clusters", lambda c: c["issueIds"])))
    return F.filter("kept", lambda i: ~i["uncertain"] & ~F.array_contains(members, i["id"]))


def _joined(items: Column) -> Column:
    return F.array_join(items, "")


def _two(c: Column) -> Column:
    return F.format_string("%.2f", c)


CATEGORIES = ["visual", "content", "structure", "style", "accessibility", "technical", "hygiene"]


def full_markdown(profile: str = "") -> Column:
    """The whole result of a pair in Markdown: summary, scores, regions, clusters, and all issues by section."""
    c, cat, md = F.col, lambda *parts: F.concat(*(F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts)), markdown_cell
    bullets = lambda title, items: F.when(F.size(items) > 0, cat(f"## {title}\n\n", _joined(items), "\n")).otherwise("")
    warnings = F.transform("warnings", lambda w: cat("> ⚠ **", md(w["code"]), "**: ", md(w["message"]), "\n"))
    open_, doubtful = _open(), F.filter("kept", lambda i: i["uncertain"])
    table = F.transform(_sections(open_), lambda s: cat("| ", md(s["landmark"]), " | ", md(s["heading"]), " | ", F.size(s["members"]), " |\n"))
    by_section = F.when(F.size(open_) > 0, cat("\n**By section:**\n\n| Landmark | Section (nearest heading) | Issues |\n|---|---|---|\n", _joined(table))).otherwise("")
    score_rows = cat(*(part for name in CATEGORIES for part in (f"| {name} | ", _two(c(f"scores.{name}")), " |\n")))
    landmark_rows = F.transform("scores.by_landmark", lambda s: cat("| ", md(s["landmark"]), *(x for name in CATEGORIES[1:] for x in (" | ", _two(s[name]))), " |\n"))
    regions = F.transform("regions", lambda r: cat("- ", md(r["summary"]), " — saturation ", _two(r["saturation"]), ", severity ", r["severity"], ", members: ", F.size(r["memberIssueIds"]), "\n"))
    clusters = F.transform("clusters", lambda x: cat("- ", md(x["summary"]), " (", x["id"], ")\n"))
    line = lambda i: cat("- [", i["severity"], "] ", md(i["type"]), " — ", md(i["message"]), " (", i["id"], ")\n")
    sections = F.transform(_sections(open_), lambda s: cat("### ", md(s["landmark"]), " › ", md(s["heading"]), "\n\n", _joined(F.transform(s["members"], line)), "\n"))
    head = cat("# Page parity report\n\n- **Status:** ", c("status"), "\n- **Old URL:** ", md(c("old_url")), "\n- **New URL:** ", md(c("new_url")), f"\n- **Profile:** {profile}\n\n" if profile else "\n\n")
    summary = cat("## Summary\n\n- **Fixable now:** ", c("fixable"), "\n- **Cluster count:** ", F.size("clusters"), "\n- **Region count:** ", F.size("regions"), "\n- **Top fixes:** ", F.array_join("top_fixes", ", "), "\n", by_section, "\n")
    scores = cat("## Scores\n\n| Category | Score |\n|---|---|\n", score_rows, "\n", F.when(F.size("scores.by_landmark") > 0, cat("**By landmark:**\n\n| Landmark | Content | Structure | Style | A11y | Technical | Hygiene |\n|---|---|---|---|---|---|---|\n", _joined(landmark_rows), "\n")).otherwise(""))
    return cat(head, bullets("Warnings", warnings), summary, scores, bullets("Regions", regions), bullets("Clusters", clusters), "## Issues by section\n\n", _joined(sections), bullets("Uncertain pairings", F.transform(doubtful, line)))


POLICY = "default-src 'none'; img-src 'self' data:; style-src 'unsafe-inline'; base-uri 'none'; form-action 'none'"
STYLE = "<style>body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2em .6em}.fail{color:#b00}.warn{color:#a60}.pass{color:#070}</style>"


def html_report(profile: str = "") -> Column:
    """The result of a pair as one static page: no script, a policy that loads nothing, and every text escaped."""
    c, e = F.col, lambda x: escape_html(F.coalesce(x.cast("string"), F.lit("")))
    cat = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    items = lambda title, xs: F.when(F.size(xs) > 0, cat(f"<section><h2>{title}</h2><ul>\n", _joined(xs), "</ul></section>\n")).otherwise("")
    li = lambda *parts: cat("<li>", *parts, "</li>\n")
    issue = lambda i: li("<code>", e(i["id"]), "</code> [", e(i["severity"]), "] ", e(i["type"]), ": ", e(i["message"]))
    sections = F.transform(_sections(_open()), lambda s: cat("<section><h3>", e(s["landmark"]), " › ", e(s["heading"]), "</h3><ul>\n", _joined(F.transform(s["members"], issue)), "</ul></section>\n"))
    rows = cat(*(part for name in CATEGORIES for part in (f"<tr><td>{name}</td><td>", _two(c(f"scores.{name}")), "</td></tr>\n")))
    meta = lambda label, value: cat(f"<dt>{label}</dt><dd>", e(value), "</dd>\n")
    return cat(
        f'<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<meta http-equiv="Content-Security-Policy" content="{POLICY}">\n<title>', e(c("old_url")), " → ", e(c("new_url")), f"</title>\n{STYLE}\n</head>\n<body>\n",
        '<h1>Page parity report <span class="', c("status"), '">', F.upper(c("status")), "</span></h1>\n<dl>\n", meta("Old URL", c("old_url")), meta("New URL", c("new_url")), meta("Profile", F.lit(profile)), meta("Fixable now", c("fixable")), meta("Clusters", F.size("clusters")), meta("Regions", F.size("regions")), "</dl>\n",
        items("Warnings", F.transform("warnings", lambda w: li("⚠ ", e(w["code"]), ": ", e(w["message"])))), items("Top fixes", F.transform("top_fixes", lambda x: li("<code>", e(x), "</code>"))),
        "<section><h2>Scores</h2><table>\n", rows, "</table></section>\n", items("Regions", F.transform("regions", lambda r: li(e(r["summary"])))), items("Clusters", F.transform("clusters", lambda x: li(e(x["summary"])))),
        items("Critical", F.transform(F.filter("kept", lambda i: i["severity"] == "critical"), issue)), "<h2>Issues by section</h2>\n", _joined(sections), "</body>\n</html>\n",
    )


def pseudo_owner(entries: DataFrame, nodes: DataFrame, key: str, value: str) -> DataFrame:
    """The owner of pseudo-elements that a locator means: the exact key, the exact selector, or a node that is found; in this order."""
    by_key = entries.where(F.col("owner_key") == value).select(*PAIR, "side", F.lit(0).alias("at"), "owner_key")
    by_selector = entries.where(F.col("selector") == value).select(*PAIR, "side", F.lit(1).alias("at"), "owner_key")
    found = located(nodes, key, value).select(*PAIR, "side", F.col("id").alias("node_id"))
    by_node = entries.join(found, [*PAIR, "side", "node_id"], "left_semi").select(*PAIR, "side", F.lit(2).alias("at"), "owner_key")
    every = by_key.unionByName(by_selector).unionByName(by_node)
    return every.groupBy(*PAIR, "side").agg(F.min(F.struct("at", "owner_key"))["owner_key"].alias("owner_key"))


def explain_pseudo(nodes: DataFrame, entries: DataFrame, key: str, value: str, slot: str, props: list[str] | None = None) -> DataFrame:
    """Styles of ::before or ::after of the located owner, side by side."""
    owner = pseudo_owner(entries, nodes, key, value)
    own = entries.join(owner, [*PAIR, "side", "owner_key"], "left_semi").select(*PAIR, "side", F.explode(slot).alias("prop", "value"))
    old, new = (sides(own, s, {"prop": "prop", "value": f"{s}_value"}) for s in ("old", "new"))
    rows = old.join(new, [*PAIR, "prop"], "full_outer").fillna(ABSENT, ["old_value", "new_value"])
    rows = rows.withColumn("changed", F.col("old_value") != F.col("new_value"))
    return rows.where(F.col("prop").isin(*props)) if props is not None else rows.where("changed")


def explain_hits(nodes: DataFrame, points: DataFrame, key: str, value: str) -> DataFrame:
    """Hit tests of the located elements: counted together where both sides were sampled, else each side by itself.

    (pair_id, viewport, together, denominator, old_hits, new_hits): with `together` false, a side counts its own points.
    """
    found = located(nodes, key, value).select(*PAIR, "side", F.col("id").alias("node_id"))
    own = points.where("status = 'sampled'").join(found, [*PAIR, "side", "node_id"], "left_semi")
    old, new = (sides(own, s, {"idx": "idx", "o": f"{s}_o"}) for s in ("old", "new"))
    both = old.join(new, [*PAIR, "idx"], "full_outer")
    seen = lambda s: F.max(F.col(f"{s}_o").isNotNull())
    counted = lambda s: (F.col(f"{s}_o") != "excluded") & F.coalesce(F.col(f"{'new' if s == 'old' else 'old'}_o") != "excluded", F.lit(True))
    tally = both.groupBy(*PAIR).agg((seen("old") & seen("new")).alias("together"), F.count_if(F.coalesce(counted("old"), counted("new"))).alias("denominator"), F.count_if(counted("old") & (F.col("old_o") == "hit")).alias("old_hits"), F.count_if(counted("new") & (F.col("new_o") == "hit")).alias("new_hits"))
    return tally


def explain_text(rows: DataFrame, by: list[str] = PAIR) -> DataFrame:
    """(*by, text): the property rows of explain as an aligned table, one text a page."""
    width = lambda c: F.array_max(F.transform("rows", lambda r: F.length(r[c])))
    listed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("prop", "old_value", "new_value"))).alias("rows"))
    line = F.array_join(F.transform("rows", lambda r: F.concat(F.rpad(r["prop"], F.col("w"), F.lit(" ")), F.lit("  "), r["old_value"], F.lit(" -> "), r["new_value"])), "\n")
    return listed.withColumn("w", width("prop")).select(*by, line.alias("text"))
