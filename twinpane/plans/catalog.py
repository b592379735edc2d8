"""The queries of the library over the driver's tables, most with DuckDB SQL that gives the same rows.

A query is named after the operators it shows; all read whole tables. Page pairs are scanned, matched and analysed once
in a session, as tables in the shared folder (plans.store); the queries on them read these.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import analyze
from ..functions import css, locales, text, urls
from ..operators import assemble, findings, issues, matching, pairing, report, sequence
from . import pairs

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, sides: bool = False) -> Callable[[Query], Query]:
    """Registers a query; sides: its SQL reads the CTEs of page pairs."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = (pairs.SQL if sides else "") + sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _sides(spark: SparkSession, sf_dir: str, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    old, new = pairs.nodes(spark, sf_dir)
    return of(old).select(F.lit("old").alias("side"), "*").unionByName(of(new).select(F.lit("new").alias("side"), "*"))


# Issues


@query("SELECT page_id, type, severity, confidence, text, landmark, id, fix_value FROM issues WHERE type = 'missing_link'", sides=True)
def slice_missing_link_issues(spark, sf_dir):
    """Links of the old pages that are missing from the new ones, as issues."""
    found = pairs.found(spark, sf_dir).where("type = 'missing_link'")
    return found.select("page_id", "type", "severity", "confidence", F.col("anchors.text").alias("text"), "landmark", "id", "fix_value")


@query("SELECT page_id, type, category, severity, confidence, message, id FROM issues", sides=True)
def u01_u03_w08_all_issues(spark, sf_dir):
    """All issues of all detectors after the short circuit, with collision suffixes."""
    return pairs.found(spark, sf_dir).select("page_id", "type", "category", "severity", "confidence", "message", "id")


def _detector(name: str, types: list[str]) -> None:
    """A query of the issues of some types, with their messages."""
    listed = ", ".join(f"'{x}'" for x in types)

    def of(spark, sf_dir):
        return pairs.found(spark, sf_dir).where(F.col("type").isin(*types)).select("page_id", "type", "severity", "confidence", "message", "id", "fix_value")

    of.__name__ = name
    query(f"SELECT page_id, type, severity, confidence, message, id, fix_value FROM issues WHERE type IN ({listed})", sides=True)(of)


_detector("d_page_facts", ["missing_title", "changed_title", "missing_h1"])
_detector("d_changed_h1", ["changed_h1", "changed_text"])
_detector("d_heading_structure", ["heading_structure_changed"])
_detector("d_changed_link_target", ["changed_link_target"])
_detector("d_missing_text", ["missing_text"])
_detector("d_broken_link_j13_j14", ["broken_link"])
_detector("d_component_swapped_a18", ["component_swapped"])
_detector("d_style_changed_j07", ["style_changed"])
_detector("d_clickable_area_j19_a12", ["clickable_area_regressed"])
_detector("d_pseudo_element_missing_j20", ["pseudo_element_missing"])
_detector("d_network_error_j15_j16_j17_p05", ["network_error"])
_detector("d_console_error_p06", ["console_error"])
_detector("d_accessibility_j25_u04_j18", ["accessibility_regression", "accessibility_improved"])
_detector("d_status_code_j10", ["status_code_mismatch"])
_detector("d_trailing_slash_f35_j12", ["url_trailing_slash"])
_detector("d_redirect_chain", ["url_redirect_chain"])
_detector("d_protocol_downgrade_j11", ["url_protocol_downgrade"])
_detector("d_canonical_mismatch_f34", ["canonical_mismatch"])
_detector("d_locale_f37", ["locale_separator_invalid", "locale_case_invalid", "locale_unknown"])
_detector("d_page_height_changed", ["page_height_changed"])


_ACTIONS = {
    "restore_content": ("missing_link", "missing_h1", "missing_text"), "restore_text": ("missing_title", "changed_title", "changed_h1", "changed_text"), "restore_heading_level": ("heading_structure_changed",),
    "update_link_target": ("changed_link_target", "url_redirect_chain"), "fix_broken_link": ("broken_link",), "reorder_components": ("component_swapped",), "restore_css_property": ("style_changed",),
    "restore_pseudo_element": ("pseudo_element_missing",), "restore_clickable_area": ("clickable_area_regressed",), "restore_asset": ("network_error",), "investigate_console_error": ("console_error",),
    "fix_accessibility_violation": ("accessibility_regression",), "fix_route": ("status_code_mismatch",), "rewrite_url": ("url_trailing_slash", "url_protocol_downgrade", "locale_separator_invalid", "locale_case_invalid"), "update_canonical": ("canonical_mismatch",),
}


@query("SELECT page_id, type, id, CASE " + " ".join(f"WHEN type IN ({', '.join(map(repr, types))}) THEN '{action}'" for action, types in _ACTIONS.items()) + " END AS action FROM issues", sides=True)
def r_remediation_actions(spark, sf_dir):
    """What to do about each issue; null where nothing can be told."""
    return pairs.found(spark, sf_dir).select("page_id", "type", "id", F.get_json_object("remediation", "$.action").alias("action"))


@query(
    "SELECT i.page_id, type, id, CASE type WHEN 'missing_link' THEN coalesce(text, '') ELSE o_text END AS was, CASE type WHEN 'changed_h1' THEN n_text END AS now FROM issues i LEFT JOIN (SELECT page_id, coalesce(o_text, '') AS o_text, coalesce(n_text, '') AS n_text FROM pairs WHERE block = 'heading' AND o_text IS DISTINCT FROM n_text) p USING (page_id) WHERE type IN ('missing_link', 'changed_h1')",
    sides=True,
)
def r_evidence_texts(spark, sf_dir):
    """The texts that evidence carries for missing links and changed headings."""
    get = lambda path: F.get_json_object("evidence", path)
    return pairs.found(spark, sf_dir).where("type in ('missing_link', 'changed_h1')").select("page_id", "type", "id", get("$.old.text").alias("was"), get("$.new.text").alias("now"))


_STRICT = issues.Options(profile="strict-visual", types={"missing_link": "warning", "status_code_mismatch": "info"}, properties={"letter-spacing": "error"})


@query(
    "SELECT page_id, id, CASE WHEN type = 'missing_link' THEN 'warning' WHEN type = 'status_code_mismatch' THEN 'critical' WHEN type = 'console_error' THEN 'warning' WHEN type = 'accessibility_improved' THEN 'info' WHEN type = 'accessibility_regression' THEN 'warning' ELSE 'error' END AS severity FROM issues",
    sides=True,
)
def f54_severity_resolution(spark, sf_dir):
    """Severities under the strict profile with a user's map, which can't demote what is always critical."""
    prop = F.when(F.col("type") != "pseudo_element_missing", F.regexp_replace("prop", "^::[a-z]+\\.", ""))
    return pairs.found(spark, sf_dir).select("page_id", "id", issues.severity(F.col("type"), F.col("category"), prop, _STRICT).alias("severity"))


# Pages


@query(
    "SELECT 'old' AS side, page_id, kind, role, seq, text, text AS name, href, raw_href, level, landmark, nullif(heading, '') AS heading FROM old_nodes UNION ALL SELECT 'new', page_id, kind, role, seq, text, text, href, raw_href, level, landmark, nullif(heading, '') FROM new_nodes",
    sides=True,
)
def s06_e01_e04_e05_e08_page_nodes(spark, sf_dir):
    """Nodes of all pages: kind, role, text, accessible name, references, level, landmark and nearest heading."""
    of = lambda n: n.select("page_id", "kind", "role", F.col("seqIndex").alias("seq"), "text", F.col("accName").alias("name"), "href", F.col("rawHref").alias("raw_href"), F.col("headingLevel").alias("level"), "landmark", "heading")
    return _sides(spark, sf_dir, of)


_SELECTORS = r"""
, counted AS (SELECT *, count(*) FILTER (starts_with(part, '<p')) OVER w AS p, count(*) FILTER (starts_with(part, '<a')) OVER w AS a FROM old_tagged WINDOW w AS (PARTITION BY page_id ORDER BY i))
SELECT n.page_id, n.seq, CASE WHEN n.kind = 'link' THEN 'ul:nth-of-type(1) > li:nth-of-type(' || a || ') > a:nth-of-type(1)' WHEN n.kind = 'heading' THEN 'article:nth-of-type(1) > h1:nth-of-type(1)'
  WHEN starts_with(n.part, '<p') THEN 'article:nth-of-type(1) > p:nth-of-type(' || p || ')' || CASE WHEN starts_with(n.part, '<p><b>') THEN ' > b:nth-of-type(1)' ELSE '' END WHEN starts_with(n.part, '<div') THEN 'div:nth-of-type(1)' ELSE 'footer:nth-of-type(1)' END AS selector
FROM old_nodes n JOIN counted c ON n.page_id = c.page_id AND n.i = c.i
"""


@query(_SELECTORS, sides=True)
def e07_selectors(spark, sf_dir):
    return pairs.nodes(spark, sf_dir)[0].select("page_id", F.col("seqIndex").alias("seq"), F.col("cssSelector").alias("selector"))


@query("SELECT page_id, seq, CAST(row_number() OVER (PARTITION BY page_id, landmark, kind, text ORDER BY seq) AS INT) AS ordinal FROM old_nodes WHERE landmark IS NOT NULL", sides=True)
def e06_ordinal_in_landmark(spark, sf_dir):
    return pairs.nodes(spark, sf_dir)[0].where("landmark is not null").select("page_id", F.col("seqIndex").alias("seq"), F.col("anchors.ordinalInLandmark").alias("ordinal"))


@query(
    "SELECT page_id, concat_ws(',', CASE WHEN contains(html, '<footer') THEN 'contentinfo' END, CASE WHEN contains(html, '<nav') THEN 'navigation' END) AS landmarks, CAST(len(regexp_extract_all(html, '<h[123]>')) AS INT) AS headings, CAST(len(regexp_extract_all(html, '<(nav|footer)>')) AS INT) AS places FROM new_pages",
    sides=True,
)
def e09_e14_landmark_set_and_inventory(spark, sf_dir):
    return pairs.scans(spark, sf_dir, "new").select("page_id", F.array_join("page.landmarks", ",").alias("landmarks"), F.col("inventory.headingCount").alias("headings"), F.col("inventory.landmarkCount").alias("places"))


@query("SELECT page_id, 'navigation' AS path, 'navigation' AS role FROM new_pages WHERE contains(html, '<nav>') UNION ALL SELECT page_id, 'contentinfo', 'contentinfo' FROM new_pages WHERE contains(html, '<footer>')", sides=True)
def e10_w10_landmark_paths(spark, sf_dir):
    return pairs.scans(spark, sf_dir, "new").select("page_id", F.explode("page.landmarkRects").alias("r")).select("page_id", "r.path", "r.role")


_ANCESTORS = r"""
, links AS (SELECT page_id, count(text) AS k, any_value(text) AS t FROM old_nodes WHERE kind = 'link' GROUP BY page_id),
inside AS (SELECT page_id, count(text) AS k, any_value(text) AS t, any_value(CASE WHEN kind = 'heading' THEN text END) AS h FROM old_nodes WHERE kind = 'heading' OR starts_with(part, '<p') GROUP BY page_id)
SELECT page_id, 'li' AS tag, text, NULL AS heading, 'navigation' AS landmark FROM old_nodes WHERE kind = 'link'
UNION ALL SELECT page_id, tag, CASE WHEN k = 1 THEN t END, NULL, 'navigation' FROM links, (VALUES ('ul'), ('nav')) v(tag)
UNION ALL SELECT page_id, 'article', CASE WHEN k = 1 THEN t END, h, NULL FROM inside
UNION ALL SELECT n.page_id, 'p', n.text, nullif(n.heading, ''), NULL FROM old_nodes n WHERE starts_with(part, '<p><b>')
"""


@query(_ANCESTORS, sides=True)
def e11_e12_ancestor_anchors(spark, sf_dir):
    """Elements above the nodes: the text of one that holds a single text, and the heading inside or before it."""
    return pairs.scans(spark, sf_dir, "old").select("page_id", F.explode("styleCandidates.ancestors").alias("a")).select("page_id", "a.tag", "a.anchors.text", F.col("a.anchors.nearestHeading").alias("heading"), "a.anchors.landmark")


@query("SELECT * FROM new_meta", sides=True)
def s07_page_metadata(spark, sf_dir):
    return pairs.meta(spark, sf_dir)[1]


@query(
    "SELECT CAST(page_id AS VARCHAR) AS pair_id, url, CASE WHEN n > 50 THEN 'cap-exceeded' END AS skipped FROM (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY url) AS n FROM (SELECT DISTINCT page_id, regexp_replace(href, '#.*$', '') AS url FROM old_nodes WHERE kind = 'link'))",
    sides=True,
)
def s11_o11_p18_probe_plan(spark, sf_dir):
    """Links of a page to be probed: distinct, within its site, the first fifty by URL."""
    key = [F.col("page_id").cast("string").alias("pair_id"), F.lit("desktop").alias("viewport"), F.lit("old").alias("side")]
    return analyze.probe_plan(pairs.nodes(spark, sf_dir)[0].select(*key, "href"), pairs.old_pages(spark, sf_dir).select(*key, "url")).select("pair_id", "url", "skipped")


# Matching


@query("SELECT page_id, seq, block, key FROM old_keyed", sides=True)
def p01_p02_block_and_exact_key(spark, sf_dir):
    n = pairs.nodes(spark, sf_dir)[0]
    fields = [f for f in n.columns if f not in ("page_id", "landmark", "heading")]
    return n.select("page_id", F.col("seqIndex").alias("seq"), pairing.node_key(F.struct(*fields)).alias("k")).select("page_id", "seq", "k.*")


def _pairs(spark, sf_dir):
    rows = pairs.rows(spark, sf_dir).select(F.col("pair_id").cast("long").alias("page_id"), "o_nodes", "n_nodes", F.explode("pairs").alias("p"))
    return rows.select("page_id", F.get("o_nodes", F.col("p.o")).alias("o"), F.get("n_nodes", F.col("p.n")).alias("n"), "p.stage", "p.band", "p.score", "p.signals")


@query("SELECT page_id, o_seq, n_seq FROM equal_keys WHERE stage = 'identity'", sides=True)
def j01_unique_key_match(spark, sf_dir):
    return _pairs(spark, sf_dir).where("signals like '%exactKey%'").select("page_id", F.col("o.seqIndex").alias("o_seq"), F.col("n.seqIndex").alias("n_seq"))


@query("SELECT page_id, block, o_text, n_text, o_raw, n_raw, stage, band, round(score, 6) AS score FROM pairs p WHERE EXISTS (FROM near x WHERE x.page_id = p.page_id AND x.o_seq = p.o_seq)", sides=True)
def j02_j03_j04_f12_f13_near_pairs(spark, sf_dir):
    """Pairs of nodes whose keys differ: by identity scores, mutual best and the assignment of what is left."""
    found = _pairs(spark, sf_dir).where("signals not like '%exactKey%'")
    changed = ~(F.col("o.text").eqNullSafe(F.col("n.text")) & F.col("o.rawHref").eqNullSafe(F.col("n.rawHref")) & F.col("o.headingLevel").eqNullSafe(F.col("n.headingLevel")))
    return found.where(changed).select(
        "page_id", matching.block(F.col("o.kind")).alias("block"), F.col("o.text").alias("o_text"), F.col("n.text").alias("n_text"), F.col("o.rawHref").alias("o_raw"), F.col("n.rawHref").alias("n_raw"), "stage", "band", F.round("score", 6).alias("score")
    )


@query("SELECT page_id, block, count(*) AS n, count(*) FILTER (band = 'uncertain') AS unsure FROM pairs GROUP BY ALL", sides=True)
def j04_pairs_by_block(spark, sf_dir):
    """How many nodes of each block are paired, and how many of them are in doubt."""
    return _pairs(spark, sf_dir).groupBy("page_id", matching.block(F.col("o.kind")).alias("block")).agg(F.count("*").alias("n"), F.count_if(F.col("band") == "uncertain").alias("unsure"))


def _left(spark, sf_dir, column, nodes):
    rows = pairs.rows(spark, sf_dir).select(F.col("pair_id").cast("long").alias("page_id"), nodes, F.explode(column).alias("m"))
    return rows.select("page_id", F.get(nodes, F.col("m.i")).alias("x")).select("page_id", "x.kind", "x.text", F.col("x.rawHref").alias("raw_href"), F.col("x.headingLevel").alias("level"))


@query("SELECT page_id, kind, text, raw_href, level FROM missing", sides=True)
def j05_missing_old(spark, sf_dir):
    return _left(spark, sf_dir, "missing", "o_nodes")


@query("SELECT page_id, kind, text, raw_href, level FROM added", sides=True)
def j06_added_new(spark, sf_dir):
    return _left(spark, sf_dir, "added", "n_nodes")


@query(
    "SELECT page_id, 'navigation' AS path, 50 AS old_height, 170 AS new_height FROM new_pages WHERE page_id % 59 = 1 AND contains(html, '<nav>') UNION ALL SELECT o.page_id, 'contentinfo', 50, 0 FROM old_pages o JOIN new_pages n USING (page_id) WHERE contains(o.html, '<footer>') AND NOT contains(n.html, '<footer>')",
    sides=True,
)
def j22_o05_section_deltas(spark, sf_dir):
    """Sections of a page whose heights differ, the eight largest."""
    rows = pairs.rows(spark, sf_dir).select(F.col("pair_id").cast("long").alias("page_id"), F.explode(findings.section_deltas()).alias("d"))
    return rows.select("page_id", "d.path", F.col("d.oldHeight").alias("old_height"), F.col("d.newHeight").alias("new_height"))


@query("SELECT l_orderkey, l_linenumber, o.l_quantity AS old_quantity, n.l_quantity AS new_quantity FROM (SELECT * FROM lineitem WHERE l_linenumber <> 7) o FULL JOIN (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM lineitem WHERE l_linenumber <> 1) n USING (l_orderkey, l_linenumber) WHERE o.l_quantity IS DISTINCT FROM n.l_quantity")
def j24_side_by_side(spark, sf_dir):
    """Property rows of two sides, full outer, only those that differ."""
    li = pairs.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    old = li.where("l_linenumber <> 7").withColumnRenamed("l_quantity", "old_quantity")
    new = li.where("l_linenumber <> 1").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 5 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).alias("new_quantity"))
    return old.join(new, ["l_orderkey", "l_linenumber"], "full_outer").where(~F.col("old_quantity").eqNullSafe(F.col("new_quantity")))


# Results


@query("SELECT page_id, id FROM issues WHERE id NOT IN (SELECT id FROM issues WHERE page_id % 3 = 0)", sides=True)
def j23_baseline_kept(spark, sf_dir):
    found = pairs.found(spark, sf_dir)
    return assemble.baseline_split(found, found.where("page_id % 3 = 0").select("id"))[0].select("page_id", "id")


@query("SELECT page_id, coalesce(landmark, '(none)') AS landmark, count(*) AS nodes FROM old_nodes GROUP BY ALL", sides=True)
def a01_landmark_node_counts(spark, sf_dir):
    return assemble.landmark_counts(pairs.nodes(spark, sf_dir)[0], ["page_id"])


_SCORE = "1.0 / (1 + count(*) FILTER (category = '{0}' AND severity <> 'info')) AS {0}"
_SCORES = "{}, {}, {}, CASE WHEN count(*) FILTER (type = 'status_code_mismatch') > 0 THEN 0.0 ELSE 1.0 / (1 + count(*) FILTER (category = 'technical' AND severity <> 'info')) END::DOUBLE AS technical, {}".format(*(_SCORE.format(c).replace(" AS", "::DOUBLE AS").replace("1.0 / (", "(1.0 / (").replace("::DOUBLE", ")::DOUBLE") for c in ("content", "structure", "style", "hygiene")))


@query(f"SELECT page_id, {_SCORES} FROM issues GROUP BY page_id", sides=True)
def a02_category_scores(spark, sf_dir):
    return assemble.category_scores(pairs.found(spark, sf_dir), ["page_id"])


@query(f"SELECT coalesce(landmark, '(none)') AS landmark, {_SCORES} FROM issues GROUP BY 1", sides=True)
def a03_landmark_scores(spark, sf_dir):
    return assemble.category_scores(pairs.found(spark, sf_dir).withColumn("landmark", F.coalesce("landmark", F.lit("(none)"))), ["landmark"])


_REGIONS = r"""
, sited AS (SELECT regexp_extract(p.url, '^[a-z]+://([^/?#]*)', 1) AS site, p.page_id FROM old_pages p),
counts AS (SELECT site, coalesce(landmark, '(none)') AS landmark, count(*) AS nodes FROM old_nodes JOIN sited USING (page_id) GROUP BY ALL),
owned AS (SELECT site, i.* REPLACE (site || '/' || i.page_id || '/' || id AS id) FROM issues i JOIN sited USING (page_id)),
found AS (
  SELECT site, landmark, count(*) FILTER (type IN ('missing_title', 'missing_h1', 'missing_text', 'missing_link')) AS structural,
    max(list_position(['info', 'warning', 'error', 'critical'], severity)) AS worst, list_sort(list(id)) AS members FROM owned WHERE landmark IN ('banner', 'complementary', 'contentinfo', 'form', 'main', 'navigation') GROUP BY ALL
),
regions AS (
  SELECT *, CAST(structural AS DOUBLE) / greatest(nodes, structural) AS saturation, ['info', 'warning', 'error', 'critical'][worst] AS severity FROM found JOIN counts USING (site, landmark)
  WHERE CAST(structural AS DOUBLE) / greatest(nodes, structural) >= {least} AND nodes >= 10
),
clusters AS (
  SELECT site, type, landmark, list_sort(list(id)) AS members, count(*) AS n FROM owned o
  WHERE landmark <> '' AND NOT EXISTS (FROM (SELECT site, unnest(members) AS id FROM regions) r WHERE r.site = o.site AND r.id = o.id) GROUP BY ALL HAVING count(*) >= 3
)
"""
_LEAST = "0.2"


def _by_site(spark, sf_dir):
    sites = pairs.old_pages(spark, sf_dir).select("page_id", urls.authority(F.col("url")).alias("site"))
    found = pairs.found(spark, sf_dir).join(sites, "page_id").withColumn("id", F.concat_ws("/", "site", "page_id", "id"))
    counts = assemble.landmark_counts(pairs.nodes(spark, sf_dir)[0].join(sites, "page_id"), ["site"])
    return found, assemble.regions(found, counts, ["site"], float(_LEAST))


@query(_REGIONS.replace("{least}", _LEAST) + "SELECT site, landmark, structural, nodes, saturation, severity, array_to_string(members, ',') AS members, 'region_' || substr(sha256('region' || chr(31) || landmark), 1, 12) AS id FROM regions", sides=True)
def a06_region_saturation(spark, sf_dir):
    """Landmarks of a site of which a large share of the old nodes changed (here from a fifth)."""
    return _by_site(spark, sf_dir)[1].withColumn("members", F.array_join("members", ","))


@query(_REGIONS.replace("{least}", _LEAST) + "SELECT site, type, landmark, array_to_string(members, ',') AS members, CAST(n AS INT) AS n FROM clusters", sides=True)
def a05_landmark_clusters(spark, sf_dir):
    found, regions = _by_site(spark, sf_dir)
    claimed = regions.select("site", F.explode("members").alias("id"))
    return assemble.clusters(found, claimed, ["site"]).withColumn("members", F.array_join("members", ","))


_GROUPED = r"""
, styled AS (SELECT *, CASE WHEN category = 'style' AND type <> 'pseudo_element_missing' THEN split_part(message, ' changed from', 1) END AS prop FROM issues),
by_prop AS (SELECT page_id, type, prop AS shared, 'prop' AS tag, list_sort(list(id)) AS members FROM styled WHERE prop IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
rest AS (SELECT * FROM issues i WHERE NOT EXISTS (FROM (SELECT page_id, unnest(members) AS id FROM by_prop) b WHERE b.page_id = i.page_id AND b.id = i.id)),
by_place AS (SELECT page_id, type, landmark AS shared, 'lm' AS tag, list_sort(list(id)) AS members FROM rest WHERE landmark <> '' GROUP BY ALL HAVING count(*) >= 3),
grouped AS (SELECT *, 'cluster_' || substr(sha256(type || chr(31) || tag || chr(31) || shared), 1, 12) AS cluster FROM (FROM by_prop UNION ALL FROM by_place))
"""


@query(_GROUPED + "SELECT page_id, cluster, shared, CAST(len(members) AS INT) AS n, array_to_string(members, ',') AS members FROM grouped", sides=True)
def a04_a05_o03_clusters_of_pages(spark, sf_dir):
    """Issues of a page that share a type and a style property, then those that share a type and a landmark."""
    c = pairs.results(spark, sf_dir).select(F.col("pair_id").cast("long").alias("page_id"), F.explode("clusters").alias("c"))
    return c.select("page_id", F.col("c.id").alias("cluster"), F.coalesce("c.sharedProperty", "c.sharedLandmark").alias("shared"), F.size("c.issueIds").alias("n"), F.array_join("c.issueIds", ",").alias("members"))


_QUEUE = r"""
, taken AS (SELECT page_id, cluster, unnest(members) AS id FROM grouped),
queue AS (
  SELECT t.page_id, cluster AS item, max(fix_value) AS worth FROM taken t JOIN issues i ON t.page_id = i.page_id AND t.id = i.id GROUP BY ALL
  UNION ALL SELECT page_id, id, fix_value FROM issues i WHERE NOT EXISTS (FROM taken t WHERE t.page_id = i.page_id AND t.id = i.id)
)
SELECT page_id, item, CAST(n AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY worth DESC, item) AS n FROM queue) WHERE n <= 5
"""


@query(_GROUPED + _QUEUE, sides=True)
def o01_o02_top_fixes(spark, sf_dir):
    """The five items of each page that are worth most: clusters, and issues outside them."""
    r = pairs.results(spark, sf_dir).select(F.col("pair_id").cast("long").alias("page_id"), F.posexplode("top_fixes").alias("place", "item"))
    return r.select("page_id", "item", (F.col("place") + 1).alias("place"))


_RESULTS = r"""
, judged_issues AS (SELECT *, list_position(['info', 'warning', 'error', 'critical'], severity) AS r, coalesce(nullif(text, ''), nullif(href, ''), nullif(landmark, ''), nullif(heading, '')) IS NOT NULL AS strong FROM issues),
per_page AS (
  SELECT page_id, CASE WHEN max(r) >= 3 THEN 'fail' WHEN max(r) = 2 THEN 'warn' ELSE 'pass' END AS status, CASE WHEN max(r) >= 3 THEN 1 ELSE 0 END AS exit_code, CAST(count(*) FILTER (r >= 2 AND strong AND type <> 'locale_unknown') AS INT) AS fixable, CAST(count(*) AS INT) AS n
  FROM judged_issues GROUP BY page_id
)
SELECT m.page_id, coalesce(status, 'pass') AS status, coalesce(exit_code, 0) AS exit_code, coalesce(fixable, 0) AS fixable, coalesce(n, 0) AS issues, coalesce(k, 0) AS clusters, o_url AS old_url, n_url AS new_url
FROM meta m LEFT JOIN per_page i ON m.page_id = i.page_id LEFT JOIN (SELECT page_id, CAST(count(*) AS INT) AS k FROM grouped GROUP BY page_id) g ON m.page_id = g.page_id
"""


@query(_GROUPED + _RESULTS, sides=True)
def k01_a08_a09_p21_p22_results(spark, sf_dir):
    """Of each result document: status, exit code, what can be fixed now, and how much there is."""
    d = lambda path, kind="string": F.get_json_object("document", path).cast(kind)
    r = pairs.results(spark, sf_dir)
    return r.select(F.col("pair_id").cast("long").alias("page_id"), d("$.status").alias("status"), "exit_code", d("$.agentSummary.fixableNow", "int").alias("fixable"), F.size("kept").alias("issues"), d("$.agentSummary.clusterCount", "int").alias("clusters"), d("$.oldUrl").alias("old_url"), d("$.newUrl").alias("new_url"))


@query("SELECT m.page_id, CAST(count(i.id) FILTER (landmark IS NULL OR landmark = 'navigation') AS INT) AS kept, CAST(count(i.id) FILTER (landmark <> 'navigation') AS INT) AS outside FROM meta m LEFT JOIN issues i ON m.page_id = i.page_id GROUP BY m.page_id", sides=True)
def p12_scope(spark, sf_dir):
    """Issues within the landmark of interest or without one, and the others."""
    r = issues.results(pairs.rows(spark, sf_dir), pairs.found(spark, sf_dir).drop("page_id"), issues.Options(scope=("navigation",)))
    return r.select(F.col("pair_id").cast("long").alias("page_id"), F.size("kept").alias("kept"), F.size("outside").alias("outside"))


@query("SELECT type, severity, count(*) AS n FROM issues GROUP BY ALL", sides=True)
def a07_type_histogram(spark, sf_dir):
    """Counts by type and severity over the kept issues of all results."""
    kept = pairs.results(spark, sf_dir).select(F.explode("kept").alias("i"))
    return kept.groupBy(F.col("i.type").alias("type"), F.col("i.severity").alias("severity")).agg(F.count("*").alias("n"))


@query("SELECT page_id, CASE WHEN max(r) >= 3 THEN 'fail' WHEN max(r) = 2 THEN 'warn' ELSE 'pass' END AS status, CASE WHEN max(r) >= 3 THEN 1 ELSE 0 END AS exit_code FROM (SELECT page_id, list_position(['info', 'warning', 'error', 'critical'], severity) AS r FROM issues) GROUP BY page_id", sides=True)
def a09_p22_status_and_exit_code(spark, sf_dir):
    rank = assemble.severity_rank(F.col("severity"))
    found = pairs.found(spark, sf_dir).groupBy("page_id").agg(F.max(rank).alias("rank"))
    return found.select("page_id", assemble.status(F.col("rank")).alias("status"), assemble.exit_code(F.col("rank")).alias("exit_code"))


# Order


_TURNS = r"""
WITH moved AS (
  SELECT conv_id AS grp, turn AS id, turn AS old_pos, CASE WHEN conv_id % 3 = 0 AND turn IN (0, 1) THEN 1 - turn WHEN conv_id % 3 = 1 THEN -turn ELSE turn END AS new_pos FROM conversations
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY old_pos, id) - 1 AS old_rank, row_number() OVER (PARTITION BY grp ORDER BY new_pos, id) - 1 AS new_rank FROM moved
), blocked AS (
  SELECT *, sum(s) OVER (PARTITION BY grp ORDER BY old_rank ROWS UNBOUNDED PRECEDING) - 1 AS block
  FROM (SELECT *, CASE WHEN new_rank = lag(new_rank) OVER (PARTITION BY grp ORDER BY old_rank) + 1 THEN 0 ELSE 1 END AS s FROM ranked)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY new_start, old_start) - 1 AS sigma
  FROM (SELECT grp, CAST(block AS BIGINT) AS block, count(*) AS size, min(old_rank) AS old_start, min(new_rank) AS new_start FROM blocked GROUP BY grp, block)
)
"""


def _moved(spark, sf_dir):
    conv, turn = F.col("conv_id"), F.col("turn")
    new = F.when((conv % 3 == 0) & turn.isin(0, 1), 1 - turn).when(conv % 3 == 1, -turn).otherwise(turn)
    return sequence.ranks(pairs.table(spark, sf_dir, "conversations").select(conv.alias("grp"), turn.alias("id"), turn.alias("old_pos"), new.alias("new_pos")))


@query(_TURNS + "SELECT grp, id, CAST(old_rank AS INT) AS old_rank, CAST(new_rank AS INT) AS new_rank, CAST(block AS BIGINT) AS block FROM blocked")
def w02_w03_ranks_and_blocks(spark, sf_dir):
    return sequence.blocks(_moved(spark, sf_dir)).select("grp", "id", "old_rank", "new_rank", "block")


@query(_TURNS + "SELECT grp, block, size, CAST(old_start AS INT) AS old_start, CAST(new_start AS INT) AS new_start, CAST(sigma AS INT) AS sigma FROM ordered")
def w04_block_order(spark, sf_dir):
    return sequence.block_order(sequence.blocks(_moved(spark, sf_dir)))


@query(_TURNS + "SELECT a.grp, a.block AS first_block, b.block AS second_block FROM ordered a JOIN ordered b ON a.grp = b.grp AND a.sigma = b.block AND b.sigma = a.block AND a.block < b.block")
def w05_swaps(spark, sf_dir):
    return sequence.swaps(sequence.block_order(sequence.blocks(_moved(spark, sf_dir))))


@query()
def w06_longest_increasing_blocks(spark, sf_dir):
    """The blocks that kept their order; tested against all subsequences."""
    return sequence.stable_blocks(sequence.block_order(sequence.blocks(_moved(spark, sf_dir))))



# Functions


_SPACES = "[ \\t\\n\\r\\f\\v]+"
_LOW_TOKENS = "list_distinct(list_filter(string_split_regex(" + pairs.LOW.format("{}") + f", '{_SPACES}'), lambda t: t <> ''))"
_JACCARD = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 1.0 ELSE len(list_intersect({0}, {1}))::DOUBLE / len(list_distinct(list_concat({0}, {1}))) END"


def _neighbours(spark, sf_dir):
    docs = pairs.table(spark, sf_dir, "documents")
    return docs.alias("x").join(docs.alias("y"), F.col("y.doc_id") == F.col("x.doc_id") + 1)


@query()
def f02_f03_jaccard_and_edit_distance(spark, sf_dir):
    """All neighbouring documents, in characters; tested against plain Python, as DuckDB's distance counts bytes."""
    a, b = F.col("x.text"), F.col("y.text")
    return _neighbours(spark, sf_dir).select("x.doc_id", F.levenshtein(F.substring(a, 1, 200), F.substring(b, 1, 200)).alias("distance"), text.token_jaccard(a, b).alias("jaccard"))


@query("SELECT x.doc_id, " + _JACCARD.format("tx", "ty") + " AS jaccard FROM (SELECT *, {t} AS tx FROM documents) x JOIN (SELECT *, {t} AS ty FROM documents) y ON y.doc_id = x.doc_id + 1".replace("{t}", _LOW_TOKENS.format("text")))
def f02_u06_token_jaccard(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("x.doc_id", text.token_jaccard(F.col("x.text"), F.col("y.text")).alias("jaccard"))


_PLAIN = "regexp_replace({}, '[^ -~]', '?', 'g')"
_CUT = {s: f"substr({s}, 1, 200)" for s in "ab"}
_SIM = f"CASE WHEN a IS NULL AND b IS NULL THEN 1.0 WHEN a IS NULL OR b IS NULL THEN 0.0 WHEN a = b THEN 1.0 ELSE 0.5 * {_JACCARD.format(_LOW_TOKENS.format(_CUT['a']), _LOW_TOKENS.format(_CUT['b']))} + 0.5 * (1 - levenshtein({_CUT['a']}, {_CUT['b']})::DOUBLE / greatest(length({_CUT['a']}), length({_CUT['b']}))) END"


@query(f"SELECT doc_id, round({_SIM}, 9)::DOUBLE AS same, CASE WHEN coalesce(a, '') = '' AND coalesce(b, '') = '' THEN 1.0 ELSE round({_SIM}, 9) END::DOUBLE AS alt, CASE WHEN la IS NOT DISTINCT FROM lb THEN 1.0 ELSE 0.0 END::DOUBLE AS role FROM (SELECT x.doc_id, {_PLAIN.format('x.text')} AS a, {_PLAIN.format('y.text')} AS b, x.lang AS la, y.lang AS lb FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1)")
def f01_f03_f06_f08_similarities(spark, sf_dir):
    """Similarities of neighbouring texts whose characters other than ASCII are question marks, so that bytes are characters."""
    a, b = (F.regexp_replace(f"{s}.text", "[^ -~]", "?") for s in "xy")
    return _neighbours(spark, sf_dir).select("x.doc_id", F.round(text.text_sim(a, b), 9).alias("same"), F.round(text.alt_sim(a, b), 9).alias("alt"), text.role_sim(F.col("x.lang"), F.col("y.lang")).alias("role"))


@query(
    "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber % 5 = 0 THEN 0.0 ELSE least(w, v) / greatest(w, v) * (least(h, g)::DOUBLE / greatest(h, g)) END, 9) AS dims, round(1 - least(1.0, abs(w / 100.0 - v / 200.0)), 9) AS pos, round(least(w * h, v * g) / greatest(w * h, v * g), 9) AS size,"
    " round(0.7 * (least(w, v) / greatest(w, v)) + 0.3 * (0.5 * (1 - least(1.0, abs(w / 100.0 - v / 200.0))) + 0.3 * (least(w * h, v * g) / greatest(w * h, v * g)) + 0.2), 9) AS combined FROM (SELECT *, l_quantity::DOUBLE AS w, (l_quantity + 3)::DOUBLE AS v, l_linenumber AS h, l_linenumber + 1 AS g FROM lineitem)"
)
def f07_f10_f11_f13_scores(spark, sf_dir):
    """Similarities of sizes and places over made-up boxes, and the combined score of two parts."""
    w, h = F.col("l_quantity").cast("double"), F.col("l_linenumber")
    v, g = w + 3, h + 1
    dims = text.dimension_sim(F.when(h % 5 == 0, 0).otherwise(w), h, v, g)
    pos, size = text.position_sim(w, F.lit(100.0), v, F.lit(200.0)), text.size_sim(w * h, v * g)
    tie = pairing.TIEBREAK[0] * pos + pairing.TIEBREAK[1] * size + pairing.TIEBREAK[2]
    nine = lambda c: F.round(c, 9)
    return pairs.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", nine(dims).alias("dims"), nine(pos).alias("pos"), nine(size).alias("size"), nine(pairing.combined(F.least(w, v) / F.greatest(w, v), tie)).alias("combined"))


@query(
    "SELECT doc_id, substr(regexp_replace(text, '[\\x00-\\x1F\\x7F-\\x{9F}]', '', 'g'), 1, 1000) AS style, array_to_string(list_filter(string_split_regex(" + pairs.LOW.format("text") + f", '{_SPACES}'), lambda t: t <> ''), ' ') AS label, "
    + pairs._LABEL("text") + f" AS short, trim(regexp_replace(text, '{_SPACES}', ' ', 'g')) AS flat, round(n_chars / 7.0 * 10000) / 10000 AS four, source LIKE 'a%' OR source = 'b' AS wild FROM documents"
)
def f16_f17_f18_f20_f21_f25_texts(spark, sf_dir):
    """Style values, labels, beginnings of eighty bytes, collapsed whitespace, four decimals, wildcards."""
    t = F.col("text")
    wild = text.wildcard_match(F.col("source"), F.lit("a*")) | text.wildcard_match(F.col("source"), F.lit("b"))
    return pairs.table(spark, sf_dir, "documents").select("doc_id", text.cap_style_value(t).alias("style"), text.label_text(t).alias("label"), text.truncate_bytes(t).alias("short"), text.collapse_whitespace(t).alias("flat"), text.round4(F.col("n_chars") / 7.0).alias("four"), wild.alias("wild"))


@query("SELECT doc_id, substr(trim(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g')), 1, 500) AS normal FROM documents")
def f15_normalize_text(spark, sf_dir):
    return pairs.table(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normal"))


@query("SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) || '://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS origin, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*([?][^#]*)', 1) AS query, regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) AS file, regexp_replace(url, '[?#].*$', '') AS stable, regexp_replace(regexp_replace(url, '#.*$', ''), '^([^?]*[^/?])/+([?].*)?$', '\\1\\2') AS compared FROM pages")
def f26_f34_url_parts(spark, sf_dir):
    u = F.col("url")
    return pairs.table(spark, sf_dir, "pages").select("page_id", urls.origin(u).alias("origin"), urls.path(u).alias("path"), urls.query(u).alias("query"), urls.file_name(u).alias("file"), urls.id_stable_url(u).alias("stable"), urls.normalize_for_compare(u).alias("compared"))


@query(
    "SELECT p.page_id, seq, raw_href, href AS resolved, CASE WHEN raw_href = '' THEN '' ELSE regexp_replace(raw_href, '#.*$', '') END AS normal, 1.0::DOUBLE AS same, 0.0::DOUBLE AS apart FROM old_nodes n JOIN old_pages p ON n.page_id = p.page_id WHERE kind = 'link'",
    sides=True,
)
def f04_f05_f27_f28_f30_links(spark, sf_dir):
    """Links as they resolve on their page, and their likeness to themselves, written out, and to another site's path."""
    n, p = pairs.nodes(spark, sf_dir)[0], pairs.old_pages(spark, sf_dir).select("page_id", "url")
    h, u = F.col("rawHref"), F.col("url")
    rows = n.where("kind = 'link'").join(p, "page_id")
    away = F.lit("https://elsewhere.example/nowhere-else")
    return rows.select("page_id", F.col("seqIndex").alias("seq"), F.col("rawHref").alias("raw_href"), urls.resolve(h, u).alias("resolved"), urls.norm_href(h, u).alias("normal"), urls.href_sim_cross_origin(h, F.col("href"), u, u).alias("same"), urls.href_sim(h, away, u, u).alias("apart"))


_REST = "regexp_replace({}.url, '^[a-z]+://[^/?#]*|#.*$', '', 'g')"
_DIR = "regexp_extract(regexp_extract(x.url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^(.*/)', 1)"
_ORIGIN = "regexp_extract({}.url, '^([a-z]+://[^/?#]*)', 1)"


@query(
    f"SELECT x.page_id, {_REST.format('x')} AS path_query, {_DIR} AS dir, CASE WHEN {_ORIGIN.format('x')} <> {_ORIGIN.format('y')} THEN y.url WHEN starts_with({_REST.format('y')}, {_DIR}) THEN substr({_REST.format('y')}, length({_DIR}) + 1) ELSE {_REST.format('y')} END AS key,"
    f" CASE WHEN regexp_replace({_ORIGIN.format('x')}, '^[a-z]+://', '') <> regexp_replace({_ORIGIN.format('y')}, '^[a-z]+://', '') THEN 'external' END AS refused FROM pages x JOIN pages y ON y.page_id = x.page_id + 1"
)
def f29_f31_f32_p17_request_keys(spark, sf_dir):
    """The next page's URL as a request of this one: its key, and whether it may be probed."""
    p = pairs.table(spark, sf_dir, "pages")
    a, b = F.col("x.url"), F.col("y.url")
    return p.alias("x").join(p.alias("y"), F.col("y.page_id") == F.col("x.page_id") + 1).select("x.page_id", urls.path_query(a).alias("path_query"), urls.page_dir(a).alias("dir"), urls.request_key(b, a).alias("key"), urls.egress_reason(b, a).alias("refused"))


_CODE = "(l_orderkey * 7919 % 16777216)"


@query(
    f"SELECT l_orderkey, l_linenumber, 'rgb(' || {_CODE} // 65536 || ', ' || {_CODE} // 256 % 256 || ', ' || {_CODE} % 256 || ')' AS color, CASE l_linenumber % 3 WHEN 0 THEN 'rgb(255, 0, 0)' WHEN 1 THEN 'rgba(1, 2, 3, 0.5)' ELSE 'var(--x)' END AS other, l_linenumber % 2 = 0 AS near,"
    " CASE l_linenumber % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'left' WHEN 2 THEN '19.2px' ELSE 'x' END AS canonical, CASE WHEN l_linenumber % 2 = 0 THEN 'background_gradient_lost' ELSE 'background_gradient_changed' END AS kind FROM lineitem"
)
def f38_f39_f41_f43_f45_css_values(spark, sf_dir):
    """Colours, nearly equal values, forms that mean the same, and what a change of a gradient is called."""
    n, code = F.col("l_linenumber"), F.col("l_orderkey") * 7919 % 16777216
    color = css.normalize_color(F.concat(F.lit("#"), F.lower(F.lpad(F.hex(code), 6, "0"))))
    other = css.normalize_value(F.lit("color"), F.when(n % 3 == 0, " Red").when(n % 3 == 1, "rgba(1,2,3,.5)").otherwise("var(--x)"))
    near = css.values_equal(F.lit("1px 2.50em"), F.when(n % 2 == 0, "1.05px 2.45em").otherwise("1.05px 2.45px"))
    prop = F.when(n % 4 == 0, "border").when(n % 4 == 1, "text-align").when(n % 4 == 2, "line-height").otherwise("content")
    value = F.when(n % 4 == 0, "0px none red").when(n % 4 == 1, "start").when(n % 4 == 2, "normal").otherwise("'x'")
    kind = css.style_change_type(F.lit("background-image"), F.lit("linear-gradient(red, blue)"), F.when(n % 2 == 0, "none").otherwise("linear-gradient(red, tan)"))
    return pairs.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", color.alias("color"), other.alias("other"), near.alias("near"), css.canonical(prop, value, F.lit("16px")).alias("canonical"), kind.alias("kind"))


@query("SELECT page_id, 'url(\"img/' || page_id || '.png\")' AS own, 'url(https://cdn.example/a/b.png)' AS elsewhere, true AS same_file, false AS other_file FROM pages")
def f40_f42_url_values(spark, sf_dir):
    """url() without the page's own origin and directory, and files that only moved to another host."""
    u = F.col("url")
    own = F.concat(F.lit('url("'), urls.scheme(u), F.lit("://"), urls.authority(u), urls.page_dir(u), F.lit("img/"), F.col("page_id").cast("string"), F.lit('.png")'))
    far = F.lit("url(https://cdn.example/a/b.png)")
    return pairs.table(spark, sf_dir, "pages").select("page_id", css.normalize_url_origins(own, u).alias("own"), css.normalize_url_origins(far, u).alias("elsewhere"), css.same_file(far, F.lit("url('/x/b.png?v=2')")).alias("same_file"), css.same_file(far, F.lit("url(/x/c.png)")).alias("other_file"))


@query("SELECT page_id, regexp_replace(url, '([?&])(ref|page)=[^&#]*', '\\1\\2=gone', 'g') AS seen, regexp_matches(url, '[?&](token|key)=') AS leaks FROM pages")
def f36_p23_redacted_urls(spark, sf_dir):
    u = F.col("url")
    return pairs.table(spark, sf_dir, "pages").select("page_id", urls.redact(u, ["ref", "page"], "gone").alias("seen"), urls.has_credential(u).alias("leaks"))


@query("SELECT page_id, seg AS segment, sep AND contains(seg, '_') AS separator_invalid, lg <> lower(lg) OR (sep AND rg <> upper(rg)) AS case_invalid, sep AND NOT (lower(lg) IN ('en', 'fr', 'de', 'es') AND upper(rg) IN ('US')) AS unknown, CASE WHEN sep THEN lower(lg) || '-' || upper(rg) ELSE lower(seg) END AS corrected FROM locale", sides=True)
def f37_locale_validation(spark, sf_dir):
    codes = locales.known_codes(spark)
    found = pairs.meta(spark, sf_dir)[1].select("page_id", locales.detect(urls.path(F.col("url")), *codes).alias("l"))
    return found.where("l is not null").select("page_id", "l.*")


@query("SELECT page_id, html AS raw, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS safe FROM pages")
def f24_escaped_evidence(spark, sf_dir):
    """The whole page, escaped."""
    raw = F.col("html")
    return pairs.table(spark, sf_dir, "pages").select("page_id", raw.alias("raw"), text.escape_html(raw).alias("safe"))


_FOLDED = r"""
, folded AS (
  SELECT page_id, coalesce(landmark, '(page)') AS landmark, type, coalesce(text, '') AS message, count(*) AS n, max(list_position(['info', 'warning', 'error', 'critical'], severity)) AS rank, max(round(fix_value, 9)) AS fix_value, min(id) AS ord
  FROM issues WHERE severity <> 'critical' GROUP BY ALL
), cells AS (
  SELECT *, trim(replace(replace(replace(message, '|', '\|'), chr(13), ' '), chr(10), ' ')) AS cell FROM folded
), sections AS (
  SELECT page_id, landmark, CAST(sum(n) AS BIGINT) AS n, max(rank) AS rank, max(fix_value) AS fix_value,
    string_agg('- [' || ['info', 'warning', 'error', 'critical'][rank] || '] ' || type || ' ×' || n || ' — ' || cell || chr(10), '' ORDER BY ord, type, message) AS lines
  FROM cells GROUP BY page_id, landmark
), headed AS (
  SELECT *, '### ' || landmark || ' › — (' || n || CASE WHEN n = 1 THEN ' issue' ELSE ' issues' END || ') — show --section ''' || landmark || '''' || chr(10) AS head FROM sections
), sized AS (SELECT *, CAST(strlen(head) + strlen(lines) AS INT) AS size FROM headed),
placed AS (
  SELECT *, CAST(row_number() OVER w AS INT) AS place,
    size > {ceiling} OR sum(CASE WHEN size > {ceiling} THEN 0 ELSE size END) OVER (PARTITION BY page_id ORDER BY fix_value DESC, landmark ROWS UNBOUNDED PRECEDING) > {budget} AS collapsed
  FROM sized WINDOW w AS (PARTITION BY page_id ORDER BY fix_value DESC, landmark)
)
SELECT page_id, place, landmark, n, ['info', 'warning', 'error', 'critical'][rank] AS severity, fix_value, size, collapsed, head, lines FROM placed
"""
_BUDGET, _CEILING = 400, 300


@query(_FOLDED.replace("{budget}", str(_BUDGET)).replace("{ceiling}", str(_CEILING)), sides=True)
def a19_w09_sections_within_budget(spark, sf_dir):
    """Sections of a page by worth, in full while a budget lasts; the first place of an issue is its id here."""
    found = pairs.found(spark, sf_dir)
    read = found.select("page_id", "id", "type", "severity", F.coalesce("anchors.text", F.lit("")).alias("message"), "landmark", F.lit(None).cast("string").alias("heading"), F.round("fix_value", 9).alias("fix_value"), F.col("id").alias("ord"))
    return report.outline(read, read.where("false"), ["page_id"], _BUDGET, _CEILING).drop("heading")

