"""Page pairs out of the driver's tables: the old side is `pages`, the new side the same rows after known changes.

What a page scan can't see (styles, requests, console, rules, probes, hit tests, pseudo-elements) is added by rules over
the page's id, so that every detector has pages on which it must speak and many more on which it must not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..analyze import Options
from ..functions import locales, urls
from ..operators import issues
from ..sources import htmlscan
from ..sources.bundles import BUNDLE
from .store import once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def old_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", "html", F.lit(200).alias("status"))


def new_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, u, p = F.col("html"), F.col("url"), F.col("page_id")
    html = (
        F.when(p % 7 == 1, F.regexp_replace(h, "(?s)<title>.*?</title>", "<title></title>"))
        .when(p % 7 == 2, F.replace(F.replace(h, F.lit("</title>"), F.lit(" v2</title>")), F.lit("</h1>"), F.lit(" v2</h1>")))
        .when(p % 7 == 3, F.regexp_replace(h, "(?s)^(.*?)<li>.*?</li>", "$1"))
        .when(p % 7 == 4, F.regexp_replace(h, '(?s)^(.*?)href="/', '$1href="/x-'))
        .when(p % 7 == 5, F.regexp_replace(h, "<(/?)h1>", "<$1h2>"))
        .when(p % 7 == 6, F.regexp_replace(h, "(?s)<footer>.*?</footer>", ""))
        .otherwise(h)
    )
    html = F.when(p % 17 == 1, F.regexp_replace(html, "(?s)<li>.*?</li>", "")).otherwise(html)
    html = F.when(p % 19 == 1, F.regexp_replace(html, '(?s)(<div class="ad">[^<]*</div>)(.*</article>)', "$2$1")).otherwise(html)
    html = F.when(p % 53 == 1, F.replace(html, F.lit("</head>"), F.lit('<link rel="canonical" href="https://example.org/other"></head>'))).otherwise(html)
    html = F.when(p % 35 == 0, F.replace(html, F.lit("</article>"), F.lit("<p>Added words.</p></article>"))).otherwise(html)
    url = (
        F.when(p % 11 == 1, F.regexp_replace(u, "^https:", "http:"))
        .when(p % 11 == 2, F.regexp_replace(u, "^([^?#]*)", "$1/"))
        .when(p % 11 == 3, F.replace(u, F.lit("/en/"), F.lit("/en_us/")))
        .when(p % 11 == 4, F.replace(u, F.lit("/en/"), F.lit("/en-us/")))
        .when(p % 11 == 5, F.replace(u, F.lit("/en/"), F.lit("/xx-ZZ/")))
        .otherwise(u)
    )
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"), html.alias("html"), F.when(p % 13 == 1, 404).otherwise(200).alias("status"))


def captured(scans: DataFrame, side: str) -> DataFrame:
    """Scanned pages as captures, with the channels that a scan lacks made by rule."""
    new = side == "new"
    p, page = F.col("page_id"), F.col("page")
    only = lambda n, r, value, other: F.when(p % n == r, value).otherwise(other) if new else other
    marked = F.filter(page["nodes"], lambda n: n["kind"].isin("link", "heading"))
    style = F.create_map(F.lit("color"), only(23, 1, F.lit("#ff0000"), F.lit("rgb(0, 0, 0)")), F.lit("font-size"), F.lit("16px"), F.lit("letter-spacing"), only(23, 1, F.lit("2px"), F.lit("normal")))
    link = F.get(F.filter(page["nodes"], lambda n: n["kind"] == "link"), F.lit(0))
    origin = F.concat(urls.scheme(page["finalUrl"]), F.lit("://"), urls.authority(page["finalUrl"]))
    request = lambda path, status, type_, failed: F.struct(F.concat(origin, F.lit(path)).alias("url"), F.lit(status).cast("int").alias("status"), F.lit(type_).alias("type"), F.lit(failed).alias("failed"))
    app = request("/app.js", 200, "script", False)
    requests = F.when(p % 29 == 1, F.array(request("/app.js", 500, "script", False))).when(p % 29 == 2, F.array(app, request("/missing.png", None, "image", True))).otherwise(F.array(app)) if new else F.array(app)
    console = only(31, 1, F.array(F.struct(F.lit("error").alias("level"), F.concat(F.lit("boom "), (p % 5).cast("string")).alias("text"))), F.array().cast("array<struct<level:string,text:string>>"))
    rule = lambda id_, nodes: F.array(F.struct(F.lit(id_).alias("id"), F.lit("serious").alias("impact"), F.lit(f"https://rules.example/{id_}").alias("helpUrl"), nodes.alias("nodes")))
    shown = F.array(F.struct(F.array(F.lit("h1")).alias("target"), F.lit("<img>").alias("html")))
    none = F.array().cast("array<struct<id:string,impact:string,helpUrl:string,nodes:array<struct<target:array<string>,html:string>>>>")
    violations = F.when(p % 37 == 1, rule("image-alt", shown)).otherwise(none) if new else F.when(p % 37 == 2, rule("label", shown)).otherwise(none)
    target = urls.without_fragment(link["href"])
    chain = only(41, 2, F.array(target, F.concat(target, F.lit("-2"))), F.array().cast("array<string>"))
    probe = F.struct(target.alias("url"), chain.alias("redirectChain"), target.alias("finalUrl"), only(41, 1, F.lit(404), F.lit(200)).alias("status"), F.lit(None).cast("string").alias("skipped"), F.lit(None).cast("string").alias("error"))
    probes = F.when(link.isNotNull(), F.array(probe)).otherwise(F.array().cast("array<struct<url:string,redirectChain:array<string>,finalUrl:string,status:int,skipped:string,error:string>>"))
    hit, miss = (F.struct(F.lit(o).alias("o"), F.lit(w).cast("string").alias("winner")) for o, w in (("hit", None), ("miss", "div.cover")))
    points = F.concat(F.array_repeat(hit, 15), only(43, 1, F.array_repeat(miss, 10), F.array_repeat(hit, 10)))
    sampled = F.struct(F.lit("sampled").alias("status"), F.lit(None).cast("string").alias("skipReason"), F.lit(5).alias("gridSize"), points.alias("points"))
    kind = BUNDLE.split("hitTests ")[1].split(", pseudoElements ")[0]
    hits = F.when(link.isNotNull(), F.map_from_arrays(F.array(link["id"]), F.array(sampled))).otherwise(F.create_map().cast(kind))
    paint = lambda top: F.create_map(F.lit("content"), F.lit('"a"'), F.lit("top"), top)
    entry = lambda top: F.struct(F.lit("selector").alias("ownerTier"), F.lit(None).cast("string").alias("ownerNodeId"), F.lit("div.x").alias("ownerSelector"), F.lit("main").alias("landmark"), paint(top).alias("before"), F.lit(None).cast("map<string,string>").alias("after"))
    pseudo = F.map_from_arrays(F.array(only(47, 1, F.lit("other"), F.lit("main::div.x"))), F.array(entry(only(47, 2, F.lit("9px"), F.lit("1px")))))
    full = page
    for name, value in (("statusCode", F.col("status")), ("redirectChain", F.array(page["finalUrl"])), ("pageHeight", only(59, 1, F.lit(2120), F.lit(2000))), ("console", console), ("linkProbes", probes)):
        full = full.withField(name, value)
    height = lambda r: only(59, 1, F.when(r["role"] == "navigation", 170).otherwise(50), F.lit(50))
    full = full.withField("landmarkRects", F.transform(page["landmarkRects"], lambda r: r.withField("bbox", F.array(F.lit(0), F.lit(0), F.lit(100), height(r)))))
    full = full.withField("network", F.struct(requests.alias("requests"))).withField("a11y", F.struct(violations.alias("violations")))
    steps = ("animationsDisabled", "reducedMotion", "timeFrozen", "randomStubbed", "fontsReady", "imagesDecoded", "lazyLoadPass", "settled", "settle")
    types = {f.split(" ", 1)[0]: f.split(" ", 1)[1] for f in _fields(BUNDLE)}
    integrity = 'struct(struct(inventory.headingCount, inventory.imageCount, inventory.landmarkCount) as pre, struct(inventory.headingCount, inventory.imageCount, inventory.landmarkCount) as post)'
    determinism = F.from_json(F.to_json(F.struct(*(F.lit("ran").alias(s) for s in steps), F.lit("stable").alias("quiescence"), F.expr(integrity).alias("integrity"))), types["determinism"])
    return scans.select(
        p.cast("string").alias("pair_id"), F.lit(side).alias("side"), F.struct(F.lit("desktop").alias("name"), F.lit(1440).alias("width"), F.lit(1000).alias("height"), F.lit(1.0).alias("dsf")).alias("viewport"),
        F.struct(only(61, 1, F.lit("mac"), F.lit("linux")).alias("os"), F.lit("1").alias("chromiumBuild"), F.lit("1").alias("playwright"), F.lit(1.0).alias("dsf")).alias("environment"), determinism.alias("determinism"), full.alias("page"),
        F.map_from_arrays(F.transform(marked, lambda n: n["id"]), F.transform(marked, lambda n: style)).alias("computedStyles"), F.col("styleCandidates"), hits.alias("hitTests"), pseudo.alias("pseudoElements"), F.lit(None).cast("string").alias("pseudoTruncated"),
    )


def _fields(ddl: str) -> list[str]:
    """The top-level fields of a type's text."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(ddl[start:i].strip())
            start = i + 1
    return [*out, ddl[start:].strip()]


def scans(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Scanned pages of a side, each page parsed once in a session."""
    return once(spark, f"scan-{side}", sf_dir, lambda: htmlscan.scanned((old_pages if side == "old" else new_pages)(spark, sf_dir)))


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captured(scans(spark, sf_dir, "old"), "old").unionByName(captured(scans(spark, sf_dir, "new"), "new"))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matched pairs: one join of both sides."""
    return once(spark, "rows", sf_dir, lambda: issues.prepared(bundles(spark, sf_dir)))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All issues, made in the rows of the matched pairs."""
    codes = locales.known_codes(spark)
    return once(spark, "issues", sf_dir, lambda: issues.found_issues(rows(spark, sf_dir), *codes, Options())).withColumn("page_id", F.col("pair_id").cast("long"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, "results", sf_dir, lambda: issues.results(rows(spark, sf_dir), found(spark, sf_dir).drop("page_id"), Options()))


def nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of either side: the fields of the scan, with landmark and nearest heading."""
    one = lambda side: htmlscan.nodes(scans(spark, sf_dir, side), "page_id").withColumns({"landmark": F.col("anchors.landmark"), "heading": F.col("anchors.nearestHeading")})
    return one("old"), one("new")


def meta(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    one = lambda side: scans(spark, sf_dir, side).select("page_id", "url", F.coalesce("page.title", F.lit("")).alias("title"), F.coalesce("page.metaDescription", F.lit("")).alias("meta_description"), F.coalesce("page.canonical", F.lit("")).alias("canonical"), F.coalesce("page.lang", F.lit("")).alias("lang"), "status")
    return one("old"), one("new")


LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CLEAN = "trim(substr(trim(regexp_replace(regexp_replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')), 1, 500))"
_SIDE = r"""
{s}_parts AS (
  SELECT page_id, url, i, regexp_extract_all(html, '<a href="[^"]*">[^<]*|<h[12]>[^<]*|<p>(?:<b>)?[^<]*|<div class="ad">[^<]*|<footer>[^<]*')[i] AS part
  FROM {s}_pages, unnest(range(1, 1 + len(regexp_extract_all(html, '<a href="[^"]*">[^<]*|<h[12]>[^<]*|<p>(?:<b>)?[^<]*|<div class="ad">[^<]*|<footer>[^<]*')))) t(i)
),
{s}_tagged AS (
  SELECT page_id, url, i, part, CASE WHEN starts_with(part, '<a') THEN 'link' WHEN starts_with(part, '<h') THEN 'heading' ELSE 'text' END AS kind,
    nullif({text}, '') AS text, CASE WHEN starts_with(part, '<a') THEN {raw} END AS raw_href
  FROM {s}_parts
),
{s}_nodes AS (
  SELECT page_id, kind, CAST(row_number() OVER w - 1 AS INT) AS seq, text, CASE kind WHEN 'text' THEN NULL ELSE kind END AS role, raw_href, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || raw_href AS href,
    CASE WHEN kind = 'heading' THEN CAST(substr(part, 3, 1) AS INT) END AS level, CASE WHEN kind = 'link' THEN 'navigation' END AS landmark,
    last_value(CASE WHEN kind = 'heading' THEN coalesce(text, '') END IGNORE NULLS) OVER w AS heading, part, i
  FROM {s}_tagged WHERE kind <> 'text' OR text IS NOT NULL WINDOW w AS (PARTITION BY page_id ORDER BY i)
),
{s}_keyed AS (
  SELECT *, kind AS block, CASE kind WHEN 'heading' THEN {low} || '|' || level WHEN 'link' THEN raw_href || '|' || {low} || '|' || {low} ELSE {low} END AS key FROM {s}_nodes
),
{s}_meta AS (
  SELECT page_id, url, {title} AS title, '' AS meta_description, regexp_extract(html, '<link rel="canonical" href="([^"]*)"', 1) AS canonical, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, status FROM {s}_pages
)"""
_SIDE = _SIDE.replace("{text}", _CLEAN.format("regexp_replace(part, '^(<[^>]*>)+', '')")).replace("{raw}", _CLEAN.format("regexp_extract(part, 'href=\"([^\"]*)\"', 1)")).replace("{title}", _CLEAN.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")).replace("{low}", LOW.format("coalesce(text, '')"))


def _id(type_: str, text: str = "''", role: str = "''", href: str = "''", landmark: str = "''", heading: str = "''", prop: str = "''") -> str:
    stable = f"regexp_replace(coalesce({href}, ''), '[?#].*$', '')"
    near = f"CASE WHEN coalesce({text}, '') <> '' OR {stable} <> '' THEN '' ELSE coalesce({heading}, '') END"
    fields = [type_, "'desktop'", f"coalesce({text}, '')", f"coalesce({role}, '')", stable, "''", "''", f"coalesce({landmark}, '')", near, prop]
    return f"'issue_' || substr(sha256({' || chr(31) || '.join(fields)}), 1, 12)"


def _row(type_: str, category: str, severity: str, confidence: str, message: str, source: str, *, flat: bool = True, text="NULL", role="NULL", href="NULL", landmark="NULL", heading="NULL", prop="''", seq_old="NULL", seq_new="NULL", grp: int = 9) -> str:
    quoted = type_ if type_.startswith(("CASE", "'", "kind_")) else f"'{type_}'"
    sure = confidence if flat else f"round(({confidence}) * CASE WHEN page_id % 61 = 1 THEN 0.5 ELSE 1.0 END * 10000) / 10000"
    return (
        f"SELECT page_id, {quoted} AS type, '{category}' AS category, {severity if severity.startswith('CASE') else repr(severity)} AS severity, CAST({sure} AS DOUBLE) AS confidence, {message} AS message, {text}::VARCHAR AS text, {href}::VARCHAR AS href, {landmark}::VARCHAR AS landmark, {heading}::VARCHAR AS heading, "
        f"CAST({seq_old} AS INT) AS seq_old, CAST({seq_new} AS INT) AS seq_new, {grp} AS grp, {_id(quoted, text, role, href, landmark, heading, prop)} AS base_id FROM {source}"
    )


_PATH = "regexp_replace(n_url, '^[a-z]+://[^/?#]*', '')"
_NPATH = "regexp_extract(n_url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_e = "coalesce({}, '')".format
_LABEL = "substr({0}, 1, coalesce(list_max(list_filter(range(20, 81), lambda k: octet_length(encode(substr({0}, 1, k))) <= 80)), 80))".format
_node = {"text": "text", "role": "role", "href": "href", "landmark": "landmark", "heading": "heading"}
_o = {k: f"o_{k}" for k in ("text", "role", "href", "landmark", "heading")} | {"seq_old": "o_seq"}
_n = {k: f"n_{k}" for k in ("text", "role", "href", "landmark", "heading")} | {"seq_old": "o_seq", "seq_new": "n_seq"}
_CHROME = "CASE WHEN {} = 'navigation' THEN 0.85 ELSE 1.0 END".format
_BASE = "CASE stage WHEN 'identity' THEN 0.95 ELSE 0.9 END * CASE band WHEN 'uncertain' THEN 0.6 ELSE 1.0 END * " + _CHROME("n_landmark")
_EVERY = "\n  UNION ALL ".join(
    [
        _row("status_code_mismatch", "technical", "critical", "0.99", "'Status code mismatch: old=' || o_status || ' new=' || n_status", "meta WHERE o_status = 200 AND n_status <> 200", href=_PATH),
        _row("page_height_changed", "visual", "info", "0.95", "'Page height changed from 2000 to 2120 px'", "meta WHERE page_id % 59 = 1", flat=False, grp=1),
        _row("missing_title", "content", "error", "0.97", "'Title removed: was ''' || o_title || ''''", "meta WHERE o_title <> '' AND n_title = ''", grp=2),
        _row("changed_title", "content", "error", "0.97", "'Title changed from ''' || o_title || ''' to ''' || n_title || ''''", "meta WHERE o_title <> '' AND n_title <> '' AND o_title <> n_title", grp=2),
        _row("missing_h1", "content", "error", "0.97", "'H1 heading removed: was ''' || coalesce(text, '') || ''''", "lost_h1", **_node, seq_old="seq", grp=2),
        _row("CASE WHEN 1 IN (o_level, n_level) THEN 'changed_h1' ELSE 'changed_text' END", "content", "error", _BASE, f"'Heading text changed from ''' || {_e('o_text')} || ''' to ''' || {_e('n_text')} || ''''", f"pairs WHERE block = 'heading' AND {_e('o_text')} <> {_e('n_text')}", flat=False, **_n, grp=2),
        _row("heading_structure_changed", "content", "error", _BASE, f"'Heading level changed for ''' || {_e('o_text')} || ''''", "pairs WHERE block = 'heading' AND o_level <> n_level", flat=False, **_n, grp=2),
        _row("changed_link_target", "content", "error", _BASE, "'Link target changed from ''' || o_raw || ''' to ''' || n_raw || ''''", "pairs WHERE block = 'link' AND o_raw <> n_raw", flat=False, **_n, grp=2),
        _row("CASE block WHEN 'link' THEN 'missing_link' ELSE 'missing_text' END", "content", "error", "0.9 * " + _CHROME("landmark"), "CASE block WHEN 'link' THEN 'Link removed: ''' || coalesce(text, href, '') ELSE 'Content removed: ''' || coalesce(text, '') END || ''''", "missing m WHERE NOT (block = 'text' AND EXISTS (FROM old_nodes l WHERE l.page_id = m.page_id AND l.kind = 'link' AND lower(l.text) = lower(m.text)))", flat=False, **_node, seq_old="seq", grp=2),
        _row("broken_link", "content", "error", "0.98", "'Broken link: ' || href || ' returned 404'", "first_link WHERE page_id % 41 = 1", **_node, seq_new="seq", grp=2),
        _row("component_swapped", "structure", "error", "confidence", "'Components swapped: \"' || a || '\" and \"' || b || '\" exchanged document order; \"' || b || '\" now renders before \"' || a || '\".'", "swapped", **_node, seq_old="seq", grp=3),
        _row("style_changed", "style", "warning", "0.9", "'color changed from rgb(0, 0, 0) to #ff0000' || CASE WHEN coalesce(o_heading, '') <> '' THEN ' near \"' || o_heading || '\"' ELSE '' END", "pairs WHERE block IN ('link', 'heading') AND page_id % 23 = 1", flat=False, **_o, seq_new="n_seq", prop="'color'", grp=4).replace("'warning' AS severity", "CASE WHEN band = 'uncertain' OR score < 0.75 THEN 'info' ELSE 'warning' END AS severity"),
        _row("style_changed", "style", "info", "0.9", "'letter-spacing changed from normal to 2px' || CASE WHEN coalesce(o_heading, '') <> '' THEN ' near \"' || o_heading || '\"' ELSE '' END", "pairs WHERE block IN ('link', 'heading') AND page_id % 23 = 1", flat=False, **_o, seq_new="n_seq", prop="'letter-spacing'", grp=4),
        _row("clickable_area_regressed", "visual", "error", "0.9", "'Clickable area regressed' || CASE WHEN coalesce(o_heading, '') <> '' THEN ' near \"' || o_heading || '\"' ELSE '' END || ': 100% -> 60% of sampled points hit (top overlap: div.cover)'", "pairs p WHERE band = 'matched' AND page_id % 43 = 1 AND EXISTS (FROM first_old f WHERE f.page_id = p.page_id AND f.seq = p.o_seq) AND EXISTS (FROM first_link f WHERE f.page_id = p.page_id AND f.seq = p.n_seq)", flat=False, **_o, seq_new="n_seq", grp=5),
        _row("pseudo_element_missing", "style", "warning", "0.9", "'::before pseudo-element is missing near \"main\"'", "meta WHERE page_id % 47 = 1", flat=False, landmark="'main'", prop="'::before'", grp=6).replace("AS DOUBLE) AS confidence", "AS DOUBLE) * 0.6 AS confidence"),
        _row("style_changed", "style", "warning", "0.9", "'::before.top changed from 1px to 9px'", "meta WHERE page_id % 47 = 2", flat=False, landmark="'main'", prop="'::before.top'", grp=6),
        _row("network_error", "technical", "error", "0.95", "'Network error: ' || o || CASE page_id % 29 WHEN 1 THEN '/app.js returned HTTP 500' ELSE '/missing.png returned HTTP unknown' END || ' on the new page'", "(SELECT page_id, regexp_extract(n_url, '^([a-z]+://[^/?#]*)', 1) AS o FROM meta) WHERE page_id % 29 IN (1, 2)", flat=False, grp=7),
        _row("console_error", "technical", "warning", "0.9", "'Console error: boom ' || page_id % 5", "meta WHERE page_id % 31 = 1", flat=False, grp=7),
        _row("accessibility_regression", "accessibility", "warning", "0.95", "'Accessibility regression: axe rule ''image-alt'' now fails (serious)'", "meta WHERE page_id % 37 = 1", flat=False, grp=8),
        _row("accessibility_improved", "accessibility", "info", "0.95", "'Accessibility improved: axe rule ''label'' no longer fails'", "meta WHERE page_id % 37 = 2", flat=False, grp=8),
        _row("url_trailing_slash", "hygiene", "error", "0.98", f"'URL has a trailing slash that should not be present: ' || {_NPATH}", f"meta WHERE regexp_matches({_NPATH}, '^/.*/$') AND {_NPATH} <> '/'", href=_PATH),
        _row("url_protocol_downgrade", "hygiene", "error", "0.98", "'Protocol downgrade: old=' || o_url || ' new=' || n_url", "meta WHERE starts_with(o_url, 'https:') AND starts_with(n_url, 'http:')", href=_PATH),
        _row("canonical_mismatch", "hygiene", "error", "0.98", "'Canonical URL mismatch: canonical resolves to https://example.org/other but final URL is ' || CASE WHEN " + _NPATH + " = '/' THEN n_url ELSE regexp_replace(n_url, '^([^?]*[^/?])/+(\\?.*)?$', '\\1\\2') END", "meta WHERE page_id % 53 = 1", href=_PATH),
        _row("locale_separator_invalid", "hygiene", "error", "0.98", "'Locale separator invalid in segment ''' || seg || ''': use hyphen not underscore'", "locale WHERE sep AND contains(seg, '_')", href=_PATH),
        _row("locale_case_invalid", "hygiene", "error", "0.98", "'Locale case invalid in segment ''' || seg || ''': expected ''' || CASE WHEN sep THEN lower(lg) || '-' || upper(rg) ELSE lower(seg) END || ''''", "locale WHERE lg <> lower(lg) OR (sep AND rg <> upper(rg))", href=_PATH),
        _row("locale_unknown", "hygiene", "error", "0.98", "'Unknown locale subtag ''' || CASE WHEN lower(lg) IN ('en', 'fr', 'de', 'es') THEN rg ELSE lg END || ''' in segment ''' || seg || ''''", "locale WHERE sep AND NOT (lower(lg) IN ('en', 'fr', 'de', 'es') AND upper(rg) IN ('US'))", href=_PATH),
        _row("url_protocol_downgrade", "hygiene", "error", "0.98", "'Per-link protocol downgrade: ' || href || ' should be https'", "new_nodes n JOIN meta USING (page_id) WHERE kind = 'link' AND starts_with(n_url, 'http:') AND starts_with(o_url, 'https:') AND EXISTS (FROM old_nodes o WHERE o.page_id = n.page_id AND o.raw_href = n.raw_href)", **_node, seq_new="seq"),
        _row("url_trailing_slash", "hygiene", "error", "0.98", "'URL has a trailing slash that should not be present: ' || regexp_extract(raw_href, '^([^?#]*)', 1)", "new_nodes n WHERE kind = 'link' AND regexp_matches(raw_href, '^/[^?#]*[^/?#][^?#]*/([?#].*)?$') AND NOT EXISTS (FROM old_nodes o WHERE o.page_id = n.page_id AND o.raw_href = n.raw_href)", **_node, seq_new="seq"),
        _row("url_redirect_chain", "hygiene", "error", "0.98", "'URL redirect chain has 2 hops: ' || href", "first_link WHERE page_id % 41 = 2", **_node, seq_new="seq"),
    ]
)

#: The same in DuckDB, by its own rules: tokens of the markup instead of a walk, multisets instead of an assignment.
SQL = (
    r"""
WITH RECURSIVE old_pages AS (SELECT page_id, url, html, 200 AS status FROM pages),
changed AS (
  SELECT page_id,
    CASE page_id % 11 WHEN 1 THEN regexp_replace(url, '^https:', 'http:') WHEN 2 THEN regexp_replace(url, '^([^?#]*)', '\1/')
      WHEN 3 THEN replace(url, '/en/', '/en_us/') WHEN 4 THEN replace(url, '/en/', '/en-us/') WHEN 5 THEN replace(url, '/en/', '/xx-ZZ/') ELSE url END AS url,
    CASE page_id % 7 WHEN 1 THEN regexp_replace(html, '(?s)<title>.*?</title>', '<title></title>')
      WHEN 2 THEN replace(replace(html, '</title>', ' v2</title>'), '</h1>', ' v2</h1>')
      WHEN 3 THEN regexp_replace(html, '(?s)^(.*?)<li>.*?</li>', '\1') WHEN 4 THEN regexp_replace(html, '(?s)^(.*?)href="/', '\1href="/x-')
      WHEN 5 THEN regexp_replace(html, '<(/?)h1>', '<\1h2>', 'g') WHEN 6 THEN regexp_replace(html, '(?s)<footer>.*?</footer>', '') ELSE html END AS html,
    CASE WHEN page_id % 13 = 1 THEN 404 ELSE 200 END AS status
  FROM pages
),
emptied AS (SELECT page_id, url, CASE WHEN page_id % 17 = 1 THEN regexp_replace(html, '(?s)<li>.*?</li>', '', 'g') ELSE html END AS html, status FROM changed),
shifted AS (SELECT page_id, url, CASE WHEN page_id % 19 = 1 THEN regexp_replace(html, '(?s)(<div class="ad">[^<]*</div>)(.*</article>)', '\2\1') ELSE html END AS html, status FROM emptied),
longer AS (SELECT page_id, url, CASE WHEN page_id % 35 = 0 THEN replace(html, '</article>', '<p>Added words.</p></article>') ELSE html END AS html, status FROM shifted),
new_pages AS (SELECT page_id, url, CASE WHEN page_id % 53 = 1 THEN replace(html, '</head>', '<link rel="canonical" href="https://example.org/other"></head>') ELSE html END AS html, status FROM longer),"""
    + ",".join(_SIDE.replace("{s}", s) for s in ("old", "new"))
    + r""",
meta AS (SELECT o.page_id, o.url AS o_url, n.url AS n_url, o.title AS o_title, n.title AS n_title, o.status AS o_status, n.status AS n_status FROM old_meta o JOIN new_meta n USING (page_id)),
o_ranked AS (SELECT *, count(*) OVER (PARTITION BY page_id, block, key) AS k, row_number() OVER (PARTITION BY page_id, block, key ORDER BY seq) AS r FROM old_keyed),
n_ranked AS (SELECT *, count(*) OVER (PARTITION BY page_id, block, key) AS k, row_number() OVER (PARTITION BY page_id, block, key ORDER BY seq) AS r FROM new_keyed),
equal_keys AS (
  SELECT o.page_id, o.block, o.seq AS o_seq, n.seq AS n_seq, CASE WHEN o.k = 1 AND n.k = 1 THEN 'identity' ELSE 'assignment' END AS stage, CASE WHEN o.k = 1 AND n.k = 1 THEN 1.0 ELSE 0.91 END::DOUBLE AS score
  FROM o_ranked o JOIN n_ranked n USING (page_id, block, key, r)
),
o_left AS (SELECT * FROM old_keyed o WHERE NOT EXISTS (FROM equal_keys e WHERE e.page_id = o.page_id AND e.o_seq = o.seq)),
n_left AS (SELECT * FROM new_keyed n WHERE NOT EXISTS (FROM equal_keys e WHERE e.page_id = n.page_id AND e.n_seq = n.seq)),
tried AS (
  SELECT o.page_id, o.block, o.seq AS o_seq, n.seq AS n_seq,
    CASE WHEN o.block = 'link' THEN 0.45::DOUBLE WHEN o.text IS NOT DISTINCT FROM n.text THEN 1.0::DOUBLE WHEN o.text IS NULL OR n.text IS NULL THEN 0.0::DOUBLE
      ELSE 0.5 * len(list_intersect(o.tokens, n.tokens)) / len(list_distinct(list_concat(o.tokens, n.tokens))) + 0.5 * (1 - (least(length(n.text), 200) - least(length(o.text), 200))::DOUBLE / least(length(n.text), 200)) END AS own
  FROM (SELECT *, {tokens} AS tokens FROM o_left) o JOIN (SELECT *, {tokens} AS tokens FROM n_left) n USING (page_id, block)
),
judged AS (SELECT *, CASE WHEN block = 'heading' AND own >= 0.85 THEN own ELSE round((0.7 * own + 0.3 * (0.5 + 0.2 * CASE block WHEN 'heading' THEN 0.7 * own + 0.3 ELSE 1.0 END)) * 1e9) / 1e9 END AS score FROM tried),
near AS (SELECT page_id, block, o_seq, n_seq, CASE WHEN block = 'heading' AND own >= 0.85 THEN 'identity' ELSE 'assignment' END AS stage, score FROM judged WHERE score >= 0.45),
all_pairs AS (FROM equal_keys UNION ALL FROM near),
pairs AS (
  SELECT p.*, CASE WHEN stage = 'identity' OR score >= 0.7 THEN 'matched' ELSE 'uncertain' END AS band, o.text AS o_text, n.text AS n_text, o.role AS o_role, n.role AS n_role, o.href AS o_href, n.href AS n_href, o.raw_href AS o_raw, n.raw_href AS n_raw,
    o.level AS o_level, n.level AS n_level, o.landmark AS o_landmark, n.landmark AS n_landmark, o.heading AS o_heading, n.heading AS n_heading
  FROM all_pairs p JOIN old_nodes o ON o.page_id = p.page_id AND o.seq = p.o_seq JOIN new_nodes n ON n.page_id = p.page_id AND n.seq = p.n_seq
),
missing AS (SELECT * FROM old_keyed o WHERE NOT EXISTS (FROM all_pairs p WHERE p.page_id = o.page_id AND p.o_seq = o.seq)),
added AS (SELECT * FROM new_keyed n WHERE NOT EXISTS (FROM all_pairs p WHERE p.page_id = n.page_id AND p.n_seq = n.seq)),
lost_h1 AS (SELECT * FROM old_nodes o WHERE level = 1 AND NOT EXISTS (FROM new_nodes n WHERE n.page_id = o.page_id AND n.level = 1) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY seq) = 1),
first_link AS (SELECT * FROM new_nodes WHERE kind = 'link' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY seq) = 1),
first_old AS (SELECT * FROM old_nodes WHERE kind = 'link' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY seq) = 1),
ordered AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY o_seq) - 1 AS old_rank, row_number() OVER (PARTITION BY page_id ORDER BY n_seq) - 1 AS new_rank FROM pairs WHERE stage = 'identity'),
runs AS (
  SELECT *, sum(s) OVER (PARTITION BY page_id ORDER BY old_rank ROWS UNBOUNDED PRECEDING) - 1 AS run
  FROM (SELECT *, CASE WHEN new_rank = lag(new_rank) OVER (PARTITION BY page_id ORDER BY old_rank) + 1 THEN 0 ELSE 1 END AS s FROM ordered)
),
run_order AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY new_start) - 1 AS sigma FROM (SELECT page_id, run, min(new_rank) AS new_start, sum(score) AS total, count(*) AS size, arg_min(struct_pack(text := o_text, href := o_href, role := o_role, landmark := o_landmark, heading := o_heading, seq := o_seq), (block <> 'heading', old_rank)) AS rep FROM runs GROUP BY page_id, run)),
swapped AS (
  SELECT a.page_id, a.rep.text AS text, a.rep.href AS href, a.rep.role AS role, a.rep.landmark AS landmark, a.rep.heading AS heading, a.rep.seq AS seq, round((a.total + b.total) / (a.size + b.size) * 10000) / 10000 AS confidence, {label_a} AS a, {label_b} AS b
  FROM run_order a JOIN run_order b ON a.page_id = b.page_id AND a.sigma = b.run AND b.sigma = a.run AND a.run < b.run
),
segments AS (
  SELECT *, list_filter(list_filter(string_split({npath}, '/'), lambda s: s <> '')[1:2],
    lambda s: regexp_matches(s, '^([A-Za-z]{2,3})([-_])([A-Za-z]{2}|[0-9]{3})$') OR lower(s) IN ('en', 'fr', 'de', 'es'))[1] AS seg FROM meta
),
locale AS (SELECT *, regexp_matches(seg, '[-_]') AS sep, regexp_extract(seg, '^([A-Za-z]+)', 1) AS lg, regexp_extract(seg, '[-_](.*)$', 1) AS rg FROM segments WHERE seg IS NOT NULL),
every AS (
  """.replace("{tokens}", "list_distinct(list_filter(string_split(" + LOW.format("substr(coalesce(text, ''), 1, 200)") + ", ' '), lambda t: t <> ''))").replace("{npath}", _NPATH).replace("{label_a}", _LABEL("coalesce(a.rep.text, a.rep.href, '')")).replace("{label_b}", _LABEL("coalesce(b.rep.text, b.rep.href, '')"))
    + _EVERY
    + r"""
),
decided AS (SELECT * FROM every e WHERE type = 'status_code_mismatch' OR NOT EXISTS (FROM every s WHERE s.page_id = e.page_id AND s.type = 'status_code_mismatch')),
worth AS (
  SELECT *, CASE severity WHEN 'critical' THEN 8.0 WHEN 'error' THEN 4.0 WHEN 'warning' THEN 2.0 ELSE 1.0 END::DOUBLE * confidence
      * CASE WHEN coalesce(nullif(text, ''), nullif(href, '')) IS NOT NULL THEN 1.0 WHEN coalesce(nullif(landmark, ''), nullif(heading, '')) IS NOT NULL THEN 0.7 ELSE 0.4 END::DOUBLE AS fix_value
  FROM decided
),
issues AS (
  SELECT * EXCLUDE (base_id, n), CASE WHEN n > 1 THEN base_id || '-' || n ELSE base_id END AS id
  FROM (SELECT *, row_number() OVER (PARTITION BY page_id, base_id ORDER BY seq_old NULLS LAST, seq_new NULLS LAST, grp) AS n FROM worth)
)
"""
)
