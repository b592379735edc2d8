"""Capture bundles (JSON, one document a file) as normalised tables, and the small inputs beside them.

The schema is declared, never inferred. A missing required field is an error; channels of later versions are null where a
bundle lacks them, which is not the same as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ANCHORS = "struct<text:string,role:string,href:string,alt:string,ariaLabel:string,nearestHeading:string,landmark:string,ordinalInLandmark:int>"
NODE = f"struct<id:string,kind:string,role:string,text:string,accName:string,href:string,imageAlt:string,bbox:array<int>,seqIndex:int,anchors:{ANCHORS},cssSelector:string,rawHref:string,src:string,naturalWidth:int,naturalHeight:int,loaded:boolean,headingLevel:int,hasOnclick:boolean>"
INVENTORY = "struct<headingCount:int,imageCount:int,landmarkCount:int>"
DETERMINISM = f"struct<animationsDisabled:string,reducedMotion:string,timeFrozen:string,randomStubbed:string,fontsReady:string,imagesDecoded:string,lazyLoadPass:string,settled:string,settle:string,hitTestProbe:string,quiescence:string,settleScrollIneffective:boolean,settleGrowthCapped:boolean,clicked:array<string>,hidden:array<string>,masked:array<string>,retriedWithoutTimeFreeze:boolean,integrity:struct<pre:{INVENTORY},post:{INVENTORY}>>"
PAGE = f"struct<url:string,finalUrl:string,redirectChain:array<string>,statusCode:int,title:string,metaDescription:string,canonical:string,lang:string,pageHeight:int,nodes:array<{NODE}>,landmarks:array<string>,landmarkRects:array<struct<path:string,role:string,heading:string,bbox:array<int>>>,network:struct<requests:array<struct<url:string,status:int,type:string,failed:boolean>>>,console:array<struct<level:string,text:string>>,a11y:struct<violations:array<struct<id:string,impact:string,helpUrl:string,nodes:array<struct<target:array<string>,html:string>>>>>,linkProbes:array<struct<url:string,redirectChain:array<string>,finalUrl:string,status:int,skipped:string,error:string>>>"
BUNDLE = f"schemaVersion string, capturedAt string, viewport struct<name:string,width:int,height:int,dsf:double>, environment struct<os:string,chromiumBuild:string,playwright:string,dsf:double>, determinism {DETERMINISM}, page {PAGE}, computedStyles map<string,map<string,string>>, styleCandidates struct<ancestors:array<struct<id:string,tag:string,bbox:array<int>,depth:int,cssSelector:string,anchors:{ANCHORS}>>,chains:map<string,array<string>>,budget:int,truncated:boolean,droppedCount:int>, hitTests map<string,struct<status:string,skipReason:string,gridSize:int,points:array<struct<o:string,winner:string>>>>, pseudoElements map<string,struct<ownerTier:string,ownerNodeId:string,ownerSelector:string,landmark:string,before:map<string,string>,after:map<string,string>>>, pseudoTruncated string"
KEY = ["pair_id", "viewport", "side"]


def read_bundles(spark: SparkSession, paths: str | list[str], pair_id: Column | None = None, side: Column | None = None) -> DataFrame:
    """Bundles with pair_id and side; by default from the last two folders of the file's path: .../pair/side/file.json."""
    file = F.input_file_name()
    raw = spark.read.schema(BUNDLE).option("multiLine", True).option("mode", "FAILFAST").json(paths)
    part = lambda n: F.element_at(F.split(file, "/"), n)
    found = raw.select((pair_id if pair_id is not None else part(-3)).alias("pair_id"), (side if side is not None else part(-2)).alias("side"), "*")
    required = F.col("schemaVersion").isNotNull() & F.col("viewport.name").isNotNull() & F.col("page.nodes").isNotNull()
    return found.where(F.when(required, True).otherwise(F.raise_error(F.concat(F.lit("a bundle lacks a required field: "), file)).cast("boolean")))


def _key(*more) -> list:
    return ["pair_id", F.col("viewport.name").alias("viewport"), "side", *more]


def _items(bundles: DataFrame, column: str, with_position: bool = True) -> DataFrame:
    found = bundles.select(*_key(F.posexplode(column).alias("pos", "x")))
    return found.select(*KEY, *(["pos"] if with_position else []), "x.*")


def captures(bundles: DataFrame) -> DataFrame:
    p = F.col("page")
    return bundles.select(*_key("environment", "determinism", p["finalUrl"].alias("url"), p["redirectChain"].alias("redirect_chain"), p["statusCode"].alias("status"), p["title"].alias("title"), p["metaDescription"].alias("meta_description"), p["canonical"].alias("canonical"), p["lang"].alias("lang"), p["pageHeight"].alias("page_height"), F.col("hitTests").isNotNull().alias("has_hit_tests"), F.col("pseudoTruncated").isNotNull().alias("pseudo_truncated")))


def nodes(bundles: DataFrame) -> DataFrame:
    return _items(bundles, "page.nodes").withColumn("bbox", _box("bbox"))


def _box(column: str) -> Column:
    at = lambda i: F.get(F.col(column), F.lit(i))
    return F.struct(at(0).alias("x"), at(1).alias("y"), at(2).alias("w"), at(3).alias("h"))


def requests(bundles: DataFrame) -> DataFrame:
    return _items(bundles, "page.network.requests")


def console(bundles: DataFrame) -> DataFrame:
    return _items(bundles, "page.console")


def violations(bundles: DataFrame) -> DataFrame:
    return _items(bundles, "page.a11y.violations").withColumnRenamed("id", "rule_id")


def link_probes(bundles: DataFrame) -> DataFrame:
    return _items(bundles, "page.linkProbes")


def landmark_rects(bundles: DataFrame) -> DataFrame:
    return _items(bundles, "page.landmarkRects").withColumn("bbox", _box("bbox"))


def styles(bundles: DataFrame) -> DataFrame:
    """(element_id, prop, value) rows."""
    one = bundles.select(*_key(F.explode("computedStyles").alias("element_id", "m")))
    return one.select(*KEY, "element_id", F.explode("m").alias("prop", "value"))


def chains(bundles: DataFrame) -> DataFrame:
    """(node_id, pos, ancestor_id), nearest first."""
    one = bundles.select(*_key(F.explode("styleCandidates.chains").alias("node_id", "c")))
    return one.select(*KEY, "node_id", F.posexplode("c").alias("pos", "ancestor_id"))


def ancestors(bundles: DataFrame) -> DataFrame:
    """Elements above the nodes whose styles were captured: id, tag, box, depth, selector, anchors."""
    return _items(bundles, "styleCandidates.ancestors").withColumn("bbox", _box("bbox"))


def pseudo(bundles: DataFrame) -> DataFrame:
    """Owners of painted pseudo-elements, with the styles of either slot."""
    one = bundles.select(*_key(F.explode("pseudoElements").alias("owner_key", "e")))
    return one.select(*KEY, "owner_key", F.col("e.ownerTier").alias("tier"), F.col("e.ownerNodeId").alias("node_id"), F.col("e.ownerSelector").alias("selector"), "e.landmark", "e.before", "e.after")


def hit_points(bundles: DataFrame) -> DataFrame:
    """(node_id, status, idx, o, winner) of the sampled elements."""
    one = bundles.select(*_key(F.explode("hitTests").alias("node_id", "h")))
    return one.select(*KEY, "node_id", F.col("h.status").alias("status"), F.posexplode("h.points").alias("idx", "p")).select(*KEY, "node_id", "status", "idx", "p.*")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Accepted ids; entries without one are skipped."""
    return spark.read.schema("id string, note string").option("multiLine", True).json(path).where("id is not null").dropDuplicates(["id"])


def read_severity_map(spark: SparkSession, path: str, types: list[str], properties: list[str]) -> DataFrame:
    """(scope, key, severity) of a map of types and properties; anything outside the vocabularies is an error."""
    raw = spark.read.schema("types map<string,string>, properties map<string,string>").option("multiLine", True).json(path)
    rows = raw.select(F.lit("types").alias("scope"), F.explode("types").alias("key", "severity")).unionByName(raw.select(F.lit("properties").alias("scope"), F.explode("properties").alias("key", "severity")))
    known = F.when(F.col("scope") == "types", F.col("key").isin(*types)).otherwise(F.col("key").isin(*properties)) & F.col("severity").isin("info", "warning", "error", "critical")
    return rows.where(F.when(known, True).otherwise(F.raise_error(F.concat(F.lit("unknown entry of the severity map: "), F.col("key"))).cast("boolean")))


def write_bundles(bundles: DataFrame, folder: str) -> None:
    """Captures as JSON below folder/pair_id=.../side=.../viewport=..., one document a file's line."""
    inner = [c for c in bundles.columns if c not in ("pair_id", "side")]
    rows = bundles.select("pair_id", "side", F.col("viewport.name").alias("view"), F.to_json(F.struct(*inner)).alias("value"))
    rows.repartition("pair_id", "side", "view").write.partitionBy("pair_id", "side", "view").text(folder)
