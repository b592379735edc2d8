"""Mixing sources to target weights by hash-threshold histograms (operator 6; DataFrame operations only).

Every row has a 48-bit hash of its id. A source gets whole copies of all its rows as long as its target allows, and
of the rest the rows whose hash lies under a threshold. The threshold is found without sorting rows: words are summed
by source and the first 12 bits of the hash, running sums over these few sums find the bucket in which the budget
ends, and only the rows of that bucket are summed by the next 12 bits, and so on (nested thresholds). At the last
level a bucket is one hash value; it is taken if that comes nearer to the target. Reruns take the same rows.

The thresholds are one row a source. They are written to the shared folder and read back, so that Spark knows their
size: it broadcasts them only under its threshold and else joins by sorting, where AQE splits a hot source.

Defined results: null text is empty; rows without words take nothing; a null source is a source of its own, last in
order; a null id hashes as the empty text; rows with the same id are taken or left together, each with its own size.
An empty table gives an empty result. Columns of the input with the names of the results give way to them. The targets
are computed over one row a source, in one task: sources are named parts of a mix, not hosts by the million.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table, without

WEIGHTS = (5, 2, 1)
BITS, LEVELS = 12, 4
RESULTS = ["size", "source_size", "target", "taken"]


def word_count(text: str | Column) -> Column:
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def row_hash(row_id: str) -> Column:
    """48 bits, the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(row_id).cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target, copies, need) of the rows (source, size).

    Sources in code point order, null last, weigh `weights` in turn and share 150 % of all words; none gets more than
    twice its own, and the excess goes to the others by weight. All sums are integers; a target is one division.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (rank % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("rank", rank).withColumn("weight", weight)
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    total = F.sum("source_size").over(every)
    before = F.coalesce(F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = (3 * total - 4 * before) * F.col("weight") > 4 * F.col("source_size") * left
    filled = ranked.withColumn("total", total).withColumn("over", over)
    filled = filled.withColumn("full", F.min(F.col("over").cast("int")).over(fill.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    capped = F.sum(F.when(F.col("full"), F.col("source_size")).otherwise(0)).over(every)
    rest = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every)
    shared = filled.withColumn("share", (3 * F.col("total") - 4 * capped) * F.col("weight")).withColumn("of", 2 * rest)
    target = F.when(F.col("full"), (2 * F.col("source_size")).cast("double")).otherwise(F.col("share").cast("double") / F.col("of").cast("double"))
    out = shared.withColumn("target", F.when(F.col("source_size") == 0, 0.0).otherwise(target))
    copies = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.least(F.lit(2), F.floor(F.col("target") / F.col("source_size")))).cast("long")
    return out.select("source", "source_size", "target", copies.alias("copies"), (F.col("target") - copies * F.col("source_size")).alias("need"))


def thresholds(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target, copies, threshold) for the rows (source, size, hash)."""
    goals = stored(targets(sized, weights), "mix-targets")
    at = goals.select("source", "need", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("base"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        rows = sized.select("source", "size", F.shiftright("_mix_hash", shift + BITS).alias("above"), F.shiftright("_mix_hash", shift).alias("bucket"))
        a, b = rows.alias("a"), at.alias("b")
        inside = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.above") == F.col("b.prefix")))
        sums = inside.groupBy("a.source", "b.need", "b.base", "a.bucket").agg(F.sum("a.size").alias("words"))
        upto = F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        ends = sums.withColumn("upto", upto).where(F.col("upto") > F.col("need"))
        first = ends.groupBy("source", "need").agg(F.min(F.struct("bucket", "words", "upto")).alias("x"))
        at = stored(first.select("source", "need", F.col("x.bucket").alias("prefix"), (F.col("x.upto") - F.col("x.words")).alias("base"), F.col("x.upto").alias("upto")), f"mix-level{level}")
        last, at = at, at.drop("upto")
    nearer = F.col("l.need") - F.col("l.base") >= F.col("l.upto") - F.col("l.need")
    out = goals.alias("g").join(last.alias("l"), F.col("g.source").eqNullSafe(F.col("l.source")), "left")
    return stored(out.select("g.source", "g.source_size", "g.target", "g.copies", (F.col("l.prefix") + nearer.cast("long")).alias("threshold")), "mix-thresholds")


def take(sized: DataFrame, cuts: DataFrame) -> DataFrame:
    """The columns of sized but `hash`, with source_size, target and taken of each row."""
    s, c = sized.drop("source_size", "target", "taken").alias("s"), cuts.alias("c")
    part = F.when(F.col("s._mix_hash") < F.col("c.threshold"), F.col("c.copies") + 1).otherwise(F.col("c.copies"))
    kept = [F.col(f"s.{x}") for x in s.columns if x != "_mix_hash"]
    return s.join(c, F.col("s.source").eqNullSafe(F.col("c.source"))).select(*kept, "c.source_size", "c.target", (F.col("s.size") * part).alias("taken"))


def sized(docs: DataFrame, *, row_id: str = "doc_id", text: str = "text", source: str = "source", keep: list[str]) -> DataFrame:
    """The columns `keep` and source, size and hash of every row."""
    kept = [c for c in keep if c not in ("source", "_mix_hash", *RESULTS)]
    return docs.select(*kept, F.col(source).alias("source"), word_count(text).alias("size"), row_hash(row_id).alias("_mix_hash"))


def mix(docs: DataFrame, *, row_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """docs with size, source_size, target and taken; taken words over size words is the number of copies of a row."""
    narrow = stored(sized(docs, row_id=row_id, text=text, source=source, keep=[]), "mix-sizes")
    cuts = thresholds(narrow, weights)
    return take(sized(docs, row_id=row_id, text=text, source=source, keep=without(docs, ["_mix_hash", *RESULTS])), cuts)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    narrow = stored(sized(docs, keep=["doc_id"]), "mix-sizes")
    return take(narrow, thresholds(narrow)).select("doc_id", *RESULTS)


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS hash
  FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM by_source
), filled AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining
  FROM ranked WINDOW w AS (ORDER BY CAST(source_size AS DOUBLE) / weight, rank)
), flagged AS (
  SELECT *, min(CAST((3 * total - 4 * before) * weight > 4 * source_size * remaining AS INT))
              OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, rank ROWS UNBOUNDED PRECEDING) = 1 AS full_up
  FROM filled
), shared AS (
  SELECT *, sum(CASE WHEN full_up THEN source_size ELSE 0 END) OVER () AS capped, sum(CASE WHEN full_up THEN 0 ELSE weight END) OVER () AS rest
  FROM flagged
), goals AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 WHEN full_up THEN CAST(2 * source_size AS DOUBLE)
         ELSE CAST((3 * total - 4 * capped) * weight AS DOUBLE) / CAST(2 * rest AS DOUBLE) END AS target
  FROM shared
), copied AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(2, CAST(floor(target / source_size) AS BIGINT)) END AS copies FROM goals
), needed AS (
  SELECT *, target - copies * source_size AS need FROM copied
), sums AS (
  SELECT source, hash, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY hash) AS upto FROM sized GROUP BY source, hash
), ends AS (
  SELECT n.source, min(s.hash) AS hash, arg_min(s.upto, s.hash) AS upto, arg_min(s.words, s.hash) AS words, any_value(n.need) AS need
  FROM needed n JOIN sums s ON n.source IS NOT DISTINCT FROM s.source AND s.upto > n.need GROUP BY n.source
), cuts AS (
  SELECT n.source, n.source_size, n.target, n.copies,
         e.hash + CASE WHEN e.need - (e.upto - e.words) >= e.upto - e.need THEN 1 ELSE 0 END AS threshold
  FROM needed n LEFT JOIN ends e ON n.source IS NOT DISTINCT FROM e.source
)
SELECT s.doc_id, s.size, c.source_size, CAST(c.target AS DOUBLE) AS target,
       CAST(s.size * (c.copies + CASE WHEN s.hash < c.threshold THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source
"""
