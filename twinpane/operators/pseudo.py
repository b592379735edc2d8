"""Pseudo-elements: paints of ::before and ::after that are gone or look different.

Entries are (pair_id, viewport, side, owner_key, tier, node_id, selector, landmark, before, after), the last two maps of
style values, null where nothing is painted. An owner is a node, an ancestor, or known by its selector only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import css
from .channels import PAIR, sides

SLOTS = {"before": "::before", "after": "::after"}
MISSING, CHANGED, UNMATCHED = 0.9, 0.9, 0.6
#: The properties that are compared (fixed values).
PROPERTIES = ["content", "position", "width", "height", "background-color", "background-image", "border", "border-radius", "top", "right", "bottom", "left", "z-index", "display", "opacity"]


def aligned(entries: DataFrame, pairs: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Old painted slots (tier, owner_key, slot, old_style) with the owner's key on the new side, and the style there.

    Owners that are nodes or ancestors without a partner drop out; one known by its selector stays, `found` tells whether
    the new side has it. Pages without any entry on the new side drop out whole.
    """
    names = {c: c for c in ("owner_key", "tier", "node_id", "selector", "landmark", "before", "after")}
    old = sides(entries, "old", names).join(entries.where("side = 'new'").select(*PAIR).distinct(), PAIR, "left_semi")
    to = lambda frame, own: frame.select(*PAIR, F.col("old_id").alias(own), F.col("new_id").alias("new_key"))
    owners = reduce(
        DataFrame.unionByName,
        [
            old.where("tier = 'node'").join(to(pairs.where("band = 'matched'"), "node_id"), [*PAIR, "node_id"]),
            old.where("tier = 'ancestor'").join(to(ancestors, "owner_key"), [*PAIR, "owner_key"]),
            old.where("tier = 'selector'").withColumn("new_key", F.col("owner_key")),
        ],
    )
    new = sides(entries, "new", {"owner_key": "new_key", "before": "new_before", "after": "new_after"}).withColumn("found", F.lit(True))
    both = owners.join(new, [*PAIR, "new_key"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    slots = F.explode(F.array(*(F.struct(F.lit(label).alias("slot"), F.col(s).alias("old_style"), F.col(f"new_{s}").alias("new_style")) for s, label in SLOTS.items()))).alias("x")
    return both.select(*PAIR, "tier", "owner_key", "new_key", "selector", "landmark", "found", slots).select("*", "x.*").drop("x").where("old_style is not null")


def pseudo_issues(entries: DataFrame, pairs: DataFrame, ancestors: DataFrame, truncated: DataFrame) -> DataFrame:
    """(pair_id, viewport, owner_key, tier, slot, type, prop, old_value, new_value, severity, confidence).

    truncated: the pages (pair_id, viewport) of which either side's entries are cut; there a missing paint is sure only
    where its owner is a node.
    """
    slots = aligned(entries, pairs, ancestors)
    cut = truncated.select(*PAIR).distinct().withColumn("cut", F.lit(True))
    none = F.lit(None).cast("string")
    unsure = F.col("cut").isNotNull() & (F.col("tier") != "node")
    gone = slots.where("new_style is null").join(cut, PAIR, "left")
    missing = gone.select(*PAIR, "owner_key", "tier", "slot", F.lit("pseudo_element_missing").alias("type"), none.alias("prop"), none.alias("old_value"), none.alias("new_value"), F.when(unsure, "info").otherwise("warning").alias("severity"), F.when(F.col("found") | (F.col("tier") != "selector"), MISSING).otherwise(F.round(F.lit(MISSING * UNMATCHED), 4)).alias("confidence"))
    both = slots.where("new_style is not null").select(*PAIR, "owner_key", "tier", "slot", "new_style", F.explode("old_style").alias("prop", "was"))
    values = both.where(F.col("prop").isin(*PROPERTIES)).withColumn("now", F.try_element_at("new_style", F.col("prop"))).where("was is not null and now is not null")
    a, b = (css.normalize_value(F.col("prop"), F.col(c)) for c in ("was", "now"))
    a, b = (css.canonical(F.col("prop"), x, none) for x in (a, b))
    changed = values.where(~css.values_equal(a, b)).select(*PAIR, "owner_key", "tier", "slot", F.lit("style_changed").alias("type"), F.concat_ws(".", "slot", "prop").alias("prop"), F.col("was").alias("old_value"), F.col("now").alias("new_value"), F.lit("warning").alias("severity"), F.lit(CHANGED).alias("confidence"))
    return missing.unionByName(changed)
