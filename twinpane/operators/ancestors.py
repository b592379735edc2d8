"""Ancestors that carry style: paired by what they contain, then by how alike they look.

Two ancestors can only be the same element if they contain the same paired nodes; of those, the most alike by style
are taken first. Chains are (pair_id, viewport, side, node_id, pos, ancestor_id), ancestors (..., id, tag).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import css
from ..functions.text import SEPARATOR, round4
from .channels import PAIR, sides

LEAST_SIMILARITY, TAG_BONUS = 0.6, 0.05
#: The properties that are compared (fixed values).
STYLE_PROPERTIES = [
    "color",
    "background-color",
    "background-image",
    "border",
    "border-radius",
    "box-shadow",
    "font-family",
    "font-size",
    "font-weight",
    "line-height",
    "letter-spacing",
    "text-align",
    "padding-top",
    "padding-right",
    "padding-bottom",
    "padding-left",
    "margin-top",
    "margin-right",
    "margin-bottom",
    "margin-left",
    "display",
    "position",
    "opacity",
    "flex-direction",
    "justify-content",
    "align-items",
    "gap",
    "grid-template-columns",
    "text-decoration-line",
    "z-index",
    "max-width",
    "pointer-events",
]


def contents(pairs: DataFrame, chains: DataFrame, nodes: DataFrame, side: str) -> DataFrame:
    """(ancestor, key): a hash of the paired nodes, by their new ids, that an ancestor contains; nodes are no ancestors."""
    links = sides(chains, side, {"node_id": f"{side}_id", "ancestor_id": "ancestor"})
    own = sides(nodes, side, {"id": "ancestor"})
    held = links.join(own, [*PAIR, "ancestor"], "left_anti").join(pairs.select(*PAIR, *{f"{side}_id", "new_id"}), [*PAIR, f"{side}_id"])
    key = F.sha2(F.array_join(F.array_sort(F.collect_set("new_id")), SEPARATOR), 256)
    return held.groupBy(*PAIR, "ancestor").agg(key.alias("key"))


def style_similarity(candidates: DataFrame, styles: DataFrame, extra: list[str]) -> DataFrame:
    """candidates (pair_id, viewport, old_id, new_id, *extra) with `base`: the share of common properties that are equal."""
    known = styles.where(F.col("prop").isin(*STYLE_PROPERTIES))
    old = sides(known, "old", {"element_id": "old_id", "prop": "prop", "value": "old_value"})
    new = sides(known, "new", {"element_id": "new_id", "prop": "prop", "value": "new_value"})
    a, b = (css.normalize_value(F.col("prop"), F.col(f"{s}_value")) for s in ("old", "new"))
    joined = candidates.join(old, [*PAIR, "old_id"]).join(new, [*PAIR, "new_id", "prop"])
    return joined.groupBy(*PAIR, "old_id", "new_id", *extra).agg((F.count_if(css.values_equal(a, b)) / F.count("*")).alias("base"))


def _greedy(frame: pd.DataFrame) -> pd.DataFrame:
    old, new, kept = set(), set(), []
    for r in frame.sort_values(["rounded", "old_id", "new_id"], ascending=[False, True, True]).itertuples():
        if r.old_id not in old and r.new_id not in new:
            old.add(r.old_id)
            new.add(r.new_id)
            kept.append(r.Index)
    return frame.loc[kept, [*PAIR, "old_id", "new_id", "base", "bonus"]]


def ancestor_pairs(pairs: DataFrame, chains: DataFrame, nodes: DataFrame, ancestors: DataFrame, styles: DataFrame) -> DataFrame:
    """(pair_id, viewport, old_id, new_id, similarity, base, bonus), one to one.

    A group of candidates is what contains the same nodes of one page: at most as many as the page is deep on either side.
    """
    side = lambda s: contents(pairs, chains, nodes, s).withColumnRenamed("ancestor", f"{s}_id").join(sides(ancestors, s, {"id": f"{s}_id", "tag": f"{s}_tag"}), [*PAIR, f"{s}_id"])
    bonus = F.when(F.col("old_tag") == F.col("new_tag"), TAG_BONUS).otherwise(0.0)
    candidates = side("old").join(side("new"), [*PAIR, "key"]).withColumn("bonus", bonus).drop("old_tag", "new_tag")
    scored = style_similarity(candidates, styles, ["key", "bonus"])
    total = F.col("base") + F.col("bonus")
    able = scored.where(total >= LEAST_SIMILARITY).withColumn("rounded", round4(total))
    found = able.groupBy(*PAIR, "key").applyInPandas(_greedy, "pair_id string, viewport string, old_id string, new_id string, base double, bonus double")
    return found.select(*PAIR, "old_id", "new_id", round4(F.least(total, F.lit(1.0))).alias("similarity"), round4(F.col("base")).alias("base"), "bonus")
