"""Order of paired components: ranks, blocks that moved together, swaps, the longest run in order."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


LEAST_MOVE = 2


def ranks(pairs: DataFrame) -> DataFrame:
    """Pairs (group, id, old_pos, new_pos) with their ranks on either side, from 0."""
    rank = lambda c: F.row_number().over(Window.partitionBy("grp").orderBy(c, "id")) - 1
    return pairs.withColumn("old_rank", rank("old_pos")).withColumn("new_rank", rank("new_pos"))


def blocks(ranked: DataFrame) -> DataFrame:
    """Runs of neighbours on the old side that are neighbours in the same order on the new side: gaps and islands."""
    w = Window.partitionBy("grp").orderBy("old_rank")
    starts = F.when(F.col("new_rank") == F.lag("new_rank").over(w) + 1, 0).otherwise(1)
    island = F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return ranked.withColumn("starts", starts).withColumn("block", island).drop("starts")


def block_order(blocked: DataFrame) -> DataFrame:
    """(grp, block, size, old_start, new_start, sigma): sigma is the block's place on the new side."""
    found = blocked.groupBy("grp", "block").agg(F.count("*").alias("size"), F.min("old_rank").alias("old_start"), F.min("new_rank").alias("new_start"))
    return found.withColumn("sigma", F.row_number().over(Window.partitionBy("grp").orderBy("new_start", "old_start")) - 1)


def swaps(ordered: DataFrame) -> DataFrame:
    """Pairs of blocks that stand in each other's place."""
    a, b = ordered.alias("a"), ordered.alias("b")
    other = (F.col("a.grp") == F.col("b.grp")) & (F.col("a.sigma") == F.col("b.block")) & (F.col("b.sigma") == F.col("a.block")) & (F.col("a.block") < F.col("b.block"))
    return a.join(b, other).select("a.grp", F.col("a.block").alias("first_block"), F.col("b.block").alias("second_block"))


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence (piles with back links)."""
    tops: list[int] = []
    places: list[int] = []
    back = [-1] * len(values)
    for i, x in enumerate(values):
        at = bisect_left(tops, x)
        back[i] = places[at - 1] if at else -1
        tops[at : at + 1] = [x]
        places[at : at + 1] = [i]
    out, i = [], places[-1] if places else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def moves(order: list[int], least: int = LEAST_MOVE) -> dict:
    """Of new ranks in old order: blocks that swapped places, then blocks outside the longest run that moved more than `least`, with the stable ones around them."""
    cuts = [0, *(i for i in range(1, len(order)) if order[i] != order[i - 1] + 1), len(order)]
    blocks = [{"start": a, "size": b - a, "at": order[a]} for a, b in zip(cuts, cuts[1:])]
    place = {i: r for r, i in enumerate(sorted(range(len(blocks)), key=lambda i: (blocks[i]["at"], blocks[i]["start"])))}
    swapped = [(i, place[i]) for i in range(len(blocks)) if place[i] > i and place[place[i]] == i]
    rest = [i for i in range(len(blocks)) if i not in {x for pair in swapped for x in pair}]
    stable = set(longest_increasing([place[i] for i in rest])) if len(rest) > 1 else set(range(len(rest)))
    moved = []
    for k, i in enumerate(rest):
        if k not in stable and abs(blocks[i]["start"] - blocks[i]["at"]) > least:
            before = next((rest[j] for j in range(k - 1, -1, -1) if j in stable), None)
            after = next((rest[j] for j in range(k + 1, len(rest)) if j in stable), None)
            moved.append({"block": blocks[i], "before": None if before is None else blocks[before], "after": None if after is None else blocks[after]})
    return {"swaps": [{"a": blocks[i], "b": blocks[j]} for i, j in swapped], "moves": moved}


def stable_blocks(ordered: DataFrame) -> DataFrame:
    """ordered with `stable`: does the block belong to the longest run of blocks in order? One group is one page."""

    def mark(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        keep = set(longest_increasing(frame["sigma"].tolist()))
        return frame.assign(stable=[i in keep for i in range(len(frame))])

    return ordered.groupBy("grp").applyInPandas(mark, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema) + ", stable boolean")
