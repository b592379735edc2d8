"""Pairing the nodes of two sides: unique keys, mutual best scores, bounded assignment, missing and added nodes.

Nodes are (page_id, block, key, node_id, ...); every join is an equi-join on page and block, so pages spread evenly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower

IDENTITY_FLOOR, TIE_MARGIN, MATCH_FLOOR, NO_MATCH = 0.85, 0.05, 0.70, 0.45
ASSIGNMENT_MOST = 128


def block(kind: Column) -> Column:
    return F.when(kind.isin("link", "button"), "link").when(kind.isin("heading", "image", "field", "form", "text"), kind).otherwise("generic")


def exact_key(kind: Column, text: Column, href: Column, level: Column, role: Column, name: Column) -> Column:
    """What makes two nodes of a block the same: fields joined by bars; texts by ASCII lower case, references as they are."""
    e = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    low = lambda c: ascii_lower(e(c))
    b = block(kind)
    return (
        F.when(b == "heading", F.concat_ws("|", low(text), e(level)))
        .when(b == "link", F.concat_ws("|", e(href), low(text), low(name)))
        .when(b == "image", F.concat_ws("|", e(href), low(name)))
        .when(b.isin("field", "form"), F.concat_ws("|", low(name), low(role)))
        .otherwise(low(text))
    )


def keyed(nodes: DataFrame) -> DataFrame:
    c = {x: F.col(x) if x in nodes.columns else F.lit(None) for x in ("kind", "text", "href", "level", "role", "name")}
    name = F.coalesce(c["name"], c["text"])
    return nodes.withColumn("block", block(c["kind"])).withColumn("key", exact_key(c["kind"], c["text"], c["href"], c["level"], c["role"], name)).withColumn("node_id", F.concat_ws("_", "kind", "seq"))


def unique_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """(page_id, block, old_id, new_id): keys that stand once on either side."""
    once = lambda side, name: side.groupBy("page_id", "block", "key").agg(F.count("*").alias("n"), F.min("node_id").alias(name)).where("n = 1").drop("n")
    return once(old, "old_id").join(once(new, "new_id"), ["page_id", "block", "key"]).select("page_id", "block", "old_id", "new_id")


def unpaired(side: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The nodes of a side that stand in no pair; name: old_id or new_id."""
    return side.join(pairs.select("page_id", F.col(name).alias("node_id")), ["page_id", "node_id"], "left_anti")


def candidates(old: DataFrame, new: DataFrame, score: Column) -> DataFrame:
    """Pairs within a page and block with their score; score is over columns of o and n."""
    return old.alias("o").join(new.alias("n"), (F.col("o.page_id") == F.col("n.page_id")) & (F.col("o.block") == F.col("n.block"))).select("o.page_id", "o.block", F.col("o.node_id").alias("old_id"), F.col("n.node_id").alias("new_id"), score.alias("score"))


def mutual_best(scored: DataFrame, floor: float = IDENTITY_FLOOR, margin: float = TIE_MARGIN) -> DataFrame:
    """Pairs that are each other's best, at or above the floor, ahead of the second best on both sides by the margin."""
    by_old = Window.partitionBy("page_id", "block", "old_id").orderBy(F.desc("score"), "new_id")
    by_new = Window.partitionBy("page_id", "block", "new_id").orderBy(F.desc("score"), "old_id")
    gap = lambda w: F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(float("-inf")))
    ranked = scored.select("*", F.row_number().over(by_old).alias("ro"), gap(by_old).alias("go"), F.row_number().over(by_new).alias("rn"), gap(by_new).alias("gn"))
    return ranked.where((F.col("ro") == 1) & (F.col("rn") == 1) & (F.col("score") >= floor) & (F.col("go") >= margin) & (F.col("gn") >= margin)).select("page_id", "block", "old_id", "new_id", "score")


def best_assignment(weight: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns of a one-to-one assignment of the largest total weight (shortest augmenting paths, integers)."""
    rows, cols = weight.shape
    if rows > cols:
        return [(r, c) for c, r in best_assignment(weight.T)]
    cost = weight.max(initial=0) - weight
    u, v, owner = np.zeros(rows, np.int64), np.zeros(cols, np.int64), np.full(cols, -1)
    for start in range(rows):
        distance, back, done = np.full(cols, np.iinfo(np.int64).max // 4), np.full(cols, -1), np.zeros(cols, bool)
        row, column, base = start, -1, 0
        while True:
            through = base + cost[row] - u[row] - v
            better = ~done & (through < distance)
            distance[better], back[better] = through[better], column
            column = int(np.argmin(np.where(done, np.iinfo(np.int64).max, distance)))
            done[column], base = True, int(distance[column])
            if owner[column] < 0:
                break
            row = int(owner[column])
        reached = np.flatnonzero(done)
        for c in reached:
            if owner[c] >= 0:
                u[owner[c]] += base - distance[c]
            v[c] -= base - distance[c]
        u[start] += base
        while column >= 0:
            before = int(back[column])
            owner[column] = owner[before] if before >= 0 else start
            column = before
    return sorted((int(r), c) for c, r in enumerate(owner) if r >= 0)


def assign(scored: DataFrame, most: int = ASSIGNMENT_MOST) -> DataFrame:
    """One-to-one pairs of the largest total score per page and block; blocks with more nodes than `most` go greedily.

    A pair below NO_MATCH is dropped; from MATCH_FLOOR it is matched, else uncertain. Scores count in units of 1e-9.
    """

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        old, new = sorted(frame["old_id"].unique()), sorted(frame["new_id"].unique())
        matrix = np.zeros((len(old), len(new)), np.int64)
        matrix[np.searchsorted(old, frame["old_id"]), np.searchsorted(new, frame["new_id"])] = np.rint(frame["score"].to_numpy() * 1e9).astype(np.int64)
        if max(matrix.shape) <= most:
            pairs = best_assignment(matrix)
        else:
            pairs, rows, cols = [], set(), set()
            for at in np.argsort(-matrix, axis=None, kind="stable"):
                r, c = divmod(int(at), len(new))
                if r not in rows and c not in cols:
                    pairs.append((r, c))
                    rows.add(r)
                    cols.add(c)
        good = [(old[r], new[c], matrix[r, c] / 1e9) for r, c in pairs if matrix[r, c] >= NO_MATCH * 1e9]
        page, name = frame["page_id"].iloc[0], frame["block"].iloc[0]
        rows = [(page, name, o, n, x, "matched" if x >= MATCH_FLOOR else "uncertain") for o, n, x in good]
        return pd.DataFrame(rows, columns=["page_id", "block", "old_id", "new_id", "score", "band"], dtype=object)

    return scored.groupBy("page_id", "block").applyInPandas(solve, "page_id long, block string, old_id string, new_id string, score double, band string")
