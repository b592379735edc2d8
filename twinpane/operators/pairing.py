"""Pairs of captures as one row each, with their nodes matched inside the row.

Two captures of a page meet in one join. All that follows happens in arrays of that row, as wide as a page: no node is
shuffled again. Only the bounded assignment step runs in Python, over Arrow batches of candidate scores.

Rows: (pair_id, viewport, old, new, o_nodes, n_nodes, pairs, missing, added, ...); nodes are sorted by id, so a place in
the array is the order of the id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import urls
from ..functions.arrays import let
from ..sources.bundles import NODE
from .matching import ASSIGNMENT_MOST, IDENTITY_FLOOR, MATCH_FLOOR, NO_MATCH, TIE_MARGIN, best_assignment, block, exact_key
from .sequence import moves

PAIR = ["pair_id", "viewport"]
CHANNELS = ["environment", "determinism", "page", "computedStyles", "styleCandidates", "hitTests", "pseudoElements", "pseudoTruncated"]
#: Weights of the tie-break and of the two parts of the combined score (fixed values).
TIEBREAK = (0.5, 0.3, 0.2)
COMBINED = (0.7, 0.3)


def sides(bundles: DataFrame) -> DataFrame:
    """One row per pair and viewport with the captures `old` and `new`; a side that was not captured is null."""
    side = lambda s: bundles.where(F.col("side") == s).select("pair_id", F.col("viewport.name").alias("viewport"), F.struct(*CHANNELS).alias(s))
    return side("old").join(side("new"), PAIR, "full_outer")


def box(x: Column, i: int) -> Column:
    return F.get(x["bbox"], F.lit(i))


def area(x: Column) -> Column:
    return box(x, 2).cast("long") * box(x, 3)


def raw_href(x: Column) -> Column:
    return F.coalesce(x["rawHref"], x["href"])


def node_key(x: Column) -> Column:
    """The block and exact key of a node."""
    href = F.when(x["kind"] == "image", urls.path(F.coalesce(x["src"], F.lit("")))).otherwise(raw_href(x))
    name = F.when(x["kind"] == "image", x["imageAlt"]).otherwise(x["accName"])
    return F.struct(block(x["kind"]).alias("block"), exact_key(x["kind"], x["text"], href, x["headingLevel"], x["role"], name).alias("key"))


def signals(x: Column, y: Column, of: Column, old_url: Column, new_url: Column) -> Column:
    """The similarities that a block's identity score is made of, by name; names a block doesn't use are absent."""
    some = lambda **parts: F.map_from_arrays(F.array(*(F.lit(k) for k in sorted(parts))), F.array(*(parts[k].cast("double") for k in sorted(parts))))
    near = t.nearby_sim(x["anchors"]["nearestHeading"], y["anchors"]["nearestHeading"], x["anchors"]["landmark"], y["anchors"]["landmark"])
    same, name, role = t.text_sim(x["text"], y["text"]), t.text_sim(x["accName"], y["accName"]), t.role_sim(x["role"], y["role"])
    size = t.dimension_sim(x["naturalWidth"], x["naturalHeight"], y["naturalWidth"], y["naturalHeight"])
    return (
        F.when(of == "link", some(href=urls.href_sim_cross_origin(raw_href(x), raw_href(y), old_url, new_url), text=same, accName=name))
        .when(of == "image", some(alt=t.alt_sim(x["imageAlt"], y["imageAlt"]), intrinsicDim=size))
        .when(of == "heading", some(text=same))
        .when(of == "text", some(text=same, nearby=near))
        .when(of.isin("field", "form"), some(accName=name, role=role, nearby=near))
        .otherwise(some(text=same, role=role))
    )


def identity(s: Column, of: Column) -> Column:
    """The weighted sum of the signals of a block."""
    return (
        F.when(of == "link", 0.55 * s["href"] + 0.35 * s["text"] + 0.10 * s["accName"])
        .when(of == "image", 0.55 * s["alt"] + 0.45 * s["intrinsicDim"])
        .when(of == "heading", s["text"])
        .when(of == "text", 0.85 * s["text"] + 0.15 * s["nearby"])
        .when(of.isin("field", "form"), 0.55 * s["accName"] + 0.30 * s["role"] + 0.15 * s["nearby"])
        .otherwise(0.70 * s["text"] + 0.30 * s["role"])
    )


def tiebreak(x: Column, y: Column, old_height: Column, new_height: Column) -> Column:
    """Where the nodes stand, how large they are, and what is near them."""
    near = t.nearby_sim(x["anchors"]["nearestHeading"], y["anchors"]["nearestHeading"], x["anchors"]["landmark"], y["anchors"]["landmark"])
    place = t.position_sim(box(x, 1), F.coalesce(old_height, F.lit(0)), box(y, 1), F.coalesce(new_height, F.lit(0)))
    known = lambda c: F.coalesce(c, F.lit(0.0))
    return TIEBREAK[0] * known(place) + TIEBREAK[1] * known(t.size_sim(area(x), area(y))) + TIEBREAK[2] * near


def combined(identity_score: Column, tiebreak_score: Column) -> Column:
    return COMBINED[0] * identity_score + COMBINED[1] * tiebreak_score


def unique_keys(o_keys: Column, n_keys: Column) -> Column:
    """(o, n) of the keys that stand once on either side: neighbours in the sorted list of all keys."""
    tag = lambda keys, side: F.transform(keys, lambda k, i: F.struct(k["block"].alias("block"), k["key"].alias("key"), F.lit(side).alias("side"), i.alias("i")))
    same = lambda a, b: F.coalesce((a["block"] == b["block"]) & (a["key"] == b["key"]), F.lit(False))

    def found(s):
        at = lambda i: F.get(s, i)
        alone = lambda e, i: (e["side"] == 0) & same(e, at(i + 1)) & (at(i + 1)["side"] == 1) & ~same(e, at(i - 1)) & ~same(e, at(i + 2))
        return F.filter(F.transform(s, lambda e, i: F.when(alone(e, i), F.struct(e["i"].alias("o"), at(i + 1)["i"].alias("n")))), lambda p: p.isNotNull())

    return let(F.array_sort(F.concat(tag(o_keys, 0), tag(n_keys, 1))), found)


CANDIDATES = "array<struct<o:int,n:int,block:string,identity:double,combined:double>>"
PAIRED = "array<struct<o:int,n:int,stage:string,score:double,band:string>>"


def _mutual(score: np.ndarray) -> list[tuple[int, int]]:
    """Each other's best, at or above the floor, ahead of the second best both ways by the margin; ties go to the first id."""
    rows, cols = score.argmax(1), score.argmax(0)

    def gap(line: np.ndarray) -> float:
        return np.inf if len(line) < 2 else float(np.subtract(*np.sort(line)[[-1, -2]]))

    return [(r, int(c)) for r, c in enumerate(rows) if cols[c] == r and score[r, c] >= IDENTITY_FLOOR and gap(score[r]) >= TIE_MARGIN and gap(score[:, c]) >= TIE_MARGIN]


def _greedy(weight: np.ndarray) -> list[tuple[int, int]]:
    pairs, rows, cols = [], set(), set()
    for at in np.argsort(-weight, axis=None, kind="stable"):
        r, c = divmod(int(at), weight.shape[1])
        if r not in rows and c not in cols:
            pairs.append((r, c))
            rows.add(r)
            cols.add(c)
    return pairs


def assigned(candidates: list[dict], most: int = ASSIGNMENT_MOST) -> list[dict]:
    """Pairs of one page: mutual best by identity, then the best assignment by combined scores (units of 1e-9)."""
    blocks: dict[str, list[dict]] = {}
    for c in candidates:
        blocks.setdefault(c["block"], []).append(c)
    out = []
    for cells in blocks.values():
        olds, news = sorted({c["o"] for c in cells}), sorted({c["n"] for c in cells})
        row, col = {x: i for i, x in enumerate(olds)}, {x: i for i, x in enumerate(news)}
        own, both = np.zeros((len(olds), len(news))), np.zeros((len(olds), len(news)))
        for c in cells:
            own[row[c["o"]], col[c["n"]]], both[row[c["o"]], col[c["n"]]] = c["identity"], c["combined"]
        sure = _mutual(own)
        out += [{"o": olds[r], "n": news[c], "stage": "identity", "score": float(own[r, c]), "band": "matched"} for r, c in sure]
        rows, cols = (np.setdiff1d(np.arange(n), [p[i] for p in sure]) for i, n in enumerate((len(olds), len(news))))
        if len(rows) and len(cols):
            weight = np.rint(both[np.ix_(rows, cols)] * 1e9).astype(np.int64)
            for r, c in best_assignment(weight) if max(weight.shape) <= most else _greedy(weight):
                if (score := weight[r, c] / 1e9) >= NO_MATCH:
                    out.append({"o": olds[rows[r]], "n": news[cols[c]], "stage": "assignment", "score": score, "band": "matched" if score >= MATCH_FLOOR else "uncertain"})
    return out


_BLOCK = "struct<start:int,size:int,at:int>"
MOVES = f"struct<swaps:array<struct<a:{_BLOCK},b:{_BLOCK}>>,moves:array<struct<block:{_BLOCK},before:{_BLOCK},after:{_BLOCK}>>>"
SOLVED = f"struct<pairs:{PAIRED},moved:{MOVES}>"


_block = pa.struct([(n, pa.int32()) for n in ("start", "size", "at")])
_pairs = pa.list_(pa.struct([("o", pa.int32()), ("n", pa.int32()), ("stage", pa.string()), ("score", pa.float64()), ("band", pa.string())]))
_moved = pa.struct([("swaps", pa.list_(pa.struct([("a", _block), ("b", _block)]))), ("moves", pa.list_(pa.struct([("block", _block), ("before", _block), ("after", _block)])))])
_SOLVED = pa.struct([("pairs", _pairs), ("moved", _moved)])


def order_of(pairs: list[dict], o_seq: list[int], n_seq: list[int]) -> list[int]:
    """The new rank of each pair, in old order; places on a page are told by position, then id."""
    old = sorted(pairs, key=lambda p: (o_seq[p["o"]], p["o"]))
    rank = {p["n"]: r for r, p in enumerate(sorted(pairs, key=lambda p: (n_seq[p["n"]], p["n"])))}
    return [rank[p["n"]] for p in old]


def _solve(candidates: pa.Array, exact: pa.Array, o_seq: pa.Array, n_seq: pa.Array, sizes: pa.Array) -> pa.Array:
    """Pairs of the rest, and how the components that identity pairs moved.

    The last argument is there so that the candidates are read twice: so they stay a column, and aren't computed within
    the call.
    """
    out = []
    for cells, sure, olds, news in zip(*(x.to_pylist() for x in (candidates, exact, o_seq, n_seq)), strict=True):
        found = assigned(cells or [])
        same = [*(sure or []), *(p for p in found if p["stage"] == "identity")]
        out.append({"pairs": found, "moved": moves(order_of(same, olds, news)) if same else {"swaps": [], "moves": []}})
    return pa.array(out, _SOLVED)


def candidates(o_rest: Column, n_rest: Column) -> Column:
    """Scores of all remaining nodes of a block against each other."""
    old_url, new_url = F.col("old.page.finalUrl"), F.col("new.page.finalUrl")
    old_height, new_height = F.col("old.page.pageHeight"), F.col("new.page.pageHeight")

    def scored(i, x, j, y):
        own = let(signals(x, y, block(x["kind"]), old_url, new_url), lambda s: identity(s, block(x["kind"])))
        return let(own, lambda s: F.struct(i.alias("o"), j.alias("n"), block(x["kind"]).alias("block"), s.alias("identity"), combined(s, tiebreak(x, y, old_height, new_height)).alias("combined")))

    def row(i, left):
        return let(F.get("o_nodes", i), lambda x: F.transform(F.filter(left, lambda j: block(F.get("n_nodes", j)["kind"]) == block(x["kind"])), lambda j: let(F.get("n_nodes", j), lambda y: scored(i, x, j, y))))

    return let(n_rest, lambda left: F.flatten(F.transform(o_rest, lambda i: row(i, left))))


def _best(nodes: str, others: str, i: Column, flipped: bool) -> Column:
    """The best identity score of a node with any node of its block on the other side."""
    old_url, new_url = F.col("old.page.finalUrl"), F.col("new.page.finalUrl")
    own = lambda x, y: let(signals(*((y, x) if flipped else (x, y)), block(x["kind"]), old_url, new_url), lambda s: identity(s, block(x["kind"])))
    return let(F.get(nodes, i), lambda x: F.array_max(F.transform(F.filter(others, lambda y: block(y["kind"]) == block(x["kind"])), lambda y: own(x, y))))


def in_order(pairs: Column) -> Column:
    """Pairs by the old node's place on the page; signals become JSON text, as maps have no order."""
    keyed = F.transform(pairs, lambda p: F.struct(p["seq"].alias("seq"), p["o"].alias("o"), p["n"].alias("n"), p["stage"].alias("stage"), p["score"].alias("score"), p["band"].alias("band"), F.to_json(p["signals"]).alias("signals")))
    return F.array_sort(keyed)


def matched(bundles: DataFrame) -> DataFrame:
    """The pairs of captures with pairs (seq, o, n, stage, score, band, signals), missing and added (seq, i, best), and moved blocks."""
    none = F.array().cast(f"array<{NODE}>")
    nodes = lambda s: F.array_sort(F.coalesce(F.col(f"{s}.page.nodes"), none))
    rows = sides(bundles).withColumns({"o_nodes": nodes("old"), "n_nodes": nodes("new")})
    rows = rows.withColumn("exact", unique_keys(F.transform("o_nodes", node_key), F.transform("n_nodes", node_key)))
    places = lambda c: F.transform(c, lambda x, i: i)
    rest = lambda c, own, side: F.array_except(places(c), F.transform(own, lambda p: p[side]))
    rows = rows.withColumns({"o_rest": rest("o_nodes", "exact", "o"), "n_rest": rest("n_nodes", "exact", "n")})
    rows = rows.withColumn("candidates", candidates(F.col("o_rest"), F.col("n_rest")).cast(CANDIDATES))
    places_on = lambda c: F.transform(c, lambda x: x["seqIndex"])
    rows = rows.withColumn("solved", F.arrow_udf(_solve, SOLVED)("candidates", "exact", places_on("o_nodes"), places_on("n_nodes"), F.size("candidates"))).withColumn("moved", F.col("solved.moved"))
    old_url, new_url = F.col("old.page.finalUrl"), F.col("new.page.finalUrl")
    seq = lambda c, i: F.get(c, i)["seqIndex"]
    exact = F.transform("exact", lambda p: F.struct(seq("o_nodes", p["o"]).alias("seq"), p["o"].alias("o"), p["n"].alias("n"), F.lit("identity").alias("stage"), F.lit(1.0).alias("score"), F.lit("matched").alias("band"), F.create_map(F.lit("exactKey"), F.lit(1.0)).alias("signals")))
    rounded = lambda m: F.transform_values(m, lambda k, v: t.round4(v))
    said = lambda p: let(F.get("o_nodes", p["o"]), lambda x: rounded(signals(x, F.get("n_nodes", p["n"]), block(x["kind"]), old_url, new_url)))
    scored = F.transform("solved.pairs", lambda p: F.struct(seq("o_nodes", p["o"]).alias("seq"), p["o"].alias("o"), p["n"].alias("n"), p["stage"].alias("stage"), p["score"].alias("score"), p["band"].alias("band"), said(p).alias("signals")))
    rows = rows.withColumn("pairs", in_order(F.concat(exact, scored)))
    left = lambda c, others, side, flipped: F.array_sort(F.transform(rest(c, "pairs", side), lambda i: F.struct(seq(c, i).alias("seq"), i.alias("i"), _best(c, others, i, flipped).alias("best"))))
    rows = rows.withColumns({"missing": left("o_nodes", "n_nodes", "o", False), "added": left("n_nodes", "o_nodes", "n", True)})
    return rows.drop("exact", "o_rest", "n_rest", "candidates", "solved")
