"""Channels of captures: computed style, hit tests, network, console, accessibility, rasters.

Tables carry (pair_id, viewport, side); pairs of nodes are (pair_id, viewport, old_id, new_id, band, score).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import css, urls

PAIR = ["pair_id", "viewport"]
LEAST_POINTS, OLD_SHARE, DROP = 9, 0.9, 0.1
CELL, MIN_AREA, MAX_DELTA, THRESHOLD = 16, 2500, 35215.0, 0.1
#: Weights of red, green and blue in luma and chroma (fixed values).
LUMA = ((0.29889531, 0.58662247, 0.11448223), (0.59597799, -0.27417610, -0.32180189), (0.21147017, -0.52261711, 0.31114694))


def sides(table: DataFrame, side: str, names: dict[str, str]) -> DataFrame:
    return table.where(F.col("side") == side).select(*PAIR, *(F.col(c).alias(n) for c, n in names.items()))


def style_changes(pairs: DataFrame, styles: DataFrame) -> DataFrame:
    """Properties of paired elements, present on both sides, that differ after all tolerances."""
    old = sides(styles, "old", {"element_id": "old_id", "prop": "prop", "value": "old_value"})
    new = sides(styles, "new", {"element_id": "new_id", "prop": "prop", "value": "new_value"})
    sizes = lambda t, s: t.where("prop = 'font-size'").select(*PAIR, f"{s}_id", F.col(f"{s}_value").alias(f"{s}_size"))
    joined = pairs.join(old, [*PAIR, "old_id"]).join(new, [*PAIR, "new_id", "prop"])
    joined = joined.join(sizes(old, "old"), [*PAIR, "old_id"], "left").join(sizes(new, "new"), [*PAIR, "new_id"], "left")
    a = css.canonical(F.col("prop"), css.normalize_value(F.col("prop"), F.col("old_value")), F.col("old_size"))
    b = css.canonical(F.col("prop"), css.normalize_value(F.col("prop"), F.col("new_value")), F.col("new_size"))
    uncertain = (F.col("band") != "matched") | (F.col("score") < 0.75)
    quiet = F.col("prop").isin("letter-spacing", "line-height")
    kind = css.style_change_type(F.col("prop"), a, b)
    return joined.where(~css.values_equal(a, b)).select(*PAIR, "old_id", "new_id", "prop", a.alias("old_value"), b.alias("new_value"), kind.alias("type"), F.when(uncertain | quiet, "info").otherwise("warning").alias("severity"))


def hit_tally(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Per pair of elements: points counted, hits on either side, and the three commonest winners of new misses."""
    names = lambda s: {"node_id": f"{s}_id", "idx": "idx", "o": f"{s}_o", "winner": f"{s}_winner"}
    joined = pairs.select(*PAIR, "old_id", "new_id").join(sides(points, "old", names("old")), [*PAIR, "old_id"]).join(sides(points, "new", names("new")), [*PAIR, "new_id", "idx"])
    counted = joined.where("old_o <> 'excluded' and new_o <> 'excluded'")
    by = [*PAIR, "old_id", "new_id"]
    tally = counted.groupBy(*by).agg(F.count("*").alias("denominator"), F.count_if(F.col("old_o") == "hit").alias("old_hits"), F.count_if(F.col("new_o") == "hit").alias("new_hits"))
    misses = counted.where("new_o = 'miss'").groupBy(*by, "new_winner").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "new_winner"))
    top = misses.withColumn("r", place).where("r <= 3").groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "new_winner", "n"))), lambda x: F.concat(x["new_winner"], F.lit(" (x"), x["n"].cast("string"), F.lit(")"))), "; ").alias("winners"))
    return tally.join(top, by, "left")


def clickable_regressions(tally: DataFrame) -> DataFrame:
    old, new = F.col("old_hits") / F.col("denominator"), F.col("new_hits") / F.col("denominator")
    return tally.where((F.col("denominator") >= LEAST_POINTS) & (old >= OLD_SHARE) & (old - new > DROP))


def network_errors(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Failing requests of the new side whose key does not fail on the old one; the first of each key."""
    keyed = requests.join(pages.select(*PAIR, "side", F.col("url").alias("page")), [*PAIR, "side"]).withColumn("key", urls.request_key(F.col("url"), F.col("page")))
    failing = keyed.where(F.col("failed") | (F.coalesce("status", F.lit(0)) >= 400))
    new, old = (failing.where(F.col("side") == s) for s in ("new", "old"))
    fresh = new.join(old.select(*PAIR, "key"), [*PAIR, "key"], "left_anti")
    return fresh.groupBy(*PAIR, "key").agg(F.min_by(F.struct("url", "status", "type"), "pos").alias("first")).select(*PAIR, "key", "first.*")


def console_errors(console: DataFrame) -> DataFrame:
    """Error texts of the new side that the old one lacks."""
    errors = console.where("level = 'error' and not startswith(text, 'Failed to load resource')")
    new, old = (errors.where(F.col("side") == s).select(*PAIR, "text") for s in ("new", "old"))
    return new.join(old, [*PAIR, "text"], "left_anti").distinct()


def accessibility(violations: DataFrame) -> DataFrame:
    """Rules that one side violates alone: new ones are regressions, old ones improvements."""
    new, old = (violations.where(F.col("side") == s).select(*PAIR, "rule_id").distinct() for s in ("new", "old"))
    key = [*PAIR, "rule_id"]
    return new.join(old, key, "left_anti").withColumn("type", F.lit("accessibility_regression")).unionByName(old.join(new, key, "left_anti").withColumn("type", F.lit("accessibility_improved")))


def changed_pixels(old: np.ndarray, new: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Where two RGBA rasters (of the common height) differ by more than a perceptual threshold, over white."""
    h, w = min(old.shape[0], new.shape[0]), min(old.shape[1], new.shape[1])
    flat = lambda x: np.trunc(255 + (x[:h, :w, :3].astype(float) - 255) * (x[:h, :w, 3:4] / 255))
    r, g, b = np.moveaxis(flat(old) - flat(new), 2, 0)
    y, i, q = (wr * r + wg * g + wb * b for wr, wg, wb in LUMA)
    return 0.5053 * y * y + 0.299 * i * i + 0.1957 * q * q > MAX_DELTA * threshold * threshold


def regions_of(changed: np.ndarray, cell: int = CELL, least: int = MIN_AREA) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, changed pixels) of changed pixels whose cells touch, also at corners; by y and x."""
    ys, xs = np.nonzero(changed)
    if not len(ys):
        return []
    cells, of = np.unique(np.stack([ys // cell, xs // cell], 1), axis=0, return_inverse=True)
    of, where = of.reshape(-1), {tuple(c): n for n, c in enumerate(cells.tolist())}
    root = np.arange(len(cells))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for (y, x), n in where.items():
        for step in ((0, 1), (1, -1), (1, 0), (1, 1)):
            if (m := where.get((y + step[0], x + step[1]))) is not None:
                root[find(n)] = find(m)
    group = np.array([find(n) for n in range(len(cells))])[of]
    out = []
    for g in np.unique(group):
        gy, gx = ys[group == g], xs[group == g]
        x, y, w, h = int(gx.min()), int(gy.min()), int(gx.max() - gx.min() + 1), int(gy.max() - gy.min() + 1)
        if w * h >= least:
            out.append((x, y, w, h, len(gy)))
    return sorted(out, key=lambda r: (r[1], r[0]))


def visual_summary(rasters: DataFrame) -> DataFrame:
    """One row a pair of rasters: the share of pixels that changed, the area compared, both heights, and the regions by y and x."""

    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                old, new = (np.frombuffer(d, np.uint8).reshape(h, w, 4) for d, h, w in ((r.old_data, r.old_h, r.old_w), (r.new_data, r.new_h, r.new_w)))
                changed = changed_pixels(old, new)
                found = [dict(zip(("x", "y", "w", "h", "pixels"), x)) for x in regions_of(changed)]
                rows.append((r.pair_id, r.viewport, float(changed.mean()) if changed.size else 0.0, float(changed.size), r.old_h, r.new_h, found))
            yield pd.DataFrame(rows, columns=["pair_id", "viewport", "ratio", "area", "old_h", "new_h", "regions"])

    return rasters.mapInPandas(run, "pair_id string, viewport string, ratio double, area double, old_h int, new_h int, regions array<struct<x:int,y:int,w:int,h:int,pixels:long>>")


def diff_image(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The new raster faded to grey, with changed pixels in red; of the common size."""
    changed = changed_pixels(old, new)
    h, w = changed.shape
    grey = (255 - (255 - new[:h, :w, :3].astype(float).mean(2)) * 0.1).astype(np.uint8)
    out = np.dstack([grey, grey, grey, np.full((h, w), 255, np.uint8)])
    out[changed] = (255, 0, 0, 255)
    return out


def crop(raster: np.ndarray, x: int, y: int, w: int, h: int, pad: int = 8) -> np.ndarray:
    return raster[max(0, y - pad) : y + h + pad, max(0, x - pad) : x + w + pad]


def png(raster: np.ndarray) -> bytes:
    """RGBA pixels as a PNG file."""
    h, w = raster.shape[:2]
    lines = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(raster).reshape(h, w * 4)], axis=1)
    part = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def crops(rasters: DataFrame, issues: DataFrame) -> DataFrame:
    """(pair_id, viewport, name, data): PNG crops of the old, new and diff raster for every visual issue, named by its id."""
    boxes = issues.where("type = 'visual_region_changed'").groupBy(*PAIR).agg(F.collect_list(F.struct("id", F.col("bbox_old").alias("box"))).alias("boxes"))

    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                old, new = (np.frombuffer(d, np.uint8).reshape(h, w, 4) for d, h, w in ((r.old_data, r.old_h, r.old_w), (r.new_data, r.new_h, r.new_w)))
                shown = {"old": old, "new": new, "diff": diff_image(old, new)}
                rows += [(r.pair_id, r.viewport, f"{b['id']}_{name}.png", png(crop(image, *map(int, b["box"])))) for b in r.boxes for name, image in shown.items()]
            yield pd.DataFrame(rows, columns=["pair_id", "viewport", "name", "data"])

    return rasters.join(boxes, PAIR).mapInPandas(run, "pair_id string, viewport string, name string, data binary")


def visual_regions(rasters: DataFrame) -> DataFrame:
    """(pair_id, viewport, ratio, x, y, w, h, pixels) of rasters (pair_id, viewport, old_w, old_h, old_data, new_w, ...), RGBA bytes.

    One raster pair is one row, so the work spreads over rows; Python runs over Arrow batches.
    """

    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                old = np.frombuffer(r.old_data, np.uint8).reshape(r.old_h, r.old_w, 4)
                new = np.frombuffer(r.new_data, np.uint8).reshape(r.new_h, r.new_w, 4)
                changed = changed_pixels(old, new)
                ratio = float(changed.mean()) if changed.size else 0.0
                rows += [(r.pair_id, r.viewport, ratio, *x) for x in regions_of(changed)] or [(r.pair_id, r.viewport, ratio, None, None, None, None, None)]
            yield pd.DataFrame(rows, columns=["pair_id", "viewport", "ratio", "x", "y", "w", "h", "pixels"]).astype({c: "Int64" for c in ("x", "y", "w", "h", "pixels")})

    return rasters.mapInPandas(run, "pair_id string, viewport string, ratio double, x long, y long, w long, h long, pixels long")
