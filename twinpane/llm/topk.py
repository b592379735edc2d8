"""Exact top-k search by inner product with KD-trees per shard (operator 3).

Vectors are dealt into shards by space: medians of a bounded sample split the widest dimensions into cells, and a cell
with more rows than a shard holds is dealt into several by hash, so copies of one vector don't pile up. A shard's tree
splits on at medians of the widest dimension and keeps the tight bounding box of every node; the largest inner product
that a box allows, sum(max(q * low, q * high)), is the bound. The traversal is best-first for a block of queries: the
node with the highest bound is opened next, for those queries only whose k-th score it can still improve.

Each query is first answered within its own shard. The k-th score found there goes along: the root boxes of all shards,
a small table, say which shards a query must still meet, and only there it goes. What meets in a task is bounded on both
sides, one shard and a bounded number of queries. Only candidates at or above the propagated k-th score leave a task.
Where boxes prune nothing, every query meets every shard; that is the cost of an exact answer then.

Defined results: vectors that are null or hold null or non-finite components take no part, neither as queries nor as
candidates; vectors of different dimensions are never compared; a query with fewer candidates than k gets all of them,
one with none has no rows. Equal scores are ranked by the smaller id. Rows with equal ids are different rows: each is a
query and a candidate of its own, and only the row itself is left out. Integer scores are exact; one beyond 64 bits is
an error. Rows without an id take no part. Empty tables give empty results.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stored, table, trimmed

K, EVERY, SCALE = 5, 50, 256
SHARD_ROWS, LEAF, TASK_QUERIES, PACKET = 16_384, 64, 16_384, 256
SAMPLE_ROWS, CELL_SAMPLE = 8192, 8  # vectors that choose the cells, and the least of them in a cell
PLACED = "cell int, dim int, id long, vector binary"
SHARD = "shard long, dim int, ids binary, vectors binary, queries long, low binary, high binary"
HIT = "query_shard long, query_row int, query_id long, vec_id long, score long"
BLOCK = "shard long, dim int, rows binary, ids binary, vectors binary, floor binary"
EXACT = float(1 << 53)
LEAST, LAST = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max


class Tree:
    """KD-tree over integer vectors (as float64): medians, tight boxes. Rows of a leaf are in order of id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(ids))
        self.ids, self.vectors, self.leaf = ids, vectors, leaf
        self.spans: list[tuple[int, int]] = []
        self.kids: list[tuple[int, int] | None] = []
        self._build(0, len(ids))
        self.vectors, self.ids = vectors[self.order], ids[self.order]
        self.low = np.array([self.vectors[a:b].min(0) for a, b in self.spans])
        self.high = np.array([self.vectors[a:b].max(0) for a, b in self.spans])
        self.least = np.array([self.ids[a:b].min() for a, b in self.spans])
        self.largest = float(np.abs(vectors).max(initial=0))

    def _build(self, a: int, b: int) -> int:
        node = len(self.spans)
        self.spans.append((a, b))
        self.kids.append(None)
        part = self.vectors[self.order[a:b]]
        width = part.max(0) - part.min(0)
        if b - a > self.leaf and width.size and width.max() > 0:
            middle = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(part[:, int(np.argmax(width))], middle, kind="introselect")]
            self.kids[node] = (self._build(a, a + middle), self._build(a + middle, b))
        else:
            self.order[a:b] = self.order[a:b][np.argsort(self.ids[self.order[a:b]], kind="stable")]
        return node

    def bounds(self, queries: np.ndarray, node: int) -> np.ndarray:
        """No vector in the node scores higher."""
        return bounds(queries, self.low[node : node + 1], self.high[node : node + 1])[:, 0]

    def scores(self, a: int, b: int, queries: np.ndarray) -> np.ndarray:
        """Of each query and row, as integers."""
        if self.largest * float(np.abs(queries).max(initial=0)) * queries.shape[1] < EXACT:
            return (queries @ self.vectors[a:b].T).astype(np.int64)
        whole = [[int(x) for x in row] for row in self.vectors[a:b]]
        return np.array([[sum(int(x) * y for x, y in zip(q, row, strict=True)) for row in whole] for q in queries], np.int64)

    def search(self, queries: np.ndarray, k: int, floors: np.ndarray | None = None, skip: np.ndarray | None = None):
        """(scores, ids, rows) of the k best rows of each query, best first; row -1 where there is none.

        floors: k-th scores found elsewhere, only rows that come before them by score, or are even, are found. skip:
        the row of the tree that is the query itself.
        """
        top, names, rows = np.full((len(queries), k), LEAST), np.full((len(queries), k), LAST), np.full((len(queries), k), -1)
        if floors is not None:
            top[:] = floors[:, None]
        every = np.arange(len(queries))
        heap = [(0.0, 0, every, self.bounds(queries, 0))] if len(queries) and len(self.ids) else []
        while heap:
            _, node, active, bound = heapq.heappop(heap)
            open_ = (bound > top[active, -1]) | ((bound >= top[active, -1]) & (self.least[node] < names[active, -1]))
            active = active[open_]
            if not len(active):
                continue
            if self.kids[node]:
                for kid in self.kids[node]:
                    bound = self.bounds(queries[active], kid)
                    heapq.heappush(heap, (-float(bound.max()), kid, active, bound))
                continue
            a, b = self.spans[node]
            found = self.scores(a, b, queries[active])
            if skip is not None:
                own = skip[active] - a
                here = np.flatnonzero((own >= 0) & (own < b - a))
                found[here, own[here]] = LEAST
            best = np.argsort(-found, axis=1, kind="stable")[:, :k]
            found = np.take_along_axis(found, best, 1)
            s, n, r = np.hstack([top[active], found]), np.hstack([names[active], self.ids[a:b][best]]), np.hstack([rows[active], best + a])
            n[s == LEAST], r[s == LEAST] = LAST, -1
            by = np.lexsort((n, -s), axis=-1)[:, :k]
            top[active], names[active], rows[active] = (np.take_along_axis(x, by, 1) for x in (s, n, r))
        return top, names, rows


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product of each query with any vector of each box."""
    bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    largest = max(float(np.abs(low).max(initial=0)), float(np.abs(high).max(initial=0)))
    if largest * float(np.abs(queries).max(initial=0)) * max(1, queries.shape[1]) >= EXACT:
        bound += np.abs(bound) * 1e-9 + 1e-9  # sums may be rounded
    return bound


def cells(sample: np.ndarray, wanted: int, least: int = CELL_SAMPLE) -> list:
    """Splits (axis, value, left, right) at medians of the widest dimension; leaves are numbers from 0."""
    count = [0]

    def split(rows: np.ndarray, parts: int):
        width = rows.max(0) - rows.min(0) if len(rows) and rows.shape[1] else np.zeros(0)
        if parts > 1 and len(rows) >= 2 * least and width.size and width.max() > 0:
            axis = int(np.argmax(width))
            value = float(np.median(rows[:, axis]))
            left = rows[:, axis] <= value
            if left.any() and not left.all():
                return (axis, value, split(rows[left], parts // 2), split(rows[~left], parts - parts // 2))
        count[0] += 1
        return count[0] - 1

    return [split(sample, wanted), count[0]]


def cell_of(vectors: np.ndarray, tree) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(vectors), tree, np.int32)
    axis, value, left, right = tree
    low = vectors[:, axis] <= value
    out = np.empty(len(vectors), np.int32)
    out[low], out[~low] = cell_of(vectors[low], left), cell_of(vectors[~low], right)
    return out


def _parsed(column: str, row_id: str, scale: int):
    """(dim, ids, integer vectors) of the sound rows of a batch."""

    def run(batch):
        vectors, ids = batch.column(column), batch.column(row_id)
        sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes[sizes >= 0]).tolist():
            rows = np.flatnonzero(sizes == dim)
            part = vectors.take(pa.array(rows))
            flat = pc.fill_null(part.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), dim)
            good = np.isfinite(flat).all(1) & ids.take(pa.array(rows)).is_valid().to_numpy(zero_copy_only=False)
            if good.any():
                own = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)[rows[good]]
                yield dim, own, np.floor(flat[good] * scale)

    return run


def _placed(parse, trees: dict):
    names = [x.split()[0] for x in PLACED.split(", ")]

    @trimmed
    def run(batches):
        for batch in batches:
            for dim, ids, vectors in parse(batch):
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * dim), len(ids), [None, pa.py_buffer(np.ascontiguousarray(vectors, "<f8").tobytes())]).cast(pa.binary()) if dim else pa.array([b""] * len(ids), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cell_of(vectors, trees.get(dim, 0))), pa.array(np.full(len(ids), dim, np.int32)), pa.array(ids), packed], names)

    return run


def _shard(every: int):
    def run(rows: pa.Table) -> pa.Table:
        dim = rows.column("dim")[0].as_py()
        ids = rows.column("id").to_numpy()
        data = b"".join(rows.column("vector").to_pylist())
        vectors = np.frombuffer(data, "<f8").reshape(len(ids), dim)
        box = [x.astype("<f8").tobytes() for x in (vectors.min(0), vectors.max(0))]
        return pa.table([pa.array([x], t) for x, t in zip((rows.column("shard")[0].as_py(), dim, ids.astype("<i8").tobytes(), data, int((ids % every == 0).sum()), *box), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=[x.split()[0] for x in SHARD.split(", ")])

    return run


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["vectors"], "<f8").reshape(len(ids), row["dim"])


_HIT_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
_HIT_NAMES = [x.split()[0] for x in HIT.split(", ")]
_BLOCK_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
_BLOCK_NAMES = [x.split()[0] for x in BLOCK.split(", ")]
_HOME = pa.list_(pa.struct([("query_row", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))


def _block(shard: int, dim: int, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray) -> list[pa.Array]:
    values = (shard, dim, rows.astype("<i4").tobytes(), ids.astype("<i8").tobytes(), vectors.astype("<f8").tobytes(), floor.astype("<i8").tobytes())
    return [pa.array([x], t) for x, t in zip(values, _BLOCK_TYPES, strict=True)]


def _unblocked(row: dict):
    ids = np.frombuffer(row["ids"], "<i8")
    return np.frombuffer(row["rows"], "<i4"), ids, np.frombuffer(row["vectors"], "<f8").reshape(len(ids), row["dim"]), np.frombuffer(row["floor"], "<i8")


def _at_home(k: int, every: int):
    """Each query within its own shard: the hits, and the queries with their k-th scores as a block."""

    @trimmed
    def run(batches):
        for batch in batches:
            for row in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                ids, vectors = _opened(row)
                tree = Tree(ids, vectors)
                asked = np.flatnonzero(tree.ids % every == 0)
                top, names, rows = tree.search(tree.vectors[asked], k, skip=asked)
                own = tree.order[asked]
                n, j = np.nonzero(rows >= 0)
                home = [{"query_row": int(own[a]), "query_id": int(ids[own[a]]), "vec_id": int(names[a, b]), "score": int(top[a, b])} for a, b in zip(n.tolist(), j.tolist(), strict=True)]
                block = _block(row["shard"], row["dim"], own, ids[own], vectors[own], top[:, -1])
                yield pa.RecordBatch.from_arrays([*block, pa.array([home], _HOME)], [*_BLOCK_NAMES, "home"])

    return run


def _sent(batches):
    """The queries of a block that may find something in a packet's shards, one row for each shard."""
    for batch in batches:
        for row in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
            rows, ids, vectors, floor = _unblocked(row)
            boxes = [np.frombuffer(b"".join(x[c] for x in row["boxes"]), "<f8").reshape(len(row["boxes"]), row["dim"]) for c in ("low", "high")]
            bound = bounds(vectors, *boxes)
            out = []
            for j, box in enumerate(row["boxes"]):
                use = np.flatnonzero(bound[:, j] >= floor)
                if box["shard"] != row["shard"] and len(use):
                    out.append([pa.array([box["shard"]], pa.int64()), pa.array([len(use)], pa.int32()), *_block(row["shard"], row["dim"], rows[use], ids[use], vectors[use], floor[use])])
                if sum(x[4].nbytes + x[6].nbytes for x in out) > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out, strict=True)], ["target", "n", *_BLOCK_NAMES])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out, strict=True)], ["target", "n", *_BLOCK_NAMES])


def _away(k: int):
    """Queries from elsewhere in a shard."""

    def run(shards: pa.Table, blocks: pa.Table) -> pa.Table:
        out = []
        for row in shards.to_pylist() if blocks.num_rows else []:
            tree = Tree(*_opened(row))
            asked = blocks.to_pylist()
            rows, ids, vectors, floor = (np.concatenate(x) for x in zip(*map(_unblocked, asked), strict=True))
            source = np.repeat([x["shard"] for x in asked], [x["n"] for x in asked])
            top, names, found = tree.search(vectors, k, floors=floor)
            n, j = np.nonzero(found >= 0)
            out.append([source[n], rows[n], ids[n], names[n, j], top[n, j]])
        release()
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] or [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, _HIT_TYPES, strict=True)], names=_HIT_NAMES)

    return run


def _trees(read: DataFrame, parse, row_id: str, shard_rows: int) -> dict:
    """Of each dimension the splits into cells, by a sample of bounded size."""
    column = next(c for c in read.columns if c != row_id)
    sizes = {r["dim"]: r["n"] for r in read.groupBy(F.size(column).alias("dim")).agg(F.count("*").alias("n")).collect()}
    out = {}
    for dim, n in sizes.items():
        if n > shard_rows:
            part = F.pmod(F.xxhash64(row_id), F.lit(1 << 30)) < max(1, SAMPLE_ROWS * (1 << 30) // n)
            sample = read.where((F.size(column) == dim) & part).limit(2 * SAMPLE_ROWS).toArrow()
            found = [v for batch in sample.to_batches() for d, _, v in parse(batch) if d == dim]
            out[dim] = cells(np.concatenate(found), -(-n // shard_rows))[0] if found else 0
    return out


def top_k(vectors: DataFrame, *, row_id: str = "vec_id", column: str = "embedding", k: int = K, every: int = EVERY, scale: int = SCALE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for every row whose id is divisible by `every`."""
    read = vectors.where(F.col(column).isNotNull() & F.col(row_id).isNotNull()).select(F.col(row_id).cast("long").alias(row_id), column)
    parse = _parsed(column, row_id, scale)
    placed = read.mapInArrow(_placed(parse, _trees(read, parse, row_id, shard_rows)), PLACED)
    placed = stored(placed, "topk-placed")
    spans = stored(placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts")), "topk-cells")
    part = F.pmod(F.col("spot"), F.col("parts"))
    dealt = placed.withColumn("spot", F.monotonically_increasing_id()).join(spans, ["dim", "cell"]).withColumn("shard", F.xxhash64("dim", "cell", part))
    shards = stored(dealt.select("shard", "dim", "id", "vector").groupBy("shard").applyInArrow(_shard(every), SHARD), "topk-shards")
    home = "array<struct<query_row:int,query_id:long,vec_id:long,score:long>>"
    blocks = stored(shards.where("queries > 0").select("shard", "dim", "ids", "vectors").repartition("shard").mapInArrow(_at_home(k, every), f"{BLOCK}, home {home}"), "topk-queries")

    packets = max(1, -(-shards.count() // PACKET))
    packet = F.pmod(F.xxhash64("shard"), F.lit(packets))
    boxes = shards.select("dim", packet.alias("packet"), F.struct("shard", "low", "high").alias("box")).groupBy("dim", "packet").agg(F.collect_list("box").alias("boxes"))
    asking = blocks.drop("home").withColumn("packet", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(packets - 1).cast("long"))))
    met = asking.join(boxes, ["dim", "packet"]).select(*_BLOCK_NAMES, "boxes")
    sent = stored(met.mapInArrow(trimmed(_sent), f"target long, n int, {BLOCK}"), "topk-sent")
    loads = stored(sent.groupBy("target").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / TASK_QUERIES)).cast("int").alias("parts")), "topk-loads")
    right = sent.join(loads, "target").withColumn("h", F.pmod(F.xxhash64("shard"), F.col("parts")).cast("int")).drop("parts")
    left = shards.select(F.col("shard").alias("s"), "dim", "ids", "vectors").join(loads, F.col("s") == F.col("target")).select("s", "dim", "ids", "vectors", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("g"))
    away = left.groupBy("s", "g").cogroup(right.groupBy("target", "h")).applyInArrow(_away(k), HIT)
    near = blocks.select(F.col("shard").alias("query_shard"), F.explode("home").alias("x")).select("query_shard", "x.query_row", "x.query_id", "x.vec_id", "x.score")
    order = Window.partitionBy("query_shard", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = near.unionByName(away).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op3_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v, row_number() OVER () AS r
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, q.r AS query, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""
