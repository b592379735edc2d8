"""N-gram Jaccard join with grouped prefixes (operator 5).

A document's set is that of its distinct word shingles. Two sets of Jaccard similarity of at least t share a shingle
among the first |x| - ceil(t|x|) + 1 of each, in any order of all shingles that both follow. The order used here puts
shingles that are frequent last (by counts of heavy hitters), so that passages which many documents share seldom stand
in a prefix.

1. Documents with equal sets are one class; classes with equal prefix and size are one group.
2. Each prefix shingle has a bucket of groups. A small bucket gives all its pairs of fitting sizes. A large one gives
   only pairs with a few pivots per band of sizes, so its pairs grow with its rows and not with their square.
3. A pair of groups goes on only if bitmaps of its prefixes allow enough overlap; it is expanded to its classes, which
   go on if bitmaps of their whole sets do, and the rest are verified on their whole texts. Bits that differ between
   two bitmaps stand for elements that differ, so a bitmap never loses a link.
4. Connected components of the verified links (large-star and small-star steps).
5. In the large buckets, what the pivots left in other components than most of the bucket is compared with the rows of
   other components in cells of bounded bytes: bitmaps first, then the whole sets of the rows that have a possible
   partner left. No link between different components is lost, pairs within one component are not compared, and only
   links leave a cell. Rows that all come near the limit without linking are still compared pair by pair there.

Result: the component of every row; links within a component need not all be made for that.

Defined results: null texts and texts without words have empty sets, n_shingles 0 and a component of their own. Rows are
documents: rows that repeat an id stand for themselves, by their texts. Rows without an id link like any others; a
component of such rows alone has a null id. deduplicate() keeps one row of each component: that of the smallest id, rows
without an id last, then of the smallest text hash; of rows with the same id and text any one. Long texts are whole. Empty tables give empty results. Other columns are not touched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SPACED, grams, slices, utf8, words
from .common import drop_tables, marked, release, stored, table, trimmed

WORDS, PERCENT = 5, 80
HOT_MIN, HOT_MAX = 16, 2_000_000
SMALL, PIVOTS = 40, 8
#: Bytes of one side of a cell: of bitmaps, and of texts.
CELL_STRAYS, CELL_ROWS = 512 << 10, 2 << 20
TEXT_STRAYS, TEXT_ROWS = 2 << 20, 8 << 20
BAND = 1.25  # sizes of linked sets differ by this factor at most, at 80 %
PROFILE = "doc_id long, th long, n int, node long, sig binary, grp long, pre binary, end_df int, pbits binary, bits binary"
#: Bits of a bitmap for each element, at least: of a prefix, whose elements count once each, and of a whole set.
PREFIX_BITS, SET_BITS = 8, 2


def needed_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


def sets_of(batch: pa.RecordBatch, text: str, size: int):
    """For each row of a batch its sorted distinct shingle hashes (uint64)."""
    for part in slices(batch, text):
        _, _, counts, hashed = words(*utf8(part.column(text)), SPACED)
        whole = grams(hashed, size)
        for a, z in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
            if z - a >= size:
                yield np.unique(whole[a : z - size + 1])
            else:
                yield grams(hashed[a:z], z - a) if z > a else np.zeros(0, np.uint64)


def bitmap(hashes: np.ndarray, factor: int) -> bytes:
    """A set as bits at the low ends of its hashes; sizes are powers of two, so a larger bitmap folds to a smaller one."""
    size = max(64, 1 << (max(len(hashes) * factor, 1) - 1).bit_length())
    found = np.zeros(size, bool)
    found[(hashes & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(found, bitorder="little").tobytes()


def most_common(x: bytes, nx: int, y: bytes, ny: int) -> int:
    """No more elements than this can be common to sets of these bitmaps and sizes."""
    size = min(len(x), len(y))
    return min(nx, ny, (nx + ny - (_folded(x, size) ^ _folded(y, size)).bit_count()) // 2)


def _folded(data: bytes, size: int) -> int:
    """A bitmap as an integer of `size` bytes."""
    value, now = int.from_bytes(data, "little"), len(data)
    while now > size:
        now //= 2
        value = (value & ((1 << 8 * now) - 1)) | (value >> 8 * now)
    return value


def signature(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _long(data: bytes) -> int:
    return int.from_bytes(data[:8], "little", signed=True)


def _heavy(text: str, size: int, held_most: int = 1 << 20):
    """Shingles that stand in two documents at least of one chunk of a task, with their counts there."""

    def out(held):
        found, count = np.unique(np.concatenate(held), return_counts=True)
        keep = count > 1
        return pa.RecordBatch.from_arrays([pa.array(found[keep].view(np.int64)), pa.array(count[keep].astype(np.int64))], ["tok", "df"])

    @trimmed
    def run(batches):
        held, total = [], 0
        for batch in batches:
            for hashes in sets_of(batch, text, size):
                held.append(hashes)
                total += len(hashes)
                if total >= held_most:
                    yield out(held)
                    held, total = [], 0
        if held:
            yield out(held)

    return run


def hot_shingles(docs: DataFrame, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles and their counts, sorted by shingle; at most HOT_MAX, the most frequent.

    Any order of the shingles gives right results, so this bound costs none: it only places shingles in the order.
    """
    counts = stored(docs.select(text).mapInArrow(_heavy(text, size), "tok long, df long").groupBy("tok").agg(F.sum("df").alias("df")).where(F.col("df") >= HOT_MIN), "jaccard-hot")
    least = HOT_MIN
    while counts.where(F.col("df") >= least).count() > HOT_MAX:
        least *= 2
    got = counts.where(F.col("df") >= least).toArrow()
    drop_tables(docs.sparkSession, counts)
    tok, df = got.column("tok").to_numpy().view(np.uint64), np.minimum(got.column("df").to_numpy(), 1 << 30)
    by = np.argsort(tok)
    return tok[by], df[by].astype(np.int64)


def _profiles(text: str, size: int, percent: int, hot):
    names = [x.split()[0] for x in PROFILE.split(", ")]
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary())

    def row(hashes, tok, df):
        n = len(hashes)
        if not n:
            return (0, *[None] * 7)
        p = n - int(needed_overlap(np.int64(n), percent)) + 1
        pre, end = hashes[:p], 0
        if len(tok):
            at = np.minimum(np.searchsorted(tok, hashes), len(tok) - 1)
            often = np.where(tok[at] == hashes, df[at], 0)
            if often.any():
                order = np.lexsort((hashes, often))[:p]
                pre, end = hashes[order], int(often[order[-1]])
        sig, data = signature(hashes), pre.tobytes()
        return n, _long(sig), sig, _long(hashlib.blake2b(data + n.to_bytes(8, "little"), digest_size=8).digest()), data, end, bitmap(pre, PREFIX_BITS), bitmap(hashes, SET_BITS)

    @trimmed
    def run(batches):
        tok, df = hot.value
        for batch in (part for whole in batches for part in slices(whole, text)):
            columns = list(zip(*(row(hashes, tok, df) for hashes in sets_of(batch, text, size)), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("th"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    return run


def _postings(batches):
    for batch in batches:
        sizes = [len(x) // 8 for x in batch.column("pre").to_pylist()]
        tok = np.concatenate([np.frombuffer(x, np.int64) for x in batch.column("pre").to_pylist()] or [np.zeros(0, np.int64)])
        grp, n = batch.column("grp").to_numpy(), batch.column("n").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(tok), pa.array(np.repeat(grp, sizes)), pa.array(np.repeat(n, sizes))], ["tok", "id", "n"])


def fits(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Do the sizes of two sets allow the similarity?"""
    return 100 * np.minimum(a, b).astype(np.int64) >= percent * np.maximum(a, b).astype(np.int64)


class _Buckets:
    """Pairs of the buckets of a sorted stream of (tok, band, id, n)."""

    def __init__(self, percent: int):
        self.percent, self.pivots = percent, {}
        self.tok = None

    def small(self, ids, n, starts, size):
        i, j = np.triu_indices(size, 1)
        a, b = starts[:, None] + i, starts[:, None] + j
        good = fits(n[a], n[b], self.percent) & (ids[a] != ids[b])
        return ids[a[good]], ids[b[good]]

    def large(self, tok, band, ids, n):
        """A piece of a large bucket against the pivots of its bands and the next lower ones."""
        if tok != self.tok:
            self.tok, self.pivots = tok, {}
        out_a, out_b = [], []
        for value in np.unique(band).tolist():
            here = band == value
            mine_id, mine_n = ids[here], n[here]
            if value not in self.pivots:
                self.pivots[value] = mine_id[:PIVOTS], mine_n[:PIVOTS]
                self.pivots = {k: v for k, v in self.pivots.items() if k >= value - 1}
            for key in (value - 1, value):
                for p_id, p_n in zip(*self.pivots.get(key, ((), ())), strict=True):
                    good = fits(mine_n, p_n, self.percent) & (mine_id != p_id)
                    out_a.append(np.full(int(good.sum()), p_id))
                    out_b.append(mine_id[good])
        return np.concatenate(out_a), np.concatenate(out_b)


def _bucket_pairs(percent: int):
    """Rows (a, b, tok, n): pairs have a null tok; the rows of large buckets come as (id, null, tok, n)."""

    def rows(a, b, tok=None, n=None):
        a, b = (a, b) if b is None else (np.minimum(a, b), np.maximum(a, b))
        none = lambda t: pa.nulls(len(a), t)
        return pa.RecordBatch.from_arrays([pa.array(a), none(pa.int64()) if b is None else pa.array(b), none(pa.int64()) if tok is None else pa.array(tok), none(pa.int32()) if n is None else pa.array(n)], ["a", "b", "tok", "n"])

    @trimmed
    def run(batches):
        state, rest = _Buckets(percent), None
        large_tok = None

        def work(part, last: bool):
            nonlocal rest, large_tok
            tok, band, ids, n = part
            cut = np.flatnonzero(tok[1:] != tok[:-1]) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(tok)]
            if not last:
                begin = int(starts[-1])
                hold = len(tok) - begin < 200_000 and tok[begin] != large_tok
                if hold:
                    rest = tuple(x[begin:] for x in part)
                    starts, ends = starts[:-1], ends[:-1]
            sizes = ends - starts
            more = (sizes > SMALL) | ((tok[starts] == large_tok) if large_tok is not None else False) if len(starts) else np.zeros(0, bool)
            if not last and len(starts) and ends[-1] == len(tok):
                more[-1] = True  # a bucket too long to hold goes on
                large_tok = tok[starts[-1]]
            out = []
            for size in np.unique(sizes[~more & (sizes > 1)]).tolist():
                some = starts[~more & (sizes == size)]
                step = max(1, 400_000 // (size * size))
                for i in range(0, len(some), step):
                    a, b = state.small(ids, n, some[i : i + step], size)
                    if len(a):
                        out.append(rows(a, b))
            for s, e in zip(starts[more].tolist(), ends[more].tolist(), strict=True):
                a, b = state.large(tok[s], band[s:e], ids[s:e], n[s:e])
                if len(a):
                    out.append(rows(a, b))
                out.append(rows(ids[s:e], None, tok[s:e], n[s:e]))
            return out

        for batch in batches:
            part = tuple(batch.column(c).to_numpy() for c in ("tok", "band", "id", "n"))
            if rest is not None:
                part, rest = tuple(np.concatenate(x) for x in zip(rest, part, strict=True)), None
            if len(part[0]):
                yield from work(part, False)
        if rest is not None:
            part, rest = rest, None
            yield from work(part, True)

    return run


def bucket_pairs(postings: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b), and the rows (tok, id, n) of large buckets, of postings (tok, id, n)."""
    banded = postings.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND))).cast("int"))
    dealt = banded.repartition("tok").sortWithinPartitions("tok", "band", "id")
    found = stored(dealt.select("tok", "band", "id", "n").mapInArrow(_bucket_pairs(percent), "a long, b long, tok long, n int"), "jaccard-buckets")
    pairs = found.where("b is not null").select("a", "b").distinct()
    return pairs, found.where("b is null").select("tok", F.col("a").alias("id"), "n")


def _bounded(percent: int):
    """Prefixes: the one that ends first holds every common shingle up to its end."""

    @trimmed
    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "pa", "pb", "ea", "eb", "la", "lb", "xa", "xb")), strict=True)
            keep = []
            for na, nb, p, q, ea, eb, last_a, last_b, x, y in rows:
                common = most_common(x, p, y, q)
                first_a = (ea, int.from_bytes(last_a, "little")) <= (eb, int.from_bytes(last_b, "little"))
                n, p, other = (na, p, nb) if first_a else (nb, q, na)
                most = common + min(n - p, other - common)
                keep.append(100 * most >= percent * (na + nb - most))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["ga", "gb"])

    return run


def bounded(pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """The pairs whose groups' prefixes (columns ga, gb) allow the similarity."""
    one = lambda s: groups.select(F.col("grp").alias(f"g{s}"), F.col("n").alias(f"n{s}"), (F.length("pre") / 8).cast("int").alias(f"p{s}"), F.col("end_df").alias(f"e{s}"), F.substring("pre", -8, 8).alias(f"l{s}"), F.col("pbits").alias(f"x{s}"))
    joined = pairs.join(one("a"), "ga").join(one("b"), "gb").select("ga", "gb", "na", "nb", "pa", "pb", "ea", "eb", "la", "lb", "xa", "xb")
    return joined.mapInArrow(_bounded(percent), "ga long, gb long")


def _alike(percent: int):
    @trimmed
    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "xa", "xb")), strict=True)
            keep = [100 * (most := most_common(x, na, y, nb)) >= percent * (na + nb - most) for na, nb, x, y in rows]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes (a, b) whose bitmaps allow the similarity."""
    one = lambda s: classes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"x{s}"))
    joined = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "na", "nb", "xa", "xb")
    return joined.mapInArrow(_alike(percent), "a long, b long")


def _verified(size: int, percent: int):
    @trimmed
    def run(batches):
        for batch in (part for whole in batches for half in slices(whole, "ta") for part in slices(half, "tb")):
            keep = []
            for x, y in zip(sets_of(batch, "ta", size), sets_of(batch, "tb", size), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def texts_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of one document for each class in nodes (distinct)."""
    wanted = stored(nodes.join(classes.select("node", F.col("rep.doc_id").alias("r_id"), F.col("rep.th").alias("r_th")), "node"), "jaccard-wanted")
    maybe = marked(docs, wanted.select(F.col("r_id").alias("doc_id"), F.col("r_th").alias("th")), ["doc_id", "th"], "_dd_maybe").where("_dd_maybe").drop("_dd_maybe")
    once = maybe.groupBy("doc_id", "th").agg(F.first("text").alias("text"))
    return wanted.join(once, F.col("r_id").eqNullSafe(F.col("doc_id")) & (F.col("r_th") == F.col("th"))).select("node", "text")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs of classes (a, b) those that link, by the whole texts of one document each."""
    asked = stored(pairs, "jaccard-asked")
    texts = texts_of(asked.select(F.col("a").alias("node")).union(asked.select("b")).distinct(), classes, docs)
    texts = stored(texts, "jaccard-texts")
    text = lambda s: texts.select(F.col("node").alias(s), F.col("text").alias(f"t{s}"))
    both = asked.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb")
    links = stored(both.mapInArrow(_verified(size, percent), "a long, b long"), "jaccard-links")
    drop_tables(docs.sparkSession, asked, texts)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b); root is the smallest node reachable."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    before = None
    while True:
        spark = edges.sparkSession
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written first, so that a node with very many links is split in the join.
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars-low")
        wide = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        wide = stored(wide.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
        drop_tables(spark, low)
        low = stored(wide.groupBy("u").agg(F.min("v").alias("m")), "stars-low")
        close = wide.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        close = stored(close.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
        state = close.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_tables(spark, edges, wide, low)
        edges = close
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def _survivors(percent: int):
    """The ids of a cell's strays and rows that have a possible partner of another root by their bitmaps."""

    def matrix(table: pa.Table, names: list[str]):
        n, ident, root, bits = (table.column(c) for c in names)
        bits = bits.to_pylist()
        sizes = np.array([len(x) for x in bits], np.int64)
        return n.to_numpy(), ident.to_numpy(), root.to_numpy(), bits, sizes

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ln, lid, lroot, lbits, lsize = matrix(left, ["n", "id", "root", "bits"])
        rn, rid, rroot, rbits, rsize = matrix(right, ["r_n", "r_id", "r_root", "r_bits"])
        found, used = np.zeros(len(lid), bool), np.zeros(len(rid), bool)
        for size in np.unique(lsize).tolist():
            strays = np.flatnonzero(lsize == size)
            for other in np.unique(rsize).tolist():
                rows = np.flatnonzero(rsize == other)
                rows = rows[np.argsort(rn[rows], kind="stable")]
                small = min(size, other)
                fold = lambda data, long: np.bitwise_or.reduce(data.reshape(len(data), long // small, small // 8), axis=1)
                y = fold(np.frombuffer(b"".join(rbits[i] for i in rows.tolist()), np.uint64).reshape(len(rows), -1), other)
                x = fold(np.frombuffer(b"".join(lbits[i] for i in strays.tolist()), np.uint64).reshape(len(strays), -1), size)
                sorted_n = rn[rows].astype(np.int64)
                for i, data in zip(strays.tolist(), x, strict=True):
                    n = int(ln[i])
                    a, z = np.searchsorted(sorted_n, [-(-n * percent // 100), n * 100 // percent + 1])
                    if a < z:
                        both = sorted_n[a:z] + n
                        most = (both - np.bitwise_count(y[a:z] ^ data).sum(1, dtype=np.int64)) // 2
                        good = (100 * most >= percent * (both - most)) & (rroot[rows[a:z]] != lroot[i])
                        if good.any():
                            found[i] = True
                            used[rows[a:z][good]] = True
        release()
        return pa.table([pa.array(np.unique(np.concatenate([lid[found], rid[used]])))], names=["id"])

    return run


def _cell(size: int, percent: int):
    """Links between the strays and the rows of a cell, one for each stray and root."""

    def sets(rows: pa.Table, names: list[str]):
        rows = rows.select(names)
        found = [x for batch in rows.to_batches() for x in sets_of(batch, names[2], size)]
        return found, rows.column(names[0]).to_numpy(), rows.column(names[1]).to_numpy()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        (xs, x_id, x_root), (ys, y_id, y_root) = sets(left, ["id", "root", "text"]), sets(right, ["r_id", "r_root", "r_text"])
        if xs and ys:
            n = np.array([len(y) for y in ys])
            known, code = np.unique(np.concatenate(ys), return_inverse=True)
            starts = np.cumsum(n) - n
            here = np.zeros(len(known), np.int32)
            for x, name, root in zip(xs, x_id.tolist(), x_root.tolist(), strict=True):
                at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                at = at[known[at] == x]
                here[at] = 1
                both = np.add.reduceat(here[code], starts)
                here[at] = 0
                linked = np.flatnonzero((100 * both >= percent * (len(x) + n - both)) & (y_root != root))
                out += [(name, int(y_id[linked[i]])) for i in np.unique(y_root[linked], return_index=True)[1]]
        release()
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _cells(rows: DataFrame, weight: str, strays: int, most: int, columns: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """The strays and the rows of each `main` (those of other roots, and all), dealt into cells of bounded bytes on either side."""
    is_stray = F.col("root") != F.col("main")
    blocks = lambda x, size: F.greatest(F.lit(1), F.ceil(x / size)).cast("int")
    spans = stored(rows.groupBy("main").agg(blocks(F.sum(F.when(is_stray, F.length(weight)).otherwise(0)), strays).alias("sb"), blocks(F.sum(F.length(weight)), most).alias("rb")), "jaccard-spans")
    placed = rows.join(spans, "main")
    part = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["main", "i", "j"]
    left = placed.where(is_stray).withColumn("i", part("sb", 1)).withColumn("j", every("rb")).select(*key, *columns)
    right = placed.withColumn("j", part("rb", 2)).withColumn("i", every("sb")).select(*(F.col(c).alias(f"r_{c}") for c in (*key, *columns)))
    return left, right, key


def left_over(large: DataFrame, roots: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links that the pivots left open in large buckets (tok, id).

    In a bucket whose rows have several roots, the strays, those outside the most common one, are compared with all
    rows of other roots. Buckets of the same most common root are taken together.
    """
    rows = large.join(roots, large["id"] == roots["node"], "left").select("tok", "id", F.coalesce("root", "id").alias("root"))
    rows = stored(rows, "jaccard-large")
    shares = rows.groupBy("tok", "root").agg(F.count("*").alias("k"))
    main = stored(shares.groupBy("tok").agg(F.count("*").alias("roots"), F.max(F.struct("k", "root"))["root"].alias("main")).where("roots > 1").select("tok", "main"), "jaccard-main")
    mixed = rows.join(main, "tok").select("main", "id", "root").distinct()
    rows = stored(mixed.join(classes.select(F.col("node").alias("id"), "n", "bits"), "id").select("main", "id", "root", "n", "bits"), "jaccard-mixed")
    left, right, key = _cells(rows, "bits", CELL_STRAYS, CELL_ROWS, ["n", "id", "root", "bits"])
    met = left.groupBy(key).cogroup(right.groupBy(*(f"r_{c}" for c in key))).applyInArrow(_survivors(percent), "id long")
    met = stored(met.distinct(), "jaccard-met")
    texts = texts_of(met.select(F.col("id").alias("node")), classes, docs)
    whole = stored(rows.select("main", "id", "root").join(texts.withColumnRenamed("node", "id"), "id"), "jaccard-whole")
    left, right, key = _cells(whole, "text", TEXT_STRAYS, TEXT_ROWS, ["id", "root", "text"])
    found = left.groupBy(key).cogroup(right.groupBy(*(f"r_{c}" for c in key))).applyInArrow(_cell(size, percent), "a long, b long")
    found = stored(found, "jaccard-left")
    drop_tables(docs.sparkSession, rows, met, whole, main)
    return found


def _joined(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc_id, text, th): the rows (doc_id, th, n, node) and the classes (node, cid, rep, root)."""
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(hot_shingles(docs, "text", size))
    profiles = stored(docs.mapInArrow(_profiles("text", size, percent, hot), PROFILE), "jaccard-profiles")
    hot.destroy()
    whole = profiles.where("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th"))
    classes = stored(whole.groupBy("node", "sig", "grp", "n").agg(F.min("doc_id").alias("cid"), first.alias("rep"), F.first("bits").alias("bits")), "jaccard-classes")
    groups = stored(whole.groupBy("grp", "n").agg(F.first("pre").alias("pre"), F.first("end_df").alias("end_df"), F.first("pbits").alias("pbits")), "jaccard-groups")
    narrow = stored(profiles.select("doc_id", "th", "n", "node"), "jaccard-rows")
    drop_tables(spark, profiles)

    pairs, large = bucket_pairs(groups.mapInArrow(_postings, "tok long, id long, n int"), percent)
    near = bounded(pairs.select(F.col("a").alias("ga"), F.col("b").alias("gb")), groups, percent)
    member = lambda s: classes.select(F.col("grp").alias(f"g{s}"), F.col("node").alias(s))
    expanded = near.join(member("a"), "ga").join(member("b"), "gb").select("a", "b")
    several = classes.groupBy("grp").agg(F.count("*").alias("k")).where("k > 1").select("grp")
    inner, inner_large = bucket_pairs(classes.join(several, "grp").select(F.col("grp").alias("tok"), F.col("node").alias("id"), "n"), percent)
    links = verified(alike(expanded.union(inner).distinct(), classes, percent), classes, docs, size, percent)
    drop_tables(spark, groups)
    roots = components(links)

    grouped = large.select("tok", F.col("id").alias("ga")).join(member("a"), "ga").select("tok", F.col("a").alias("id"))
    grouped = grouped.union(inner_large.select(F.xxhash64("tok"), "id"))
    if not grouped.isEmpty():
        more = left_over(grouped, roots, classes, docs, size, percent)
        if not more.isEmpty():
            roots = components(links.union(more))
    rooted = stored(classes.select("node", "cid", "rep").join(roots, "node", "left").select("node", "cid", "rep", F.coalesce("root", "node").alias("root")), "jaccard-rooted")
    drop_tables(spark, classes)
    return narrow, rooted


def _read(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    return docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))


def near_duplicates(docs: DataFrame, *, row_id: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    narrow, rooted = _joined(_read(docs, row_id, text), size, percent)
    named = stored(rooted.join(rooted.groupBy("root").agg(F.min("cid").alias("component_id")), "root").select("node", "component_id"), "jaccard-components")
    r, c = narrow.alias("r"), named.alias("c")
    found = r.join(c, F.col("r.node") == F.col("c.node"), "left")
    return found.select("r.doc_id", F.col("r.n").cast("long").alias("n_shingles"), F.when(F.col("r.node").isNull(), F.col("r.doc_id")).otherwise(F.col("c.component_id")).alias("component_id"))


def deduplicate(docs: DataFrame, *, row_id: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with exactly one row of each component; rows without words stay.

    Rows that go are named by id and text hash. Only rows that a bitmap of these keys marks are shuffled.
    """
    narrow, rooted = _joined(_read(docs, row_id, text), size, percent)
    best = rooted.groupBy("root").agg(F.min("rep").alias("best"))
    kept = rooted.join(best, "root").where(F.col("rep").eqNullSafe(F.col("best"))).select("node", F.col("rep.doc_id").alias("k_id"), F.col("rep.th").alias("k_th"))
    keys = narrow.where("n > 0").groupBy("doc_id", "th").agg(F.first("node").alias("node"), F.count("*").alias("k"))
    stays = F.col("k_th").isNotNull() & F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("th") == F.col("k_th"))
    judged = keys.join(kept, "node", "left").select("doc_id", "th", F.coalesce(stays, F.lit(False)).alias("stays"), "k")
    open_keys = stored(judged.where("not stays or k > 1").select(F.col("doc_id").alias("_dd_k_id"), F.col("th").alias("_dd_k_th"), "stays"), "jaccard-keys")
    own = docs.columns
    read = docs.withColumn("_dd_id", F.col(row_id).cast("long")).withColumn("_dd_th", F.xxhash64(text))
    read = marked(read, open_keys.select(F.col("_dd_k_id").alias("_dd_id"), F.col("_dd_k_th").alias("_dd_th")), ["_dd_id", "_dd_th"], "_dd_maybe")
    sure, maybe = read.where("not _dd_maybe").select(own), read.where("_dd_maybe")
    met = maybe.join(open_keys, F.col("_dd_id").eqNullSafe(F.col("_dd_k_id")) & (F.col("_dd_th") == F.col("_dd_k_th")), "left").where("stays or stays is null")
    # A repeated row that stays, stays once; others that the bitmap marked by chance are told apart by `stays`.
    once = met.where("stays").dropDuplicates(["_dd_id", "_dd_th"]).select(own)
    return sure.unionByName(met.where("stays is null").select(own)).unionByName(once)


def op5_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
