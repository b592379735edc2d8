"""Language-model scoring by deleted interpolation (operator 10).

P(w | u) = a * c(u w) / c(u) + b * c(w) / N + (1 - a - b) / (V + 1), with weights by the frequency of the context u.
The weights are learned by expectation-maximisation on held-out counts: every training token is held out in turn, that
is, scored with counts from which it has been deleted.

How the counts travel: documents are packed into blocks of some megabytes of text. Python tasks write them, some blocks a
file, to the shared folder and read them there, so Spark's rows hold no texts, only the names of files. A block sends its
distinct words and pairs of words, as sorted hashes with their counts in the block's training texts, to slices of
the hash space; a slice adds up the counts of all blocks and answers each block with what the others have, in the order
it asked.
So a word or pair travels once per block in which it stands, however often, and no task holds more than one slice or
one block. The answers are a table in the shared folder, with a part for each file of blocks, that the file's task reads once; texts
are not shuffled.

What goes to the driver is bounded: N, V, and a histogram of the held-out tokens by context frequency and by rounded
logarithms of the two estimates (mean estimates are kept per cell), on which the weights are learned.

Defined results: a null text is empty and is the one token `end`. Words and pairs are hashed to 64 bits. Without training rows N
and V are 0 and every token has probability 1 in the base model and in the other. Rows that repeat count and are scored
each. A null id is kept. Columns of the input other than id and text are not read.
"""

from __future__ import annotations

import itertools
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import SPACED, mix, slices, utf8, words
from .common import PLAIN_FILES, crc_fold, release, scratch_path, stored, table, trimmed

BLOCK_BYTES, SLICE_ENTRIES, BLOCKS_A_FILE = 4 << 20, 2_000_000, 8
START, END = np.uint64(0x5EED5EED5EED5EED), np.uint64(0xE4D0E4D0E4D0E4D1)
BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("train", pa.binary()), ("offsets", pa.binary()), ("data", pa.binary())])
FILES = "file long, size long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
STEP, ITERATIONS = 0.05, 100


def _packed(batches, block_bytes: int):
    """Blocks of whole texts, as rows of BLOCK."""
    held: list = []
    total = 0

    def out():
        joined = pa.Table.from_batches(held).combine_chunks()
        data, offsets = utf8(joined.column("text"))
        row = [[uuid.uuid4().int >> 65], [joined.column("doc_id").to_pylist()], [joined.column("train").to_numpy().astype(np.uint8).tobytes()], [offsets.astype("<i8").tobytes()], [data.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, BLOCK.types, strict=True)], schema=BLOCK)

    for whole in batches:
        for batch in slices(whole, "text", block_bytes):
            size = len(utf8(batch.column("text"))[0])
            if held and total + size > block_bytes:
                yield out()
                held, total = [], 0
            held.append(batch)
            total += size
    if held:
        yield out()


def _pack(path: str, block_bytes: int):
    """Writes the blocks to files in the shared folder; a row of FILES for each. A task that runs again writes other files."""

    @trimmed
    def run(batches):
        store, root = pyarrow.fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        blocks = _packed(batches, block_bytes)
        for first in blocks:
            file, size = uuid.uuid4().int >> 65, 0
            with pyarrow.parquet.ParquetWriter(f"{root}/{file}.parquet", BLOCK, filesystem=store, compression="zstd", compression_level=3, use_dictionary=False, write_statistics=False, write_page_checksum=True) as out:
                for block in itertools.chain([first], itertools.islice(blocks, BLOCKS_A_FILE - 1)):
                    out.write_batch(block)  # a row group of its own
                    size += len(block.column("data")[0].as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([size], pa.int64())], ["file", "size"])

    return run


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and the index of every element among them."""
    order = np.argsort(x)
    ranked = x[order]
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    inverse = np.empty(len(x), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    return ranked[new], order[new], inverse


def blocks_of(path: str, batches):
    """The files of FILES batches and their blocks, one at a time, as rows of BLOCK."""
    store, root = pyarrow.fs.FileSystem.from_uri(path)
    for batch in batches:
        for file in batch.column("file").to_pylist():
            with pyarrow.parquet.ParquetFile(f"{root}/{file}.parquet", filesystem=store, page_checksum_verification=True) as held:
                for i in range(held.num_row_groups):
                    yield file, held.read_row_group(i, use_threads=False).to_pylist()[0]


class Block:
    """Tokens of a block: the words of each text and its end, their distinct values and those of pairs."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        offsets, data = np.frombuffer(row["offsets"], "<i8"), np.frombuffer(row["data"], np.uint8)
        self.train = np.frombuffer(row["train"], np.uint8).astype(bool)
        _, _, counts, hashed = words(data, offsets, SPACED)
        docs = len(counts) - 1
        self.sizes = np.diff(counts) + 1
        self.doc = np.repeat(np.arange(docs), self.sizes)
        token = np.full(len(hashed) + docs, END, np.uint64)
        token[np.arange(len(hashed)) + np.repeat(np.arange(docs), np.diff(counts))] = hashed
        first = np.cumsum(self.sizes) - self.sizes
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[first] = START
        self.words, _, self.word = distinct(token)
        pair = mix(before * np.uint64(0x9E3779B97F4A7C15) + token)
        self.pairs, at, self.pair = distinct(pair)
        # The context of the first token counts as often as texts end.
        previous = np.empty_like(self.word)
        previous[1:] = self.word[:-1]
        previous[first] = np.searchsorted(self.words, END)
        self.pair_word, self.pair_context = self.word[at], previous[at]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each word and each pair stands in the block's training texts."""
        learned = self.train[self.doc]
        return tuple(np.bincount(inverse[learned], minlength=len(values)) for values, inverse in ((self.words, self.word), (self.pairs, self.pair)))

    def asks(self, parts: int):
        """(kind, slice, hashes, counts in training texts), packed."""
        for kind, values, count in zip((1, 2), (self.words, self.pairs), self.counts(), strict=True):
            bounds = _bounds(parts)
            cuts = np.append(np.searchsorted(values, bounds), len(values))
            for part in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[part], cuts[part + 1]
                yield kind, part, pack_hashes(values[a:b]), pack_counts(count[a:b])


def pack_hashes(values: np.ndarray) -> bytes:
    """Sorted hashes as their differences, byte by byte: all lowest bytes, then all next ones, and so on.

    The high bytes of the differences are nearly all zero, so the shuffle's compression takes them away.
    """
    return np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_hashes(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1), dtype=np.uint64)


def pack_counts(count: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold the largest."""
    top = int(count.max(initial=0))
    return count.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // max(n, 1) or 1}")


def _bounds(parts: int) -> np.ndarray:
    return np.array([(i << 64) // parts for i in range(parts)], np.uint64)


ASK = "part int, kind int, file long, block long, hashes binary, counts binary"


def _asks(path: str, parts: int):
    @trimmed
    def run(batches):
        for file, row in blocks_of(path, batches):
            rows = [(part, kind, file, row["block"], h, c) for kind, part, h, c in Block(row).asks(parts)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in ASK.split(", ")])

    return run


ANSWER = "file long, block long, kind int, part int, totals binary, n long, v long"


def _answers(asked: pa.Table) -> pa.Table:
    """For each block that asked, what the others count of a slice and kind; and one row, of file -1, with N and V of the slice."""
    kind, part = asked.column("kind")[0].as_py(), asked.column("part")[0].as_py()
    hashes = [unpack_hashes(x) for x in asked.column("hashes").to_pylist()]
    counts = [unpack_counts(x, len(h)) for x, h in zip(asked.column("counts").to_pylist(), hashes, strict=True)]
    _, _, inverse = distinct(np.concatenate(hashes))
    total = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
    out, at = [], 0
    for h, c in zip(hashes, counts, strict=True):
        out.append(pack_counts(total[inverse[at : at + len(h)]] - c))
        at += len(h)
    n = len(hashes) + 1
    release()
    columns = [pa.array([*asked.column("file").to_pylist(), -1], pa.int64()), pa.array([*asked.column("block").to_pylist(), None], pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array([*out, None], pa.binary()), pa.array([None] * (n - 1) + [int(total.sum())], pa.int64()), pa.array([None] * (n - 1) + [int((total > 0).sum())], pa.int64())]
    return pa.table(columns, names=["file", "block", "kind", "part", "totals", "n", "v"])


class _Shelf:
    """Reads the answers to a file's blocks from the table of answers, once for each file."""

    def __init__(self, path: str, parts: int):
        self.path, self.parts, self.file, self.answers = path, parts, None, {}

    def _read(self, file: int) -> None:
        self.file, self.answers = file, {}
        store, root = pyarrow.fs.FileSystem.from_uri(self.path)
        checked = pyarrow.dataset.ParquetFileFormat(default_fragment_scan_options=pyarrow.dataset.ParquetFragmentScanOptions(page_checksum_verification=True))
        for got in pyarrow.dataset.dataset(f"{root}/file={file}", filesystem=store, format=checked).to_batches(columns=["block", "kind", "part", "totals"], batch_readahead=1, fragment_readahead=1, use_threads=False):
            for block, kind, part, totals in zip(*(x.to_pylist() for x in got.columns), strict=True):
                self.answers.setdefault(block, {})[kind, part] = totals

    def totals(self, block: Block, key: int, file: int) -> tuple[np.ndarray, np.ndarray]:
        if self.file != file:
            self._read(file)
        answers = self.answers[key]
        out = []
        for kind, values, own in zip((1, 2), (block.words, block.pairs), block.counts(), strict=True):
            sizes = np.diff(np.append(np.searchsorted(values, _bounds(self.parts)), len(values)))
            others = [unpack_counts(answers[kind, part], sizes[part]) for part in np.flatnonzero(sizes).tolist()]
            out.append(own + np.concatenate(others).astype(np.float64))
        return out[0], out[1]


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 + the whole logarithm to base 2."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0).astype(np.int64)


HISTOGRAM = "context int, p2 int, p1 int, n long, sum2 double, sum1 double"


def _held_out(path: str, shelf: _Shelf, n: int):
    """The histogram of the training tokens of each block, each scored with itself deleted."""

    @trimmed
    def run(batches):
        for file, row in blocks_of(path, batches):
            block = Block(row)
            word, pair = shelf.totals(block, row["block"], file)
            weight = np.bincount(block.pair[block.train[block.doc]], minlength=len(block.pairs))
            some = weight > 0
            weight, c2, c1, c = weight[some], pair[some] - 1, word[block.pair_context[some]] - 1, word[block.pair_word[some]] - 1
            p2, p1 = c2 / np.maximum(c1, 1), c / max(n - 1, 1)
            # Cells: context bucket, then the two estimates by STEP of their logarithms, 0 for an estimate of none.
            cell = lambda p: np.where(p > 0, np.maximum(np.log10(np.maximum(p, 1e-300)) / STEP, -4000).astype(np.int64) - 1, 0) + 8191
            keys, _, inverse = distinct((context_bucket(c1) << 26) + (cell(p2) << 13) + cell(p1))
            sums = [np.bincount(inverse, w) for w in (weight, weight * p2, weight * p1)]
            if len(keys):
                yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in (keys >> 26, keys >> 13 & 8191, keys & 8191)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], [x.split()[0] for x in HISTOGRAM.split(", ")])

    return run


def weights(rows: list, v: int, iterations: int = ITERATIONS) -> dict[int, tuple[float, float, float]]:
    """EM for the weights of each context bucket; one count for each component keeps all above zero."""
    out = {}
    p0 = 1 / (v + 1)
    by: dict[int, list] = {}
    for context, n, sum2, sum1 in rows:
        by.setdefault(context, []).append((n, sum2 / n, sum1 / n))
    for context, cells in by.items():
        n, p2, p1 = (np.array(x, float) for x in zip(*cells, strict=True))
        parts = np.stack([p2 if context else np.zeros_like(p2), p1, np.full_like(p1, p0)])
        lam = np.full(3, 1 / 3)
        for _ in range(iterations):
            share = lam[:, None] * parts
            lam = (share / share.sum(0) * n).sum(1) + 1
            lam /= lam.sum()
        if not context:
            lam = np.array([0, lam[1] + lam[0] * 0.5, lam[2] + lam[0] * 0.5])
        out[context] = tuple(lam.tolist())
    return out


def _weights_of(context: np.ndarray, lam: dict[int, tuple]) -> np.ndarray:
    """Rows of weights; a bucket that was never held out takes those of the nearest lower one that was."""
    table = np.zeros((66, 3))
    last = lam.get(0, (0.0, 0.5, 0.5))
    for b in range(66):
        last = lam.get(b, last)
        table[b] = last if b else lam.get(0, (0.0, 0.5, 0.5))
    return table[context]


def _scores(path: str, shelf: _Shelf, n: int, v: int, lam: dict):
    @trimmed
    def run(batches):
        for file, row in blocks_of(path, batches):
            block = Block(row)
            word, pair = shelf.totals(block, row["block"], file)
            docs = len(block.sizes)
            base = np.log10((word + 1) / (n + v + 1))
            lam_of = _weights_of(context_bucket(word[block.pair_context]), lam)
            context = word[block.pair_context]
            p = lam_of[:, 0] * pair / np.maximum(context, 1) + lam_of[:, 1] * word[block.pair_word] / max(n, 1) + lam_of[:, 2] / (v + 1)
            log_p = np.log10(p) if n else np.zeros(len(p))
            sums = lambda x: np.bincount(block.doc, x, docs)
            columns = [pa.array(block.ids, pa.int64()), pa.array(~block.train), pa.array(block.sizes), pa.array(sums((word > 0)[block.word].astype(float)).astype(np.int64)), pa.array(sums(base[block.word])), pa.array(sums(log_p[block.pair]))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCORES.split(", ")])

    return run


def score_corpus(docs: DataFrame, train: Column, *, row_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, slice_entries: int = SLICE_ENTRIES) -> DataFrame:
    """Scores every row of docs with the model of the rows for which `train` holds; the columns of SCORES and train_tokens."""
    read = docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    texts, answers = (scratch_path(docs.sparkSession, name) for name in ("lm-texts", "lm-answers"))
    files = stored(read.mapInArrow(_pack(texts, block_bytes), FILES), "lm-files")
    n_files, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(24, -(-size // (6 * slice_entries)))
    dealt = files.repartition(max(1, n_files))
    answered = dealt.mapInArrow(_asks(texts, parts), ASK).groupBy("part", "kind").applyInArrow(_answers, ANSWER)
    answered.repartition(max(1, n_files), "file").sortWithinPartitions("file", "block").write.options(**PLAIN_FILES).partitionBy("file").parquet(answers, compression="zstd")
    n = v = 0
    if n_files:
        n, v = docs.sparkSession.read.schema("kind int, n long, v long").parquet(f"{answers}/file=-1").where("kind = 1").agg(F.sum("n"), F.sum("v")).first()
    shelf = _Shelf(answers, parts)
    cells = dealt.mapInArrow(_held_out(texts, shelf, n), HISTOGRAM).groupBy("context", "p2", "p1").agg(*(F.sum(c).alias(c) for c in ("n", "sum2", "sum1")))
    lam = weights([(r["context"], r["n"], r["sum2"], r["sum1"]) for r in cells.collect()], v)
    return dealt.mapInArrow(_scores(texts, shelf, n, v, lam), SCORES).withColumn("train_tokens", F.lit(n).cast("long"))


def op10_lm(spark, sf_dir: str) -> DataFrame:
    held = crc_fold("doc_id", 7) == 2
    found = score_corpus(table(spark, sf_dir, "documents"), ~held)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
