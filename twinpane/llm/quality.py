"""Quality classifier: a byte-level convolutional network in numpy (operator 8).

A filter is a table of weights by position and byte, so a convolution over one-hot bytes is a sum of table look-ups.
The bytes of a whole document are covered by chunks that overlap by half. Each filter's response (with a rectifier)
is max-pooled within each chunk; the largest and the mean of a filter's chunk values are the features of the document,
and one logistic unit combines them into a probability.

Training runs on the driver with Adam on a bounded sample of labelled rows (`sample_rows`, the rows with the smallest
hashes of their ids; each text whole, up to `sample_bytes` in all: a text that would pass this is left out and the next
ones are tried). Scoring runs over every whole text, row by row; a long one goes through in pieces, of which only the
maxima of half chunks are held.

Defined results: null text counts as empty, and an empty text has zero features, so its score is that of the bias.
Rows that repeat are scored alike. With labels of one class only, or none, every score is the (smoothed) share of
label 1. Labels other than 0 and 1 are not used. An empty table gives an empty result. Columns of the input with the names of the results give way to them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices, utf8
from .common import crc_fold, table, trimmed

WIDTH, FILTERS, STRIDE = 6, 16, 2
HALF = 128  # positions in half a chunk: a chunk covers 512 bytes and starts 256 bytes after the one before
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 24 << 20
LONG = 1 << 18  # bytes of a text that is scored by itself, in pieces


class Network:
    def __init__(self, rng: np.random.Generator, prior: float = 0.5):
        self.tables = rng.normal(0, 0.35, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.tables[:, 0] = 0  # padding
        self.bias = np.zeros(FILTERS, np.float32)
        self.weights = rng.normal(0, 0.2, 2 * FILTERS).astype(np.float32)
        self.offset = np.array([np.log(prior / (1 - prior))], np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.tables, self.bias, self.weights, self.offset]

    def forward(self, data: np.ndarray, offsets: np.ndarray, keep: bool = False):
        """Features of each row; with keep also what the gradient needs."""
        sizes = np.diff(offsets)
        spots = -(-sizes // STRIDE)
        filled = np.flatnonzero(sizes)
        features = np.zeros((len(sizes), 2 * FILTERS), self.tables.dtype)
        if not len(filled):
            return features, None
        # Each row starts at an even place and ends in zeros.
        room = spots * STRIDE + STRIDE * WIDTH
        begin = np.cumsum(room) - room
        padded = np.zeros(int(room.sum()) + WIDTH, np.uint8)
        padded[np.repeat(begin - offsets[:-1], sizes) + np.arange(len(data))] = data
        halves = -(-spots // HALF)
        first = np.cumsum(spots) - spots
        at = np.repeat(begin - first * STRIDE, spots) + np.arange(int(spots.sum())) * STRIDE
        value = self.tables[0][padded[at]]
        for j in range(1, WIDTH):
            value += self.tables[j][padded[at + j]]
        value += self.bias
        half_of = np.cumsum(halves) - halves
        edges = np.repeat(first - half_of * HALF, halves) + np.arange(int(halves.sum())) * HALF
        top = np.maximum.reduceat(value, edges, axis=0)
        # Chunk = two neighbouring halves; a row with one half has one chunk.
        chunks = np.maximum(halves - 1, np.minimum(halves, 1))
        chunk_of = np.cumsum(chunks) - chunks
        left = np.repeat(half_of - chunk_of, chunks) + np.arange(int(chunks.sum()))
        right = left + np.repeat((halves > 1).astype(np.int64), chunks)
        pooled = np.maximum(np.maximum(top[left], top[right]), 0)
        starts = chunk_of[filled]
        features[filled, :FILTERS] = np.maximum.reduceat(pooled, starts, axis=0)
        features[filled, FILTERS:] = np.add.reduceat(pooled, starts, axis=0) / chunks[filled][:, None]
        return features, (padded, at, value, edges, top, left, right, pooled, chunks, filled) if keep else None

    def long_features(self, data: np.ndarray, halves_at_once: int = 64) -> np.ndarray:
        """The features of one text, by pieces of some half chunks."""
        spots = -(-len(data) // STRIDE)
        halves = -(-spots // HALF)
        top = np.empty((halves, FILTERS), self.tables.dtype)
        for h in range(0, halves, halves_at_once):
            a, b = h * HALF, min((h + halves_at_once) * HALF, spots)
            piece = np.zeros((b - a - 1) * STRIDE + WIDTH, np.uint8)
            some = data[a * STRIDE : a * STRIDE + len(piece)]
            piece[: len(some)] = some
            at = np.arange(b - a) * STRIDE
            value = self.tables[0][piece[at]]
            for j in range(1, WIDTH):
                value += self.tables[j][piece[at + j]]
            value += self.bias
            top[h : h + halves_at_once] = np.maximum.reduceat(value, np.arange(0, b - a, HALF), axis=0)
        pooled = np.maximum(np.maximum(top[:-1], top[1:]) if halves > 1 else top, 0)
        return np.concatenate([pooled.max(0), pooled.sum(0) / len(pooled)])[None, :].astype(self.tables.dtype)

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) == 2 and len(data) > LONG:
            return self.long_features(data)
        return self.forward(data, offsets)[0]

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.offset[0], -30, 30).astype(np.float64)))

    def gradient(self, features: np.ndarray, kept, error: np.ndarray) -> list[np.ndarray]:
        """Of the mean loss; error: probability minus label, over the number of rows."""
        d_weights, d_offset = features.T @ error, np.array([error.sum()], np.float32)
        d_tables, d_bias = np.zeros_like(self.tables), np.zeros_like(self.bias)
        if kept is not None:
            padded, at, value, edges, top, left, right, pooled, chunks, filled = kept
            row = np.repeat(np.arange(len(filled)), chunks[filled])
            back = error[filled][:, None] * self.weights[None, :]
            # Neighbouring chunks share a half, so a maximum may stand in two chunks: the first one gets the gradient.
            best = np.zeros(pooled.shape, bool)
            top_chunk, top_filter = np.nonzero(pooled == features[filled][row, :FILTERS])
            _, once = np.unique(row[top_chunk] * FILTERS + top_filter, return_index=True)
            best[top_chunk[once], top_filter[once]] = True
            flow = back[row, FILTERS:] / chunks[filled][row][:, None] + np.where(best, back[row, :FILTERS], 0)
            flow[pooled <= 0] = 0
            source = np.where(top[left] >= top[right], left[:, None], right[:, None])
            chunk, filt = np.nonzero(flow)
            half, amount = source[chunk, filt], flow[chunk, filt]
            # The place of the maximum of each half and filter that gets any gradient.
            both, inverse = np.unique(half * FILTERS + filt, return_inverse=True)
            amount = np.bincount(inverse, amount, len(both)).astype(np.float32)
            half, filt = both // FILTERS, both % FILTERS
            ends = np.append(edges[1:], len(value))
            length = int((ends - edges).max())
            place = np.minimum(edges[half][:, None] + np.arange(length), (ends[half] - 1)[:, None])
            spot = place[np.arange(len(half)), np.argmax(value[place, filt[:, None]], axis=1)]
            d_bias += np.bincount(filt, amount, FILTERS).astype(np.float32)
            for j in range(WIDTH):
                key = padded[at[spot] + j].astype(np.int64) * FILTERS + filt
                d_tables[j] += np.bincount(key, amount, 256 * FILTERS).reshape(256, FILTERS).astype(np.float32)
            d_tables[:, 0] = 0
        return [d_tables, d_bias, d_weights.astype(np.float32), d_offset.astype(np.float32)]


def fit(texts: list[bytes], labels: np.ndarray, *, seed: int = 7, epochs: int = 8, batch: int = 48, rate: float = 0.01) -> Network:
    """Adam on the logistic loss; deterministic."""
    rng = np.random.Generator(np.random.PCG64(seed))
    prior = (labels.sum() + 1) / (len(labels) + 2)
    net = Network(rng, float(prior))
    if len(set(labels.tolist())) < 2:
        net.weights[:] = 0
        return net
    means, squares, step = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()], 0
    rounds = max(epochs, -(-300 * batch // len(texts))) if len(texts) < 2000 else epochs
    total = rounds * -(-len(texts) // batch)
    for _ in range(rounds):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            sizes = np.array([len(texts[k]) for k in some])
            offsets = np.zeros(len(some) + 1, np.int64)
            np.cumsum(sizes, out=offsets[1:])
            data = np.frombuffer(b"".join(texts[k] for k in some), np.uint8)
            features, kept = net.forward(data, offsets, keep=True)
            error = ((net.probability(features) - labels[some]) / len(some)).astype(np.float32)
            step += 1
            slow = rate * (1 - 0.9 * step / total)
            for p, g, m, v in zip(net.parameters(), net.gradient(features, kept, error), means, squares, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= slow * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def train(docs: DataFrame, labels: DataFrame, *, row_id: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """Learns from the labels with the smallest hashes of their ids: at most sample_rows of them and sample_bytes of text.

    The sample is drawn from the labels alone, so only it is sent to the documents, and only its texts come back.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(row_id).isNotNull()).select(F.xxhash64(row_id).alias("h"), F.col(row_id).alias("id"), F.col(label).cast("int").alias("label"))
    picked = F.broadcast(docs.sparkSession.createDataFrame(known.orderBy("h", "id", "label").limit(sample_rows).collect(), known.schema))
    bytes_of = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    rows = docs.select(F.col(row_id).alias("id"), bytes_of.alias("text")).join(picked, "id")
    sizes = rows.groupBy("h").agg(F.sum(F.length("text")).alias("size")).orderBy("h").collect()
    total, fitting = 0, []
    for r in sizes:
        if total + r["size"] <= sample_bytes:
            total += r["size"]
            fitting.append((r["h"],))
    chosen = F.broadcast(docs.sparkSession.createDataFrame(fitting, "h long"))  # at most sample_rows
    got = rows.join(chosen, "h", "left_semi").collect()
    got = sorted(got, key=lambda r: (r["h"], bytes(r["text"]), r["label"]))
    return fit([bytes(r["text"]) for r in got], np.array([r["label"] for r in got], np.float64))


def score(docs: DataFrame, net: Network, *, text: str = "text", keep: list[str] | None = None, into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns `keep` of docs (default: all), the probability and the prediction for every whole text."""
    keep = [c for c in (keep or docs.columns) if c not in into]
    held = docs.sparkSession.sparkContext.broadcast(net)

    @trimmed
    def run(batches):
        for whole in batches:
            for batch in slices(whole, text, LONG):
                p = held.value.probability(held.value.features(*utf8(batch.column(text))))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*keep, *into])

    schema = docs.select(*keep, F.lit(0.0).alias(into[0]), F.lit(0).alias(into[1])).schema
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = crc_fold("doc_id", 3) == 1
    net = train(docs, labels.where(~held))
    return score(docs.select("doc_id", "text"), net, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "score", "predicted")
