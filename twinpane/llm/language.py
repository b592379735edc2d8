"""Language identification by words first, then shorter and shorter character n-grams (operator 9).

Learning counts every word and every character n-gram of the labelled sample, per language; nothing that stands in it
is left out. The sample is bounded: each language has a share of `sample_bytes`, and if its texts are more than that,
those texts are taken whose hash lies under the share. That bound makes the broadcast safe, whatever the size of the
corpus. The model is sparse, an entry holds only the languages in which it stands, so many languages cost no more.

Scoring: a known word adds its log frequency in each language. An unseen word is scored by its n-grams of five
characters; if the model knows none of them, by those of four, and so on down to single characters, with a penalty for
each step. A language that lacks an entry counts as having it half a time. The prediction is the language of the
highest sum, its score the posterior probability.

Defined results: null text, or text without a letter: `und`, score 0. Texts of letters of which the model knows
nothing get the most frequent language with its prior probability. Without training rows every text is `und`. Ties go
to the language that comes first by name. Repeated rows count as often as they stand, in learning and in scoring. An
empty table gives an empty result. Long texts are read in pieces that end at a character that is no letter; a run of
letters longer than a piece (PIECE) is cut. A column of the input whose name is one of the results gives way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import mix, slices
from .common import crc_fold, drop_tables, stored, table, trimmed

ORDERS = (5, 4, 3, 2, 1)
SAMPLE_BYTES = 16 << 20
PIECE = 1 << 18
UNDETERMINED = "und"
_BASE = 0x9E3779B97F4A7C15 & ~7 | 5
_CODE = np.uint64(0xD6E8FEB86659FD93)
_SPACE = ord(" ")


_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)], bool)
_powers: list[np.ndarray] = []


def pieces(text: str, limit: int = PIECE):
    """Consecutive parts of a text, each ended by a character that is no letter; longer runs of letters are cut."""
    at = 0
    while len(text) - at > limit:
        cut = at + limit
        while cut > at and text[cut - 1].isalpha():
            cut -= 1
        cut = cut if cut > at else at + limit
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 18, 1 << (n - 1).bit_length())
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers.append(np.multiply.accumulate(step))
    return _powers[0], _powers[1]


class Batch:
    """Words of some texts: runs of letters, lower-cased, each with a space before and after."""

    def __init__(self, texts: list[str | None]):
        joined = [t.lower() if t else "" for t in texts]
        sizes = np.array([len(t) + 2 for t in joined], np.int64)
        codes = np.frombuffer("".join(" " + t + " " for t in joined).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _LETTER[codes] if len(codes) else np.zeros(0, bool)
        edge = np.flatnonzero(np.diff(letter.astype(np.int8)))
        self.starts, self.ends = edge[::2] + 1, edge[1::2] + 1
        self.codes = np.where(letter, codes, _SPACE).astype(np.uint64)
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(sizes, out=bounds[1:])
        self.counts = np.searchsorted(self.starts, bounds)
        power, self.inverse = _power(len(codes) + 1)
        self.total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix(self.codes * _CODE) * power[: len(codes)], out=self.total[1:])
        self.words = self.hashed(self.starts, self.ends)

    def hashed(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64) * _CODE)

    def grams(self, which: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of the words `which`, each with one space on either side, and for each its word in `which`."""
        pad = 1 if order > 1 else 0
        starts, ends = self.starts[which] - pad, self.ends[which] + pad
        count = np.maximum(ends - starts - order + 1, 0)
        owner = np.repeat(np.arange(len(which)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + starts[owner]
        return self.hashed(at, at + order), owner


def _tally(hashes: np.ndarray, langs: np.ndarray, weights: np.ndarray, order: int):
    """Sums of weights by (hash, language)."""
    if not len(hashes):
        return
    by = np.lexsort((langs, hashes))
    hashes, langs, weights = hashes[by], langs[by], weights[by]
    first = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (langs[1:] != langs[:-1])])
    yield order, hashes[first].view(np.int64), langs[first], np.add.reduceat(weights, first)


class _Learner:
    """Sums of a task, with at most about half a million entries held."""

    def __init__(self, codes: dict[str, int]):
        self.codes, self.held = codes, {}

    def rows(self):
        for order, parts in self.held.items():
            for _, h, lang, n in _tally(*(np.concatenate(x) for x in zip(*parts, strict=True)), order):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), order, np.int32)), pa.array(h), pa.array(lang.astype(np.int32)), pa.array(n)], ["n", "hash", "lang", "count"])
        self.held = {}

    def add(self, texts, langs):
        texts = [t or "" for t in texts]
        for text, lang in zip(texts, langs, strict=True):
            if len(text) > PIECE:
                for piece in pieces(text):
                    self._add([piece], [lang])
        short = [(t, x) for t, x in zip(texts, langs, strict=True) if len(t) <= PIECE]
        if short:
            self._add(*zip(*short, strict=True))

    def _add(self, texts, langs):
        batch = Batch(texts)
        of = np.array([self.codes[x] for x in langs], np.int64)
        word_lang = np.repeat(of, np.diff(batch.counts))
        key = batch.words * np.uint64(0x9E3779B1) + word_lang.astype(np.uint64)
        _, one, weight = np.unique(key, return_index=True, return_counts=True)
        self._hold(0, batch.words[one].view(np.uint64), word_lang[one], weight.astype(np.int64))
        for order in ORDERS:
            hashes, owner = batch.grams(one, order)
            for _, h, lang, n in _tally(hashes, word_lang[one][owner], weight[owner].astype(np.int64), order):
                self._hold(order, h.view(np.uint64), lang, n)

    def _hold(self, order, h, lang, n):
        self.held.setdefault(order, []).append((h, lang, n))

    def size(self) -> int:
        return sum(len(p[0]) for parts in self.held.values() for p in parts)


class Table:
    """The entries of one kind: for each its languages and by how much its log frequency there exceeds the floor."""

    def __init__(self, hashes: np.ndarray, langs: np.ndarray, counts: np.ndarray, totals: np.ndarray):
        by = np.lexsort((langs, hashes))
        self.known, first = np.unique(hashes[by], return_index=True)
        self.ptr = np.append(first, len(by)).astype(np.int64)
        self.lang = langs[by].astype(np.int32)
        self.floor = np.log(0.5 / totals)
        self.logs = (np.log(counts[by] / totals[self.lang]) - self.floor[self.lang]).astype(np.float32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.known) or not len(hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return at, self.known[at] == hashes

    def sums(self, at: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
        """For each group the sum of the log frequencies of its entries, by language."""
        k = len(self.floor)
        size = self.ptr[at + 1] - self.ptr[at]
        spot = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - self.ptr[at], size)
        out = np.bincount(np.repeat(group, size) * k + self.lang[spot], self.logs[spot], groups * k).reshape(groups, k)
        return out + np.bincount(group, minlength=groups)[:, None] * self.floor


class Model:
    """Tables by order (0: words) and the prior of each language."""

    def __init__(self, languages: list[str], prior: np.ndarray, tables: dict[int, Table]):
        self.languages, self.prior, self.tables = languages, prior, tables

    def points(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The sum of each text by language, without the prior; the number of words."""
        batch, k = Batch(texts), len(self.languages)
        sizes = np.diff(batch.counts)
        of = np.repeat(np.arange(len(texts)), sizes)
        at, known = self.tables[0].find(batch.words)
        total = self.tables[0].sums(at[known], of[known], len(texts))
        unseen = np.flatnonzero(~known)
        if len(unseen):
            _, one, back = np.unique(batch.words[unseen], return_index=True, return_inverse=True)
            rest, found = unseen[one], np.zeros((len(one), k))
            left = np.arange(len(rest))
            for step, order in enumerate(ORDERS):
                hashes, owner = batch.grams(rest[left], order)
                at, good = self.tables[order].find(hashes)
                n = np.bincount(owner[good], minlength=len(left))
                sums = self.tables[order].sums(at[good], owner[good], len(left))
                # An n-gram overlaps its neighbours: their mean, once per `order` characters.
                length = np.maximum((batch.ends - batch.starts)[rest[left]] / order, 1)
                hit = n > 0
                found[left[hit]] = (sums[hit] / n[hit][:, None]) * length[hit][:, None] - step
                left = left[~hit]
                if not len(left):
                    break
            for i in range(0, len(unseen), 8192):
                np.add.at(total, of[unseen[i : i + 8192]], found[back[i : i + 8192]])
        return total, sizes

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        total, words = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        short = [i for i, t in enumerate(texts) if t and len(t) <= PIECE]
        if short:
            total[short], words[short] = self.points([texts[i] for i in short])
        for i, text in enumerate(texts):
            if text and len(text) > PIECE:
                for piece in pieces(text):
                    part, n = self.points([piece])
                    total[i] += part[0]
                    words[i] += n[0]
        total += self.prior
        total -= total.max(axis=1, keepdims=True)
        chance = np.exp(total)
        chance /= chance.sum(axis=1, keepdims=True)
        best, some = np.argmax(chance, axis=1), words > 0
        return [self.languages[b] if w else UNDETERMINED for b, w in zip(best, some, strict=True)], np.where(some, chance[np.arange(len(texts)), best], 0.0).tolist()


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The model of the rows with text and language; priors are of all of them, counts of a sample of about sample_bytes."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    seen = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).orderBy("lang").collect()
    languages = [r["lang"] for r in seen]
    codes = {x: i for i, x in enumerate(languages)}
    # Of 2^20 hash values, those below the language's share are in the sample.
    cuts = docs.sparkSession.createDataFrame([(r["lang"], min(1 << 20, -(-sample_bytes * (1 << 20) // (len(seen) * max(1, r["size"]))))) for r in seen], "l string, cut long")
    sample = rows.join(F.broadcast(cuts), F.col("lang") == F.col("l")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.col("cut")).select("text", "lang")

    @trimmed
    def count(batches):
        held = _Learner(codes)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 19):
                held.add(batch.column("text").to_pylist(), batch.column("lang").to_pylist())
                if held.size() > 500_000:
                    yield from held.rows()
        yield from held.rows()

    counts = stored(sample.mapInArrow(count, "n int, hash long, lang int, count long").groupBy("n", "hash", "lang").agg(F.sum("count").alias("count")), "language-counts")
    k, tables = len(languages), {}
    for order in (0, *ORDERS):
        got = counts.where(F.col("n") == order).select("hash", "lang", "count").toArrow()
        hashes, langs, n = (got.column(c).to_numpy() for c in ("hash", "lang", "count"))
        totals = np.maximum(np.bincount(langs, n, k) if k else np.zeros(0), 1)
        tables[order] = Table(hashes.view(np.uint64), langs, n, totals)
    drop_tables(docs.sparkSession, counts)
    weight = np.array([r["n"] for r in seen], float)
    return Model(languages, np.log(weight / weight.sum()) if k else np.zeros(0), tables)


def identify(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of docs (default: all), the predicted language and its score."""
    keep = [c for c in (keep or docs.columns) if c not in into]
    held = docs.sparkSession.sparkContext.broadcast(model)

    @trimmed
    def run(batches):
        for whole in batches:
            for batch in slices(whole, text, 1 << 19):
                texts = batch.column(text).to_pylist()
                found = held.value.score(texts) if held.value.languages else ([UNDETERMINED] * len(texts), [0.0] * len(texts))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found[0], pa.string()), pa.array(found[1], pa.float64())], [*keep, *into])

    schema = docs.select(*keep, F.lit("").alias(into[0]), F.lit(0.0).alias(into[1])).schema
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def op9_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_fold("doc_id", 4) == 2
    model = learn(docs.where(~held))
    found = identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
