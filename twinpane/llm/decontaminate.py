"""Benchmark decontamination with a generalised suffix automaton (operator 1).

The words of all test items form one automaton. Every document is streamed through it once; the longest match that
ends at each word says whether a window of an item ends there. Items are dealt into shards of a bounded number of
words, whose automata are built one after the other on the driver and then kept as flat arrays, some 30 bytes a word.
A document passes all of them in one scan, without a join. The test set is a stated input: its words, not the corpus,
decide the memory of a task (about 30 MB a million words, and its vocabulary).

Defined results: null text has no words and no hits. An item that is null or has no words never matches. Items with
the same id count once; a null item id is the empty id. An empty table of documents gives an empty result. Rows are scored one by one, so repeated rows give repeated results. No items: nothing is hit.
A column of the input whose name is that of the result gives way to it.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, slices, utf8, words
from .common import table, trimmed, without

WINDOW = 13
SHARD_WORDS = 400_000
RESULT = "struct<n_words:long,n_hit:long,items:array<string>,hit_words:array<struct<first:long,last:long>>,spans:array<struct<start:long,end:long>>>"


class Automaton:
    """Generalised suffix automaton over word ids, with the items of every window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window, self.vocabulary, self.names = window, {}, []
        self.next, self.link, self.length = [{}], [-1], [0]
        self.long_items: dict[int, set[int]] = {}
        self.short_items: dict[int, list[tuple[int, int]]] = {}
        self.least = window
        hashes: dict[bytes, int] = {}
        texts = []
        for name, text in items:
            data = np.frombuffer(text, np.uint8)
            starts, ends, _, hashed = words(data, np.array([0, len(data)]), ALNUM)
            ids = []
            for s, e, h in zip(starts.tolist(), ends.tolist(), hashed.tolist(), strict=True):
                word = lowered(text[s:e])
                ids.append(hashes.setdefault(word, len(hashes)))
                self.vocabulary[h] = ids[-1]
            if ids:
                self.names.append(name)
                texts.append(ids)
                self.least = min(self.least, len(ids))
                self._add(ids)
        self.words = list(hashes)
        for item, ids in enumerate(texts):
            self._mark(item, ids)
        chain = bytearray(len(self.next))
        for state in sorted(range(len(self.next)), key=self.length.__getitem__):
            chain[state] = state in self.short_items or (state > 0 and chain[self.link[state]])
        self.has_short = chain
        self.hashes = np.array(sorted(self.vocabulary), np.uint64)
        self.ids = np.array([self.vocabulary[h] for h in self.hashes.tolist()], np.int64)
        self.vocabulary = {}
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self._flatten()

    def _flatten(self) -> None:
        """Arrays instead of dictionaries: most states have one way on, and most windows are of one item."""
        self.token, self.step, self.many = array("i", [-1]) * len(self.next), array("i", [-1]) * len(self.next), {}
        for state, ways in enumerate(self.next):
            if len(ways) == 1:
                self.token[state], self.step[state] = next(iter(ways.items()))
            elif ways:
                self.many[state] = ways
        self.window_item = array("i", [-1]) * len(self.next)
        self.window_items = {}
        for state, found in self.long_items.items():
            if len(found) == 1:
                self.window_item[state] = next(iter(found))
            else:
                self.window_items[state] = tuple(sorted(found))
        self.link, self.length = array("i", self.link), array("i", self.length)
        self.next, self.long_items = [], {}

    def items_of(self, state: int) -> tuple[int, ...]:
        item = self.window_item[state]
        return (item,) if item >= 0 else self.window_items.get(state, ())

    def _split(self, state: int, token: int, target: int) -> int:
        """The state of the strings of `target` that are no longer than that of `state` plus one."""
        copy = len(self.next)
        self.next.append(dict(self.next[target]))
        self.link.append(self.link[target])
        self.length.append(self.length[state] + 1)
        self.link[target] = copy
        while state >= 0 and self.next[state].get(token) == target:
            self.next[state][token] = copy
            state = self.link[state]
        return copy

    def _add(self, ids: list[int]) -> None:
        last = 0
        for token in ids:
            target = self.next[last].get(token)
            if target is not None:
                last = target if self.length[target] == self.length[last] + 1 else self._split(last, token, target)
                continue
            new = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            state = last
            while state >= 0 and token not in self.next[state]:
                self.next[state][token] = new
                state = self.link[state]
            if state >= 0:
                target = self.next[state][token]
                self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, token, target)
            last = new

    def of_window(self, state: int, size: int) -> int:
        """The state on the suffix path of `state` that holds the suffix of `size` words."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _mark(self, item: int, ids: list[int]) -> None:
        state = 0
        for at, token in enumerate(ids):
            state = self.next[state][token]
            if at + 1 >= self.window:
                self.long_items.setdefault(self.of_window(state, self.window), set()).add(item)
        if len(ids) < self.window:
            self.short_items.setdefault(self.of_window(state, len(ids)), []).append((len(ids), item))

    def lookup(self, hashed: np.ndarray) -> np.ndarray:
        """Word ids; -1 for words of no item."""
        out = np.full(len(hashed), -1, np.int64)
        maybe = np.flatnonzero(self.seen[(hashed & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(maybe) and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashed[maybe]), len(self.hashes) - 1)
            right = self.hashes[at] == hashed[maybe]
            out[maybe[right]] = self.ids[at[right]]
        return out

    def stream(self, ids: list[int], base: int, intervals: list[tuple[int, int]], found: set[int]) -> None:
        """Streams words through the automaton; adds (first, last) word of each hit, counted from base, and the items."""
        window, links, lengths, tokens, steps, many = self.window, self.link, self.length, self.token, self.step, self.many
        state = matched = 0
        for at, token in enumerate(ids):
            while True:
                step = steps[state] if tokens[state] == token else many[state].get(token, -1) if state in many else -1
                if step >= 0 or not state:
                    break
                state = links[state]
                matched = lengths[state]
            if step < 0:
                continue
            state = step
            matched += 1
            if matched >= window:
                intervals.append((base + at - window + 1, base + at))
                found.update(self.items_of(self.of_window(state, window)))
            if self.has_short[state]:
                up = state
                while up > 0 and self.has_short[up]:
                    for size, item in self.short_items.get(up, ()):
                        if size <= matched:
                            intervals.append((base + at - size + 1, base + at))
                            found.add(item)
                    up = links[up]


def lowered(word: bytes) -> bytes:
    return word.lower()  # bytes.lower() changes A-Z only


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching intervals of words become one."""
    out: list[list[int]] = []
    for first, last in sorted(intervals):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def _scan(batch: pa.RecordBatch, text: str, automata: list[Automaton]) -> list[dict]:
    data, offsets = utf8(batch.column(text))
    starts, ends, counts, hashed = words(data, offsets, ALNUM)
    results = [{"n_words": n, "n_hit": 0, "items": [], "hit_words": [], "spans": []} for n in np.diff(counts).tolist()]
    hits: dict[int, tuple[list, set]] = {}
    for automaton in automata:
        ids = automaton.lookup(hashed)
        known = ids >= 0
        edge = np.zeros(len(known) + 1, bool)
        edge[:-1] = True
        edge[1:-1] = known[1:] != known[:-1]
        edge[counts] = True
        edge[-1] = True
        cuts = np.flatnonzero(edge)
        runs = np.flatnonzero(known[cuts[:-1]] & (np.diff(cuts) >= automaton.least)) if len(known) else np.zeros(0, np.int64)
        rows = np.searchsorted(counts, cuts[runs], side="right") - 1
        for run, row in zip(runs.tolist(), rows.tolist(), strict=True):
            a, b, found = int(cuts[run]), int(cuts[run + 1]), set()
            intervals, names = hits.get(row, ([], set()))
            automaton.stream(ids[a:b].tolist(), a - int(counts[row]), intervals, found)
            if found:
                names.update(automaton.names[i] for i in found)
                hits[row] = intervals, names
    for row, (intervals, names) in hits.items():
        joined = merged(intervals)
        base, begin = int(counts[row]), int(offsets[row])
        spans, at, points = [], begin, 0
        for first, last in joined:
            s, e = int(starts[base + first]), int(ends[base + last])
            points += _points(data[at:s])
            start = points
            points += _points(data[s:e])
            at = e
            spans.append({"start": start, "end": points})
        results[row] |= {"n_hit": sum(b - a + 1 for a, b in joined), "items": sorted(names), "hit_words": [{"first": a, "last": b} for a, b in joined], "spans": spans}
    return results


def _points(data: np.ndarray) -> int:
    """Code points in UTF-8 bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def find_contamination(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", into: str = "contamination", keep: list[str] | None = None, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The columns `keep` of docs (default: all) and a struct `into` with the words, hits, items and spans of each row.

    items: hit item ids, sorted as strings; hit_words: runs of hit words, counted from 0; spans: the same in code
    points, end exclusive. Each automaton holds at most about `shard_words` words (or one item).
    """
    spark = docs.sparkSession
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.encode(F.coalesce(item_text, F.lit("")), "UTF-8").alias("text"))
    held, automata, size = [], [], 0
    for r in items.orderBy("id", "text").toLocalIterator():
        held.append((r["id"], bytes(r["text"])))
        size += len(held[-1][1]) // 5
        if size >= shard_words:
            automata.append(spark.sparkContext.broadcast(Automaton(held, window)))
            held, size = [], 0
    if held:
        automata.append(spark.sparkContext.broadcast(Automaton(held, window)))
    keep = [c for c in (keep or docs.columns) if c != into]
    schema = docs.select(*keep, F.lit(None).cast(RESULT).alias(into)).schema
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(_scanner(automata, text, into, keep), schema)


_KIND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("hit_words", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _scanner(automata: list, text: str, into: str, keep: list[str]):
    @trimmed
    def run(batches):
        for whole in batches:
            for batch in slices(whole, text):
                result = pa.array(_scan(batch, text, [x.value for x in automata]), _KIND)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), result], [*keep, into])

    return run


def contaminated(into: str = "contamination", percent: int = 5):
    """The rule of coverage: hit words are at least `percent` of all words."""
    return (F.col(f"{into}.n_hit") > 0) & (100 * F.col(f"{into}.n_hit") >= percent * F.col(f"{into}.n_words"))


def remove_spans(text: str = "text", spans: str = "contamination.spans"):
    """The text without the spans; they are sorted and don't overlap."""
    gaps = F.expr(f"transform(sequence(0, size({spans})), i -> struct(if(i = 0, 0L, {spans}[i - 1].end) as a, if(i = size({spans}), cast(length({text}) as long), {spans}[i].start) as b))")
    cut = F.array_join(F.transform(gaps, lambda g: F.substring(F.col(text), (g["a"] + 1).cast("int"), (g["b"] - g["a"]).cast("int"))), "")
    return F.when(F.size(spans) > 0, cut).otherwise(F.col(text))


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", percent: int = 5, window: int = WINDOW) -> DataFrame:
    """docs without the rows over the limit of coverage; in the others, the hit spans are cut from the text.

    Columns stay as they are; n_chars, if there, is counted anew where text changed.
    """
    into = "_contamination"
    found = find_contamination(docs, items, text=text, into=into, window=window)
    cut = F.size(f"{into}.spans") > 0
    kept = found.where(~contaminated(into, percent)).withColumn(text, remove_spans(text, f"{into}.spans"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(cut, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*without(docs, [into]))


def sha256_of(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    c = F.col("contamination")
    return found.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
