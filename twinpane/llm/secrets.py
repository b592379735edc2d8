"""Secret scans with multipart credential linking (operator 4).

Three base patterns are always reported: assignments of a password, token or key; access identifiers; long hexadecimal
strings. Weak parts (user names and client ids, other key-like values, mixed tokens, endpoints) are common in clean
text; one is reported only where complementary parts stand in the same scope: parts of one document, not separated
by a blank line. A smaller `reach`, in code points, can be given.

* a weak identifier needs a secret (base or weak),
* a weak secret needs an identifier (access or weak),
* an endpoint needs both.

The join of the parts is an interval join by sorted positions: every part looks up the nearest complementary part on
either side, so its cost is n log n in the parts of a document and no pairs are made.

Defined results: null text is the empty text and has no spans. Rows are scanned one by one, so repeated rows give
repeated results. A column of the input whose name is that of the result gives way to it. Spans of a kind never
overlap; a weak span that overlaps a base span is not reported again. Values run to their ends, however long. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices
from .common import map_arrow, table, without

REACH = 1 << 62  # the whole scope
KINDS = ("assign", "access", "hex")
WEAK = ("weakid", "weaksecret", "endpoint")
SPANS = "array<struct<kind:string,start:int,end:int>>"

_AI = re.ASCII | re.IGNORECASE
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _AI)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a run of hex digits is matched whole or, if shorter, not at all
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_WEAK_ID = re.compile(r"""(?<![A-Za-z0-9])(user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})""", _AI)
_WEAK_SECRET = re.compile(r"""(?<![A-Za-z0-9])(pass|pwd|key|auth|credentials?|signature)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})""", _AI)
_MIXED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
_ENDPOINT = re.compile(r"""(?:(?:https?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.]))""", _AI)
_SCOPE = re.compile(r"\n[ \t\r]*\n")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, in order of start and then of KINDS."""
    out = []
    lower = text.lower()
    if any(w in lower for w in _WORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


class _Nearby:
    """Spans of one kind of part, for lookups of any that stand within reach."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(spans)
        self.starts = [s for s, _ in self.spans]
        tops, top = [], 0
        for _, e in self.spans:
            top = max(top, e)
            tops.append(top)
        self.tops = tops

    def has(self, start: int, end: int, reach: int, low: int, high: int) -> bool:
        """Is there another span in [low, high) with a gap of at most reach?"""
        first = bisect_left(self.starts, low)
        last = bisect_right(self.starts, min(end + reach, high - 1))
        at = last - 1
        while at >= first and self.tops[at] + reach >= start:
            s, e = self.spans[at]
            if (s, e) != (start, end) and e + reach >= start:
                return True
            at -= 1
        return False


def linked_spans(text: str, base: list[tuple[int, int, str]], reach: int = REACH) -> list[tuple[int, int, str]]:
    """The weak spans that complementary parts confirm."""
    ids = [(m.start(), m.end()) for m in _WEAK_ID.finditer(text)]
    ends = [(m.start(), m.end()) for m in _ENDPOINT.finditer(text)]
    strong_ids = [(s, e) for s, e, k in base if k == "access"]
    strong = [(s, e) for s, e, k in base if k != "access"]
    if not (ids or strong_ids):
        return []  # every rule needs an identifier
    weak = [(m.start(), m.end()) for m in _WEAK_SECRET.finditer(text)]
    weak += [(m.start(), m.end()) for m in _MIXED.finditer(text) if any(c.isdigit() for c in m[0]) and m[0].lower() != m[0] and m[0].upper() != m[0]]
    covered = _Nearby([(s, e) for s, e, _ in base])
    apart = lambda spans: [x for x in spans if not covered.has(x[0] + 0.5, x[1] - 0.5, -0.5, 0, len(text) + 1)]
    ids, weak, ends = apart(ids), apart(_longest(weak)), apart(ends)
    cuts = [0, *(m.end() for m in _SCOPE.finditer(text)), len(text) + 1]
    all_ids, secrets = _Nearby(ids + strong_ids), _Nearby(weak + strong)
    out = []
    for kind, spans, needs in (("weakid", ids, (secrets,)), ("weaksecret", weak, (all_ids,)), ("endpoint", ends, (all_ids, secrets))):
        for s, e in spans:
            at = bisect_right(cuts, s)
            if all(x.has(s, e, reach, cuts[at - 1], cuts[at]) for x in needs):
                out.append((s, e, kind))
    return out


def _longest(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of overlapping spans the first and longest."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not out or s >= out[-1][1]:
            out.append((s, e))
    return out


def spans_of(text: str | None, reach: int = REACH) -> list[tuple[int, int, str]]:
    """All spans, by start and then by kind as listed in KINDS and WEAK."""
    if not text:
        return []
    base = base_spans(text)
    order = KINDS + WEAK
    return sorted(base + linked_spans(text, base, reach), key=lambda x: (x[0], order.index(x[2])))


_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_secrets(docs: DataFrame, *, text: str = "text", into: str = "secrets", keep: list[str] | None = None, reach: int = REACH) -> DataFrame:
    """The columns `keep` of docs (default: all) and an array `into` of the spans (kind, start, end) in code points."""
    keep = [c for c in (keep or docs.columns) if c != into]
    read = docs.select(*dict.fromkeys([*keep, text]))

    def scan(whole: pa.RecordBatch):
        for batch in slices(whole, text):
            found = [[{"kind": k, "start": s, "end": e} for s, e, k in spans_of(t.as_py(), reach)] for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, _KIND)], [*keep, into])

    schema = docs.select(*keep, F.lit(None).cast(SPANS).alias(into)).schema
    return map_arrow(read, scan, schema)


def redact(docs: DataFrame, *, text: str = "text", reach: int = REACH, mark: str = "[secret]") -> DataFrame:
    """docs with every span, overlapping ones together, replaced by `mark`; n_chars, if there, is counted anew there."""
    read = docs.select(*docs.columns)
    count = "n_chars" in docs.columns

    def scan(whole: pa.RecordBatch):
        for batch in slices(whole, text):
            yield masked(batch)

    def masked(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, changed = batch.column(text).to_pylist(), False
        sizes = batch.column("n_chars").to_pylist() if count else None
        for i, old in enumerate(texts):
            spans = spans_of(old, reach)
            if spans:
                parts, at = [], 0
                for s, e, _ in spans:
                    if s >= at:
                        parts += [old[at:s], mark]
                    at = max(at, e)
                texts[i], changed = "".join(parts) + old[at:], True
                if count:
                    sizes[i] = len(texts[i])
        if not changed:
            return batch
        new = {text: pa.array(texts, batch.schema.field(text).type)}
        if count:
            new["n_chars"] = pa.array(sizes, batch.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

    return map_arrow(read, scan, docs.schema)


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin(*KINDS))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("secrets")).alias("spans"), *without(found, ["doc_id", "secrets"]))
