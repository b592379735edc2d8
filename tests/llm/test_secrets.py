import hashlib
import random
import re

from twinpane.llm import secrets as s

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{s.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)]


def test_base_against_brute_force():
    rng = random.Random(3)
    parts = ["token", "API_KEY", "apikey", "password", "=", ":", " ", '"', "'", "abcdefgh", "AKIA", "AKIAQQQQQQQQQQQQ", "0af3" * 8, "é", "K", "ſecret", "x.y", "-", "\n", "Secret = ", "passwd:"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert [f"{k}:{a}:{b}" for a, b, k in s.base_spans(text)] == brute_base(text)
        every = s.spans_of(text)
        assert set(s.base_spans(text)) <= set(every)


def brute_links(text, reach):
    """All pairs of parts."""
    base = s.base_spans(text)
    found = {"weakid": s._WEAK_ID, "weaksecret": s._WEAK_SECRET, "endpoint": s._ENDPOINT}
    parts = {k: [(m.start(), m.end()) for m in p.finditer(text)] for k, p in found.items()}
    parts["weaksecret"] = s._longest(parts["weaksecret"] + [(m.start(), m.end()) for m in s._MIXED.finditer(text) if any(c.isdigit() for c in m[0]) and m[0].lower() != m[0] and m[0].upper() != m[0]])
    parts = {k: [x for x in v if not any(x[0] < e and b < x[1] for b, e, _ in base)] for k, v in parts.items()}
    ids = parts["weakid"] + [x[:2] for x in base if x[2] == "access"]
    secrets = parts["weaksecret"] + [x[:2] for x in base if x[2] != "access"]
    cuts = [0, *(m.end() for m in s._SCOPE.finditer(text)), len(text) + 1]
    scope = lambda x: max(i for i, c in enumerate(cuts) if c <= x[0])
    near = lambda x, others: any(y != x and scope(x) == scope(y) and y[0] - x[1] <= reach and x[0] - y[1] <= reach for y in others)
    out = [(*x, "weakid") for x in parts["weakid"] if near(x, secrets)]
    out += [(*x, "weaksecret") for x in parts["weaksecret"] if near(x, ids)]
    out += [(*x, "endpoint") for x in parts["endpoint"] if near(x, ids) and near(x, secrets)]
    return sorted(out)


def test_links_against_all_pairs():
    rng = random.Random(4)
    parts = ["user=alice ", "client_id: 77ab ", "https://db.example.org/x ", "10.0.0.7:5432 ", "key=zzzzzz1 ", "pwd: hunter22 ", "aB3dE6gH9jK2mN5pQ8sT ", "\n\n", "word " * 9, "token=abcdefgh1 ", "AKIAQQQQQQQQQQQQ ", "filler ", "é "]
    linked = 0
    for _ in range(1500):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        got = sorted(x for x in s.spans_of(text, 60) if x[2] in s.WEAK)
        assert got == brute_links(text, 60), text
        linked += len(got)
    assert linked > 1000


def test_weak_parts_alone_are_not_reported():
    assert s.spans_of("see https://example.org/a and key=abcdef9") == []
    assert s.spans_of("user=bob and nothing else") == []
    assert [x[2] for x in s.spans_of("host 10.1.2.3:22 user=bob pwd=hunter22")] == ["endpoint", "weakid", "weaksecret"]
    assert s.spans_of("user=bob\n\npwd=hunter22") == []


def test_whole_table_nulls_and_redaction(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = s.op4_secrets(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        base = brute_base(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in base) for k in s.KINDS)
    frame = spark.createDataFrame([(1, "é token=abcdefghij end", "x", 9), (2, None, "x", None), (3, "", "x", 0), (4, "a" * 31, "x", 31), (1, "é token=abcdefghij end", "x", 9)], "doc_id long, text string, secrets string, n_chars long")
    found = s.find_secrets(frame)
    assert found.columns == ["doc_id", "text", "n_chars", "secrets"] and [len(r.secrets) for r in found.orderBy("doc_id").collect()] == [1, 1, 0, 0, 0]
    red = {r.doc_id: r for r in s.redact(frame).collect()}
    assert red[1].text == "é [secret] end" and red[1].n_chars == 14 and red[2].text is None and red[4].n_chars == 31
    assert s.find_secrets(frame.limit(0)).count() == 0 and s.redact(frame.limit(0)).count() == 0
