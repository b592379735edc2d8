import hashlib
import random
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinpane.functions import locales, text, urls
from twinpane.operators import assemble, matching, sequence


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x).cast("string")


def test_assignment_is_the_best_of_all():
    rng = np.random.Generator(np.random.PCG64(3))
    for _ in range(300):
        rows, cols = rng.integers(1, 6, 2).tolist()
        w = rng.integers(0, 12, (rows, cols))
        pairs = matching.best_assignment(w)
        assert len(pairs) == min(rows, cols) == len({r for r, _ in pairs}) == len({c for _, c in pairs})
        small, big = sorted((rows, cols))
        best = max(sum(w[i, p[i]] if rows <= cols else w[p[i], i] for i in range(small)) for p in permutations(range(big), small))
        assert sum(w[r, c] for r, c in pairs) == best


def test_assignment_over_pages(spark):
    rows = [(1, "text", f"o{i}", f"n{j}", 0.9 if i == j else 0.5) for i in range(3) for j in range(3)] + [(2, "text", "o", "n", 0.3), (3, "text", "o", "n", 0.6)]
    rows += [(4, "text", f"o{i:03}", f"n{j:03}", 0.8 if i == j else 0.1) for i in range(140) for j in range(140)]  # the greedy way
    got = {(r.page_id, r.old_id, r.new_id, r.band) for r in matching.assign(spark.createDataFrame(rows, "page_id long, block string, old_id string, new_id string, score double")).collect()}
    assert got == {(1, f"o{i}", f"n{i}", "matched") for i in range(3)} | {(3, "o", "n", "uncertain")} | {(4, f"o{i:03}", f"n{i:03}", "matched") for i in range(140)}


def test_mutual_best_needs_a_margin(spark):
    rows = [(1, "b", "o1", "n1", 0.95), (1, "b", "o1", "n2", 0.92), (1, "b", "o2", "n3", 0.9), (2, "b", "o1", "n1", 0.9), (2, "b", "o2", "n1", 0.9), (3, "b", "o", "n", 0.84)]
    got = matching.mutual_best(spark.createDataFrame(rows, "page_id long, block string, old_id string, new_id string, score double")).collect()
    assert {(r.page_id, r.old_id, r.new_id) for r in got} == {(1, "o2", "n3")}


def test_longest_increasing_of_all_subsequences():
    rng = random.Random(1)
    for _ in range(300):
        x = rng.sample(range(20), rng.randint(0, 8))
        got = sequence.longest_increasing(x)
        assert all(x[a] < x[b] for a, b in zip(got, got[1:], strict=False))
        assert len(got) == max(len(c) for n in range(len(x) + 1) for c in combinations(x, n) if list(c) == sorted(c))


def test_ids_and_suffixes(spark):
    null = lit(None)
    fields = ["missing_link", "desktop", "Get it", "link", "https://www.example.com/get", "", "", "main", "", ""]
    want = "issue_" + hashlib.sha256("\x1f".join(fields).encode()).hexdigest()[:12]
    got = assemble.issue_id(lit("missing_link"), lit("desktop"), lit("Get it"), lit("link"), lit("https://WWW.example.com/get?utm=1#x"), null, null, lit("main"), lit("ignored"), null)
    assert value(spark, got) == want
    rows = [("x", 5, None, 1), ("x", None, None, 2), ("x", 1, 2, 3), ("y", None, 1, 4)]
    frame = spark.createDataFrame([(1, *r) for r in rows], "page_id long, id string, seq_old int, seq_new int, emit_ord int")
    assert {(r.emit_ord, r.id) for r in assemble.suffixed(frame, ["page_id"]).collect()} == {(3, "x"), (1, "x-2"), (2, "x-3"), (4, "y")}


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda: text.text_sim(lit(None), lit(None)), 1.0),
        (lambda: text.text_sim(lit(None), lit("")), 0.0),
        (lambda: text.text_sim(lit("abc"), lit("abd")), 0.5 * 0 + 0.5 * (1 - 1 / 3)),
        (lambda: text.token_jaccard(lit("A b"), lit("a c")), 1 / 3),
        (lambda: text.token_jaccard(lit(""), lit(" ")), 1.0),
        (lambda: text.alt_sim(lit(None), lit("")), 1.0),
        (lambda: text.dimension_sim(*(F.lit(x) for x in (100, 50, 50, 50))), 0.5),
        (lambda: text.dimension_sim(*(F.lit(None).cast("int") for _ in range(4))), 0.5),
        (lambda: text.dimension_sim(F.lit(0), F.lit(1), F.lit(1), F.lit(1)), 0.0),
        (lambda: text.position_sim(F.lit(10), F.lit(100), F.lit(60), F.lit(100)), 0.5),
        (lambda: text.size_sim(F.lit(4), F.lit(8)), 0.5),
        (lambda: text.normalize_text(lit(" a  b\x07\x85c\n\n d ")), "a bc d"),
        (lambda: text.ascii_lower(lit("ÀBc")), "Àbc"),
        (lambda: text.label_text(lit("  Sign \n UP ")), "sign up"),
        (lambda: text.wildcard_match(lit("locale_unknown"), lit("locale_*")), True),
        (lambda: text.wildcard_match(lit("locale"), lit("locale_*")), False),
        (lambda: text.markdown_cell(lit("a|b\nc")), "a\\|b c"),
        (lambda: text.markdown_cell(lit(" a\r\nb\n")), "a  b"),
        (lambda: text.shell_quote(lit("it's")), "'it'\\''s'"),
        (lambda: urls.origin(lit("HTTPS://Ex.com:443/a")), "https://ex.com"),
        (lambda: urls.origin(lit("http://ex.com:8080")), "http://ex.com:8080"),
        (lambda: urls.origin(lit("mailto:a@b")), ""),
        (lambda: urls.norm_href(lit("../x?y#z"), lit("https://a.com/b/c")), "/b/../x?y"),
        (lambda: urls.norm_href(lit("#top"), lit("https://a.com/")), "#top"),
        (lambda: urls.norm_href(lit("https://b.com/x"), lit("https://a.com/")), "https://b.com/x"),
        (lambda: urls.href_sim(lit("https://old.com/x"), lit("https://new.com/x"), lit("https://old.com/"), lit("https://new.com/")), 1.0),
        (lambda: urls.href_sim(lit("/x?a"), lit("/x?b"), lit("https://old.com/"), lit("https://new.com/")), 0.7),
        (lambda: urls.request_key(lit("https://a.com/p/img/x.png?v"), lit("https://a.com/p/index")), "img/x.png?v"),
        (lambda: urls.normalize_for_compare(lit("https://a.com/x/?q#f")), "https://a.com/x?q"),
        (lambda: urls.normalize_for_compare(lit("https://a.com/")), "https://a.com/"),
        (lambda: urls.is_loopback(lit("http://app.localhost:3000/")), True),
        (lambda: urls.is_loopback(lit("http://127.8.9.1/")), True),
        (lambda: urls.is_loopback(lit("http://local.example/")), False),
        (lambda: urls.egress_reason(lit("ftp://a.com/"), lit("https://a.com/")), "scheme"),
        (lambda: urls.egress_reason(lit("http://192.168.1.4/"), lit("https://a.com/")), "private"),
        (lambda: urls.egress_reason(lit("https://b.com/"), lit("https://a.com/")), "external"),
        (lambda: urls.egress_reason(lit("https://a.com/q"), lit("https://a.com/")), None),
        (lambda: urls.redact(lit("https://a.com/?x=1&TOKEN=abc#f")), "https://a.com/?x=1&TOKEN=…redacted…#f"),
        (lambda: urls.has_credential(lit("https://a.com/?sid=9")), True),
        (lambda: urls.has_credential(lit("https://a.com/?sid=…redacted…&key=")), False),
        (lambda: urls.slash_violation(lit("https://a.com/x/")), True),
        (lambda: urls.slash_violation(lit("https://a.com/")), False),
    ],
)
def test_functions(spark, make, want):
    got = value(spark, make())
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("/es-MX/x", ("es-MX", False, False, False, "es-MX")),
        ("/es_MX/x", ("es_MX", True, False, False, "es-MX")),
        ("/es-mx/x", ("es-mx", False, True, False, "es-MX")),
        ("/shop/EN", ("EN", False, True, False, "en")),
        ("/a/b/en", None),
        ("/zz/x", None),
        ("/xx-ZZ", ("xx-ZZ", False, False, True, "xx-ZZ")),
        ("/es-419/", ("es-419", False, False, False, "es-419")),
    ],
)
def test_locales(spark, path, want):
    got = value(spark, locales.detect(lit(path), *locales.known_codes(spark)))
    assert (tuple(got) if got else None) == want
