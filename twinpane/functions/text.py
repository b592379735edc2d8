"""Scalar text and similarity functions as Column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = "\u001f"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def non_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*(non_empty(c) for c in columns))


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[ \\t\\n\\r\\f\\x0B]+", " "))


def normalize_text(c: Column, cap: int = 500) -> Column:
    """No-break spaces become spaces, control characters go, whitespace runs collapse, ends are trimmed, then the cap."""
    spaced = F.translate(c, " ", " ")
    clean = F.regexp_replace(spaced, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]", "")
    return F.substring(F.trim(F.regexp_replace(clean, "[ \\t\\n\\r]+", " ")), 1, cap)


def cap_style_value(c: Column, cap: int = 1000) -> Column:
    return F.substring(F.regexp_replace(c, "[\\x00-\\x1F\\x7F-\\x{9F}]", ""), 1, cap)


def tokens(c: Column) -> Column:
    """Distinct ASCII-lower-cased whitespace tokens."""
    return F.array_distinct(F.filter(F.split(ascii_lower(c), "[ \\t\\n\\r\\f\\x0B]+"), lambda t: t != ""))


def label_text(c: Column) -> Column:
    """Text as compared by the duplicate-label filter."""
    return F.array_join(F.filter(F.split(ascii_lower(c), "[ \\t\\n\\r\\f\\x0B]+"), lambda t: t != ""), " ")


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = tokens(a), tokens(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def edit_similarity(a: Column, b: Column, prefix: int = 200) -> Column:
    x, y = F.substring(a, 1, prefix), F.substring(b, 1, prefix)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / longest)


def text_sim(a: Column, b: Column) -> Column:
    """Two nulls are alike, a null and a value are not; else half token Jaccard, half edit similarity of the beginnings."""
    x, y = F.substring(a, 1, 200), F.substring(b, 1, 200)
    return (
        F.when(a.isNull() & b.isNull(), 1.0)
        .when(a.isNull() | b.isNull(), 0.0)
        .when(a == b, 1.0)
        .otherwise(0.5 * token_jaccard(x, y) + 0.5 * edit_similarity(a, b))
    )


def alt_sim(a: Column, b: Column) -> Column:
    return F.when(non_empty(a).isNull() & non_empty(b).isNull(), 1.0).otherwise(text_sim(a, b))


def role_sim(a: Column, b: Column) -> Column:
    return F.when(a.eqNullSafe(b), 1.0).otherwise(0.0)


def nearby_sim(heading_a: Column, heading_b: Column, landmark_a: Column, landmark_b: Column) -> Column:
    return 0.7 * text_sim(heading_a, heading_b) + 0.3 * role_sim(landmark_a, landmark_b)


def dimension_sim(wa: Column, ha: Column, wb: Column, hb: Column) -> Column:
    """All unknown: 0.5; any unknown or zero: 0; else the product of the ratios of the smaller to the larger."""
    all_null = wa.isNull() & ha.isNull() & wb.isNull() & hb.isNull()
    bad = F.coalesce(wa, F.lit(0)) * F.coalesce(ha, F.lit(0)) * F.coalesce(wb, F.lit(0)) * F.coalesce(hb, F.lit(0)) == 0
    return F.when(all_null, 0.5).when(bad, 0.0).otherwise(F.least(wa, wb) / F.greatest(wa, wb) * (F.least(ha, hb) / F.greatest(ha, hb)))


def position_sim(ya: Column, height_a: Column, yb: Column, height_b: Column) -> Column:
    return F.when((height_a == 0) | (height_b == 0), 0.0).otherwise(1 - F.least(F.lit(1.0), F.abs(ya / height_a - yb / height_b)))


def size_sim(area_a: Column, area_b: Column) -> Column:
    return F.when((area_a <= 0) | (area_b <= 0), 0.0).otherwise(F.least(area_a, area_b) / F.greatest(area_a, area_b))


def round4(c: Column) -> Column:
    return F.round(c * 10000) / 10000


def content_id(prefix: str, *fields: Column) -> Column:
    """prefix_ and the first 12 hex digits of the SHA-256 of the fields, nulls as empty, joined by U+001F."""
    joined = F.concat_ws(SEPARATOR, *(F.coalesce(f.cast("string"), F.lit("")) for f in fields))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, 12))


def truncate_bytes(c: Column, most: int = 80) -> Column:
    """The longest beginning of at most so many bytes of UTF-8 that ends at a character."""
    sizes = F.sequence(F.lit(most // 4), F.lit(most))
    cut = F.array_max(F.filter(sizes, lambda k: F.octet_length(F.substring(c, F.lit(1), k)) <= most))
    return F.when(F.octet_length(c) <= most, c).otherwise(F.substring(c, F.lit(1), cut))


def wildcard_match(value: Column, pattern: Column) -> Column:
    """Equal, or a prefix if the pattern ends in an asterisk."""
    return F.when(pattern.endswith("*"), F.startswith(value, F.regexp_replace(pattern, "\\*$", ""))).otherwise(value == pattern)


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def markdown_cell(c: Column) -> Column:
    """A table cell: pipes escaped, each line end a space, ends trimmed."""
    flat = F.translate(F.replace(c, F.lit("|"), F.lit("\\|")), "\r\n", "  ")
    return F.regexp_replace(flat, "(?U)^\\s+|\\s+$", "")


def shell_quote(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\''")), F.lit("'"))
