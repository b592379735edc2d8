"""Locale segments of URL paths."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .arrays import let
from .text import ascii_lower

SHAPE = "^([A-Za-z]{2,3})([-_])([A-Za-z]{2}|[0-9]{3})$"


def known_codes(spark: SparkSession) -> tuple[list[str], list[str]]:
    """Two-letter languages and regions, from the tables of the Java runtime."""
    locale = spark.sparkContext._jvm.java.util.Locale
    return sorted(x for x in locale.getISOLanguages() if len(x) == 2), sorted(locale.getISOCountries())


def _listed(codes: list[str], code: Column) -> Column:
    return F.array_contains(F.split(F.lit(",".join(codes)), ","), code)


def detect(path: Column, languages: list[str], regions: list[str]) -> Column:
    """As judged(), without the part that is unknown."""
    return judged(path, languages, regions).dropFields("unknown_subtag")


def judged(path: Column, languages: list[str], regions: list[str]) -> Column:
    """The first of the first two path segments that looks like a locale, with what is wrong about it; null if none does.

    A bare language counts only if it is known; a language with a region is checked for its separator, its case (language
    lower, region upper) and for known codes.
    """
    segments = F.slice(F.filter(F.split(path, "/"), lambda s: s != ""), 1, 2)
    bare = lambda s: s.rlike("^[A-Za-z]{2}$") & _listed(languages, ascii_lower(s))
    return let(F.get(F.filter(segments, lambda s: s.rlike(SHAPE) | bare(s)), F.lit(0)), lambda s: _judged(s, languages, regions))


def _judged(segment: Column, languages: list[str], regions: list[str]) -> Column:
    both = segment.rlike(SHAPE)
    parts = F.struct(F.when(both, F.regexp_extract(segment, SHAPE, 1)).otherwise(segment).alias("language"), F.regexp_extract(segment, SHAPE, 3).alias("region"), F.regexp_extract(segment, SHAPE, 2).alias("separator"), both.alias("both"))

    def of(p):
        language, region, both = p["language"], p["region"], p["both"]
        lower, upper = ascii_lower(language), F.upper(region)
        known = F.struct(((F.length(language) == 2) & _listed(languages, lower)).alias("language"), (region.rlike("^[0-9]{3}$") | _listed(regions, upper)).alias("region"))
        return let(
            known,
            lambda k: F.struct(
                segment.alias("segment"),
                (both & (p["separator"] == "_")).alias("separator_invalid"),
                ((language != lower) | (both & (region != upper))).alias("case_invalid"),
                (both & ~(k["language"] & k["region"])).alias("unknown"),
                F.when(both, F.concat(lower, F.lit("-"), upper)).otherwise(lower).alias("corrected"),
                F.when(both & ~k["language"], language).when(both & ~k["region"], region).alias("unknown_subtag"),
            ),
        )

    return F.when(segment.isNotNull(), let(parts, of))
