"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

Language identification, near-duplicate removal, benchmark decontamination, secret redaction, mixing to target weights.
A stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.

Defined results: rows with null or empty texts have no language and go in the first stage. Null ids, repeated ids and
other null columns are kept like any values; rows that repeat id and text count as copies. Texts are whole, however long.
An empty table gives an empty result. Extra columns travel to the end, but those named size, source_size, target or taken
give way to the last stage's results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinpane.llm.common import stored, table
from twinpane.llm.decontaminate import decontaminate
from twinpane.llm.jaccard import deduplicate
from twinpane.llm.language import UNDETERMINED, identify, learn
from twinpane.llm.mixing import mix
from twinpane.llm.secrets import redact

#: A language below this probability counts as not recognised.
LEAST_SCORE = 0.5
LANG, SCORE = "_pipeline_lang", "_pipeline_score"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts that are null, have no letter or are in doubt go."""
    found = identify(docs, learn(docs), into=(LANG, SCORE))
    kept = found.where((F.col(LANG) != UNDETERMINED) & (F.col(SCORE) >= LEAST_SCORE))
    return kept.drop(LANG, SCORE)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id."""
    return deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others, passages of the benchmark are cut."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets masked."""
    return redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and taken."""
    return mix(docs).where("taken > 0")


STAGES = [
    ("language", language_stage),
    ("near_duplicates", duplicates_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]

#: Language identification can't be expressed in SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, from the table of documents; every result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
