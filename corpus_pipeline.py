"""A corpus pipeline of five stages: language identification, line deduplication, near-duplicates, benchmark
decontamination and mixing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All stages but the last return the columns of documents;
the last adds `copy`, the number of the copy, and has a row for every copy that the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import decontamination, language_id, line_dedup, minhash_dedup, mixing
from lexmill.session import scratch

#: Estimated similarity of a near copy whose lines the line stage leaves to the next one. The estimate's standard
#: deviation is 0.035 at the next stage's 0.8, so this is below all but about one in 400 of what that would link.
SPARE = 0.7


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language the network can't tell."""
    return language_id.keep_identified(docs)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of recurring templates but for their first; documents that lose all their words go. A near copy
    of the document that keeps a line keeps it too: cut up, it would no longer resemble that document, and pass the
    next stage beside it. When that stage drops the copy, its lines go with it."""
    return line_dedup.drop_recurring(docs, spare=SPARE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near-duplicates."""
    return minhash_dedup.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves documents so that the sources reach their target words."""
    return mixing.mix_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_recurring_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The first stage is a trained network, which SQL can't express; tests hold run() to plain Python on planted copies, passages and junk.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch() as kept:
            docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
