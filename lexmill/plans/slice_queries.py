"""The first end-to-end slice: tokenise, look up in prioritised lexicon layers, measure coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.plans.registry import query
from lexmill.session import table

TOKEN = r"[\p{L}\p{N}_'-]+"


def _tokens(docs: DataFrame) -> DataFrame:
    return docs.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({TOKEN})"), F.lit(1))).alias("token"))


@query(
    "lexicon_cascade_coverage",
    r"""
    WITH bench AS (
      SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_''-]+')) AS form FROM benchmark),
    parts AS (
      SELECT DISTINCT unnest(regexp_extract_all(lower(p_name), '[\p{L}\p{N}_''-]+')) AS form FROM part),
    toks AS (
      SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_''-]+')) AS token FROM documents),
    counted AS (SELECT lang, token, count(*) AS n FROM toks GROUP BY lang, token),
    staged AS (
      SELECT c.lang, c.n,
             CASE WHEN b.form IS NOT NULL THEN 'benchmark'
                  WHEN p.form IS NOT NULL THEN 'part' ELSE 'missing' END AS stage
      FROM counted c LEFT JOIN bench b ON b.form = c.token LEFT JOIN parts p ON p.form = c.token)
    SELECT lang, stage, sum(n)::BIGINT AS n_tokens, count(*) AS n_forms FROM staged GROUP BY lang, stage
    """,
)
def lexicon_cascade_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tokens first, then one left join per lexicon layer; the first layer that has the form wins."""
    counted = _tokens(table(spark, sf_dir, "documents")).groupBy("lang", "token").agg(F.count("*").alias("n"))

    def layer(name: str, column: str, stage: str) -> DataFrame:
        forms = F.explode(F.regexp_extract_all(F.lower(column), F.lit(f"({TOKEN})"), F.lit(1)))
        return table(spark, sf_dir, name).select(forms.alias("token")).distinct().withColumn(stage, F.lit(stage))

    staged = counted.join(layer("benchmark", "text", "benchmark"), "token", "left").join(layer("part", "p_name", "part"), "token", "left")
    return (
        staged.groupBy("lang", F.coalesce("benchmark", "part", F.lit("missing")).alias("stage"))
        .agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_forms"))
    )
