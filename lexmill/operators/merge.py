"""Keep-best merges, unions with precedence, and deduplication."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_best(df: DataFrame, keys: list[str], rank: list[Column], last: bool = False, flag: str | None = None) -> DataFrame:
    """The row with the greatest rank per key; of equals the first by `ord`, or the last. A flag column becomes true if
    any row of the key has it. An aggregate rather than a window: partial maxima leave nothing skewed to shuffle."""
    order = F.col("ord") if last else -F.col("ord")
    best = F.max_by(F.struct(*df.columns), F.struct(*rank, order))
    if flag is None:
        return df.groupBy(*keys).agg(best.alias("row")).select("row.*")
    merged = df.groupBy(*keys).agg(best.alias("row"), F.max(flag).alias("__flag"))
    return merged.select(*[F.col("__flag").alias(c) if c == flag else F.col(f"row.{c}").alias(c) for c in df.columns])


def union_by_precedence(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Later sources override earlier ones."""
    out = None
    for rank, df in enumerate(sources):
        df = df.withColumn("__rank", F.lit(rank))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    kept = [c for c in out.columns if c != "__rank"]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*kept), "__rank").alias("row")).select("row.*")


def pool_union(pools: list[DataFrame], keep: str = "max") -> DataFrame:
    """Distinct hypotheses of a sentence over several pools (sent_id, hyp, score): greatest score, or the first."""
    out = None
    for rank, df in enumerate(pools):
        df = df.select("sent_id", "hyp", "score", F.lit(rank).alias("__rank"))
        out = df if out is None else out.unionByName(df)
    score = F.max("score") if keep == "max" else F.min_by("score", "__rank")
    return out.groupBy("sent_id", "hyp").agg(score.alias("score"))


def distinct_sets(df: DataFrame, array: str) -> DataFrame:
    """One row per set of elements, whatever their order and number."""
    return df.withColumn(array, F.array_sort(F.array_distinct(array))).dropDuplicates([array])


def overlapping(df: DataFrame, array: str, other: str) -> DataFrame:
    return df.withColumn("overlap", F.arrays_overlap(array, other)).withColumn("both", F.array_sort(F.array_union(array, other)))


def greedy_dedupe(df: DataFrame, group: str, limit: int = 8) -> DataFrame:
    """Per group, in `ord`: drops a row whose id or whose normalised text a kept row has. The choice depends on what was
    kept before, so a group is one pandas frame; groups are single result lists and small. group, ord, id, text."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, texts, kept = set(), set(), []
        for i, r in rows.sort_values("ord").iterrows():
            text = " ".join((r["text"] or "")[:200].split()).lower()
            if (r["id"] and r["id"] in ids) or (text and text in texts):
                continue
            ids.add(r["id"])
            texts.add(text)
            kept.append(i)
            if len(kept) >= limit:
                break
        return rows.loc[kept]

    return df.groupBy(group).applyInPandas(run, df.schema)


def inject(store: DataFrame, forms: DataFrame, force: bool = False) -> DataFrame:
    """Adds form, gloss, score to a store; an existing form is only replaced by a higher score, or by force."""
    both = store.select("form", "gloss", "score", F.lit(0).alias("__new")).unionByName(forms.select("form", "gloss", "score", F.lit(1).alias("__new")))
    order = F.struct("__new") if force else F.struct("score", -F.col("__new"))
    return both.groupBy("form").agg(F.max_by(F.struct("gloss", "score"), order).alias("r")).select("form", "r.*")
