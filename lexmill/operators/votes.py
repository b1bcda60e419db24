"""Votes, modes, confidence and acceptance gates over candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def argmax_vote(df: DataFrame, key: str, choice: str, weight: Column, order: str) -> DataFrame:
    """key, choice, weight, share: the greatest sum of weights, on ties the choice seen first."""
    sums = df.groupBy(key, choice).agg(F.sum(weight).alias("weight"), F.min(order).alias("seen"))
    best = F.max_by(F.struct(choice, "weight"), F.struct("weight", -F.col("seen")))
    return sums.groupBy(key).agg(best.alias("r"), F.sum("weight").alias("total")).select(key, f"r.{choice}", "r.weight", (F.col("r.weight") / F.col("total")).alias("share"))


def mode_with_share(df: DataFrame, key: str, choice: str, least: float = 0.0) -> DataFrame:
    """key, choice, n, share of the most frequent choice (on ties the smallest), if its share is enough."""
    counts = df.groupBy(key, choice).agg(F.count("*").alias("n"))
    top = counts.groupBy(key).agg(F.min_by(F.struct(choice, "n"), F.struct(-F.col("n"), choice)).alias("r"), F.sum("n").alias("total"))
    return top.select(key, f"r.{choice}", "r.n", (F.col("r.n") / F.col("total")).alias("share")).filter(F.col("share") >= least)


def sense_vote(candidates: DataFrame, priors: DataFrame, least: float = 0.72) -> DataFrame:
    """token, meaning, confidence, share. candidates: token, meaning, method, score, sim, content.

    Weights are score * (.45 + .55 sim) * prior * (.55 + .45 content), more where several method families agree; a vote is
    refused if its share is under .38 at a similarity under .78, or if its confidence is too low."""
    w = F.col("score") * (0.45 + 0.55 * F.col("sim")) * F.coalesce("prior", F.lit(0.85)) * (0.55 + 0.45 * F.col("content"))
    summed = (
        candidates.join(F.broadcast(priors), "method", "left")  # priors: a fixed table of a few dozen rows
        .groupBy("token", "meaning")
        .agg(F.sum(w).alias("w"), F.count_distinct("method").alias("families"), F.count("*").alias("n"), F.max("sim").alias("sim"), F.max("score").alias("score"), F.max("content").alias("content"))
    )
    boost = F.when(F.col("families") >= 2, 1 + 0.12 * F.least(F.lit(3), F.col("families") - 1)).otherwise(1.0) * F.when(F.col("n") >= 3, 1.08).otherwise(1.0)
    summed = summed.withColumn("w", F.col("w") * boost)
    top = summed.groupBy("token").agg(F.max_by(F.struct("meaning", "w", "sim", "score", "content"), F.struct("w", "meaning")).alias("r"), F.sum("w").alias("total"))
    share = F.col("r.w") / F.col("total")
    raw = F.least(F.lit(0.96), 0.35 * share + 0.35 * F.col("r.sim") + 0.20 * F.least(F.lit(1.0), F.col("r.score")) + 0.10 * F.least(F.lit(1.0), F.col("r.content")))
    strong = (F.col("r.sim") >= 0.85) & (F.col("r.score") >= 0.88) & (share >= 0.5)
    confidence = F.when(raw >= least, raw).when(strong, F.greatest(raw, F.lit(0.74)))
    refused = (share < 0.38) & (F.col("r.sim") < 0.78)
    return top.select("token", "r.meaning", F.when(~refused, confidence).alias("confidence"), share.alias("share")).filter("confidence is not null")


def gap_gate(sim: Column, support: Column, content: Column, grammatical: Column) -> Column:
    """Why a proposal is accepted, or why not."""
    return (
        F.when(grammatical & (sim >= 0.88) & (support >= 2), "high_sim_meta_donor").when(grammatical, "meta_meaning_blocked")
        .when((sim >= 0.74) & (support >= 1), "high_form_similarity").when((sim >= 0.58) & (support >= 2), "moderate_sim_multi_neighbor")
        .when((sim >= 0.48) & (support >= 3) & (content >= 0.5), "neighborhood_vote_content").when((sim >= 0.70) & (content >= 0.7), "high_sim_content_gloss")
        .otherwise("below_evidence_threshold")
    )


def lineage_gate(sim: Column, support: Column) -> Column:
    return (
        F.when((sim >= 0.75) & (support >= 1), "high_form_similarity").when((sim >= 0.55) & (support >= 3), "moderate_sim_multi_neighbor")
        .when((support >= 5) & (sim >= 0.40), "strong_neighborhood_vote").otherwise("below_evidence_threshold")
    )


def concentration(df: DataFrame, key: str, p: str) -> DataFrame:
    """key, entropy, concentration (1 - entropy / ln n), peak, margin, confidence of a distribution per key."""
    stats = df.groupBy(key).agg(
        F.sum(-F.col(p) * F.ln(F.col(p) + 1e-12)).alias("entropy"), F.count("*").alias("n"), F.sort_array(F.collect_list(p), asc=False).alias("ps")
    )
    peak, second = F.get("ps", F.lit(0)), F.coalesce(F.get("ps", F.lit(1)), F.get("ps", F.lit(0)) * 0.5)
    stats = stats.withColumn("margin", peak / (peak + second + 1e-12)).withColumn("concentration", F.greatest(F.lit(0.0), 1 - F.col("entropy") / F.ln(F.greatest("n", F.lit(2)))))
    confidence = F.greatest(F.lit(0.05), F.least(F.lit(0.98), 0.45 * F.col("margin") + 0.55 * F.col("concentration")))
    return stats.select(key, "entropy", "concentration", peak.alias("peak"), "margin", confidence.alias("confidence"))
