"""Sense picks by domain, context symbols, tiered boosters, keyword diffusion, and stems learnt from training forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import gloss as G
from lexmill.operators.similarity import best_of


def domain_score(meaning: Column, keywords: Column) -> Column:
    """.4 content and .15 for each of up to four keywords found; .05 for grammatical glosses, long ones count .7."""
    plain = F.replace(F.lower(meaning), F.lit("_"), F.lit(" "))
    hits = F.size(F.filter(keywords, lambda k: plain.contains(k)))
    score = 0.4 * G.content_score(meaning) + 0.15 * F.least(F.lit(4), hits)
    return F.when(G.is_grammatical(meaning), 0.05).when(F.length(meaning) > 48, 0.7 * score).otherwise(score)


def pick_sense(senses: DataFrame, margin: float = 0.04) -> DataFrame:
    """token, meaning: the best sense if it wins by the margin, else of the best three the one with most content. senses:
    token, ord, meaning, keywords."""
    first = senses.groupBy("token", "meaning").agg(F.min("ord").alias("ord"), F.first("keywords").alias("keywords"))
    scored = first.withColumn("s", domain_score(F.col("meaning"), F.col("keywords"))).withColumn("content", G.content_score(F.col("meaning")))
    top = best_of(scored, ["token"], [F.desc("s"), F.col("ord"), F.col("meaning")], 3)
    ranked = top.groupBy("token").agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "ord", "meaning", "content"))).alias("r"))  # three a token
    clear = (F.size("r") == 1) | (-F.col("r")[0]["s"] >= -F.get("r", F.lit(1))["s"] + margin)
    rich = F.array_sort(F.transform("r", lambda x, i: F.struct((-x["content"]).alias("c"), i.alias("i"), x["meaning"].alias("meaning"))))[0]["meaning"]
    return ranked.select("token", F.when(clear, F.col("r")[0]["meaning"]).otherwise(rich).alias("meaning"))


def symbol_lookup(tokens: DataFrame, registry: DataFrame) -> DataFrame:
    """meaning of (token, context) by a small registry, and where it comes from."""
    found = registry.select(F.col("form").alias("__f"), F.col("context").alias("__c"), "meaning")
    joined = tokens.join(F.broadcast(found), (F.lower("token") == F.col("__f")) & (F.col("context") == F.col("__c")), "left")  # a fixed registry
    return joined.select("token", "context", "meaning", F.when(F.col("meaning").isNotNull(), F.concat(F.lit("domain_registry:"), "context")).alias("source"))


def booster(candidates: DataFrame) -> DataFrame:
    """token, meaning, score of tiered candidates (token, tier, meaning, score): any exact one; the best of tier A; of tier B
    (at least .68) the meaning with most methods, .06 more if several agree; of tier C (at least .80) the best."""
    usable = candidates.filter((F.col("tier").isin("exact", "A")) | ((F.col("tier") == "B") & (F.col("score") >= 0.68)) | ((F.col("tier") == "C") & (F.col("score") >= 0.80)))
    grouped = usable.groupBy("token", "tier", "meaning").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    score = F.when((F.col("tier") == "B") & (F.col("n") >= 2), F.least(F.lit(0.95), F.col("best") + 0.06)).otherwise(F.col("best"))
    votes = F.when(F.col("tier") == "B", F.col("n")).otherwise(F.lit(0))
    place = F.when(F.col("tier") == "exact", 0).when(F.col("tier") == "A", 1).when(F.col("tier") == "B", 2).otherwise(3)
    order = F.struct((-place).alias("p"), votes.alias("v"), F.col("best"), F.col("meaning"))
    return grouped.groupBy("token").agg(F.max_by(F.struct("meaning", score.alias("score"), "tier"), order).alias("r")).select("token", "r.*")


# What a hop adds to a domain from others.
COUPLINGS = {
    "linguistic": {"historical": 0.15, "mythological": 0.15, "english": 0.1},
    "historical": {"linguistic": 0.12, "mythological": 0.1},
    "mythological": {"historical": 0.12},
    "quantum": {"cosmological": 0.08},
}
# Keywords and what they add at the start.
BUMPS = (
    (("aqua", "manus", "latin", "rome"), {"historical": 1.0, "linguistic": 0.4}),
    (("lingua", "logos", "zipf", "word"), {"linguistic": 1.1}),
    (("zeus", "temple", "myth", "divine"), {"mythological": 1.2, "historical": 0.3}),
    (("quantum", "photon"), {"quantum": 1.3}),
    (("hieroglyph",), {"hieroglyphic": 1.2}),
)
DOMAINS = ("linguistic", "historical", "mythological", "english", "quantum", "cosmological", "hieroglyphic")


def diffusion(texts: DataFrame, hops: int = 3, start: float = 0.05, seed: float = 1.2) -> DataFrame:
    """id, domain, confidence after hops of fixed couplings between domains, a struct of scores per row. texts: id, text,
    seed (the routed domain)."""
    low = F.lower("text")
    scores = {}
    for d in DOMAINS:
        s = F.lit(start) + F.when(F.col("seed") == d, seed).otherwise(0.0)
        for words, gains in BUMPS:
            if d in gains:
                s = s + F.when(low.rlike("|".join(words)), gains[d]).otherwise(0.0)
        scores[d] = s
    df = texts.select("id", F.struct(*[s.alias(d) for d, s in scores.items()]).alias("s"))
    for _ in range(max(1, hops)):
        step = [sum((w * F.col(f"s.{o}") for o, w in COUPLINGS.get(d, {}).items()), F.col(f"s.{d}")).alias(d) for d in DOMAINS]
        df = df.select("id", F.struct(*step).alias("s"))
    ranked = F.array_sort(F.array(*[F.struct((-F.col(f"s.{d}")).alias("m"), F.lit(i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DOMAINS)]))
    best, second = -ranked[0]["m"], -ranked[1]["m"]
    return df.select("id", ranked[0]["d"].alias("domain"), (best / (best + second)).alias("confidence"))


def learnt_stems(store: DataFrame, suffixes: list[str], keep: int = 3, most: int | None = None) -> DataFrame:
    """form, meaning for stems by the first matching suffix, from the longest form that has the stem, if no form is the stem."""
    n = F.length("form")
    stem = F.coalesce(*[F.when(F.col("form").endswith(s) & (n - len(s) >= keep), F.substr("form", F.lit(1), n - len(s))) for s in suffixes])
    stems = store.select(stem.alias("stem"), "form", "meaning").filter("stem is not null")
    best = stems.groupBy("stem").agg(F.max_by("meaning", F.struct(n, "form")).alias("meaning"), F.max(n).alias("n"))
    new = best.join(store.select(F.col("form").alias("stem")), "stem", "left_anti")
    new = new if most is None else new.orderBy(F.desc("n"), "stem").limit(most)
    return new.select(F.col("stem").alias("form"), "meaning")
