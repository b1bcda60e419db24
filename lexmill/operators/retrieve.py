"""Retrieval, routing, planning and certification over ledgers and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators.similarity import best_of


def postings(claims: DataFrame, *more: str, column: str = "text") -> DataFrame:
    """id, more columns, token: one row per occurrence."""
    return claims.select("id", *more, F.explode(F.regexp_extract_all(F.lower(column), F.lit("([a-z]{3,})"), F.lit(1))).alias("token"))


def search(claims: DataFrame, queries: DataFrame, k: int = 8, domain_bonus: float = 1.5) -> DataFrame:
    """query, place, id, score: one point per posting of each different query token, a bonus for the domain; the k best,
    of equals the smallest id. claims: id, domain, text; queries: query, domain, text."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1)))
    wanted = queries.select("query", F.col("domain").alias("asked"), F.explode(tokens).alias("token"))
    bonus = F.max(F.when(F.col("domain") == F.col("asked"), domain_bonus).otherwise(0.0))
    hits = postings(claims, "domain").join(wanted, "token").groupBy("query", "id").agg((F.count("*") + bonus).alias("score"))
    # of the claims with the bonus alone, only the k smallest ids of a domain can be among the k best
    few = best_of(claims.select("domain", "id").filter(F.col("domain").isNotNull()), ["domain"], [F.col("id")], k).select("domain", "id")
    bare = queries.select("query", "domain").join(few, "domain").select("query", "id", F.lit(domain_bonus).alias("score"))
    scored = hits.unionByName(bare).groupBy("query", "id").agg(F.max("score").alias("score"))
    top = best_of(scored, ["query"], [F.desc("score"), F.col("id")], k)
    return top.select("query", (F.col("place") - 1).alias("place"), "id", "score")


def keyword_route(df: DataFrame, text: str, rules: list[tuple[str, str]], default: str) -> Column:
    """The first rule whose keyword the text contains."""
    chain = None
    for word, name in rules:
        hit = F.lower(text).contains(word)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise(default)


def atlas_match(texts: DataFrame, atlas: DataFrame) -> DataFrame:
    """id, name, score: 3 if the text contains the name, 1 for each keyword of at least four letters; the first of the
    best. The atlas is a small fixed table (id, text; ord, name, keywords)."""
    words = atlas.select("ord", "name", F.explode(F.concat(F.array(F.struct(F.lower("name").alias("w"), F.lit(3.0).alias("s"))), F.transform(F.filter(F.split(F.lower("keywords"), " "), lambda w: F.length(w) >= 4), lambda w: F.struct(w.alias("w"), F.lit(1.0).alias("s"))))).alias("x"))
    found = texts.join(F.broadcast(words), F.lower("text").contains(F.col("x.w")))
    sums = found.groupBy("id", "ord", "name").agg(F.sum("x.s").alias("score"))
    return sums.groupBy("id").agg(F.max_by(F.struct("name", "score"), F.struct("score", -F.col("ord"))).alias("r")).select("id", "r.*")


def input_mode(text: Column, stop: list[str], science: list[str], meta: list[str], classical: list[str]) -> Column:
    """science_query, english_meta, mixed, classical_surface or modern_english from shares of word lists."""
    toks = T.words(text)
    n = F.greatest(F.size(toks), F.lit(1))
    count = lambda words: F.size(F.filter(toks, lambda t: t.isin(words)))
    stops, old = count(stop), count(classical)
    english = stops / n
    content = F.size(toks) - stops
    greek = text.rlike(r"[Ͱ-Ͽἀ-῿]")
    classic = ((old / F.greatest(content, F.lit(1)) >= 0.5) & (content <= 8)) | greek | ((old > 0) & (english < 0.35))
    return (
        F.when((count(science) >= 1) & (english >= 0.25), "science_query").when((count(meta) >= 1) & (english >= 0.35), "english_meta")
        .when((old > 0) & (english >= 0.4), "mixed").when(classic, "classical_surface").when((english >= 0.4) | ((stops >= 2) & (content >= 1)), "modern_english")
        .when(old > 0, "classical_surface").otherwise("mixed")
    )


def junk_token(token: Column, exempt: list[str]) -> Column:
    t = F.lower(F.trim(token))
    ascii_only = ~t.rlike(r"[^\x00-\x7F]")
    bad = t.rlike(r"(.)\1{2,}") | (ascii_only & ~t.rlike("[aeiouy]") & (F.length(t) >= 4)) | t.rlike("^(zz|xx|qq|asdf|qwer|zxcv)")
    return (F.length(t) >= 3) & ~t.isin(exempt) & bad


def densify_plan(df: DataFrame) -> DataFrame:
    """Adds reasons, thin, actions (at most three) from unresolved, tokens, map_rate, session, archive, ledger, teach, mode."""
    c = F.col
    reasons = F.array_compact(F.array(
        F.when(c("unresolved") >= 2, "unresolved_tokens"), F.when((c("tokens") > 0) & (c("unresolved") >= 0.4 * F.greatest(c("tokens"), F.lit(1))), "high_unresolved_ratio"),
        F.when(c("map_rate") < 0.45, "low_map_rate"), F.when(c("session") == 0, "empty_session_prior"), F.when(c("archive") == 0, "empty_archive_prior"),
        F.when(c("ledger") < 2, "thin_domain_ledger"), F.when((c("mode") == "english_meta") & (c("teach") == 0), "missing_teach_panel"),
    ))
    df = df.withColumn("reasons", reasons).withColumn("thin", (F.size("reasons") >= 2) | ((c("unresolved") >= 2) & (c("archive") == 0)))
    acts = F.array_compact(F.array(
        F.when(c("mode") == "english_meta", "teach_inject"), F.when(c("archive") == 0, "archive_note"), F.when(c("unresolved") >= 2, "lexicon_seed"), F.when(c("ledger") < 2, "ledger_claim"),
    ))
    return df.withColumn("actions", F.when(c("thin") | (c("unresolved") >= 1), F.slice(acts, 1, 3)).otherwise(F.expr("cast(array() as array<string>)")))


def certify(texts: DataFrame, law: Column, tolerance: float = 1e-3) -> DataFrame:
    """id, claimed, certified: every `S = x` of a text against the law's value."""
    numbers = F.regexp_extract_all("text", F.lit(r"\bS\s*=\s*(-?[0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    found = texts.select("*", F.explode(numbers).alias("raw")).withColumn("claimed", F.col("raw").cast("double"))
    return found.select("id", "claimed", (F.abs(F.col("claimed") - law) <= tolerance).alias("certified"))


def recall(lines: DataFrame, query: str, k: int = 3) -> DataFrame:
    """The first k lines (by ord) that contain the query."""
    return lines.filter(F.lower("value").contains(query.lower())).orderBy("ord").limit(k)


def coverage_route(lang: Column, tokens: Column, covered: Column, forced: list[str], preferred: list[str], long: int = 16) -> Column:
    n = F.size(tokens)
    share = F.when(n == 0, 0.0).otherwise(covered / n)
    return F.when(lang.isin(forced) | (n >= long), "neural").when(lang.isin(preferred) | ((share >= 0.85) & (n <= 10)), "densify").otherwise("neural")
