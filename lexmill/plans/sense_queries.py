"""Queries of sense picks, boosters, diffusion and small media."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import senses
from lexmill.plans import sql as Q
from lexmill.plans.join_queries import SQL_STORE, store
from lexmill.plans.record_queries import SQL_CONTENT, SQL_META, sql_keys
from lexmill.plans.registry import query
from lexmill.session import table

Session = SparkSession

KEYWORDS = ("ring", "bolt", "red", "gear")
SQL_SENSES = f"SELECT p_brand AS token, {Q.slug("p_name || CASE WHEN p_size > 45 THEN ' of the old stone house in the mountains' ELSE '' END")} AS gloss, min(p_partkey) AS ord FROM part GROUP BY ALL"


@query("domain_sense_pick", f"""
WITH x AS (SELECT token, ord, gloss AS meaning, {SQL_CONTENT} AS content, {SQL_META} AS meta, least(4, len(list_filter({list(KEYWORDS)}, lambda k: contains(replace(gloss, '_', ' '), k)))) AS hits FROM ({sql_keys(SQL_SENSES)})),
s AS (SELECT *, CASE WHEN meta THEN 0.05 WHEN length(meaning) > 48 THEN 0.7 * (0.4 * content + 0.15 * hits) ELSE 0.4 * content + 0.15 * hits END::DOUBLE AS s FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY s DESC, ord) AS r FROM s),
t AS (SELECT token, count(*) AS n, max(s) FILTER (r = 1) AS s1, max(s) FILTER (r = 2) AS s2, arg_min(meaning, r) AS best, arg_min(meaning, (-content, r)) AS rich FROM r WHERE r <= 3 GROUP BY token)
SELECT token, CASE WHEN n = 1 OR s1 >= s2 + 0.04 THEN best ELSE rich END AS meaning FROM t""")
def domain_sense_pick(spark: Session, sf: str) -> DataFrame:
    """Names of a brand's parts as its senses, ranked by keywords of the domain and content."""
    p = table(spark, sf, "part")
    gloss = T.slug(F.concat("p_name", F.when(F.col("p_size") > 45, " of the old stone house in the mountains").otherwise("")))
    return senses.pick_sense(p.select(F.col("p_brand").alias("token"), F.col("p_partkey").alias("ord"), gloss.alias("meaning"), F.array(*map(F.lit, KEYWORDS)).alias("keywords")))


@query("context_symbols", """
WITH a AS (SELECT s_suppkey, n_name AS token, 'region_' || (s_suppkey % 5)::VARCHAR AS context FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT token, a.context, 'meaning_' || n_nationkey::VARCHAR AS meaning, CASE WHEN n_nationkey IS NOT NULL THEN 'domain_registry:' || a.context END AS source FROM a LEFT JOIN nation ON n_name = token AND 'region_' || n_regionkey::VARCHAR = a.context""")
def context_symbols(spark: Session, sf: str) -> DataFrame:
    """One surface, a meaning in one context and none in others: nations asked for in regions."""
    n = table(spark, sf, "nation")
    region = lambda c: F.concat(F.lit("region_"), c.cast("string"))
    asked = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("token"), region(F.col("s_suppkey") % 5).alias("context"))
    registry = n.select(F.lower("n_name").alias("form"), region(F.col("n_regionkey")).alias("context"), F.concat(F.lit("meaning_"), F.col("n_nationkey").cast("string")).alias("meaning"))
    return senses.symbol_lookup(asked, registry)


@query("booster_cascade", """
WITH c AS (SELECT l_orderkey AS token, CASE WHEN l_quantity > 49 THEN 'exact' WHEN l_quantity > 45 THEN 'A' WHEN l_quantity > 15 THEN 'B' ELSE 'C' END AS tier, 'm' || (l_suppkey % 3)::VARCHAR AS meaning, 0.6 + l_discount * 4 AS score FROM lineitem),
g AS (SELECT token, tier, meaning, count(*) AS n, max(score) AS best FROM c WHERE tier IN ('exact', 'A') OR (tier = 'B' AND score >= 0.68) OR (tier = 'C' AND score >= 0.80) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY CASE tier WHEN 'exact' THEN 0 WHEN 'A' THEN 1 WHEN 'B' THEN 2 ELSE 3 END, CASE WHEN tier = 'B' THEN n ELSE 0 END DESC, best DESC, meaning DESC) AS r FROM g)
SELECT token, meaning, round(CASE WHEN tier = 'B' AND n >= 2 THEN least(0.95, best + 0.06) ELSE best END, 6) AS score, tier FROM r WHERE r = 1""")
def booster_cascade(spark: Session, sf: str) -> DataFrame:
    """Tiers of candidates with agreement: the lines of an order propose one of three meanings."""
    size = F.col("l_quantity")
    tier = F.when(size > 49, "exact").when(size > 45, "A").when(size > 15, "B").otherwise("C")
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("token"), tier.alias("tier"), F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string")).alias("meaning"), (0.6 + F.col("l_discount") * 4).alias("score"))
    return senses.booster(c).select("token", "meaning", F.round("score", 6).alias("score"), "tier")


def _diffusion_sql() -> str:
    start = []
    for d in senses.DOMAINS:
        gains = "".join(f" + CASE WHEN regexp_matches(lower(text), '{'|'.join(w)}') THEN {g[d]} ELSE 0 END" for w, g in senses.BUMPS if d in g)
        start.append(f"0.05::DOUBLE + CASE WHEN seed = '{d}' THEN 1.2 ELSE 0 END{gains} AS {d}")
    out = f"SELECT id, {', '.join(start)} FROM (SELECT conv_id * 1000 + turn AS id, text || CASE WHEN role = 'user' THEN ' zeus' ELSE ' word' END AS text, CASE WHEN turn = 0 THEN 'quantum' ELSE 'linguistic' END AS seed FROM conversations)"
    for _ in range(3):
        out = f"SELECT id, {', '.join(' + '.join([d, *[f'{w} * {o}' for o, w in senses.COUPLINGS.get(d, {}).items()]]) + f' AS {d}' for d in senses.DOMAINS)} FROM ({out})"
    long = " UNION ALL ".join(f"SELECT id, {i} AS i, '{d}' AS d, {d} AS s FROM z" for i, d in enumerate(senses.DOMAINS))
    return f"WITH z AS ({out}), l AS ({long}), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, i) AS k FROM l) SELECT a.id, a.d AS domain, round(a.s / (a.s + b.s), 9) AS confidence FROM r a JOIN r b ON a.id = b.id AND a.k = 1 AND b.k = 2"


@query("domain_diffusion", _diffusion_sql())
def domain_diffusion(spark: Session, sf: str) -> DataFrame:
    """Fixed couplings, unrolled; one row per text throughout."""
    c = table(spark, sf, "conversations")
    texts = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat("text", F.when(F.col("role") == "user", " zeus").otherwise(" word")).alias("text"),
        F.when(F.col("turn") == 0, "quantum").otherwise("linguistic").alias("seed"),
    )
    found = senses.diffusion(texts)
    return found.select("id", "domain", F.round("confidence", 9).alias("confidence"))


@query("train_stem_densify", f"""
SELECT stem AS form, arg_max(meaning, (length(form), form)) AS meaning FROM (
  SELECT form, meaning, CASE WHEN ends_with(form, 'en') AND length(form) >= 5 THEN left(form, length(form) - 2) WHEN ends_with(form, 'e') AND length(form) >= 4 THEN left(form, length(form) - 1)
    WHEN ends_with(form, 't') AND length(form) >= 4 THEN left(form, length(form) - 1) END AS stem FROM {SQL_STORE})
WHERE stem IS NOT NULL AND stem NOT IN (SELECT form FROM {SQL_STORE}) GROUP BY stem""")
def train_stem_densify(spark: Session, sf: str) -> DataFrame:
    """Stems of training forms by the first matching suffix, the longest form first, free keys only."""
    return senses.learnt_stems(store(spark, sf), ["en", "e", "t"])


@query("waveform_samples", "SELECT p_size, list_transform(range(0, 8), lambda i: round(sin(2 * pi() * p_size * i / 64.0::DOUBLE), 9) + 0) AS samples FROM (SELECT DISTINCT p_size FROM part)")
def waveform_samples(spark: Session, sf: str) -> DataFrame:
    """Samples of a sine as array expressions."""
    sizes = table(spark, sf, "part").select("p_size").distinct()
    wave = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.round(F.sin(2 * F.pi() * F.col("p_size") * i / 64.0), 9) + F.lit(0.0))
    return sizes.select("p_size", wave.alias("samples"))
