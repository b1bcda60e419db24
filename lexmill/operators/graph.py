"""Sense graphs: building, coverage holes and their filling, neighbourhoods, and multi-hop attention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.similarity import best_of


def build(bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, label) and edges (src, rel, dst) of bindings (sense, lang, form, ord). Labels keep the longest;
    an edge is unique, forwards `expresses` and backwards `realized_as`."""
    sense = F.concat(F.lit("sense:"), "sense")
    form = F.concat(F.lit("form:"), "lang", F.lit(":"), "form")
    rows = bindings.select(sense.alias("s"), form.alias("f"), F.concat(F.lit("lang:"), "lang").alias("l"), "sense", "form", "lang")
    nodes = (
        rows.select(F.explode(F.array(
            F.struct(F.col("s").alias("id"), F.lit("sense").alias("kind"), F.col("sense").alias("label")),
            F.struct(F.col("f").alias("id"), F.lit("form").alias("kind"), F.col("form").alias("label")),
            F.struct(F.col("l").alias("id"), F.lit("language").alias("kind"), F.col("lang").alias("label")),
        )).alias("n")).select("n.*")
        .groupBy("id", "kind").agg(F.max_by("label", F.struct(F.length("label"), "label")).alias("label"))
    )
    edges = rows.select(F.explode(F.array(
        F.struct(F.col("f").alias("src"), F.lit("expresses").alias("rel"), F.col("s").alias("dst")),
        F.struct(F.col("s").alias("src"), F.lit("realized_as").alias("rel"), F.col("f").alias("dst")),
        F.struct(F.col("f").alias("src"), F.lit("in_language").alias("rel"), F.col("l").alias("dst")),
    )).alias("e")).select("e.*").distinct()
    return nodes, edges


def holes(bindings: DataFrame, senses: DataFrame, langs: DataFrame) -> DataFrame:
    """sense, lang without a form. langs is the short list of target languages: senses are fanned out over it, not joined
    with all rows of another table."""
    targets = langs.agg(F.sort_array(F.collect_set("lang")).alias("targets"))
    have = bindings.groupBy("sense").agg(F.collect_set("lang").alias("have"))
    wanted = senses.select("sense").distinct().join(F.broadcast(targets)).join(have, "sense", "left")  # targets: one row
    missing = F.array_except("targets", F.coalesce("have", F.expr("cast(array() as array<string>)")))
    return wanted.select("sense", F.explode(missing).alias("lang"))


def coverage(bindings: DataFrame, n_langs: int, under: int) -> DataFrame:
    """sense, n_langs, missing, under_min."""
    counted = bindings.groupBy("sense").agg(F.count_distinct("lang").alias("n_langs"))
    return counted.select("sense", "n_langs", (F.lit(n_langs) - F.col("n_langs")).alias("missing"), (F.col("n_langs") < under).alias("under_min"))


def fill(missing: DataFrame, gold: DataFrame, least: float = 0.85, longest: int = 32, most: int | None = None) -> DataFrame:
    """The best gold form (sense, lang, form, confidence, ord) for each hole: one word, confident, the first of equals."""
    good = gold.filter((F.col("confidence") >= least) & (F.length("form") <= longest) & ~F.col("form").contains(" "))
    best = good.groupBy("sense", "lang").agg(F.max_by(F.struct("form", "confidence"), F.struct("confidence", -F.col("ord"))).alias("r"))
    found = missing.join(best, ["sense", "lang"]).select("sense", "lang", "r.*")
    return found if most is None else found.orderBy("sense", "lang").limit(most)


def neighbourhood(bindings: DataFrame) -> DataFrame:
    """sense, lang, forms in order of first claim."""
    first = bindings.groupBy("sense", "lang", "form").agg(F.min("ord").alias("ord"))
    return first.groupBy("sense", "lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "form"))), lambda x: x["form"]).alias("forms"))


def hub_pairs(bindings: DataFrame, hub: str, item: str) -> DataFrame:
    """a < b, n: pairs of items that share a hub. Items are distinct per hub; a hub is as large as its set of items
    (languages of a gloss, suppliers of a part), which the data model bounds."""
    own = bindings.select(hub, item).distinct()
    a, b = own.select(hub, F.col(item).alias("a")), own.select(hub, F.col(item).alias("b"))
    return a.join(b, hub).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def donors(present: DataFrame, k: int = 3, least: int = 3) -> DataFrame:
    """owner, concept, donor, shared: for each concept that an owner lacks, the k owners that have it and share most
    concepts with the owner. present: owner, concept."""
    own = present.distinct()
    shared = own.select(F.col("owner").alias("o"), "concept").join(own.select(F.col("owner").alias("d"), "concept"), "concept").filter("o <> d").groupBy("o", "d").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)
    offered = shared.join(own.select(F.col("owner").alias("d"), "concept"), "d")
    lacking = offered.join(own.select(F.col("owner").alias("o"), "concept"), ["o", "concept"], "left_anti")
    best = best_of(lacking, ["o", "concept"], [F.desc("shared"), F.col("d")], k)
    return best.select(F.col("o").alias("owner"), "concept", (F.col("place") - 1).alias("place"), F.col("d").alias("donor"), "shared")


def domain_edges(nodes: DataFrame) -> DataFrame:
    """i, j, w between the at most 80 nodes (idx, name, scalar, family) of a domain graph: family, alignment and name
    stem; weights over .15, and a weak ring so that it hangs together."""
    a, b = nodes.select(*[F.col(c).alias(f"{c}_i") for c in nodes.columns]), nodes.select(*[F.col(c).alias(f"{c}_j") for c in nodes.columns])
    stem = lambda c: F.substring_index(c, "_", 1)
    pairs = a.join(F.broadcast(b), F.col("idx_i") < F.col("idx_j"))  # at most 80 rows a side
    same = F.when((F.col("family_i") == F.col("family_j")) & (F.col("family_i") != "abstract"), 0.55).otherwise(0.0)
    w = same + 0.25 * (1 - F.abs(F.col("scalar_i") - F.col("scalar_j"))) + F.when(stem("name_i") == stem("name_j"), 0.2).otherwise(0.0)
    n = F.lit(nodes.count())
    ring = (F.col("idx_j") - F.col("idx_i") == 1) | ((F.col("idx_i") == 0) & (F.col("idx_j") == n - 1))
    w = F.when(w > 0.15, w).otherwise(0.0)
    w = F.when(ring, F.greatest(w, F.lit(0.08))).otherwise(w)
    half = pairs.select(F.col("idx_i").alias("i"), F.col("idx_j").alias("j"), w.alias("w")).filter("w > 0")
    return half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def attention(nodes: DataFrame, edges: DataFrame, query: DataFrame, hops: int = 4, temperature: float = 0.85) -> DataFrame:
    """idx, p after `hops` rounds of attention of a normalised query (idx, q) over the graph: fixed, unrolled joins."""
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # at most 80 rows

    def softmax(df: DataFrame, x, name: str = "h") -> DataFrame:
        df = df.withColumn("__x", x)
        df = df.withColumn("__e", F.exp((F.col("__x") - F.max("__x").over(everything)) / temperature))
        return df.withColumn(name, F.col("__e") / F.sum("__e").over(everything)).drop("__x", "__e")

    degrees = edges.groupBy("i").agg(F.sum("w").alias("deg"))
    base = nodes.select("idx", "scalar").join(query, "idx", "left").fillna(0.0, ["q"]).join(degrees, F.col("idx") == F.col("i"), "left").drop("i")
    value = 0.5 + 0.5 * F.tanh("scalar")
    state = softmax(base, 3.0 * (0.65 * F.col("q") + 0.35 * value * F.col("q")))
    for _ in range(max(1, hops)):
        sent = edges.join(state.select(F.col("idx").alias("j"), "h"), "j").groupBy("i").agg(F.sum(F.col("w") * F.col("h")).alias("m"))
        joined = state.join(sent, F.col("idx") == F.col("i"), "left").drop("i")
        gated = 0.55 * F.coalesce(F.col("m") / F.sqrt("deg"), F.lit(0.0)) + 0.45 * F.col("q") * (1 + F.abs("scalar"))
        state = softmax(joined, 2.5 * (0.4 * F.col("h") + 0.6 * gated), "h2").drop("h", "m").withColumnRenamed("h2", "h")
    return state.select("idx", F.col("h").alias("p"))
