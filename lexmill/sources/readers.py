"""Readers that turn heterogeneous lexical files into typed tables. Schemas are given, never inferred, and an
ordinal (`ord`) is kept wherever the first or the last of several rows wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.session import cut

GOLD = (
    "source_lang string, source_word string, target_lang string, target_word string, meaning_key string, "
    "confidence double, tier string, source_title string, pos string, is_name boolean"
)
LANGUAGE_PACK = (
    "lang string, form_sense_prefer map<string,array<string>>, seeds array<struct<form:string,gloss:string,lang:string>>, "
    "participle_stems array<struct<stem:string,gloss:string>>, demonym_seeds map<string,string>, "
    "ethnonym_suffixes array<string>, sense_clusters array<array<string>>"
)
# Aliases of language codes, by scope.
LANGUAGE_ALIASES = {
    "ingest": {"lat": "la", "el": "grc", "eng": "en", "egx": "egy"},
    "history": {"latin": "la", "greek": "grc", "ancient greek": "grc", "old english": "ang"},
    "packs": {"el": "grc", "lat": "la", "oe": "ang"},
}


def language_code(code: Column, scope: str = "ingest") -> Column:
    """The scope's canonical code; codes without an alias stay."""
    aliases = F.create_map(*[F.lit(x) for pair in LANGUAGE_ALIASES[scope].items() for x in pair])
    low = F.lower(F.trim(code))
    return F.coalesce(aliases[low], low)


def first_filled(*columns: Column) -> Column:
    """The first value that isn't null or blank; zero counts as missing for numbers."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns])


def _ordered(df: DataFrame) -> DataFrame:
    """Adds ord: file, then place in the file as Spark read it."""
    return df.withColumn("ord", F.monotonically_increasing_id())


def read_jsonl(spark: SparkSession, path: str, schema: str = GOLD, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """JSON lines. Returns the good rows and the malformed lines; blank lines are skipped. A limit counts
    physical lines."""
    lines = _ordered(spark.read.text(path))
    if limit is not None:
        lines = lines.orderBy("ord").limit(limit)
    lines = lines.filter(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("row").isNull() | F.col("row._bad").isNotNull()
    return parsed.filter(~bad).select("ord", "row.*").drop("_bad"), parsed.filter(bad).select("ord", "value")


def script_language(form: Column) -> Column:
    """Language by script where nothing else tells it."""
    return (
        F.when(form.rlike(r"[Ͱ-Ͽἀ-῿]"), "grc").when(form.rlike(r"[\x{13000}-\x{1342f}]"), "egy")
        .when(form.rlike(r"[\x{12000}-\x{123ff}]"), "akk").when(form.rlike(r"[֐-׿]"), "he").otherwise("la")
    )


def read_map(spark: SparkSession, path: str, lang: str | None = None) -> DataFrame:
    """{form: gloss} or {form: {meaning | gloss | en}} in one JSON document: lang, form, meaning."""
    whole = spark.read.text(path, wholetext=True)
    pairs = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("form", "raw"))
    inner = F.from_json("raw", "meaning string, gloss string, en string")
    meaning = F.when(F.col("raw").startswith("{"), first_filled(inner["meaning"], inner["gloss"], inner["en"])).otherwise(F.col("raw"))
    found = pairs.select(F.lit(lang).alias("hint"), "form", meaning.alias("meaning"))
    return found.select(F.coalesce("hint", script_language(F.col("form"))).alias("lang"), "form", "meaning").filter(F.trim("meaning") != "")


def read_nested_map(spark: SparkSession, path: str) -> DataFrame:
    """{by_domain: {domain: {form: gloss}}, global_safe: {form: gloss}}: domain, form, gloss, confidence."""
    schema = "by_domain map<string,map<string,string>>, global_safe map<string,string>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"))
    domains = doc.select(F.explode("d.by_domain").alias("domain", "m")).select("domain", F.explode("m").alias("form", "gloss"), F.lit(0.80).alias("confidence"))
    safe = doc.select(F.lit("global").alias("domain"), F.explode("d.global_safe").alias("form", "gloss"), F.lit(0.82).alias("confidence"))
    return domains.unionByName(safe)


def fan_out(df: DataFrame, *columns: str) -> DataFrame:
    """One row per different filled value of the columns, as `form`."""
    values = F.array_distinct(F.array_compact(F.array(*[F.nullif(F.trim(c), F.lit("")) for c in columns])))
    return df.select("*", F.explode(values).alias("form"))


def read_csv_aliased(spark: SparkSession, path: str, aliases: dict[str, list[str]], drop_value: str | None = None, sep: str = ",") -> DataFrame:
    """Headered CSV whose columns go by several names; a name that is missing falls back to its position."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    low = {c.lower().lstrip("﻿"): c for c in raw.columns}
    chosen = []
    for place, (name, others) in enumerate(aliases.items()):
        there = [F.col(f"`{low[o.lower()]}`") for o in [name, *others] if o.lower() in low]
        chosen.append((F.coalesce(*there) if there else F.col(f"`{raw.columns[place]}`")).alias(name))
    df = raw.select(*chosen)
    return df if drop_value is None else df.filter(F.expr(" AND ".join(f"coalesce(`{c}`, '') <> '{drop_value}'" for c in aliases)))


def read_jdbc(spark: SparkSession, url: str, table: str, predicate: str | None = None, **options) -> DataFrame:
    """A relational table; the predicate is pushed to the database."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return df.filter(predicate) if predicate else df


def read_pairs(spark: SparkSession, path: str, columns: tuple[str, ...] = ("form", "gloss"), cut: int | None = None, last_wins: bool = True) -> DataFrame:
    """Tab-separated keys and a value, `#` comments skipped: one row per lower-cased key, the last (or first)."""
    rows = _ordered(spark.read.text(path)).filter(~F.col("value").startswith("#") & F.col("value").contains("\t"))
    parts = F.split("value", "\t", -1)
    values = [F.lower(F.trim(F.get(parts, F.lit(i)))) if i < len(columns) - 1 else F.trim(F.get(parts, F.lit(i))) for i in range(len(columns))]
    if cut is not None:
        values[-1] = F.left(values[-1], F.lit(cut))
    df = rows.select("ord", *[v.alias(c) for v, c in zip(values, columns, strict=True)]).filter(F.col(columns[-1]).isNotNull())
    return pick_by_order(df, list(columns[:-1]), last=last_wins)


def pick_by_order(df: DataFrame, keys: list[str], order: str = "ord", last: bool = False) -> DataFrame:
    """First or last row per key, as an aggregate, so that a frequent key is summed up before the shuffle."""
    rest = F.struct(*df.columns)
    pick = F.max_by(rest, order) if last else F.min_by(rest, order)
    return df.groupBy(*keys).agg(pick.alias("row")).select("row.*")


def read_tags(spark: SparkSession, path: str, tags: list[str]) -> DataFrame:
    """code, tag, value triples to one wide row per code."""
    raw = spark.read.option("sep", "\t").option("comment", "#").schema("cp string, tag string, value string").csv(path)
    return raw.groupBy("cp").pivot("tag", tags).agg(F.first("value"))


def read_parallel(spark: SparkSession, sentences: str, links: str, langs: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sentences (id, lang, text) of the languages, and links (a, b)."""
    s = spark.read.option("sep", "\t").option("quote", "").schema("id long, lang string, text string").csv(sentences)
    return s.filter(F.col("lang").isin(langs) & (F.trim("text") != "")), spark.read.option("sep", "\t").schema("a long, b long").csv(links)


def read_senses(spark: SparkSession, path: str, most: int = 3) -> DataFrame:
    """Nested dictionary lines: (word, gloss), for the word and each other form, the first `most` different glosses."""
    schema = "word string, lang_code string, forms array<struct<form:string>>, senses array<struct<glosses:array<string>,raw_glosses:array<string>>>"
    raw = spark.read.schema(schema).json(path)
    glosses = F.flatten(F.transform("senses", lambda s: F.concat(F.coalesce(s["glosses"], F.array()), F.coalesce(s["raw_glosses"], F.array()))))
    cleaned = F.slice(F.array_distinct(F.filter(F.transform(glosses, lambda g: F.trim(g)), lambda g: g != "")), 1, most)
    forms = F.concat(F.array("word"), F.coalesce(F.transform("forms", lambda f: f["form"]), F.expr("cast(array() as array<string>)")))
    rows = raw.select(F.explode(forms).alias("form"), cleaned.alias("g")).select("form", F.explode("g").alias("gloss"))
    return rows.dropDuplicates(["form", "gloss"])


def read_pools(spark: SparkSession, path: str, expected: int) -> DataFrame:
    """N-best caches: sent_id, place, hyp, score. A cache of another number of sentences is refused."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "n_src int, rows array<struct<hyps:array<string>,scores:array<double>>>").alias("d"))
    found = doc.select(F.max("d.n_src")).first()[0]
    if found != expected:
        raise ValueError(f"the cache has {found} sentences, not {expected}")
    rows = doc.select(F.posexplode("d.rows").alias("sent_id", "r"))
    return rows.select("sent_id", F.posexplode(F.arrays_zip("r.hyps", "r.scores")).alias("place", "z")).select("sent_id", "place", F.col("z.hyps").alias("hyp"), F.col("z.scores").alias("score"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Gazetteer names: one row per filled form column."""
    columns = ["attested_form", "romanized_form_1", "romanized_form_2", "romanized_form_3"]
    raw = spark.read.option("header", True).csv(path)
    have = [c for c in columns if c in raw.columns]
    return raw.select("place_id", "title", "language_tag", F.explode(F.array_distinct(F.array_compact(F.array(*have)))).alias("form"))


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """Concept matrix: concept, and its English form or else its first."""
    raw = _ordered(spark.read.option("header", True).csv(path)).select("ord", "concept", "language", "form")
    order = F.struct((F.col("language") != "en").alias("other"), "ord")
    return raw.groupBy("concept").agg(F.min_by("form", order).alias("en"))


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """Language packs, merged by canonical code."""
    raw = spark.read.schema(LANGUAGE_PACK).option("multiLine", True).json(path)
    flat = lambda c: F.flatten(F.collect_list(F.coalesce(c, F.array()))).alias(c)
    return raw.groupBy(language_code(F.col("lang"), "packs").alias("lang")).agg(flat("seeds"), flat("participle_stems"), flat("ethnonym_suffixes"), flat("sense_clusters"))


def read_atlas(spark: SparkSession, path: str) -> DataFrame:
    """name, D_eff, delta_psi, delta_theta, observed, keywords."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    number = lambda c: F.col(c).cast("double").alias(c)
    return raw.select("name", number("D_eff"), number("delta_psi"), number("delta_theta"), F.col("observed").cast("int").cast("boolean").alias("observed"), "keywords")


def union_facts(*sources: DataFrame) -> DataFrame:
    """Facts of different shapes, missing columns null, with the rank of their source."""
    out = None
    for rank, df in enumerate(sources):
        df = df.withColumn("source_rank", F.lit(rank))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_hypotheses(spark: SparkSession, path: str) -> DataFrame:
    """Vision hypotheses; bbox becomes an array of doubles."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    return raw.select("gardiner", F.col("confidence").cast("double").alias("confidence"), "source", F.split("bbox", ",").cast("array<double>").alias("bbox"))


def profile(df: DataFrame, by: str) -> DataFrame:
    """Rows and filled values of each column, by one column."""
    others = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.count("*").alias("rows"), *[F.count(c).alias(f"filled_{c}") for c in others])


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def number_rows(df: DataFrame, *order: str, name: str = "ord") -> DataFrame:
    """0, 1, 2, ... in a total order, made from counts per range partition, so no task gets all rows. The ranges are
    written, as their bounds are sampled and would not be the same twice."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    ranged = cut(ranged.withColumn("__i", F.monotonically_increasing_id()))
    counts = ranged.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__i").alias("__first"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("__p", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return ranged.join(F.broadcast(offsets), "__p").withColumn(name, F.col("__i") - F.col("__first") + F.col("__before")).drop("__p", "__i", "__first", "__before")
