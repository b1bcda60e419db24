"""Queries that write a table in the format of a source and read it with that source's reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import corpus
from lexmill.plans.join_queries import SQL_BINDINGS, bindings
from lexmill.plans.registry import query
from lexmill.session import shared_path, table
from lexmill.sources import readers

Session = SparkSession

#: Rows of one JSON document, where the source has a document a file.
BLOCK = 500


def _blocks(spark: Session, sf: str) -> DataFrame:
    """part with a form of its own for each row and the block of its document."""
    p = table(spark, sf, "part")
    return p.withColumn("form", F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))).withColumn("block", F.floor(F.col("p_partkey") / BLOCK))


def _documents(rows: DataFrame, name: str) -> str:
    """Writes a file for each row of (block, value), whose blocks differ."""
    path = shared_path(rows.sparkSession, name)
    rows.write.partitionBy("block").text(path)
    return path


def _lines(rows: DataFrame, key: str, order: str, line: Column, name: str) -> str:
    """Writes lines so that all of one key are in one file, in order."""
    path = shared_path(rows.sparkSession, name)
    rows.repartition(key).sortWithinPartitions(key, order).select(line.alias("value")).write.text(path)
    return path


@query("map_scan", "SELECT 'la' AS lang, p_name || ' ' || p_partkey::VARCHAR AS form, p_type AS meaning FROM part WHERE p_partkey % 4 <> 3")
def map_scan(spark: Session, sf: str) -> DataFrame:
    """JSON maps whose values are glosses, objects of one of three fields, or blank."""
    kind, gloss = F.col("p_partkey") % 4, F.col("p_type")
    raw = (
        F.when(kind == 0, F.format_string('"%s"', gloss)).when(kind == 1, F.format_string('{"gloss":"%s"}', gloss))
        .when(kind == 2, F.format_string('{"meaning":" ","en":"%s"}', gloss)).otherwise('""')
    )
    pairs = F.array_join(F.collect_list(F.format_string('"%s":%s', F.col("form"), raw)), ",")
    docs = _blocks(spark, sf).groupBy("block").agg(F.concat(F.lit("{"), pairs, F.lit("}")).alias("value"))
    return readers.read_map(spark, _documents(docs, "maps"))


@query("nested_map_scan", """
SELECT p_brand AS domain, p_name || ' ' || p_partkey::VARCHAR AS form, p_type AS gloss, 0.8::DOUBLE AS confidence FROM part WHERE p_size > 5
UNION ALL SELECT 'global', p_name || ' ' || p_partkey::VARCHAR, p_type, 0.82::DOUBLE FROM part WHERE p_size <= 5""")
def nested_map_scan(spark: Session, sf: str) -> DataFrame:
    """S3: maps of maps by domain, and one for all."""
    p = _blocks(spark, sf)
    entry = F.struct("form", "p_type")
    domains = p.filter("p_size > 5").groupBy("block", "p_brand").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    domains = domains.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("p_brand", "m"))).alias("by_domain"))
    safe = p.filter("p_size <= 5").groupBy("block").agg(F.map_from_entries(F.collect_list(entry)).alias("global_safe"))
    docs = domains.join(safe, "block", "full").select("block", F.to_json(F.struct("by_domain", "global_safe")).alias("value"))
    return readers.read_nested_map(spark, _documents(docs, "nested"))


@query("pairs_scan", "SELECT lower(p_name) AS form, arg_max(left(p_type || ' ' || p_brand, 12), p_partkey) AS gloss FROM part WHERE p_size > 1 GROUP BY 1")
def pairs_scan(spark: Session, sf: str) -> DataFrame:
    """Tab-separated keys and values among comments; the last line of a key wins, values are cut."""
    line = F.concat(F.when(F.col("p_size") == 1, "# ").otherwise(""), F.upper("p_name"), F.lit("\t"), "p_type", F.lit(" "), "p_brand")
    path = _lines(table(spark, sf, "part"), "p_name", "p_partkey", line, "pairs")
    return readers.read_pairs(spark, path, cut=12).select("form", "gloss")


@query("tags_scan", """SELECT 'S' || s_suppkey::VARCHAR AS cp, s_name AS "kName", s_nationkey::VARCHAR AS "kNation", CASE WHEN s_acctbal > 5000 THEN 'rich' END AS "kClass" FROM supplier""")
def tags_scan(spark: Session, sf: str) -> DataFrame:
    """Code, tag and value a line, to one wide row per code."""
    tag = lambda name, value: F.struct(F.lit(name).alias("tag"), value.alias("value"))
    tags = F.array(tag("kName", F.col("s_name")), tag("kNation", F.col("s_nationkey").cast("string")), tag("kClass", F.when(F.col("s_acctbal") > 5000, "rich")))
    rows = table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("cp"), F.explode(tags).alias("t")).select("cp", "t.tag", "t.value").filter("value IS NOT NULL")
    path = shared_path(spark, "tags")
    rows.write.option("sep", "\t").csv(path)
    return readers.read_tags(spark, path, ["kName", "kNation", "kClass"])


@query("parallel_scan", f"""
WITH s AS (SELECT ord AS id, lang, form FROM {SQL_BINDINGS} WHERE lang IN ('de', 'en')), l AS (SELECT p_partkey AS a, p_partkey + p_size AS b FROM part), bo AS (SELECT a, b FROM l UNION SELECT b, a FROM l)
SELECT x.id AS src_id, y.id AS ref_id FROM bo JOIN s x ON x.id = bo.a JOIN s y ON y.id = bo.b WHERE x.lang <> 'en' AND y.lang = 'en' AND x.id NOT IN (SELECT item_id FROM benchmark) AND y.id NOT IN (SELECT item_id FROM benchmark)""")
def parallel_scan(spark: Session, sf: str) -> DataFrame:
    """Sentences and links as tab-separated files, joined in both directions without the held-out ids."""
    sentences, links = shared_path(spark, "sentences"), shared_path(spark, "links")
    bindings(spark, sf).select("ord", "lang", "form").write.option("sep", "\t").csv(sentences)
    table(spark, sf, "part").select("p_partkey", F.col("p_partkey") + F.col("p_size")).toDF("a", "b").write.option("sep", "\t").csv(links)
    s, pairs = readers.read_parallel(spark, sentences, links, ["de", "en"])
    return corpus.parallel_pairs(s, pairs, "en", table(spark, sf, "benchmark").select(F.col("item_id").alias("id"))).select("src_id", "ref_id")


@query("sense_scan", "SELECT DISTINCT form, unnest([p_type, p_brand, p_size::VARCHAR]) AS gloss FROM (SELECT *, unnest([p_name, upper(p_name)]) AS form FROM part)")
def sense_scan(spark: Session, sf: str) -> DataFrame:
    """Dictionary lines with other forms and nested glosses; the first three different ones."""
    glosses = F.array("p_type", F.concat(F.lit(" "), "p_type", F.lit(" ")), F.lit(""), "p_brand")
    senses = F.array(F.struct(glosses.alias("glosses")), F.struct(F.array(F.col("p_size").cast("string"), "p_name").alias("glosses")))
    line = F.struct(F.col("p_name").alias("word"), F.lit("la").alias("lang_code"), F.array(F.struct(F.upper("p_name").alias("form"))).alias("forms"), senses.alias("senses"))
    path = shared_path(spark, "senses")
    table(spark, sf, "part").select(F.to_json(line).alias("value")).write.text(path)
    return readers.read_senses(spark, path)


@query("hypothesis_pool_scan", "SELECT n_regionkey AS sent_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS place, n_name AS hyp, n_nationkey / 4.0::DOUBLE AS score FROM nation")
def hypothesis_pool_scan(spark: Session, sf: str) -> DataFrame:
    """A cache of pools, one document: here a pool of nations for each region."""
    n = table(spark, sf, "nation")
    pools = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("z"))
    rows = F.struct(F.col("z.n_name").alias("hyps"), F.transform("z.n_nationkey", lambda k: k / 4.0).alias("scores"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n_regionkey", rows.alias("r")))), lambda x: x["r"])  # a row per region
    size = table(spark, sf, "region").count()
    path = shared_path(spark, "pools")
    pools.agg(F.to_json(F.struct(F.lit(size).alias("n_src"), ordered.alias("rows"))).alias("value")).coalesce(1).write.text(path)
    return readers.read_pools(spark, path, size)


@query("gazetteer_scan", """
SELECT DISTINCT s_suppkey::VARCHAR AS place_id, n_name AS title, CASE WHEN s_nationkey % 2 = 0 THEN 'la' ELSE 'grc' END AS language_tag, unnest(CASE WHEN s_acctbal > 0 THEN [s_name, lower(s_name)] ELSE [s_name] END) AS form
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def gazetteer_scan(spark: Session, sf: str) -> DataFrame:
    """Places with several forms a row, some of them blank or the same."""
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("place_id"), F.col("n_name").alias("title"), F.when(F.col("s_nationkey") % 2 == 0, "la").otherwise("grc").alias("language_tag"),
        F.col("s_name").alias("attested_form"), F.when(F.col("s_acctbal") > 0, F.lower("s_name")).alias("romanized_form_1"), F.col("s_name").alias("romanized_form_2"),
    )
    path = shared_path(spark, "places")
    rows.write.option("header", True).csv(path)
    return readers.read_names(spark, path)


@query("concept_scan", f"SELECT sense AS concept, arg_min(form, (CASE lang WHEN 'en' THEN 0 ELSE 1 END, ord)) AS en FROM {SQL_BINDINGS} GROUP BY sense")
def concept_scan(spark: Session, sf: str) -> DataFrame:
    """A concept's forms in several languages; the English one, or else the first."""
    path = shared_path(spark, "concepts")
    b = bindings(spark, sf).select(F.col("sense").alias("concept"), F.col("lang").alias("language"), "form", "ord")
    b.repartition("concept").sortWithinPartitions("concept", "ord").drop("ord").write.option("header", True).csv(path)
    return readers.read_concepts(spark, path)


CODES = ("el", "lat", "LA ", "oe", "grc", "akk")


@query("pack_languages", """
SELECT CASE lower(trim(code)) WHEN 'el' THEN 'grc' WHEN 'lat' THEN 'la' WHEN 'oe' THEN 'ang' ELSE lower(trim(code)) END AS lang, count(*) AS packs, sum(k)::BIGINT AS seeds, count(*) * 2 AS suffixes
FROM (SELECT ['el', 'lat', 'LA ', 'oe', 'grc', 'akk'][n_nationkey % 6 + 1] AS code, 1 + n_regionkey % 2 AS k FROM nation) GROUP BY 1""")
def pack_languages(spark: Session, sf: str) -> DataFrame:
    """Language packs, one document each, merged by their canonical codes."""
    seed = F.struct(F.col("n_name").alias("form"), F.lit("place").alias("gloss"), F.lit("la").alias("lang"))
    pack = F.struct(
        F.element_at(F.array(*map(F.lit, CODES)), (F.col("n_nationkey") % 6 + 1).cast("int")).alias("lang"), F.array_repeat(seed, (F.col("n_regionkey") % 2 + 1).cast("int")).alias("seeds"),
        F.array(F.lit("ensis"), F.lit("anus")).alias("ethnonym_suffixes"), F.array(F.struct(F.col("n_name").alias("stem"), F.lit("x").alias("gloss"))).alias("participle_stems"),
    )
    docs = table(spark, sf, "nation").select(F.col("n_nationkey").alias("block"), F.to_json(pack).alias("value"))
    packs = readers.read_packs(spark, _documents(docs, "packs"))
    return packs.select("lang", F.size("participle_stems").cast("long").alias("packs"), F.size("seeds").cast("long").alias("seeds"), F.size("ethnonym_suffixes").cast("long").alias("suffixes"))


@query("atlas_scan", """SELECT 'd_' || p_partkey::VARCHAR AS name, p_size::DOUBLE AS "D_eff", p_retailprice / 1000 AS delta_psi, 1.0::DOUBLE AS delta_theta, p_size % 2 = 1 AS observed, p_name AS keywords FROM part""")
def atlas_scan(spark: Session, sf: str) -> DataFrame:
    """A domain atlas with typed columns, a domain for each part."""
    path = shared_path(spark, "atlas")
    rows = table(spark, sf, "part").select(
        F.concat(F.lit("d_"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").cast("double").alias("D_eff"), (F.col("p_retailprice") / 1000).alias("delta_psi"),
        F.lit(1.0).alias("delta_theta"), (F.col("p_size") % 2).alias("observed"), F.col("p_name").alias("keywords"),
    )
    rows.write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_atlas(spark, path)


@query("box_scan", "SELECT 'A' || p_partkey::VARCHAR AS gardiner, p_retailprice / 10000 AS confidence, p_brand AS source, [p_size::DOUBLE, p_size + 0.5::DOUBLE, p_partkey::DOUBLE, 4::DOUBLE] AS bbox FROM part")
def box_scan(spark: Session, sf: str) -> DataFrame:
    """Hypotheses whose box is a text of four numbers."""
    path = shared_path(spark, "boxes")
    box = F.concat_ws(",", F.col("p_size").cast("string"), (F.col("p_size") + F.lit(0.5)).cast("string"), F.col("p_partkey").cast("string"), F.lit("4"))
    rows = table(spark, sf, "part").select(F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("gardiner"), (F.col("p_retailprice") / 10000).alias("confidence"), F.col("p_brand").alias("source"), box.alias("bbox"))
    rows.write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_hypotheses(spark, path)


@query("file_checksums", "SELECT sha256(n_name || chr(10)) AS sha256, (length(n_name) + 1)::BIGINT AS length FROM nation")
def file_checksums(spark: Session, sf: str) -> DataFrame:
    """Checksums of a file for each nation; downloads themselves are out of scope."""
    path = _documents(table(spark, sf, "nation").select(F.col("n_nationkey").alias("block"), F.col("n_name").alias("value")), "files")
    return readers.checksums(spark, f"{path}/*/*.txt").select("sha256", "length")
