"""Queries of sources, projections, filters and record validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import gloss as G
from lexmill.functions import text as T
from lexmill.operators import retrieve
from lexmill.operators.similarity import best_of
from lexmill.plans import sql as Q
from lexmill.plans.registry import query
from lexmill.session import shared_path, table
from lexmill.sources import readers, sinks

Session = SparkSession


@query("jsonl_scan_events", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def jsonl_scan_events(spark: Session, sf: str) -> DataFrame:
    """Events written as JSON lines among blank and malformed ones, and scanned with a given schema."""
    path = shared_path(spark, "jsonl")
    rows = table(spark, sf, "events").select(F.to_json(F.struct("event_id", "user_id", "event_type")).alias("value"))
    junk = spark.createDataFrame([("",), ("{not json",), ("   ",)], "value string")
    rows.unionByName(junk).write.text(path)
    good, _ = readers.read_jsonl(spark, path, "event_id long, user_id long, event_type string")
    return good.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("map_fan_out", """
SELECT kind, count(*) AS n, count(DISTINCT form) AS forms FROM (
  SELECT DISTINCT p_partkey, 'all' AS kind, form FROM (
    SELECT p_partkey, unnest([trim(p_name), trim(p_brand), trim(p_type), lower(trim(p_name))]) AS form FROM part) WHERE form <> '') GROUP BY kind""")
def map_fan_out(spark: Session, sf: str) -> DataFrame:
    """Up to four different forms of one record, one row each."""
    p = table(spark, sf, "part").withColumn("low", F.lower("p_name"))
    return readers.fan_out(p, "p_name", "p_brand", "p_type", "low").groupBy(F.lit("all").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("form").alias("forms"))


@query("csv_scan_aliased", "SELECT n_regionkey::VARCHAR AS region, count(*) AS n FROM nation WHERE n_name <> 'XXX' GROUP BY 1")
def csv_scan_aliased(spark: Session, sf: str) -> DataFrame:
    """A headered CSV whose columns go by other names."""
    path = shared_path(spark, "csv")
    table(spark, sf, "nation").select(F.col("n_name").alias("languageReference"), F.col("n_regionkey").alias("Region")).write.option("header", True).csv(path)
    df = readers.read_csv_aliased(spark, path, {"name": ["languageReference", "language_id"], "region": ["regionkey"]}, drop_value="XXX")
    return df.groupBy("region").agg(F.count("*").alias("n"))


@query("relational_scan_filtered", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal >= 5000 AND length(c_name) BETWEEN 4 AND 30 AND c_mktsegment LIKE 'B%'")
def relational_scan_filtered(spark: Session, sf: str) -> DataFrame:
    """The filters reach the scan."""
    return table(spark, sf, "customer").filter((F.col("c_acctbal") >= 5000) & F.length("c_name").between(4, 30) & F.col("c_mktsegment").like("B%")).select("c_custkey", "c_name")


@query("pairs_last_wins", """
SELECT form, gloss FROM (
  SELECT lower(p_type) AS form, left(p_name, 48) AS gloss, row_number() OVER (PARTITION BY lower(p_type) ORDER BY p_partkey DESC) AS r FROM part) WHERE r = 1""")
def pairs_last_wins(spark: Session, sf: str) -> DataFrame:
    """Key and value pairs where the last line of a key wins, values cut at 48 characters."""
    rows = table(spark, sf, "part").select(F.lower("p_type").alias("form"), F.left("p_name", F.lit(48)).alias("gloss"), F.col("p_partkey").alias("ord"))
    return readers.pick_by_order(rows, ["form"], last=True).select("form", "gloss")


@query("tags_to_wide", """
SELECT user_id, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'view' THEN value END) AS view,
       max(CASE WHEN event_type = 'purchase' THEN value END) AS purchase FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY user_id""")
def tags_to_wide(spark: Session, sf: str) -> DataFrame:
    """Tagged values to one wide row; the tags are given, so no pass looks for them."""
    tags = ["click", "view", "purchase"]
    return table(spark, sf, "events").filter(F.col("event_type").isin(tags)).groupBy("user_id").pivot("event_type", tags).agg(F.max("value"))


@query("nested_senses", f"""
SELECT word, count(*) AS n FROM (SELECT DISTINCT l_orderkey AS word, l_returnflag || '-' || l_linestatus AS gloss FROM lineitem) GROUP BY word HAVING count(*) >= 2""")
def nested_senses(spark: Session, sf: str) -> DataFrame:
    """Nested lists of glosses, distinct per word."""
    nested = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("word")).agg(F.collect_list(F.concat("l_returnflag", F.lit("-"), "l_linestatus")).alias("glosses"))
    return nested.select("word", F.explode(F.array_distinct("glosses")).alias("gloss")).groupBy("word").agg(F.count("*").alias("n")).filter("n >= 2")


@query("pool_scan", "SELECT l_orderkey AS sent_id, l_linenumber - 1 AS place, l_extendedprice AS score FROM lineitem")
def pool_scan(spark: Session, sf: str) -> DataFrame:
    """Parallel arrays of hypotheses and scores to one row each."""
    li = table(spark, sf, "lineitem")
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice"))).alias("z"))
    each = rows.select(F.col("l_orderkey").alias("sent_id"), F.explode(F.arrays_zip(F.col("z.l_linenumber").alias("h"), F.col("z.l_extendedprice").alias("s"))).alias("x"))
    return each.select("sent_id", (F.col("x.h") - 1).alias("place"), F.col("x.s").alias("score"))


@query("append_log_replay", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id")
def append_log_replay(spark: Session, sf: str) -> DataFrame:
    """Two appends to a log of JSON lines, replayed."""
    path = shared_path(spark, "log")
    c = table(spark, sf, "conversations")
    sinks.append_log(c.filter("role = 'user'"), path)
    sinks.append_log(c.filter("role <> 'user' OR role IS NULL"), path)
    return sinks.replay_log(spark, path, "conv_id long, turn long, role string, text string").groupBy("conv_id").agg(F.count("*").alias("n"))


@query("union_of_facts", """
SELECT source_rank, count(*) AS n, count(price) AS priced FROM (
  SELECT 0 AS source_rank, p_name AS title, p_retailprice AS price FROM part UNION ALL
  SELECT 1, s_name, NULL FROM supplier UNION ALL SELECT 2, n_name, NULL FROM nation) GROUP BY source_rank""")
def union_of_facts(spark: Session, sf: str) -> DataFrame:
    """Sources of different shapes in a fixed order, missing columns null."""
    facts = readers.union_facts(
        table(spark, sf, "part").select(F.col("p_name").alias("title"), F.col("p_retailprice").alias("price")),
        table(spark, sf, "supplier").select(F.col("s_name").alias("title")), table(spark, sf, "nation").select(F.col("n_name").alias("title")),
    )
    return facts.groupBy("source_rank").agg(F.count("*").alias("n"), F.count("price").alias("priced"))


@query("image_sink")
def image_sink(spark: Session, sf: str) -> DataFrame:
    """A small image per row as PNG bytes; returns its size and signature."""
    rgb = F.unhex(F.repeat(F.lpad(F.hex("r_regionkey"), 6, "0"), 16))
    images = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit(4).alias("width"), F.lit(4).alias("height"), rgb.alias("rgb"))
    return sinks.encode_images(images).select("id", F.length("png").alias("n_bytes"), F.hex(F.substring("png", 1, 8)).alias("signature"))


@query("source_profile", "SELECT lang, count(*) AS rows, count(doc_id) AS filled_doc_id, count(text) AS filled_text, count(source) AS filled_source FROM documents GROUP BY lang")
def source_profile(spark: Session, sf: str) -> DataFrame:
    """Rows and filled values by language."""
    return readers.profile(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), "lang")


@query("gold_records", f"""
SELECT lang, count(*) AS n, sum(is_name::INT)::BIGINT AS names FROM (
  SELECT CASE lower(trim(lang)) WHEN 'lat' THEN 'la' WHEN 'eng' THEN 'en' ELSE lower(trim(lang)) END AS lang, trim(word) AS word, {Q.slug('gloss')} AS key,
         regexp_matches(gloss, '^[A-Z]') AS is_name
  FROM (SELECT lang, word, word AS gloss FROM (SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents)))
WHERE word <> '' AND length(word) <= 80 AND key NOT IN ('', 'unknown', '?', 'null', 'none') AND length(lang) <= 4 GROUP BY lang""")
def gold_records(spark: Session, sf: str) -> DataFrame:
    """Canonical records: normalised codes, trimmed words, rejected blanks and over-long forms."""
    raw = table(spark, sf, "documents").select("lang", F.explode(F.split("text", " ")).alias("word"))
    rec = raw.select(readers.language_code(F.col("lang")).alias("lang"), readers.first_filled(F.col("word")).alias("word"), T.slug(F.col("word")).alias("key"), F.col("word").rlike("^[A-Z]").alias("is_name"))
    good = rec.filter(F.col("word").isNotNull() & (F.length("word") <= 80) & ~F.col("key").isin("", "unknown", "?", "null", "none") & (F.length("lang") <= 4))
    return good.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.col("is_name").cast("long")).alias("names"))


GLOSSES = [
    ("water",), ("nominative_plural_of_aqua",), ("genitive_of_rex",), ("form_of_x",), ("a_t_os",), ("glaphur_s",), ("king_of_rome",), ("hand",), ("name_of_a_city",),
    ("bcdfghjkl",), ("river_in_gaul",), ("unknown",), ("the_of_and",), ("present_active_infinitive_of_amo",), ("x",), ("",), ("great_stone_house_of_the_old_king_in_the_mountains_beyond_the_sea",),
]
CASES = ", ".join(f"'{w}'" for w in G.CASE_WORDS)
SQL_META = (
    f"(m = '' OR regexp_matches(m, '^(?:{'|'.join(G.GRAMMAR_HEADS)})(?:_|$)') OR contains(m, 'form_of_') OR regexp_matches(m, '^(initialism_of|inflection_of_|name_of_)')"
    f" OR (len(b) >= 3 AND len(list_filter(b, lambda x: x IN ({', '.join(f"'{w}'" for w in G.GRAMMAR_WORDS)}))) >= 2)"
    f" OR (len(list_filter(b, lambda x: x IN ({CASES}) OR x LIKE '%genitive' OR x LIKE '%dative')) > 0 AND len(list_filter(b, lambda x: x NOT IN ({CASES}) AND length(x) >= 3)) <= 1))"
)
SQL_GARBAGE = (
    f"({SQL_META} OR length(m) > 90 OR len(regexp_extract_all(m, '_')) > 14 OR (len(regexp_extract_all(m, '[a-z]')) >= 8 AND len(regexp_extract_all(m, '[aeiouy]')) < 0.15 * len(regexp_extract_all(m, '[a-z]')))"
    " OR (len(c) >= 2 AND len(list_filter(c, lambda x: length(x) <= 1)) >= greatest(2, len(c) // 2))"
    " OR (contains(m, '_') AND (len(list_filter(c, lambda x: length(x) >= 4)) = 0 OR len(list_filter(c, lambda x: length(x) <= 1)) >= 2))"
    f" OR (regexp_matches(m, '_[a-z]$') AND length(m) <= 16) OR regexp_matches(m, '^[a-z]{{3,12}}_[a-z]{{1,2}}$') OR m IN ({', '.join(f"'{w}'" for w in G.SHELLS)}) OR regexp_matches(m, '{G.GRAMMAR_TEXT}'))"
)
def sql_keys(glosses: str) -> str:
    """The rows of a query with a gloss, and what the twins of the predicates work on."""
    stop = ", ".join(f"'{w}'" for w in G.STOP)
    found = f"list_filter(regexp_extract_all(gloss, '[a-z]{{3,}}'), lambda x: x NOT IN ({stop}))"
    return f"SELECT *, string_split(m, '_') AS b, list_filter(string_split(m, '_'), lambda x: x <> '') AS c, {found} AS found FROM (SELECT *, regexp_replace(lower(gloss), '^_+|_+$', '', 'g') AS m FROM ({glosses}))"


SQL_KEYS = sql_keys(f"SELECT gloss FROM {Q.values(GLOSSES, 'gloss')} UNION ALL SELECT DISTINCT {Q.slug('p_name')} FROM part")
SQL_CONTENT = (
    f"CASE WHEN gloss = '' THEN 0.0 WHEN {SQL_GARBAGE} THEN 0.05 WHEN len(found) = 0 THEN 0.2"
    " ELSE least(1.0, 0.4 + 0.1 * len(found) + 0.3 * least(1.0, 12.0::DOUBLE / greatest(4, length(gloss)))) * CASE WHEN length(gloss) > 50 THEN 0.7 ELSE 1 END END::DOUBLE"
)


def _glosses(spark: Session, sf: str) -> DataFrame:
    fixed = spark.sql("SELECT * FROM " + Q.values(GLOSSES, "gloss"))
    return fixed.union(table(spark, sf, "part").select(T.slug(F.col("p_name"))).distinct())


@query("gloss_predicates", f"SELECT gloss, {SQL_META} AS grammatical, {SQL_GARBAGE} AS garbage FROM ({SQL_KEYS})")
def gloss_predicates(spark: Session, sf: str) -> DataFrame:
    """Grammatical and garbage glosses."""
    return _glosses(spark, sf).select("gloss", G.is_grammatical(F.col("gloss")).alias("grammatical"), G.is_garbage(F.col("gloss")).alias("garbage"))


@query("gloss_content_score", f"SELECT gloss, round({SQL_CONTENT}, 9) AS score FROM ({SQL_KEYS})")
def gloss_content_score(spark: Session, sf: str) -> DataFrame:
    """how much content a gloss has."""
    return _glosses(spark, sf).select("gloss", F.round(G.content_score(F.col("gloss")), 9).alias("score"))


@query("gloss_length_score", "SELECT DISTINCT p_type AS gloss, 0.5 + CASE WHEN length(p_type) <= 2 THEN -0.35 WHEN length(p_type) = 3 THEN 0.05 WHEN length(p_type) <= 12 THEN 0.35 WHEN length(p_type) <= 24 THEN 0.15 ELSE 0.05 END + CASE WHEN contains(p_type, ' ') THEN 0 ELSE 0.15 END::DOUBLE AS score FROM part")
def gloss_length_score(spark: Session, sf: str) -> DataFrame:
    """the score by length bands."""
    return table(spark, sf, "part").select("p_type").distinct().select(F.col("p_type").alias("gloss"), G.gloss_score(F.col("p_type")).alias("score"))


BANNED = ["the ", "!!", "###", "http"]


@query("bad_gloss_counts", f"SELECT lang, sum((length(trim(line)) = 0 OR length(line) > 48 OR {' OR '.join(f"contains(lower(line), '{b}')" for b in BANNED)})::INT)::BIGINT AS bad, count(*) AS n FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY lang")
def bad_gloss_counts(spark: Session, sf: str) -> DataFrame:
    """P5: length caps and banned parts."""
    lines = table(spark, sf, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    bad = (F.length(F.trim("line")) == 0) | (F.length("line") > 48)
    for b in BANNED:
        bad = bad | F.lower("line").contains(b)
    return lines.groupBy("lang").agg(F.sum(bad.cast("long")).alias("bad"), F.count("*").alias("n"))


@query("name_split", "SELECT is_name, count(*) AS n FROM (SELECT regexp_matches(p_name, '^[A-Z]') OR len(string_split(p_name, ' ')) >= 6 OR p_size IN (1, 2, 3) AS is_name FROM part) GROUP BY is_name")
def name_split(spark: Session, sf: str) -> DataFrame:
    """Names apart from the rest by pattern, kind or length."""
    is_name = F.col("p_name").rlike("^[A-Z]") | (F.size(F.split("p_name", " ")) >= 6) | F.col("p_size").isin(1, 2, 3)
    return table(spark, sf, "part").groupBy(is_name.alias("is_name")).agg(F.count("*").alias("n"))


@query("junk_tokens", f"""
SELECT lang, count(DISTINCT token) AS n FROM (SELECT lang, unnest({Q.words('text', '[a-z]+')}) AS token FROM documents)
WHERE length(token) >= 3 AND token NOT IN ('the', 'nth') AND (regexp_matches(token, '{"|".join(chr(97 + i) * 3 for i in range(26))}')
  OR (length(token) >= 4 AND NOT regexp_matches(token, '[aeiouy]')) OR regexp_matches(token, '^(zz|xx|qq|asdf|qwer|zxcv)')) GROUP BY lang""")
def junk_tokens(spark: Session, sf: str) -> DataFrame:
    """Tokens that no gloss should be made for."""
    toks = table(spark, sf, "documents").select("lang", F.explode(T.words(F.col("text"))).alias("token")).distinct()
    return toks.filter(retrieve.junk_token(F.col("token"), ["the", "nth"])).groupBy("lang").agg(F.count("*").alias("n"))


@query("low_quality_claims", "SELECT low, count(*) AS n FROM (SELECT len(regexp_extract_all(text, '!!')) >= 3 OR (contains(text, '***')::INT + contains(text, '###')::INT + contains(text, ' | ')::INT) >= 2 AS low FROM documents) GROUP BY low")
def low_quality_claims(spark: Session, sf: str) -> DataFrame:
    """Texts with three marks of one kind, or two kinds of shells."""
    shells = sum(F.col("text").contains(s).cast("int") for s in ("***", "###", " | "))
    return table(spark, sf, "documents").groupBy(((T.count_of(F.col("text"), "!!") >= 3) | (shells >= 2)).alias("low")).agg(F.count("*").alias("n"))


@query("miss_classes", """
SELECT class, count(*) AS n FROM (
  SELECT CASE WHEN trim(p) = '' THEN 'fallback_empty' WHEN regexp_matches(p, '^(nominative|genitive|name_of_)') THEN 'meta_or_name_dump'
              WHEN length(regexp_replace(p, '[^a-z]', '', 'g')) >= 4 AND len(regexp_extract_all(p, '[aeiouy]')) < 0.15 * length(regexp_replace(p, '[^a-z]', '', 'g')) AND contains(p, '_') THEN 'garbage_translit'
              WHEN length(p) > 80 OR len(regexp_extract_all(p, ' ')) > 12 THEN 'wiki_dump_long'
              WHEN regexp_matches(w, '(ensis|anus)$') THEN 'ethnonym_missense' WHEN n_chars > 2000 THEN 'exact_wrong_sense' ELSE 'near_miss_or_other' END AS class
  FROM (SELECT lower(text) AS p, lower(text) AS w, n_chars FROM documents)) GROUP BY class""")
def miss_classes(spark: Session, sf: str) -> DataFrame:
    """Ordered rules give each miss one class."""
    d = table(spark, sf, "documents").select(F.lower("text").alias("p"), F.lower("text").alias("w"), "n_chars")
    flat = F.length(F.regexp_replace("p", "[^a-z]", ""))
    cls = (
        F.when(F.trim("p") == "", "fallback_empty").when(F.col("p").rlike("^(nominative|genitive|name_of_)"), "meta_or_name_dump")
        .when((flat >= 4) & (T.count_of(F.col("p"), "[aeiouy]") < 0.15 * flat) & F.col("p").contains("_"), "garbage_translit")
        .when((F.length("p") > 80) | (T.count_of(F.col("p"), " ") > 12), "wiki_dump_long").when(F.col("w").rlike("(ensis|anus)$"), "ethnonym_missense")
        .when(F.col("n_chars") > 2000, "exact_wrong_sense").otherwise("near_miss_or_other")
    )
    return d.groupBy(cls.alias("class")).agg(F.count("*").alias("n"))


STOPS, SCIENCE, META, OLD = ["the", "of", "and", "is", "a", "to", "in", "with"], ["entropy", "tion"], ["latin", "greek"], ["est", "manus"]


@query("input_modes", f"""
SELECT mode, count(*) AS n FROM (
  SELECT CASE WHEN sci >= 1 AND en >= 0.25 THEN 'science_query' WHEN meta >= 1 AND en >= 0.35 THEN 'english_meta' WHEN old > 0 AND en >= 0.4 THEN 'mixed'
              WHEN (old / greatest(con, 1)::DOUBLE >= 0.5 AND con <= 8) OR (old > 0 AND en < 0.35) THEN 'classical_surface'
              WHEN en >= 0.4 OR (st >= 2 AND con >= 1) THEN 'modern_english' WHEN old > 0 THEN 'classical_surface' ELSE 'mixed' END AS mode
  FROM (SELECT st, sci, meta, old, len(t) - st AS con, st / greatest(len(t), 1)::DOUBLE AS en FROM (
    SELECT t, len(list_filter(t, lambda x: x IN {tuple(STOPS)})) AS st, len(list_filter(t, lambda x: x IN {tuple(SCIENCE)})) AS sci,
           len(list_filter(t, lambda x: x IN {tuple(META)})) AS meta, len(list_filter(t, lambda x: x IN {tuple(OLD)})) AS old
    FROM (SELECT {Q.words('text')} AS t FROM conversations)))) GROUP BY mode""")
def input_modes(spark: Session, sf: str) -> DataFrame:
    """P10: what kind of utterance a turn is."""
    mode = retrieve.input_mode(F.col("text"), STOPS, SCIENCE, META, OLD)
    return table(spark, sf, "conversations").groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))


def hash_bucket(key, modulus: int):
    """SHA-256 of the key as one large number, modulo; folded over its hex digits."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.conv(F.substr(F.sha2(key, 256), i, F.lit(1)), 16, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda a, d: (a * 16 + d) % modulus)


@query("hash_split_counts", """
SELECT CASE WHEN h < 8500 THEN 'train' ELSE 'test' END AS part, count(*) AS n, sum(h)::BIGINT AS total FROM (
  SELECT list_reduce(list_prepend(0, list_transform(range(1, 65), lambda i: instr('0123456789abcdef', substr(sha256('la:' || p_name), i, 1)) - 1)), lambda a, d: (a * 16 + d) % 10000) AS h FROM part) GROUP BY 1""")
def hash_split_counts(spark: Session, sf: str) -> DataFrame:
    """A split by hash that depends on the key alone."""
    h = table(spark, sf, "part").select(hash_bucket(F.concat(F.lit("la:"), "p_name"), 10000).alias("h"))
    return h.groupBy(F.when(F.col("h") < 8500, "train").otherwise("test").alias("part")).agg(F.count("*").alias("n"), F.sum("h").alias("total"))


@query("stratified_quota", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM documents) WHERE r <= 25")
def stratified_quota(spark: Session, sf: str) -> DataFrame:
    """At most 25 of each language, by hash; the limit is applied before the shuffle."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return best_of(d, ["lang"], [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")], 25).select("lang", "doc_id")


@query("fixed_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 100")
def fixed_sample(spark: Session, sf: str) -> DataFrame:
    """100 rows by hash order: top-k per partition, then one merge."""
    return table(spark, sf, "documents").select("doc_id").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(100)


@query("breadth_pick", f"""
SELECT p_brand, n FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) a LEFT JOIN {Q.values([('Brand#55', 0), ('Brand#11', 1), ('Brand#99', 2)], 'name, r')} ON name = p_brand
WHERE n >= 5 ORDER BY coalesce(r, 1000), n DESC, p_brand LIMIT 20""")
def breadth_pick(spark: Session, sf: str) -> DataFrame:
    """Preferred keys first while they have mass, then by mass; 20 of them."""
    rank = spark.sql("SELECT * FROM " + Q.values([("Brand#55", 0), ("Brand#11", 1), ("Brand#99", 2)], "name, r"))
    n = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n")).filter("n >= 5")
    return n.join(rank, F.col("p_brand") == F.col("name"), "left").orderBy(F.coalesce("r", F.lit(1000)), F.desc("n"), "p_brand").limit(20).select("p_brand", "n")


@query("claim_records", "SELECT sha256(conv_id::VARCHAR || '|' || turn::VARCHAR || '|' || role) AS id, role || ' said: ' || text AS claim_text, [role, 'turn' || turn::VARCHAR] AS tags FROM conversations")
def claim_records(spark: Session, sf: str) -> DataFrame:
    """Claims with ids that depend on their content, so reruns agree."""
    key = F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role")
    return table(spark, sf, "conversations").select(
        F.sha2(key, 256).alias("id"), F.concat("role", F.lit(" said: "), "text").alias("claim_text"),
        F.array("role", F.concat(F.lit("turn"), F.col("turn").cast("string"))).alias("tags"),
    )
