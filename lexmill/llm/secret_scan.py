"""Secret scan with a random forest that removes false positives; DataFrame functions and Spark ML only.

Candidates are whole runs of 16 or more key characters with a digit, and private-key headers. The forest judges each by its
length, character classes and their transitions, the share that dictionary words cover, path-like form, and the
neighbouring words. It is trained from labelled findings (value, left, right, path, label); without any of the
caller's, `labelled_findings()` makes a fixed set from rules: keys beside words that name them against digests,
identifiers, paths, placeholders and encoded data beside theirs.

Cases: null and empty texts have no candidates and score 0; a null source is an empty path; repeated rows are
returned one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import pick
from lexmill.session import cut, table

#: '=' is padding at the end of a run, and a sign between a name and its value elsewhere.
KEY = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
HEADER = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
#: Shorter values with a digit right behind a name and '='.
SHORT = r"(?<=[A-Za-z0-9_-]=)(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{6,15}+(?![A-Za-z0-9+/_-])"
CANDIDATE = f"{HEADER}|{KEY}|{SHORT}"
#: Characters of context on the left and on the right.
LEFT, RIGHT = 48, 16
THRESHOLD = 0.5
TREES, DEPTH, SEED = 30, 7, 5
FINDINGS = 4000

#: Words that a generated key hardly contains.
DICTIONARY = (
    "about after again align array async audio author base before begin block body book border bottom branch build button "
    "cache call center change chapter check child class clear client code color column commit common compare component config "
    "content control copy count create data default delete design detail device display document download draft east edit element "
    "email enable encode error event example export field file filter final find font footer form format frame from function "
    "group handle header height help hidden home icon image import index info inner input insert install item label language "
    "large layer layout left length level library line link list load local login main manager margin master match media menu "
    "message method middle model module name native network north note number object offset only open option order outer output "
    "owner package page panel parent password path pattern people place plugin point policy position post print private process "
    "product profile project public query read record region release remove render report request reset resource response result "
    "right root scroll search section select server service session setting share shadow short simple site size small source "
    "south space stack start state static status store stream string style submit summary support switch system table target task "
    "template test text theme time title token tool total track transition type unit update upload user value version video view "
    "visible watch west width window word world wrapper write year"
).split()
NAMES = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|auth|credential|private|bearer|client.?id)"
OTHERS = r"(?i)(sha-?\d*|md5|commit|checksum|digest|hash|uuid|guid|etag|revision|integrity|image|base64|order|invoice|isbn|phone|serial|build|version|example|dummy|sample|placeholder)"

FEATURES = (
    "f_length", "f_digit", "f_upper", "f_symbol", "f_transitions", "f_hex", "f_covered", "f_slash", "f_dash", "f_prefix",
    "f_named", "f_other", "f_assigned", "f_quoted", "f_in_path", "f_distinct", "f_code_path",
)


def _share(value: Column, chars: str) -> Column:
    return (F.length(value) - F.length(F.regexp_replace(value, f"[{chars}]+", ""))) / F.greatest(F.length(value), F.lit(1))


def with_features(found: DataFrame) -> DataFrame:
    """Adds the columns FEATURES to value, left, right, path."""
    v, left, right, path = (F.coalesce(F.col(c), F.lit("")) for c in ("value", "left", "right", "path"))
    n = F.greatest(F.length(v), F.lit(1))
    change = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    words = "|".join(sorted((w for w in DICTIONARY if len(w) > 3), key=len, reverse=True))
    number = lambda condition: condition.cast("double")
    return found.withColumns({
        "f_length": F.length(v).cast("double"),
        "f_digit": _share(v, "0-9"),
        "f_upper": _share(v, "A-Z"),
        "f_symbol": _share(v, "^A-Za-z0-9"),
        "f_transitions": F.size(F.split(v, change, -1)) / n,
        "f_hex": number(v.rlike("^[0-9a-fA-F]+$")),
        "f_covered": (n - F.length(F.regexp_replace(F.lower(v), words, ""))) / n,
        "f_slash": _share(v, "/"),
        "f_dash": _share(v, "_-"),
        "f_prefix": number(v.rlike(r"^(AKIA|ASIA|gh[pousr]_|glpat-|sk_live_|sk-|xox[abps]-|AIza|eyJ|-----BEGIN)")),
        "f_named": number(left.rlike(NAMES + r"[^\n]{0,14}$")),
        "f_other": number(left.rlike(OTHERS + r"[^\n]{0,14}$")),
        "f_assigned": number(left.rlike(r"[=:]\s*[\"'`]?$")),
        "f_quoted": number(left.rlike(r"[\"'`]$") & right.rlike(r"^[\"'`]")),
        "f_in_path": number(left.rlike(r"(https?://|www\.|/|\\)\S*$")),
        "f_distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "f_code_path": number(path.rlike(r"(?i)\.(py|js|ts|java|go|rb|env|ya?ml|json|toml|ini|cfg|sh)$")),
    })


def candidates(docs: DataFrame) -> DataFrame:
    """rid, doc_id, value, left, right, path: a row per candidate, one with a null value for documents without."""
    found = F.regexp_extract_all("text", F.lit(f"({CANDIDATE})"), F.lit(1))
    around = F.split("text", CANDIDATE, -1)
    has = F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False))
    base = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "path", F.when(has, found).alias("found"), F.when(has, around).alias("around"))
    each = F.transform(
        "found",
        lambda value, i: F.struct(
            value.alias("value"),
            # a name with a digit is a candidate itself, and stands before its value
            F.substring(F.concat(F.coalesce(F.get("found", i - 1), F.lit("")), F.get("around", i)), -LEFT, LEFT).alias("left"),
            F.substring(F.get("around", i + 1), 1, RIGHT).alias("right"),
        ),
    )
    return base.select("rid", "doc_id", "path", F.explode_outer(each).alias("c")).select("rid", "doc_id", "path", "c.value", "c.left", "c.right")


def labelled_findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """value, left, right, path, label: a fixed set made by rule from hashes of 0, 1, 2, ..., as candidates() reads it from texts"""
    hexes = lambda seed: F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    packed = lambda seed: F.regexp_replace(F.base64(F.unhex(hexes(seed))), "=", "")
    pick_of = lambda values, seed: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(len(values))) + 1).cast("int"))
    size = (F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(24)) + 20).cast("int")
    words = F.concat_ws("_", *[pick_of(DICTIONARY, s) for s in (2, 3, 4)])
    name = pick_of(("token", "api_key", "apikey", "secret", "password", "access key", "auth_token", "client_secret", "private key"), 5)
    sign = pick_of((' = "', ": ", "=", ' = ', ': "', " '", " "), 6)
    other = pick_of(("commit ", "sha256:", "md5: ", "checksum = ", "digest ", "uuid: ", "etag: \"", "revision ", "order ", "the ", "integrity=\"sha512-", "of file ", "invoice no. ", "image;base64,"), 7)
    uuid = F.regexp_replace(F.substring(hexes("u"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    s1, s0, kind = F.substring(packed("a"), 1, 40), hexes("b"), F.col("id") % 10
    secret = F.when(kind == 0, F.substring(s0, 1, 40)).when(kind == 1, F.substr(s1, F.lit(1), size)).when(
        kind == 2, F.concat(F.lit("AKIA"), F.upper(F.substring(hexes("c"), 1, 16)))).when(
        kind == 3, F.concat(pick_of(("ghp_", "sk_live_", "glpat-", "xoxb-"), 8), F.substring(F.regexp_replace(packed("d"), "[+/]", "x"), 1, 36))).otherwise(
        F.substr(s0, F.lit(1), F.when(size % 2 == 0, 32).otherwise(40)))
    harmless = F.when(kind == 5, F.substr(s0, F.lit(1), F.when(size % 2 == 0, 40).otherwise(64))).when(kind == 6, uuid).when(
        kind == 7, F.concat(words, F.lit("_"), (F.col("id") % 97).cast("string"))).when(
        kind == 8, F.concat(F.lit("src/"), F.regexp_replace(words, "_", "/"), (F.col("id") % 7).cast("string"))).otherwise(
        F.concat(F.lit("example_key_1234567890"), (F.col("id") % 3).cast("string")))
    context = lambda what: F.concat(pick_of(("", "see ", "with ", "x.\n", "and then ", "export ", "https://host/get?x=1&"), 9), what)
    good = kind < 5
    made = spark.range(0, rows, 1, 4).select(
        "id",
        F.when(good, secret).otherwise(harmless).alias("value"),
        F.when(good, context(F.concat(name, sign))).when(kind == 8, context(pick_of(("/", "https://host/", "in "), 10))).when(
            kind == 9, context(F.concat(name, sign))).otherwise(context(other)).alias("left"),
        F.when(good & sign.contains('"'), F.lit('" x')).otherwise(pick_of((" and", "\n", ".", ""), 11)).alias("right"),
        pick_of(("", "src0", "a.py", "conf.yaml", "notes.txt"), 12).alias("path"),
    )
    read = candidates(made.select(F.col("id").alias("doc_id"), F.concat("left", "value", "right").alias("text"), "path")).filter(F.col("value").isNotNull())
    return read.select("value", "left", "right", "path", (F.col("doc_id") % 10 < 5).cast("int").alias("label"))


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel:
    """A forest from labelled findings; their number is bounded by whoever labels them."""
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(findings))
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=SEED, maxMemoryInMB=64)
    return forest.fit(cut(vectors.select("features", F.col("label").cast("double").alias("label"))))


def scored(found: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """found with score, the forest's share for a secret; 0 without a value."""
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(found))
    probability = vector_to_array("probability")[1]
    out = model.transform(vectors).withColumn("score", F.when(F.col("value").isNull(), 0.0).otherwise(probability))
    return out.select(*found.columns, "score")


def secret_scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_candidates, n_secrets, score (the highest), secrets (array of struct(value, left, score)): one row
    per document."""
    own = pick(docs, doc_id="doc_id", text="text", path="source")
    found = cut(candidates(own))  # row numbers hold from here on
    model = train(labelled_findings(docs.sparkSession) if findings is None else findings)
    secret = F.col("score") >= threshold
    return (
        scored(found, model)
        .groupBy("rid", "doc_id")
        .agg(
            F.count("value").alias("n_candidates"),
            F.sum(F.when(secret, 1).otherwise(0)).cast("long").alias("n_secrets"),
            F.max("score").alias("score"),
            F.sort_array(F.collect_list(F.when(secret, F.struct("value", "left", "score")))).alias("secrets"),
        )
        .drop("rid")
    )


def query(spark, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    values = F.array_join(F.transform("secrets", lambda x: F.sha2(x["value"], 256)), ",")
    return found.select("doc_id", "n_candidates", "n_secrets", F.round("score", 6).alias("score"), values.alias("secrets_sha256"))
