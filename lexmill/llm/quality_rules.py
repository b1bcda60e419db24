"""Quality rules with host verdicts, DataFrame functions only.

Every document is measured inside its row (arrays and higher-order functions, no shuffle of words). Rule
failures are summed by host, the failure rates are shrunk towards an empirical beta prior that is fitted to
all hosts by the method of moments, and the verdict of the host is joined back to its documents.

Cases: a null or empty text has no words and fails the base rules; a null host is a host of its own;
repeated rows are measured and returned one by one; an empty table gives an empty result; other columns of
the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import fresh, pick, space_words
from lexmill.session import cut, table

#: Fixed values of the base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected if its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5

SYMBOLS = r"[^#*$%&|<>]+"


def _at(array: Column, i: Column) -> Column:
    return F.get(array, i)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None) -> DataFrame:
    """One row per document: doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    n_repeat_words counts the words in three-word windows that occur at least twice in the text. Windows are
    compared by 64-bit hash: they are sorted as (hash prefix, position) packed into one long, so that equal
    windows become neighbours, and neighbours are compared by the whole hash."""
    host = F.col("source") if host is None else host
    base = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), host.alias("host"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t")
    )
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = base.select("doc_id", "host", "t", space_words(F.col("t")).alias("w"), lines.alias("lines"))
    two = one.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "w")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("w") >= 4,
            F.transform(
                F.sequence(F.lit(0), F.size("w") - 3),
                lambda i: F.xxhash64(_at(F.col("w"), i), _at(F.col("w"), i + 1), _at(F.col("w"), i + 2)),
            ),
        ).alias("h"),
    )
    kept = ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    bits = F.ceil(F.log2(F.col("n_words") + 1)).cast("int")
    # texts whose windows are all different have nothing to count
    three = two.select(
        *kept,
        F.when(F.size(F.array_distinct("h")) < F.size("h"), F.col("h")).alias("h"),
        bits.alias("bits"),
        F.expr("shiftleft(1L, cast(ceil(log2(n_words + 1)) as int)) - 1L").alias("mask"),
    )
    four = three.select(
        *kept,
        "h",
        "mask",
        F.sort_array(
            F.transform("h", lambda x, i: F.call_function("shiftleft", x, F.col("bits")).bitwiseOR(i.cast("long")))
        ).alias("packed"),
    )
    five = four.select(
        *kept,
        F.transform("packed", lambda p: p.bitwiseAND(F.col("mask"))).alias("at"),
        F.transform("packed", lambda p: _at(F.col("h"), p.bitwiseAND(F.col("mask")).cast("int"))).alias("sorted"),
    )
    same = lambda i, j: F.coalesce(_at(F.col("sorted"), i) == _at(F.col("sorted"), j), F.lit(False))
    repeated = F.sort_array(F.filter("at", lambda _, i: same(i, i + 1) | same(i, i - 1)))
    six = five.select(*kept, repeated.alias("starts"))
    gaps = F.zip_with(
        F.expr("slice(starts, 1, size(starts) - 1)"),
        F.expr("slice(starts, 2, size(starts) - 1)"),
        lambda a, b: F.least(b - a, F.lit(3).cast("long")),
    )
    covered = F.aggregate(gaps, F.lit(3).cast("long"), lambda acc, x: acc + x)
    return six.select(*kept, F.when(F.size("starts") > 0, covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Method of moments over all hosts (columns n, failed): the variance between hosts, less what sampling
    alone explains, sets how strongly rates are shrunk. One row comes to the driver."""
    rate = F.col("failed") / F.col("n")
    row = hosts.agg(
        F.count("*").alias("hosts"), (F.sum("failed") / F.sum("n")).alias("mean"),
        F.var_pop(rate).alias("var"), F.avg(1 / F.col("n")).alias("inv"),
    ).first()
    if not row["hosts"] or row["mean"] is None or row["mean"] in (0.0, 1.0):
        return 0.5, 0.5
    spread = row["mean"] * (1 - row["mean"])
    between = max(row["var"] - spread * row["inv"], spread * 1e-3)
    strength = max(spread / between - 1, 1.0)
    return row["mean"] * strength, (1 - row["mean"]) * strength


def host_verdicts(measured: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, n, failed, host_rate (posterior mean), host_failed."""
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    alpha, beta = beta_prior(hosts)
    rate = (F.col("failed") + alpha) / (F.col("n") + alpha + beta)
    return hosts.withColumn("host_rate", rate).withColumn("host_failed", F.col("host_rate") > max_host_rate)


def quality_rules(docs: DataFrame, host: Column | None = None, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """doc_id, the measures, base_failed, kept, and of the host: host_n, host_base_failed (documents), host_rate (shrunk),
    host_failed. One row per document.

    The measures are made once and kept in the shared folder, as the hosts' sums and the result both need
    them. What is joined back is one row per host, without texts."""
    measured = cut(measures(docs, host=host).withColumn("base_failed", base_failed()))
    verdicts = host_verdicts(measured, max_host_rate).select(
        F.col("host").alias("vhost"), F.col("n").alias("host_n"), F.col("failed").alias("host_base_failed"), F.round("host_rate", 6).alias("host_rate"), "host_failed"
    )
    joined = measured.join(verdicts, F.col("host").eqNullSafe(F.col("vhost")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))).alias("kept"), "host_n", "host_base_failed", "host_rate", "host_failed",
    )


def filter_quality(docs: DataFrame, host: Column | None = None, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The kept documents with all their columns. Rows are numbered in a written table, so each has its own verdict,
    whatever its id."""
    row, good_row = fresh(docs, "row"), fresh(docs, "good_row")
    own = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    host = F.col("source") if host is None else host
    rules = quality_rules(own.select(F.col(row).alias("doc_id"), F.col("text"), host.alias("source")), max_host_rate=max_host_rate)
    good = rules.filter("kept").select(F.col("doc_id").alias(good_row))
    return own.join(good, F.col(row) == F.col(good_row), "left_semi").drop(row)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(pick(docs, doc_id="doc_id", text="text", source="source"))


SQL = r"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM base),
ln AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM base)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
pos AS (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w),
win AS (SELECT r, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) AS k FROM pos),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + d) AS n_repeat_words FROM rep, (SELECT unnest([0, 1, 2]) AS d) GROUP BY r),
m AS (
  SELECT w.r, doc_id, source, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN ln USING (r) LEFT JOIN cov USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source AS host, count(*) AS n, sum(base_failed::INT) AS failed FROM f GROUP BY source),
p AS (
  SELECT sum(failed) / sum(n) AS mean, var_pop(failed / n) AS v, avg(1 / n) AS inv FROM h),
q AS (
  SELECT mean, mean * (1 - mean) AS spread,
         greatest(mean * (1 - mean) / greatest(v - mean * (1 - mean) * inv, mean * (1 - mean) * 1e-3) - 1, 1.0) AS strength FROM p),
v AS (
  SELECT host, n, failed, (failed + CASE WHEN mean IN (0, 1) THEN 0.5 ELSE mean * strength END)
             / (n + CASE WHEN mean IN (0, 1) THEN 1.0 ELSE strength END) AS rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rate > 0.5 AS kept, n AS host_n, failed::BIGINT AS host_base_failed, round(rate, 6) AS host_rate, rate > 0.5 AS host_failed
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.host
"""
