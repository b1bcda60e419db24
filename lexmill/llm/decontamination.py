"""Benchmark decontamination as a prefix-filtered set join, DataFrame functions only.

A benchmark item is cut into windows of `window` consecutive words (a shorter item is one window). A window
is a set of word shingles with positions. Shingles are ordered by rarity over all documents; as a window must
be contained whole, its necessary prefix is one token, its rarest shingle. Postings of that token give
candidates (document, window, start); length and positional bounds drop those that would not fit; the rest
are verified by all shingles that tile the window at their exact positions.

The documents are read once. Only postings of benchmark shingles and one row per document leave that scan.
The benchmark's shingles are broadcast if their counted number is within `broadcast_rows`; beyond it the same
join is dealt by shingle. Shingles are 64-bit hashes that include their length; a window of ten words is reported if
its two tiles agree at exact positions, one of `SHINGLE` words or fewer if its only one does.

Cases: null or empty texts have no words; items without words match nothing; an item without id marks words
but isn't listed; repeated documents are returned row by row, repeated items count once; an empty benchmark
or an empty table gives no hits or no rows; other columns of either table, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import alnum_words, fresh, pick
from lexmill.session import cut, scratch, table

WINDOW = 10
SHINGLE = 5
#: About 40 MB as a hash relation.
BROADCAST_ROWS = 1_000_000


def _hash(words: str, i: Column, k: int) -> Column:
    """Hash of k words from i (from 0). The length is part of it."""
    return F.xxhash64(F.lit(k), *[F.get(F.col(words), i + j) for j in range(k)])


def _hashes(words: str, k: int) -> Column:
    at = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(at, lambda i: _hash(words, i, k))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """w (array of words), items (array of the ids that have it): one row per different window."""
    items = benchmark.select("item_id", alnum_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    cuts = F.transform(starts, lambda i: F.slice("words", i, window))
    return items.select("item_id", F.explode(cuts).alias("w")).groupBy("w").agg(F.collect_set("item_id").alias("items"))


def _window_shingles(windows: DataFrame, sizes: list[int]) -> DataFrame:
    """wid, len, k, offset, h: every shingle of every window."""
    rows = [
        windows.filter(F.least(F.col("len"), F.lit(SHINGLE)) == k).select(
            "wid", "len", F.lit(k).alias("k"), F.posexplode(_hashes("w", k)).alias("offset", "h")
        )
        for k in sizes
    ]
    return reduce(DataFrame.unionAll, rows)


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, key, n_words, spans (array of struct(start, end), disjoint and in order), n_hit, items: one row
    per document. key tells rows of one doc_id with different texts apart."""
    docs = pick(docs, doc_id="doc_id", text="text")
    windows = cut(
        item_windows(pick(benchmark, item_id="item_id", text="text"), window)
        .select(F.sha2(F.to_json(F.struct("w")), 256).alias("wid"), F.size("w").alias("len"), "w", "items")
    )
    sizes = sorted(r[0] for r in windows.select(F.least(F.col("len"), F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]
    shingles = cut(_window_shingles(windows, sizes))
    tokens = shingles.select("h", "k").distinct()
    if tokens.count() <= broadcast_rows:
        tokens = F.broadcast(tokens)

    # one scan: a first element stands for the document itself, the others are its shingles in order. The outer
    # form of posexplode keeps the optimizer from inferring a filter on the array, which would compute it twice
    words = docs.select("doc_id", F.xxhash64("text").alias("key"), alnum_words(F.col("text")).alias("w"))
    rows = words.select(
        "doc_id", "key", F.size("w").alias("n"), F.concat(F.array(F.xxhash64("doc_id")), *[_hashes("w", k) for k in sizes]).alias("hs")
    ).select("doc_id", "key", "n", F.posexplode_outer("hs").alias("i", "h"))
    before, begins = F.lit(1), {}
    for k in sizes:
        begins[k] = before
        before = before + F.greatest(F.col("n") - k + 1, F.lit(0))
    begin = reduce(lambda other, k: F.when(F.col("k") == k, begins[k]).otherwise(other), sizes, F.lit(0))
    found = cut(
        rows.join(tokens, "h", "left")
        .filter((F.col("i") == 0) | F.col("k").isNotNull())
        .select("doc_id", "key", "n", F.when(F.col("i") > 0, F.col("i") - begin).alias("pos"), "h")
    )
    base = found.filter(F.col("pos").isNull()).select("doc_id", "key", F.col("n").cast("long").alias("n_words"))
    postings = found.filter(F.col("pos").isNotNull()).distinct()

    # the necessary prefix of each window: its rarest shingle
    rarity = postings.groupBy("h").agg(F.count("*").alias("df"))
    prefix = (
        shingles.join(rarity, "h", "left")
        .groupBy("wid", "len", "k")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "offset")).alias("p"))
        .filter("p.df > 0")
        .select("wid", "len", "k", "p.h", "p.offset")
    )
    candidates = (
        postings.join(prefix, "h")
        .select("doc_id", "key", "n", "wid", "len", (F.col("pos") - F.col("offset")).alias("start"))
        .filter((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n")))
    )
    # the shingles that tile a window: every k-th and the last
    tiles = shingles.filter((F.col("offset") % F.col("k") == 0) | (F.col("offset") == F.col("len") - F.col("k")))
    tiles = tiles.groupBy("wid").agg(F.collect_list(F.struct("offset", "h")).alias("tiles"))
    wanted = candidates.join(tiles, "wid").select("doc_id", "key", "wid", "len", "start", F.size("tiles").alias("need"), F.explode("tiles").alias("t"))
    wanted = wanted.select("doc_id", "key", "wid", "len", "start", "need", (F.col("start") + F.col("t.offset")).alias("pos"), F.col("t.h").alias("h"))
    there = postings.select(F.col("doc_id").alias("d2"), F.col("key").alias("key2"), F.col("pos").alias("pos2"), F.col("h").alias("h2"))
    verified = (
        wanted.join(
            there,
            F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("key") == F.col("key2")) & (F.col("pos") == F.col("pos2")) & (F.col("h") == F.col("h2")),
            "left_semi",
        )
        .groupBy("doc_id", "key", "wid", "len", "start", "need")
        .agg(F.count("*").alias("got"))
        .filter("got = need")
        .join(windows.select("wid", "items"), "wid")
    )
    per_doc = verified.groupBy("doc_id", "key").agg(
        F.sort_array(F.collect_set(F.struct(F.col("start"), (F.col("start") + F.col("len")).alias("end")))).alias("raw"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    merged = F.aggregate(
        "raw",
        empty,
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))),
    )
    # counted on its own, so that the spans are only built for who reads them
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("last"))
    covered = F.aggregate(
        "raw",
        start,
        lambda acc, x: F.struct(
            (acc["total"] + F.greatest(x["end"] - F.greatest(x["start"], acc["last"]), F.lit(0))).alias("total"), F.greatest(acc["last"], x["end"]).alias("last")
        ),
        lambda acc: acc["total"],
    )
    spans = per_doc.select(F.col("doc_id").alias("d2"), F.col("key").alias("key2"), merged.alias("spans"), covered.alias("n_hit"), "items")
    return base.join(spans, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("key") == F.col("key2")), "left").select(
        "doc_id", "key", "n_words",
        F.coalesce("spans", empty).alias("spans"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.array_sort(F.transform("items", lambda x: x.cast("string"))).alias("items"),
    )


def decontamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contaminated_words(docs, benchmark, **options)
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.greatest(F.coalesce(F.size("items"), F.lit(0)), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.0, **options) -> DataFrame:
    """The documents with all their columns, without those of which more than max_share of the words is hit."""
    bad_id, bad_key = fresh(docs, "bad_id"), fresh(docs, "bad_key")
    with scratch() as kept:
        hit = contaminated_words(docs, benchmark, **options).filter((F.col("n_hit") > 0) & (F.col("n_hit") > F.col("n_words") * max_share))
        bad = kept(hit.select(F.col("doc_id").alias(bad_id), F.col("key").alias(bad_key)).distinct())
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.xxhash64("text") == F.col(bad_key)), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, w[i:i + 9] AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ls AS (SELECT DISTINCT len(k) AS l FROM bw),
dw AS (
  SELECT r, i, l, w[i:i + l - 1] AS k
  FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls WHERE len(w) >= l)),
hit AS (SELECT DISTINCT r, i, l, item_id FROM dw JOIN bw USING (k)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM hit) GROUP BY r),
its AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
