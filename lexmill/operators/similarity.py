"""Blocked similarity joins. Every join is an equi-join on a block key, so no pair of different blocks is made."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T


def best_of(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "place") -> DataFrame:
    """The k first rows of each group with their place from 1. The limit is applied before the shuffle too, so a group
    is never larger than k rows per task."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col(name) <= k)


def prefix_pairs(left: DataFrame, right: DataFrame, prefix: int) -> DataFrame:
    """a, b with equal first characters. left has a, right has b; distinct before the join."""
    x = left.select("a").distinct().withColumn("block", F.left("a", F.lit(prefix)))
    y = right.select("b").distinct().withColumn("block", F.left("b", F.lit(prefix)))
    return x.join(y, "block")


def edit_neighbours(left: DataFrame, right: DataFrame, prefix: int = 3) -> DataFrame:
    """For each a the nearest b, by distance then by b: at most 1 edit under 7 characters, else 2; lengths of 4 or more
    that differ by no more than that and 1."""
    cap = F.when(F.length("a") < 7, 1).otherwise(2)
    pairs = prefix_pairs(left, right, prefix).filter((F.length("a") >= 4) & (F.length("b") >= 4) & (F.abs(F.length("a") - F.length("b")) <= cap + 1))
    near = pairs.withColumn("distance", F.levenshtein("a", "b", 2)).filter(F.col("distance").between(1, cap))
    return near.groupBy("a").agg(F.min_by(F.struct("b", "distance"), F.struct("distance", "b")).alias("r")).select("a", "r.*")


def band_pairs(left: DataFrame, right: DataFrame, band: int = 3, least: float = 0.35) -> DataFrame:
    """a, b, similarity: equal first character and lengths within the band, by exploding the length to its band."""
    x = left.select("a").distinct().select("a", F.left("a", F.lit(1)).alias("first"), F.explode(F.sequence(F.length("a") - band, F.length("a") + band)).alias("size"))
    y = right.select("b").distinct().select("b", F.left("b", F.lit(1)).alias("first"), F.length("b").alias("size"))
    pairs = x.join(y, ["first", "size"]).filter("a <> b")
    return pairs.select("a", "b", T.combined_similarity(F.col("a"), F.col("b")).alias("similarity")).filter(F.col("similarity") >= least)


def top_donors(pairs: DataFrame, k: int = 5) -> DataFrame:
    """The k most similar b of each a, as an array of struct(similarity, b), best first."""
    best = best_of(pairs, ["a"], [F.desc("similarity"), F.desc("b")], k)
    return best.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("similarity", "b")), asc=False).alias("top"))


def gram_vectors(forms: DataFrame, n: int = 3) -> DataFrame:
    """form, gram, tf, norm of the character n-grams of #form#."""
    counted = forms.select("form").distinct().select("form", F.explode(T.grams(F.concat(F.lit("#"), "form", F.lit("#")), n)).alias("gram")).groupBy("form", "gram").agg(F.count("*").alias("tf"))
    norms = counted.groupBy("form").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    return counted.join(norms, "form")


def gram_pairs(left: DataFrame, right: DataFrame, n: int = 3, prefix: int = 2, least: float = 0.2) -> DataFrame:
    """form, other, cosine of n-gram counts within a block of equal first characters."""
    x = gram_vectors(left, n).withColumn("block", F.left("form", F.lit(prefix)))
    y = gram_vectors(right, n).select(F.col("form").alias("other"), "gram", F.col("tf").alias("tf2"), F.col("norm").alias("norm2"), F.left("form", F.lit(prefix)).alias("block"))
    dots = x.join(y, ["block", "gram"]).filter("form <> other").groupBy("form", "other").agg(F.sum(F.col("tf") * F.col("tf2")).alias("dot"), F.max("norm").alias("n1"), F.max("norm2").alias("n2"))
    return dots.select("form", "other", (F.col("dot") / (F.col("n1") * F.col("n2"))).alias("cosine")).filter(F.col("cosine") >= least)


def gram_neighbours(left: DataFrame, right: DataFrame, n: int = 3, prefix: int = 2, least: float = 0.2, k: int = 12) -> DataFrame:
    """form, near: the k nearest of gram_pairs() as an array of struct(cosine, other), best first."""
    best = best_of(gram_pairs(left, right, n, prefix, least), ["form"], [F.desc("cosine"), F.desc("other")], k)
    return best.groupBy("form").agg(F.sort_array(F.collect_list(F.struct("cosine", "other")), asc=False).alias("near"))


def cosine(a, b):
    """Cosine of two arrays of numbers; 0 if one is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    both = norm(a) * norm(b)
    return F.when(both == 0, 0.0).otherwise(dot / both)


def _vectors(column: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of `dim` numbers without a null as a matrix, and their rows."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    good = [i for i, n in enumerate(lists.value_lengths().to_pylist()) if n == dim]
    flat = lists.take(pa.array(good, pa.int64())).flatten()
    m = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(good), dim)
    if flat.null_count:
        whole = ~np.asarray(flat.is_null()).reshape(m.shape).any(axis=1)
        return m[whole], np.array(good, np.int64)[whole]
    return m, np.array(good, np.int64)


def _blocks(df: DataFrame, key: str, vector: str, rows: int, name: str, copies: int | None = None) -> DataFrame:
    """dim, keys, vectors as bytes: up to `rows` vectors of one length a row. Of equal vectors in a block only those with the `copies` smallest keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                keys, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
                for dim in sorted(set(lists.value_lengths().drop_null().to_pylist())):
                    m, where = _vectors(lists, dim)
                    ids = keys[where].astype(np.int64)
                    if copies is not None and len(ids):
                        order = np.lexsort((ids, np.unique(m, axis=0, return_inverse=True)[1].ravel()))
                        same = np.zeros(len(ids), bool)
                        same[copies:] = (m[order[copies:]] == m[order[:-copies]]).all(axis=1)
                        kept = np.sort(order[~same])
                        m, ids = m[kept], ids[kept]
                    if len(ids):
                        yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), f"{name}_keys": [ids.tobytes()], f"{name}_rows": [m.tobytes()]})

    return df.select(F.col(key).cast("long"), F.col(vector)).mapInArrow(run, f"dim int, {name}_keys binary, {name}_rows binary")


def nearest(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """q, key, cosine: the k vectors of the greatest cosine (to nine places, of equals the smallest key) of each query, but for the
    one of its own key. Exact: every block of vectors meets every block of queries in one product of matrices, and what
    its rounding leaves open is computed again number by number. Vectors that have a null, or another length than
    the query's, have no cosine and come last."""
    q = _blocks(queries.filter(F.col(key).isNotNull()), key, vector, 256, "q")
    v = _blocks(vectors.filter(F.col(key).isNotNull()), key, vector, 2048, "v", k + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, own = np.frombuffer(r["v_keys"], np.int64), np.frombuffer(r["q_keys"], np.int64)
                m, a = np.frombuffer(r["v_rows"]).reshape(len(ids), -1), np.frombuffer(r["q_rows"]).reshape(len(own), -1)
                unit = lambda x: x / np.where((n := np.sqrt((x * x).sum(axis=1, keepdims=True))) == 0, 1.0, n)
                c = unit(a) @ unit(m).T if r["dim"] else np.zeros((len(own), len(ids)))
                c[own[:, None] == ids[None, :]] = -np.inf
                n = min(k, c.shape[1])
                least = np.partition(c, c.shape[1] - n, axis=1)[:, -n]
                i, j = np.nonzero((c >= least[:, None] - 3e-9) & (c > -np.inf))
                exact = np.empty(len(i))
                for at in range(0, len(i), 65536):
                    part = slice(at, at + 65536)
                    x, y = a[i[part]], m[j[part]]
                    dot, xx, yy = (np.zeros(len(x)) for _ in range(3))
                    for d in range(r["dim"]):  # one number after the other, as the sum is written
                        dot, xx, yy = dot + x[:, d] * y[:, d], xx + x[:, d] * x[:, d], yy + y[:, d] * y[:, d]
                    both = np.sqrt(xx) * np.sqrt(yy)
                    exact[part] = np.where(both == 0, 0.0, dot / np.where(both == 0, 1.0, both))
                near = np.trunc(exact * 1e9 + np.copysign(0.5, exact)) / 1e9
                order = np.lexsort((ids[j], -near, i))
                place = np.arange(len(order)) - np.searchsorted(i[order], i[order])
                best = order[place < k]
                yield pa.RecordBatch.from_pydict({"q": own[i[best]], key: ids[j[best]], "cosine": exact[best], "near": near[best]})

    met = q.withColumnRenamed("dim", "q_dim").crossJoin(v.repartition(v.sparkSession.sparkContext.defaultParallelism)).filter("q_dim = dim").drop("q_dim")
    found = met.mapInArrow(run, f"q long, {key} long, cosine double, near double")
    # where fewer than k vectors have a cosine, those without follow; only the k + 1 smallest keys of a kind can be among them
    flat = lambda x: F.when(F.forall(vector, lambda y: y.isNotNull()), F.size(vector))
    kinds = best_of(vectors.filter(F.col(key).isNotNull()).select(key, flat(vector).alias("n")), ["n"], [F.col(key)], k + 1, "__p").select(key, "n")
    asked = queries.filter(F.col(key).isNotNull()).select(F.col(key).alias("q"), flat(vector).alias("m"))
    few = best_of(found, ["q"], [F.desc("near"), F.col(key)], k)
    short = asked.join(few.groupBy("q").agg(F.count("*").alias("have")), "q", "left").filter(F.coalesce("have", F.lit(0)) < k)
    rest = short.join(kinds, (F.col("q") != F.col(key)) & ~F.coalesce(F.col("m") == F.col("n"), F.lit(False))).select("q", key, F.lit(None).cast("double").alias("cosine"), F.lit(None).cast("double").alias("near"))
    return best_of(few.drop("place").unionByName(rest), ["q"], [F.desc("near"), F.col(key)], k)


def containment_pairs(left: DataFrame, right: DataFrame, least: float = 0.72, size: int = 6, prefix: int = 4) -> DataFrame:
    """a, b: one contains the other, both of `size` characters, lengths in the ratio `least`, in one block."""
    pairs = prefix_pairs(left, right, prefix).filter("a <> b")
    ratio = F.least(F.length("a"), F.length("b")) / F.greatest(F.length("a"), F.length("b"))
    return pairs.filter((F.length("a") >= size) & (F.length("b") >= size) & (F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a"))) & (ratio >= least)).select("a", "b", ratio.alias("ratio"))
