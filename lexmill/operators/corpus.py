"""Parallel corpora: pairing, co-occurrence tables, decoding and text-overlap metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import cells
from lexmill.session import cut
from lexmill.sources.readers import number_rows


def parallel_pairs(sentences: DataFrame, links: DataFrame, target: str, held_out: DataFrame, least: int = 2, most: int = 40, cap: int | None = None) -> DataFrame:
    """src_id, ref_id, lang, src, ref of links in either direction, without any whose id is held out, token counts in
    bounds; with a cap, evenly over the source lengths of each language."""
    both = links.select("a", "b").union(links.select("b", "a")).toDF("src_id", "ref_id").distinct()
    both = both.join(held_out.select(F.col("id").alias("src_id")), "src_id", "left_anti").join(held_out.select(F.col("id").alias("ref_id")), "ref_id", "left_anti")
    src = sentences.filter(F.col("lang") != target).select(F.col("id").alias("src_id"), "lang", F.col("text").alias("src"))
    ref = sentences.filter(F.col("lang") == target).select(F.col("id").alias("ref_id"), F.col("text").alias("ref"))
    pairs = both.join(src, "src_id").join(ref, "ref_id")
    n = lambda c: F.size(T.tokens(F.col(c)))
    pairs = pairs.filter(n("src").between(least, most) & n("ref").between(least, most))
    return pairs if cap is None else even_sample(pairs.withColumn("n", n("src")), "lang", ["n", "src_id", "ref_id"], cap).drop("n")


def even_sample(df: DataFrame, group: str, order: list[str], cap: int) -> DataFrame:
    """Every step-th row of a group in the order, step = max(1, rows // cap), the first cap of them."""
    numbered = cut(number_rows(df, group, *order, name="__o"))  # by ranges, as a group may hold most rows
    sizes = numbered.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n"), F.min("__o").alias("__first"))
    ranked = numbered.join(sizes, F.col(group).eqNullSafe(F.col("__g"))).withColumn("__i", F.col("__o") - F.col("__first"))
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / cap))
    return ranked.filter((F.col("__i") % step == 0) & (F.col("__i") / step < cap)).select(*df.columns)


def cooccurrence(pairs: DataFrame, src: str = "src", ref: str = "ref") -> DataFrame:
    """s, t, c, n: how often t stands in the target of a source with s (target repeats count, source repeats too), and how
    often s occurs. Sentences are short; each pair is multiplied out within itself only."""
    own = pairs.select(T.tokens(F.col(src)).alias("s"), T.tokens(F.col(ref)).alias("t")).filter((F.size("s") > 0) & (F.size("t") > 0))
    counts = own.select(F.explode("s").alias("s"), "t").select("s", F.explode("t").alias("t")).groupBy("s", "t").agg(F.count("*").alias("c"))
    totals = own.select(F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    return counts.join(totals, "s")


def top_translation(counts: DataFrame, least_n: int = 5, least_c: int = 3, share: float = 0.08, enough: int = 20) -> DataFrame:
    """s, t, c: the most frequent partner (on ties the smallest) that passes the thresholds and isn't the word itself."""
    best = counts.groupBy("s").agg(F.min_by(F.struct("t", "c", "n"), F.struct(-F.col("c"), "t")).alias("r")).select("s", "r.*")
    return best.filter((F.col("n") >= least_n) & (F.col("c") >= least_c) & (F.col("t") != F.col("s")) & (F.length("t") <= 40) & ((F.col("c") >= share * F.col("n")) | (F.col("c") >= enough))).select("s", "t", "c")


def best_partners(pairs: DataFrame, src: str = "src", ref: str = "ref", least_n: int = 5, least_c: int = 3, share: float = 0.08, enough: int = 20) -> DataFrame:
    """top_translation() of cooccurrence(), without a row for each pair of words: counted in arrays, and only the words that
    share a source's greatest count are looked up to decide between them."""
    own = cells.sentences(pairs, src, ref)
    top = cells.greatest(own, least_n, least_c, share, enough)
    names = lambda c, h: own.select(F.explode(c).alias(f"{c}_name")).distinct().select(F.xxhash64(f"{c}_name").alias(h), f"{c}_name")
    best = top.join(names("t", "t").hint("merge"), "t").groupBy("s").agg(F.min("t_name").alias("t"), F.first("c").alias("c"))
    return best.join(names("s", "s").hint("merge"), "s").filter((F.col("t") != F.col("s_name")) & (F.length("t") <= 40)).select(F.col("s_name").alias("s"), "t", "c")


def bigram_alignment(pairs: DataFrame, src: str = "src", ref: str = "ref") -> DataFrame:
    """s (two words), t (two words), c: each source bigram of each different pair aligned with the target bigram of the greatest sum of
    both words' counts (those of cooccurrence()), the first of equals. Counts are those of the whole corpus, so the result doesn't
    depend on its order."""
    return cells.aligned(cells.sentences(pairs, src, ref))


def ngram_counts(df: DataFrame, key: str, column: str, n: int, name: str) -> DataFrame:
    return T.explode_ngrams(df, [key], T.tokens(F.col(column)), n).groupBy(key, "g").agg(F.count("*").alias(name))


def overlap_sums(h: DataFrame, r: DataFrame, key: str) -> DataFrame:
    """One row: tp, fp, fn over multisets (counts h and r per key and gram)."""
    both = h.join(r, [key, "g"], "full").fillna(0, ["h", "r"])
    tp = F.least("h", "r")
    return both.agg(F.sum(tp).alias("tp"), F.sum(F.col("h") - tp).alias("fp"), F.sum(F.col("r") - tp).alias("fn"))


def f1(sums: DataFrame) -> DataFrame:
    tp, one = F.coalesce("tp", F.lit(0)), F.lit(1)
    p, r = tp / F.greatest(one, tp + F.col("fp")), tp / F.greatest(one, tp + F.col("fn"))
    return sums.select(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def bleu(pairs: DataFrame, key: str = "id", most: int = 4) -> DataFrame:
    """Corpus BLEU with add-one counts: bleu, bp, p1..p4. pairs: key, hyp, ref. Both sides are tokenised once, and the
    n-grams of all lengths are counted and joined in one pass."""
    own = cut(pairs.select(key, T.tokens(F.col("hyp")).alias("h"), T.tokens(F.col("ref")).alias("r")))

    def counts(side: str) -> DataFrame:
        parts = [T.explode_ngrams(own, [key], F.col(side), n).withColumn("n", F.lit(n)) for n in range(1, most + 1)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.groupBy(key, "n", "g").agg(F.count("*").alias(f"c_{side}"))

    met = counts("h").join(counts("r"), [key, "n", "g"], "left")
    match, total = F.least("c_h", F.coalesce("c_r", F.lit(0))), F.col("c_h")
    only = lambda x, n: F.coalesce(F.sum(F.when(F.col("n") == n, x)), F.lit(0))
    parts = met.agg(*[((only(match, n) + 1) / (only(total, n) + 1)).alias(f"p{n}") for n in range(1, most + 1)])
    lengths = own.agg(F.sum(F.size("h")).alias("hl"), F.sum(F.size("r")).alias("rl"))
    bp = F.when(F.col("hl") > F.col("rl"), 1.0).otherwise(F.exp(1 - F.col("rl") / F.greatest(F.lit(1), F.col("hl"))))
    mean = F.exp(sum(F.ln(f"p{n}") for n in range(1, most + 1)) / most)
    return parts.join(lengths).select(F.when(F.col("hl") > 0, bp * mean).otherwise(0.0).alias("bleu"), bp.alias("bp"), *[f"p{n}" for n in range(1, most + 1)])  # one row each


def sentence_bleu(hyp: Column, ref: Column, most: int = 4) -> Column:
    """Smoothed BLEU of two token arrays, by array functions alone."""
    def log_precision(n: int) -> Column:
        h, r = T.ngrams_of(hyp, n), T.ngrams_of(ref, n)
        count = lambda grams, g: F.size(F.filter(grams, lambda x: x == g))
        match = F.aggregate(F.transform(F.array_distinct(h), lambda g: F.least(count(h, g), count(r, g))), F.lit(0), lambda a, x: a + x)
        return F.when(F.size(hyp) < n, F.ln(F.lit(1e-9))).otherwise(F.ln((match + 1) / (F.size(h) + 1)))

    logs = [log_precision(n) for n in range(1, most + 1)]
    bp = F.when(F.size(hyp) > F.size(ref), 1.0).otherwise(F.exp(1 - F.size(ref) / F.greatest(F.lit(1), F.size(hyp))))
    return F.when((F.size(hyp) == 0) | (F.size(ref) == 0), 0.0).otherwise(bp * F.exp(sum(logs) / most))


def decode(sentences: DataFrame, phrases: DataFrame, longest: int = 3) -> DataFrame:
    """id, out: greedy from left to right, the longest phrase that the table (s, t; one row per s) has, else the word
    itself. Phrases of a text are found by a join, so the table may be of any size; the choice at a word depends on
    the choices before it, so it is a loop over the text's own hits in an Arrow batch. Neither the words of the texts nor the
    table go to the driver: of small files of texts Spark would guess a small side, and broadcast all their phrases."""
    table = cut(phrases.select("s", "t"))
    lengths = sorted(r[0] for r in table.select((F.length("s") - F.length(F.replace("s", F.lit(" "))) + 1).alias("n")).filter(F.col("n") <= longest).distinct().collect())
    own = sentences.select("id", F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda x: x != "").alias("toks"))

    def grams(n: int) -> Column:
        at = F.when(F.size("toks") >= n, F.sequence(F.lit(1), F.size("toks") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.col("toks") if n == 1 else F.transform(at, lambda i: F.concat_ws(" ", F.slice("toks", i, n)))

    inside = F.array_distinct(F.concat(F.array().cast("array<string>"), *map(grams, lengths)))
    each = own.select("id", F.explode(inside).alias("s")).hint("merge").join(table, "s")
    hits = each.groupBy(F.col("id").alias("of")).agg(F.collect_list(F.struct("s", "t")).alias("hits"))  # as many as the text has words, times `longest`

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            outs = []
            for toks, found in zip(b.column("toks"), b.column("hits"), strict=True):
                toks, known = toks.as_py(), {h["s"]: h["t"] for h in found.as_py() or ()}
                i, out = 0, []
                while i < len(toks):
                    n, word = next(((n, g) for n in reversed(lengths) if i + n <= len(toks) and (g := " ".join(toks[i : i + n])) in known), (1, None))
                    out.append(toks[i] if word is None else known[word])
                    i += n
                outs.append(" ".join(out))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(outs, pa.string())], ["id", "out"])

    return own.join(hits.hint("merge"), F.col("id").eqNullSafe(F.col("of")), "left").select("id", "toks", "hits").mapInArrow(run, f"id {dict(own.dtypes)['id']}, out string")


def install_pairs(pairs: DataFrame) -> DataFrame:
    """key, value: each source token to the target token at its proportional position; the first pair (by id) wins."""
    own = pairs.select("id", T.tokens(F.col("src")).alias("s"), T.tokens(F.col("ref")).alias("t")).filter((F.size("s") > 0) & (F.size("t") > 0))
    each = own.select("id", "s", "t", F.posexplode("s").alias("i", "key"))
    at = F.least(F.floor(F.col("i") * F.size("t") / F.size("s")), F.size("t") - 1).cast("int")
    return each.select("id", "i", "key", F.get("t", at).alias("value")).groupBy("key").agg(F.min_by("value", F.struct("id", "i")).alias("value"))
