"""Mixing sources to target weights by entropy balancing.

Sources take the weights 3, 1, 2, 3, 1, 2, ... in code-point order (null last) and share `total` times all words.
A target stops at `most` times the source's words, and the excess goes to the others by weight; with
w the weights and S the sizes this is min(most * S, level * w) for the one level that uses up the total, found
by raising it until no further source is full, each step one sum over the sources.

The rates of documents are those nearest to one copy each in entropy (bounded by `most`, so of the odds) under the
sources' token constraints: r = most * sigmoid(tilt * size / scale), an exponential tilt of every document by
its words, with the scale a source's mean size by words. The tilts solve the convex dual, sum of size * r =
target for each source, by Newton iterations whose gradient and curvature are sums over the distributed table of
sizes; a step that leaves the bracket of the solution halves it instead. Each rate is then rounded to whole
copies; documents of a source are dealt by hash to blocks of about `BLOCK`, and the words that a rounding adds or
leaves are carried to the next smaller document of the block, so a block misses its target by about its smallest
documents.

Rows that agree in id, source and text are one entry of the plan, with their number, in chunks of at most `CHUNK`;
its copies are shared out among them.

Cases: null and empty texts have size 0 and take no words; a null source is a source of its own, the last;
sources of other types go by their string; a source without words has target 0; repeated rows are rows of their
own; an empty table gives an empty result; other columns, whatever their names, are not read. Reruns agree, as
every order is by size and hash, and rows that can't be told apart are interchangeable.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import fresh, pick, space_words
from lexmill.session import cut, scratch, table
from lexmill.sources.readers import number_rows

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL = 1.5
MOST = 2
BLOCK = 1024
CHUNK = 64
ROUNDS = 60
TOLERANCE = 1e-7
#: Parts into which the rows of one entry are dealt to be numbered.
BUCKETS = 256


def _entry(*columns: str) -> Column:
    """128 bits of hash of the columns, nulls included."""
    fields = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.xxhash64(F.lit(3), *fields).alias("a"), F.xxhash64(F.lit(5), *fields).alias("b"))


def sizes_of(docs: DataFrame, **more: str) -> DataFrame:
    """doc_id, source, size, entry, and the columns of docs that `more` renames."""
    own = pick(docs, doc_id="doc_id", source="source", text="text", **more).withColumn("source", F.col("source").cast("string"))
    size = F.size(space_words(F.col("text"))).cast("long")
    return own.select("doc_id", "source", size.alias("size"), _entry("doc_id", "source", "text").alias("entry"), *more)


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """The columns of sources (source, source_size and others), s (the source's number in its order) and target."""
    ranked = number_rows(sources.withColumn("none", F.col("source").isNull()), "none", "source", name="s").drop("none")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    table_ = cut(ranked.withColumn("w", w).withColumn("cap", (most * F.col("source_size")).cast("double")))
    level, pool = 0.0, total * (table_.agg(F.sum("source_size")).first()[0] or 0)
    while True:  # a source that is full stays so, as the level only rises
        full = F.col("cap") < level * F.col("w")
        row = table_.agg(F.sum(F.when(full, F.col("cap"))).alias("used"), F.sum(F.when(~full, F.col("w"))).alias("free")).first()
        higher = (pool - (row["used"] or 0.0)) / row["free"] if row["free"] else float("inf")
        if higher <= level:
            break
        level = higher
        if level == float("inf"):
            break
    target = F.col("cap") if level == float("inf") else F.least("cap", level * F.col("w"))
    return table_.select(*sources.columns, "s", target.alias("target"))


def tilts(cells: DataFrame, wanted: DataFrame, most: float = MOST, rounds: int = ROUNDS) -> DataFrame:
    """s, tilt: Newton's method on the dual, one tilt per source. cells: s, z (size / scale), words (of all documents of
    that size); wanted: s, target, source_size. A source whose target is all it can give has no finite tilt; it gets an
    infinite one."""
    whole = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    state = wanted.filter("source_size > 0").select(
        "s", "target", whole.alias("whole"), F.lit(0.0).alias("tilt"), F.lit(-1e9).alias("lo"), F.lit(1e9).alias("hi")
    )
    state = cut(state)
    rate = most / (1 + F.exp(-F.col("tilt") * F.col("z")))
    for _ in range(rounds):
        moments = (
            cells.join(state.filter("not whole").select("s", "tilt"), "s")
            .groupBy("s")
            .agg(F.sum(F.col("words") * rate).alias("got"), F.sum(F.col("words") * F.col("z") * rate * (1 - rate / most)).alias("curve"))
        )
        off = F.col("target") - F.col("got")
        reach = F.greatest(F.abs("tilt"), F.lit(2.0))
        step = F.greatest(F.least(off / F.greatest("curve", F.lit(1e-12)), reach), -reach)
        lo, hi = F.when(off > 0, F.col("tilt")).otherwise(F.col("lo")), F.when(off > 0, F.col("hi")).otherwise(F.col("tilt"))
        moved = state.join(moments, "s", "left").select(
            "s", "target", "whole", (F.col("tilt") + step).alias("newton"), "tilt", lo.alias("lo"), hi.alias("hi"),
            F.when(~F.col("whole"), F.abs(off) / F.greatest("target", F.lit(1.0))).alias("off"),
        )
        inside = (F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi"))
        settled = F.coalesce(F.col("off") < TOLERANCE, F.lit(True))
        tilt = F.when(settled, F.col("tilt")).when(inside, F.col("newton")).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = cut(moved.select("s", "target", "whole", tilt.alias("tilt"), "lo", "hi", "off"))
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst < TOLERANCE:
            break
    return state.select("s", F.when(F.col("whole"), F.lit(float("inf"))).otherwise(F.col("tilt")).alias("tilt"))


def _rounded(most: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "h"], ascending=[False, True], kind="stable")
        copies, owed = [], 0.0
        for size, rate, rows in zip(block["size"], block["rate"], block["rows"], strict=True):
            if size <= 0:
                copies.append(min(most, int(rate + 0.5)) * rows)
                continue
            wish = rate * size * rows + owed
            c = min(most * rows, max(0, int(wish / size + 0.5)))
            owed = wish - c * size
            copies.append(c)
        return block.assign(copies=copies)[["doc_id", "entry_a", "entry_b", "s", "size", "chunk", "rows", "rate", "copies"]]

    return run


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, entry, number (0, 1, ... of the rows of an entry): one row
    per document."""
    sized = cut(sizes_of(docs))
    kind = dict(sized.dtypes)["doc_id"]
    return _planned(sized, kind, weights, total, most)


def _planned(sized: DataFrame, kind: str, weights: tuple[float, ...], total: float, most: int) -> DataFrame:
    with scratch() as kept:
        plan = kept(_tilted(sized, weights, total, most))
    by_source = F.col("source").eqNullSafe(F.col("name"))
    entries = sized.groupBy("entry").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("size").alias("size"), F.count("*").alias("m"))
    entries = entries.join(plan.select("name", "s", "n", "tilt", "scale"), by_source)
    chunks = entries.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / CHUNK))))
    h = F.xxhash64(F.lit(23), "entry", "chunk")
    infinite = F.col("tilt") == float("inf")
    rate = F.when(infinite, F.lit(float(most))).otherwise(most / (1 + F.exp(-F.col("tilt") * F.col("size") / F.col("scale"))))
    dealt = chunks.select(
        "doc_id", F.col("entry.a").alias("entry_a"), F.col("entry.b").alias("entry_b"), "s", "size", "chunk",
        F.least(F.lit(CHUNK).cast("long"), F.col("m") - F.col("chunk") * CHUNK).alias("rows"), rate.alias("rate"), h.alias("h"),
        F.pmod(F.xxhash64(F.lit(29), "entry", "chunk"), F.ceil(F.col("n") / BLOCK).cast("long")).alias("block"),
    )
    schema = f"doc_id {kind}, entry_a long, entry_b long, s long, size long, chunk long, rows long, rate double, copies long"
    rounded = dealt.groupBy("s", "block").applyInPandas(_rounded(most), schema)
    each = rounded.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    extra = (F.col("k") < F.col("copies") % F.col("rows")).cast("long")
    out = each.join(plan.select("s", F.col("name").alias("source"), "source_size", "target"), "s")
    return out.select(
        "doc_id", "source", "size", "source_size", "target", "rate", (F.floor(F.col("copies") / F.col("rows")) + extra).cast("int").alias("copies"),
        F.struct(F.col("entry_a").alias("a"), F.col("entry_b").alias("b")).alias("entry"), (F.col("chunk") * CHUNK + F.col("k")).alias("number"),
    )


def _tilted(sized: DataFrame, weights: tuple[float, ...], total: float, most: int) -> DataFrame:
    """name (of the source), s, n, source_size, target, scale, tilt: one row per source."""
    cells = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    squares = F.sum(F.col("n") * F.col("size").cast("double") * F.col("size"))
    sources = cells.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("source_size"), squares.alias("squares"))
    wanted = cut(targets(sources, weights, total, most).withColumn("scale", F.greatest(F.col("squares") / F.greatest("source_size", F.lit(1)), F.lit(1.0))).drop("squares"))
    by_source = F.col("source").eqNullSafe(F.col("name"))
    named = wanted.withColumnRenamed("source", "name")
    weighed = cells.withColumnRenamed("n", "c").join(named, by_source).select("s", (F.col("size") / F.col("scale")).alias("z"), (F.col("c") * F.col("size")).alias("words"))
    tilt = tilts(cut(weighed.filter("words > 0")), wanted, most)
    return named.join(tilt, "s", "left").withColumn("tilt", F.coalesce("tilt", F.lit(0.0)))


def source_mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, rate."""
    return mixed(docs, **options).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", F.round("rate", 6).alias("rate")
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """row, entry, number: the rows of an entry numbered from 0, by way of buckets, so that no task gets all of one."""
    dealt = cut(rows.select("entry", "row", F.pmod(F.xxhash64("row"), F.lit(BUCKETS)).alias("b")))
    before = Window.partitionBy("entry").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
    sums = dealt.groupBy("entry", "b").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("entry", "b").orderBy("row")) - 1
    return dealt.withColumn("i", within).join(sums.drop("c"), ["entry", "b"]).select("row", "entry", (F.col("i") + F.col("before")).alias("number"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST, name: str = "copy") -> DataFrame:
    """The mix itself: every document as often as it has copies, with all its columns and the number of the copy,
    from 1, in the column `name` (or a free name, if docs has that)."""
    row = fresh(docs, "row")
    own = cut(docs.withColumn(row, F.monotonically_increasing_id()))  # written, so the numbers hold
    name = name if name.lower() not in {c.lower() for c in docs.columns} else fresh(docs, name)
    sized = cut(sizes_of(own, row=row))
    plan = _planned(sized.drop("row"), dict(sized.dtypes)["doc_id"], weights, total, most).filter("copies > 0").select("entry", "number", "copies")
    known = sized.groupBy("entry").agg(F.count("*").alias("m"), F.min("row").alias("row"))
    single = known.filter("m = 1").select("row", "entry", F.lit(0).cast("long").alias("number"))
    several = known.filter("m > 1").select("entry")
    numbers = single.union(_numbered(sized.join(several, "entry", "left_semi")))
    taken = numbers.join(plan, ["entry", "number"])
    rid, copies = fresh(own, "rid"), fresh(own, "copies")
    out = own.join(taken.select(F.col("row").alias(rid), F.col("copies").alias(copies)), F.col(row) == F.col(rid))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(copies))).alias(name))


def query(spark, sf_dir: str) -> DataFrame:
    return source_mix(table(spark, sf_dir, "documents"))
