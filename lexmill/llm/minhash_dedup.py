"""MinHash near-duplicates with tensored banding; links are confirmed on whole shingle sets.

Two collections of `m` sub-keys, each of `r` minimum hashes, are computed for every different shingle set.
The key of table (i, j) pairs sub-key i of the first collection with sub-key j of the second: m * m tables
of 2r hashes from only 2m * r hashes. Two sets of similarity s meet in some table with the probability
(1 - (1 - s^r)^m)^2, which at s = 0.8 and the defaults is 0.996. A sub-key that no other set has can't be
part of a shared key, so only the shared ones are multiplied out.

Copies are never compared: documents with equal sets form a class and its smallest id stands for it. Within
a table's bucket classes meet a pivot (a star, linear in the bucket). Classes that the stars tie together are a
family, whatever the pivot is like, so two classes that share a bucket are always in one. Each class is first
compared with the pivot that it meets in most tables, of those that neither lengths nor one-bit sketches rule out
(the sketch by more than six standard deviations). Where a family is still in several components, each class outside the largest one is compared with the whole family, in blocks
of `BLOCK` by `BLOCK` classes, with an inverted index in each, so neither the rows nor a task grow with the
square of a family. Every link is confirmed on the whole sets of words. Components are found by distributed
label propagation with pointer jumping.

Cases: null, empty and wordless texts have an empty set and are linked with nothing; a single word is its own
set; repeated rows are returned one by one and share a component; a null id is never a component's name
unless nothing else is in it; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.batches import parts
from lexmill.llm.common import fresh, pick
from lexmill.session import cut, scratch, table

WORDS = 2
PERCENT = 80
SUBKEYS = 12
HASHES = 4
BLOCK = 1024
#: Estimated similarity, from one bit of each minimum hash, below which a pair is no candidate.
SKETCH_FLOOR = 0.42
SEED = 20_240_607
#: Distinct words whose hashes a worker remembers.
REMEMBERED = 100_000


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split by ASCII white space: bytes.lower() and bytes.split() do exactly that."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles_of(text: str | None, k: int = WORDS) -> set:
    """The whole set, as tuples of words."""
    words = words_of(text)
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(k)], strict=False))


def similar(a: set, b: set, percent: int = PERCENT) -> bool:
    if not a or not b or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(text: str | None, k: int, hashes: _WordHashes) -> np.ndarray:
    """The set as sorted 64-bit hashes."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(k, len(w))
    acc = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i])
    return np.unique(acc)


def _signatures(k: int, m: int, r: int):
    rng = np.random.default_rng(SEED)
    mul = rng.integers(1 << 62, size=2 * m * r, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(1 << 62, size=2 * m * r, dtype=np.uint64)

    def sketch(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """2m sub-keys a row, and one bit of each minimum hash, packed into longs."""
        out = np.zeros((len(sets), 2 * m), np.uint64)
        packed = np.zeros((len(sets), -(-2 * m * r // 64)), np.uint64)
        todo = [i for i, s in enumerate(sets) if len(s)]
        at = 0
        while at < len(todo):  # in blocks that fit the cache
            end, total = at, 0
            while end < len(todo) and (total == 0 or total + len(sets[todo[end]]) <= 32_768):
                total += len(sets[todo[end]])
                end += 1
            rows = todo[at:end]
            block = np.concatenate([sets[i] for i in rows])
            starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in rows])[:-1]])
            keys = np.zeros((len(rows), 2 * m), np.uint64)
            bits = np.zeros((len(rows), packed.shape[1]), np.uint64)
            for t in range(2 * m * r):
                low = np.minimum.reduceat((block * mul[t] + add[t]) >> np.uint64(32), starts)
                bits[:, t // 64] |= (_mix(low) & np.uint64(1)) << np.uint64(t % 64)
                keys[:, t // r] = _mix(keys[:, t // r] * np.uint64(0x9E3779B97F4A7C15) + low + np.uint64(1))
            out[rows], packed[rows] = keys, bits
            at = end
        return out, packed

    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.view(np.int64).reshape(-1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for part in parts(batches, "text"):
            sets = [shingle_hashes(t.as_py(), k, hashes) for t in part.column("text")]
            keys, bits = sketch(sets)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), lists(keys), lists(bits)],
                names=["doc_id", "key", "n_shingles", "cid", "sub", "bits"],
            )

    return run


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, set()
        for part in parts(batches, "text_u", "text_v"):
            good = []
            for u, a, b in zip(part.column("u"), part.column("text_u"), part.column("text_v"), strict=True):
                if u != last:
                    last, left = u, shingles_of(a.as_py(), k)
                good.append(similar(left, shingles_of(b.as_py(), k), percent))
            yield part.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, label: the smallest `ord` that a node reaches over edges (u, v). nodes has node, ord.

    Each round takes the smallest label among the neighbours, then the label's own label (pointer jumping), so
    the number of rounds grows with the logarithm of a component's diameter. Tables of past rounds are deleted."""
    with scratch() as kept:
        return kept(_settled(nodes, edges, max_rounds))


def _settled(nodes: DataFrame, edges: DataFrame, max_rounds: int) -> DataFrame:
    both = cut(edges.select(F.col("u").alias("node"), F.col("v").alias("other")).union(edges.select(F.col("v").alias("node"), F.col("u").alias("other"))).distinct())
    touched = both.select("node").distinct()
    labels = cut(nodes.join(touched, "node", "left_semi").select("node", F.struct("ord", F.col("node").alias("id")).alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("got")), "other").groupBy("node").agg(F.min("got").alias("got"))
        step = labels.join(near, "node").select("node", F.least("label", "got").alias("label"), (F.col("got") < F.col("label")).alias("moved"))
        step = cut(step)
        if not step.agg(F.max("moved")).first()[0]:
            return labels
        up = step.select(F.col("node").alias("id"), F.col("label").alias("above"))
        labels = cut(step.withColumn("id", F.col("label.id")).join(up, "id").select("node", F.least("label", "above").alias("label")))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, subkeys: int = SUBKEYS, hashes: int = HASHES
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    return _classified(docs, words, percent, subkeys, hashes).select("doc_id", "n_shingles", "component_id", "kept")


def _links_between(k: int, percent: int):
    """Links between the open classes of a block and a block of their family, one per open class and component
    of the other side. Shingle hashes find them by an inverted index, whole sets confirm them."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            hashes = _WordHashes()
            sets = [shingle_hashes(t, k, hashes) for t in right["text"]]
            sizes = np.array([len(x) for x in sets])
            every = np.concatenate(sets)
            order = np.argsort(every, kind="stable")
            every, owner = every[order], np.repeat(np.arange(len(sets)), sizes)[order]
            homes, ids, texts = list(right["home"]), list(right["c"]), list(right["text"])
            for c, home, text in zip(left["c"], left["home"], left["text"], strict=True):
                own = shingle_hashes(text, k, hashes)
                lo, hi = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
                width = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
                both = np.bincount(owner[at], minlength=len(sets))
                likely = np.flatnonzero(100 * both >= percent * (len(own) + sizes - both))
                mine, seen = None, {home}
                for j in likely:
                    if homes[j] in seen:
                        continue
                    mine = shingles_of(text, k) if mine is None else mine
                    if similar(mine, shingles_of(texts[j], k), percent):
                        seen.add(homes[j])
                        found.append((c, ids[j]))
        return pd.DataFrame(found, columns=["u", "v"])

    return run


def _sketch_agrees(a: str, b: str, bits: int, floor: float) -> Column:
    """Whether two arrays of longs agree in as many bits as the similarity `floor` would make them."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    return apart <= bits * (1 - floor) / 2


def _classified(docs: DataFrame, words: int, percent: int, subkeys: int, hashes: int) -> DataFrame:
    docs = pick(docs, doc_id="doc_id", text="text")
    kind = dict(docs.dtypes)["doc_id"]
    keyed = docs.withColumn("key", F.xxhash64("text"))
    sketched = cut(keyed.mapInArrow(_signatures(words, subkeys, hashes), f"doc_id {kind}, key long, n_shingles long, cid binary, sub array<long>, bits array<long>"))
    classes = cut(
        sketched.filter(F.col("cid").isNotNull())
        .groupBy("cid")
        .agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.first("sub").alias("sub"), F.first("bits").alias("bits"))
    )
    # a class goes by its smallest id, or by the hash of its set if an id is null or has several sets
    plain = not classes.groupBy("rep").agg(F.count("*").alias("c")).filter("c > 1 or rep is null").limit(1).count()
    classes = classes.withColumn("c", F.col("rep" if plain else "cid"))
    c_kind = dict(classes.dtypes)["c"]

    # sub-keys that at least two classes have, multiplied out to table keys
    single = classes.select("c", F.posexplode("sub").alias("i", "key"))
    shared = single.groupBy("i", "key").agg(F.count("*").alias("k")).filter("k > 1").select("i", "key")
    halves = single.join(shared, ["i", "key"], "left_semi").groupBy("c").agg(F.collect_list(F.struct("i", "key")).alias("s"))
    halves = halves.select("c", F.filter("s", lambda x: x["i"] < subkeys).alias("a"), F.filter("s", lambda x: x["i"] >= subkeys).alias("b"))
    halves = halves.select("c", F.explode("a").alias("a"), "b")
    tables = cut(halves.select("c", F.explode(F.transform("b", lambda x: F.xxhash64(F.col("a.i"), F.col("a.key"), x["i"], x["key"]))).alias("key")))
    pivots = tables.groupBy("key").agg(F.min("c").alias("u"), F.max("c").alias("last")).filter("u < last").select("key", "u")
    met = tables.join(pivots, "key").filter("c <> u").groupBy("u", F.col("c").alias("v")).agg(F.count("*").alias("met"))
    side = lambda x: classes.select(F.col("c").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    near_size = 100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")
    stars = cut(
        met.join(side("v"), "v").join(side("u"), "u")
        .select("u", "v", "met", (near_size & _sketch_agrees("bits_u", "bits_v", 2 * subkeys * hashes, SKETCH_FLOOR)).alias("likely"))
    )

    # texts of the classes that meet another one, read once for all comparisons. The hints keep these joins the same at
    # every size: all their sides grow with the corpus
    active = stars.select("u").union(stars.select("v")).distinct().select(F.col("u").alias("c"))
    if plain:
        texts = docs.withColumnRenamed("doc_id", "c").join(active.hint("merge"), "c", "left_semi").filter(F.col("text").isNotNull())
        twice = sketched.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").limit(1).count()
        texts = cut(texts.dropDuplicates(["c"]) if twice else texts)
    else:

        def own_class(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Only rows whose text has the class' set: an id can have other texts too."""
            own = _WordHashes()
            for batch in batches:
                keep = [xxhash.xxh3_128_digest(shingle_hashes(t, words, own).tobytes()) == bytes(c) for t, c in zip(batch["text"], batch["c"], strict=True)]
                yield batch.loc[np.array(keep, bool), ["c", "text"]]

        wanted = classes.join(active, "c", "left_semi").select("c", "rep")
        texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).select("c", "text")
        texts = cut(texts.mapInPandas(own_class, f"c {c_kind}, text string").dropDuplicates(["c"]))

    nodes = classes.select(F.col("c").alias("node"), F.struct(F.col("rep").isNull().alias("none"), "rep").alias("ord"))
    first = stars.filter("likely").groupBy("v").agg(F.max_by("u", F.struct("met", "u")).alias("u"))
    joined = first.hint("merge").join(texts.select(F.col("c").alias("v"), F.col("text").alias("text_v")), "v")
    joined = joined.hint("merge").join(texts.select(F.col("c").alias("u"), F.col("text").alias("text_u")), "u")
    links = cut(joined.select("u", "v", "text_u", "text_v").mapInArrow(_confirm(words, percent), f"u {c_kind}, v {c_kind}"))
    labels = components(nodes, links)

    # families that are still in several components
    home = labels.select(F.col("node").alias("c"), F.col("label.id").alias("home"))
    member = components(nodes, stars.select("u", "v")).select(F.col("node").alias("c"), F.col("label.id").alias("family"))
    member = cut(member.join(home, "c", "left").select("family", "c", F.coalesce("home", "c").alias("home")))
    parts = member.groupBy("family", "home").agg(F.count("*").alias("k"))
    mixed = parts.groupBy("family").agg(F.max_by("home", F.struct("k", "home")).alias("main"), F.sum("k").alias("n"), F.max("k").alias("most"), F.count("*").alias("parts"))
    mixed = cut(mixed.filter("parts > 1").select("family", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("opens")))
    if not mixed.isEmpty():
        placed = member.join(mixed, "family").join(texts, "c")
        block = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "c"), F.col(n).cast("long")).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        open_side = placed.filter("home <> main").select("family", "c", "home", "text", block("opens", 5).alias("x"), every("blocks").alias("y"))
        all_side = placed.select("family", "c", "home", "text", every("opens").alias("x"), block("blocks", 7).alias("y"))
        pairs = open_side.groupBy("family", "x", "y").cogroup(all_side.toDF("f2", "c", "home", "text", "x2", "y2").groupBy("f2", "x2", "y2"))
        more = cut(pairs.applyInPandas(_links_between(words, percent), f"u {c_kind}, v {c_kind}"))
        if not more.isEmpty():
            labels = components(nodes, links.union(more))

    found = labels.select(F.col("node").alias("c"), F.col("label.ord.rep").alias("low"), F.col("label.id").alias("group"))
    named = classes.select("cid", "rep", "c").join(found, "c", "left")
    named = named.select(F.col("cid").alias("c2"), F.coalesce("low", "rep").alias("component_id"), F.coalesce("group", "c").alias("group"))
    out = sketched.select("doc_id", "key", "n_shingles", "cid").join(named, F.col("cid") == F.col("c2"), "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id", "key", "n_shingles", "component_id", "group",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"),
    )


def keep_one_of_each(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, subkeys: int = SUBKEYS, hashes: int = HASHES
) -> DataFrame:
    """The documents with all their columns, one of each component: the one with the smallest id, of rows with
    the same id the one with the smallest hash. Documents without words all stay."""
    with scratch() as kept:
        found = kept(_classified(docs, words, percent, subkeys, hashes).select("doc_id", "key", "group"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    chosen = found.filter(F.col("group").isNotNull()).groupBy("group").agg(F.min(order).alias("o"))
    key, own_id, own_key = fresh(docs, "text_key"), fresh(docs, "own_id"), fresh(docs, "own_key")
    stay = chosen.select(F.col("o.doc_id").alias(own_id), F.col("o.key").alias(own_key))
    stay = stay.union(found.filter(F.col("group").isNull()).select("doc_id", "key").distinct())
    rows = docs.withColumn(key, F.xxhash64("text")).join(stay, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_key)), "left_semi")
    twice = found.filter(F.col("group").isNotNull()).groupBy("doc_id", "key").agg(F.count("*").alias("k")).filter("k > 1").limit(1).count()
    if twice:  # repeated rows
        rows = rows.dropDuplicates(["doc_id", key])
    return rows.drop(key)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, w[i:i + 1] AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
keyed AS (SELECT doc_id, hash(k) AS h, k FROM s),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c
  FROM keyed a JOIN keyed b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT u, v FROM pairs JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v
  WHERE 100 * c >= 80 * (nu.n + nv.n - c)),
e AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, e.v FROM reach JOIN e ON e.u = reach.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id, n
"""
