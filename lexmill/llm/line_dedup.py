"""Line deduplication by a log-template tree, DataFrame functions only.

A line's tokens are what white space separates; tokens with a digit become `<*>`. The tree has a fixed depth: the
number of tokens, the first `DEPTH` tokens, and `SPLITS` levels more for leaves that hold several templates. In a
node that holds different lines, the token that at least half of them (and two) share is constant at its
position, and the other positions are variable fields; a line whose constants make up `SIMILAR` percent of its
tokens belongs to the node's template. Of the other lines, those that share so many tokens with some line of the
rest go on to the next level, each below the most common of its tokens that no more than half of the rest share
(the most leading of such), so what else stands in a leaf doesn't hide a template. Any line left is a
template of its own. A template that `min_docs` documents have (two, if it is of `LONG` words or more) recurs:
its first line, by document and position, stays, and all its others are dropped.

Lines travel as hashes; only leaves with several different lines have their tokens compared, each different
line once. Counts are pre-aggregated, so a line that a third of the documents share is no heavy group.

With `spare` (a similarity) a document keeps the first of its lines of a template whose first line stands in a near
copy of it, so that copies stay whole for a later comparison of whole documents. Whether two documents that share
lines are near copies is estimated from the `SKETCH` smallest hashes of their shingles.

Cases: null texts have no lines and stay null; lines of fewer than `MIN_WORDS` words are never dropped; a text
all of whose lines are dropped becomes empty; rows that share id and text lose the same lines; an empty table
gives an empty result; other columns, whatever their names, are kept by drop_recurring() and not read otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import SPACE_RUN, ascii_lower, fresh, pick, space_words
from lexmill.session import cut, scratch, table

DEPTH = 3
SPLITS = 2
MIN_WORDS = 4
#: Lines shorter than this are only compared whole.
MIN_TREE_WORDS = 6
#: Percent of a line's tokens.
SIMILAR = 70
MIN_DOCS = 3
LONG = 50
#: Leaves, as longs: about 40 MB.
BROADCAST_ROWS = 1_000_000
#: Hashes of a document's sketch, and the words of a shingle in it.
SKETCH = 128
SHINGLE = 2


def _spaced(line: Column) -> Column:
    """Single spaces between tokens, none at the ends. Most lines are so already, which plain searches tell."""
    odd = line.startswith(" ") | line.endswith(" ") | line.contains("  ")
    for c in "\t\x0b\x0c\r":
        odd = odd | line.contains(c)
    return F.when(odd, F.regexp_replace(F.regexp_replace(line, SPACE_RUN, " "), "^ | $", "")).otherwise(line)


def _masked(line: Column) -> Column:
    """Tokens with a digit become <*>. The look-behind tries a token once, not at each of its characters."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "(?<![^ ])[^ 0-9]*[0-9][^ ]*", "<*>")).otherwise(line)


def _lines(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, key, pos, n, leaf, th (and line, masked): lines of enough words. Steps are nested transforms, each of
    which computes its part once per line; the outer form of explode keeps the optimizer from inferring a filter that
    would compute them all again."""
    found = F.transform(F.transform(F.split("text", "\n", -1), _spaced), _masked)
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    sized = F.transform(found, lambda x, i: F.struct(i.alias("pos"), F.when(x == "", 0).otherwise(spaces(x) + 1).alias("n"), x.alias("line")))
    long = F.filter(sized, lambda s: s["n"] >= MIN_WORDS)
    fields = lambda s: [
        s["pos"].alias("pos"), s["n"].alias("n"), F.xxhash64(s["n"], F.substring_index(s["line"], " ", DEPTH)).alias("leaf"),
        F.xxhash64(s["line"]).alias("th"), *([s["line"].alias("line")] if texts else []),
    ]
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.explode_outer(F.transform(long, lambda s: F.struct(*fields(s)))).alias("l"))
    return rows.select("doc_id", "key", "l.*").filter(F.col("n").isNotNull())


def _shared(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, at, token, c): tokens that several lines of a node have at a position; (node, total): lines of a node."""
    counts = tokens.groupBy("node", "at", "token").agg(F.count("*").alias("c")).filter("c >= 2")
    return counts, tokens.filter("at = 0").groupBy("node").agg(F.count("*").alias("total"))


def _fitting(tokens: DataFrame) -> DataFrame:
    """node, th: the lines that belong to the template of their node."""
    counts, total = _shared(tokens)
    constant = (
        counts.groupBy("node", "at")
        .agg(F.max(F.struct("c", "token")).alias("top"))
        .join(total, "node")
        .filter(2 * F.col("top.c") >= F.col("total"))
        .select("node", "at", F.col("top.token").alias("token"))
    )
    same = tokens.join(constant, ["node", "at", "token"], "left_semi").groupBy("node", "th", "n").agg(F.count("*").alias("same"))
    return same.filter(100 * F.col("same") >= SIMILAR * F.col("n")).select("node", "th")


def _next_level(tokens: DataFrame, members: DataFrame, level: int) -> DataFrame:
    """The tokens of the lines that are no members and share enough with another, each below a node of its own."""
    rest = cut(tokens.join(members, ["node", "th"], "left_anti"))
    counts, total = _shared(rest)
    # no more than half of the rest: the others can't tell templates apart
    telling = F.when(2 * F.col("c") <= F.col("total"), F.struct(F.col("c"), (-F.col("at")).alias("before"), F.col("token")))
    lines = (
        rest.join(counts.join(total, "node"), ["node", "at", "token"])
        .groupBy("node", "th", "n")
        .agg(F.count("*").alias("same"), F.max(telling).alias("best"))
        .filter(100 * F.col("same") >= SIMILAR * F.col("n"))
        .select("node", "th", F.xxhash64(F.lit(level), "node", "best.before", "best.token").alias("below"))
    )
    return cut(rest.join(lines, ["node", "th"]).select(F.col("below").alias("node"), "leaf", "th", "n", "at", "token"))


def _leaf_members(docs: DataFrame, lines: DataFrame, broadcast_rows: int) -> DataFrame:
    """leaf, th, template: the lines that belong to a template with others."""
    leaves = (
        lines.filter(F.col("n") >= MIN_TREE_WORDS)
        .groupBy("leaf")
        .agg(F.min("th").alias("lo"), F.max("th").alias("hi"), F.count("*").alias("c"))
        .filter("lo < hi and c >= 3")
        .select("leaf")
    )
    leaves = cut(leaves)
    if leaves.count() <= broadcast_rows:
        leaves = F.broadcast(leaves)
    texts = _lines(docs, texts=True).filter(F.col("n") >= MIN_TREE_WORDS).join(leaves, "leaf", "left_semi")
    texts = texts.groupBy("leaf", "th").agg(F.first("line").alias("line"), F.first("n").alias("n"))
    tokens = cut(texts.select(F.col("leaf").alias("node"), "leaf", "th", "n", F.posexplode_outer(F.split("line", " ", -1)).alias("at", "token")))
    found = []
    for level in range(SPLITS + 1):
        members = cut(_fitting(tokens))
        own = tokens.filter("at = 0").select("node", "leaf", "th")
        found.append(members.join(own, ["node", "th"]).select("leaf", "th", F.xxhash64(F.lit(level), "node").alias("template")))
        if level < SPLITS:
            tokens = _next_level(tokens, members, level)
    return reduce(DataFrame.unionAll, found)


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key, sketch: the smallest of the hashes (halves of them) of a document's shingles."""
    words = docs.select("doc_id", "key", space_words(ascii_lower(F.col("text"))).alias("w"))
    last = F.greatest(F.size("w") - SHINGLE, F.lit(0))
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.shiftright(F.xxhash64(*[F.get(F.col("w"), i + j) for j in range(SHINGLE)]), 32).cast("int"))
    return words.select("doc_id", "key", F.slice(F.sort_array(F.array_distinct(hashes)), 1, SKETCH).alias("sketch"))


def _near_copies(docs: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (doc_id, key, of_id, of_key) whose texts' estimated similarity is enough. A document that keeps
    lines for very many others is a heavy key of the last join, both sides of which are tables that Spark can split."""
    theirs = pairs.select(F.col("of_id").alias("doc_id"), F.col("of_key").alias("key"))
    wanted = pairs.select("doc_id", "key").union(theirs).distinct().toDF("d", "k")
    on = lambda a, x, b, y: F.col(a).eqNullSafe(F.col(b)) & (F.col(x) == F.col(y))
    keyed = docs.withColumn("key", F.xxhash64("text"))
    # sketches are made in the scan and are what is shuffled, as texts are much larger; equal rows have equal ones
    sketches = _sketches(keyed).join(wanted, on("doc_id", "key", "d", "k"), "left_semi").groupBy("doc_id", "key").agg(F.first("sketch").alias("sketch"))
    sketches = cut(sketches)
    left = cut(pairs.join(sketches.toDF("d", "k", "mine"), on("doc_id", "key", "d", "k")).drop("d", "k"))
    both = left.join(sketches.toDF("d", "k", "other"), on("of_id", "of_key", "d", "k"))
    low = F.slice(F.sort_array(F.array_union("mine", "other")), 1, SKETCH)
    common = F.size(F.array_intersect(F.array_intersect(low, F.col("mine")), F.col("other")))
    return both.filter(common >= similarity * F.size(low)).select("doc_id", "key", "of_id", "of_key")


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, broadcast_rows: int = BROADCAST_ROWS, spare: float | None = None) -> DataFrame:
    """doc_id, key, drop (array of line positions): the documents that lose lines."""
    docs = pick(docs, doc_id="doc_id", text="text")
    lines = cut(_lines(docs).distinct())
    members = cut(_leaf_members(docs, lines, broadcast_rows))
    tree = F.struct(F.lit(1).alias("kind"), F.col("template").alias("id"))
    own = F.struct(F.lit(0).alias("kind"), F.col("th").alias("id"))
    placed = lines.join(members, ["leaf", "th"], "left").select("doc_id", "key", "pos", "n", F.when(F.col("template").isNotNull(), tree).otherwise(own).alias("g"))
    placed = cut(placed)
    where = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "pos")
    recurring = (
        placed.groupBy("g", "doc_id", "key")
        .agg(F.min("pos").alias("pos"), F.max("n").alias("n"))
        .groupBy("g")
        .agg(F.count("*").alias("docs"), F.max("n").alias("n"), F.min(where).alias("first"))
        .filter((F.col("docs") >= min_docs) | ((F.col("n") >= LONG) & (F.col("docs") >= 2)))
        .select("g", "first")
    )
    # cut, so that both sides of the join are dealt alike and a template with very many lines can be split
    gone = placed.join(cut(recurring), "g").filter(~where.eqNullSafe(F.col("first")))
    if spare is not None:
        gone = _spared(docs, gone, spare)
    return gone.groupBy("doc_id", "key").agg(F.collect_list("pos").alias("drop"))


def _spared(docs: DataFrame, gone: DataFrame, similarity: float) -> DataFrame:
    """gone without the first line of each template that a document shares with a near copy which keeps it."""
    gone = cut(
        gone.select("doc_id", "key", "pos", "g", F.col("first.doc_id").alias("of_id"), F.col("first.key").alias("of_key"))
        .withColumn("self", F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key")))
    )
    others = gone.filter("not self")
    near = cut(_near_copies(docs, others.select("doc_id", "key", "of_id", "of_key").distinct(), similarity)).toDF("d", "k", "d2", "k2")
    match = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")) & F.col("of_id").eqNullSafe(F.col("d2")) & (F.col("of_key") == F.col("k2"))
    kept = others.join(near, match, "left_semi").groupBy("doc_id", "key", "g").agg(F.min("pos").alias("pos")).select("doc_id", "key", "pos")
    kept = kept.toDF("d", "k", "p")
    stays = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")) & (F.col("pos") == F.col("p"))
    return gone.join(kept, stays, "left_anti")


def deduplicated(docs: DataFrame, **options) -> tuple[DataFrame, str]:
    """docs with its text column without the dropped lines, and the name of an added column with their number."""
    lid, lkey, drop, parts, name = (fresh(docs, stem) for stem in ("lid", "lkey", "ldrop", "lparts", "dropped"))
    with scratch() as kept:
        drops = kept(dropped_lines(docs, **options)).toDF(lid, lkey, drop)
    joined = docs.join(drops, F.col("doc_id").eqNullSafe(F.col(lid)) & (F.xxhash64("text") == F.col(lkey)), "left")
    # the lines are a column of their own, so that the lambda below doesn't split the text for each of them
    joined = joined.withColumn(parts, F.when(F.col(drop).isNotNull(), F.split("text", "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(drop))
    rest = F.array_join(F.transform(stay, lambda i: F.get(F.col(parts), i)), "\n")
    text = F.when(F.col(parts).isNull(), F.col("text")).otherwise(rest)
    columns = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, F.coalesce(F.size(drop), F.lit(0)).cast("long").alias(name)), name


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text (without the dropped lines), n_lines, n_dropped: one row per document."""
    own = pick(docs, doc_id="doc_id", text="text")
    lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long")
    found, name = deduplicated(own.withColumn("n_lines", lines), **options)
    return found.select("doc_id", "text", "n_lines", F.col(name).alias("n_dropped"))


def drop_recurring(docs: DataFrame, **options) -> DataFrame:
    """The documents with all their columns and without recurring lines. A document that loses all its words is
    a copy of what stays elsewhere and goes."""
    found, name = deduplicated(docs, **options)
    return found.filter((F.col(name) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop(name)


def query(spark, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def _sql_level(k: int) -> str:
    """One level of the tree over tk{k} (node, leaf, line, n, px, token): its members and the next level's tokens."""
    return rf"""
tot{k} AS (SELECT node, count(*) AS total FROM tk{k} WHERE px = 1 GROUP BY node),
fr{k} AS (SELECT node, px, token, count(*) AS c FROM tk{k} GROUP BY ALL HAVING count(*) >= 2),
top{k} AS (SELECT node, px, token, c FROM fr{k} QUALIFY row_number() OVER (PARTITION BY node, px ORDER BY c DESC, token DESC) = 1),
cs{k} AS (SELECT node, px, token FROM top{k} JOIN tot{k} USING (node) WHERE 2 * c >= total),
mem{k} AS (SELECT node, leaf, line FROM tk{k} JOIN cs{k} USING (node, px, token) GROUP BY node, leaf, line, n HAVING 100 * count(*) >= 70 * n),
re{k} AS (SELECT * FROM tk{k} ANTI JOIN mem{k} USING (node, line)),
rt{k} AS (SELECT node, count(*) AS total FROM re{k} WHERE px = 1 GROUP BY node),
rf{k} AS (SELECT node, px, token, count(*) AS c FROM re{k} GROUP BY ALL HAVING count(*) >= 2),
rs{k} AS (SELECT node, line, n, px, token, c, total FROM re{k} JOIN rf{k} USING (node, px, token) JOIN rt{k} USING (node)),
en{k} AS (SELECT node, line FROM rs{k} GROUP BY node, line, n HAVING 100 * count(*) >= 70 * n),
be{k} AS (SELECT node, line, px, token FROM rs{k} WHERE 2 * c <= total QUALIFY row_number() OVER (PARTITION BY node, line ORDER BY c DESC, px) = 1),
tk{k + 1} AS (
  SELECT node || '|' || coalesce(be{k}.px::VARCHAR || ':' || be{k}.token, '') || '|{k}' AS node, leaf, line, n, re{k}.px, re{k}.token
  FROM re{k} SEMI JOIN en{k} USING (node, line) LEFT JOIN be{k} USING (node, line)),"""


SQL = (
    r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
raw AS (SELECT r, doc_id, md5(text) AS key, ls[i] AS l, i - 1 AS pos FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
m AS (
  SELECT r, doc_id, key, pos,
         regexp_replace(regexp_replace(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'), '^ | $', '', 'g'), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS line
  FROM raw),
ln AS (
  SELECT *, string_split(line, ' ') AS t, len(string_split(line, ' ')) AS n FROM m WHERE line <> ''),
l4 AS (SELECT *, n::VARCHAR || '|' || array_to_string(t[1:3], ' ') AS leaf FROM ln WHERE n >= 4),
leaves AS (SELECT leaf FROM (SELECT DISTINCT doc_id, key, pos, leaf, line FROM l4 WHERE n >= 6) GROUP BY leaf HAVING min(line) < max(line) AND count(*) >= 3),
tx AS (SELECT DISTINCT leaf, line, t, n FROM l4 JOIN leaves USING (leaf) WHERE n >= 6),
tk0 AS (SELECT leaf AS node, leaf, line, n, px, t[px] AS token FROM (SELECT *, unnest(range(1, n + 1)) AS px FROM tx)),"""
    + "".join(_sql_level(k) for k in range(SPLITS + 1))
    + "\nmem AS ("
    + " UNION ALL ".join(f"SELECT leaf, line, '{k}|' || node AS template FROM mem{k}" for k in range(SPLITS + 1))
    + r"""),
pl AS (
  SELECT DISTINCT l4.doc_id, l4.key, l4.pos, l4.n, CASE WHEN mem.leaf IS NOT NULL THEN 'L' || mem.template ELSE 'T' || l4.line END AS g
  FROM l4 LEFT JOIN mem ON mem.leaf = l4.leaf AND mem.line = l4.line),
st AS (SELECT g, count(DISTINCT (doc_id, key)) AS docs, max(n) AS n FROM pl GROUP BY g),
rec AS (SELECT g FROM st WHERE docs >= 3 OR (n >= 50 AND docs >= 2)),
rk AS (SELECT pl.*, row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) AS rn FROM pl JOIN rec USING (g)),
dr AS (SELECT DISTINCT doc_id, key, pos FROM rk WHERE rn > 1),
kept AS (
  SELECT raw.r, count(*) AS n_lines, count(dr.pos) AS n_dropped,
         string_agg(raw.l, chr(10) ORDER BY raw.pos) FILTER (WHERE dr.pos IS NULL) AS text
  FROM raw LEFT JOIN dr ON dr.doc_id = raw.doc_id AND dr.key = raw.key AND dr.pos = raw.pos GROUP BY raw.r)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(kept.text, '')) END AS text_sha256
FROM d LEFT JOIN kept USING (r)
"""
)
