"""Queries of joins, look-ups, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import corpus, graph, lookup, merge, rank, retrieve, similarity, votes
from lexmill.plans import sql as Q
from lexmill.plans.function_queries import SQL_NAMES, SQL_TURNS, SUFFIXES, _turns, names
from lexmill.plans.registry import query
from lexmill.session import table
from lexmill.sources.readers import pick_by_order

Session = SparkSession


def store(spark: Session, sf: str) -> DataFrame:
    """form, meaning: a small lexicon made of the words of part names; the smallest part that has a word is its meaning."""
    words = table(spark, sf, "part").select("p_partkey", F.explode(T.words(F.col("p_name"))).alias("form"))
    return words.groupBy("form").agg(F.concat(F.lit("part_"), F.min("p_partkey").cast("string")).alias("meaning"))


SQL_STORE = f"(SELECT form, 'part_' || min(p_partkey)::VARCHAR AS meaning FROM (SELECT p_partkey, unnest({Q.words('p_name')}) AS form FROM part) GROUP BY form)"


def misspelt(spark: Session, sf: str) -> DataFrame:
    """token: the words of part names with an ending."""
    return names(spark, sf).select(F.concat("form", F.lit("ing")).alias("token"))


SQL_MISSPELT = f"(SELECT form || 'ing' AS token FROM {SQL_NAMES})"


@query("equi_join_words", "SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def equi_join_words(spark: Session, sf: str) -> DataFrame:
    """The strategy is left to the optimizer."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


@query("lookup_cascade_scores", f"""
SELECT token, coalesce(a.meaning, b.meaning) AS meaning, CASE WHEN a.meaning IS NOT NULL THEN 'exact' WHEN b.meaning IS NOT NULL THEN 'stem' ELSE 'missing' END AS stage,
       CASE WHEN a.meaning IS NOT NULL THEN 1.0 WHEN b.meaning IS NOT NULL THEN 0.86 ELSE 0.0 END::DOUBLE AS score
FROM (SELECT token FROM {SQL_MISSPELT} UNION SELECT form FROM {SQL_NAMES}) t LEFT JOIN {SQL_STORE} a ON a.form = token LEFT JOIN {SQL_STORE} b ON b.form = regexp_replace(token, 'ing$', '')""")
def lookup_cascade_scores(spark: Session, sf: str) -> DataFrame:
    """Layers in order, the first that has the token wins."""
    toks = misspelt(spark, sf).union(names(spark, sf)).distinct()
    s = store(spark, sf)
    return lookup.cascade(toks, [("exact", s, F.col("token"), 1.0), ("stem", s, F.regexp_replace("token", "ing$", ""), 0.86)])


SQL_BINDINGS = (
    "(SELECT lower(p_type) AS sense, CASE right(p_brand, 1) WHEN '1' THEN 'de' WHEN '2' THEN 'en' WHEN '3' THEN 'la' ELSE 'fr' END AS lang, p_name AS form, p_partkey AS ord FROM part)"
)


def bindings(spark: Session, sf: str) -> DataFrame:
    """sense, lang, form, ord: every part binds its name, in the language of its brand, to its type."""
    last = F.right("p_brand", F.lit(1))
    lang = F.when(last == "1", "de").when(last == "2", "en").when(last == "3", "la").otherwise("fr")
    return table(spark, sf, "part").select(F.lower("p_type").alias("sense"), lang.alias("lang"), F.col("p_name").alias("form"), F.col("p_partkey").alias("ord"))


#: Forms in their own languages, in one that has none, and forms that nothing binds.
SQL_ASKED = f"(SELECT DISTINCT lang, form FROM {SQL_BINDINGS} UNION SELECT DISTINCT 'grc', p_name FROM part UNION SELECT DISTINCT 'de', p_brand FROM part)"


def asked(spark: Session, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    own = bindings(spark, sf).select("lang", "form")
    return own.union(p.select(F.lit("grc"), "p_name")).union(p.select(F.lit("de"), "p_brand")).distinct()


@query("sense_lookup", f"""
SELECT a.lang, a.form, coalesce(e.sense, g.sense) AS sense, CASE WHEN e.sense IS NOT NULL THEN 1.0 WHEN g.sense IS NOT NULL THEN 0.95 ELSE 0.0 END::DOUBLE AS confidence
FROM {SQL_ASKED} a LEFT JOIN (SELECT lang, form, arg_min(sense, ord) AS sense FROM {SQL_BINDINGS} GROUP BY lang, form) e ON e.lang = a.lang AND e.form = a.form
LEFT JOIN (SELECT form, arg_min(sense, ord) AS sense FROM {SQL_BINDINGS} GROUP BY form) g ON g.form = a.form""")
def sense_lookup(spark: Session, sf: str) -> DataFrame:
    """J3."""
    return lookup.sense_of(asked(spark, sf), bindings(spark, sf))


@query("sense_render", f"SELECT sense, arg_min(form, (CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, ord)) AS form, arg_min(lang, (CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, ord)) AS lang FROM {SQL_BINDINGS} GROUP BY sense")
def sense_render(spark: Session, sf: str) -> DataFrame:
    """J4."""
    b = bindings(spark, sf)
    return lookup.render(b.select("sense").distinct(), b, "de")


@query("multi_key_probe", f"SELECT token, 'en|' || token AS _k, meaning AS gloss, length(meaning)::DOUBLE AS score FROM (SELECT token FROM {SQL_MISSPELT} UNION SELECT form FROM {SQL_NAMES}) LEFT JOIN {SQL_STORE} ON form = token".replace("'en|' || token AS _k, ", ""))
def multi_key_probe(spark: Session, sf: str) -> DataFrame:
    """Several keys of a token, the best score wins."""
    toks = misspelt(spark, sf).union(names(spark, sf)).distinct()
    glosses = store(spark, sf).withColumnRenamed("meaning", "gloss")
    return lookup.probe_keys(toks, glosses, ["en", "la"], F.length("gloss").cast("double"))


@query("edit_neighbours", f"""
SELECT a, b, distance::INT AS distance FROM (SELECT a.token AS a, b.form AS b, levenshtein(a.token, b.form) AS distance, row_number() OVER (PARTITION BY a.token ORDER BY levenshtein(a.token, b.form), b.form) AS r
  FROM (SELECT DISTINCT left(form, length(form) - 1) || 'x' AS token FROM {SQL_NAMES}) a JOIN {SQL_NAMES} b ON left(a.token, 3) = left(b.form, 3)
  WHERE length(a.token) >= 4 AND length(b.form) >= 4 AND abs(length(a.token) - length(b.form)) <= CASE WHEN length(a.token) < 7 THEN 2 ELSE 3 END
    AND levenshtein(a.token, b.form) BETWEEN 1 AND CASE WHEN length(a.token) < 7 THEN 1 ELSE 2 END) WHERE r = 1""")
def edit_neighbours(spark: Session, sf: str) -> DataFrame:
    """J7."""
    n = names(spark, sf)
    wrong = n.select(F.concat(F.substr("form", F.lit(1), F.length("form") - 1), F.lit("x")).alias("a"))
    return similarity.edit_neighbours(wrong, n.select(F.col("form").alias("b")))


@query("stem_equality_join", f"""
SELECT DISTINCT a.form AS a, b.form AS b FROM (SELECT form, left(form, length(form) - length(suffix)) AS stem FROM {SQL_NAMES}, {Q.values([(s,) for s in SUFFIXES], 'suffix')} WHERE ends_with(form, suffix) AND length(form) - length(suffix) >= 3) a
JOIN (SELECT form, left(form, length(form) - length(suffix)) AS stem FROM {SQL_NAMES}, {Q.values([(s,) for s in SUFFIXES], 'suffix')} WHERE ends_with(form, suffix) AND length(form) - length(suffix) >= 3) b ON a.stem = b.stem AND a.form < b.form
WHERE {Q.edit_similarity('a.form', 'b.form')} >= 0.48""")
def stem_equality_join(spark: Session, sf: str) -> DataFrame:
    """Forms that share a stem and are similar as a whole."""
    stems = names(spark, sf).select("form", F.explode(T.strip_suffixes(F.col("form"), SUFFIXES)).alias("stem"))
    a, b = stems.withColumnRenamed("form", "a"), stems.withColumnRenamed("form", "b")
    return a.join(b, "stem").filter("a < b").select("a", "b").distinct().filter(T.edit_similarity(F.col("a"), F.col("b")) >= 0.48)


@query("longest_stem_probe", f"""
SELECT token, meaning, candidate FROM {SQL_MISSPELT} t LEFT JOIN (
  SELECT token AS tk, arg_max(meaning, (length(candidate), candidate)) AS meaning, arg_max(candidate, (length(candidate), candidate)) AS candidate FROM (
    SELECT token, stem || e AS candidate FROM (SELECT token, left(token, unnest(range(greatest(3, length(token) - 9), length(token) + 1))) AS stem FROM {SQL_MISSPELT} WHERE length(token) > 3) , {Q.values([('',), ('e',), ('s',)], 'e')})
  JOIN {SQL_STORE} ON form = candidate GROUP BY token) ON tk = token""")
def longest_stem_probe(spark: Session, sf: str) -> DataFrame:
    """Candidate stems and reattached endings; the longest key that the store has wins."""
    return lookup.longest_stem(misspelt(spark, sf), store(spark, sf), T.truncations(F.col("token")), ["e", "s"])


@query("ordered_strip_cascade", f"""
SELECT token, meaning, form FROM {SQL_MISSPELT} LEFT JOIN (
  SELECT token AS tk, arg_min(meaning, (rule, ending)) AS meaning, arg_min(form, (rule, ending)) AS form FROM (
    SELECT token, rule, ending, left(token, length(token) - length(suffix)) || e AS cand FROM {SQL_MISSPELT}, {Q.values([(0, 'ing'), (1, 'ng'), (2, 'g')], 'rule, suffix')}, (SELECT * FROM {Q.values([(0, ''), (1, 'e'), (2, 'i')], 'ending, e').replace(' t(', ' u(')})
    WHERE ends_with(token, suffix) AND length(token) - length(suffix) >= 3) JOIN {SQL_STORE} ON form = cand GROUP BY token) ON tk = token""")
def ordered_strip_cascade(spark: Session, sf: str) -> DataFrame:
    """The first hit over ordered suffixes and endings."""
    return lookup.first_hit(misspelt(spark, sf), store(spark, sf), ["ing", "ng", "g"], ["", "e", "i"])


@query("prefix_peel_join", f"SELECT token, form AS residual FROM (SELECT p || form AS token, p, form FROM {SQL_NAMES}, {Q.values([('re',), ('over',)], 'p')} WHERE length(form) >= 3)")
def prefix_peel_join(spark: Session, sf: str) -> DataFrame:
    """A known prefix off; the residual must be a word."""
    n = names(spark, sf).filter(F.length("form") >= 3)
    prefixes = ["over", "re"]
    toks = n.select(F.explode(F.array(*[F.concat(F.lit(p), "form") for p in prefixes])).alias("token"), "form")
    peels = [F.when(F.col("token").startswith(p) & (F.length("token") - len(p) >= 3), F.substr("token", F.lit(len(p) + 1))) for p in prefixes]
    tried = toks.select("token", F.col("form").alias("made_of"), F.explode(F.array_compact(F.array(*peels))).alias("residual"))
    return tried.join(names(spark, sf), F.col("residual") == F.col("form"), "left_semi").filter("residual = made_of").select("token", "residual")


@query("parallel_pairs_guarded", f"""
WITH s AS (SELECT conv_id * 1000 + turn AS id, role AS lang, text FROM conversations), l AS (SELECT conv_id * 1000 + turn AS a, conv_id * 1000 + turn + 1 AS b FROM conversations), h AS (SELECT item_id AS id FROM benchmark),
bo AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l)
SELECT x AS src_id, y AS ref_id FROM bo JOIN s p ON p.id = x JOIN s q ON q.id = y WHERE p.lang <> 'assistant' AND q.lang = 'assistant' AND x NOT IN (SELECT id FROM h) AND y NOT IN (SELECT id FROM h)
AND len({Q.tokens('p.text')}) BETWEEN 2 AND 40 AND len({Q.tokens('q.text')}) BETWEEN 2 AND 40""")
def parallel_pairs_guarded(spark: Session, sf: str) -> DataFrame:
    """Links in both directions, held-out ids anti-joined."""
    c = table(spark, sf, "conversations")
    s = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("lang"), "text")
    links = s.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return corpus.parallel_pairs(s, links, "assistant", table(spark, sf, "benchmark").select(F.col("item_id").alias("id"))).select("src_id", "ref_id")


@query("donor_search", """
WITH own AS (SELECT DISTINCT s_nationkey AS o, l_partkey AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
sh AS (SELECT a.o AS o, b.o AS d, count(*) AS shared FROM own a JOIN own b USING (c) WHERE a.o <> b.o GROUP BY ALL HAVING count(*) >= 3),
off AS (SELECT sh.o, own.c, sh.d, sh.shared FROM sh JOIN own ON own.o = sh.d WHERE NOT EXISTS (SELECT 1 FROM own x WHERE x.o = sh.o AND x.c = own.c)),
r AS (SELECT o, c, d, shared, row_number() OVER (PARTITION BY o, c ORDER BY shared DESC, d) - 1 AS place FROM off)
SELECT o AS owner, c AS concept, place::INT AS place, d AS donor, shared FROM r WHERE place < 3""")
def donor_search(spark: Session, sf: str) -> DataFrame:
    """Parts that a nation's suppliers lack, and the nations most like it that have them."""
    own = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return graph.donors(own.select(F.col("s_nationkey").alias("owner"), F.col("l_partkey").alias("concept")))


@query("hub_pair_counts", "SELECT a.s AS a, b.s AS b, count(*) AS n FROM (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem) a JOIN (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem) b ON a.p = b.p AND a.s < b.s GROUP BY ALL")
def hub_pair_counts(spark: Session, sf: str) -> DataFrame:
    """J15, A3."""
    return graph.hub_pairs(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


@query("coverage_holes", "SELECT n.n_name AS sense, s.c_mktsegment AS lang FROM (SELECT n_name, n_nationkey FROM nation) n, (SELECT DISTINCT c_mktsegment FROM customer) s WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_mktsegment = s.c_mktsegment AND c.c_acctbal > 5000)")
def coverage_holes(spark: Session, sf: str) -> DataFrame:
    """J16, G3."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    have = c.filter("c_acctbal > 5000").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("sense"), F.col("c_mktsegment").alias("lang"))
    return graph.holes(have, n.select(F.col("n_name").alias("sense")), c.select(F.col("c_mktsegment").alias("lang")).distinct())


@query("title_fallback_join", "SELECT s_suppkey, coalesce(CASE WHEN n_regionkey <> 1 THEN n_name END, s_name) AS title FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def title_fallback_join(spark: Session, sf: str) -> DataFrame:
    """J17."""
    n = table(spark, sf, "nation").filter("n_regionkey <> 1").select(F.col("n_nationkey").alias("k"), "n_name")
    return table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("k"), "left").select("s_suppkey", F.coalesce("n_name", "s_name").alias("title"))


@query("disagreement_join", f"SELECT ok, count(*) AS n FROM (SELECT (length(h) > 0 AND length(r) > 0 AND (contains(h, r) OR contains(r, h) OR (length(h) >= 4 AND length(r) >= 4 AND left(h, 4) = left(r, 4)))) AS ok FROM (SELECT lower(trim(hyp)) AS h, lower(trim(ref)) AS r FROM {SQL_TURNS})) GROUP BY ok")
def disagreement_join(spark: Session, sf: str) -> DataFrame:
    """An inner join and how often both sides agree softly."""
    return _turns(spark, sf).groupBy(T.soft_prefix(F.col("hyp"), F.col("ref")).alias("ok")).agg(F.count("*").alias("n"))


@query("ledger_inverted_search", f"""
WITH c AS (SELECT doc_id AS id, lang AS domain, text FROM documents), q AS (SELECT item_id AS query, 'fr' AS domain, text FROM benchmark WHERE item_id % 50 = 0),
qt AS (SELECT DISTINCT query, unnest({Q.words('text', '[a-z]{3,}')}) AS token FROM q), p AS (SELECT id, unnest({Q.words('text', '[a-z]{3,}')}) AS token FROM c),
h AS (SELECT query, id, count(*)::DOUBLE AS s FROM p JOIN qt USING (token) GROUP BY ALL UNION ALL SELECT query, id, 1.5 FROM c JOIN q USING (domain)),
t AS (SELECT query, id, sum(s) AS score FROM h GROUP BY ALL)
SELECT query, place::INT AS place, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) - 1 AS place FROM t) WHERE place < 8""")
def ledger_inverted_search(spark: Session, sf: str) -> DataFrame:
    """Postings joined with query tokens; the eight best of each query. The stated query set is every item whose id
    divides by 50, against all documents."""
    claims = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"), "text")
    queries = table(spark, sf, "benchmark").filter("item_id % 50 = 0").select(F.col("item_id").alias("query"), F.lit("fr").alias("domain"), "text")
    return retrieve.search(claims, queries)


LATIN, GREEK = "abgdeiklmnoprst", "αβγδεικλμνοπρστ"


@query("two_hop_concepts", f"""
WITH f AS (SELECT replace(form, ' ', '') AS form, min(ord) AS concept, lang FROM {SQL_BINDINGS} WHERE lang IN ('la', 'de') GROUP BY ALL),
best AS (SELECT form, arg_min(concept, CASE lang WHEN 'la' THEN 1 ELSE 2 END) AS concept FROM f GROUP BY form),
known AS (SELECT form, n_name AS en FROM best JOIN part ON p_partkey = concept JOIN nation ON n_nationkey = p_size),
t AS (SELECT replace(p_name, ' ', '') AS token FROM part UNION SELECT translate(replace(p_name, ' ', ''), '{LATIN}', '{GREEK}') FROM part UNION SELECT lower(p_brand) FROM part)
SELECT token, coalesce(a.en, b.en) AS en, CASE WHEN a.en IS NOT NULL THEN 0.96 WHEN b.en IS NOT NULL THEN 0.88 END::DOUBLE AS score
FROM t LEFT JOIN known a ON a.form = token LEFT JOIN known b ON b.form = translate(token, '{GREEK}', '{LATIN}')""")
def two_hop_concepts(spark: Session, sf: str) -> DataFrame:
    """Form to concept to English, directly or by Latin letters: parts to the nations of their sizes."""
    p, n = table(spark, sf, "part"), table(spark, sf, "nation")
    joined = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    forms = bindings(spark, sf).withColumn("form", joined("form")).groupBy("lang", "form").agg(F.min("ord").alias("concept"))
    concepts = p.join(n, F.col("p_size") == F.col("n_nationkey")).select(F.col("p_partkey").alias("concept"), F.col("n_name").alias("en"))
    toks = p.select(F.explode(F.array(joined("p_name"), F.translate(joined("p_name"), LATIN, GREEK), F.lower("p_brand"))).alias("token")).distinct()
    return lookup.two_hops(toks, forms, concepts, ["la", "de"])


@query("prefix_theta_join", f"SELECT a.form AS a, b.form AS b FROM {SQL_NAMES} a JOIN {SQL_NAMES} b ON left(a.form, 3) = left(b.form, 3) AND a.form <> b.form AND starts_with(b.form, a.form)")
def prefix_theta_join(spark: Session, sf: str) -> DataFrame:
    """One form starts the other, within blocks of three characters."""
    n = names(spark, sf)
    pairs = similarity.prefix_pairs(n.select(F.col("form").alias("a")), n.select(F.col("form").alias("b")), 3)
    return pairs.filter("a <> b").filter(F.col("b").startswith(F.col("a"))).select("a", "b")


@query("containment_theta_join", f"SELECT a.form AS a, b.form AS b, round(least(length(a.form), length(b.form)) / greatest(length(a.form), length(b.form))::DOUBLE, 9) AS ratio FROM {SQL_NAMES} a JOIN {SQL_NAMES} b ON left(a.form, 4) = left(b.form, 4) AND a.form <> b.form WHERE length(a.form) >= 4 AND length(b.form) >= 4 AND (contains(a.form, b.form) OR contains(b.form, a.form)) AND least(length(a.form), length(b.form)) / greatest(length(a.form), length(b.form))::DOUBLE >= 0.5")
def containment_theta_join(spark: Session, sf: str) -> DataFrame:
    """J22."""
    n = names(spark, sf)
    found = similarity.containment_pairs(n.select(F.col("form").alias("a")), n.select(F.col("form").alias("b")), least=0.5, size=4)
    return found.select("a", "b", F.round("ratio", 9).alias("ratio"))


SQL_PREFIX = "list_sum(list_transform(range(1, least(length(a.form), length(b.form)) + 1), lambda i: (left(a.form, i) = left(b.form, i))::INT))"


@query("prefix_neighbours", f"SELECT a.form AS a, b.form AS b, {SQL_PREFIX}::INT AS common, round(0.45 * {SQL_PREFIX} / greatest(length(a.form), length(b.form))::DOUBLE + 0.55 * {Q.edit_similarity('a.form', 'b.form')}, 9) AS score FROM {SQL_NAMES} a JOIN {SQL_NAMES} b ON left(a.form, 3) = left(b.form, 3) AND a.form < b.form")
def prefix_neighbours(spark: Session, sf: str) -> DataFrame:
    """Shared prefix and edit similarity mixed."""
    n = names(spark, sf)
    pairs = similarity.prefix_pairs(n.select(F.col("form").alias("a")), n.select(F.col("form").alias("b")), 3).filter("a < b").withColumn("common", T.common_prefix(F.col("a"), F.col("b")))
    score = 0.45 * F.col("common") / F.greatest(F.length("a"), F.length("b")) + 0.55 * T.edit_similarity(F.col("a"), F.col("b"))
    return pairs.select("a", "b", F.col("common").cast("int").alias("common"), F.round(score, 9).alias("score"))


@query("gram_cosine_neighbours", f"""
WITH g AS (SELECT form, gram, count(*) AS tf FROM (SELECT form, unnest({Q.grams("('#' || form || '#')", 3)}) AS gram FROM {SQL_NAMES}) GROUP BY ALL), n AS (SELECT form, sqrt(sum(tf * tf)) AS norm FROM g GROUP BY form),
d AS (SELECT a.form AS form, b.form AS other, sum(a.tf * b.tf) AS dot FROM g a JOIN g b ON a.gram = b.gram AND left(a.form, 1) = left(b.form, 1) AND a.form <> b.form GROUP BY ALL)
SELECT d.form, d.other, round(dot / (x.norm * y.norm), 9) AS cosine FROM d JOIN n x ON x.form = d.form JOIN n y ON y.form = d.other WHERE dot / (x.norm * y.norm) >= 0.2""")
def gram_cosine_neighbours(spark: Session, sf: str) -> DataFrame:
    """Cosine of character trigrams by a join on the gram."""
    n = names(spark, sf)
    return similarity.gram_pairs(n, n, prefix=1).select("form", "other", F.round("cosine", 9).alias("cosine"))


#: Letters of part names and the Greek ones for them, accented and plain.
NAMED, ACCENTED, PLAIN = "aeiobdgklmnprst", "άέίόβδγκλμνπρστ", "αειοβδγκλμνπρστ"
#: Ethnonym endings as they are peeled: folded, the longest first.
PEELED = sorted({e.translate(str.maketrans(T.GREEK_ACCENTED, T.GREEK_PLAIN)) for e in lookup.DEMONYMS}, key=lambda x: (-len(x), x))


def _gazetteer_sql() -> str:
    fold = lambda x: f"translate({x}, '{ACCENTED}', '{PLAIN}')"
    latin = lambda x: f"regexp_replace(translate({x}, '{PLAIN}', '{NAMED}'), '[^a-z]', '', 'g')"
    old = f"translate(form, '{NAMED}', '{ACCENTED}')"
    names_ = f"SELECT CASE WHEN length(form) % 2 = 0 THEN 'la' ELSE 'en' END AS lang, form, 'place_' || form AS meaning, form AS ord FROM {SQL_NAMES} WHERE length(form) > 3 UNION ALL SELECT 'grc', {fold(old)}, 'polis_' || form, 'z' || form FROM {SQL_NAMES} WHERE length(form) = 4"
    asked_ = f"SELECT form AS token, 'la' AS lang FROM {SQL_NAMES} UNION ALL SELECT {old}, 'grc' FROM {SQL_NAMES} UNION ALL SELECT form || 'ensis', 'la' FROM {SQL_NAMES} UNION ALL SELECT form || 'ana', 'fr' FROM {SQL_NAMES} UNION ALL SELECT {old} || 'ιώτης', 'grc' FROM {SQL_NAMES}"
    parts = [
        f"n AS ({names_})", "k AS (SELECT key, arg_min(meaning, ord) AS meaning FROM (SELECT 'l|' || lang || '|' || form AS key, meaning, ord FROM n UNION ALL SELECT 'f|' || form, meaning, ord FROM n"
        f" UNION ALL SELECT 't|' || {latin('form')}, meaning, ord FROM n WHERE lang = 'grc') GROUP BY key)",
        f"t AS (SELECT token, lang, lower(translate(token, '{ACCENTED}ώ', '{PLAIN}ω')) AS form FROM ({asked_}))",
        f"d AS (SELECT token, lang, i, left(form, length(form) - length(e)) AS stem FROM t, (SELECT * FROM {Q.values([(i, e) for i, e in enumerate(PEELED)], 'i, e').replace(' t(', ' u(')}) WHERE ends_with(form, e) AND length(form) - length(e) >= 3)",
        f"c AS (SELECT d.*, k, stem || more AS place FROM d, (SELECT * FROM {Q.values(list(enumerate(lookup.PLACE_ENDINGS)), 'k, more').replace(' t(', ' u(')}))",
        "p AS (SELECT token, lang, 0 AS place, 'l|' || lang || '|' || form AS key, 0.98 AS score, 'name_lang_exact' AS method FROM t UNION ALL SELECT token, lang, 1, 'f|' || form, 0.95, 'name_form_exact' FROM t"
        f" UNION ALL SELECT token, lang, 2, 't|' || {latin('form')}, 0.90, 'name_translit' FROM t WHERE lang = 'grc' UNION ALL SELECT token, lang, 3, 'f|' || {latin('form')}, 0.88, 'name_translit_form' FROM t WHERE lang = 'grc'"
        " UNION ALL SELECT token, lang, 10 + 20 * i + 2 * k, 'f|' || place, 0.84, 'name_demonym_peel' FROM c UNION ALL SELECT token, lang, 11 + 20 * i + 2 * k, 'l|' || lang || '|' || place, 0.84, 'name_demonym_peel' FROM c"
        f" UNION ALL SELECT token, lang, 28 + 20 * i, 'f|' || {latin('stem')}, 0.82, 'name_demonym_translit' FROM d WHERE lang = 'grc' UNION ALL SELECT token, lang, 29 + 20 * i, 't|' || {latin('stem')}, 0.82, 'name_demonym_translit' FROM d WHERE lang = 'grc')",
        "b AS (SELECT token, lang, arg_min(meaning, place) AS meaning, arg_min(score, place)::DOUBLE AS score, arg_min(method, place) AS method FROM p JOIN k USING (key) GROUP BY token, lang)",
    ]
    return f"WITH {', '.join(parts)} SELECT t.token, t.lang, meaning, score, method FROM t LEFT JOIN b ON b.token = t.token AND b.lang = t.lang"


@query("gazetteer_cascade", _gazetteer_sql())
def gazetteer_cascade(spark: Session, sf: str) -> DataFrame:
    """Words of part names as places, asked for as they are, in Greek letters, and as the people who live there."""
    n = names(spark, sf)
    form, old = F.col("form"), F.translate("form", NAMED, ACCENTED)
    places = n.filter(F.length("form") > 3).select(F.when(F.length("form") % 2 == 0, "la").otherwise("en").alias("lang"), form, F.concat(F.lit("place_"), form).alias("meaning"), form.alias("ord"))
    greek = n.filter(F.length("form") == 4).select(F.lit("grc").alias("lang"), old.alias("form"), F.concat(F.lit("polis_"), form).alias("meaning"), F.concat(F.lit("z"), form).alias("ord"))
    ask = lambda token, lang: F.struct(token.alias("token"), F.lit(lang).alias("lang"))
    asked_ = F.array(ask(form, "la"), ask(old, "grc"), ask(F.concat(form, F.lit("ensis")), "la"), ask(F.concat(form, F.lit("ana")), "fr"), ask(F.concat(old, F.lit("ιώτης")), "grc"))
    return lookup.gazetteer(n.select(F.explode(asked_).alias("x")).select("x.*"), places.unionByName(greek))


LATIN_TOKENS = ("ibus", "orum", "uum", "ae", "ationibus")
SQL_DECLINED = " UNION ".join(f"SELECT left(form, length(form) - {k}) || '{e}' AS token FROM {SQL_NAMES} WHERE length(form) > 3" for e in LATIN_TOKENS for k in (0, 1, 2))


def _declension_sql() -> str:
    from lexmill.plans.record_queries import SQL_CONTENT, SQL_META, sql_keys

    ending = lambda rows, names_: f"(SELECT * FROM {Q.values(rows, names_).replace(' t(', ' u(')})"
    meanings = sql_keys(f"SELECT form, meaning || CASE length(form) % 3 WHEN 0 THEN '_king' ELSE '' END AS gloss FROM {SQL_STORE}")
    parts = [
        f"t AS ({SQL_DECLINED})", f"s AS (SELECT form AS donor, gloss AS meaning, {SQL_CONTENT} AS content, {SQL_META} AS meta FROM ({meanings}))",
        f"c AS (SELECT DISTINCT token, stem FROM (SELECT token, token AS stem FROM t UNION ALL SELECT token, left(token, length(token) - length(e)) || 'u' FROM t, {ending(list(lookup.U_STEMS), 'e, n')} WHERE ends_with(token, e) AND length(token) >= n"
        f" UNION ALL SELECT token, left(token, length(token) - length(e)) FROM t, {ending([(e,) for e in lookup.LATIN_ENDINGS], 'e')} WHERE ends_with(token, e) AND length(token) - length(e) >= 3) WHERE length(stem) >= 3)",
        f"f AS (SELECT token, stem, e, s.*, {Q.edit_similarity('token', 'donor')} AS sim FROM (SELECT token, stem, e, stem || e AS cand FROM c, {ending([('',), *[(e,) for e in lookup.LATIN_LEMMAS]], 'e')}) JOIN s ON donor = cand)",
        f"z AS (SELECT *, least(0.96, CASE WHEN e = '' THEN 0.84 ELSE 0.88 END * CASE WHEN meta THEN 0.35 ELSE 1 END + CASE WHEN regexp_matches(meaning, '{'|'.join(lookup.DOMAIN_WORDS)}') THEN 0.05 ELSE 0 END + 0.03 * least(3, length(stem) - 3) + 0.1 * content + 0.18 * sim)::DOUBLE AS score"
        " FROM f WHERE sim >= 0.48 AND NOT (abs(length(token) - length(donor)) > 4 AND sim < 0.62))",
    ]
    order = "(round(score, 9), length(stem), donor)"
    return f"WITH {', '.join(parts)} SELECT token, arg_max(meaning, {order}) AS meaning, arg_max(donor, {order}) AS donor, round(max(score), 9) AS score FROM z WHERE score >= 0.82 GROUP BY token"


@query("declension_lemmas", _declension_sql())
def declension_lemmas(spark: Session, sf: str) -> DataFrame:
    """Words of part names declined, and the words that their class stems lead back to."""
    n = names(spark, sf).filter(F.length("form") > 3)
    made = [F.concat(F.substr("form", F.lit(1), F.length("form") - k), F.lit(e)) for e in LATIN_TOKENS for k in (0, 1, 2)]
    kings = F.concat("meaning", F.when(F.length("form") % 3 == 0, "_king").otherwise(""))
    found = lookup.declension_lemmas(n.select(F.explode(F.array(*made)).alias("token")).distinct(), store(spark, sf).select("form", kings.alias("meaning")))
    return found.select("token", "meaning", "donor", F.round("score", 9).alias("score"))


PREFIXES, PEEL_ENDINGS = ["poly", "pseudo", "neo", "hydro"], ["s", "e"]
SQL_COMPOUNDS = f"(SELECT 'pseudo' || form AS token FROM {SQL_NAMES} UNION SELECT 'neo' || form || 'ing' FROM {SQL_NAMES} UNION SELECT 'hydro' || left(form, length(form) - 1) FROM {SQL_NAMES} UNION SELECT form FROM {SQL_NAMES})"


@query("compound_peel", f"""
WITH p AS (SELECT token, rule, substr(token, length(prefix) + 1) AS rest FROM {SQL_COMPOUNDS}, (SELECT * FROM {Q.values([(0, 'pseudo'), (1, 'hydro'), (2, 'poly'), (3, 'neo')], 'rule, prefix').replace(' t(', ' u(')}) WHERE starts_with(token, prefix) AND length(token) >= 8 AND length(token) - length(prefix) >= 4),
s AS (SELECT token, rule, c, left(rest, length(rest) - c) AS stem FROM (SELECT *, unnest(range(0, greatest(1, least(length(rest) - 2, 10)))) AS c FROM p)),
x AS (SELECT token, rule, c, i, stem || e AS cand FROM s, (SELECT * FROM {Q.values([(0, ''), (1, 's'), (2, 'e')], 'i, e').replace(' t(', ' u(')})),
b AS (SELECT token, arg_min(form, (rule, c, i)) AS form, arg_min(meaning, (rule, c, i)) AS meaning FROM x JOIN {SQL_STORE} ON form = cand GROUP BY token)
SELECT t.token, form, meaning FROM {SQL_COMPOUNDS} t LEFT JOIN b ON b.token = t.token""")
def compound_peel(spark: Session, sf: str) -> DataFrame:
    """Words with a prefix, whole, inflected or cut; the rest, with an ending, or its stem must be in the store."""
    form = F.col("form")
    made = F.array(F.concat(F.lit("pseudo"), form), F.concat(F.lit("neo"), form, F.lit("ing")), F.concat(F.lit("hydro"), F.substr(form, F.lit(1), F.length(form) - 1)), form)
    return lookup.peel_compounds(names(spark, sf).select(F.explode(made).alias("token")).distinct(), store(spark, sf), PREFIXES, PEEL_ENDINGS)


@query("wrong_sense_pairs", f"""
WITH x AS (SELECT word, arg_min(p_type || ' ' || p_brand, p_partkey) AS gold, arg_max(p_type || ' ' || p_brand, p_partkey) AS densify FROM (SELECT *, unnest({Q.words('p_name')}) AS word FROM part) GROUP BY word),
y AS (SELECT word, lower(gold) AS g, lower(densify) AS d, gold, densify FROM x)
SELECT word, gold, densify FROM y WHERE NOT (contains(g, d) OR contains(d, g) OR left(g, 4) = left(d, 4))""")
def wrong_sense_pairs(spark: Session, sf: str) -> DataFrame:
    """Forms of two lexicons whose glosses aren't softly equal: the first and the last part that has a word."""
    w = table(spark, sf, "part").select(F.explode(T.words(F.col("p_name"))).alias("word"), F.concat_ws(" ", "p_type", "p_brand").alias("gloss"), F.col("p_partkey").alias("ord"))
    gold = w.groupBy("word").agg(F.min_by("gloss", "ord").alias("gold"))
    densify = w.groupBy("word").agg(F.max_by("gloss", "ord").alias("densify"))
    return gold.join(densify, "word").filter(~T.soft_prefix(F.col("densify"), F.col("gold"))).select("word", "gold", "densify")


@query("mbr_pick")
def mbr_pick(spark: Session, sf: str) -> DataFrame:
    """Minimum Bayes risk inside each conversation's pool of turns."""
    c = table(spark, sf, "conversations")
    pools = c.select(F.col("conv_id").alias("sent_id"), F.col("turn").alias("place"), F.col("text").alias("hyp"), (-F.col("turn") / 4.0).alias("gen"))
    return rank.minimum_risk(pools)


KEYWORDS = [("the", "a"), ("in", "b"), ("st", "c")]


@query("keyword_routes", "SELECT item_id, CASE WHEN contains(lower(text), 'ouou') THEN 'first' WHEN contains(lower(text), 'tion') THEN 'second' ELSE 'other' END AS route FROM benchmark")
def keyword_routes(spark: Session, sf: str) -> DataFrame:
    """The first rule whose keyword a text contains."""
    b = table(spark, sf, "benchmark")
    return b.select("item_id", retrieve.keyword_route(b, "text", [("ouou", "first"), ("tion", "second")], "other").alias("route"))


@query("alias_enrichment", "SELECT p_partkey, coalesce(CASE WHEN p_size < 5 THEN 1.0 END, CASE p_brand WHEN 'Brand#11' THEN 2.0 WHEN 'Brand#12' THEN 3.0 END, 9.0)::DOUBLE AS d FROM part")
def alias_enrichment(spark: Session, sf: str) -> DataFrame:
    """Parameters from the nearest ancestor that has them."""
    brands = spark.createDataFrame([("Brand#11", 2.0), ("Brand#12", 3.0)], "brand string, d2 double")
    p = table(spark, sf, "part")
    return p.join(F.broadcast(brands), F.col("p_brand") == F.col("brand"), "left").select("p_partkey", F.coalesce(F.when(F.col("p_size") < 5, 1.0), F.col("d2"), F.lit(9.0)).alias("d"))


@query("reverse_lookup", f"SELECT w, form FROM (SELECT w, form, row_number() OVER (PARTITION BY w ORDER BY form) AS r FROM {Q.values([('part_1s',), ('part_2',), ('part_3',)], 'w')} JOIN {SQL_STORE} ON rtrim(w, 's') = rtrim(meaning, 's')) WHERE r <= 4")
def reverse_lookup(spark: Session, sf: str) -> DataFrame:
    """From a gloss, plural or not, to at most four forms."""
    asked = spark.sql("SELECT * FROM " + Q.values([("part_1s",), ("part_2",), ("part_3",)], "w"))
    bare = lambda c: F.regexp_replace(c, "s+$", "")
    found = asked.join(store(spark, sf), bare("w") == bare("meaning")).groupBy("w").agg(F.slice(F.sort_array(F.collect_set("form")), 1, 4).alias("f"))
    return found.select("w", F.explode("f").alias("form"))


ATLAS = [(0, "thion", "tion ouer the"), (1, "inan", "eresing that"), (2, "with", "ent hein ndea")]


@query("scored_keyword_match", f"""
SELECT id, name, score FROM (SELECT id, name, sum(s) AS score, row_number() OVER (PARTITION BY id ORDER BY sum(s) DESC, ord) AS r FROM (
  SELECT item_id AS id, ord, name, CASE WHEN contains(lower(text), w) THEN s ELSE 0 END::DOUBLE AS s FROM benchmark, (
    SELECT ord, name, name AS w, 3.0 AS s FROM {Q.values(ATLAS, 'ord, name, kw')} UNION ALL SELECT ord, name, w, 1.0 FROM (SELECT ord, name, unnest(string_split(kw, ' ')) AS w FROM {Q.values(ATLAS, 'ord, name, kw')}) WHERE length(w) >= 4))
  GROUP BY id, ord, name HAVING sum(s) > 0) WHERE r = 1""")
def scored_keyword_match(spark: Session, sf: str) -> DataFrame:
    """J34."""
    atlas = spark.sql("SELECT * FROM " + Q.values(ATLAS, "ord, name, keywords"))
    return retrieve.atlas_match(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"), atlas)


@query("keep_best_by_key", "SELECT lang, source, doc_id, n_chars, any_long FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS r, max((n_chars > 5000)::INT) OVER (PARTITION BY lang, source) = 1 AS any_long FROM documents) WHERE r = 1")
def keep_best_by_key(spark: Session, sf: str) -> DataFrame:
    """A1: the best record of each key, the first of equals, flags joined by or."""
    d = table(spark, sf, "documents").select("lang", "source", "doc_id", "n_chars", F.col("doc_id").alias("ord"), (F.col("n_chars") > 5000).alias("any_long"))
    return merge.keep_best(d, ["lang", "source"], [F.col("n_chars")], flag="any_long").drop("ord")


@query("keep_best_last", "SELECT p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey DESC) AS r FROM part) WHERE r = 1")
def keep_best_last(spark: Session, sf: str) -> DataFrame:
    """A1: of equals the last."""
    p = table(spark, sf, "part").select("p_type", "p_size", "p_partkey", F.col("p_partkey").alias("ord"))
    return merge.keep_best(p, ["p_type"], [F.col("p_size")], last=True).select("p_type", "p_partkey")


@query("distribution_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def distribution_counts(spark: Session, sf: str) -> DataFrame:
    """A2."""
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("distinct_sets_per_key", "SELECT source, list_sort(list(DISTINCT lang)) AS langs FROM documents GROUP BY source")
def distinct_sets_per_key(spark: Session, sf: str) -> DataFrame:
    """A3."""
    return table(spark, sf, "documents").groupBy("source").agg(F.sort_array(F.collect_set("lang")).alias("langs"))


@query("vote_argmax", """
SELECT l_partkey, l_suppkey, weight, round(share, 9) AS share FROM (SELECT l_partkey, l_suppkey, weight, weight / sum(weight) OVER (PARTITION BY l_partkey) AS share, row_number() OVER (PARTITION BY l_partkey ORDER BY weight DESC, seen) AS r
  FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) AS weight, min(l_orderkey * 10 + l_linenumber) AS seen FROM lineitem GROUP BY ALL)) WHERE r = 1""")
def vote_argmax(spark: Session, sf: str) -> DataFrame:
    """A4, K3."""
    li = table(spark, sf, "lineitem").withColumn("ord", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    found = votes.argmax_vote(li, "l_partkey", "l_suppkey", F.col("l_quantity"), "ord")
    return found.select("l_partkey", "l_suppkey", "weight", F.round("share", 9).alias("share"))


# How far each method is trusted.
PRIORS = [("rev_lemma_end", 1.08), ("decl_lemma", 1.10), ("stem_match", 0.92), ("rev_exact", 1.20), ("substring", 0.80)]


SQL_CANDIDATES = (
    "(SELECT l_orderkey AS token, 'm' || (l_suppkey % 3)::VARCHAR AS meaning, ['rev_lemma_end', 'decl_lemma', 'stem_match', 'rev_exact', 'substring'][l_linenumber % 5 + 1] AS method, l_quantity / 50 AS score,"
    " 0.3 + l_discount * 7 AS sim, l_tax * 10 + 0.2 AS content FROM lineitem)"
)


@query("sense_votes", f"""
WITH c AS (SELECT * FROM {SQL_CANDIDATES}), p AS (SELECT * FROM {Q.values(PRIORS, 'method, prior')}),
s AS (SELECT token, meaning, sum(score * (0.45 + 0.55 * sim) * prior * (0.55 + 0.45 * content)) * CASE WHEN count(DISTINCT method) >= 2 THEN 1 + 0.12 * least(3, count(DISTINCT method) - 1) ELSE 1 END * CASE WHEN count(*) >= 3 THEN 1.08 ELSE 1 END AS w,
        max(sim) AS sim, max(score) AS score, max(content) AS content FROM c JOIN p USING (method) GROUP BY ALL),
t AS (SELECT *, w / sum(w) OVER (PARTITION BY token) AS share, row_number() OVER (PARTITION BY token ORDER BY w DESC, meaning DESC) AS r FROM s),
k AS (SELECT *, least(0.96, 0.35 * share + 0.35 * sim + 0.2 * least(1.0, score) + 0.1 * least(1.0, content)) AS conf FROM t WHERE r = 1)
SELECT token, meaning, round(CASE WHEN conf >= 0.72 THEN conf ELSE greatest(conf, 0.74) END, 9) AS confidence, round(share, 9) AS share FROM k
WHERE NOT (share < 0.38 AND sim < 0.78) AND (conf >= 0.72 OR (sim >= 0.85 AND score >= 0.88 AND share >= 0.5))""")
def sense_votes(spark: Session, sf: str) -> DataFrame:
    """A5: the lines of an order vote, by the method that their number stands for, for a meaning."""
    methods = F.array(*[F.lit(m) for m in ("rev_lemma_end", "decl_lemma", "stem_match", "rev_exact", "substring")])
    c = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("token"), F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string")).alias("meaning"), F.element_at(methods, (F.col("l_linenumber") % 5 + 1).cast("int")).alias("method"),
        (F.col("l_quantity") / 50).alias("score"), (0.3 + F.col("l_discount") * 7).alias("sim"), (F.col("l_tax") * 10 + 0.2).alias("content"),
    )
    p = spark.sql("SELECT * FROM " + Q.values(PRIORS, "method, prior"))
    return votes.sense_vote(c, p).select("token", "meaning", F.round("confidence", 9).alias("confidence"), F.round("share", 9).alias("share"))


@query("share_threshold_mode", """
SELECT o_custkey, o_orderpriority, n, round(n / total, 9) AS share FROM (SELECT o_custkey, o_orderpriority, count(*) AS n, sum(count(*)) OVER (PARTITION BY o_custkey) AS total,
  row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY o_custkey, o_orderpriority) WHERE r = 1 AND n / total >= 0.4""")
def share_threshold_mode(spark: Session, sf: str) -> DataFrame:
    """A6."""
    found = votes.mode_with_share(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", 0.4)
    return found.select("o_custkey", "o_orderpriority", "n", F.round("share", 9).alias("share"))


SQL_CO = f"""p AS (SELECT id, {Q.tokens('hyp')} AS s, {Q.tokens('ref')} AS t FROM {SQL_TURNS}),
co AS (SELECT s, t, count(*) AS c FROM (SELECT s, unnest(t) AS t FROM (SELECT unnest(s) AS s, t FROM p WHERE len(s) > 0 AND len(t) > 0)) GROUP BY ALL), tot AS (SELECT s, count(*) AS n FROM (SELECT unnest(s) AS s FROM p WHERE len(t) > 0) GROUP BY s)"""


@query("cooccurrence_top1", f"""
WITH {SQL_CO} SELECT s, t, c FROM (SELECT s, t, c, n, row_number() OVER (PARTITION BY s ORDER BY c DESC, t) AS r FROM co JOIN tot USING (s))
WHERE r = 1 AND n >= 5 AND c >= 3 AND t <> s AND length(t) <= 40 AND (c >= 0.08 * n OR c >= 20)""")
def cooccurrence_top1(spark: Session, sf: str) -> DataFrame:
    """Unigrams."""
    return corpus.best_partners(_turns(spark, sf), "hyp", "ref")


@query("bigram_alignment_top1")
def bigram_alignment_top1(spark: Session, sf: str) -> DataFrame:
    """Bigrams in two passes, independent of the corpus' order."""
    best = corpus.bigram_alignment(_turns(spark, sf), "hyp", "ref")
    return best.groupBy("s").agg(F.min_by(F.struct("t", "c"), F.struct(-F.col("c"), "t")).alias("r")).select("s", "r.*").filter("c >= 2")


def _sql_grams(n: int, column: str, name: str) -> str:
    return f"(SELECT id, g, count(*) AS {name} FROM (SELECT id, unnest(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) ELSE [] END) AS g FROM (SELECT id, {Q.tokens(column)} AS w FROM {SQL_TURNS})) GROUP BY ALL)"


@query("bleu_parts", "SELECT " + ", ".join(f"round((SELECT (coalesce(sum(least(h, coalesce(r, 0))), 0) + 1) / (coalesce(sum(h), 0) + 1)::DOUBLE FROM {_sql_grams(n, 'hyp', 'h')} LEFT JOIN {_sql_grams(n, 'ref', 'r')} USING (id, g)), 9) AS p{n}" for n in range(1, 5)))
def bleu_parts(spark: Session, sf: str) -> DataFrame:
    """Clipped and smoothed n-gram precisions."""
    return corpus.bleu(_turns(spark, sf)).select(*[F.round(f"p{n}", 9).alias(f"p{n}") for n in range(1, 5)])


SQL_F1 = "SELECT round(tp / greatest(1, tp + fp)::DOUBLE, 9) AS precision, round(tp / greatest(1, tp + fn)::DOUBLE, 9) AS recall, round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 9) AS f1 FROM (SELECT sum(least(coalesce(h, 0), coalesce(r, 0))) AS tp, sum(coalesce(h, 0) - least(coalesce(h, 0), coalesce(r, 0))) AS fp, sum(coalesce(r, 0) - least(coalesce(h, 0), coalesce(r, 0))) AS fn FROM {h} FULL JOIN {r} USING (id, g))"


@query("unigram_f1", SQL_F1.format(h=_sql_grams(1, "hyp", "h"), r=_sql_grams(1, "ref", "r")))
def unigram_f1(spark: Session, sf: str) -> DataFrame:
    """A9."""
    t = _turns(spark, sf)
    return _rounded(corpus.f1(corpus.overlap_sums(corpus.ngram_counts(t, "id", "hyp", 1, "h"), corpus.ngram_counts(t, "id", "ref", 1, "r"), "id")))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) for c in df.columns])


@query("chrf_parts", SQL_F1.format(h=f"(SELECT id, g, count(*) AS h FROM (SELECT id, unnest({Q.grams('hyp', 3)}) AS g FROM {SQL_TURNS}) GROUP BY ALL)", r=f"(SELECT id, g, count(*) AS r FROM (SELECT id, unnest({Q.grams('ref', 3)}) AS g FROM {SQL_TURNS}) GROUP BY ALL)"))
def chrf_parts(spark: Session, sf: str) -> DataFrame:
    """A10."""
    t = _turns(spark, sf)
    grams = lambda c, n: t.select("id", F.explode(T.grams(F.col(c), 3)).alias("g")).groupBy("id", "g").agg(F.count("*").alias(n))
    return _rounded(corpus.f1(corpus.overlap_sums(grams("hyp", "h"), grams("ref", "r"), "id")))


@query("sentence_bleu_scores")
def sentence_bleu_scores(spark: Session, sf: str) -> DataFrame:
    """An Arrow function over distinct pairs."""
    return _turns(spark, sf).select("id", F.round(rank.sentence_bleu_udf()("hyp", "ref"), 9).alias("bleu"))


@query("rollup_rates", "SELECT coalesce(lang, '(all)') AS lang, count(*) AS n, sum(quality)::BIGINT AS good, round(avg(quality), 9) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)")
def rollup_rates(spark: Session, sf: str) -> DataFrame:
    """Overall and by language in one pass."""
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    r = j.rollup("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.round(F.avg("quality"), 9).alias("rate"))
    return r.withColumn("lang", F.coalesce("lang", F.lit("(all)")))


@query("catalog_scores", "SELECT source, count(*) AS n, round(avg((quality = 1)::INT), 9) AS open_rate, round(avg((toxic = 0)::INT), 9) AS product_rate, (avg((quality = 1)::INT) >= 0.85 AND avg((toxic = 0)::INT) >= 0.85) OR count(*) < 20 AS ok FROM labels JOIN documents USING (doc_id) GROUP BY source")
def catalog_scores(spark: Session, sf: str) -> DataFrame:
    """Rates per group; small groups pass."""
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    a, b = F.avg((F.col("quality") == 1).cast("int")), F.avg((F.col("toxic") == 0).cast("int"))
    return j.groupBy("source").agg(F.count("*").alias("n"), F.round(a, 9).alias("open_rate"), F.round(b, 9).alias("product_rate"), (((a >= 0.85) & (b >= 0.85)) | (F.count("*") < 20)).alias("ok"))


@query("stream_statistics", "SELECT count(*) AS n, count_if(quality = 1)::BIGINT AS exact, count_if(toxic = 0)::BIGINT AS soft, round(avg(n_chars), 6) AS mean FROM labels JOIN documents USING (doc_id)")
def stream_statistics(spark: Session, sf: str) -> DataFrame:
    """One aggregate for all counters."""
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("exact"), F.count_if(F.col("toxic") == 0).alias("soft"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query("field_pooling", "SELECT l_orderkey, round(avg(l_quantity), 9) AS mean, round(avg(l_quantity) FILTER (WHERE r <= greatest(1, floor(n * 0.34))), 9) AS peak FROM (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) GROUP BY l_orderkey")
def field_pooling(spark: Session, sf: str) -> DataFrame:
    """Mean and mean of the top share."""
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.avg("l_quantity").alias("mean"), F.sort_array(F.collect_list("l_quantity"), asc=False).alias("q"))
    k = F.greatest(F.lit(1), F.floor(F.size("q") * 0.34)).cast("int")
    top = F.aggregate(F.slice("q", F.lit(1), k), F.lit(0.0), lambda a, x: a + x) / k
    return g.select("l_orderkey", F.round("mean", 9).alias("mean"), F.round(top, 9).alias("peak"))


@query("ordered_alternates", "SELECT l_partkey, list(l_shipmode ORDER BY first) AS alternates FROM (SELECT l_partkey, l_returnflag || l_linestatus AS l_shipmode, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY ALL) GROUP BY l_partkey")
def ordered_alternates(spark: Session, sf: str) -> DataFrame:
    """Different alternates in the order of their first appearance; distinct before they are collected. The SQL leaves
    open which of two equal ones comes first: it is the one whose first row stands first, files by path, as in DuckDB run by one thread."""
    rows = table(spark, sf, "lineitem").select("l_partkey", F.concat("l_returnflag", "l_linestatus").alias("g"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), "_metadata.file_path", "_metadata.row_index")
    files = rows.select("file_path").distinct().select("file_path", F.row_number().over(Window.orderBy("file_path")).cast("long").alias("file"))
    placed = rows.join(F.broadcast(files), "file_path")  # one row per file
    first = placed.groupBy("l_partkey", "g").agg(F.min("ord").alias("ord"), F.min(F.shiftleft("file", 40) + F.col("row_index")).alias("place"))
    order = F.struct(F.col("ord").isNull().alias("last"), "ord", "place", "g")
    return first.groupBy("l_partkey").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["g"]).alias("alternates"))


@query("entropy_concentration", """
SELECT l_orderkey, round(e, 9) + 0 AS entropy, round(greatest(0, 1 - e / ln(greatest(n, 2))), 9) + 0 AS concentration FROM (
  SELECT l_orderkey, sum(-p * ln(p + 1e-12)) AS e, count(*) AS n FROM (SELECT l_orderkey, l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS p FROM lineitem) GROUP BY l_orderkey)""")
def entropy_concentration(spark: Session, sf: str) -> DataFrame:
    """A17."""
    p = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_quantity") / F.sum("l_quantity").over(Window.partitionBy("l_orderkey"))).alias("p"))
    return votes.concentration(p, "l_orderkey", "p").select("l_orderkey", F.round("entropy", 9).alias("entropy"), F.round("concentration", 9).alias("concentration"))


@query("binding_coverage", f"SELECT sense, count(DISTINCT lang) AS n_langs, 4 - count(DISTINCT lang) AS missing, count(DISTINCT lang) < 2 AS under_min FROM {SQL_BINDINGS} GROUP BY sense")
def binding_coverage(spark: Session, sf: str) -> DataFrame:
    """A18."""
    return graph.coverage(bindings(spark, sf), 4, 2)


@query("approximate_counts")
def approximate_counts(spark: Session, sf: str) -> DataFrame:
    """Opt-in sketches, an extension; exact counts are elsewhere."""
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey").alias("orders"), F.percentile_approx("l_quantity", 0.5).alias("median"))


@query("pool_minmax_rank", "SELECT l_orderkey, l_linenumber, round(CASE WHEN hi - lo < 1e-15 THEN 0.5 ELSE (l_quantity - lo) / (hi - lo) END, 9) AS up, round(CASE WHEN hi - lo < 1e-15 THEN 0.0 ELSE (hi - l_quantity) / (hi - lo) END, 9) AS down FROM (SELECT *, min(l_quantity) OVER w AS lo, max(l_quantity) OVER w AS hi FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))")
def pool_minmax_rank(spark: Session, sf: str) -> DataFrame:
    """Both conventions for a pool of equals."""
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(rank.rank01("l_quantity", "l_orderkey"), 9).alias("up"), F.round(rank.rank01("l_quantity", "l_orderkey", False, 0.0), 9).alias("down"))


@query("pool_zscore", "SELECT l_orderkey, l_linenumber, round((l_extendedprice - avg(l_extendedprice) OVER w) / (stddev_pop(l_extendedprice) OVER w + 1e-8), 4) + 0 AS z FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1) WINDOW w AS (PARTITION BY l_orderkey)")
def pool_zscore(spark: Session, sf: str) -> DataFrame:
    """W2."""
    n = F.count("*").over(Window.partitionBy("l_orderkey"))
    return table(spark, sf, "lineitem").withColumn("n", n).filter("n > 1").select("l_orderkey", "l_linenumber", F.round(rank.zscore("l_extendedprice", "l_orderkey"), 4).alias("z"))


@query("upper_median_penalty", "SELECT l_orderkey, l_linenumber, round(-abs(ln(l_quantity / s[len(s) // 2 + 1])), 9) + 0 AS penalty FROM (SELECT l_orderkey, l_linenumber, l_quantity, list_sort(list(l_quantity) OVER (PARTITION BY l_orderkey)) AS s FROM lineitem)")
def upper_median_penalty(spark: Session, sf: str) -> DataFrame:
    """W3."""
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(rank.length_penalty("l_quantity", "l_orderkey"), 9).alias("penalty"))


@query("bucket_caps", "SELECT p_size, count(*) AS n, max(p_partkey) AS last FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS r FROM part) WHERE r <= 8 GROUP BY p_size")
def bucket_caps(spark: Session, sf: str) -> DataFrame:
    """The first eight of each bucket; the rank filter is pushed below the shuffle by the optimizer."""
    w = Window.partitionBy("p_size").orderBy("p_partkey")
    return table(spark, sf, "part").withColumn("r", F.row_number().over(w)).filter("r <= 8").groupBy("p_size").agg(F.count("*").alias("n"), F.max("p_partkey").alias("last"))


@query("even_length_sample", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE i % greatest(1, n // 20) = 0 AND i / greatest(1, n // 20) < 20")
def even_length_sample(spark: Session, sf: str) -> DataFrame:
    """W5."""
    return corpus.even_sample(table(spark, sf, "documents").select("lang", "doc_id", "n_chars"), "lang", ["n_chars", "doc_id"], 20).select("lang", "doc_id")


@query("zipf_weights", f"SELECT word, n, rank, round(1 / rank::DOUBLE, 9) AS weight FROM (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM (SELECT word, count(*) AS n FROM (SELECT unnest({Q.tokens('text')}) AS word FROM benchmark) GROUP BY word))")
def zipf_weights(spark: Session, sf: str) -> DataFrame:
    """Global ranks numbered per range partition, no single-task window over the vocabulary."""
    n = table(spark, sf, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return rank.zipf(n).select("word", "n", "rank", F.round("weight", 9).alias("weight"))


@query("first_and_last_wins", "SELECT p_type, arg_min(p_name, p_partkey) AS first, arg_max(p_name, p_partkey) AS last FROM part GROUP BY p_type")
def first_and_last_wins(spark: Session, sf: str) -> DataFrame:
    """W7."""
    p = table(spark, sf, "part").select("p_type", "p_name", F.col("p_partkey").alias("ord"))
    return p.groupBy("p_type").agg(F.min_by("p_name", "ord").alias("first"), F.max_by("p_name", "ord").alias("last"))


@query("running_best_plateau", "SELECT conv_id, turn, best::INT AS best, turn - max(CASE WHEN n > coalesce(before, -1) THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS since FROM (SELECT conv_id, turn, length(text) AS n, max(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS best, max(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conversations)")
def running_best_plateau(spark: Session, sf: str) -> DataFrame:
    """Best so far, and rounds since it improved."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    c = c.select("conv_id", "turn", "n", F.max("n").over(w).alias("best"), F.max("n").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    up = F.max(F.when(F.col("n") > F.coalesce("before", F.lit(-1)), F.col("turn"))).over(w)
    return c.select("conv_id", "turn", "best", (F.col("turn") - up).alias("since"))


@query("recency_scores", "SELECT conv_id, turn, round(turn * 0.1 + (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) * 0.01 + CASE WHEN contains(text, 'tion') THEN 3.0 ELSE 0 END - CASE WHEN len(regexp_extract_all(text, 'the')) >= 3 THEN 2.0 ELSE 0 END, 9)::DOUBLE AS score FROM conversations")
def recency_scores(spark: Session, sf: str) -> DataFrame:
    """W9."""
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    s = F.col("turn") * 0.1 + i * 0.01 + F.when(F.col("text").contains("tion"), 3.0).otherwise(0.0) - F.when(T.count_of(F.col("text"), "the") >= 3, 2.0).otherwise(0.0)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.round(s, 9).alias("score"))


@query("turn_context", "SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, least(3 + turn // 3, 20) AS hits FROM conversations")
def turn_context(spark: Session, sf: str) -> DataFrame:
    """The previous turn and a growing window of hits."""
    return table(spark, sf, "conversations").select("conv_id", "turn", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before"), F.least(F.lit(3) + F.floor(F.col("turn") / 3), F.lit(20)).alias("hits"))


@query("window_frames", "SELECT o_custkey, o_orderkey, (ntile(4) OVER w)::INT AS quarter, lead(o_orderkey) OVER w AS next, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def window_frames(spark: Session, sf: str) -> DataFrame:
    """Frames, an extension."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.ntile(4).over(w).alias("quarter"), F.lead("o_orderkey").over(w).alias("next"), F.round(F.avg("o_totalprice").over(w.rowsBetween(-2, 0)), 4).alias("moving"))


@query("stable_sort", "SELECT p_size, lower(p_name) AS name, p_partkey FROM part ORDER BY p_size, lower(p_name), p_partkey")
def stable_sort(spark: Session, sf: str) -> DataFrame:
    """K1: a range-partitioned total order."""
    return table(spark, sf, "part").select("p_size", F.lower("p_name").alias("name"), "p_partkey").orderBy("p_size", "name", "p_partkey")


@query("top_k_per_group", "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 5")
def top_k_per_group(spark: Session, sf: str) -> DataFrame:
    """K2: five of each group; the optimizer limits each task's groups before the shuffle."""
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").withColumn("r", F.row_number().over(w)).filter("r <= 5").select("o_orderpriority", "o_orderkey")


@query("longest_key_first", f"SELECT form, length(form)::INT AS n FROM {SQL_NAMES} ORDER BY n DESC, form LIMIT 30")
def longest_key_first(spark: Session, sf: str) -> DataFrame:
    """K4."""
    return names(spark, sf).select("form", F.length("form").alias("n")).orderBy(F.desc("n"), "form").limit(30)


@query("shortest_forms", f"SELECT form FROM {SQL_NAMES} ORDER BY length(form), form LIMIT 40")
def shortest_forms(spark: Session, sf: str) -> DataFrame:
    """K5, K6: a capped table in a total order."""
    return names(spark, sf).orderBy(F.length("form"), "form").limit(40)


@query("union_precedence", "SELECT k, arg_max(v, r) AS v FROM (SELECT p_type AS k, min(p_name) AS v, 0 AS r FROM part GROUP BY 1 UNION ALL SELECT p_type, max(p_name), 1 FROM part WHERE p_size > 40 GROUP BY 1) GROUP BY k")
def union_precedence(spark: Session, sf: str) -> DataFrame:
    """U2."""
    p = table(spark, sf, "part")
    a = p.groupBy(F.col("p_type").alias("k")).agg(F.min("p_name").alias("v"))
    b = p.filter("p_size > 40").groupBy(F.col("p_type").alias("k")).agg(F.max("p_name").alias("v"))
    return merge.union_by_precedence([a, b], ["k"])


@query("pool_unions", "SELECT sent_id, hyp, max(score) AS score FROM (SELECT l_orderkey AS sent_id, l_returnflag AS hyp, l_quantity AS score FROM lineitem UNION ALL SELECT l_orderkey, l_linestatus, l_quantity / 2 FROM lineitem) GROUP BY ALL")
def pool_unions(spark: Session, sf: str) -> DataFrame:
    """U3."""
    li = table(spark, sf, "lineitem")
    pool = lambda c, s: li.select(F.col("l_orderkey").alias("sent_id"), F.col(c).alias("hyp"), s.alias("score"))
    return merge.pool_union([pool("l_returnflag", F.col("l_quantity")), pool("l_linestatus", F.col("l_quantity") / 2)])


@query("contamination_antijoin", f"""
WITH g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [] END) AS g FROM (SELECT doc_id, {Q.tokens('text')} AS w FROM documents)),
b AS (SELECT DISTINCT unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [] END) AS g FROM (SELECT {Q.tokens('text')} AS w FROM benchmark))
SELECT doc_id, count(*) AS shared FROM g JOIN b USING (g) GROUP BY doc_id""")
def contamination_antijoin(spark: Session, sf: str) -> DataFrame:
    """Semi-join of n-grams between documents and an evaluation set."""
    five = lambda t, *keep: T.explode_ngrams(table(spark, sf, t), list(keep), T.tokens(F.col("text")), 5).distinct()
    return five("documents", "doc_id").join(five("benchmark"), "g", "left_semi").groupBy("doc_id").agg(F.count("*").alias("shared"))


@query("key_set_operations", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT p_partkey FROM part WHERE p_size > 25) UNION ALL SELECT 'only', count(*) FROM (SELECT p_partkey FROM part WHERE p_size > 25 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def key_set_operations(spark: Session, sf: str) -> DataFrame:
    """U4."""
    a = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("k"))
    b = table(spark, sf, "part").filter("p_size > 25").select(F.col("p_partkey").alias("k"))
    n = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n(a.intersect(b), "both").union(n(b.subtract(a), "only"))


@query("cluster_sets", f"""
WITH c AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey % 7)) AS s FROM lineitem GROUP BY l_orderkey)
SELECT array_to_string(s, '|') AS members, count(*) AS n, any_value(list_has_any(s, [0, 3])) AS touches FROM c GROUP BY s""")
def cluster_sets(spark: Session, sf: str) -> DataFrame:
    """Orders as sets of seven classes of suppliers; equal sets are one, and some overlap a given one."""
    c = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_suppkey") % 7)).alias("s"))
    touches = F.arrays_overlap("s", F.array(F.lit(0).cast("long"), F.lit(3).cast("long")))
    return c.groupBy(F.array_join(F.col("s").cast("array<string>"), "|").alias("members")).agg(F.count("*").alias("n"), F.bool_or(touches).alias("touches"))


@query("greedy_knowledge_dedupe")
def greedy_knowledge_dedupe(spark: Session, sf: str) -> DataFrame:
    """Id or text seen before, in order, per conversation."""
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("ord"), F.col("role").alias("id"), "text")
    return merge.greedy_dedupe(c, "conv_id", 8)
