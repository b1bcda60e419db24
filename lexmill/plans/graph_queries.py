"""Queries of graphs, iteration, conversation and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import corpus, graph, iterate, lookup, merge, retrieve, votes
from lexmill.plans import sql as Q
from lexmill.plans.function_queries import SQL_NAMES, SQL_TURNS, _turns, names
from lexmill.plans.join_queries import SQL_BINDINGS, SQL_MISSPELT, SQL_STORE, bindings, misspelt, store
from lexmill.plans.registry import query
from lexmill.session import shared_path, table
from lexmill.sources import sinks
from lexmill.streaming import streams

Session = SparkSession


@query("graph_build", f"""
SELECT kind, count(*) AS n FROM (
  SELECT DISTINCT 'node:sense' AS kind, sense AS a, '' AS b, '' AS c FROM {SQL_BINDINGS} UNION SELECT DISTINCT 'node:form', lang, form, '' FROM {SQL_BINDINGS} UNION SELECT DISTINCT 'node:language', lang, '', '' FROM {SQL_BINDINGS}
  UNION SELECT DISTINCT 'edge:expresses', lang, form, sense FROM {SQL_BINDINGS} UNION SELECT DISTINCT 'edge:realized_as', sense, lang, form FROM {SQL_BINDINGS} UNION SELECT DISTINCT 'edge:in_language', lang, form, '' FROM {SQL_BINDINGS}) GROUP BY kind""")
def graph_build(spark: Session, sf: str) -> DataFrame:
    """Nodes and unique edges, written and read again."""
    nodes, edges = graph.build(bindings(spark, sf))
    path = shared_path(spark, "graph")
    sinks.write_graph(nodes, edges, path)
    nodes, edges = sinks.read_graph(spark, path)
    n = nodes.groupBy(F.concat(F.lit("node:"), "kind").alias("kind")).agg(F.count("*").alias("n"))
    return n.unionByName(edges.groupBy(F.concat(F.lit("edge:"), "rel").alias("kind")).agg(F.count("*").alias("n")))


@query("hub_neighbourhood", f"SELECT sense, lang, list(form ORDER BY o) AS forms FROM (SELECT sense, lang, form, min(ord) AS o FROM {SQL_BINDINGS} GROUP BY ALL) GROUP BY sense, lang")
def hub_neighbourhood(spark: Session, sf: str) -> DataFrame:
    """G2."""
    return graph.neighbourhood(bindings(spark, sf))


@query("note_export", f"SELECT sense, count(*) AS lines FROM (SELECT DISTINCT sense, lang, form FROM {SQL_BINDINGS}) GROUP BY sense")
def note_export(spark: Session, sf: str) -> DataFrame:
    """One Markdown text per sense, read back and counted."""
    path = shared_path(spark, "notes")
    sinks.export_notes(bindings(spark, sf), path)
    notes = spark.read.text(path)
    return notes.filter(F.col("value").startswith("- ")).groupBy("sense").agg(F.count("*").alias("lines"))


@query("hole_filling", """
WITH b AS (SELECT DISTINCT n_regionkey AS sense, c_mktsegment AS lang FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9800),
h AS (SELECT r_regionkey AS sense, s.lang FROM region, (SELECT DISTINCT c_mktsegment AS lang FROM customer) s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.sense = r_regionkey AND b.lang = s.lang)),
g AS (SELECT n_regionkey AS sense, c_mktsegment AS lang, c_name AS form, c_acctbal / 10000 AS confidence, c_custkey AS ord FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal / 10000 >= 0.85 AND length(c_name) <= 32 AND NOT contains(c_name, ' '))
SELECT sense, lang, form, round(confidence, 9) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY sense, lang ORDER BY confidence DESC, ord) AS r FROM g JOIN h USING (sense, lang)) WHERE r = 1""")
def hole_filling(spark: Session, sf: str) -> DataFrame:
    """G4, G3."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    gold = c.select(F.col("n_regionkey").alias("sense"), F.col("c_mktsegment").alias("lang"), F.col("c_name").alias("form"), (F.col("c_acctbal") / 10000).alias("confidence"), F.col("c_custkey").alias("ord"))
    missing = graph.holes(gold.filter("confidence > 0.98"), table(spark, sf, "region").select(F.col("r_regionkey").alias("sense")), gold.select("lang").distinct())
    return graph.fill(missing, gold).select("sense", "lang", "form", F.round("confidence", 9).alias("confidence"))


def _domains(spark: Session, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return n.select(F.col("n_nationkey").alias("idx"), F.concat(F.col("n_regionkey").cast("string"), F.lit("_"), F.lower("n_name")).alias("name"), (F.col("n_nationkey") / 50.0).alias("scalar"), F.when(F.col("n_regionkey") == 0, "abstract").otherwise(F.col("n_regionkey").cast("string")).alias("family"))


@query("domain_graph_edges", """
WITH d AS (SELECT n_nationkey AS i, n_regionkey AS r, n_nationkey / 50.0::DOUBLE AS s FROM nation),
p AS (SELECT a.i AS i, b.i AS j, CASE WHEN a.r = b.r AND a.r <> 0 THEN 0.55 ELSE 0 END + 0.25 * (1 - abs(a.s - b.s)) + CASE WHEN a.r = b.r THEN 0.2 ELSE 0 END AS w, (b.i - a.i = 1 OR (a.i = 0 AND b.i = 24)) AS ring FROM d a JOIN d b ON a.i < b.i),
k AS (SELECT i, j, CASE WHEN ring THEN greatest(CASE WHEN w > 0.15 THEN w ELSE 0 END, 0.08) WHEN w > 0.15 THEN w ELSE 0 END AS w FROM p)
SELECT i, j, round(w, 9) AS w FROM k WHERE w > 0 UNION ALL SELECT j, i, round(w, 9) FROM k WHERE w > 0""")
def domain_graph_edges(spark: Session, sf: str) -> DataFrame:
    """Weights between at most 80 domains."""
    return graph.domain_edges(_domains(spark, sf)).select("i", "j", F.round("w", 9).alias("w"))


def _attention_sql() -> str:
    soft = "SELECT *, exp((x - max(x) OVER ()) / 0.85) / sum(exp((x - mx) / 0.85)) OVER () AS h FROM (SELECT *, max(x) OVER () AS mx FROM ({}))"
    parts = [
        "d AS (SELECT n_nationkey AS i, n_regionkey AS r, n_nationkey / 50.0::DOUBLE AS s, CASE WHEN n_nationkey = 7 THEN 1.0 ELSE 0.0 END::DOUBLE AS q FROM nation)",
        "p AS (SELECT a.i AS i, b.i AS j, CASE WHEN a.r = b.r AND a.r <> 0 THEN 0.55 ELSE 0 END + 0.25 * (1 - abs(a.s - b.s)) + CASE WHEN a.r = b.r THEN 0.2 ELSE 0 END AS w, (b.i - a.i = 1 OR (a.i = 0 AND b.i = 24)) AS ring FROM d a JOIN d b ON a.i < b.i)",
        "k AS (SELECT i, j, CASE WHEN ring THEN greatest(CASE WHEN w > 0.15 THEN w ELSE 0 END, 0.08) WHEN w > 0.15 THEN w ELSE 0 END AS w FROM p)",
        "e AS (SELECT i, j, w FROM k WHERE w > 0 UNION ALL SELECT j, i, w FROM k WHERE w > 0)", "g AS (SELECT i, sum(w) AS deg FROM e GROUP BY i)",
        f"h0 AS ({soft.format('SELECT i, 3.0 * (0.65 * q + 0.35 * (0.5 + 0.5 * tanh(s)) * q) AS x FROM d')})",
    ]
    for n in range(1, 5):
        sent = f"(SELECT e.i, sum(e.w * h) AS m FROM e JOIN h{n - 1} z ON z.i = e.j GROUP BY e.i)"
        x = f"SELECT d.i, 2.5 * (0.4 * z.h + 0.6 * (0.55 * coalesce(m / sqrt(deg), 0) + 0.45 * q * (1 + abs(s)))) AS x FROM d JOIN h{n - 1} z ON z.i = d.i LEFT JOIN {sent} y ON y.i = d.i LEFT JOIN g ON g.i = d.i"
        parts.append(f"h{n} AS ({soft.format(x)})")
    return f"WITH {', '.join(parts)} SELECT i AS idx, round(h, 9) AS p FROM h4"


@query("multi_hop_attention", _attention_sql())
def multi_hop_attention(spark: Session, sf: str) -> DataFrame:
    """A query spread over the domain graph in unrolled hops."""
    d = _domains(spark, sf)
    q = d.select("idx", F.when(F.col("idx") == 7, 1.0).otherwise(0.0).alias("q"))
    return graph.attention(d, graph.domain_edges(d), q).select("idx", F.round("p", 9).alias("p"))


@query("climb_loop", f"""
SELECT token, arg_max(meaning, length(form)) AS meaning FROM (SELECT token, left(token, unnest(range(greatest(3, length(token) - 4), length(token) + 1))) AS cut FROM {SQL_MISSPELT}) JOIN {SQL_STORE} ON form = cut GROUP BY token""")
def climb_loop(spark: Session, sf: str) -> DataFrame:
    """Score, learn from misses, repeat to a plateau; the state is written each round. Training and
    evaluation keys are kept apart, so what is learnt from a miss is a stem and never the evaluated form."""
    return iterate.climb(misspelt(spark, sf), store(spark, sf), rounds=3)


@query("stem_install", f"""
SELECT stem, meaning FROM (SELECT stem, arg_min(meaning, (length(meaning), meaning)) AS meaning FROM (SELECT left(form, unnest(range(greatest(3, length(form) - 9), length(form)))) AS stem, meaning FROM {SQL_STORE} WHERE length(form) > 3) GROUP BY stem)
WHERE stem NOT IN (SELECT form FROM {SQL_NAMES})""")
def stem_install(spark: Session, sf: str) -> DataFrame:
    """Stems of labelled forms, the shortest gloss wins, evaluated forms excluded. Opt-in: it leaks labels into what it
    helps to score."""
    s = store(spark, sf)
    stems = s.select(F.explode(T.truncations(F.col("form"))).alias("stem"), "meaning")
    best = stems.groupBy("stem").agg(F.min_by("meaning", F.struct(F.length("meaning"), "meaning")).alias("meaning"))
    return best.join(s, F.col("stem") == F.col("form"), "left_anti")


@query("greedy_phrase_decode")
def greedy_phrase_decode(spark: Session, sf: str) -> DataFrame:
    """Greedy decoding with a phrase table learnt from adjacent turns."""
    best = corpus.best_partners(_turns(spark, sf), "hyp", "ref")
    c = table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("id"), "text")
    return corpus.decode(c, best).select("id.conv_id", "id.turn", "out")


@query("pair_install", f"""
SELECT key, arg_min(value, (id, i)) AS value FROM (
  SELECT id, i - 1 AS i, s[i] AS key, t[least((i - 1) * len(t) // len(s), len(t) - 1) + 1] AS value FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM (SELECT id, {Q.tokens('hyp')} AS s, {Q.tokens('ref')} AS t FROM {SQL_TURNS}) WHERE len(s) > 0 AND len(t) > 0)) GROUP BY key""")
def pair_install(spark: Session, sf: str) -> DataFrame:
    """G10."""
    return corpus.install_pairs(_turns(spark, sf).withColumnRenamed("hyp", "src"))


@query("product_picks", """
WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity, l_tax, l_discount FROM lineitem)
SELECT l_orderkey, arg_max(l_linenumber, (l_quantity, -l_linenumber)) AS by_gen, arg_min(l_linenumber, (l_tax, l_linenumber)) AS by_nll, arg_max(l_linenumber, (l_quantity / 50 + 2 * l_discount, -l_linenumber)) AS by_weights FROM c GROUP BY l_orderkey""")
def product_picks(spark: Session, sf: str) -> DataFrame:
    """Several pickers in one aggregate."""
    n = F.col("l_linenumber")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.max_by("l_linenumber", F.struct("l_quantity", -n)).alias("by_gen"), F.min_by("l_linenumber", F.struct("l_tax", n)).alias("by_nll"),
        F.max_by("l_linenumber", F.struct(F.col("l_quantity") / 50 + 2 * F.col("l_discount"), -n)).alias("by_weights"),
    )


@query("route_decisions", f"""
SELECT doc_id, CASE WHEN lang IN ('de') OR n >= 16 THEN 'neural' WHEN lang IN ('fr') OR (n <= 10 AND CASE WHEN n = 0 THEN 0 ELSE k / n::DOUBLE END >= 0.85) THEN 'densify' ELSE 'neural' END AS route
FROM (SELECT doc_id, lang, len(t) AS n, len(list_filter(t, lambda x: x IN ('the', 'and', 'of', 'in'))) AS k FROM (SELECT doc_id, lang, {Q.tokens('text')} AS t FROM documents))""")
def route_decisions(spark: Session, sf: str) -> DataFrame:
    """G12."""
    d = table(spark, sf, "documents").select("doc_id", "lang", T.tokens(F.col("text")).alias("t"))
    known = F.size(F.filter("t", lambda x: x.isin("the", "and", "of", "in")))
    return d.select("doc_id", retrieve.coverage_route(F.col("lang"), F.col("t"), known, ["de"], ["fr"]).alias("route"))


@query("conversation_turns", f"""
SELECT conv_id, turn, role, n AS tokens, sum(n) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS so_far, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 'follow_up' WHEN role = 'user' THEN 'ask' ELSE 'reply' END AS kind
FROM (SELECT conv_id, turn, role, len({Q.tokens('text')}) AS n FROM conversations)""")
def conversation_turns(spark: Session, sf: str) -> DataFrame:
    """Turns in order with their context."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.size(T.tokens(F.col("text"))).cast("long").alias("tokens"))
    kind = F.when(F.lag("role").over(w) == F.col("role"), "follow_up").when(F.col("role") == "user", "ask").otherwise("reply")
    return c.select("conv_id", "turn", "role", "tokens", F.sum("tokens").over(w).alias("so_far"), kind.alias("kind"))


SQL_PLANS = (
    "(SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'english_meta' WHEN 1 THEN 'mixed' ELSE 'science_query' END AS mode, o_custkey % 4 AS u, o_orderkey % 9 AS t, (o_custkey % 10) / 10.0::DOUBLE AS r,"
    " o_custkey % 2 AS session, o_orderkey % 5 % 2 AS archive, o_custkey % 6 AS ledger, o_orderkey % 2 AS teach FROM orders)"
)


@query("densify_plans", f"""
SELECT id, len(reasons)::INT AS n_reasons, len(reasons) >= 2 OR (u >= 2 AND archive = 0) AS thin, CASE WHEN len(reasons) >= 2 OR u >= 1 THEN array_to_string(acts[1:3], ',') ELSE '' END AS actions FROM (
  SELECT *, list_filter([CASE WHEN u >= 2 THEN 'u' END, CASE WHEN t > 0 AND u >= 0.4 * t THEN 'h' END, CASE WHEN r < 0.45 THEN 'l' END, CASE WHEN session = 0 THEN 's' END, CASE WHEN archive = 0 THEN 'a' END, CASE WHEN ledger < 2 THEN 'd' END, CASE WHEN mode = 'english_meta' AND teach = 0 THEN 'm' END], lambda x: x IS NOT NULL) AS reasons,
    list_filter([CASE WHEN mode = 'english_meta' THEN 'teach_inject' END, CASE WHEN archive = 0 THEN 'archive_note' END, CASE WHEN u >= 2 THEN 'lexicon_seed' END, CASE WHEN ledger < 2 THEN 'ledger_claim' END], lambda x: x IS NOT NULL) AS acts
  FROM {SQL_PLANS})""")
def densify_plans(spark: Session, sf: str) -> DataFrame:
    """A plan for each order, whose keys stand for what is known of a turn."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf, "orders").select(
        o.alias("id"), F.when(o % 3 == 0, "english_meta").when(o % 3 == 1, "mixed").otherwise("science_query").alias("mode"), (c % 4).alias("unresolved"), (o % 9).alias("tokens"),
        (c % 10 / 10.0).alias("map_rate"), (c % 2).alias("session"), (o % 5 % 2).alias("archive"), (c % 6).alias("ledger"), (o % 2).alias("teach"),
    )
    return retrieve.densify_plan(rows).select("id", F.size("reasons").alias("n_reasons"), "thin", F.array_join("actions", ",").alias("actions"))


@query("gap_acceptance", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN meta AND sim >= 0.88 AND n >= 2 THEN 'high_sim_meta_donor' WHEN meta THEN 'meta_meaning_blocked' WHEN sim >= 0.74 AND n >= 1 THEN 'high_form_similarity' WHEN sim >= 0.58 AND n >= 2 THEN 'moderate_sim_multi_neighbor'
  WHEN sim >= 0.48 AND n >= 3 AND content >= 0.5 THEN 'neighborhood_vote_content' WHEN sim >= 0.70 AND content >= 0.7 THEN 'high_sim_content_gloss' ELSE 'below_evidence_threshold' END AS reason,
  CASE WHEN sim >= 0.75 AND n >= 1 THEN 'high_form_similarity' WHEN sim >= 0.55 AND n >= 3 THEN 'moderate_sim_multi_neighbor' WHEN n >= 5 AND sim >= 0.4 THEN 'strong_neighborhood_vote' ELSE 'below_evidence_threshold' END AS lineage
FROM (SELECT *, l_discount * 9.3 AS sim, l_linenumber - 1 AS n, l_quantity / 50 AS content, l_returnflag = 'R' AS meta FROM lineitem)""")
def gap_acceptance(spark: Session, sf: str) -> DataFrame:
    """Both acceptance gates over the lines of orders as proposals."""
    c = F.col
    sim, n = c("l_discount") * 9.3, c("l_linenumber") - 1
    reason = votes.gap_gate(sim, n, c("l_quantity") / 50, c("l_returnflag") == "R")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", reason.alias("reason"), votes.lineage_gate(sim, n).alias("lineage"))


SQL_WRONG = f"(SELECT DISTINCT left(form, length(form) - 1) || 'x' AS a FROM {SQL_NAMES} WHERE length(form) >= 5)"


SQL_LIKE = f"0.65 * {Q.edit_similarity('x.a', 'y.form')} + 0.35 * {Q.dice('x.a', 'y.form')}"


@query("gap_fill_votes", f"""
WITH p AS (SELECT a, form AS b, sim FROM (SELECT x.a, y.form, {SQL_LIKE} AS sim FROM {SQL_WRONG} x JOIN {SQL_NAMES} y ON left(x.a, 1) = left(y.form, 1) AND abs(length(x.a) - length(y.form)) <= 3 AND x.a <> y.form) WHERE sim >= 0.35),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b DESC) AS r FROM p) WHERE r <= 5),
v AS (SELECT a, meaning, sum(sim) AS w, max(sim) AS sim, count(*) FILTER (sim >= 0.45) AS n FROM t JOIN {SQL_STORE} ON form = b GROUP BY ALL),
z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, meaning DESC) AS r FROM v) WHERE r = 1)
SELECT a, meaning, round(sim, 9) AS similarity, CASE WHEN sim >= 0.74 AND n >= 1 THEN 'high_form_similarity' WHEN sim >= 0.58 AND n >= 2 THEN 'moderate_sim_multi_neighbor'
  WHEN sim >= 0.48 AND n >= 3 THEN 'neighborhood_vote_content' ELSE 'below_evidence_threshold' END AS reason FROM z""")
def gap_fill_votes(spark: Session, sf: str) -> DataFrame:
    """For unknown forms the five nearest of the lexicon vote, and the gate decides."""
    from lexmill.operators.similarity import band_pairs, top_donors

    n = names(spark, sf)
    unknown = n.filter(F.length("form") >= 5).select(F.concat(F.substr("form", F.lit(1), F.length("form") - 1), F.lit("x")).alias("a"))
    top = top_donors(band_pairs(unknown, n.select(F.col("form").alias("b"))))
    each = top.select("a", F.explode("top").alias("x")).select("a", F.col("x.similarity").alias("sim"), F.col("x.b").alias("b"))
    voted = each.join(store(spark, sf), F.col("b") == F.col("form")).groupBy("a", "meaning").agg(F.sum("sim").alias("w"), F.max("sim").alias("sim"), F.count_if(F.col("sim") >= 0.45).alias("n"))
    best = voted.groupBy("a").agg(F.max_by(F.struct("meaning", "sim", "n"), F.struct("w", "meaning")).alias("r")).select("a", "r.*")
    return best.select("a", "meaning", F.round("sim", 9).alias("similarity"), votes.gap_gate(F.col("sim"), F.col("n"), F.lit(0.5), F.lit(False)).alias("reason"))


@query("runtime_inject", f"SELECT form, CASE WHEN length(form) = 5 THEN 'new' ELSE meaning END AS gloss, CASE WHEN length(form) = 5 THEN 0.9 ELSE 0.5 END::DOUBLE AS score FROM {SQL_STORE}")
def runtime_inject(spark: Session, sf: str) -> DataFrame:
    """Injected forms replace weaker ones."""
    s = store(spark, sf).select("form", F.col("meaning").alias("gloss"), F.lit(0.5).alias("score"))
    new = s.filter(F.length("form") == 5).select("form", F.lit("new").alias("gloss"), F.lit(0.9).alias("score"))
    weak = s.filter(F.length("form") == 6).select("form", F.lit("weak").alias("gloss"), F.lit(0.1).alias("score"))
    return merge.inject(s, new.unionByName(weak))


@query("registered_functions", f"SELECT {Q.slug('p_name')} AS slug, count(*) AS n FROM part GROUP BY 1")
def registered_functions(spark: Session, sf: str) -> DataFrame:
    """A SQL function registered in the session; it is inlined, so it stays inside generated code."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION lexmill_slug(x STRING) RETURNS STRING RETURN regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '_'), '^_+|_+$', '')")
    return table(spark, sf, "part").select(F.expr("lexmill_slug(p_name)").alias("slug")).groupBy("slug").agg(F.count("*").alias("n"))


@query("judge_choice", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN p_size + 100 END::INT AS choice FROM part")
def judge_choice(spark: Session, sf: str) -> DataFrame:
    """The choice in a judge's answer, one for each part; the judge itself is out of scope."""
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    answer = F.when(k == 0, F.concat(F.lit("I choose candidate "), size, F.lit(", not 7."))).when(k == 1, F.concat(F.lit("Answer: "), (F.col("p_size") + 100).cast("string"))).otherwise("none of them")
    return table(spark, sf, "part").select("p_partkey", F.nullif(F.regexp_extract(answer, r"(\d+)", 1), F.lit("")).cast("int").alias("choice"))


@query("event_windows", "SELECT epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: Session, sf: str) -> DataFrame:
    """Tumbling windows, an extension; streams.windowed() is the same over a stream."""
    w = streams.windowed(table(spark, sf, "events"), "1 hour")
    return w.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("sliding_windows", """
WITH b AS (SELECT epoch(time_bucket(INTERVAL '15 minutes', ts))::BIGINT AS b, event_type, value FROM events),
w AS (SELECT unnest([b, b - 900, b - 1800, b - 2700]) AS start, event_type, value FROM b)
SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""")
def sliding_windows(spark: Session, sf: str) -> DataFrame:
    """Windows of an hour that start every 15 minutes."""
    e = table(spark, sf, "events").groupBy(F.window("ts", "1 hour", "15 minutes").alias("w"), "event_type")
    return e.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_timestamp("w.start").alias("start"), "event_type", "n", "total")


@query("cube_of_flags", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS level, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_of_flags(spark: Session, sf: str) -> DataFrame:
    """Every combination of two keys."""
    c = table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus")
    return c.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("grouping_sets_of_flags", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
def grouping_sets_of_flags(spark: Session, sf: str) -> DataFrame:
    """Chosen combinations in one pass."""
    li = table(spark, sf, "lineitem")
    sets = li.groupingSets([["l_returnflag", "l_linestatus"], ["l_linenumber"], []], "l_returnflag", "l_linestatus", "l_linenumber")
    return sets.agg(F.count("*").alias("n"))


@query("session_windows", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: Session, sf: str) -> DataFrame:
    """Sessions with a gap of 30 minutes."""
    e = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.unix_timestamp("w.start").alias("start"), "n")


@query("watermarked_stream", """
SELECT epoch(start)::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, value FROM events) w
WHERE w.start + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes' GROUP BY w.start, event_type""")
def watermarked_stream(spark: Session, sf: str) -> DataFrame:
    """R2: the windows of a stream of files that its watermark has closed, run until no input is left."""
    w = streams.run_available(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema)
    return w.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("session_rate_limit", """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT user_id, event_id, k, true AS admitted, t AS last, t AS hour, 1 AS n FROM e WHERE k = 1
  UNION ALL SELECT user_id, event_id, k, ok, CASE WHEN ok THEN t ELSE last END, CASE WHEN near THEN hour WHEN fresh THEN t ELSE hour END, CASE WHEN near THEN n WHEN fresh THEN 1 WHEN ok THEN n + 1 ELSE n END
  FROM (SELECT *, NOT near AND (fresh OR n < 40) AS ok FROM (SELECT e.user_id, e.event_id, e.k, e.t, s.last, s.hour, s.n, e.t - s.last < 2 AS near, e.t - s.hour > 3600 AS fresh FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)))
SELECT user_id, event_id, admitted FROM s""")
def session_rate_limit(spark: Session, sf: str) -> DataFrame:
    """At least two seconds between actions and at most 40 an hour from an hour's first action, per user."""
    return streams.rate_limited(table(spark, sf, "events").select("user_id", "ts", "event_id"))


@query("memo_cache", f"SELECT token, meaning FROM (SELECT DISTINCT unnest({Q.words('p_name')}) AS token FROM part) JOIN {SQL_STORE} ON form = token")
def memo_cache(spark: Session, sf: str) -> DataFrame:
    """Distinct tokens are resolved once, which is what a memo would save."""
    toks = table(spark, sf, "part").select(F.explode(T.words(F.col("p_name"))).alias("token")).dropDuplicates(["token"])
    return lookup.cascade(toks, [("exact", store(spark, sf), F.col("token"), 1.0)]).filter("stage = 'exact'").select("token", "meaning")


@query("memory_recall", "SELECT ord, value FROM (SELECT doc_id * 1000000 + i - 1 AS ord, ls[i] AS value FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))) WHERE contains(lower(value), 'tion') ORDER BY ord LIMIT 3")
def memory_recall(spark: Session, sf: str) -> DataFrame:
    """The first three lines that contain a text."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "value")).select((F.col("doc_id") * 1000000 + F.col("i")).alias("ord"), "value")
    return retrieve.recall(lines, "tion")
