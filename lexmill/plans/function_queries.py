"""Queries of string and number functions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import gloss as G
from lexmill.functions import scalar as S
from lexmill.functions import text as T
from lexmill.operators import rank, retrieve
from lexmill.plans import sql as Q
from lexmill.plans.registry import query
from lexmill.session import table

Session = SparkSession


def vocabulary(spark: Session, sf: str) -> DataFrame:
    """lang, token, n of the documents."""
    return table(spark, sf, "documents").select("lang", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n"))


def names(spark: Session, sf: str) -> DataFrame:
    """form: distinct words of part names."""
    return table(spark, sf, "part").select(F.explode(T.words(F.col("p_name"))).alias("form")).distinct()


SQL_NAMES = f"(SELECT DISTINCT unnest({Q.words('p_name')}) AS form FROM part)"


@query("doc_token_counts", f"SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest({Q.tokens('text')}) AS token FROM documents) GROUP BY lang, token")
def doc_token_counts(spark: Session, sf: str) -> DataFrame:
    """F14, A2."""
    return vocabulary(spark, sf)


@query("doc_vocab_topk", f"SELECT token, count(*) AS n FROM (SELECT unnest({Q.tokens('text')}) AS token FROM documents) GROUP BY token ORDER BY n DESC, token LIMIT 50")
def doc_vocab_topk(spark: Session, sf: str) -> DataFrame:
    """Top-k by partial top-k of each task."""
    n = table(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "token").limit(50)


@query("diacritic_fold", f"SELECT fold, count(*) AS forms FROM (SELECT DISTINCT token, strip_accents(token) AS fold FROM (SELECT unnest({Q.words('text', '[a-zà-öø-ÿ]+')}) AS token FROM documents)) GROUP BY fold HAVING count(*) > 1")
def diacritic_fold(spark: Session, sf: str) -> DataFrame:
    """full fold of distinct forms only, in an Arrow function, as Spark has no decomposition."""
    forms = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-öø-ÿ]+)"), F.lit(1))).alias("token")).distinct()
    return forms.select(T.fold(F.col("token")).alias("fold")).groupBy("fold").agg(F.count("*").alias("forms")).filter("forms > 1")


#: Letters of part names, and the Greek ones that stand for them, accented and plain.
NAMED, ACCENTED, PLAIN = "aeioubdgklmnprst", "άέίόύβδγκλμνπρστ", "αειουβδγκλμνπρστ"


@query("greek_light_fold", f"""
SELECT form, translate(word, '{NAMED}', '{PLAIN}') AS folded, regexp_replace(translate(word, 'u', 'y'), '[^a-z]', '', 'g') AS latin
FROM (SELECT ' ' || translate(word, '{NAMED}', '{ACCENTED}') AS form, word FROM (SELECT DISTINCT p_name AS word FROM part))""")
def greek_light_fold(spark: Session, sf: str) -> DataFrame:
    """light fold and Latin letters of part names in accented Greek letters."""
    rows = table(spark, sf, "part").select(F.concat(F.lit(" "), F.translate("p_name", NAMED, ACCENTED)).alias("form")).distinct()
    return rows.withColumn("folded", T.light_fold(F.col("form"))).withColumn("latin", T.greek_to_latin(F.col("folded")))


SQL_BARE = "regexp_replace(html, '<[^>]*>', ' ', 'g')"


@query("html_slug_projection", f"SELECT page_id, {Q.slug('url')} AS slug, {Q.slug(SQL_BARE)} AS body FROM pages")
def html_slug_projection(spark: Session, sf: str) -> DataFrame:
    """F4, F5 on pages."""
    p = table(spark, sf, "pages")
    return p.select("page_id", T.slug(F.col("url")).alias("slug"), T.slug(F.regexp_replace("html", "<[^>]*>", " ")).alias("body"))


@query("head_glosses", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '(of ' || p_type || ') ' || p_name WHEN 1 THEN 'the ' || p_name || ' of a king' WHEN 2 THEN 'to ' || p_name WHEN 3 THEN NULL
  WHEN 4 THEN CASE WHEN p_size > 30 THEN NULL ELSE p_brand || rpad('', p_size, 'e') END ELSE NULL END AS head FROM part""")
def head_glosses(spark: Session, sf: str) -> DataFrame:
    """the first clause of definitions with numbers, wiki markup and clauses; too short or long ones have none."""
    p, k = table(spark, sf, "part"), F.col("p_partkey") % 6
    text = (
        F.when(k == 0, F.concat(F.lit("1. (of "), "p_type", F.lit(") "), "p_name", F.lit("; pure"))).when(k == 1, F.concat(F.lit("a) the [["), "p_name", F.lit("]] of a king")))
        .when(k == 2, F.concat(F.lit("{{lb}} to "), "p_name", F.lit(" | run"))).when(k == 3, "x")
        .when(k == 4, F.concat(F.lit("  "), "p_brand", F.repeat(F.lit("e"), F.when(F.col("p_size") > 30, 99).otherwise(F.col("p_size"))), F.lit(","))).otherwise("2) 12 34")
    )
    return p.select("p_partkey", G.head_gloss(text).alias("head"))


@query("referent_chain", f"""
WITH p AS (SELECT p_partkey AS k, p_partkey // 3 AS r FROM part), s0 AS (SELECT k, r AS e FROM p),
{', '.join(f's{i} AS (SELECT s{i - 1}.k, coalesce(p.r, e) AS e FROM s{i - 1} LEFT JOIN p ON p.k = e)' for i in range(1, 5))}
SELECT 'w' || k::VARCHAR AS name, 'w' || e::VARCHAR AS resolved FROM s4 UNION ALL SELECT DISTINCT 'a_' || p_size::VARCHAR, 'a_' || p_size::VARCHAR FROM part UNION ALL SELECT DISTINCT 'b_' || p_size::VARCHAR, 'b_' || p_size::VARCHAR FROM part""")
def referent_chain(spark: Session, sf: str) -> DataFrame:
    """references followed at most four times from the first, circles cut."""
    from lexmill.operators.lookup import chain

    p = table(spark, sf, "part")
    tagged = lambda t, c: F.concat(F.lit(t), c.cast("string"))
    parts = p.select(tagged("w", F.col("p_partkey")).alias("name"), tagged("w", F.floor(F.col("p_partkey") / 3)).alias("referent"))
    half = lambda x, y: p.select(tagged(x, F.col("p_size")).alias("name"), tagged(y, F.col("p_size")).alias("referent")).distinct()
    return chain(parts.unionByName(half("a_", "b_")).unionByName(half("b_", "a_")), 4)


@query("near_dup_blocked_edit", f"""
SELECT a.form AS a, b.form AS b, round({Q.edit_similarity('a.form', 'b.form')}, 9) AS similarity FROM {SQL_NAMES} a JOIN {SQL_NAMES} b ON left(a.form, 2) = left(b.form, 2) AND a.form < b.form
WHERE {Q.edit_similarity('a.form', 'b.form')} >= 0.5""")
def near_dup_blocked_edit(spark: Session, sf: str) -> DataFrame:
    """Edit similarity within blocks of equal first characters."""
    from lexmill.operators.similarity import prefix_pairs

    n = names(spark, sf)
    pairs = prefix_pairs(n.select(F.col("form").alias("a")), n.select(F.col("form").alias("b")), 2).filter("a < b")
    sim = T.edit_similarity(F.col("a"), F.col("b"))
    return pairs.select("a", "b", F.round(sim, 9).alias("similarity")).filter("similarity >= 0.5")


@query("trigram_dice_pairs", f"""
SELECT a.form AS a, b.form AS b, round({Q.dice('a.form', 'b.form')}, 9) AS dice FROM {SQL_NAMES} a JOIN {SQL_NAMES} b ON left(a.form, 1) = left(b.form, 1) AND a.form < b.form
WHERE {Q.dice('a.form', 'b.form')} >= 0.3""")
def trigram_dice_pairs(spark: Session, sf: str) -> DataFrame:
    """F9."""
    from lexmill.operators.similarity import prefix_pairs

    n = names(spark, sf)
    pairs = prefix_pairs(n.select(F.col("form").alias("a")), n.select(F.col("form").alias("b")), 1).filter("a < b")
    return pairs.select("a", "b", F.round(T.trigram_dice(F.col("a"), F.col("b")), 9).alias("dice")).filter("dice >= 0.3")


SUFFIXES = ["ing", "ed", "er", "es", "ly", "ion", "tion", "s", "able", "ish"]
SQL_SUFFIXES = Q.values([(s,) for s in SUFFIXES], "suffix")


@query("suffix_stems", f"SELECT DISTINCT form, left(form, length(form) - length(suffix)) AS stem FROM {SQL_NAMES}, {SQL_SUFFIXES} WHERE ends_with(form, suffix) AND length(form) - length(suffix) >= 3")
def suffix_stems(spark: Session, sf: str) -> DataFrame:
    """candidate stems from an ordered list of suffixes, as one projection."""
    return names(spark, sf).select("form", F.explode(T.strip_suffixes(F.col("form"), SUFFIXES)).alias("stem"))


@query("progressive_truncation", f"SELECT form, left(form, k) AS stem FROM (SELECT form, unnest(range(greatest(3, length(form) - 9), length(form))) AS k FROM {SQL_NAMES} WHERE length(form) > 3)")
def progressive_truncation(spark: Session, sf: str) -> DataFrame:
    """F11."""
    return names(spark, sf).select("form", F.explode(T.truncations(F.col("form"))).alias("stem"))


RULES = [("e", "ed"), ("e", "ing"), ("l", "ls"), ("t", "ting"), ("n", "ns")]


@query("inflection_forms", f"SELECT form, left(form, length(form) - 1) || made AS inflected FROM {SQL_NAMES} JOIN {Q.values(RULES, 'ending, made')} ON right(form, 1) = ending WHERE length(form) >= 4")
def inflection_forms(spark: Session, sf: str) -> DataFrame:
    """finite paradigms by a small rule table on the ending."""
    rules = F.broadcast(spark.sql("SELECT * FROM " + Q.values(RULES, "ending, made")))  # fixed rules
    return names(spark, sf).filter(F.length("form") >= 4).join(rules, F.right("form", F.lit(1)) == F.col("ending")).select("form", F.concat(F.substr("form", F.lit(1), F.length("form") - 1), "made").alias("inflected"))


@query("codon_tokens", "SELECT codon, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(upper(substr(md5(p_name), 1, 30)), '0123456789BDEF', 'ACGTACGTACGTAC'), '[ACGT]{3}')) AS codon FROM part) GROUP BY codon")
def codon_tokens(spark: Session, sf: str) -> DataFrame:
    """triples of a genomic text."""
    gene = F.translate(F.upper(F.substring(F.md5("p_name"), 1, 30)), "0123456789BDEF", "ACGTACGTACGTAC")
    return table(spark, sf, "part").select(F.explode(F.regexp_extract_all(gene, F.lit("([ACGT]{3})"), F.lit(1))).alias("codon")).groupBy("codon").agg(F.count("*").alias("n"))


@query("longest_match_tokens")
def longest_match_tokens(spark: Session, sf: str) -> DataFrame:
    """the longest lexicon key at each place, left to right, in an Arrow batch over a small given lexicon."""
    from lexmill.operators.corpus import decode

    lexicon = {"the": "THE", "of the": "OF_THE", "and": "AND", "and of the": "AND_OF_THE"}
    phrases = spark.createDataFrame(list(lexicon.items()), "s string, t string")
    return decode(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), phrases, 3).select("id", F.length("out").alias("n"))


def _turns(spark: Session, sf: str) -> DataFrame:
    """id, hyp, ref: a turn and the one after it."""
    c = table(spark, sf, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ref"))
    return c.join(nxt.hint("merge"), ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("hyp"), "ref")


SQL_TURNS = "(SELECT a.conv_id * 1000 + a.turn AS id, a.text AS hyp, b.text AS ref FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


@query("soft_matches", f"""
SELECT id, (length(h) > 0 AND length(r) > 0 AND (contains(h, r) OR contains(r, h) OR (length(h) >= 4 AND length(r) >= 4 AND left(h, 4) = left(r, 4)))) AS by_prefix,
  (length(h) > 0 AND length(r) > 0 AND (contains(h, r) OR contains(r, h) OR (x > 0 AND x >= 0.5 * y))) AS by_half, (length(h) > 0 AND length(r) > 0 AND (contains(h, r) OR contains(r, h) OR (x > 0 AND x >= 0.67 * y))) AS by_most
FROM (SELECT id, lower(trim(hyp)) AS h, lower(trim(ref)) AS r, len(list_intersect(list_distinct({Q.words('hyp')}), list_distinct({Q.words('ref')}))) AS x, len(list_distinct({Q.words('ref')})) AS y FROM {SQL_TURNS})""")
def soft_matches(spark: Session, sf: str) -> DataFrame:
    """the soft predicates, each under its own name."""
    t = _turns(spark, sf)
    return t.select("id", T.soft_prefix(F.col("hyp"), F.col("ref")).alias("by_prefix"), T.soft_recall(F.col("hyp"), F.col("ref"), 0.5).alias("by_half"), T.soft_recall(F.col("hyp"), F.col("ref"), 0.67).alias("by_most"))


SQL_FLUENT = """
CASE WHEN length(trim(text)) = 0 THEN 0.0 WHEN len(w) = 0 THEN 0.2 ELSE greatest(0.0, least(1.0, 1.0 - CASE WHEN len(w) < 2 THEN 0.15 ELSE 0 END
 - CASE WHEN regexp_matches(text, '[^A-Za-z0-9_\\s''.,;:!?"()-]') THEN 0.1 ELSE 0 END - CASE WHEN len(list_filter(w, lambda x: length(x) = 1)) > 0.35 * len(w) THEN 0.2 ELSE 0 END - CASE WHEN len(w) > 80 THEN 0.1 ELSE 0 END)) END"""


@query("fluency_scores", f"SELECT doc_id, round({SQL_FLUENT}::DOUBLE, 9) AS fluency FROM (SELECT doc_id, text, {Q.words('text')} AS w FROM documents)")
def fluency_scores(spark: Session, sf: str) -> DataFrame:
    """F16: penalties for short, odd, chopped and long texts."""
    d = table(spark, sf, "documents").select("doc_id", "text", T.words(F.col("text")).alias("w"))
    off = lambda cond, v: F.when(cond, v).otherwise(0.0)
    s = 1.0 - off(F.size("w") < 2, 0.15) - off(F.col("text").rlike(r"[^A-Za-z0-9_\s'.,;:!?\"()-]"), 0.1) - off(F.size(F.filter("w", lambda x: F.length(x) == 1)) > 0.35 * F.size("w"), 0.2) - off(F.size("w") > 80, 0.1)
    return d.select("doc_id", F.round(F.when(F.length(F.trim("text")) == 0, 0.0).when(F.size("w") == 0, 0.2).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))), 9).alias("fluency"))


@query("clause_split", r"""
SELECT id, c AS clause FROM (
  SELECT id, unnest(list_filter(CASE WHEN length(p) > 24 AND contains(p, ',') THEN list_transform(string_split(p, ','), lambda x: trim(x)) ELSE [p] END, lambda x: x <> '')) AS c
  FROM (SELECT id, unnest(list_filter(list_transform(string_split_regex(trim(t), '[;|/]|\s+[-—]\s+'), lambda x: trim(x)), lambda x: x <> '')) AS p
        FROM (SELECT doc_id AS id, text AS t FROM documents)))""")
def clause_split(spark: Session, sf: str) -> DataFrame:
    """clauses of a text."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(T.clauses(F.col("text"))).alias("clause"))


@query("display_text", "SELECT conv_id, turn, CASE WHEN length(t) > 160 THEN left(t, 159) || '…' ELSE t END AS shown FROM (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '^(flowing_|fluid_)', ''), '\\s+', ' ', 'g')) AS t FROM conversations)")
def display_text(spark: Session, sf: str) -> DataFrame:
    """prefixes off, spaces single, at most 160 characters."""
    t = F.trim(F.regexp_replace(F.regexp_replace("text", "^(flowing_|fluid_)", ""), r"\s+", " "))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.length(t) > 160, F.concat(F.left(t, F.lit(159)), F.lit("…"))).otherwise(t).alias("shown"))


@query("narrative_render", "SELECT l_orderkey, '[S=' || printf('%.2e', sum(l_quantity)) || '] ' || string_agg(l_returnflag || l_linestatus, ' -> ' ORDER BY l_linenumber, l_returnflag || l_linestatus) AS story FROM lineitem GROUP BY l_orderkey")
def narrative_render(spark: Session, sf: str) -> DataFrame:
    """a joined text with a scalar in scientific notation."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("x")))), lambda s: s["x"])
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("[S="), F.format_string("%.2e", F.sum("l_quantity")), F.lit("] "), F.array_join(parts, " -> ")).alias("story"))


@query("surface_features", f"""
SELECT doc_id, round(CASE WHEN len(l) = 0 THEN 0.5 ELSE len(regexp_extract_all(lower(text), '[aeiou]')) / len(l)::DOUBLE END, 9) AS vowels,
  round(CASE WHEN length(text) = 0 THEN 0 ELSE len(regexp_extract_all(text, '[,.;:!?]')) / length(text)::DOUBLE END, 9) AS punctuation, (len(w) - len(list_distinct(w)))::INT AS repeats
FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '\\p{{L}}') AS l, {Q.tokens('text')} AS w FROM documents)""")
def surface_features(spark: Session, sf: str) -> DataFrame:
    """F20."""
    d = table(spark, sf, "documents").select("doc_id", "text", T.tokens(F.col("text")).alias("w"))
    return d.select("doc_id", F.round(T.vowel_share(F.col("text")), 9).alias("vowels"), F.round(T.punctuation_density(F.col("text")), 9).alias("punctuation"), T.repeats(F.col("w")).alias("repeats"))


IPA = [("the", "ðə", "A"), ("and", "ænd", "A"), ("of", "ɒv", "B"), ("in", "ɪn", "B")]


@query("ipa_lookup", f"SELECT token, coalesce(ipa, token) AS ipa, coalesce(tier, 'C') AS tier, regexp_matches(token, '^[aeiou]') AS vowel_start FROM (SELECT DISTINCT unnest({Q.words('text')}) AS token FROM benchmark) LEFT JOIN {Q.values(IPA, 'w, ipa, tier')} ON w = token")
def ipa_lookup(spark: Session, sf: str) -> DataFrame:
    """a pronunciation table, else the letters themselves, with features."""
    table_ = spark.sql("SELECT * FROM " + Q.values(IPA, "w, ipa, tier"))
    toks = table(spark, sf, "benchmark").select(F.explode(T.words(F.col("text"))).alias("token")).distinct()
    return toks.join(F.broadcast(table_), F.col("w") == F.col("token"), "left").select("token", F.coalesce("ipa", "token").alias("ipa"), F.coalesce("tier", F.lit("C")).alias("tier"), F.col("token").rlike("^[aeiou]").alias("vowel_start"))


# Amino acids of the 64 codons, bases in the order T, C, A, G.
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# What the amino acids stand for, and the codons with a word of their own.
PROCESS = {
    "M": "start", "*": "stop", "F": "aromatic_ring", "L": "hydrophobic_chain", "S": "hydroxyl_link", "Y": "signal_tyrosine", "C": "disulfide_bridge",
    "W": "aromatic_core", "P": "kink_proline", "H": "charge_histidine", "Q": "amide_link", "R": "charge_arginine", "I": "hydrophobic_branch",
    "T": "hydroxyl_threonine", "N": "amide_asparagine", "K": "charge_lysine", "V": "hydrophobic_valine", "A": "compact_alanine", "D": "charge_aspartate",
    "E": "charge_glutamate", "G": "flex_glycine",
}
OWN_WORDS = {"ATG": "start", "GTG": "transfer", "CAC": "energy", "CTG": "structure", "ACT": "action", "TAA": "stop", "TAG": "stop", "TGA": "stop", "CAA": "energy_link", "GCG": "core_structure"}


def codon_table(spark: Session) -> DataFrame:
    """codon, meaning: DNA and, where U changes the spelling, RNA, from the rule above."""
    bases = "TCAG"
    rows = []
    for i, (a, b, c) in enumerate((a, b, c) for a in bases for b in bases for c in bases):
        codon = a + b + c
        meaning = OWN_WORDS.get(codon, PROCESS[AMINO[i]])
        rows.append((codon.lower(), meaning))
        if "T" in codon:
            rows.append((codon.replace("T", "U").lower(), f"{'start' if codon == 'ATG' else 'stop' if AMINO[i] == '*' else meaning}_rna"))
    return spark.createDataFrame(rows, "codon string, meaning string")


def _codon_sql() -> str:
    case = lambda key, pairs: f"CASE {key} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items())} END"
    spelt = "substr('TCAG', i // 16 + 1, 1) || substr('TCAG', i // 4 % 4 + 1, 1) || substr('TCAG', i % 4 + 1, 1)"
    known = f"SELECT p_partkey, dna, rna, aa, coalesce({case('dna', OWN_WORDS)}, {case('aa', PROCESS)}) AS meaning FROM (SELECT p_partkey, p_size % 2 = 1 AS rna, {spelt} AS dna, substr('{AMINO}', i + 1, 1) AS aa FROM (SELECT *, (p_partkey % 65)::INT AS i FROM part))"
    return (
        "SELECT p_partkey, CASE WHEN rna THEN lower(replace(dna, 'T', 'U')) ELSE dna END AS codon, CASE WHEN rna AND contains(dna, 'T') THEN "
        f"CASE WHEN dna = 'ATG' THEN 'start' WHEN aa = '*' THEN 'stop' ELSE meaning END || '_rna' ELSE meaning END AS meaning FROM ({known})"
    )


@query("genetic_code", _codon_sql())
def genetic_code(spark: Session, sf: str) -> DataFrame:
    """codons of both spellings, one for each part, by a broadcast table of 64 triples; two letters have no meaning."""
    i = F.col("p_partkey") % 65
    dna = F.concat(*[F.substr(F.lit("TCAG"), (F.floor(i / d) % m + 1).cast("int"), F.lit(1)) for d, m in ((16, 64), (4, 4), (1, 4))])
    rows = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 1, F.lower(F.replace(dna, F.lit("T"), F.lit("U")))).otherwise(dna).alias("x"))
    return rows.join(F.broadcast(codon_table(spark)), F.lower("x") == F.col("codon"), "left").select("p_partkey", F.col("x").alias("codon"), "meaning")  # a fixed table


CLOSED = ["the", "of", "and", "is", "a", "to", "in"]


@query("word_reorder", f"""
SELECT conv_id, turn, array_to_string(CASE WHEN len(w) < 3 OR len(c) = 0 THEN w ELSE list_concat(list_concat(c[1:1], k[1:least(len(k), 2)]), list_concat(c[2:], k[least(len(k), 2) + 1:])) END, ' ') AS out
FROM (SELECT *, list_filter(w, lambda x: x NOT IN {tuple(CLOSED)}) AS c, list_filter(w, lambda x: x IN {tuple(CLOSED)}) AS k FROM (SELECT conv_id, turn, {Q.words('text')} AS w FROM conversations))""")
def word_reorder(spark: Session, sf: str) -> DataFrame:
    """content first, the closed class near it."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", T.words(F.col("text")).alias("words"))
    return c.select("conv_id", "turn", F.array_join(rank.reordered(c, CLOSED, 2.4), " ").alias("out"))


def sql_scalar(d: str, dpsi: str, dtheta: str) -> str:
    """The same arithmetic with the constants as literals; observed, other inputs at their defaults."""
    return (
        f"{S.K!r} * (cos(({S.PSI!r} + {dpsi}) / {S.ETA!r}) / sqrt({d}) * exp(1.0 + {S.B_IN!r} * {dpsi}) * (1 + exp({S.ALPHA * S.GAMMA / S.PHI!r}) * {S.C_EFF!r})"
        f" * (1 + {S.P_NEW!r} * ln({d} / 25)) * {math.exp(S.C_FACTOR * S.P_VAR)!r} * cos({dpsi} + {S.P_VAR!r}) + 1.0)"
    )


@query("domain_scalar_panel", f"SELECT p_size, round({sql_scalar('d', '0.8', '1.0')}, 9) AS s FROM (SELECT DISTINCT p_size, p_size::DOUBLE + 5 AS d FROM part)")
def domain_scalar_panel(spark: Session, sf: str) -> DataFrame:
    """M1: the scalar over a range of dimensions; the third term is below the rounding."""
    d = table(spark, sf, "part").select("p_size").distinct()
    return d.select("p_size", F.round(S.panel(d_eff=F.col("p_size") + 5.0, dpsi=0.8, dtheta=1.0, observed=True)["s"], 9).alias("s"))


@query("domain_scalar_golden", f"""
SELECT p_size, dpsi, round({sql_scalar('d', 'dpsi', '1.0')}, 8) AS s FROM (SELECT DISTINCT p_size, p_size::DOUBLE + 5 AS d, (p_partkey % 4) / 5.0::DOUBLE + 0.4 AS dpsi FROM part)""")
def domain_scalar_golden(spark: Session, sf: str) -> DataFrame:
    """M1: the scalar over dimensions and shifts; its golden values are in the tests."""
    rows = table(spark, sf, "part").select("p_size", ((F.col("p_partkey") % 4) / 5.0 + 0.4).alias("dpsi")).distinct()
    return rows.select("p_size", "dpsi", F.round(S.panel(d_eff=F.col("p_size") + 5.0, dpsi=F.col("dpsi"), dtheta=1.0, observed=True)["s"], 8).alias("s"))


@query("authority_check", "SELECT r_name, sha256(r_name) = sha256('ASIA') AS authority_ok, 'local' AS law FROM region")
def authority_check(spark: Session, sf: str) -> DataFrame:
    """M2: a pinned checksum decides on the authority; without the pinned file the local law holds."""
    return table(spark, sf, "region").select("r_name", (F.sha2("r_name", 256) == F.sha2(F.lit("ASIA"), 256)).alias("authority_ok"), F.lit("local").alias("law"))


@query("scalar_steps", f"SELECT DISTINCT p_size, step, round(CASE step WHEN 'growth' THEN {math.exp(S.ALPHA * S.GAMMA / S.PHI)!r} WHEN 'mass' THEN 1 / sqrt(p_size::DOUBLE) ELSE 1 + {S.P_NEW!r} * ln(p_size / 25.0::DOUBLE) END, 9) AS value FROM part, {Q.values([('growth',), ('mass',), ('d_scale',)], 'step')}")
def scalar_steps(spark: Session, sf: str) -> DataFrame:
    """M3: named steps as rows."""
    d = table(spark, sf, "part").select("p_size").distinct()
    size = F.col("p_size").cast("double")
    step = lambda n, v: F.struct(F.lit(n).alias("step"), F.round(v, 9).alias("value"))
    growth = F.lit(math.exp(S.ALPHA * S.GAMMA / S.PHI))
    return d.select("p_size", F.explode(F.array(step("growth", growth), step("mass", 1 / F.sqrt(size)), step("d_scale", 1 + S.P_NEW * F.ln(size / 25)))).alias("x")).select("p_size", "x.*")


def seed_pools(spark: Session, sf: str) -> DataFrame:
    """Candidate pools with features, made from order lines."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("sent_id"), F.col("l_linenumber").alias("place"), (F.col("l_discount") * 10 + 1).alias("enc_norm"), F.col("l_tax").alias("nll"),
        F.col("l_quantity").alias("gen"), (F.col("l_discount") * 9).alias("spm_ent_norm"), (F.col("l_tax") * 50 + 1).alias("spm_mean_len"),
        (F.col("l_tax") / 2).alias("spm_unk_frac"), (F.col("l_quantity") / 2).alias("spm_n_pieces"), F.col("l_linenumber").alias("hyp_len"), F.lit(4).alias("src_len"),
    )
    return li.select("*", rank.rank01("nll", "sent_id", False).alias("nll_rank"), rank.rank01("enc_norm", "sent_id").alias("enc_rank"), rank.rank01("gen", "sent_id").alias("gen_rank"))


@query("seed_scalar_pick")
def seed_scalar_pick(spark: Session, sf: str) -> DataFrame:
    """The candidate with the greatest scalar of its mapped features, the first of equals."""
    mapped = rank.seed_inputs(seed_pools(spark, sf))
    return rank.pick(mapped, "sent_id", rank.seed_scalar(mapped), "place", ["place"])


@query("golden_series", f"SELECT l_orderkey, round(sum(l_quantity * pow({S.PHI!r}, -(l_linenumber - 1))) / sum(pow({S.PHI!r}, -(l_linenumber - 1))), 6) AS s FROM (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS l_linenumber FROM lineitem) GROUP BY l_orderkey")
def golden_series(spark: Session, sf: str) -> DataFrame:
    """M5: a series weighted by powers of the golden ratio."""
    v = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: x["l_quantity"])
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(v.alias("v")).select("l_orderkey", F.round(S.golden_series(F.col("v")), 6).alias("s"))


@query("pool_softmax", "SELECT l_orderkey, l_linenumber, round(e / sum(e) OVER (PARTITION BY l_orderkey), 9) AS p FROM (SELECT l_orderkey, l_linenumber, exp((l_quantity - max(l_quantity) OVER (PARTITION BY l_orderkey)) / 10.0) AS e FROM lineitem)")
def pool_softmax(spark: Session, sf: str) -> DataFrame:
    """M6."""
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(rank.softmax("l_quantity", "l_orderkey", 10.0), 9).alias("p"))


@query("vector_normalise", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding), 6) AS pooled FROM embeddings")
def vector_normalise(spark: Session, sf: str) -> DataFrame:
    """M6, M7: norm and mean pooling of arrays."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    d = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.sqrt(total(F.transform(d, lambda x: x * x))), 6).alias("norm"), F.round(total(d) / F.size(d), 6).alias("pooled"))


@query("embedding_cosine_topk", """
SELECT q, vec_id, round(cosine, 6) AS cosine FROM (
  SELECT a.vec_id AS q, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cosine,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS r
  FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) WHERE r <= 5""")
def embedding_cosine_topk(spark: Session, sf: str) -> DataFrame:
    """M7, K2: every vector against a stated set of queries, those whose id divides by 50."""
    from lexmill.operators.similarity import nearest

    e = table(spark, sf, "embeddings")
    return nearest(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", 5).select("q", "vec_id", F.round("cosine", 6).alias("cosine"))


def _picker(spark: Session, sf: str, model: str) -> DataFrame:
    """Picks of the pools that a model wasn't fitted on, those whose hashed id divides by four. The label, to be its pool's dearest
    line, is none of the features."""
    features = ["gen_rank", "nll_rank", "enc_rank", "spm_ent_norm"]
    price = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sent_id"), F.col("l_linenumber").alias("place"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("gen"))
    top = price.groupBy("sent_id").agg(F.max("price").alias("best"))
    labelled = price.join(top, "sent_id").select("sent_id", "place", "gen", (F.col("price") == F.col("best")).cast("double").alias("label")).dropDuplicates(["sent_id", "place", "gen"])
    pools = seed_pools(spark, sf).join(labelled, ["sent_id", "place", "gen"])
    held_out = F.pmod(F.xxhash64("sent_id"), F.lit(4)) == 0
    scored = rank.learned(pools.filter(~held_out), pools.filter(held_out), features, "label", model)
    return rank.pick(scored, "sent_id", F.col("p"), "place", ["place"])


@query("learned_picker")
def learned_picker(spark: Session, sf: str) -> DataFrame:
    """M8, M9: a logistic picker over reference-free features; the best candidate of each held-out pool."""
    return _picker(spark, sf, "logistic")


@query("boosted_picker")
def boosted_picker(spark: Session, sf: str) -> DataFrame:
    """M8: the same with boosted trees."""
    return _picker(spark, sf, "trees")


GRID = rank.grid({"l_discount": [0.0, 1.0, 2.0], "l_tax": [0.0, 1.0]})


@query("weight_grid", f"""
SELECT w, round(avg(y), 6) AS mean FROM (
  SELECT w, l_orderkey, arg_max(l_quantity, (s, -o)) AS y FROM (
    SELECT w, l_orderkey, l_linenumber::BIGINT * 10000000000000 + l_partkey * 10000000 + l_suppkey * 100 + l_quantity::BIGINT AS o, l_quantity, l_discount * a + l_tax * b AS s FROM lineitem, {Q.values([(i, g['l_discount'], g['l_tax']) for i, g in enumerate(GRID)], 'w, a, b')}) GROUP BY w, l_orderkey) GROUP BY w""")
def weight_grid(spark: Session, sf: str) -> DataFrame:
    """The mean target of what each weight vector picks, in one pass over the candidates."""
    li = table(spark, sf, "lineitem").withColumn("o", F.col("l_linenumber").cast("long") * 10000000000000 + F.col("l_partkey") * 10000000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long"))
    found = rank.grid_scores(li, "l_orderkey", "o", ["l_discount", "l_tax"], "l_quantity", GRID)
    return found.select("w", F.round("mean", 6).alias("mean"))


@query("seeded_dimension", f"""
SELECT name, round(6.0 + list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, length(name) + 1), lambda i: (unicode(substr(lower(name), i, 1)) + 1) * pow({S.PHI!r}, ((i - 1) % 7 + 1)))), lambda h, x: (h + x) % 1000.0) / 1000.0 * 18.0, 2) AS d
FROM (SELECT n_name AS name FROM nation)""")
def seeded_dimension(spark: Session, sf: str) -> DataFrame:
    """A number from the code points of a name."""
    return table(spark, sf, "nation").select(F.col("n_name").alias("name"), S.seeded_dimension(F.col("n_name")).alias("d"))


@query("field_classes", """
SELECT class, count(*) AS n FROM (
  SELECT CASE WHEN x + y > 1.35 * greatest(g, 0.05) AND g < 0.12 THEN 'hidden' WHEN x + y > 1.35 * greatest(g, 0.05) THEN 'marked' WHEN g > 0.1 THEN 'surface' ELSE 'plain' END AS class
  FROM (SELECT sin(i / 7.0) * sin(i / 7.0) AS x, cos(j / 5.0) * cos(j / 5.0) / 4 AS y, abs(sin((i + j) / 9.0)) AS g FROM range(64) a(i), range(64) b(j))) GROUP BY class""")
def field_classes(spark: Session, sf: str) -> DataFrame:
    """A grid of pixels with bands, classified by rules."""
    grid = spark.range(64 * 64).select((F.col("id") % 64).alias("i"), F.floor(F.col("id") / 64).alias("j"))
    bands = grid.select((F.sin(F.col("i") / 7.0) * F.sin(F.col("i") / 7.0)).alias("x"), (F.cos(F.col("j") / 5.0) * F.cos(F.col("j") / 5.0) / 4).alias("y"), F.abs(F.sin((F.col("i") + F.col("j")) / 9.0)).alias("g"))
    strong = F.col("x") + F.col("y") > 1.35 * F.greatest("g", F.lit(0.05))
    cls = F.when(strong & (F.col("g") < 0.12), "hidden").when(strong, "marked").when(F.col("g") > 0.1, "surface").otherwise("plain")
    return bands.groupBy(cls.alias("class")).agg(F.count("*").alias("n"))


@query("event_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def event_timestamps(spark: Session, sf: str) -> DataFrame:
    """ISO texts of times."""
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("array_operations", "SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) AS flags, list_sort(list(l_linenumber))[1:2] AS first_two, bool_or(l_returnflag = 'R') AS has_r FROM lineitem GROUP BY l_orderkey")
def array_operations(spark: Session, sf: str) -> DataFrame:
    """Distinct, slices and contains-any of arrays."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("f"), F.sort_array(F.collect_list("l_linenumber")).alias("n"))
    return li.select("l_orderkey", F.sort_array(F.array_distinct("f")).alias("flags"), F.slice("n", 1, 2).alias("first_two"), F.exists("f", lambda x: x == "R").alias("has_r"))


@query("map_operations", "SELECT n_regionkey, arg_max(n_name, (length(n_name), n_name)) AS longest, count(*) AS n FROM nation GROUP BY n_regionkey")
def map_operations(spark: Session, sf: str) -> DataFrame:
    """Labels kept in maps; the longest wins a merge."""
    m = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.length("n_name").alias("l")))).alias("m"))
    best = F.array_max(F.transform(F.map_entries("m"), lambda e: F.struct(e["value"].alias("l"), e["key"].alias("k"))))
    return m.select("n_regionkey", best["k"].alias("longest"), F.size("m").cast("long").alias("n"))


@query("json_operations", "SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k FROM events GROUP BY event_type")
def json_operations(spark: Session, sf: str) -> DataFrame:
    """A path into JSON texts."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.get_json_object("props", "$.k")).alias("with_k"))


@query("numeric_certification", """
SELECT id, claimed, abs(claimed - 0.6513247618848969) <= 1e-3 AS certified FROM (
  SELECT p_partkey AS id, unnest([('0.' || lpad((6490 + p_size)::VARCHAR, 4, '0'))::DOUBLE, p_size::DOUBLE]) AS claimed FROM part WHERE p_partkey % 3 <> 0)""")
def numeric_certification(spark: Session, sf: str) -> DataFrame:
    """Two numbers claimed in a text of each part against the law, none in every third."""
    said = F.concat(F.lit("here S = 0."), F.lpad((F.col("p_size") + 6490).cast("string"), 4, "0"), F.lit("! and then S="), F.col("p_size").cast("string"), F.lit(" or X = 4"))
    texts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, "no number").otherwise(said).alias("text"))
    return retrieve.certify(texts, S.panel(d_eff=F.lit(12.0), dpsi=F.lit(0.8), dtheta=F.lit(1.0), observed=True)["s"])
