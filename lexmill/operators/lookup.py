"""Prioritised look-ups: distinct tokens first, then equi-joins; the first layer or the best score decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import gloss as G
from lexmill.functions import text as T


def cascade(tokens: DataFrame, layers: list[tuple[str, DataFrame, Column, float]], key: str = "token") -> DataFrame:
    """tokens with meaning, stage and score of the first layer that has the key. A layer is (stage, frame of form and
    meaning, key expression over the token, score); forms of a layer are unique."""
    out, stages = tokens, []
    for i, (stage, layer, probe, score) in enumerate(layers):
        found = layer.select(F.col("form").alias(f"__f{i}"), F.col("meaning").alias(f"__m{i}"))
        out = out.join(found, probe == F.col(f"__f{i}"), "left")
        stages.append(F.when(F.col(f"__m{i}").isNotNull(), F.struct(F.col(f"__m{i}").alias("meaning"), F.lit(stage).alias("stage"), F.lit(score).alias("score"))))
    none = F.struct(F.lit(None).cast("string").alias("meaning"), F.lit("missing").alias("stage"), F.lit(0.0).alias("score"))
    return out.select(*tokens.columns, F.coalesce(*stages, none).alias("hit")).select(*tokens.columns, "hit.*")


def sense_of(tokens: DataFrame, bindings: DataFrame) -> DataFrame:
    """lang, form to sense and confidence: exact in the language 1, else the sense that claimed the form first 0.95.
    bindings: sense, lang, form, ord."""
    exact = bindings.groupBy("lang", "form").agg(F.min_by("sense", "ord").alias("exact"))
    anywhere = bindings.groupBy("form").agg(F.min_by("sense", "ord").alias("first"))
    found = tokens.join(exact, ["lang", "form"], "left").join(anywhere, "form", "left")
    return found.select(
        *tokens.columns, F.coalesce("exact", "first").alias("sense"),
        F.when(F.col("exact").isNotNull(), 1.0).when(F.col("first").isNotNull(), 0.95).otherwise(0.0).alias("confidence"),
    )


def render(senses: DataFrame, bindings: DataFrame, target: str) -> DataFrame:
    """The sense's first form in the target language, else in English, else in any."""
    order = F.struct(F.when(F.col("lang") == target, 0).when(F.col("lang") == "en", 1).otherwise(2).alias("r"), "ord")
    forms = bindings.groupBy("sense").agg(F.min_by("form", order).alias("form"), F.min_by("lang", order).alias("lang"))
    return senses.join(forms, "sense", "left")


def probe_keys(tokens: DataFrame, store: DataFrame, langs: list[str], score: Column) -> DataFrame:
    """Raw, lower-cased and lang|form keys; the gloss with the greatest score, on ties the earliest key."""
    keys = F.array("token", F.lower("token"), *[F.concat(F.lit(f"{lang}|"), F.lower("token")) for lang in langs])
    tried = tokens.select("token", F.posexplode(keys).alias("place", "form"))
    found = tried.join(store, "form").withColumn("__s", score)
    best = found.groupBy("token").agg(F.max_by(F.struct("gloss", F.col("__s").alias("score")), F.struct("__s", -F.col("place"))).alias("r"))
    return tokens.join(best.select("token", "r.*"), "token", "left")


def two_hops(tokens: DataFrame, forms: DataFrame, concepts: DataFrame, langs: list[str]) -> DataFrame:
    """form to concept (in the order of the languages) to English; exact 0.96, by Latin letters 0.88."""
    rank = F.array_position(F.array(*map(F.lit, langs)), F.col("lang"))
    ranked = forms.filter(F.col("lang").isin(langs)).groupBy("form").agg(F.min_by("concept", rank).alias("concept"))
    exact = ranked.join(concepts, "concept").select(F.col("form").alias("f1"), F.col("en").alias("e1"))
    latin = exact.toDF("f2", "e2")
    found = tokens.join(exact, F.col("token") == F.col("f1"), "left").join(latin, T.greek_to_latin(T.light_fold(F.col("token"))) == F.col("f2"), "left")
    return found.select("token", F.coalesce("e1", "e2").alias("en"), F.when(F.col("e1").isNotNull(), 0.96).when(F.col("e2").isNotNull(), 0.88).alias("score"))


def candidates_by(tokens: DataFrame, generate: Column, endings: list[str]) -> DataFrame:
    """token, stem, candidate: generated stems, bare and with each ending."""
    stems = tokens.select("token", F.explode(generate).alias("stem"))
    every = F.array("stem", *[F.concat("stem", F.lit(e)) for e in endings if e])
    return stems.select("token", "stem", F.posexplode(every).alias("place", "candidate"))


def longest_stem(tokens: DataFrame, store: DataFrame, generate: Column, endings: list[str]) -> DataFrame:
    """The meaning under the longest key among the token itself, its stems and their reattachments."""
    tried = candidates_by(tokens, F.concat(F.array("token"), generate), endings)
    found = tried.join(store.withColumnRenamed("form", "candidate"), "candidate")
    best = found.groupBy("token").agg(F.max_by(F.struct("meaning", "candidate"), F.struct(F.length("candidate"), "candidate")).alias("r"))
    return tokens.join(best.select("token", "r.*"), "token", "left")


def first_hit(tokens: DataFrame, store: DataFrame, suffixes: list[str], endings: list[str], keep: int = 3) -> DataFrame:
    """Ordered suffixes times ordered endings; the first that the store has wins."""
    n = F.length("token")
    stems = [F.when(F.col("token").endswith(s) & (n - len(s) >= keep), F.struct(F.lit(i).alias("rule"), F.substr("token", F.lit(1), n - len(s)).alias("stem"))) for i, s in enumerate(suffixes)]
    tried = tokens.select("token", F.explode(F.array_compact(F.array(*stems))).alias("x")).select("token", "x.*")
    tried = tried.select("token", "rule", F.posexplode(F.array(*[F.concat("stem", F.lit(e)) for e in endings])).alias("ending", "form"))
    found = tried.join(store, "form").groupBy("token").agg(F.min_by(F.struct("meaning", "form"), F.struct("rule", "ending")).alias("r"))
    return tokens.join(found.select("token", "r.*"), "token", "left")


def chain(pairs: DataFrame, steps: int = 4) -> DataFrame:
    """Follows name -> referent up to `steps` times; a name without a referent, or one of a cycle, is where it ends."""
    out = pairs.select("name", F.col("referent").alias("at"), F.array("name").alias("seen"))
    nxt = pairs.select(F.col("name").alias("n2"), F.col("referent").alias("r2"))
    for _ in range(steps):
        joined = out.join(nxt, F.col("at") == F.col("n2"), "left")
        go = F.col("r2").isNotNull() & ~F.array_contains("seen", F.col("at"))
        out = joined.select("name", F.when(go, F.col("r2")).otherwise(F.col("at")).alias("at"), F.array_union("seen", F.array("at")).alias("seen"))
    return out.select("name", F.col("at").alias("resolved"))


def peel_compounds(tokens: DataFrame, store: DataFrame, prefixes: list[str], endings: list[str], shortest: int = 8, keep: int = 4) -> DataFrame:
    """token, form, meaning by what a known prefix leaves: that itself, else with an ending, else its longest stem with or
    without one. Tokens of at least `shortest` characters, rests of at least `keep`; the longest prefix first."""
    ordered = sorted(set(prefixes), key=lambda p: (-len(p), p))
    n = F.length("token")
    rests = [F.when(F.col("token").startswith(p) & (n - len(p) >= keep), F.struct(F.lit(i).alias("rule"), F.substr("token", F.lit(len(p) + 1)).alias("rest"))) for i, p in enumerate(ordered)]
    peeled = tokens.filter(n >= shortest).select("token", F.explode(F.array_compact(F.array(*rests))).alias("x")).select("token", "x.*")
    stems = peeled.select("token", "rule", F.posexplode(F.concat(F.array("rest"), T.truncations(F.col("rest")))).alias("cutoff", "stem"))
    tried = stems.select("token", "rule", "cutoff", F.posexplode(F.array("stem", *[F.concat("stem", F.lit(e)) for e in endings])).alias("ending", "form"))
    best = tried.join(store, "form").groupBy("token").agg(F.min_by(F.struct("form", "meaning"), F.struct("rule", "cutoff", "ending")).alias("r"))
    return tokens.join(best.select("token", "r.*"), "token", "left")


# Latin endings that come off, those that leave a stem in -u (with the least length of the form), and what a
# lemma may end in.
LATIN_ENDINGS = (
    "ationibus ionibus tionibus tatibus oribus arum orum ibus uum ium em um am as os es is us ae ui a o i e u"
).split()
U_STEMS = (("ibus", 6), ("uum", 5))
LATIN_LEMMAS = "us um a is es or io u are ere ire o".split()
# Words of meanings that the historical and linguistic domains prefer.
DOMAIN_WORDS = ("hand", "water", "law", "king", "city", "war", "people")


def declension_stems(form: Column) -> Column:
    """Stems by declension class: the form, the fourth class rebuilt with its -u, and what is left of each ending."""
    n = F.length(form)
    rebuilt = [F.when(form.endswith(e) & (n >= least), F.concat(F.substr(form, F.lit(1), n - len(e)), F.lit("u"))) for e, least in U_STEMS]
    return F.array_distinct(F.filter(F.concat(F.array(form), F.array_compact(F.array(*rebuilt)), T.strip_suffixes(form, LATIN_ENDINGS)), lambda s: F.length(s) >= 3))


def declension_lemmas(tokens: DataFrame, store: DataFrame, least: float = 0.82) -> DataFrame:
    """token, meaning, donor, score: the best key among class stems (0.84) and stems with a lemma's ending (0.88), more for
    longer stems, content, likeness and words of the domain; like the token by 0.48, or 0.62 where lengths differ by over 4."""
    tried = candidates_by(tokens, declension_stems(F.col("token")), LATIN_LEMMAS).withColumnRenamed("candidate", "form")
    found = tried.join(store, "form").withColumn("sim", T.edit_similarity(F.col("token"), F.col("form")))
    apart = F.abs(F.length("token") - F.length("form")) > 4
    found = found.filter((F.col("sim") >= 0.48) & ~(apart & (F.col("sim") < 0.62)))
    base = F.when(F.col("place") == 0, 0.84).otherwise(0.88) * F.when(G.is_grammatical(F.col("meaning")), 0.35).otherwise(1.0)
    base = base + F.when(F.lower("meaning").rlike("|".join(DOMAIN_WORDS)), 0.05).otherwise(0.0) + 0.03 * F.least(F.lit(3), F.length("stem") - 3)
    scored = found.withColumn("score", F.least(F.lit(0.96), base + 0.10 * G.content_score(F.col("meaning")) + 0.18 * F.col("sim"))).filter(F.col("score") >= least)
    order = F.struct("score", F.length("stem").alias("n"), "form")
    return scored.groupBy("token").agg(F.max_by(F.struct("meaning", F.col("form").alias("donor"), "score"), order).alias("r")).select("token", "r.*")


# Endings of ethnonyms, and what a place's name may have after their stem.
DEMONYMS = "ιώτης ιώτου ίτης ίτου εύς έως αίος αῖος ensis enses anus ana ani anum icus ica icum ites itae iotai".split()
PLACE_ENDINGS = ["", "a", "os", "us", "on", "um"]


def gazetteer(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """token, lang, meaning, score, method of the first probe that has a name: the form in its language 0.98, in any 0.95; by
    Latin letters a Greek name 0.90 or any form 0.88; without an ethnonym's ending 0.84, its Greek stem by Latin letters
    0.82; a form in contact 0.80. names: lang, form, meaning, ord (of several, the first has the key)."""
    greek = lambda c: c.rlike("[\u0370-\u03ff\u1f00-\u1fff]")
    of, lang = T.light_fold(F.col("form")), F.col("lang")
    keys = F.array(F.concat(F.lit("l|"), lang, F.lit("|"), of), F.concat(F.lit("f|"), of), F.when(greek(of), F.concat(F.lit("t|"), T.greek_to_latin(of))))
    keyed = names.select(F.explode(F.array_compact(keys)).alias("key"), "meaning", "ord").groupBy("key").agg(F.min_by("meaning", "ord").alias("meaning"))

    def probe(place: int, kind: str, key: Column, score: float, method: str) -> Column:
        full = F.concat(F.lit("l|"), lang, F.lit("|"), key) if kind == "l" else F.concat(F.lit(kind + "|"), key)
        return F.struct(F.lit(place).alias("place"), full.alias("key"), F.lit(score).alias("score"), F.lit(method).alias("method"))

    form, n = F.col("__form"), F.length("__form")
    bridge, latin = greek(form) | lang.isin("grc", "el"), T.greek_to_latin(form)
    probes = [
        probe(0, "l", form, 0.98, "name_lang_exact"), probe(1, "f", form, 0.95, "name_form_exact"),
        F.when(bridge, probe(2, "t", latin, 0.90, "name_translit")), F.when(bridge, probe(3, "f", latin, 0.88, "name_translit_form")),
    ]
    folded = {e.translate(str.maketrans(T.GREEK_ACCENTED, T.GREEK_PLAIN)) for e in DEMONYMS}
    for i, e in enumerate(sorted(folded, key=lambda x: (-len(x), x))):
        peels, stem, at = form.endswith(e) & (n - len(e) >= 3), F.substr(form, F.lit(1), n - len(e)), 10 + 20 * i
        for k, more in enumerate(PLACE_ENDINGS):
            place = F.concat(stem, F.lit(more))
            probes += [F.when(peels, probe(at + 2 * k, "f", place, 0.84, "name_demonym_peel")), F.when(peels, probe(at + 2 * k + 1, "l", place, 0.84, "name_demonym_peel"))]
        old = peels & lang.isin("grc", "el")
        probes += [F.when(old, probe(at + 18, "f", T.greek_to_latin(stem), 0.82, "name_demonym_translit")), F.when(old, probe(at + 19, "t", T.greek_to_latin(stem), 0.82, "name_demonym_translit"))]
    probes.append(probe(10_000, "f", F.when(greek(form), latin).otherwise(form), 0.80, "name_contact_title"))
    asked = tokens.select("token", "lang").distinct().withColumn("__form", T.light_fold(F.col("token")))
    tried = asked.select("token", "lang", F.explode(F.array_compact(F.array(*probes))).alias("x")).select("token", "lang", "x.*")
    best = tried.join(keyed, "key").groupBy("token", "lang").agg(F.min_by(F.struct("meaning", "score", "method"), "place").alias("r"))
    return tokens.join(best.select("token", "lang", "r.*"), ["token", "lang"], "left")
