"""Predicates and scores of glosses, as Column expressions over lower-case keys with underscores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import count_of

# First words that make a gloss grammatical.
GRAMMAR_HEADS = (
    "nominative genitive dative accusative ablative vocative locative singular plural dual masculine feminine neuter "
    "present perfect imperfect future pluperfect aorist active passive middle deponent indicative subjunctive optative "
    "imperative infinitive participle first second third person comparative superlative alternative_form misspelling "
    "archaic_form obsolete_form initialism abbreviation acronym synonym diminutive augmentative present_active "
    "perfect_passive future_active future_passive supine gerund gerundive"
).split()
# Words of which two among three or more make a gloss grammatical.
GRAMMAR_WORDS = (
    "nominative genitive dative accusative ablative vocative singular plural masculine feminine neuter of form active "
    "passive present perfect infinitive participle first second third person indicative subjunctive optative imperative "
    "middle deponent inflection spelling obsolete clipping alternative"
).split()
# Words that make a gloss with at most one other long word grammatical.
CASE_WORDS = (
    "nominative genitive dative accusative ablative vocative singular plural masculine feminine neuter participle "
    "infinitive indicative subjunctive optative spelling obsolete clipping"
).split()
# Glosses that say nothing.
SHELLS = (
    "narrative_flow heritage_flow generic_dynamics fluid_resonance primordial_signal unknown inflection inflections "
    "grammar grammatical form word lemma stem root ending suffix prefix"
).split()
# Texts anywhere in a gloss that make it garbage.
GRAMMAR_TEXT = (
    "dative|genitive|accusative|nominative|vocative|ablative|singular of|plural of|participle of|imperative of|"
    "the compound|compound of|with genitive|with dative"
)
# Words without content.
STOP = "the and for with from that this into onto upon a an of to in on or by as at".split()


def _key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "^_+|_+$", "")


def is_grammatical(text: Column) -> Column:
    m = _key(text)
    bits = F.split(m, "_")
    cases = F.filter(bits, lambda b: b.isin(CASE_WORDS))
    rest = F.filter(bits, lambda b: ~b.isin(CASE_WORDS) & (F.length(b) >= 3))
    case_like = (F.size(cases) > 0) | F.exists(bits, lambda b: b.endswith("genitive") | b.endswith("dative"))
    return (
        (m == "")
        | m.rlike(f"^(?:{'|'.join(GRAMMAR_HEADS)})(?:_|$)")
        | m.contains("form_of_")
        | m.rlike("^(initialism_of|inflection_of_|name_of_)")
        | ((F.size(bits) >= 3) & (F.size(F.filter(bits, lambda b: b.isin(GRAMMAR_WORDS))) >= 2))
        | (case_like & (F.size(rest) <= 1))
    )


def is_garbage(text: Column) -> Column:
    m = _key(text)
    bits = F.filter(F.split(m, "_"), lambda b: b != "")
    letters, vowels = count_of(m, "[a-z]"), count_of(m, "[aeiouy]")
    ones = F.size(F.filter(bits, lambda b: F.length(b) <= 1))
    n = F.size(bits)
    return (
        is_grammatical(m)
        | (F.length(m) > 90)
        | (count_of(m, "_") > 14)
        | ((letters >= 8) & (vowels < 0.15 * letters))
        | ((n >= 2) & (ones >= F.greatest(F.lit(2), F.floor(n / 2))))
        | (m.contains("_") & (~F.exists(bits, lambda b: F.length(b) >= 4) | (ones >= 2)))
        | (m.rlike("_[a-z]$") & (F.length(m) <= 16))
        | m.rlike("^[a-z]{3,12}_[a-z]{1,2}$")
        | m.isin(SHELLS)
        | m.rlike(GRAMMAR_TEXT)
    )


def content_score(text: Column) -> Column:
    """0 for an empty gloss, 0.05 for garbage, 0.2 without content words, else more for concrete and short ones."""
    raw = F.coalesce(text, F.lit(""))
    found = F.filter(F.regexp_extract_all(F.lower(raw), F.lit("([a-z]{3,})"), F.lit(1)), lambda w: ~w.isin(STOP))
    score = F.least(F.lit(1.0), 0.4 + 0.1 * F.size(found) + 0.3 * F.least(F.lit(1.0), 12.0 / F.greatest(F.lit(4), F.length(raw))))
    return (
        F.when(raw == "", 0.0).when(is_garbage(raw), 0.05).when(F.size(found) == 0, 0.2)
        .when(F.length(raw) > 50, 0.7 * score).otherwise(score)
    )


def gloss_score(clean: Column) -> Column:
    """The compiled product's score: length bands and a bonus for one word."""
    n = F.length(clean)
    band = F.when(n <= 2, -0.35).when(n == 3, 0.05).when(n <= 12, 0.35).when(n <= 24, 0.15).otherwise(0.05)
    return F.when(n == 0, 0.0).otherwise(0.5 + band + F.when(~clean.contains(" "), 0.15).otherwise(0.0))


# Starts of definitions that only refer to another.
REFERRING = ("see ", "cf.", "compare ", "variant of", "alternative form", "misspelling", "obsolete", "archaic spelling")


def head_gloss(text: Column) -> Column:
    """First clause without numbering or wiki markup; null unless 2 to 60 characters, two ASCII letters, and no mere reference."""
    d = F.trim(F.split(F.trim(text), "[\n;|]")[0])
    d = F.regexp_replace(d, r"\s+", " ")
    d = F.regexp_replace(d, r"^[(\[]?\d+[)\].:]\s*", "")
    d = F.regexp_replace(d, r"^[A-Za-z]\)\s*", "")
    d = F.regexp_replace(d, r"\{\{[^}]+\}\}", "")
    d = F.regexp_replace(d, r"\[\[(?:[^|\]]+\|)?([^\]]+)\]\]", "$1")
    d = F.regexp_replace(d, r"^[ .,;:-]+|[ .,;:-]+$", "")
    refers = F.lower(d).rlike("^(" + "|".join(s.replace(".", r"\.") for s in REFERRING) + ")")
    return F.when(F.length(d).between(2, 60) & (count_of(d, "[A-Za-z]") >= 2) & ~refers, d)


def referent(text: Column) -> Column:
    """What follows the last _of_, without articles and grammar."""
    m = F.lower(F.trim(text))
    tail = F.regexp_extract(m, "^.*_of_(.*)$", 1)
    drop = ["the", "a", "an", "masculine", "feminine", "neuter", "singular", "plural", "active", "passive"]
    parts = F.filter(F.split(tail, "_"), lambda b: (b != "") & ~b.isin(drop))
    return F.when(m.contains("_of_") & (F.size(parts) > 0), F.array_join(parts, "_"))
