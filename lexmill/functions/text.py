"""String expressions. Each is a Column; the only Arrow function is the full Unicode fold, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of letters, digits, apostrophe, hyphen and underscore; the same in both regular-expression dialects.
TOKEN = r"[\p{L}\p{N}_'-]+"

# Accented Greek letters and their plain forms, one to one.
GREEK_ACCENTED = "άέήίόύώϊϋΐΰὕὖᾶῆῖῦῶὐ"
GREEK_PLAIN = "αεηιουωιυιυυυαηιυωυ"
# Greek letters that become two Latin ones, then those that become one.
GREEK_PAIRS = (("θ", "th"), ("φ", "ph"), ("χ", "ch"), ("ψ", "ps"))
GREEK_SINGLE = "ξηωυβγδζκλμνπρσςταειο"
LATIN_SINGLE = "xeoybgdzklmnprsstaeio"
VOWELS = "aeiouy"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def words(text: Column) -> Column:
    """Runs of a-z."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))


def _fold(texts: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        if x is None:
            return None
        split = unicodedata.normalize("NFD", x.strip().lower())
        return "".join("".join(c for c in split if unicodedata.category(c) != "Mn").split())

    return texts.map(one, na_action="ignore")


def fold(text: Column) -> Column:
    """Lower case without combining marks or white space."""
    return F.pandas_udf(_fold, "string")(text)


def light_fold(text: Column) -> Column:
    return F.translate(F.lower(F.trim(text)), GREEK_ACCENTED, GREEK_PLAIN)


def greek_to_latin(folded: Column) -> Column:
    for a, b in GREEK_PAIRS:
        folded = F.replace(folded, F.lit(a), F.lit(b))
    return F.regexp_replace(F.translate(folded, GREEK_SINGLE, LATIN_SINGLE), "[^a-z]", "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def edit_similarity(a: Column, b: Column, guard: bool = True) -> Column:
    """1 - distance / length of the longer; 1 for two empty strings, 0 for one. With the guard, 0 as well where the
    lengths differ by more than 4 and by more than 0.6 of the longer."""
    n, m = F.length(a), F.length(b)
    longest = F.greatest(n, m)
    out = 1 - F.levenshtein(a, b) / longest
    if guard:
        out = F.when(F.abs(n - m) > F.greatest(F.lit(4), F.floor(0.6 * longest)), 0.0).otherwise(out)
    return F.when(longest == 0, 1.0).when(F.least(n, m) == 0, 0.0).otherwise(out)


def grams(text: Column, n: int) -> Column:
    """All runs of n characters, repeats included; none if the text is shorter."""
    at = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.when(F.length(text) >= n, F.transform(at, lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.expr("cast(array() as array<string>)"))


def trigram_dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the sets of trigrams over ^text$; equality decides for texts of one character."""
    x, y = (F.array_distinct(grams(F.concat(F.lit("^"), t, F.lit("$")), 3)) for t in (a, b))
    short = (F.length(a) < 2) | (F.length(b) < 2)
    return F.when(short, (a == b).cast("double")).otherwise(2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def combined_similarity(a: Column, b: Column) -> Column:
    return 0.65 * edit_similarity(a, b) + 0.35 * trigram_dice(a, b)


def strip_suffixes(form: Column, suffixes: list[str], keep: int = 3) -> Column:
    """Distinct stems after removing one suffix, longest suffix first, that leave at least `keep` characters."""
    ordered = sorted(set(suffixes), key=lambda s: (-len(s), s))
    stems = [F.when(form.endswith(s) & (F.length(form) - len(s) >= keep), F.substr(form, F.lit(1), F.length(form) - len(s))) for s in ordered]
    return F.array_distinct(F.array_compact(F.array(*stems)))


def truncations(form: Column, most: int = 9, keep: int = 3) -> Column:
    """The form without its last 1 to `most` characters, at least `keep` left."""
    n = F.length(form)
    last = F.greatest(n - most, F.lit(keep))
    return F.when(n > keep, F.transform(F.sequence(n - 1, last), lambda i: F.substr(form, F.lit(1), i))).otherwise(F.expr("cast(array() as array<string>)"))


def soft_prefix(pred: Column, gold: Column) -> Column:
    """Equal, contained either way, or the same first four characters; false if one is empty."""
    p, g = F.lower(F.trim(pred)), F.lower(F.trim(gold))
    stem = (F.length(p) >= 4) & (F.length(g) >= 4) & (F.left(p, F.lit(4)) == F.left(g, F.lit(4)))
    return (F.length(p) > 0) & (F.length(g) > 0) & (p.contains(g) | g.contains(p) | stem)


def soft_recall(pred: Column, gold: Column, least: float = 0.5) -> Column:
    """Contained either way, or at least this share of the gold words found."""
    p, g = F.array_distinct(words(pred)), F.array_distinct(words(gold))
    both = F.size(F.array_intersect(p, g))
    a, b = F.lower(F.trim(pred)), F.lower(F.trim(gold))
    return (F.length(a) > 0) & (F.length(b) > 0) & (a.contains(b) | b.contains(a) | ((both > 0) & (both >= least * F.size(g))))


def clauses(text: Column) -> Column:
    """Parts at ; | / and free-standing dashes; parts of over 24 characters also at commas."""
    parts = F.filter(F.transform(F.split(F.trim(text), r"[;|/]|\s+[-—]\s+"), lambda s: F.trim(s)), lambda x: x != "")
    more = F.transform(parts, lambda p: F.when((F.length(p) > 24) & p.contains(","), F.filter(F.transform(F.split(p, ","), lambda s: F.trim(s)), lambda x: x != "")).otherwise(F.array(p)))
    return F.flatten(more)


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def vowel_share(text: Column) -> Column:
    """Vowels among letters; 0.5 without letters."""
    letters = count_of(F.lower(text), r"\p{L}")
    return F.when(letters == 0, 0.5).otherwise(count_of(F.lower(text), "[aeiou]") / letters)


def punctuation_density(text: Column) -> Column:
    return F.when(F.length(text) == 0, 0.0).otherwise(count_of(text, "[,.;:!?]") / F.length(text))


def repeats(array: Column) -> Column:
    """How many elements repeat an earlier one."""
    return F.size(array) - F.size(F.array_distinct(array))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when((a == "") | (b == ""), 0).when(first == 0, F.least(F.length(a), F.length(b))).otherwise(first.cast("int") - 1)


def ngrams_of(array: Column, n: int, sep: str = " ") -> Column:
    """Word n-grams joined by sep."""
    at = F.sequence(F.lit(1), F.size(array) - (n - 1))
    return F.when(F.size(array) >= n, F.transform(at, lambda i: F.array_join(F.slice(array, i, n), sep))).otherwise(F.expr("cast(array() as array<string>)"))


def explode_ngrams(df: DataFrame, keep: list[str], array: Column, n: int, name: str = "g") -> DataFrame:
    """One row per n-gram of an array expression. The array is a column of its own before the lambda sees it, else it would
    be computed for every element; and the outer explode keeps the optimizer from inferring a filter that would put it
    back there."""
    own = df.select(*keep, array.alias("__words"))
    return own.select(*keep, F.explode_outer(ngrams_of(F.col("__words"), n)).alias(name)).filter(F.col(name).isNotNull())
