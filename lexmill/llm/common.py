"""Expressions and helpers that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words split by ASCII white space.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Words of ASCII digits, lower-case letters and everything beyond ASCII.
NOT_ALNUM_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under names of our own, so that others can't clash."""
    return df.select(*[F.col(f"`{theirs}`").alias(ours) for ours, theirs in columns.items()])


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    name, k = f"__{stem}", 0
    while name.lower() in taken:
        k += 1
        name = f"__{stem}{k}"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. lower() does the same wherever it leaves what is beyond ASCII alone,
    and is much faster than translate()."""
    beyond = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    return F.when(F.lower(beyond) == beyond, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def space_words(text: Column) -> Column:
    """Array of words split by ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN, -1), "")


def alnum_words(text: Column) -> Column:
    """Array of lower-cased words of letters, digits and what is beyond ASCII; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_ALNUM_RUN, -1), "")


def hash_share(key: Column, seed: int = 42) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)).cast("double") / float(1 << 30)
