"""Functions against hand-made cases."""

import math

import pytest
from pyspark.sql import functions as F

from lexmill.functions import gloss as G
from lexmill.functions import scalar as S
from lexmill.functions import text as T


def one(spark, column, **values):
    row = spark.range(1).select(*[(F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v))).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, folded", [("Κρής", "κρης"), ("Āqua", "aqua"), ("ΚΡΗΣ", "κρης"), (" a b ", "ab"), ("", "")])
def test_fold(spark, text, folded):
    assert one(spark, T.fold(F.col("t")), t=text) == folded


def test_fold_null(spark):
    assert spark.createDataFrame([(None,)], "t string").select(T.fold(F.col("t")).alias("x")).first()["x"] is None


def test_edit_similarity(spark):
    sim = lambda a, b, **k: one(spark, T.edit_similarity(F.col("a"), F.col("b"), **k), a=a, b=b)
    assert sim("manibus", "manus") == pytest.approx(1 - 2 / 7)
    assert sim("", "") == 1.0 and sim("a", "") == 0.0
    assert sim("abcdefghij", "abc") == 0.0 and sim("abcdefghij", "abc", guard=False) > 0


def test_trigram_dice(spark):
    dice = lambda a, b: one(spark, T.trigram_dice(F.col("a"), F.col("b")), a=a, b=b)
    assert dice("abc", "abc") == 1.0 and dice("a", "b") == 0.0 and dice("a", "a") == 1.0
    assert dice("abcd", "abce") == pytest.approx(2 * 2 / 8)


def test_common_prefix(spark):
    length = lambda a, b: one(spark, T.common_prefix(F.col("a"), F.col("b")), a=a, b=b)
    assert [length("abc", "abd"), length("abc", "abc"), length("abc", "abcd"), length("", "x"), length("x", "y")] == [2, 3, 3, 0, 0]


def test_soft_predicates_differ(spark):
    assert one(spark, T.soft_prefix(F.col("a"), F.col("b")), a="handle", b="hand of a king")
    assert not one(spark, T.soft_recall(F.col("a"), F.col("b")), a="handle", b="hand of a king")
    assert one(spark, T.soft_recall(F.col("a"), F.col("b")), a="the hand of", b="hand of god") and not one(spark, T.soft_recall(F.col("a"), F.col("b"), 0.9), a="the hand of", b="hand of god")


def test_clauses(spark):
    assert one(spark, T.clauses(F.col("t")), t="a; b | c - d") == ["a", "b", "c", "d"]
    assert one(spark, T.clauses(F.col("t")), t="short, one") == ["short, one"]
    assert one(spark, T.clauses(F.col("t")), t="a rather long gloss, with a second part") == ["a rather long gloss", "with a second part"]


@pytest.mark.parametrize("text, head", [("1. (of water) clear; pure", "(of water) clear"), ("x", None), ("2) 12 34", None), ("a) the [[hand]] of a king", "the hand of a king")])
def test_head_gloss(spark, text, head):
    assert one(spark, G.head_gloss(F.col("t")), t=text) == head


@pytest.mark.parametrize("text, grammatical, garbage", [
    ("water", False, False), ("nominative_plural_of_aqua", True, True), ("a_t_os", False, True), ("glaphur_s", False, True), ("", True, True),
    ("king_of_rome", False, False), ("unknown", False, True), ("bcdfghjkl", False, True),
])
def test_gloss_predicates(spark, text, grammatical, garbage):
    assert one(spark, G.is_grammatical(F.col("t")), t=text) == grammatical and one(spark, G.is_garbage(F.col("t")), t=text) == garbage


def test_content_score_order(spark):
    score = lambda t: one(spark, G.content_score(F.col("t")), t=t)
    assert score("") == 0.0 and score("genitive_of_rex") == 0.05 and score("upon with from") == 0.2
    assert score("water") == pytest.approx(0.8) and score("water") > score("great_stone_house_of_the_old_king_in_the_mountains_beyond_the_sea")


@pytest.mark.parametrize("d, dpsi, want", [(12.0, 0.8, 0.6513247618848969), (21.0, 0.8, 0.6325783360136283), (6.0, 1.0, 0.9555063001027196)])
def test_scalar_golden(spark, d, dpsi, want):
    got = one(spark, S.panel(d_eff=F.col("d"), dpsi=F.col("p"), dtheta=1.0, observed=True)["s"], d=d, p=dpsi)
    assert abs(got - want) < 1e-10


def test_scalar_constants():
    assert S.K == pytest.approx(0.4202216641606967, abs=1e-15) and S.C_EFF == pytest.approx(0.9577022026205613, abs=1e-15) and S.P_VAR == pytest.approx(0.9579871226722757, abs=1e-15)


def test_golden_series(spark):
    phi = (1 + math.sqrt(5)) / 2
    assert one(spark, S.golden_series(F.col("v")), v=[1.0, 2.0]) == pytest.approx((1 + 2 / phi) / (1 + 1 / phi))
    assert one(spark, S.seeded_dimension(F.col("t")), t="linguistic") == one(spark, S.seeded_dimension(F.col("t")), t="LINGUISTIC")


def test_truncations_and_suffixes(spark):
    assert one(spark, T.truncations(F.col("t")), t="manibus") == ["manibu", "manib", "mani", "man"]
    assert one(spark, T.truncations(F.col("t")), t="abc") == []
    assert one(spark, T.strip_suffixes(F.col("t"), ["ibus", "us", "s"]), t="manibus") == ["man", "manib", "manibu"]
