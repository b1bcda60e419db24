"""The climb loop: score, learn stems from misses, merge, repeat until a plateau."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators.merge import union_by_precedence
from lexmill.session import cut


def resolve(tokens: DataFrame, store: DataFrame) -> DataFrame:
    """token, meaning for tokens that the store has, itself or cut by one to four characters; the longest key wins."""
    tried = tokens.select("token", F.explode(F.concat(F.array("token"), T.truncations(F.col("token"), most=4))).alias("form"))
    found = tried.join(store, "form")
    return found.groupBy("token").agg(F.max_by("meaning", F.struct(F.length("form"), "form")).alias("meaning"))


def climb(tokens: DataFrame, store: DataFrame, rounds: int = 5, patience: int = 1) -> DataFrame:
    """token, meaning after the last round. Each round's store is written to the shared folder, so a lost executor or a
    restart costs one round; only the count of resolved tokens comes to the driver."""
    best, stale = -1, 0
    found = resolve(tokens, store)
    for _ in range(rounds):
        found = cut(resolve(tokens, store))
        n = found.count()
        if n <= best:
            stale += 1
            if stale >= patience:
                break
        else:
            best, stale = n, 0
        misses = tokens.join(found, "token", "left_anti")
        near = misses.select(F.substr("token", F.lit(1), F.greatest(F.length("token") - 3, F.lit(3))).alias("stem"))
        learnt = store.join(near.distinct(), F.col("form").startswith(F.col("stem")) & (F.left("form", F.lit(3)) == F.left("stem", F.lit(3))))
        learnt = learnt.groupBy(F.col("stem").alias("form")).agg(F.min("meaning").alias("meaning"))
        store = cut(union_by_precedence([learnt, store.select("form", "meaning")], ["form"]))
    return found
