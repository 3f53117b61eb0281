"""Greedy removal of near copies in order of arrival, without gathering a group."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.plans.lineage import cut


def greedy_dedup(df: DataFrame, key: str, group: str, items: str, threshold: float = 0.6) -> DataFrame:
    """Rows of ``df`` that a greedy pass keeps: within a group, in order of ``key``, a row is
    dropped if its set reaches the Jaccard ``threshold`` with a row kept before it.

    Copies of a set decide alike, so only the first of each is compared.  Similar sets meet
    on a token of their prefix; each round then settles the sets all of whose similar
    predecessors are settled, which gives exactly the result of the pass, in as many
    rounds as the longest chain of such sets.  A null group is a group; null and empty
    sets are kept once per group.  ``key`` must be unique.
    """
    f = Fraction(str(threshold))
    num, den = f.numerator, f.denominator
    g = F.coalesce(F.col(group).cast("string"), F.lit("␀"))
    rows = df.select(F.col(key).alias("k"), g.alias("g"), F.array_sort(F.array_distinct(F.coalesce(F.col(items), F.array().cast("array<string>")))).alias("s"))
    first = cut(rows.groupBy("g", "s").agg(F.min("k").alias("k")))
    tokens = first.select("g", "k", F.size("s").alias("n"), F.explode("s").alias("t"))
    often = tokens.groupBy("t").agg(F.count("*").alias("f"))
    # rarest first: such a token is shared by few sets, and only ids meet on it
    ordered = tokens.join(often, "t").groupBy("g", "k", "n").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("a"))
    n = F.col("n")
    p = ordered.select("g", "k", "n", F.explode(F.slice("a", 1, (n - F.ceil(n * num / den) + 1).cast("int"))).alias("x")).select("g", "x.t", "k", "n")
    a, b = p.select("g", "t", F.col("k").alias("late"), "n"), p.select("g", "t", F.col("k").alias("early"), F.col("n").alias("m"))
    near = a.join(b, ["g", "t"]).where((F.col("early") < F.col("late")) & (F.least("n", "m") * den >= F.greatest("n", "m") * num)).select("late", "early").distinct()
    sets = first.select("k", "s")
    near = near.join(sets.select(F.col("k").alias("late"), F.col("s").alias("x")), "late").join(sets.select(F.col("k").alias("early"), F.col("s").alias("y")), "early")
    both, size = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    pairs = cut(near.where(both * (num + den) >= size * num).select("late", "early"))
    state = cut(first.select("k", F.when(F.size("s") >= 0, F.lit(None).cast("boolean")).alias("keep")))
    while True:
        seen = pairs.join(state.select(F.col("k").alias("early"), F.col("keep").alias("kept")), "early")
        verdict = seen.groupBy(F.col("late").alias("k")).agg(F.max(F.coalesce("kept", F.lit(False))).alias("drop"), F.count_if(F.col("kept").isNull()).alias("open"))
        new = F.when(F.coalesce("drop", F.lit(False)), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        state = cut(state.join(verdict, "k", "left").select("k", F.coalesce("keep", new).alias("keep")))
        if state.where("keep is null").isEmpty():
            break
    return df.join(state.where("keep").select(F.col("k").alias(key)), key, "left_semi")
