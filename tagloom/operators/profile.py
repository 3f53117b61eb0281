"""Association of items with groups: support, lift, shares by level, gap and match.

Input rows ``k, s, role, level`` hold each item of a posting once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals(rows: DataFrame) -> DataFrame:
    """``role, level, n``: postings per role (level null) and per role and level, in one pass."""
    k = rows.select("k", "role", "level").distinct()
    return k.groupingSets([["role"], ["role", "level"]], "role", "level").agg(F.count("*").alias("n"))


def role_edges(rows: DataFrame, support: float, least: int = 3) -> DataFrame:
    """``skill, role, count, support, lift`` of items frequent enough in a role.

    lift = ln(share in the role / share in all roles), from unrounded shares.
    """
    per = rows.groupBy("s", "role").agg(F.count("*").alias("n"))
    total = rows.select("k", "role").distinct().groupBy("role").agg(F.count("*").alias("total"))
    all_ = total.agg(F.sum("total").alias("tot"))
    share = F.col("n") / F.col("total").cast("double")
    overall = F.sum("n").over(Window.partitionBy("s")) / F.col("tot").cast("double")
    e = per.join(total, "role").join(F.broadcast(all_)).withColumn("lift", F.log(share / overall))
    return e.where((F.col("n") >= least) & (share >= support)).select(F.col("s").alias("skill"), "role", F.col("n").alias("count"), F.round(share, 4).alias("support"), F.round("lift", 4).alias("lift"))


def level_shares(rows: DataFrame, edges: DataFrame, floor: int) -> DataFrame:
    """``skill, role, level, share`` for levels of a role with ``floor`` postings or more."""
    denom = rows.select("k", "role", "level").distinct().groupBy("role", "level").agg(F.count("*").alias("denom")).where(F.col("denom") >= floor)
    per = rows.groupBy(F.col("s").alias("skill"), "role", "level").agg(F.count("*").alias("n"))
    known = edges.select("skill", "role").join(denom, "role")
    return known.join(per, ["skill", "role", "level"], "left").select("skill", "role", "level", F.round(F.coalesce("n", F.lit(0)) / F.col("denom").cast("double"), 4).alias("share"))


def gap_score(support: Column = None, lift: Column = None) -> Column:
    return (support if support is not None else F.col("support")) * F.greatest(lift if lift is not None else F.col("lift"), F.lit(0.1))


def gap(edges: DataFrame, have: DataFrame) -> DataFrame:
    """The edges of a role with ``have`` (``skill``): flag and score of what is missing."""
    h = have.select("skill").distinct().withColumn("__h", F.lit(True))
    return edges.join(h, "skill", "left").select(
        "skill", "role", "support", "lift", F.col("__h").isNotNull().alias("have"), F.round(gap_score(), 6).alias("score")
    )


def held_out(rows: DataFrame, train: DataFrame, support: float, least: int = 3) -> DataFrame:
    """``skill, role, count`` of held-out postings: frequent enough there, and no edge of ``train``."""
    total = rows.groupBy("role").agg(F.count_distinct("k").alias("total"))
    n = rows.groupBy(F.col("s").alias("skill"), "role").agg(F.count_distinct("k").alias("count")).join(total, "role")
    n = n.where((F.col("count") >= least) & (F.col("count") / F.col("total") >= support))
    return n.join(train.select("skill", "role"), ["skill", "role"], "left_anti").select("skill", "role", "count")


def match(edges: DataFrame, have: DataFrame) -> DataFrame:
    """``role, coverage, n_have, n_skills, matched, top_missing``, coverage weighted by support."""
    g = gap(edges, have)
    w = Window.partitionBy("role", "have").orderBy(F.desc("support"), "skill")
    g = g.withColumn("rn", F.row_number().over(w))
    missing = F.collect_list(F.when(~F.col("have") & (F.col("rn") <= 5), F.struct("rn", "skill")))
    return g.groupBy("role").agg(
        F.round(F.try_divide(F.sum(F.when(F.col("have"), F.col("support")).otherwise(0.0)), F.sum("support")), 6).alias("coverage"),
        F.count_if("have").alias("n_have"), F.count("*").alias("n_skills"),
        F.array_join(F.slice(F.array_sort(F.collect_list(F.when(F.col("have"), F.col("skill")))), 1, 15), "|").alias("matched"),
        F.array_join(F.transform(F.array_sort(missing), lambda x: x["skill"]), "|").alias("top_missing"),
    )


def null_rare(df: DataFrame, group: str, least: int) -> DataFrame:
    """``group`` set to null where fewer than ``least`` rows hold it; the counts are joined, not windowed, so a large group is no single task."""
    keep = df.groupBy(group).agg(F.count("*").alias("__n")).where((F.col("__n") >= least) & F.col(group).isNotNull()).withColumnRenamed(group, "__g")
    return df.join(keep, df[group] == keep["__g"], "left").withColumn(group, F.col("__g")).drop("__g", "__n")
