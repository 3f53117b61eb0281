"""Co-occurrence graph: pairs, PMI, degrees, structural indices, held-out edges.

An edge table holds each undirected edge once, ``source < target``; an adjacency table
both directions as ``i, j``.  Items come as rows ``k, s`` without repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Neighbours of a hub that are paired in one task.
HUB = 5_000


def pair_counts(items: DataFrame) -> DataFrame:
    """``source, target, count`` of items in one basket.

    The baskets are gathered once and their pairs generated in place, so the items are
    shuffled once by basket and the partly summed pairs once more.
    """
    return array_pairs(items.groupBy("k").agg(F.array_sort(F.collect_set("s")).alias("a")).where(F.size("a") >= 2))


def array_pairs(baskets: DataFrame) -> DataFrame:
    """``source, target, count`` of baskets that are gathered already: ``a``, the sorted items of each."""
    pairs = F.flatten(F.transform("a", lambda x, i: F.transform(F.slice("a", i + 2, F.size("a")), lambda y: F.struct(x.alias("source"), y.alias("target")))))
    return baskets.select(F.explode(pairs).alias("p")).groupBy("p.source", "p.target").agg(F.count("*").alias("count"))


def doc_freq(items: DataFrame) -> DataFrame:
    return items.groupBy("s").agg(F.count("*").alias("doc_freq"))


def pmi(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    return F.log(n_ab.cast("double") * n / (n_a.cast("double") * n_b))


def pmi_edges(items: DataFrame, least: int = 3) -> DataFrame:
    """``source, target, count, pmi``: pairs with enough joint baskets and positive PMI."""
    return _positive(pair_counts(items), doc_freq(items), items.agg(F.count_distinct("k").alias("n")), least)


def basket_edges(baskets: DataFrame, least: int = 3) -> DataFrame:
    """:func:`pmi_edges` of baskets that are gathered already, ``k, a``: only sums are shuffled."""
    return _positive(array_pairs(baskets), doc_freq(baskets.select(F.explode("a").alias("s"))), baskets.agg(F.count("k").alias("n")), least)


def _positive(pairs: DataFrame, freq: DataFrame, n: DataFrame, least: int) -> DataFrame:
    a = freq.select(F.col("s").alias("source"), F.col("doc_freq").alias("fa"))
    b = freq.select(F.col("s").alias("target"), F.col("doc_freq").alias("fb"))
    e = pairs.where(F.col("count") >= least).join(a, "source").join(b, "target").join(F.broadcast(n))
    v = pmi(F.col("count"), F.col("fa"), F.col("fb"), F.col("n"))
    return e.withColumn("v", v).where("v > 0").select("source", "target", "count", F.round("v", 4).alias("pmi"))


def adjacency(edges: DataFrame) -> DataFrame:
    """``i, j`` and the edge's columns, both ways; one pass over the edges."""
    rest = [c for c in edges.columns if c not in ("source", "target")]
    both = F.explode(F.array(F.struct(F.col("source").alias("i"), F.col("target").alias("j")), F.struct(F.col("target").alias("i"), F.col("source").alias("j"))))
    return edges.select(both.alias("x"), *rest).select("x.i", "x.j", *rest)


def degree(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy("i").agg(F.count("*").alias("d"))


def shared_neighbours(edges: DataFrame, weight: Column | None = None) -> DataFrame:
    """``i, j, v``: sum over common neighbours of ``weight`` (of their degree ``d``), i = j included.

    Each pair is summed once, i <= j, and turned round at the end.  A hub's neighbours are
    paired in parts: each is sent with one part of the others to a task.
    """
    adj = adjacency(edges).select("i", "j")
    w = weight if weight is not None else F.lit(1)
    parts = F.ceil(F.col("d") / HUB).cast("int")
    near = adj.join(degree(edges).withColumnRenamed("i", "j"), "j").select("i", "j", w.alias("w"), parts.alias("k"), F.pmod(F.xxhash64("i"), parts).cast("int").alias("part"))
    left = near.select("i", "j", "w", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"))
    right = near.select(F.col("i").alias("i2"), "j", "part")
    half = left.join(right, ["j", "part"]).where("i <= i2").groupBy("i", "i2").agg(F.sum("w").alias("v"))
    both = F.when(F.col("i") == F.col("i2"), F.array(F.struct("i", F.col("i2").alias("j")))).otherwise(F.array(F.struct("i", F.col("i2").alias("j")), F.struct(F.col("i2").alias("i"), F.col("i").alias("j"))))
    return half.select(F.explode(both).alias("x"), "v").select("x.i", "x.j", "v")


def _with_degrees(edges: DataFrame) -> DataFrame:
    d = degree(edges)
    s = shared_neighbours(edges)
    return s.join(d.withColumnRenamed("d", "di"), "i").join(d.select(F.col("i").alias("j"), F.col("d").alias("dj")), "j")


def resource_allocation(edges: DataFrame) -> DataFrame:
    return shared_neighbours(edges, 1.0 / F.greatest(F.col("d"), F.lit(1)))


def adamic_adar(edges: DataFrame) -> DataFrame:
    return shared_neighbours(edges, 1.0 / F.log(F.greatest(F.col("d"), F.lit(2)).cast("double")))


def jaccard(edges: DataFrame) -> DataFrame:
    return _with_degrees(edges).select("i", "j", (F.col("v") / F.greatest(F.col("di") + F.col("dj") - F.col("v"), F.lit(1))).alias("v"))


def salton(edges: DataFrame) -> DataFrame:
    return _with_degrees(edges).select("i", "j", (F.col("v") / F.sqrt(F.greatest(F.col("di") * F.col("dj"), F.lit(1)).cast("double"))).alias("v"))


def hub_depressed(edges: DataFrame) -> DataFrame:
    return _with_degrees(edges).select("i", "j", (F.col("v") / F.greatest("di", "dj", F.lit(1))).alias("v"))


INDICES = {"resource_allocation": resource_allocation, "jaccard": jaccard, "adamic_adar": adamic_adar, "salton": salton, "hub_depressed": hub_depressed}


def top_neighbours(edges: DataFrame, by: str, n: int) -> DataFrame:
    """The ``n`` neighbours of each node with the largest ``by``; ties by name."""
    from pyspark.sql import Window

    w = Window.partitionBy("i").orderBy(F.desc(by), "j")
    return adjacency(edges).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def conditional(edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """``i, j, p``: P(j | i) = joint count / mentions of i, both ways, rounded to 4 places."""
    m = mentions.select(F.col("s").alias("i"), "mentions")
    return adjacency(edges).join(m, "i").select("i", "j", F.round(F.try_divide(F.col("count").cast("double"), F.col("mentions")), 4).alias("p"))


def held_out(items: DataFrame, train: DataFrame, nodes: DataFrame, least: int = 3) -> DataFrame:
    """Pairs of held-out baskets that reach the floor, join known nodes and are no train edge."""
    known = nodes.select("s")
    p = pair_counts(items).where(F.col("count") >= least)
    p = p.join(known.withColumnRenamed("s", "source"), "source", "left_semi").join(known.withColumnRenamed("s", "target"), "target", "left_semi")
    return p.join(train.select("source", "target"), ["source", "target"], "left_anti").select("source", "target", "count")
