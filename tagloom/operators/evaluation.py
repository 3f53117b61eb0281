"""Evaluation: masked ranks, hits, reciprocal ranks, AUC, average precision, negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.ranking import running


def mask(items: DataFrame, least: int = 4) -> DataFrame:
    """``k, s, masked``: of each basket of ``least`` items or more a third, one at least, is masked.

    The items come in the order of a hash of basket and item, so the choice is the same
    at every run and in every engine.
    """
    b = _hashed(items, least)
    return b.select("k", "n", F.posexplode("a").alias("pos", "x")).select("k", F.col("x.s").alias("s"), (F.col("pos") < F.col("n")).alias("masked"))


def parted(items: DataFrame, least: int = 4) -> DataFrame:
    """``k, known, masked``: :func:`mask` as two arrays per basket."""
    b = _hashed(items, least)
    return b.select("k", F.expr("slice(a.s, int(n) + 1, size(a))").alias("known"), F.expr("slice(a.s, 1, int(n))").alias("masked"))


def _hashed(items: DataFrame, least: int) -> DataFrame:
    order = F.md5(F.concat_ws("|", F.col("k").cast("string"), "s"))
    b = items.groupBy("k").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "s"))).alias("a")).where(F.size("a") >= least)
    return b.select("k", "a", F.greatest(F.lit(1), F.floor(F.size("a") / 3)).alias("n"))


def basket_scores(masked: DataFrame, scores: DataFrame, *values: str) -> DataFrame:
    """``k, j`` and summed scores of every candidate of a basket; known items are no candidates."""
    known = masked.where("not masked").select("k", F.col("s").alias("i"))
    s = known.join(scores, "i").groupBy("k", "j").agg(*[F.sum(v).alias(v) for v in values])
    return s.join(known.withColumnRenamed("i", "j"), ["k", "j"], "left_anti")


def target_ranks(masked: DataFrame, candidates: DataFrame, score: Column, by: tuple[str, ...] = ("k",)) -> DataFrame:
    """``k, s, rank`` of each masked item among the candidates of its basket; ties by name."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.round(score, 6)), "j")
    r = candidates.withColumn("rank", F.row_number().over(w))
    return r.join(masked.where("masked").select("k", F.col("s").alias("j")), ["k", "j"]).select(*by, F.col("j").alias("s"), "rank")


def hits(ranks: DataFrame, *by: str) -> DataFrame:
    hit = [F.round(F.avg((F.col("rank") <= k).cast("int")), 6).alias(f"hits_{k}") for k in (5, 10, 20)]
    return ranks.groupBy(*by).agg(*hit, F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr"), F.count("*").alias("n_targets"))


def auc(df: DataFrame, score: str, label: str, *by: str) -> DataFrame:
    """Area under the ROC curve, ties counted half, from one row per distinct score.

    Equal scores are summed first, so the ordered pass runs over distinct scores only.
    Null where a class is missing.
    """
    y = F.col(label).cast("int")
    g = running(df.groupBy(*by, score).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("q")), score, "q", by=by)
    won = F.sum(F.col("p") * (F.col("before_q") + F.col("q") / 2.0))
    return g.groupBy(*by).agg(F.round(F.try_divide(won, F.sum("p") * F.sum("q")), 6).alias("auc"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Precision at each distinct threshold, weighted by the recall it adds."""
    y = F.col(label).cast("int")
    g = running(df.groupBy(score).agg(F.sum(y).alias("p"), F.count("*").alias("n")), score, "p", "n", descending=True)
    g = g.withColumn("tp", F.col("before_p") + F.col("p")).withColumn("at", F.col("before_n") + F.col("n"))
    return g.agg(F.round(F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("at")), F.sum("p")), 6).alias("average_precision"))


def band(count: Column) -> Column:
    """Support bands: 3-5, 6-10, 11+."""
    return F.when(count.between(3, 5), "3-5").when(count.between(6, 10), "6-10").when(count >= 11, "11+")


def degree_bucket(d: Column) -> Column:
    return F.floor(F.log1p(d.cast("double")) * 2).cast("int")


def negatives(positives: DataFrame, degrees: DataFrame, edges: DataFrame, tries: int = 20) -> DataFrame:
    """``source, target, negative``: a node of the target's degree bucket, not linked to the source.

    The nodes of a bucket stand in the order of a hash; a positive looks at ``tries`` of
    them in turn, from a place that its own hash gives, and takes the first that
    qualifies.  Positives without any are left out.
    """
    d = degrees.select(F.col("i").alias("x"), degree_bucket(F.col("d")).alias("b"))
    order = Window.partitionBy("b").orderBy(F.md5("x"), "x")
    placed = d.withColumn("at", (F.row_number().over(order) - 1).cast("long"))
    size = d.groupBy("b").agg(F.count("*").alias("n"))
    begin = F.conv(F.substring(F.md5(F.concat_ws("|", "source", "target")), 1, 8), 16, 10).cast("long")
    c = positives.join(d.withColumnRenamed("x", "target"), "target").join(F.broadcast(size), "b")  # one row per doubling of degrees
    c = c.select("source", "target", "b", "n", begin.alias("begin"), F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("t")).where("t < n")
    c = c.withColumn("at", (F.col("begin") + F.col("t")) % F.col("n")).join(placed.withColumnRenamed("x", "negative"), ["b", "at"])
    taken = edges.select(F.col("i").alias("source"), F.col("j").alias("negative"))
    c = c.where("negative != source and negative != target").join(taken, ["source", "negative"], "left_anti")
    return c.groupBy("source", "target").agg(F.min_by("negative", "t").alias("negative"))


def mean_neighbours(adjacency: DataFrame, vectors: DataFrame) -> DataFrame:
    """``i, pos, x``: the mean vector of each node's neighbours, one row per dimension."""
    v = vectors.select(F.col("s").alias("j"), F.posexplode("v").alias("pos", "x"))
    return adjacency.select("i", "j").join(v, "j").groupBy("i", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
