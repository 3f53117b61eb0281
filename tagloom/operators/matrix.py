"""Score matrices in coordinate form: standardising, blending, scoring of many queries.

A matrix is ``i, j, v`` over N x N nodes; cells that aren't there are zero.  Statistics
count the zeros without making them, so a sparse matrix is never filled to be measured.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.plans.lineage import cut


def _std(n: Column, s: Column, q: Column) -> Column:
    """Unbiased standard deviation from count, sum and sum of squares, at least 1e-8."""
    return F.greatest(F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))), F.lit(1e-8))


def dense(m: DataFrame, nodes: DataFrame) -> DataFrame:
    """All cells; for node sets of the size of a vocabulary, whose cells are wanted as output."""
    n = nodes.select("s")
    cells = n.select(F.col("s").alias("i")).crossJoin(n.select(F.col("s").alias("j")))
    return cells.join(m, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))


def standardise(m: DataFrame, nodes: DataFrame) -> DataFrame:
    """z-score over the whole matrix; returns the stored cells and, as ``z0``, the value of the zero ones."""
    n = nodes.agg(F.count("*").cast("double").alias("n"))
    t = m.agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).join(n)
    t = t.select((F.col("s") / (F.col("n") * F.col("n"))).alias("mu"), _std(F.col("n") * F.col("n"), F.col("s"), F.col("q")).alias("sd"))
    return m.join(F.broadcast(t)).select("i", "j", ((F.col("v") - F.col("mu")) / F.col("sd")).alias("v"), (-F.col("mu") / F.col("sd")).alias("z0"))


def row_standardise(m: DataFrame, nodes: DataFrame) -> DataFrame:
    """z-score of each row: stored cells and ``z0`` of the row's zero cells."""
    n = nodes.agg(F.count("*").cast("double").alias("n"))
    r = m.groupBy("i").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).join(F.broadcast(n))
    r = r.select("i", (F.col("s") / F.col("n")).alias("mu"), _std(F.col("n"), F.col("s"), F.col("q")).alias("sd"))
    return m.join(r, "i").select("i", "j", ((F.col("v") - F.col("mu")) / F.col("sd")).alias("v"), (-F.col("mu") / F.col("sd")).alias("z0"))


def row_col_parts(m: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What rows, then columns standardised are made of: stored cells of the rows, zeros of the rows, and the columns.

    (``i, j, v, z0``; ``i, z0``; ``j, cmu, csd``.)  Column sums are the sum of all rows'
    zero values plus what the stored cells differ by.
    """
    z = cut(row_standardise(m, nodes))
    n = nodes.agg(F.count("*").cast("double").alias("n"))
    rows = z.select("i", "z0").distinct()
    base = rows.agg(F.sum("z0").alias("s0"), F.sum(F.col("z0") * F.col("z0")).alias("q0")).join(n)
    d = z.groupBy("j").agg(F.sum(F.col("v") - F.col("z0")).alias("ds"), F.sum(F.col("v") * F.col("v") - F.col("z0") * F.col("z0")).alias("dq"))
    cols = nodes.select(F.col("s").alias("j")).join(d, "j", "left").join(F.broadcast(base))
    s, q = F.coalesce("s0", F.lit(0.0)) + F.coalesce("ds", F.lit(0.0)), F.coalesce("q0", F.lit(0.0)) + F.coalesce("dq", F.lit(0.0))
    return z, rows, cols.select("j", (s / F.col("n")).alias("cmu"), _std(F.col("n"), s, q).alias("csd"))


def known_scores(m: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """``j, score``: for each node the sum of its cells over the ``known`` rows (``s``, repeats count), rows, then columns standardised.

    Only cells of the known rows are read and no zero one is made: a node's sum is that of
    the rows' zeros, plus what its stored cells differ by, less the column's mean.
    """
    z, rows, cols = row_col_parts(m, nodes)
    q = known.groupBy(F.col("s").alias("i")).agg(F.count("*").alias("w"))
    base = q.join(rows, "i", "left").agg(F.sum("w").alias("k"), F.coalesce(F.sum(F.col("w") * F.coalesce("z0", F.lit(0.0))), F.lit(0.0)).alias("zeros"))
    own = z.join(q, "i").groupBy("j").agg(F.sum(F.col("w") * (F.col("v") - F.col("z0"))).alias("more"))
    s = cols.join(own, "j", "left").join(F.broadcast(base)).where("k is not null")
    return s.select("j", ((F.col("zeros") + F.coalesce("more", F.lit(0.0)) - F.col("k") * F.col("cmu")) / F.col("csd")).alias("score"))


def row_col_standardise(m: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows, then columns standardised, as all cells; to score some rows use :func:`known_scores`."""
    z, rows, cols = row_col_parts(m, nodes)
    cells = nodes.select(F.col("s").alias("i")).join(rows, "i", "left").crossJoin(cols).join(z.select("i", "j", "v"), ["i", "j"], "left")
    return cells.select("i", "j", ((F.coalesce("v", "z0", F.lit(0.0)) - F.col("cmu")) / F.col("csd")).alias("v"))


def blend(a: DataFrame, b: DataFrame, weight: Column) -> DataFrame:
    """weight * a + (1 - weight) * b over the cells of both (columns ``i, j, v``)."""
    return a.withColumnRenamed("v", "va").join(b.withColumnRenamed("v", "vb"), ["i", "j"]).withColumn("w", weight).select("i", "j", (F.col("w") * F.col("va") + (1 - F.col("w")) * F.col("vb")).alias("v"))


def summed(scores: DataFrame, known: DataFrame) -> DataFrame:
    """``j, score``: the sum of each node's cells over the known rows, a name given twice weighing twice."""
    return scores.join(known.select(F.col("s").alias("i")), "i").groupBy("j").agg(F.sum("v").alias("score"))


def unknown(scored: DataFrame, known: DataFrame) -> DataFrame:
    """``scored`` without the known nodes; nothing else is cut, so masks and exclusions may follow before the ranking."""
    return scored.join(known.select(F.col("s").alias("j")).distinct(), "j", "left_anti")


def recommend(scores: DataFrame, known: DataFrame, k: int, dedupe: bool = False) -> DataFrame:
    """``j, score, rank``: the best ``k`` nodes by summed score over the known rows, these left out.

    A name given twice weighs twice unless ``dedupe``; ties by name.
    """
    return ranked(unknown(summed(scores, known.distinct() if dedupe else known), known), k)


def ranked(s: DataFrame, k: int) -> DataFrame:
    """The best ``k``, once, at the end; ties by name."""
    s = s.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "j").limit(k)
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "j")))


def role_mask(lift: Column) -> Column:
    """Factor of a target role: 1 + lift, between 0.1 and above; -1 where there is none."""
    return F.greatest(1 + F.greatest(F.coalesce(lift, F.lit(-1.0)), F.lit(-0.9)), F.lit(0.1))


def unit(v: Column) -> Column:
    """L2-normalised array of doubles; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_pairs(vectors: DataFrame, least: float, block: int = 2000, both: bool = False) -> DataFrame:
    """``i, j, v`` with cosine >= ``least`` of all pairs (i < j, or ``both`` and i = j), by blocks.

    Vectors ``id, v`` are hashed to blocks of about ``block`` rows and each two blocks are
    multiplied as matrices in one task, so no task holds more than two blocks.  Null
    vectors are left out; a zero vector has cosine 0 with all.
    """
    vectors = vectors.where("v is not null")
    n = max(1, -(-vectors.count() // block))
    b = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    x = vectors.select("id", "v", b.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("o"))
    x = x.select("id", "v", "b", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"))
    kind = dict(vectors.dtypes)["id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        norm = np.sqrt((m * m).sum(1, keepdims=True))
        m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
        ids, blk, p, q = pdf["id"].to_numpy(), pdf["b"].to_numpy(), pdf["p"].iloc[0], pdf["q"].iloc[0]
        left, right = np.flatnonzero(blk == p), np.flatnonzero(blk == q)
        sim = m[left] @ m[right].T
        r, c = np.nonzero(sim >= least)
        a, z, v = ids[left[r]], ids[right[c]], sim[r, c]
        if p != q and both:
            a, z, v = np.concatenate([a, z]), np.concatenate([z, a]), np.concatenate([v, v])
        elif p != q:
            a, z = np.where(a < z, a, z), np.where(a < z, z, a)
        out = pd.DataFrame({"i": a, "j": z, "v": v})
        return out if both else out[out["i"] < out["j"]]

    return x.groupBy("p", "q").applyInPandas(run, f"i {kind}, j {kind}, v double")


def nearest(queries: DataFrame, base: DataFrame, least: float, block: int = 2000) -> DataFrame:
    """``id, name, v``: the nearest base vector of each query with cosine >= ``least``; ties by name.

    Base rows ``name, v`` go in blocks to every group of queries ``id, v``; each block
    gives its best, and the best of those is kept.
    """
    nb = max(1, -(-base.count() // block))
    nq = max(1, -(-queries.count() // block))
    grid = F.sequence(F.lit(0), F.lit(nb - 1))
    q = queries.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(nq)).alias("g"), F.explode(grid).alias("b"))
    s = base.select("name", "v", F.pmod(F.xxhash64("name"), F.lit(nb)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nq - 1).cast("bigint"))).alias("g"))
    kind = dict(queries.dtypes)["id"]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"id": a["id"][:0], "name": b["name"][:0], "v": np.empty(0)})
        b = b.sort_values("name")
        x, y = np.stack(a["v"].to_numpy()).astype(np.float64), np.stack(b["v"].to_numpy()).astype(np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
        sim = np.round(x @ y.T, 12)
        at = sim.argmax(1)
        v = sim[np.arange(len(at)), at]
        return pd.DataFrame({"id": a["id"].to_numpy(), "name": b["name"].to_numpy()[at], "v": v})[v >= least]

    best = q.groupBy("g", "b").cogroup(s.groupBy("g", "b")).applyInPandas(run, f"id {kind}, name string, v double")
    return best.groupBy("id").agg(F.min(F.struct((-F.col("v")).alias("n"), "name")).alias("x")).select("id", F.col("x.name").alias("name"), (-F.col("x.n")).alias("v"))
