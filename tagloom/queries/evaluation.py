"""Evaluation of the scores on held-out postings and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.operators import evaluation as e
from tagloom.operators import graph as g
from tagloom.operators import matrix as m
from tagloom.operators.ranking import running
from tagloom.operators.sweep import blended_hits
from tagloom.plans.lineage import cut
from tagloom.plans.market import baskets, split_items, split_of
from tagloom.queries.recommend import _BL, _G, _IDX, _VE, _session, allocation, cosine, edges, heuristic_scores, nodes, query, trusted, vectors

ALPHAS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)


def held(spark, d, split="val"):
    return g.held_out(split_items(_session(spark), d, split), edges(spark, d), nodes(spark, d))


def ranks(spark, d):
    m = e.mask(split_items(_session(spark), d, "test").join(nodes(spark, d), "s", "left_semi"))
    return e.target_ranks(m, e.basket_scores(m, heuristic_scores(spark, d), "v"), F.col("v"))


def scored(spark, d):
    """Pairs that are no train edge, with their score and whether they are held-out edges."""
    ra = allocation(spark, d).where("i < j").select(F.col("i").alias("source"), F.col("j").alias("target"), F.round("v", 6).alias("score"))
    free = ra.join(edges(spark, d), ["source", "target"], "left_anti")
    return free.join(held(spark, d), ["source", "target"], "left").select("source", "target", "score", "count", F.col("count").isNotNull().alias("label"))


def auc_by_band(spark, d):
    """Per support band: its positives against as many negatives, the first by hash."""
    s = scored(spark, d)
    pos = s.where("label").withColumn("band", e.band(F.col("count")))
    n = pos.groupBy("band").agg(F.count("*").alias("n")).where("n >= 50")
    most = n.agg(F.max("n")).first()[0] or 0
    # as many as the largest band has positives, taken by each partition first
    first = s.where("not label").select("score", F.concat_ws("|", F.md5(F.concat_ws("|", "source", "target")), "source", "target").alias("h")).orderBy("h").limit(most)
    neg = running(first.withColumn("one", F.lit(1)), "h", "one").join(n, F.col("before_one") < F.col("n")).withColumn("label", F.lit(False))
    both = pos.join(n, "band", "left_semi").select("band", "score", "label").unionByName(neg.select("band", "score", "label"))
    return e.auc(both, "score", "label", "band").select("band", "auc", "n_pos")


def alpha_sweep(spark, d):
    """Hits and reciprocal rank for each weight, fixed and adaptive, and each structural index.

    The join of the largest table is made once, for baskets that are written with their
    items; the graph and the masked baskets come from these.
    """
    gathered = cut(baskets(_session(spark), d))
    t = gathered.where(split_of(F.col("k")) == "train").withColumnRenamed("skills", "a")
    # what the other tables of the query start from
    spark.written |= {"edges": cut(g.basket_edges(t)), "nodes": cut(t.select(F.explode("a").alias("s")).distinct())}
    x, n, cos = edges(spark, d), nodes(spark, d), cosine(spark, d)
    others = {}
    for name, index in g.INDICES.items():
        z = cut(m.standardise(index(x), n))
        if first := z.first():  # without edges there is no index
            others[name] = z, first["z0"]
    b = cos.agg(F.avg("v").alias("mu"), F.greatest(F.stddev_samp("v"), F.lit(1e-8)).alias("sd"))
    b = cos.join(F.broadcast(b)).select("i", "j", ((F.col("v") - F.col("mu")) / F.col("sd")).alias("v"))
    trust = {r["s"]: r["c"] for r in trusted(spark, d).collect()}
    copies = {r["s"]: r["count"] for r in vectors(spark, d).where("v is not null").groupBy("s").count().collect()}
    test = gathered.where(split_of(F.col("k")) == "test").select("k", F.explode("skills").alias("s")).join(n, "s", "left_semi")
    # the number of tasks follows the setting, not the bytes: a basket is few bytes and much work
    test = test.repartition(int(_session(spark).conf.get("spark.sql.shuffle.partitions")), "k")
    modes = [(a, mode) for a in ALPHAS for mode in ("fixed", "adaptive") if a or mode == "fixed"]
    return blended_hits(e.parted(test), b, others, trust, copies, modes)


def _negatives(spark, d):
    x = edges(spark, d)
    return e.negatives(held(spark, d).select("source", "target"), g.degree(x), g.adjacency(x))


QUERIES = {
    "hits_mrr": lambda s, d: e.hits(ranks(s, d)),
    "masked_rank": ranks,
    "auc_rank": lambda s, d: e.auc(scored(s, d), "score", "label"),
    "average_precision": lambda s, d: e.average_precision(scored(s, d), "score", "label"),
    "auc_by_band": auc_by_band,
    "support_bands": lambda s, d: held(s, d).groupBy(e.band(F.col("count")).alias("band")).agg(F.count("*").alias("n"), F.sum("count").alias("total")),
    "negative_sampling": _negatives,
    "alpha_sweep": alpha_sweep,
    "sage_mean_aggregate": lambda s, d: e.mean_neighbours(g.adjacency(edges(s, d)), vectors(s, d)).select("i", "pos", F.round("x", 6).alias("x")),
}
QUERIES = {k: query(f) for k, f in QUERIES.items()}

from tagloom.plans.market import GRAPH, with_  # noqa: E402
from tagloom.queries.recommend import _Z  # noqa: E402

_HELD = ", hv AS (SELECT x.s AS source, y.s AS target, count(*) AS count FROM b x JOIN b y ON x.k = y.k AND x.s < y.s JOIN sp ON sp.k = x.k WHERE split = 'val' GROUP BY 1, 2), hd AS (SELECT * FROM hv WHERE count >= 3 AND source IN (SELECT s FROM nd) AND target IN (SELECT s FROM nd) AND NOT EXISTS (SELECT 1 FROM e WHERE e.source = hv.source AND e.target = hv.target))"
_MASK = ", ti AS (SELECT b.k, b.s FROM b JOIN sp USING (k) WHERE split = 'test' AND b.s IN (SELECT s FROM nd)), mk AS (SELECT k, s, row_number() OVER (PARTITION BY k ORDER BY md5(k || '|' || s)) - 1 < greatest(1, count(*) OVER (PARTITION BY k) // 3) AS masked FROM ti QUALIFY count(*) OVER (PARTITION BY k) >= 4)"
_CAND = ", ca AS (SELECT k, j, {v} FROM mk JOIN {m} m ON m.i = mk.s WHERE NOT masked AND NOT EXISTS (SELECT 1 FROM mk o WHERE o.k = mk.k AND o.s = m.j AND NOT o.masked) GROUP BY k, j)"
_RK = _G + _MASK + _CAND.format(v="sum(v) AS v", m="rc") + ", rr AS (SELECT k, j, row_number() OVER (PARTITION BY k ORDER BY round(v, 6) DESC, j) AS rank FROM ca), fr AS (SELECT rr.k, s, rank FROM rr JOIN mk ON mk.k = rr.k AND mk.s = rr.j AND masked)"
_HIT = "round(avg((rank <= 5)::INT), 6) AS hits_5, round(avg((rank <= 10)::INT), 6) AS hits_10, round(avg((rank <= 20)::INT), 6) AS hits_20, round(avg(1.0::DOUBLE / rank), 6) AS mrr, count(*) AS n_targets"
_SC = _G + _HELD + ", sc AS (SELECT ra.i AS source, ra.j AS target, round(v, 6) AS score, count, count IS NOT NULL AS label FROM ra LEFT JOIN hd ON hd.source = ra.i AND hd.target = ra.j WHERE ra.i < ra.j AND NOT EXISTS (SELECT 1 FROM e WHERE e.source = ra.i AND e.target = ra.j))"
_BAND = "CASE WHEN count BETWEEN 3 AND 5 THEN '3-5' WHEN count BETWEEN 6 AND 10 THEN '6-10' WHEN count >= 11 THEN '11+' END"

ORACLE = {
    "hits_mrr": _RK + " SELECT " + _HIT + " FROM fr",
    "masked_rank": _RK + " SELECT * FROM fr",
    "auc_rank": _SC + " SELECT round(sum(CASE WHEN p.score > q.score THEN 1 WHEN p.score = q.score THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 6) AS auc, count(DISTINCT (p.source, p.target)) AS n_pos, count(DISTINCT (q.source, q.target)) AS n_neg FROM sc p, sc q WHERE p.label AND NOT q.label",
    "average_precision": _SC + ", w AS (SELECT score, sum(p) OVER o AS tp, sum(n) OVER o AS seen, p FROM (SELECT score, count_if(label) AS p, count(*) AS n FROM sc GROUP BY score) WINDOW o AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT round(sum(p * tp / seen::DOUBLE) / sum(p), 6) AS average_precision FROM w",
    "auc_by_band": _SC + f""", ps AS (SELECT {_BAND} AS band, score FROM sc WHERE label), pn AS (SELECT band, count(*) AS n FROM ps GROUP BY band HAVING count(*) >= 50),
ng AS (SELECT score, row_number() OVER (ORDER BY md5(source || '|' || target), source, target) AS rn FROM sc WHERE NOT label)
SELECT band, round(sum(CASE WHEN ps.score > ng.score THEN 1 WHEN ps.score = ng.score THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 6) AS auc, any_value(n) AS n_pos FROM ps JOIN pn USING (band) JOIN ng ON rn <= n GROUP BY band""",
    "support_bands": _G + _HELD + f" SELECT {_BAND} AS band, count(*) AS n, sum(count)::BIGINT AS total FROM hd GROUP BY 1",
    "negative_sampling": _G + _HELD + """, db AS (SELECT i AS x, floor(ln(1 + d::DOUBLE) * 2)::INT AS b FROM deg),
pl AS (SELECT x, b, row_number() OVER (PARTITION BY b ORDER BY md5(x), x) - 1 AS at, count(*) OVER (PARTITION BY b) AS n FROM db),
tr AS (SELECT source, target, b.b, b.n, t, (('0x' || substr(md5(source || '|' || target), 1, 8))::BIGINT + t) % b.n AS at FROM hd JOIN pl b ON b.x = target, (SELECT unnest(range(20)) AS t) WHERE t < b.n)
SELECT source, target, arg_min(n.x, t) AS negative FROM tr JOIN pl n ON n.b = tr.b AND n.at = tr.at
WHERE n.x <> source AND n.x <> target AND NOT EXISTS (SELECT 1 FROM a WHERE a.i = source AND a.j = n.x) GROUP BY source, target""",
    "alpha_sweep": with_(*GRAPH, "a", "deg") + ", nd AS (SELECT s FROM df), cell AS (SELECT x.s AS i, y.s AS j FROM nd x, nd y)" + _VE + ", gz AS (SELECT i, j, " + _Z.format(w="") + " AS v FROM cs)"
    + ", cf AS (SELECT s, coalesce(d, 0) / (coalesce(d, 0) + 60)::DOUBLE AS c FROM nd LEFT JOIN deg ON i = s), sh AS (SELECT x.i AS i, y.i AS j, k.d AS dk, p.d AS di, q.d AS dj FROM a x JOIN a y ON x.j = y.j JOIN deg k ON k.i = x.j JOIN deg p ON p.i = x.i JOIN deg q ON q.i = y.i), ix AS ("
    + " UNION ALL ".join(f"SELECT i, j, '{k}' AS structural, {v} AS v FROM sh GROUP BY i, j" for k, v in _IDX.items())
    + "), dz AS (SELECT c.i, c.j, n.structural, coalesce(v, 0) AS v FROM cell c CROSS JOIN (SELECT DISTINCT structural FROM ix) n LEFT JOIN ix ON ix.i = c.i AND ix.j = c.j AND ix.structural = n.structural), sz AS (SELECT i, j, structural, " + _Z.format(w="PARTITION BY structural")
    + " AS v FROM dz), bo AS (SELECT i, j, structural, sz.v AS a, gz.v AS b, sqrt(x.c * y.c) AS w FROM sz JOIN gz USING (i, j) JOIN cf x ON x.s = i JOIN cf y ON y.s = j)" + _MASK
    + ", ca AS (SELECT k, j, structural, sum(m.a) AS a, sum(m.b) AS b, sum(w * m.a) AS wa, sum(w * m.b) AS wb FROM mk JOIN bo m ON m.i = mk.s WHERE NOT masked AND NOT EXISTS (SELECT 1 FROM mk o WHERE o.k = mk.k AND o.s = m.j AND NOT o.masked) GROUP BY k, j, structural)"
    + ", al AS (SELECT alpha, mode FROM (SELECT unnest([" + ", ".join(f"{x}::DOUBLE" for x in ALPHAS) + "]) AS alpha), (SELECT unnest(['fixed', 'adaptive']) AS mode) WHERE alpha > 0 OR mode = 'fixed')"
    + ", rr AS (SELECT k, j, structural, alpha, mode, row_number() OVER (PARTITION BY k, structural, alpha, mode ORDER BY round(CASE WHEN mode = 'fixed' THEN alpha * a + (1 - alpha) * b ELSE alpha * wa + b - alpha * wb END, 6) DESC, j) AS rank FROM ca, al) SELECT alpha, mode, structural, " + _HIT + " FROM rr JOIN mk ON mk.k = rr.k AND mk.s = rr.j AND masked GROUP BY alpha, mode, structural",
    "sage_mean_aggregate": _G + _VE + ", ex AS (SELECT s, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS x FROM ve) SELECT i, pos::INT AS pos, round(avg(x), 6) AS x FROM a JOIN ex ON ex.s = a.j GROUP BY i, pos",
}
