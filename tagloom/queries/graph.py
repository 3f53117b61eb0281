"""Postings, baskets and the co-occurrence graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators import graph as g
from tagloom.plans.market import GRAPH, baskets, bucket_of, item_rows, part_nodes, split_items, split_of, table, with_


def train(spark: SparkSession, d: str) -> DataFrame:
    return split_items(spark, d, "train")


def edges(spark: SparkSession, d: str) -> DataFrame:
    return g.pmi_edges(train(spark, d))


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Corpus-wide rows per name, before any dedup: what the conditional share divides by."""
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    return line.join(part, line["l_partkey"] == part["p_partkey"]).groupBy(F.col("p_name").alias("s")).agg(F.count("*").alias("mentions"))


def join_inner(spark, d):
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.join(line, o["o_orderkey"] == line["l_orderkey"]).groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"), F.count_distinct("o_orderkey").alias("n_orders"))


def canonical_baskets(spark, d):
    return baskets(spark, d).select("k", F.array_join("skills", "|").alias("skills"))


def index_query(name: str):
    def run(spark, d):
        return g.INDICES[name](edges(spark, d)).select("i", "j", F.round("v", 6).alias("v"))

    return run


def graph_stats(spark, d):
    e, n = edges(spark, d), g.doc_freq(train(spark, d))
    m, v = F.col("m").cast("double"), F.col("v")
    return e.agg(F.count("*").alias("m")).join(n.agg(F.count("*").alias("v"))).select(
        F.col("v").alias("n_nodes"), F.col("m").alias("n_edges"),
        F.round(F.try_divide(2 * m, v), 6).alias("mean_degree"), F.round(F.try_divide(2 * m, v * (v - 1)), 6).alias("density"),
    )


def median_lower(spark, d):
    return g.degree(edges(spark, d)).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY d)").cast("bigint").alias("median_degree"))


def neighbours(by: str):
    def run(spark, d):
        return g.top_neighbours(edges(spark, d), by, 15).select("i", "j", "rank", "count", "pmi")

    return run


def hash_split(spark, d):
    return baskets(spark, d).groupBy(split_of(F.col("k")).alias("split")).agg(F.count("*").alias("n_postings"), F.sum(bucket_of(F.col("k"))).alias("bucket_sum"))


def heldout_edges(spark, d):
    t = train(spark, d)
    e, nodes = g.pmi_edges(t), g.doc_freq(t)
    out = [g.held_out(split_items(spark, d, s), e, nodes).withColumn("split", F.lit(s)) for s in ("val", "test")]
    return out[0].unionByName(out[1])


def basket_size_stats(spark, d):
    n = F.size("skills")
    return baskets(spark, d).agg(F.round(F.avg(n), 6).alias("mean_size"), F.median(n).alias("median_size"), F.max(n).alias("max_size"))


def edge_weight_norm(spark, d):
    e = edges(spark, d)
    mean = e.agg(F.avg("count").alias("m"))
    return e.join(F.broadcast(mean)).select("source", "target", F.round(F.log1p("count"), 6).alias("log_count"), "pmi", F.round(F.col("count") / F.col("m"), 6).alias("weight"))


def jaccard_sets(spark, d):
    """Jaccard of the skill sets of successive postings of a company."""
    from pyspark.sql import Window

    b = baskets(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("company")), "k")
    b = b.withColumn("before", F.lag("skills").over(Window.partitionBy("company").orderBy("k"))).where("before is not null")
    return b.select("k", "company", F.round(F.size(F.array_intersect("skills", "before")) / F.size(F.array_union("skills", "before")), 6).alias("jaccard"))


def conditional_prob(spark, d):
    return g.conditional(edges(spark, d), mentions(spark, d))


QUERIES = {
    "join_inner": join_inner,
    "canonical_baskets": canonical_baskets,
    "cooccur_pairs": lambda s, d: g.pair_counts(item_rows(s, d)),
    "node_doc_freq": lambda s, d: g.doc_freq(train(s, d)),
    "pmi_edges": edges,
    "top_pmi_edges": lambda s, d: edges(s, d).orderBy(F.desc("pmi"), "source", "target").limit(20),
    "top_count_edges": lambda s, d: edges(s, d).orderBy(F.desc("count"), "source", "target").limit(15),
    "degree": lambda s, d: g.degree(edges(s, d)),
    "graph_stats": graph_stats,
    "median_lower": median_lower,
    "resource_allocation": index_query("resource_allocation"),
    "idx_jaccard": index_query("jaccard"),
    "idx_adamic_adar": index_query("adamic_adar"),
    "idx_salton": index_query("salton"),
    "idx_hub_depressed": index_query("hub_depressed"),
    "neighbours_distinctive": neighbours("pmi"),
    "neighbours_frequent": neighbours("count"),
    "conditional_prob": conditional_prob,
    "hash_split": hash_split,
    "heldout_edges": heldout_edges,
    "basket_size_stats": basket_size_stats,
    "edge_weight_norm": edge_weight_norm,
    "jaccard_sets": jaccard_sets,
}

_E = with_(*GRAPH)
_A = with_(*GRAPH, "a", "deg")
_SN = "SELECT x.i AS i, y.i AS j, {} AS v FROM a x JOIN a y ON x.j = y.j JOIN deg ON deg.i = x.j GROUP BY 1, 2"
_IJ = _A + ", c AS (" + _SN.format("count(*)") + "), q AS (SELECT c.i, c.j, c.v, x.d AS di, y.d AS dj FROM c JOIN deg x ON x.i = c.i JOIN deg y ON y.i = c.j) "
_NB = _A + "SELECT i, j, rank, count, pmi FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY {} DESC, j) AS rank FROM a) WHERE rank <= 15"

ORACLE = {
    "join_inner": "SELECT o_orderstatus, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_orders FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
    "canonical_baskets": with_("items", "b") + "SELECT k, string_agg(s, '|' ORDER BY s) AS skills FROM b GROUP BY k",
    "cooccur_pairs": with_("items") + "SELECT x.s AS source, y.s AS target, count(*) AS count FROM items x JOIN items y ON x.k = y.k AND x.s < y.s GROUP BY 1, 2",
    "node_doc_freq": with_("items", "b", "sp", "t", "df") + "SELECT * FROM df",
    "pmi_edges": _E + "SELECT * FROM e",
    "top_pmi_edges": _E + "SELECT * FROM e ORDER BY pmi DESC, source, target LIMIT 20",
    "top_count_edges": _E + "SELECT * FROM e ORDER BY count DESC, source, target LIMIT 15",
    "degree": _A + "SELECT * FROM deg",
    "graph_stats": _E + "SELECT v AS n_nodes, m AS n_edges, round(2.0::DOUBLE * m / v, 6) AS mean_degree, round(2.0::DOUBLE * m / (v * (v - 1)), 6) AS density FROM (SELECT count(*) AS m FROM e), (SELECT count(*) AS v FROM df)",
    "median_lower": _A + "SELECT quantile_disc(d, 0.5) AS median_degree FROM deg",
    "resource_allocation": _A + "SELECT i, j, round(v, 6) AS v FROM (" + _SN.format("sum(1.0::DOUBLE / greatest(d, 1))") + ")",
    "idx_adamic_adar": _A + "SELECT i, j, round(v, 6) AS v FROM (" + _SN.format("sum(1.0::DOUBLE / ln(greatest(d, 2)::DOUBLE))") + ")",
    "idx_jaccard": _IJ + "SELECT i, j, round(v::DOUBLE / greatest(di + dj - v, 1), 6) AS v FROM q",
    "idx_salton": _IJ + "SELECT i, j, round(v::DOUBLE / sqrt(greatest(di * dj, 1)::DOUBLE), 6) AS v FROM q",
    "idx_hub_depressed": _IJ + "SELECT i, j, round(v::DOUBLE / greatest(di, dj, 1), 6) AS v FROM q",
    "neighbours_distinctive": _NB.format("pmi"),
    "neighbours_frequent": _NB.format("count"),
    "conditional_prob": _A + ", m AS (SELECT p_name AS s, count(*) AS mentions FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT i, j, round(count::DOUBLE / mentions + 1e-12, 4) AS p FROM a JOIN m ON m.s = i",  # ties round up, as in Spark
    "hash_split": with_("items", "b") + """SELECT CASE h WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split, count(*) AS n_postings, sum(h)::BIGINT AS bucket_sum
FROM (SELECT DISTINCT k, ('0x' || substr(md5(k::VARCHAR), 1, 8))::BIGINT % 10 AS h FROM b) GROUP BY 1""",
    "heldout_edges": _E + """, h AS (SELECT split, x.s AS source, y.s AS target, count(*) AS count FROM b x JOIN b y ON x.k = y.k AND x.s < y.s JOIN sp ON sp.k = x.k WHERE split <> 'train' GROUP BY 1, 2, 3)
SELECT source, target, count, split FROM h WHERE count >= 3 AND source IN (SELECT s FROM df) AND target IN (SELECT s FROM df)
  AND NOT EXISTS (SELECT 1 FROM e WHERE e.source = h.source AND e.target = h.target)""",
    "basket_size_stats": with_("items", "b") + "SELECT round(avg(n), 6) AS mean_size, median(n) AS median_size, max(n)::INT AS max_size FROM (SELECT k, count(*) AS n FROM b GROUP BY k)",
    "edge_weight_norm": _E + "SELECT source, target, round(ln(1 + count::DOUBLE), 6) AS log_count, pmi, round(count / (SELECT avg(count) FROM e), 6) AS weight FROM e",
    "jaccard_sets": with_("items", "b") + """, s AS (SELECT k, list(s ORDER BY s) AS skills FROM b GROUP BY k),
w AS (SELECT k, o_custkey AS company, skills, lag(skills) OVER (PARTITION BY o_custkey ORDER BY k) AS before FROM s JOIN orders ON o_orderkey = k)
SELECT k, company, round(len(list_intersect(skills, before))::DOUBLE / len(list_distinct(list_concat(skills, before))), 6) AS jaccard FROM w WHERE before IS NOT NULL""",
}
