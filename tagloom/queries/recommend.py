"""Embeddings, score matrices and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.operators import graph as g
from tagloom.operators import matrix as m
from tagloom.operators import profile as p
from tagloom.operators import trends as t
from tagloom.operators.ranking import running
from tagloom.plans.lineage import cut
from tagloom.plans.market import GRAPH, ROLE, items, part_nodes, table, with_
from tagloom.queries import graph as base
from tagloom.queries.graph import mentions
from tagloom.queries.roles import have, one_role, role_edges
from tagloom.queries.trends import _S, rank_slopes


class Tables:
    """Session and folder of the tables, with what one query has written of them so far.

    Made anew for each call of a query, so queries that are built at the same time don't
    meet.
    """

    def __init__(self, spark, d):
        self.spark, self.d, self.written = spark, d, {}


def once(f):
    """The table that ``f`` makes, written once per query: its branches don't repeat the plan."""

    def run(t, d=None):
        if not isinstance(t, Tables):
            return f(t, d)
        if f.__name__ not in t.written:
            t.written[f.__name__] = cut(f(t, t.d))
        return t.written[f.__name__]

    return run


def query(f):
    def run(spark, d):
        return f(Tables(spark, d), d)

    return run


def _session(t):
    return t.spark if isinstance(t, Tables) else t


@once
def edges(spark, d):
    return base.edges(_session(spark), d)


@once
def nodes(spark, d):
    return g.doc_freq(base.train(_session(spark), d)).select("s")


@once
def placed(spark, d):
    """``s, vec_id``: the place of each node in the order of names."""
    return running(nodes(spark, d).withColumn("one", F.lit(1)), "s", "one").select("s", F.col("before_one").alias("vec_id"))


@once
def vectors(spark, d):
    """``s, v``: the embedding of each node, by its place in the order of names."""
    return placed(spark, d).join(table(_session(spark), d, "embeddings"), "vec_id").select("s", F.col("embedding").alias("v"))


@once
def allocation(spark, d):
    return g.resource_allocation(edges(spark, d))


@once
def cosine(spark, d):
    return m.cosine_pairs(vectors(spark, d).withColumnRenamed("s", "id"), -1.0, both=True)


def gnn(spark, d):
    return m.standardise(cosine(spark, d), nodes(spark, d)).select("i", "j", "v")


@once
def structural(spark, d):
    n = nodes(spark, d)
    z = m.standardise(allocation(spark, d), n)
    z0 = z.agg(F.first("z0").alias("z0"))
    all_ = m.dense(z.select("i", "j", "v").withColumn("hit", F.lit(1.0)).select("i", "j", "v"), n)
    return all_.join(z.select("i", "j", F.lit(True).alias("f")), ["i", "j"], "left").join(F.broadcast(z0)).select("i", "j", F.when(F.col("f"), F.col("v")).otherwise(F.col("z0")).alias("v"))


def fixed(spark, d, alpha=0.9):
    return m.blend(structural(spark, d), gnn(spark, d), F.lit(alpha))


def trusted(spark, d, pivot=60):
    """``s, c``: how far structural scores of a node are to be trusted, by its neighbours."""
    return nodes(spark, d).join(g.degree(edges(spark, d)).withColumnRenamed("i", "s"), "s", "left").select("s", (F.coalesce("d", F.lit(0)) / (F.coalesce("d", F.lit(0)) + pivot)).alias("c"))


@once
def confidence(spark, d):
    """``i, j, w``: how far the structural score of a pair is to be trusted, by its nodes' neighbours."""
    deg = trusted(spark, d)
    cells = cosine(spark, d).select("i", "j").join(deg.select(F.col("s").alias("i"), F.col("c").alias("ci")), "i").join(deg.select(F.col("s").alias("j"), F.col("c").alias("cj")), "j")
    return cells.select("i", "j", F.sqrt(F.col("ci") * F.col("cj")).alias("w"))


def adaptive(spark, d, alpha=0.9):
    """The structural part weighs less for nodes with few neighbours."""
    a = structural(spark, d).withColumnRenamed("v", "va").join(confidence(spark, d), ["i", "j"]).join(gnn(spark, d).withColumnRenamed("v", "vb"), ["i", "j"])
    w = F.col("w") * alpha
    return a.select("i", "j", (w * F.col("va") + (1 - w) * F.col("vb")).alias("v"))


@once
def heuristic_scores(spark, d):
    return m.row_col_standardise(allocation(spark, d), nodes(spark, d))


@once
def known(spark, d):
    return have(_session(spark), d).join(nodes(spark, d).withColumnRenamed("s", "skill"), "skill", "left_semi").select(F.col("skill").alias("s"))


@once
def known_heuristic(spark, d):
    """Score of every unknown node by the known ones."""
    k = known(spark, d)
    return m.unknown(m.known_scores(allocation(spark, d), nodes(spark, d), k), k)


def heuristic(spark, d, k=10):
    return m.ranked(known_heuristic(spark, d), k)


def hybrid(spark, d, k=10):
    q = known(spark, d)
    return m.ranked(m.unknown(m.known_scores(cut(fixed(spark, d)), nodes(spark, d), q), q), k)


def target_role(spark, d):
    lift = one_role(_session(spark), d).select(F.col("skill").alias("j"), "lift")
    return m.ranked(known_heuristic(spark, d).join(lift, "j", "left").select("j", (F.round("score", 6) * m.role_mask(F.col("lift"))).alias("score")), 10)


def exclude_category(spark, d):
    cat = part_nodes(_session(spark), d).select(F.col("s").alias("j"), "category")
    keep = known_heuristic(spark, d).join(cat, "j", "left").where(F.coalesce(~F.col("category").isin("misty", "steel"), F.lit(True)))
    return m.ranked(keep.select("j", "category", "score"), 10)


def given(spark, d):
    """Each recommendation with the largest conditional share over the known names, 0 if none."""
    r = heuristic(spark, d)
    c = g.conditional(edges(spark, d), mentions(_session(spark), d)).join(known(spark, d).withColumnRenamed("s", "i"), "i", "left_semi")
    return r.join(c.groupBy("j").agg(F.max("p").alias("given")), "j", "left").na.fill(0.0, ["given"])


def with_trend(spark, d):
    r = heuristic(spark, d)
    tr = rank_slopes(_session(spark), d).select(F.col("tech").alias("j"), "rank_slope", t.direction(F.col("rank_slope")).alias("direction"))
    return r.join(tr, "j", "left")


def api_recommend(spark, d):
    r = with_trend(spark, d).join(given(spark, d).select("j", "given"), "j")
    return r.join(part_nodes(_session(spark), d).select(F.col("s").alias("j"), "category"), "j", "left")


def broad(spark, d):
    """Nodes whose single mention says little: degree above twice the median."""
    deg = g.degree(edges(spark, d))
    med = deg.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY d)").alias("md"))
    return deg.join(F.broadcast(med)).select(F.col("i").alias("s"), "d", (F.col("d") > 2 * F.col("md")).alias("broad"))


def embedding_nn(spark, d):
    """Every stored vector that is no node's, with the nearest node at a cosine of 0.1 or more."""
    v = table(_session(spark), d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    v = v.join(placed(spark, d).select(F.col("vec_id").alias("id")), "id", "left_anti")
    return m.nearest(v, vectors(spark, d).withColumnRenamed("s", "name"), 0.1).select("id", "name", F.round("v", 5).alias("v"))


def index_correlation(spark, d):
    """Correlation of the structural indices over all cells, the zeros counted, not made."""
    e, n = edges(spark, d), nodes(spark, d)
    names = list(g.INDICES)
    j = None
    for x in names:
        i = g.INDICES[x](e).withColumnRenamed("v", x)
        j = i if j is None else j.join(i, ["i", "j"], "full")
    j = j.na.fill(0.0)
    sums = [F.sum(F.col(a)).alias(f"s_{a}") for a in names] + [F.sum(F.col(a) * F.col(b)).alias(f"q_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    s = j.agg(*sums).join(n.agg((F.count("*") * F.count("*")).cast("double").alias("n")))
    cov = lambda a, b: F.col(f"q_{a}_{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("n")
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(cov(a, b) / F.sqrt(cov(a, a) * cov(b, b)), 4).alias("r")) for i, a in enumerate(names) for b in names[i + 1 :]]
    return s.select(F.explode(F.array(*cells)).alias("x")).select("x.a", "x.b", "x.r")


def rounded(f, places=5):
    return lambda s, d: f(s, d).select("i", "j", F.round("v", places).alias("v"))


QUERIES = {
    "embedding_normalise": lambda s, d: vectors(s, d).select("s", F.posexplode(m.unit(F.col("v"))).alias("pos", "x")).select("s", "pos", F.round("x", 6).alias("x")),
    "dot_decode": lambda s, d: edges(s, d).join(vectors(s, d).select(F.col("s").alias("source"), F.col("v").alias("a")), "source").join(vectors(s, d).select(F.col("s").alias("target"), F.col("v").alias("b")), "target").select("source", "target", F.round(m.dot(F.col("a"), F.col("b")), 5).alias("v")),
    "cosine_all_pairs": rounded(cosine),
    "embedding_nn": embedding_nn,
    "matrix_standardise": rounded(structural),
    "row_standardise": lambda s, d: m.row_standardise(allocation(s, d), nodes(s, d)).select("i", "j", F.round("v", 5).alias("v")),
    "row_col_standardise": rounded(heuristic_scores),
    "blend_fixed": rounded(fixed),
    "blend_adaptive": rounded(adaptive),
    "index_correlation": index_correlation,
    "recommend_heuristic": heuristic,
    "recommend_hybrid": hybrid,
    "recommend_target_role": target_role,
    "recommend_exclude_category": exclude_category,
    "recommend_with_trend": with_trend,
    "recommend_given": given,
    "broad_skill_warning": broad,
    "api_recommend": api_recommend,
}

QUERIES = {k: query(f) for k, f in QUERIES.items()}

_N = ", nd AS (SELECT s FROM df), ra AS (SELECT x.i AS i, y.i AS j, sum(1.0::DOUBLE / greatest(d, 1)) AS v FROM a x JOIN a y ON x.j = y.j JOIN deg ON deg.i = x.j GROUP BY 1, 2), cell AS (SELECT x.s AS i, y.s AS j FROM nd x, nd y), dn AS (SELECT i, j, coalesce(v, 0) AS v FROM cell LEFT JOIN ra USING (i, j))"
_Z = "(v - avg(v) OVER ({w})) / greatest(stddev_samp(v) OVER ({w}), 1e-8)"
_ST = ", st AS (SELECT i, j, " + _Z.format(w="") + " AS v FROM dn), rz AS (SELECT i, j, " + _Z.format(w="PARTITION BY i") + " AS v FROM dn), rc AS (SELECT i, j, " + _Z.format(w="PARTITION BY j") + " AS v FROM rz)"
_VE = ", ve AS (SELECT s, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM (SELECT s, row_number() OVER (ORDER BY s) - 1 AS vec_id FROM nd) JOIN embeddings USING (vec_id)), un AS (SELECT s, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM ve), cs AS (SELECT x.s AS i, y.s AS j, list_dot_product(x.v, y.v) AS v FROM un x, un y)"
_BL = ", gz AS (SELECT i, j, " + _Z.format(w="") + " AS v FROM cs), bl AS (SELECT i, j, 0.9::DOUBLE * st.v + (1 - 0.9::DOUBLE) * gz.v AS v FROM st JOIN gz USING (i, j))"
_KN = ", kn AS (SELECT s FROM nd WHERE ascii(substr(s, 2, 1)) % 4 = 0)"
_RS = ", sc AS (SELECT j, round(sum(v), 6) AS score FROM rc WHERE i IN (SELECT s FROM kn) AND j NOT IN (SELECT s FROM kn) GROUP BY j), top AS (SELECT j, score, row_number() OVER (ORDER BY score DESC, j) AS rank FROM sc QUALIFY rank <= 10)"
_G = with_(*GRAPH, "a", "deg") + _N + _ST
_GR = with_(*GRAPH, "a", "deg", *ROLE, "nodes") + _N + _ST + _KN + _RS
_GT = _S.rstrip() + ", " + with_(*GRAPH, "a", "deg", "nodes").removeprefix("WITH ").replace(with_("items").removeprefix("WITH ").rstrip() + ",\n", "") .rstrip() + _N + _ST + _KN + _RS
_MM = ", m AS (SELECT p_name AS s, count(*) AS mentions FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), gv AS (SELECT j, max(round(count::DOUBLE / mentions, 4)) AS given FROM a JOIN m ON m.s = i WHERE i IN (SELECT s FROM kn) GROUP BY j)"
_IDX = {
    "resource_allocation": "sum(1.0::DOUBLE / greatest(dk, 1))",
    "jaccard": "count(*)::DOUBLE / greatest(any_value(di) + any_value(dj) - count(*), 1)",
    "adamic_adar": "sum(1.0::DOUBLE / ln(greatest(dk, 2)::DOUBLE))",
    "salton": "count(*)::DOUBLE / sqrt(greatest(any_value(di) * any_value(dj), 1)::DOUBLE)",
    "hub_depressed": "count(*)::DOUBLE / greatest(any_value(di), any_value(dj), 1)",
}
_PAIRS = [(a, b) for i, a in enumerate(_IDX) for b in list(_IDX)[i + 1 :]]

ORACLE = {
    "embedding_normalise": _G + _VE + " SELECT s, (generate_subscripts(v, 1) - 1)::INT AS pos, round(unnest(v), 6) AS x FROM un",
    "dot_decode": _G + _VE + " SELECT source, target, round(list_dot_product(x.v, y.v), 5) AS v FROM e JOIN ve x ON x.s = source JOIN ve y ON y.s = target",
    "cosine_all_pairs": _G + _VE + " SELECT i, j, round(v, 5) AS v FROM cs",
    "embedding_nn": _G + _VE + """, q AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id NOT IN (SELECT row_number() OVER (ORDER BY s) - 1 FROM nd)), qq AS (SELECT id, s AS name, list_dot_product(q.v, un.v) / sqrt(list_dot_product(q.v, q.v)) AS v FROM q, un)
SELECT id, arg_min(name, (-v, name)) AS name, round(max(v), 5) AS v FROM qq GROUP BY id HAVING max(v) >= 0.1""",
    "matrix_standardise": _G + " SELECT i, j, round(v, 5) AS v FROM st",
    "row_standardise": _G + " SELECT i, j, round(rz.v, 5) AS v FROM rz SEMI JOIN ra USING (i, j)",
    "row_col_standardise": _G + " SELECT i, j, round(v, 5) AS v FROM rc",
    "blend_fixed": _G + _VE + _BL + " SELECT i, j, round(v, 5) AS v FROM bl",
    "blend_adaptive": _G + _VE + _BL + ", cf AS (SELECT s, coalesce(d, 0) / (coalesce(d, 0) + 60)::DOUBLE AS c FROM nd LEFT JOIN deg ON i = s), wt AS (SELECT x.s AS i, y.s AS j, sqrt(x.c * y.c) * 0.9 AS w FROM cf x, cf y) SELECT i, j, round(w * st.v + (1 - w) * gz.v, 5) AS v FROM st JOIN gz USING (i, j) JOIN wt USING (i, j)",
    "index_correlation": with_(*GRAPH, "a", "deg") + ", nd AS (SELECT s FROM df), cell AS (SELECT x.s AS i, y.s AS j FROM nd x, nd y), sh AS (SELECT x.i AS i, y.i AS j, k.d AS dk, p.d AS di, q.d AS dj FROM a x JOIN a y ON x.j = y.j JOIN deg k ON k.i = x.j JOIN deg p ON p.i = x.i JOIN deg q ON q.i = y.i), ix AS (SELECT i, j, "
    + ", ".join(f"{v} AS {k}" for k, v in _IDX.items()) + " FROM sh GROUP BY i, j), al AS (SELECT " + ", ".join(f"coalesce({k}, 0) AS {k}" for k in _IDX) + " FROM cell LEFT JOIN ix USING (i, j)) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r FROM al" for a, b in _PAIRS),
    "recommend_heuristic": _GR + " SELECT * FROM top",
    "recommend_hybrid": with_(*GRAPH, "a", "deg") + _N + _ST + _VE + _BL + ", r2 AS (SELECT i, j, " + _Z.format(w="PARTITION BY i") + " AS v FROM bl), c2 AS (SELECT i, j, " + _Z.format(w="PARTITION BY j") + " AS v FROM r2)" + _KN + _RS.replace("FROM rc ", "FROM c2 ") + " SELECT * FROM top",
    "recommend_target_role": _GR + ", r1 AS (SELECT min(c_mktsegment) AS role FROM customer), mk AS (SELECT j, round(score * greatest(1 + greatest(coalesce(lift, -1), -0.9), 0.1::DOUBLE), 6) AS score FROM sc LEFT JOIN (SELECT skill, lift FROM re JOIN r1 USING (role)) ON skill = j) SELECT j, score, row_number() OVER (ORDER BY score DESC, j) AS rank FROM mk QUALIFY rank <= 10",
    "recommend_exclude_category": _GR + ", x AS (SELECT j, category, score FROM sc LEFT JOIN nodes ON s = j WHERE coalesce(category NOT IN ('misty', 'steel'), true)) SELECT *, row_number() OVER (ORDER BY score DESC, j) AS rank FROM x QUALIFY rank <= 10",
    "recommend_with_trend": _GT + " SELECT top.*, rank_slope, direction FROM top LEFT JOIN di ON tech = j",
    "recommend_given": _GR + _MM + " SELECT top.*, coalesce(given, 0) AS given FROM top LEFT JOIN gv USING (j)",
    "broad_skill_warning": with_(*GRAPH, "a", "deg") + "SELECT i AS s, d, d > 2 * (SELECT quantile_disc(d, 0.5) FROM deg) AS broad FROM deg",
    "api_recommend": _GT + _MM + " SELECT top.*, rank_slope, direction, coalesce(given, 0) AS given, category FROM top LEFT JOIN di ON tech = j LEFT JOIN gv USING (j) LEFT JOIN nodes ON s = j",
}
