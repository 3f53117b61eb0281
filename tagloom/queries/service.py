"""Requests to the service with their parameters, on the model of the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.api import Model, Service
from tagloom.operators import profile as p
from tagloom.plans.market import GRAPH, ROLE, part_nodes, table, with_
from tagloom.queries import graph as base
from tagloom.queries import recommend, roles, trends
from tagloom.queries.recommend import _KN, _MM
from tagloom.queries.roles import _DEN, _GAP, _H, _ONE, FLOOR, SUPPORT
from tagloom.queries.trends import _S


def service(spark, d) -> Service:
    """The service over the order tables; the category of a name is its last word."""
    t = recommend.Tables(spark, d)
    names = part_nodes(spark, d).withColumnRenamed("s", "name").join(base.mentions(spark, d).withColumnRenamed("s", "name"), "name", "left")
    rows = roles.rows(spark, d)
    edges = p.role_edges(rows, SUPPORT)
    fits = trends.fits(spark, d).join(trends.rank_slopes(spark, d), "tech", "left")
    return Service(Model(
        names, recommend.edges(t, d), edges, p.level_shares(rows, edges, FLOOR), p.totals(rows),
        trends=fits, series=trends.series(spark, d), vectors=recommend.vectors(t, d), nodes=recommend.nodes(t, d),
    ))


def _have(spark, d) -> list[str]:
    return sorted(x[0] for x in roles.have(spark, d).collect())  # a part of the vocabulary


def _first_role(spark, d) -> str:
    return table(spark, d, "customer").agg(F.min("c_mktsegment")).first()[0]


def _table(spark, rows: list[dict], schema: str):
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def recommended(method="heuristic"):
    def run(spark, d):
        r = service(spark, d).recommend(_have(spark, d), 12, method, _first_role(spark, d), ["misty", "steel"])
        return _table(spark, r["recommendations"], "rank int, skill string, score double, category string, role_support double, given double")

    return run


def gaps(spark, d):
    r = service(spark, d).gap(_first_role(spark, d), _have(spark, d), "1-URGENT", 15)
    return _table(spark, [{**x, "part": n, "coverage": r["coverage"], "postings": r["postings_analysed"]} for n in ("you_have", "gaps") for x in r[n]], "part string, skill string, support double, lift double, coverage double, postings long")


def matches(spark, d):
    r = service(spark, d).match(_have(spark, d))
    return _table(spark, [{**x, "matched": "|".join(x["matched"]), "top_missing": "|".join(x["top_missing"])} for x in r["roles"]], "role string, coverage double, matched string, top_missing string, postings long")


def one_skill(spark, d):
    s = service(spark, d)
    name = s.nodes.agg(F.min("s")).first()[0]
    r = s.skill(name.upper(), 5)
    return _table(spark, [{**x, "part": n, "degree": r["degree"]} for n in ("distinctive", "frequent") for x in r[n]], "part string, skill string, category string, pmi double, postings long, degree long")


def one_trend(spark, d):
    s = service(spark, d)
    name = s.trends.agg(F.min("tech")).first()[0]
    r = s.trend(name)
    return _table(spark, [{"tech": r["tech"], "year": int(y), "share": round(v, 6), "rank_slope": r["rank_slope"]} for y, v in r["series"].items()], "tech string, year int, share double, rank_slope double")


def resume(spark, d):
    """A document with names of the vocabulary in two sections, one of them misspelt."""
    s = service(spark, d)
    a, b, c = (x[0] for x in s.nodes.orderBy("s").limit(3).collect())
    from tagloom.sources.models import ngram_vectors

    r = s.resume(f"PROJECTS\nBuilt a thing with {a}\nTechnical Skills\n{b}*, {a}, {c}x, nothing known\n", 5, _first_role(spark, d), ngram_vectors, 0.7)
    rows = [{"part": "skill", **x} for x in r["skills"]] + [{"part": "recommendation", "name": x["skill"], "weight": x["score"]} for x in r["recommendations"]] + [{"part": "role", "name": x["role"], "weight": x["coverage"]} for x in r["role_match"]]
    return _table(spark, rows, "part string, name string, section string, weight double")


QUERIES = {
    "service_recommend": recommended(),
    "service_recommend_hybrid": recommended("hybrid"),
    "service_gap": gaps,
    "service_match": matches,
    "service_skill": one_skill,
    "service_trend": one_trend,
    "service_resume": resume,
}

_RK = """, r1 AS (SELECT min(c_mktsegment) AS role FROM customer), ro AS (SELECT skill, support, lift FROM re JOIN r1 USING (role)),
sx AS (SELECT j, sum(v) AS v FROM rc WHERE i IN (SELECT s FROM kn) AND j NOT IN (SELECT s FROM kn) GROUP BY j),
mk AS (SELECT j, category, support, round(v * greatest(1 + greatest(coalesce(lift, -1), -0.9), 0.1::DOUBLE), 6) AS score FROM sx JOIN nodes ON s = j LEFT JOIN ro ON skill = j WHERE category NOT IN ('misty', 'steel'))
SELECT (row_number() OVER (ORDER BY score DESC, j))::INT AS rank, j AS skill, score, category, support AS role_support, coalesce(given, 0) AS given FROM mk LEFT JOIN gv USING (j) QUALIFY rank <= 12"""

ORACLE = {
    "service_recommend": with_(*GRAPH, "a", "deg", *ROLE, "nodes") + recommend._N + recommend._ST + _KN + _MM + _RK,
    "service_gap": with_(*ROLE) + _ONE + _H + _DEN + ", q AS (SELECT o.skill, o.role, ls.share AS support, o.lift FROM o JOIN ls ON ls.skill = o.skill AND ls.role = o.role WHERE level = '1-URGENT' AND share > 0), gp AS (" + _GAP.format(e="q")
    + "), r AS (SELECT *, row_number() OVER (PARTITION BY have ORDER BY CASE WHEN have THEN support ELSE support * greatest(lift, 0.1::DOUBLE) END DESC, skill) AS rn FROM gp) SELECT CASE WHEN have THEN 'you_have' ELSE 'gaps' END AS part, skill, support, lift, (SELECT round(avg(have::INT), 4) FROM gp) AS coverage, (SELECT denom FROM den JOIN r1 USING (role) WHERE level = '1-URGENT') AS postings FROM r WHERE rn <= CASE WHEN have THEN 30 ELSE 15 END",
    "service_match": with_(*ROLE) + _H + ", q AS (SELECT *, row_number() OVER (PARTITION BY role, have ORDER BY support DESC, skill) AS rn FROM (" + _GAP.format(e="re") + """))
SELECT role, round(sum(CASE WHEN have THEN support ELSE 0 END) / sum(support), 4) AS coverage, array_to_string(list_slice(coalesce(list(skill ORDER BY skill) FILTER (have), []), 1, 15), '|') AS matched,
  coalesce(string_agg(skill, '|' ORDER BY rn) FILTER (NOT have AND rn <= 5), '') AS top_missing, any_value(total) AS postings FROM q JOIN rt USING (role) GROUP BY role""",
    "service_skill": with_(*GRAPH, "a", "deg", "nodes") + ", x AS (SELECT min(s) AS i FROM df), nb AS (SELECT a.*, row_number() OVER (ORDER BY pmi DESC, j) AS rp, row_number() OVER (ORDER BY count DESC, j) AS rc FROM a JOIN x USING (i)) SELECT part, j AS skill, category, pmi, count AS postings, d AS degree FROM (SELECT *, 'distinctive' AS part FROM nb WHERE rp <= 5 UNION ALL SELECT *, 'frequent' FROM nb WHERE rc <= 5) JOIN deg USING (i) JOIN nodes ON s = j",
    "service_trend": _S + "SELECT tech, year::INT AS year, round(share, 6) AS share, rank_slope FROM sr LEFT JOIN rs USING (tech) WHERE tech = (SELECT min(tech) FROM sr)",
}
