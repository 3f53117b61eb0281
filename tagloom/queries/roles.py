"""Roles and levels: classification of titles, association profiles, gap and match."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagloom.functions import titles as t
from tagloom.operators import profile as p
from tagloom.plans.market import ROLE, postings, split_items, table, with_

#: Share of a role's postings that makes an edge, and the floor of a level, on the order tables.
SUPPORT, FLOOR = 0.06, 20


def rows(spark, d):
    return split_items(spark, d, "train").join(postings(spark, d).select("k", "role", "level"), "k")


def role_edges(spark, d):
    return p.role_edges(rows(spark, d), SUPPORT)


def have(spark, d):
    """The profile that the gap and match queries ask about: names chosen by a letter."""
    names = table(spark, d, "part").select(F.col("p_name").alias("skill")).distinct()
    return names.where(F.ascii(F.substring("skill", 2, 1)) % 4 == 0)


def _role(spark, d):
    return table(spark, d, "customer").agg(F.min("c_mktsegment").alias("role"))


def one_role(spark, d):
    return role_edges(spark, d).join(F.broadcast(_role(spark, d)), "role")


def _titles(spark, d):
    title = F.col("job_title")
    return table(spark, d, "postings").select("posting_id", "job_title", t.role_of(title).alias("role"), t.level_of(title).alias("level"))


def role_gap_seniority(spark, d):
    r = rows(spark, d)
    shares = p.level_shares(r, one_role(spark, d), FLOOR).where("level = '1-URGENT' and share > 0")
    lifts = one_role(spark, d).select("skill", "lift")
    e = shares.join(lifts, "skill").select("skill", "role", F.col("share").alias("support"), "lift")
    return p.gap(e, have(spark, d))


def seniority_gap(spark, d):
    s = p.level_shares(rows(spark, d), role_edges(spark, d), FLOOR)
    w = s.groupBy("skill", "role").pivot("level", ["1-URGENT", "3-MEDIUM"]).agg(F.first("share"))
    return w.where("`1-URGENT` is not null and `3-MEDIUM` is not null").select("skill", "role", F.round(F.col("1-URGENT") - F.col("3-MEDIUM"), 4).alias("gap")).orderBy(F.desc("gap"), "skill", "role").limit(12)


def role_top_support(spark, d):
    w = Window.partitionBy("role").orderBy(F.desc("support"), "skill")
    return role_edges(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 8").select("role", "skill", "support", "rank")


def skill_roles(spark, d):
    w = Window.partitionBy("skill").orderBy(F.desc("lift"), "role")
    return role_edges(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 8").select("skill", "role", "support", "lift", "rank")


def sample_titles(spark, d):
    ts = _titles(spark, d).where("role is not null")
    big = ts.groupBy("role").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "role").limit(12)
    w = Window.partitionBy("role").orderBy("job_title")
    return ts.select("role", "job_title").distinct().join(F.broadcast(big), "role").withColumn("rank", F.row_number().over(w)).where("rank <= 4").select("role", "job_title", "rank")


def coverage_stats(spark, d):
    return _titles(spark, d).agg(F.count("*").alias("n_rows"), F.count("role").alias("n_assigned"), F.round(F.avg(F.col("role").isNotNull().cast("int")), 6).alias("coverage"), F.count_distinct("role").alias("n_roles"))


def crosstab_pivot(spark, d):
    c = _titles(spark, d).where("role is not null").groupBy("role").pivot("level", list(t.LEVEL_ORDER)).count()
    return c.na.fill(0)


def api_roles(spark, d):
    r = rows(spark, d).select("k", "role", "level").distinct()
    n = r.groupBy("role", "level").agg(F.count("*").alias("n"))
    by = n.groupBy("role").agg(F.sum("n").alias("postings"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "level", F.col("n").cast("string")))), "|").alias("by_level"))
    return by.join(role_edges(spark, d).groupBy("role").agg(F.count("*").alias("distinct_skills")), "role", "left").na.fill(0, ["distinct_skills"])


def scatter_points(spark, d):
    g = p.gap(one_role(spark, d), have(spark, d))
    return g.withColumn("o", F.when(F.col("have"), 0).otherwise(1)).orderBy("o", F.desc("score"), "skill").limit(18).select("skill", "have", F.least(F.lit(0.0), F.floor("lift")).cast("double").alias("low"), F.greatest(F.lit(1.0), F.ceil("lift")).cast("double").alias("high"))


def role_heldout(spark, d):
    known = split_items(spark, d, "train").select("s").distinct()
    post, train = postings(spark, d).select("k", "role"), role_edges(spark, d)
    out = [p.held_out(split_items(spark, d, x).join(known, "s", "left_semi").join(post, "k"), train, SUPPORT).withColumn("split", F.lit(x)) for x in ("val", "test")]
    return out[0].unionByName(out[1])


QUERIES = {
    "role_heldout": role_heldout,
    "role_you_have": lambda s, d: p.gap(one_role(s, d), have(s, d)).where("have").orderBy(F.desc("support"), "skill").limit(30).select("skill", "support", "lift"),
    "filter_include_exclude": lambda s, d: table(s, d, "postings").where(t.is_tech_title(F.col("job_title"))).select("posting_id", "job_title"),
    "case_role_assign": lambda s, d: _titles(s, d).select("posting_id", "role"),
    "case_seniority_assign": lambda s, d: _titles(s, d).select("posting_id", "level"),
    "rare_group_null": lambda s, d: p.null_rare(_titles(s, d).select("posting_id", "role"), "role", 200),
    "role_level_totals": lambda s, d: p.totals(rows(s, d)),
    "role_skill_edges": role_edges,
    "role_level_support": lambda s, d: p.level_shares(rows(s, d), role_edges(s, d), FLOOR),
    "skill_roles": skill_roles,
    "role_gap": lambda s, d: p.gap(one_role(s, d), have(s, d)).where("not have").orderBy(F.desc("score"), "skill").limit(15),
    "role_gap_seniority": role_gap_seniority,
    "role_gap_coverage": lambda s, d: p.gap(role_edges(s, d), have(s, d)).groupBy("role").agg(F.round(F.avg(F.col("have").cast("int")), 6).alias("coverage")),
    "role_match": lambda s, d: p.match(role_edges(s, d), have(s, d)),
    "role_top_support": role_top_support,
    "role_specific_skills": lambda s, d: role_edges(s, d).where("support >= 0.08").orderBy(F.desc("lift"), "skill", "role").limit(20),
    "seniority_gap": seniority_gap,
    "crosstab_pivot": crosstab_pivot,
    "value_counts": lambda s, d: _titles(s, d).groupBy("role", "level").agg(F.count("*").alias("n")),
    "coverage_stats": coverage_stats,
    "sample_titles": sample_titles,
    "role_family": lambda s, d: _titles(s, d).where("role is not null").select("role").distinct().select("role", t.family_of(F.col("role")).alias("family")),
    "scatter_points": scatter_points,
    "api_roles": api_roles,
}

_R = with_(*ROLE)
_LOW = "lower(coalesce(job_title, ''))"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _case(text: str, ordered, otherwise="NULL") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {_q(x)}) THEN {_q(n)}" for n, x in ordered) + f" ELSE {otherwise} END"


_ROLE = f"CASE WHEN regexp_matches({_LOW}, {_q(t.NO_ROLE)}) THEN NULL ELSE {_case(_LOW, t.ROLES)} END"
_TT = f"WITH tt AS (SELECT posting_id, job_title, {_ROLE} AS role, {_case(_LOW, t.LEVELS, _q('mid'))} AS level FROM postings) "
_ONE = ", r1 AS (SELECT min(c_mktsegment) AS role FROM customer), o AS (SELECT re.* FROM re JOIN r1 USING (role))"
_DEN = ", den AS (SELECT role, level, count(DISTINCT k) AS denom FROM g GROUP BY 1, 2 HAVING count(DISTINCT k) >= 20), lv AS (SELECT s, role, level, count(*) AS n FROM g GROUP BY 1, 2, 3), ls AS (SELECT re.skill, re.role, den.level, round(coalesce(lv.n, 0) / den.denom::DOUBLE, 4) AS share FROM re JOIN den USING (role) LEFT JOIN lv ON lv.s = re.skill AND lv.role = re.role AND lv.level = den.level)"
_GAP = "SELECT {e}.skill, {e}.role, {e}.support, {e}.lift, h.skill IS NOT NULL AS have, round({e}.support * greatest({e}.lift, 0.1::DOUBLE), 6) AS score FROM {e} LEFT JOIN h USING (skill)"
_H = ", h AS (SELECT DISTINCT p_name AS skill FROM part WHERE ascii(substr(p_name, 2, 1)) % 4 = 0)"

ORACLE = {
    "role_heldout": _R + """, ho AS (SELECT b.k, b.s, role, split FROM b JOIN sp USING (k) JOIN post USING (k) WHERE split <> 'train' AND b.s IN (SELECT s FROM t)),
ht AS (SELECT split, role, count(DISTINCT k) AS total FROM ho GROUP BY ALL), hc AS (SELECT split, s AS skill, role, count(DISTINCT k) AS count FROM ho GROUP BY ALL)
SELECT skill, role, count, split FROM hc JOIN ht USING (split, role) WHERE count >= 3 AND count / total::DOUBLE >= 0.06 AND NOT EXISTS (SELECT 1 FROM re WHERE re.skill = hc.skill AND re.role = hc.role)""",
    "role_you_have": _R + _ONE + _H + " SELECT o.skill, o.support, o.lift FROM o JOIN h USING (skill) ORDER BY o.support DESC, o.skill LIMIT 30",
    "filter_include_exclude": f"SELECT posting_id, job_title FROM postings WHERE regexp_matches({_LOW}, {_q(t.INCLUDE)}) AND NOT regexp_matches({_LOW}, {_q(t.EXCLUDE)})",
    "case_role_assign": _TT + "SELECT posting_id, role FROM tt",
    "case_seniority_assign": _TT + "SELECT posting_id, level FROM tt",
    "rare_group_null": _TT + "SELECT posting_id, CASE WHEN count(*) OVER (PARTITION BY role) >= 200 THEN role END AS role FROM tt",
    "role_level_totals": _R + "SELECT role, level, count(DISTINCT k) AS n FROM g GROUP BY GROUPING SETS ((role), (role, level))",
    "role_skill_edges": _R + "SELECT skill, role, count, support, lift FROM re",
    "role_level_support": _R + _DEN + " SELECT * FROM ls",
    "skill_roles": _R + "SELECT skill, role, support, lift, row_number() OVER (PARTITION BY skill ORDER BY lift DESC, role) AS rank FROM re QUALIFY rank <= 8",
    "role_gap": _R + _ONE + _H + " SELECT * FROM (" + _GAP.format(e="o") + ") WHERE NOT have ORDER BY score DESC, skill LIMIT 15",
    "role_gap_seniority": _R + _ONE + _H + _DEN + ", q AS (SELECT o.skill, o.role, ls.share AS support, o.lift FROM o JOIN ls ON ls.skill = o.skill AND ls.role = o.role WHERE level = '1-URGENT' AND share > 0) " + _GAP.format(e="q"),
    "role_gap_coverage": _R + _H + ", q AS (" + _GAP.format(e="re") + ") SELECT role, round(avg(have::INT), 6) AS coverage FROM q GROUP BY role",
    "role_match": _R + _H + ", q AS (SELECT *, row_number() OVER (PARTITION BY role, have ORDER BY support DESC, skill) AS rn FROM (" + _GAP.format(e="re") + """))
SELECT role, round(sum(CASE WHEN have THEN support ELSE 0 END) / sum(support), 6) AS coverage, count_if(have) AS n_have, count(*) AS n_skills,
  array_to_string(list_slice(coalesce(list(skill ORDER BY skill) FILTER (have), []), 1, 15), '|') AS matched,
  coalesce(string_agg(skill, '|' ORDER BY rn) FILTER (NOT have AND rn <= 5), '') AS top_missing FROM q GROUP BY role""",
    "role_top_support": _R + "SELECT role, skill, support, row_number() OVER (PARTITION BY role ORDER BY support DESC, skill) AS rank FROM re QUALIFY rank <= 8",
    "role_specific_skills": _R + "SELECT skill, role, count, support, lift FROM re WHERE support >= 0.08 ORDER BY lift DESC, skill, role LIMIT 20",
    "seniority_gap": _R + _DEN + " SELECT a.skill, a.role, round(a.share - c.share, 4) AS gap FROM ls a JOIN ls c ON a.skill = c.skill AND a.role = c.role WHERE a.level = '1-URGENT' AND c.level = '3-MEDIUM' ORDER BY gap DESC, a.skill, a.role LIMIT 12",
    "crosstab_pivot": _TT + "SELECT role, " + ", ".join(f"count_if(level = '{x}') AS {x}" for x in t.LEVEL_ORDER) + " FROM tt WHERE role IS NOT NULL GROUP BY role",
    "value_counts": _TT + "SELECT role, level, count(*) AS n FROM tt GROUP BY ALL",
    "coverage_stats": _TT + "SELECT count(*) AS n_rows, count(role) AS n_assigned, round(avg((role IS NOT NULL)::INT), 6) AS coverage, count(DISTINCT role) AS n_roles FROM tt",
    "sample_titles": _TT + """, big AS (SELECT role, count(*) AS n FROM tt WHERE role IS NOT NULL GROUP BY role ORDER BY n DESC, role LIMIT 12)
SELECT role, job_title, row_number() OVER (PARTITION BY role ORDER BY job_title) AS rank FROM (SELECT DISTINCT role, job_title FROM tt) JOIN big USING (role) QUALIFY rank <= 4""",
    "role_family": _TT + "SELECT role, " + _case("role", [(n, t.any_of(w)) for n, w in t.FAMILIES]) + " AS family FROM (SELECT DISTINCT role FROM tt WHERE role IS NOT NULL)",
    "scatter_points": _R + _ONE + _H + ", q AS (" + _GAP.format(e="o") + ") SELECT skill, have, least(0, floor(lift))::DOUBLE AS low, greatest(1, ceil(lift))::DOUBLE AS high FROM q ORDER BY NOT have, score DESC, skill LIMIT 18",
    "api_roles": _R + """, n AS (SELECT role, level, count(DISTINCT k) AS n FROM g GROUP BY 1, 2), c AS (SELECT role, count(*) AS c FROM re GROUP BY role)
SELECT role, sum(n)::BIGINT AS postings, string_agg(level || '=' || n, '|' ORDER BY level || '=' || n) AS by_level, coalesce(any_value(c), 0) AS distinct_skills FROM n LEFT JOIN c USING (role) GROUP BY role""",
}
