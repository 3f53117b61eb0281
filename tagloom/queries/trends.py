"""Adoption by year on the order tables, and the survey layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import names as n
from tagloom.operators import trends as t
from tagloom.plans.market import items, postings, table, with_
from tagloom.sources import survey


def dated(spark, d):
    return items(spark, d).join(postings(spark, d), "k")


def series(spark, d):
    return t.shares(dated(spark, d).select("k", "s", "year"))


def fits(spark, d):
    return t.fit(series(spark, d))


def desire(spark, d):
    """Share of a year's postings that hold the item on a returned line: the want, from 1997 on."""
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    back = line.where("l_returnflag = 'R'").join(part, line["l_partkey"] == part["p_partkey"]).select(F.col("l_orderkey").alias("k"), F.col("p_name").alias("s")).distinct()
    total = dated(spark, d).select("year", "k").distinct().groupBy("year").agg(F.count("*").alias("t"))
    got = back.join(postings(spark, d).select("k", "year"), "k").where("year >= 1997").groupBy(F.col("s").alias("tech"), "year").agg(F.count("*").alias("n"))
    return got.join(total, "year").select("tech", "year", (F.col("n") / F.col("t").cast("double")).alias("share"))


def json_nested_explode(spark, d):
    """Survey documents made of the yearly counts, written as JSON and read by the nested scan."""
    c = dated(spark, d).groupBy("year", "role", "s").agg(F.count("*").alias("n"))
    data = F.sort_array(F.collect_list(F.struct(F.col("s").alias("response"), F.col("n").alias("frequency"))))
    block = c.groupBy("year", "role").agg(F.struct(F.create_map(F.lit("all"), F.struct(F.sum("n").alias("total_respondents"), data.alias("data"))).alias("datasets")).alias("b"))
    docs = block.groupBy(F.col("year").cast("string").alias("year")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("role", "b")))).alias("doc"))
    return survey.modern_rows(docs, F.col("doc")).select("year", "block", "response", "frequency", "total_respondents")


#: Blocks that the roles of the order tables stand for in the survey documents below.
_BLOCK = {"AUTOMOBILE": "Language", "BUILDING": "Database", "FURNITURE": "Platform", "HOUSEHOLD": "SOTags", "MACHINERY": "DA_Language"}


def survey_rows(spark, d):
    """Survey documents with technology, topic and desire blocks, read by the nested scan."""
    r = dated(spark, d)
    total = r.groupBy("role", "year").agg(F.count_distinct("k").alias("t"))
    c = r.groupBy("year", "role", "s").agg(F.count("*").alias("n")).join(total, ["role", "year"]).withColumn("p", F.round(F.col("n") / F.col("t").cast("double"), 6))
    block = F.element_at(F.create_map(*[F.lit(x) for kv in _BLOCK.items() for x in kv]), F.col("role"))
    data = F.sort_array(F.collect_list(F.struct(F.col("s").alias("response"), F.col("n").alias("frequency"), F.col("p").alias("percent"), F.col("p").alias("percent1"))))
    b = c.withColumn("block", block).groupBy("year", "block").agg(F.struct(F.max("t").alias("total_respondents"), data.alias("data")).alias("x"))
    b = b.select("year", "block", F.struct(F.map_from_arrays(F.array("block"), F.array("x")).alias("datasets")).alias("b"))
    docs = b.groupBy(F.col("year").cast("string").alias("year")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("block", "b")))).alias("doc"))
    return survey.modern_rows(docs, F.col("doc"))


def survey_vocabulary(spark, d):
    v = survey.vocabulary(survey_rows(spark, d))
    return v.select("canonical", "key", F.array_join("aliases", "|").alias("aliases"), "category", F.array_join("years", "|").alias("years"), "max_frequency").orderBy(F.desc("max_frequency"), "canonical")


def legacy_pct_trycast(spark, d):
    s = series(spark, d).withColumn("v", F.when(F.col("year") % 2 == 0, (F.col("share") * 100).cast("string")).otherwise("n/a"))
    graph = F.struct(F.lit("All Respondents").alias("Title"), F.map_from_entries(F.collect_list(F.struct("tech", "v"))).alias("Data"))
    sub = F.struct(F.lit("Most Popular").alias("Title"), F.array(F.struct(F.array(graph).alias("Graphs"))).alias("GraphCollections"))
    docs = s.groupBy(F.col("year").cast("string").alias("year")).agg(F.to_json(F.struct(F.array(sub).alias("SubSections"))).alias("doc"))
    return survey.legacy_rows(docs, F.col("doc")).select("year", "response", F.round("percent", 6).alias("percent"))


def adoption_max(spark, d):
    """Largest share of a technology in a year over the blocks (here roles) that list it."""
    r = dated(spark, d)
    total = r.select("role", "year", "k").distinct().groupBy("role", "year").agg(F.count("*").alias("t"))
    c = r.groupBy("s", "role", "year").agg(F.count("*").alias("n")).join(total, ["role", "year"])
    return c.groupBy("s", "year").agg(F.round(F.max(F.col("n") / F.col("t").cast("double")), 6).alias("share"))


def first_seen(spark, d):
    r = dated(spark, d).withColumn("category", F.element_at(F.split("s", " "), -1))
    return r.groupBy("category").agg(F.min_by("s", F.struct("year", "k", "s")).alias("name"), F.min("year").alias("first_year"))


def solid(spark, d):
    return t.solid(fits(spark, d))


def rank_slopes(spark, d):
    return t.rank_slopes(t.ranks(series(spark, d)))


def api_trend(spark, d):
    """Detail of each technology: fit, series, rank slope and direction."""
    s = series(spark, d).groupBy("tech").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("year", F.round("share", 4).alias("v")))), lambda x: F.concat_ws("=", x["year"].cast("string"), F.printf(F.lit("%.4f"), x["v"]))), "|").alias("series"))
    return fits(spark, d).join(rank_slopes(spark, d), "tech", "left").join(s, "tech").withColumn("direction", t.direction(F.col("rank_slope")))


def membership_flag(spark, d):
    known = table(spark, d, "final_vocab").select(F.col("canonical").alias("name"), F.lit(True).alias("f"))
    nodes = table(spark, d, "graph_nodes").select("name")
    return nodes.join(known, "name", "left").select("name", F.col("f").isNotNull().alias("in_vocabulary"))


QUERIES = {
    "json_nested_explode": json_nested_explode,
    "survey_vocabulary": survey_vocabulary,
    "survey_adoption": lambda s, d: survey.adoption_rows(survey_rows(s, d)).select("tech", "year", "share", "category"),
    "survey_desire": lambda s, d: survey.desire_rows(survey_rows(s, d)),
    "survey_respondents": lambda s, d: survey.respondents(survey_rows(s, d)),
    "legacy_pct_trycast": legacy_pct_trycast,
    "filter_junk": lambda s, d: table(s, d, "final_mapping").where(~F.coalesce(n.is_no_answer(F.col("raw")), F.lit(False))).select("raw"),
    "canon_key": lambda s, d: table(s, d, "final_mapping").select("raw", n.canon_key(F.col("raw")).alias("key")),
    "adoption_max": adoption_max,
    "first_seen": first_seen,
    "trend_fit": fits,
    "trend_solid": solid,
    "trend_composition": lambda s, d: t.composition(solid(s, d)),
    "rank_series": lambda s, d: t.ranks(series(s, d)).select("tech", "year", F.round("rank", 4).alias("rank")),
    "rank_slope": rank_slopes,
    "trend_direction": lambda s, d: rank_slopes(s, d).select("tech", t.direction(F.col("rank_slope")).alias("direction")),
    "trends_rising": lambda s, d: fits(s, d).where("n_years >= 4 and slope is not null").orderBy(F.desc("slope"), "tech").limit(15).select("tech", "slope", "latest"),
    "trends_falling": lambda s, d: fits(s, d).where("n_years >= 4 and slope is not null").orderBy("slope", "tech").limit(15).select("tech", "slope", "latest"),
    "desire_gap": lambda s, d: t.desire_gaps(desire(s, d), series(s, d)),
    "membership_flag": membership_flag,
    "api_trend": api_trend,
}

_S = with_("items", "post") + """, dt AS (SELECT items.k, s, year, role FROM items JOIN post USING (k)), yt AS (SELECT year, count(DISTINCT k) AS t FROM dt GROUP BY year),
sr AS (SELECT s AS tech, year, count(*) / any_value(t)::DOUBLE AS share FROM dt JOIN yt USING (year) GROUP BY s, year),
ft AS (SELECT tech, count(*) AS n_years, min(year) AS first_year, max(year) AS last_year, CASE WHEN count(*) >= 2 THEN round(regr_slope(share, year::DOUBLE), 6) END AS slope,
  CASE WHEN count(*) >= 2 AND arg_min(share, year) > 0 THEN round((arg_max(share, year) - arg_min(share, year)) / arg_min(share, year), 4) END AS change,
  CASE WHEN count(*) >= 2 AND min(share) < max(share) THEN round(regr_r2(share, year::DOUBLE), 3) END AS r2, count(*) >= 4 AS r2_meaningful, round(arg_max(share, year), 4) AS latest FROM sr GROUP BY tech),
so AS (SELECT * FROM ft WHERE n_years >= 3 AND slope IS NOT NULL AND latest >= 0.01),
rk AS (SELECT tech, year, 1 - (row_number() OVER (PARTITION BY year ORDER BY round(share, 4) DESC, tech DESC) - 1) / greatest(count(*) OVER (PARTITION BY year) - 1, 1)::DOUBLE AS rank FROM sr),
rs AS (SELECT tech, round(regr_slope(rank, year::DOUBLE), 6) AS rank_slope FROM rk GROUP BY tech HAVING count(*) >= 3),
di AS (SELECT tech, rank_slope, CASE WHEN rank_slope > 0.01 THEN 'rising' WHEN rank_slope < -0.01 THEN 'falling' WHEN rank_slope IS NOT NULL THEN 'flat' END AS direction FROM rs)
"""


def _norm(c: str) -> str:
    return f"regexp_replace(regexp_replace(replace(regexp_replace(lower({c}), '\\(.*?\\)', ' ', 'g'), '&', ' and '), '[^a-z0-9+#./]', '', 'g'), '\\.+$', '')"


def _renames(c: str, t: dict) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in t.items()) + f" ELSE {c} END"


_BK = "CASE role " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _BLOCK.items()) + " END"
_CT = "CASE role " + " ".join(f"WHEN '{k}' THEN '{({**survey.BLOCKS, **survey.VOCABULARY_ONLY}).get(v)}'" for k, v in _BLOCK.items() if not v.startswith(survey.DESIRE)) + " END"
_SV = _S + f""", ry AS (SELECT role, year, count(DISTINCT k) AS t FROM dt GROUP BY ALL), sv AS (SELECT s, role, year, {_BK} AS block, {_CT} AS category, count(*) AS n, round(count(*) / any_value(t)::DOUBLE, 6) AS p FROM dt JOIN ry USING (role, year) GROUP BY s, role, year)
"""

ORACLE = {
    "survey_vocabulary": _SV + f"SELECT arg_max(s, (year, n, length(s), s)) AS canonical, {_norm('s')} AS key, any_value(s) AS aliases, string_agg(DISTINCT category, '/' ORDER BY category) AS category, string_agg(DISTINCT year::VARCHAR, '|' ORDER BY year::VARCHAR) AS years, max(n) AS max_frequency FROM sv WHERE category IS NOT NULL GROUP BY {_norm('s')} ORDER BY max_frequency DESC, canonical",
    "survey_adoption": _SV + f"SELECT {_norm('s')} AS tech, year::VARCHAR AS year, max(p) AS share, any_value(c) AS category FROM sv JOIN (SELECT s, arg_min(category, (year, list_position(['Language', 'Database', 'Platform'], block))) AS c FROM sv WHERE block IN ('Language', 'Database', 'Platform') GROUP BY s) USING (s) WHERE block IN ('Language', 'Database', 'Platform') GROUP BY s, year",
    "survey_desire": _SV + f"SELECT {_norm('s')} AS tech, year::VARCHAR AS year, max(p) AS share FROM sv WHERE block LIKE 'DA%' GROUP BY s, year",
    "survey_respondents": _SV + "SELECT year::VARCHAR AS year, max(t) AS respondents FROM ry WHERE role IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') GROUP BY year",
    "json_nested_explode": _S + "SELECT year::VARCHAR AS year, role AS block, s AS response, count(*) AS frequency, sum(count(*)) OVER (PARTITION BY year, role)::BIGINT AS total_respondents FROM dt GROUP BY year, role, s",
    "legacy_pct_trycast": _S + "SELECT year::VARCHAR AS year, tech AS response, round(share, 6) AS percent FROM sr WHERE year % 2 = 0",
    "filter_junk": "SELECT raw FROM final_mapping WHERE NOT coalesce(regexp_matches(raw, '" + n.NO_ANSWER.replace("'", "''") + "'), false)",
    "canon_key": f"SELECT raw, {_renames(_norm('raw'), n.TREND_RENAMES)} AS key FROM final_mapping",
    "adoption_max": _S + ", rt AS (SELECT role, year, count(DISTINCT k) AS t FROM dt GROUP BY ALL) SELECT s, year, round(max(n / t::DOUBLE), 6) AS share FROM (SELECT s, role, year, count(*) AS n FROM dt GROUP BY ALL) JOIN rt USING (role, year) GROUP BY s, year",
    "first_seen": _S + "SELECT split_part(s, ' ', -1) AS category, arg_min(s, (year, k, s)) AS name, min(year) AS first_year FROM dt GROUP BY 1",
    "trend_fit": _S + "SELECT * FROM ft",
    "trend_solid": _S + "SELECT * FROM so",
    "trend_composition": _S + "SELECT count(*) AS n, round(median(slope), 6) AS median_slope, round(avg((slope < 0)::INT), 6) AS share_down, avg((slope < 0)::INT) > 0.6 OR avg((slope < 0)::INT) < 0.4 AS lopsided FROM so",
    "rank_series": _S + "SELECT tech, year, round(rank, 4) AS rank FROM rk",
    "rank_slope": _S + "SELECT * FROM rs",
    "trend_direction": _S + "SELECT tech, direction FROM di",
    "trends_rising": _S + "SELECT tech, slope, latest FROM ft WHERE n_years >= 4 AND slope IS NOT NULL ORDER BY slope DESC, tech LIMIT 15",
    "trends_falling": _S + "SELECT tech, slope, latest FROM ft WHERE n_years >= 4 AND slope IS NOT NULL ORDER BY slope, tech LIMIT 15",
    "desire_gap": _S + """, w AS (SELECT s AS tech, year, count(*) / any_value(t)::DOUBLE AS want FROM (SELECT DISTINCT l_orderkey AS k, p_name AS s FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R') JOIN post USING (k) JOIN yt USING (year) WHERE year >= 1997 GROUP BY s, year)
SELECT tech, year, round(want - share, 4) AS gap FROM w JOIN sr USING (tech, year) QUALIFY year = max(year) OVER (PARTITION BY tech)""",
    "membership_flag": "SELECT name, name IN (SELECT canonical FROM final_vocab) AS in_vocabulary FROM graph_nodes",
    "api_trend": _S + "SELECT ft.*, rank_slope, series, direction FROM ft LEFT JOIN di USING (tech) JOIN (SELECT tech, string_agg(year || '=' || format('{:.4f}', round(share, 4)), '|' ORDER BY year) AS series FROM sr GROUP BY tech) USING (tech)",
}
