"""Queries of the core and the SQL that states them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.text import fold
from tagloom.operators.eager import heavy_keys, join_aggregate, per_left_row, roll_up
from tagloom.operators.packed import split_packed
from tagloom.plans.lineage import cut


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return split_packed(_t(spark, d, "postings"), ["posting_id"], "job_skills", "skill")


def p5_companies(spark: SparkSession, d: str) -> DataFrame:
    """Per company: rows of both tables, rows of their join, skills held and the latest arrival."""
    clean, postings = _t(spark, d, "postings_clean"), _t(spark, d, "postings")
    return join_aggregate(
        clean, postings, fold(F.col("company")), fold(F.col("company")),
        {"n_skills": ("sum", F.greatest(F.size("skills"), F.lit(0)))},
        {"last_ingested": ("max", F.col("ingested_at"))}, "left",
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The joined states by spelling, rolled up to companies; each clean row counts once, whatever it joins."""
    clean, postings = _t(spark, d, "postings_clean"), _t(spark, d, "postings")
    low = F.lower("company")
    by_spelling = per_left_row(join_aggregate(clean, postings, low, low, how="left"))
    # written: one row per company, read for the total and for the shares
    companies = cut(roll_up(by_spelling, fold(F.col("key")), {"rows": "sum"}))
    return heavy_keys(companies, "rows", 0.02).select(F.col("key").alias("company"))


QUERIES = {"p2_found": p2_found, "p5_found": p5_found, "p5_companies": p5_companies}

_SPACE = r"'[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{001C}-\x{001F}]+', ' ', 'g'"
_FOLD = f"nullif(trim(regexp_replace(lower(company), {_SPACE})), '')"

ORACLE = {
    "p5_found": f"""SELECT company FROM (SELECT {_FOLD} AS company, count(*) AS n FROM postings_clean GROUP BY 1)
WHERE company IS NOT NULL AND n / (SELECT count(*)::DOUBLE FROM postings_clean) >= 0.02""",
    "p5_companies": f"""WITH a AS (SELECT {_FOLD} AS key, count(*) AS n, sum(coalesce(len(skills), 0)) AS s FROM postings_clean GROUP BY 1),
b AS (SELECT {_FOLD} AS key, count(*) AS n, max(ingested_at) AS m FROM postings GROUP BY 1)
SELECT a.key, a.n AS n_left, coalesce(b.n, 0) AS n_right, a.n * greatest(coalesce(b.n, 0), 1) AS n_joined,
  (a.s * greatest(coalesce(b.n, 0), 1))::BIGINT AS n_skills, b.m AS last_ingested FROM a LEFT JOIN b ON a.key = b.key""",
}
