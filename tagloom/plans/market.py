"""The market model on the order tables: an order is a posting, its part names are skills.

Customers are companies, market segments roles, order priorities levels and order years
survey years; the columns are named after what they stand for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def item_rows(spark: SparkSession, d: str) -> DataFrame:
    """``k, s``: the skills of each posting, repeats included, for what gathers them by posting anyway."""
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    return line.join(part, line["l_partkey"] == part["p_partkey"]).select(F.col("l_orderkey").alias("k"), F.col("p_name").alias("s"))


def items(spark: SparkSession, d: str) -> DataFrame:
    """``k, s``: the distinct skills of each posting."""
    return item_rows(spark, d).distinct()


def baskets(spark: SparkSession, d: str) -> DataFrame:
    """``k, skills``: sorted skills of the postings with two or more."""
    return item_rows(spark, d).groupBy("k").agg(F.array_sort(F.collect_set("s")).alias("skills")).where(F.size("skills") >= 2)


def bucket_of(key: Column, buckets: int = 10) -> Column:
    """A bucket that depends on the key alone, the same in every engine with MD5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % buckets


def split_of(key: Column) -> Column:
    b = bucket_of(key)
    return F.when(b == 0, "test").when(b == 1, "val").otherwise("train")


def split_items(spark: SparkSession, d: str, *splits: str) -> DataFrame:
    """``k, s`` of the postings in some splits."""
    b = baskets(spark, d).where(split_of(F.col("k")).isin(*splits))
    return b.select("k", F.explode("skills").alias("s"))


def postings(spark: SparkSession, d: str) -> DataFrame:
    """``k, company, role, level, year``."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("company"), F.col("c_mktsegment").alias("role"),
        F.col("o_orderpriority").alias("level"), F.year("o_orderdate").alias("year"),
    )


def part_nodes(spark: SparkSession, d: str) -> DataFrame:
    """``s, category, in_survey``: second word of a name as its category, a few first words as survey names."""
    names = table(spark, d, "part").select(F.col("p_name").alias("s")).distinct()
    return names.select("s", F.element_at(F.split("s", " "), -1).alias("category"), (F.ascii(F.substring("s", 1, 1)) % 2 == 0).alias("in_survey"))


#: The same model as common table expressions of DuckDB.
CTE = {
    "items": "items AS (SELECT DISTINCT l_orderkey AS k, p_name AS s FROM lineitem JOIN part ON l_partkey = p_partkey)",
    "b": "b AS (SELECT k, s FROM items QUALIFY count(*) OVER (PARTITION BY k) >= 2)",
    "sp": "sp AS (SELECT DISTINCT k, CASE ('0x' || substr(md5(k::VARCHAR), 1, 8))::BIGINT % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM b)",
    "t": "t AS (SELECT b.k, b.s FROM b JOIN sp USING (k) WHERE split = 'train')",
    "n": "n AS (SELECT count(DISTINCT k) AS n FROM t)",
    "df": "df AS (SELECT s, count(*) AS doc_freq FROM t GROUP BY s)",
    "p": "p AS (SELECT x.s AS source, y.s AS target, count(*) AS count FROM t x JOIN t y ON x.k = y.k AND x.s < y.s GROUP BY 1, 2)",
    "e": """e AS (SELECT source, target, count, round(v, 4) AS pmi FROM (
  SELECT source, target, count, ln(count::DOUBLE * n.n / (a.doc_freq::DOUBLE * c.doc_freq)) AS v
  FROM p JOIN df a ON a.s = source JOIN df c ON c.s = target CROSS JOIN n) WHERE count >= 3 AND v > 0)""",
    "a": "a AS (SELECT source AS i, target AS j, count, pmi FROM e UNION ALL SELECT target, source, count, pmi FROM e)",
    "deg": "deg AS (SELECT i, count(*) AS d FROM a GROUP BY i)",
    "post": "post AS (SELECT o_orderkey AS k, o_custkey AS company, c_mktsegment AS role, o_orderpriority AS level, year(o_orderdate) AS year FROM orders JOIN customer ON o_custkey = c_custkey)",
    "nodes": "nodes AS (SELECT DISTINCT p_name AS s, split_part(p_name, ' ', -1) AS category, ascii(p_name) % 2 = 0 AS in_survey FROM part)",
    "g": "g AS (SELECT t.k, t.s, role, level FROM t JOIN post USING (k))",
    "rt": "rt AS (SELECT role, count(DISTINCT k) AS total FROM g GROUP BY role)",
    "re": """re AS (SELECT s AS skill, role, n AS count, round(n / total::DOUBLE, 4) AS support, round(ln((n / total::DOUBLE) / (all_n / tot::DOUBLE)), 4) AS lift FROM (
  SELECT s, role, n, total, sum(n) OVER (PARTITION BY s) AS all_n, (SELECT sum(total) FROM rt) AS tot
  FROM (SELECT s, role, count(*) AS n FROM g GROUP BY s, role) JOIN rt USING (role)) WHERE n >= 3 AND n / total::DOUBLE >= 0.06)""",
}


def with_(*names: str) -> str:
    """WITH clause of some of the expressions above, in their order."""
    return "WITH " + ",\n".join(CTE[n] for n in CTE if n in names) + "\n"


GRAPH = ("items", "b", "sp", "t", "n", "df", "p", "e")
ROLE = ("items", "b", "sp", "t", "post", "g", "rt", "re")
