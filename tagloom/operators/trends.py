"""Adoption series: fits, ranks within a year, direction, desire against use.

Series come as rows ``tech, year, share``; a missing year is no observation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shares(rows: DataFrame, by: str = "year", key: str = "k", tech: str = "s") -> DataFrame:
    """``tech, year, share`` of a year's postings that hold the item."""
    total = rows.select(by, key).distinct().groupBy(by).agg(F.count("*").alias("t"))
    n = rows.groupBy(F.col(tech).alias("tech"), by).agg(F.count("*").alias("n"))
    return n.join(total, by).select("tech", F.col(by).alias("year"), (F.col("n") / F.col("t").cast("double")).alias("share"))


def fit(series: DataFrame) -> DataFrame:
    """Least-squares line and first-to-last change of each series.

    Slope, change and r2 are null below two years, r2 also for a constant series, change
    where the first share isn't positive.
    """
    n, y, x = F.count("*"), F.col("share"), F.col("year").cast("double")
    first, last = F.min_by("share", "year"), F.max_by("share", "year")
    two = n >= 2
    return series.groupBy("tech").agg(
        n.alias("n_years"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.when(two, F.round(F.regr_slope(y, x), 6)).alias("slope"),
        F.when(two & (first > 0), F.round((last - first) / first, 4)).alias("change"),
        F.when(two & (F.min("share") < F.max("share")), F.round(F.regr_r2(y, x), 3)).alias("r2"),
        (n >= 4).alias("r2_meaningful"), F.round(last, 4).alias("latest"),
    )


def solid(fits: DataFrame, years: int = 3, latest: float = 0.01) -> DataFrame:
    return fits.where((F.col("n_years") >= years) & F.col("slope").isNotNull() & (F.col("latest") >= latest))


def composition(fits: DataFrame) -> DataFrame:
    """Median slope, share declining, and whether nearly all move the same way."""
    down = F.avg((F.col("slope") < 0).cast("int"))
    return fits.agg(F.count("*").alias("n"), F.round(F.median("slope"), 6).alias("median_slope"), F.round(down, 6).alias("share_down"), ((down > 0.6) | (down < 0.4)).alias("lopsided"))


def ranks(series: DataFrame) -> DataFrame:
    """``tech, year, rank``: 1 for the most adopted of a year down to 0; ties by name, descending."""
    w = Window.partitionBy("year")
    i = F.row_number().over(w.orderBy(F.desc("v"), F.desc("tech"))) - 1
    return series.withColumn("v", F.round("share", 4)).select("tech", "year", (1 - i / F.greatest(F.count("*").over(w) - 1, F.lit(1))).alias("rank"))


def rank_slopes(ranked: DataFrame, years: int = 3) -> DataFrame:
    x = F.col("year").cast("double")
    return ranked.groupBy("tech").agg(F.count("*").alias("n_years"), F.round(F.regr_slope(F.col("rank"), x), 6).alias("rank_slope")).where(F.col("n_years") >= years).select("tech", "rank_slope")


def direction(slope: Column, least: float = 0.01) -> Column:
    return F.when(slope > least, "rising").when(slope < -least, "falling").when(slope.isNotNull(), "flat")


def desire_gaps(desire: DataFrame, series: DataFrame) -> DataFrame:
    """``tech, year, gap``: desired minus used share in the latest year of desire; null gaps left out."""
    last = desire.groupBy("tech").agg(F.max("year").alias("year"), F.max_by("share", "year").alias("want"))
    return last.join(series, ["tech", "year"]).select("tech", "year", F.round(F.col("want") - F.col("share"), 4).alias("gap"))
