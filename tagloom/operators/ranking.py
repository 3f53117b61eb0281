"""Running sums over a whole table in order, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.plans.lineage import cut


def running(df: DataFrame, order: str, *values: str, by: tuple[str, ...] = (), descending: bool = False) -> DataFrame:
    """``df`` with ``before_x`` for each of the ``values``: its sum over the rows that come earlier.

    ``order`` must differ within the rows of a group ``by``.  The rows are partitioned by
    ranges of the order; each range is summed by itself and then raised by the totals of
    the ranges before it, of which there are no more than partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.desc(order) if descending else F.asc(order)
    x = cut(df.repartitionByRange(n, *by, key).withColumn("__part", F.spark_partition_id()))
    totals = x.groupBy(*by, "__part").agg(*[F.sum(v).alias(f"__{v}") for v in values])
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    raised = totals.select(*by, "__part", *[F.coalesce(F.sum(f"__{v}").over(earlier), F.lit(0)).alias(f"__{v}") for v in values])
    w = Window.partitionBy(*by, "__part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    y = x.select(*x.columns, *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"before_{v}") for v in values])
    y = y.join(raised, [*by, "__part"])
    return y.select(*df.columns, *[(F.col(f"before_{v}") + F.col(f"__{v}")).alias(f"before_{v}") for v in values])
