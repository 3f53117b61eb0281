"""Per-key results without long tasks when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a partial state of each kind is built and merged.
_BUILD = {"count": lambda c: F.count(c), "sum": lambda c: F.sum(c), "min": lambda c: F.min(c), "max": lambda c: F.max(c)}
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def compact(df: DataFrame, key: Column, states: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """One compact state per key: ``key, n`` and the named states.

    ``states`` maps a name to (kind, expression) with kind count, sum, min or max.  All
    are algebraic, so each task first reduces its own rows and at most one row per task
    and key is shuffled: a key with a third of all rows costs no task more than the
    others.  A null key is a key of its own; an empty table gives no rows.
    """
    cols = [e.alias(f"__{n}") for n, (_, e) in states.items()]
    slim = df.select(key.alias("key"), *cols)
    aggs = [_BUILD[kind](F.col(f"__{n}")).alias(n) for n, (kind, _) in states.items()]
    return slim.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *aggs)


def join_aggregate(
    left: DataFrame,
    right: DataFrame,
    left_key: Column,
    right_key: Column,
    left_states: Mapping[str, tuple[str, Column]] | None = None,
    right_states: Mapping[str, tuple[str, Column]] | None = None,
    how: str = "inner",
) -> DataFrame:
    """Aggregates of ``left JOIN right`` per join key, without forming the joined rows.

    Both inputs are reduced to one state per key before the join (eager aggregation),
    the states are joined and combined: the joined row count is ``n_left * n_right``, a
    sum or count over one side is multiplied by the rows of the other, minima and maxima
    stay.  Columns: ``key, n_left, n_right, n_joined`` and the states under their names.
    Null keys never join (``how='left'`` keeps them with ``n_right`` 0).  States of both
    sides must have different names; other columns may clash freely.
    """
    ls, rs = dict(left_states or {}), dict(right_states or {})
    if set(ls) & set(rs):
        raise ValueError(f"states named twice: {sorted(set(ls) & set(rs))}")
    a = compact(left, left_key, ls).withColumnRenamed("n", "n_left")
    b = compact(right, right_key, rs).withColumnRenamed("n", "n_right").withColumnRenamed("key", "__key")
    j = a.join(b, a["key"] == b["__key"], how).drop("__key")
    n_right = F.coalesce("n_right", F.lit(0))
    outer = how == "left"
    # an unmatched left row still appears once in a left join
    times_left = F.greatest(n_right, F.lit(1)) if outer else n_right
    out = [F.col("key"), F.col("n_left"), n_right.alias("n_right"), (F.col("n_left") * times_left).alias("n_joined")]
    for n, (kind, _) in ls.items():
        out.append((F.col(n) * times_left if kind in ("sum", "count") else F.col(n)).alias(n))
    for n, (kind, _) in rs.items():
        out.append((F.col(n) * F.col("n_left") if kind in ("sum", "count") else F.col(n)).alias(n))
    return j.select(*out)


def per_left_row(joined: DataFrame, *states: str) -> DataFrame:
    """Adds ``rows``: the left rows behind the joined ones, each counted once.

    A left row stands in ``max(n_right, 1)`` rows of a left join, so its joined rows and
    the ``states`` that were multiplied with them are divided by that number, exactly.
    """
    copies = F.greatest("n_right", F.lit(1))
    return joined.withColumns({"rows": F.expr("n_joined div greatest(n_right, 1)"), **{s: F.col(s) / copies for s in states}})


def roll_up(joined: DataFrame, by: Column, states: Mapping[str, str]) -> DataFrame:
    """Roll the states of :func:`join_aggregate` up to coarser keys: ``key, n_left, n_right, n_joined`` and states."""
    kept = ["n_left", "n_right", "n_joined"]
    return joined.groupBy(by.alias("key")).agg(
        *[F.sum(c).alias(c) for c in kept], *[_MERGE[kind](n).alias(n) for n, kind in states.items()]
    )


def heavy_keys(compacted: DataFrame, n: str, share: float) -> DataFrame:
    """Keys with at least ``share`` of the rows counted in ``n``; null keys count in the total only."""
    total = compacted.agg(F.sum(n).alias("__total"))
    return compacted.join(F.broadcast(total)).where(F.col("key").isNotNull() & (F.col(n) / F.col("__total") >= share)).drop("__total")
