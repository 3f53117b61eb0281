import pytest
from pyspark.sql import functions as F

from tagloom.functions.text import fold
from tagloom.operators.eager import compact, heavy_keys, join_aggregate, roll_up


def test_join_aggregate_equals_plain_join(spark):
    a = spark.createDataFrame([(i % 3 if i % 10 else None, i) for i in range(50)], "k int, v int")
    b = spark.createDataFrame([(i % 4, i) for i in range(40)], "k int, v int")
    for how in ("inner", "left"):
        got = {r["key"]: tuple(r)[1:] for r in join_aggregate(a, b, F.col("k"), F.col("k"), {"s": ("sum", F.col("v")), "lo": ("min", F.col("v"))}, {"t": ("sum", F.col("v")), "c": ("count", F.col("v"))}, how).collect()}
        j = a.join(b.withColumnRenamed("v", "w").withColumnRenamed("k", "k2"), F.col("k") == F.col("k2"), how)
        want = {r["k"]: r for r in j.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.sum("w").alias("t"), F.count("w").alias("c")).collect()}
        assert set(got) == set(want)
        for k, (_, _, n, s, lo, t, c) in got.items():
            assert (n, s, lo) == (want[k]["n"], want[k]["s"], want[k]["lo"])
            assert (t, c or 0) == (want[k]["t"], want[k]["c"])


def test_roll_up_and_heavy(spark):
    a = spark.createDataFrame([(" A  b",), ("a B",), ("c",), (None,), ("  ",)], "company string")
    c = compact(a, fold(F.col("company")), {})
    assert {r["key"]: r["n"] for r in c.collect()} == {"a b": 2, "c": 1, None: 2}
    assert [r["key"] for r in heavy_keys(c, "n", 0.4).collect()] == ["a b"]
    assert heavy_keys(compact(a.limit(0), F.col("company"), {}), "n", 0.1).count() == 0
    j = join_aggregate(a, a, F.col("company"), F.col("company"), {"x": ("max", F.col("company"))})
    assert roll_up(j, F.lit(1), {"x": "max"}).first()["n_joined"] == 4


def test_states_must_differ(spark):
    a = spark.range(1)
    with pytest.raises(ValueError):
        join_aggregate(a, a, F.col("id"), F.col("id"), {"x": ("sum", F.col("id"))}, {"x": ("sum", F.col("id"))})


def test_heavy_companies_come_through_the_join(spark):
    """The plan of p5_found reads both tables and joins their states; rows without a partner count too."""
    from tagloom.operators.eager import per_left_row
    from tagloom.queries import QUERIES

    a = spark.createDataFrame([("x",)] * 4 + [("y",)] * 2 + [(None,)], "k string")
    b = spark.createDataFrame([("x",)] * 3, "k string")
    got = {r["key"]: r["rows"] for r in per_left_row(join_aggregate(a, b, F.col("k"), F.col("k"), how="left")).collect()}
    assert got == {"x": 4, "y": 2, None: 1}

    seen = []
    from tagloom.queries import training

    keep, training.cut = training.cut, lambda df: seen.append(df) or df
    try:
        QUERIES["p5_found"](spark, "/root/testdata/sf0.001").collect()
    finally:
        training.cut = keep
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and plan.count("FileScan parquet") == 2 and "postings.parquet" in plan and "postings_clean.parquet" in plan
