"""Rows of a few classes are not sent to as many tasks."""

from pyspark.sql import functions as F

from statloom.operators.relational import train_test_flag


def test_a_split_by_class_moves_no_rows(spark):
    df = spark.range(4000).select("id", (F.col("id") % 2).alias("kind"))
    split = train_test_flag(df, ["id"], 0.2, 42, "held", "kind")
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert {r["kind"]: r["n"] for r in split.filter("held").groupBy("kind").agg(F.count("*").alias("n")).collect()} == {0: 400, 1: 400}
