"""The gaps of a series are made from the rows once."""

from pyspark.sql import functions as F

from statloom.operators.timeseries import infer_period


def test_rows_are_read_once(spark):
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 7).cast("int"))
    found = infer_period(spark.range(40).select(F.lit("a").alias("who"), day.alias("day")), "day", "who")
    assert "Range (" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("a", 7.0, 52)]
