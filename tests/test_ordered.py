"""The bucketed running values equal the plain windows, on any mix of keys and times."""

from __future__ import annotations

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from flightops.operators.ordered import with_row_number, with_running_last

BASE = dt.datetime(2026, 1, 27)
ROW = st.tuples(
    st.sampled_from(["hot", "hot", "hot", "b", "c"]),
    st.integers(0, 400),
    st.one_of(st.none(), st.integers(0, 9)),
    st.one_of(st.none(), st.sampled_from(["", "x", "y"])),
)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROW, min_size=1, max_size=60))
def test_running_values_equal_plain_windows(spark, given_rows):
    rows = [(k, BASE + dt.timedelta(seconds=s), i, v, g) for i, (k, s, v, g) in enumerate(given_rows)]
    frame = spark.createDataFrame(rows, "k string, ts timestamp_ntz, seq int, v int, g string")
    order = ["ts", "seq"]
    window = Window.partitionBy("k").orderBy(*order)
    upto, before = (window.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    for current, span in ((True, upto), (False, before)):
        result = with_running_last(frame, ["k"], order, {"lv": "v", "lg": "g"}, current, bucket_seconds=60)
        plain = frame.select(
            "*", F.last("v", True).over(span).alias("lv"), F.last("g", True).over(span).alias("lg")
        )
        assert sorted(map(str, result.collect())) == sorted(map(str, plain.collect()))
    numbered = with_row_number(frame, ["k"], order, "n", bucket_seconds=60)
    plain = frame.withColumn("n", F.row_number().over(window))
    assert sorted(tuple(x) [2:3] + (x.n,) for x in numbered.collect()) == sorted(
        tuple(x)[2:3] + (x.n,) for x in plain.collect()
    )


def test_a_burst_of_one_key_is_spread(spark):
    off = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(off, "false")
    try:
        rows = spark.range(100_000).selectExpr("'hot' as k", "timestamp_micros(id * 10)::timestamp_ntz as ts", "id as seq")
        numbered = with_row_number(rows, ["k"], ["ts", "seq"], "n").withColumn("part", F.spark_partition_id())
        per_task = numbered.groupBy("part").agg(F.count("*").alias("c"), F.sum((F.col("n") != F.col("seq") + 1).cast("int")).alias("wrong"))
        tasks = per_task.collect()
        assert sum(t.wrong for t in tasks) == 0
        assert len(tasks) > 1
        assert max(t.c for t in tasks) < 100_000
    finally:
        spark.conf.unset(off)
