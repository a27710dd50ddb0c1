"""Running values over an ordered key, without putting a whole key into one task.

A plain window over `keys` sorts all rows of a key in one task. Here a key's rows are cut
into time buckets: the window runs inside (key, bucket), and what earlier buckets hand on is
computed from one aggregated row per bucket and joined back. The results are those of the
plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightops.functions.times import epoch_micros
from flightops.session import written

# Short, so that a burst is spread too; a key of one day has at most 864,000 buckets however many its rows.
BUCKET_SECONDS = 0.1


def _bucket(ts: str, seconds: float) -> Column:
    return F.floor(epoch_micros(F.col(ts)) / F.lit(int(seconds * 1_000_000))).cast("bigint")


def _bucketed(rows: DataFrame, ts: str, seconds: float, once: bool) -> DataFrame:
    bucketed = rows.withColumn("_bucket", _bucket(ts, seconds))
    return written(bucketed, "bucketed") if once else bucketed


def with_running_last(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, str],
    include_current: bool = True,
    bucket_seconds: float = BUCKET_SECONDS,
    once: bool = False,
) -> DataFrame:
    """Add, for each `values` entry (new name -> column), its last non-null value so far.

    `order` starts with a timestamp column and must be unique within a key. The rows are needed twice, for themselves and
    for the row of their bucket. With `once` they are written to the shared folder first: the choice
    for rows that took joins to make, where evaluating them again costs more than writing them.
    """
    bucketed = _bucketed(rows, order[0], bucket_seconds, once)
    last_row = 0 if include_current else -1
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, last_row)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)

    position = F.struct(*order)
    per_bucket = bucketed.groupBy(*keys, "_bucket").agg(
        *[F.max_by(source, F.when(F.col(source).isNotNull(), position)).alias(f"_b_{name}")
          for name, source in values.items()]
    )
    carried = per_bucket.select(
        *keys,
        "_bucket",
        *[F.last(f"_b_{name}", ignorenulls=True).over(before).alias(f"_c_{name}") for name in values],
    )
    local = bucketed.select(
        "*", *[F.last(source, ignorenulls=True).over(inside).alias(f"_w_{name}") for name, source in values.items()]
    )
    return local.join(carried, [*keys, "_bucket"]).select(
        *rows.columns, *[F.coalesce(f"_w_{name}", f"_c_{name}").alias(name) for name in values]
    )


def with_row_number(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    bucket_seconds: float = BUCKET_SECONDS,
    once: bool = False,
) -> DataFrame:
    """Add the 1-based position of each row within its key. `order` and `once` as above."""
    bucketed = _bucketed(rows, order[0], bucket_seconds, once)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    numbered = bucketed.withColumn("_position", F.row_number().over(inside))
    return numbered.join(offsets, [*keys, "_bucket"]).select(
        *rows.columns, (F.col("_offset") + F.col("_position")).alias(name)
    )
