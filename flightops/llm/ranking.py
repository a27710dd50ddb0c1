"""Places in a total order of all rows, with no task holding more than its range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flightops.llm.common import staged

ROW_BITS = 33  # of monotonically_increasing_id: the partition is above them, the row within it below
BROADCAST_BYTES = 16_000_000


def in_order(rows: DataFrame, keys: list[Column | str]) -> DataFrame:
    """`rows`, written in ranges of `keys`, with `__at`: the range in the high bits, the row in it in the low ones."""
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return staged(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranges")


def runs(placed: DataFrame, group: list[str]) -> DataFrame:
    """One row for each group and range: `__first` (its first `__at`), `__before` (rows of the group in earlier ranges), `__n`.

    There are no more of them than groups and ranges together, if the group leads the order.
    """
    part = F.shiftright("__at", ROW_BITS).alias("__part")
    counted = placed.groupBy(*group, part).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    return counted.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))


def light(rows: DataFrame, text: str | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`rows` of numbers and at most one text column, to be broadcast if they have no more than `limit` bytes."""
    size = F.lit(64) + (F.coalesce(F.octet_length(text), F.lit(0)) if text else F.lit(0))
    return F.broadcast(rows) if (rows.agg(F.sum(size)).first()[0] or 0) <= limit else rows


def ranked(rows: DataFrame, keys: list[Column | str], name: str) -> DataFrame:
    """`rows` with `name`, their place in the order of `keys`, from 0. Rows with equal keys stand in any order."""
    placed = in_order(rows, keys)
    starts = light(staged(runs(placed, []).select("__part", "__first", "__before"), "starts"))
    found = placed.withColumn("__part", F.shiftright("__at", ROW_BITS)).join(starts, "__part")
    return found.select(*rows.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias(name))
