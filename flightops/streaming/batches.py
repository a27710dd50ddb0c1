"""What a `foreachBatch` job keeps from one micro-batch to the next, and the watermark that it keeps itself.

A job's folder holds `out/<table>/batch_id=<n>`, the rows that a micro-batch settled, and `state/<table>/<n mod 3>`,
what it handed on. A micro-batch reads the state of the one before and overwrites its own folders, so a
replay after a failure writes the same again. State takes no more room than three micro-batches of it.

The watermark is the oldest, over the kinds of rows that feed the job, of the newest event times seen, less the
allowed delay. Rows at or behind the watermark of the micro-batch before are late: they come out once, in `late`. All others are
settled as soon as the watermark reaches them, in the order of their times, whatever micro-batch brought them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from flightops.functions.times import epoch_micros

KEPT = 3
MARKS = "kind string, newest_us bigint, watermark_us bigint"
END_OF_TIME = 253_402_300_799_000_000  # the watermark of a job that is told that no more rows come


class MicroBatch:
    """The tables of one micro-batch of a job."""

    def __init__(self, spark: SparkSession, folder: str, batch_id: int) -> None:
        self.spark, self.folder, self.batch_id = spark, folder, batch_id

    def before(self, name: str, schema: StructType | str) -> DataFrame:
        """A table as the micro-batch before left it; empty at the first."""
        if self.batch_id == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/state/{name}/{(self.batch_id - 1) % KEPT}")

    def keep(self, name: str, rows: DataFrame) -> DataFrame:
        path = f"{self.folder}/state/{name}/{self.batch_id % KEPT}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def put(self, name: str, rows: DataFrame) -> DataFrame:
        path = f"{self.folder}/out/{name}/batch_id={self.batch_id}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)


def micros_of(column: str) -> Column:
    return epoch_micros(F.col(column))


def due_rows(batch: MicroBatch, rows: DataFrame, kinds: tuple[str, ...], delay_seconds: int, last: bool) -> tuple[DataFrame, int | None]:
    """The rows (kind, ts, …) that this micro-batch settles, and the watermark that settles them.

    Writes the late ones and keeps those that are still ahead of the watermark.
    """
    marks = {r.kind: r for r in batch.before("marks", MARKS).collect()}  # one row per kind
    reached = max((r.watermark_us for r in marks.values() if r.watermark_us is not None), default=None)
    # The source is read once; everything after starts from this copy.
    arrived = batch.keep("arrived", rows)
    newest = {r.kind: r.newest_us for r in arrived.groupBy("kind").agg(F.max(micros_of("ts")).alias("newest_us")).collect()}
    newest = {k: max((t for t in (newest.get(k), marks[k].newest_us if k in marks else None) if t is not None), default=None) for k in kinds}
    watermark = reached
    if last:
        watermark = END_OF_TIME
    elif None not in newest.values():
        watermark = max(t for t in (min(newest.values()) - delay_seconds * 1_000_000, reached) if t is not None)
    batch.keep("marks", batch.spark.createDataFrame([(k, newest[k], watermark) for k in kinds], MARKS))

    late = F.lit(False) if reached is None else micros_of("ts") <= reached
    batch.put("late", arrived.filter(late))
    open_rows = arrived.filter(~late).unionByName(batch.before("pending", arrived.schema))
    due = F.lit(False) if watermark is None else micros_of("ts") <= watermark
    batch.keep("pending", open_rows.filter(~due))
    return open_rows.filter(due), watermark


def as_time(micros: int | None) -> Column:
    return F.timestamp_micros(F.lit(micros).cast("bigint")).cast("timestamp_ntz")


def run_job(
    rows: DataFrame, settle: Callable[[MicroBatch, DataFrame, bool], None], folder: str, checkpoint: str, available_now: bool
) -> StreamingQuery:
    """Start the job. A folder belongs to one checkpoint."""

    def step(batch: DataFrame, batch_id: int) -> None:
        settle(MicroBatch(batch.sparkSession, folder, batch_id), batch, False)

    writer = rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def close_job(spark: SparkSession, schema: StructType, settle: Callable, folder: str, batches: int) -> None:
    """Settle what is still open after the last of `batches` micro-batches, as if time had run out."""
    settle(MicroBatch(spark, folder, batches), spark.createDataFrame([], schema), True)


def results(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """All rows that a job has put out in a table so far."""
    return spark.read.parquet(f"{folder}/out/{name}").drop("batch_id")
