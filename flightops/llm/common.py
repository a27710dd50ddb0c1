"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from flightops.session import shared_dir, tune

# Rows per Arrow or Parquet batch of texts; a text may hold a hundred thousand characters.
BATCH_ROWS = 256


def session_for_texts(spark: SparkSession) -> SparkSession:
    """The session with small Arrow batches, so that a batch of long texts stays small."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def session_for_scans(spark: SparkSession) -> SparkSession:
    """The session for texts that also reads Parquet in small batches.

    The reader holds a batch's texts as one array, which it doubles as it fills: with 4,096 rows, tens of megabytes a task.
    """
    session_for_texts(spark)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BATCH_ROWS))
    return spark


def staged(rows: DataFrame, name: str) -> DataFrame:
    """`rows` written to the shared folder and read again, which cuts the lineage.

    Any executor can read the files, so a lost executor costs no recomputation.
    """
    spark = rows.sparkSession
    path = shared_dir(spark, name)
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash(text: str = "text") -> Column:
    """Tells rows apart that repeat an id with another text; a null text has a hash of its own."""
    return F.xxhash64(F.col(text).isNull(), F.col(text))


def small(rows: DataFrame, limit: int) -> DataFrame:
    """`rows`, to be broadcast if there are no more than `limit`; a larger table is joined by a shuffle."""
    return F.broadcast(rows) if rows.count() <= limit else rows


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Record batches, cut so that none has many more than `max_bytes` of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes, dtype=np.int64) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if high > low:
                yield batch.slice(low, high - low)


def pieces(batches: Iterator[pa.RecordBatch], max_bytes: int = 8_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Record batches with their texts, cut so that no piece has many more than `max_bytes` of text."""
    for part in slices(batches, max_bytes):
        yield part, part.column("text").to_pylist()


def map_texts(docs: DataFrame, keep: list[str], added: str, compute: Callable[[list[str | None]], list[list]]) -> DataFrame:
    """The columns `keep` of docs, unchanged, with the columns `added` that `compute` makes of the texts.

    `added` is a list of fields as in a schema; `compute` returns one list for each of them.
    """
    schema = docs.select(*keep).schema
    fields = T._parse_datatype_string(added).fields
    for field in fields:
        schema = schema.add(field)
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            own = [part.column(i) for i in range(len(keep))]
            new = [pa.array(values, kind) for values, kind in zip(compute(texts), types, strict=True)]
            yield pa.RecordBatch.from_arrays(own + new, names=[*keep, *(f.name for f in fields)])

    kept = [F.col(c) for c in keep]
    return docs.select(*kept, *([] if "text" in keep else ["text"])).mapInArrow(run, schema)
