"""Exact top-k inner products by an impact-ordered index, read score at a time.

The index cuts the vectors into blocks. In a block, the postings (row, value) of each dimension are
kept in segments by quantised impact: the sign and the number of binary digits of the value. Segments are
read by descending impact, those of one size of all dimensions together, and for a group of queries at
once: their contributions are added to one sum per query and row by a product of matrices.

Every query brings a floor, the k-th best exact score among the rows of a bounded sample, so its k best
rows score at least that. A row's score is at most its sum plus what the unread segments of each dimension
can still add. Reading stops once these bounds prove that all but a few rows are below the floor, or when
no segment is left; a block whose bound lies below a query's floor is not read for it. The rows that may
still belong to the result are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flightops.llm.common import staged

BLOCK_ROWS = 4096
QUERY_ROWS = 8192  # queries that meet a block in one task
TOGETHER = 256  # queries that read a block's segments at once
ENOUGH = 32  # rows a query that are cheaper to score than to read on
SAMPLE_ROWS = 2048  # rows that give the floors; any number is right, more prune more
NO_FLOOR = -(1 << 62)

IDS, SEGMENT = -1, "block long, dim int, level int, rows binary, vals binary"


def integers(vector: str = "embedding") -> Column:
    """floor(256 * x) of every component; null if the vector or a component is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(F.coalesce(finite, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long")))


def _level(values: np.ndarray) -> np.ndarray:
    """Sign times number of binary digits."""
    digits = np.zeros(values.shape, np.int64)
    size = np.abs(values)
    while size.any():
        digits += size > 0
        size = size >> 1
    return np.sign(values) * digits


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Segments of vectors (vec_id, v): block, dim, level, rows and vals; dim -1 holds a block's ids.

    Zeros are not stored. Vectors may differ in length; what is missing counts as zero.
    """
    blocks = max(1, -(-vectors.count() // block_rows))

    def segments(block: int, ids: np.ndarray, matrix: np.ndarray) -> pd.DataFrame:
        out = [(block, IDS, matrix.shape[1], b"", ids.astype("<i8").tobytes())]
        levels = _level(matrix)
        for dim in range(matrix.shape[1]):
            column, level = matrix[:, dim], levels[:, dim]
            order = np.argsort(level, kind="stable")
            values, starts = np.unique(level[order], return_index=True)
            for value, rows in zip(values.tolist(), np.split(order, starts[1:]), strict=True):
                if value:
                    out.append((block, dim, value, rows.astype("<i4").tobytes(), column[rows].astype("<i8").tobytes()))
        return pd.DataFrame(out, columns=["block", "dim", "level", "rows", "vals"])

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made, held = TaskContext.get().partitionId(), 0, []
        size = 0

        def flush(frame: pd.DataFrame) -> pd.DataFrame:
            width = max(map(len, frame["v"]))
            matrix = np.zeros((len(frame), width), np.int64)
            for i, v in enumerate(frame["v"]):
                matrix[i, : len(v)] = v
            return segments((part << 32) + made, frame["vec_id"].to_numpy(), matrix)

        for frame in frames:
            while len(frame):
                take = frame.iloc[: block_rows - size]
                held.append(take)
                size, frame = size + len(take), frame.iloc[len(take) :]
                if size == block_rows:
                    yield flush(pd.concat(held))
                    made, held, size = made + 1, [], 0
        if held:
            yield flush(pd.concat(held))

    return vectors.select("vec_id", "v").repartition(blocks).mapInPandas(index, SEGMENT)


def _matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros or cut at `width`."""
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: min(len(v), width)] = v[:width]
    return out


def _fitting(queries: np.ndarray, most: int) -> type:
    """The type in which sums of products with values up to `most` are whole: a float where it is exact."""
    size = float(np.abs(queries).astype(float).sum(axis=1).max(initial=0.0)) * most
    return np.float32 if size < 1 << 23 else np.float64 if size < 1 << 52 else np.int64  # differences of two are whole too


class Block:
    """A block's segments by descending impact, and its rows for exact scores."""

    def __init__(self, frame: pd.DataFrame) -> None:
        head = frame[frame["dim"] == IDS].iloc[0]
        self.ids = np.frombuffer(head["vals"], "<i8")
        self.width = int(head["level"])
        rest = frame[frame["dim"] != IDS]
        self.matrix = np.zeros((len(self.ids), self.width), np.int64)
        self.layers = []  # (rows, dims, values) of all segments of one size
        size = np.abs(rest["level"].to_numpy())
        for level in np.unique(size)[::-1]:
            some = rest[size == level]
            rows = [np.frombuffer(x, "<i4") for x in some["rows"]]
            dims = np.repeat(some["dim"].to_numpy(np.int64), [len(r) for r in rows])
            rows, vals = np.concatenate(rows), np.frombuffer(b"".join(some["vals"]), "<i8")
            self.matrix[rows, dims] = vals
            self.layers.append((rows, dims, vals))
        # Largest and smallest value of each dimension in the segments from each layer on; 0 if there is none.
        self.high = np.zeros((len(self.layers) + 1, self.width), np.int64)
        self.low = np.zeros_like(self.high)
        for i in range(len(self.layers) - 1, -1, -1):
            _, dims, vals = self.layers[i]
            self.high[i], self.low[i] = self.high[i + 1], self.low[i + 1]
            np.maximum.at(self.high[i], dims, vals)
            np.minimum.at(self.low[i], dims, vals)
        self.most = int(np.abs(self.matrix).max(initial=0))

    def _left(self, queries: np.ndarray, layer: int) -> np.ndarray:
        """The most that segments from `layer` on can add to a score of each query."""
        return np.maximum(queries, 0) @ self.high[layer] + np.minimum(queries, 0) @ self.low[layer]

    def top(self, owns: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(own, ids, scores) of each query: its k best rows other than `own` that reach its floor."""
        meets = np.flatnonzero(self._left(queries, 0) >= floors)
        owns, queries, floors = owns[meets], queries[meets], floors[meets]
        kind = _fitting(queries, self.most)
        asked, sums = queries.astype(kind), np.zeros((len(queries), len(self.ids)), kind)
        may = np.ones(sums.shape, bool)
        for i, (rows, dims, vals) in enumerate(self.layers):
            layer = np.zeros((self.width, len(self.ids)), kind)
            layer[dims, rows] = vals
            sums += asked @ layer
            may = sums >= (floors - self._left(queries, i + 1)).astype(kind)[:, None]
            if np.count_nonzero(may) <= ENOUGH * len(may):
                break
        for own, query, rows in zip(owns.tolist(), queries, may, strict=True):
            rows = np.flatnonzero(rows)
            rows = rows[self.ids[rows] != own]
            scores = self.matrix[rows] @ query
            best = np.lexsort((self.ids[rows], -scores))[:k]
            yield own, self.ids[rows][best], scores[best]


def with_floors(queries: DataFrame, vectors: DataFrame, k: int, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """queries (vec_id, v) and floor: the k-th best score among `sample_rows` of vectors, least hashes first.

    Rows of the query's own id do not count; with fewer than k others the floor is below every score.
    """
    first = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()  # a bounded sample
    ids = np.array([r.vec_id for r in first], np.int64)
    rows = [np.asarray(r.v, np.int64) for r in first]

    def floors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample = _matrix(rows, max(map(len, rows), default=0))
        most = int(np.abs(sample).max(initial=0))
        for frame in frames:
            floor = np.full(len(frame), NO_FLOOR, np.int64)
            for at in range(0, len(frame), TOGETHER):
                part = frame.iloc[at : at + TOGETHER]
                asked = _matrix(list(part["v"]), sample.shape[1])
                kind = _fitting(asked, most)
                scores = (asked.astype(kind) @ sample.astype(kind).T).astype(np.int64)
                scores[part["vec_id"].to_numpy()[:, None] == ids] = NO_FLOOR
                if len(ids) >= k:
                    floor[at : at + TOGETHER] = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
            yield frame.assign(floor=floor)

    return queries.select("vec_id", "v").mapInPandas(floors, "vec_id long, v array<long>, floor long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k best rows of vectors (vec_id, v) for every row of queries (vec_id, v), v an array of longs:

    query_id, rank, vec_id, score. Rows with the query's own id are not candidates; rows that repeat an
    id and vector count once; ties go to the smaller id. Fewer than k candidates are all returned. Rows
    with a null id or vector take no part; an empty table gives no rows. Vectors may differ in length, what
    is missing counts as zero. Other columns are not read.
    """
    there = "vec_id is not null and v is not null"
    vectors = staged(vectors.select("vec_id", "v").filter(there).distinct(), "vectors")
    queries = queries.select("vec_id", "v").filter(there).distinct()
    index = staged(build_index(vectors, block_rows), "index")
    groups = max(1, -(-queries.count() // query_rows))
    queries = with_floors(queries, vectors, k).withColumn("grp", F.pmod(F.xxhash64("vec_id"), F.lit(groups)))
    blocks = index.filter(f"dim = {IDS}").select(F.col("block").alias("of"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    pairs = blocks.select("of", every.alias("grp"))
    left = queries.join(pairs, "grp").groupBy("of", "grp")
    right = index.withColumn("part", every).groupBy("block", "part")

    def search(asked: pd.DataFrame, segments: pd.DataFrame) -> pd.DataFrame:
        out = []
        block = Block(segments) if len(asked) else None
        for at in range(0, len(asked), TOGETHER):
            part = asked.iloc[at : at + TOGETHER]
            rows = _matrix(list(part["v"]), block.width)
            for own, ids, scores in block.top(part["vec_id"].to_numpy(), rows, part["floor"].to_numpy(), k):
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    found = left.cogroup(right).applyInPandas(search, "query_id long, vec_id long, score long").distinct()
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
