"""Mixing sources to target weights along a curriculum, in DataFrame operations only.

Each source has a weight that changes over training time (0 to 1), given by knots joined by straight
lines. The integral of its weight is the source's share of all words, up to a number of repeats of its
own words; what that limit leaves over is shared by weight among the others. Within a source the
documents stand in a fixed shuffled order, repeated as often as needed, until the demand is met. The
cumulative demand of a source at time t is its target times the part of its integral up to t; inverted,
it gives every copy of a document its training position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flightops.llm.common import staged, text_hash

Knots = Sequence[tuple[float, float]]
# Weights 5, 2 and 1 on average: the first fades, the second grows.
CURRICULUM: tuple[Knots, ...] = (((0, 6), (1, 4)), ((0, 1), (1, 3)), ((0, 1), (1, 1)))
MOST_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"
LEVELS = (2, 4)  # digits of the shuffle key by which running sums are split


def integral(knots: Knots) -> float:
    return sum((b - a) * (v + w) / 2 for (a, v), (b, w) in zip(knots, knots[1:]))


def time_at(knots: Knots, part: Column) -> Column:
    """The time by which the integral of the weight has reached `part` (0 to 1) of its whole."""
    whole, done, out = integral(knots), 0.0, F.lit(float(knots[-1][0]))
    pieces = []
    for (a, v), (b, w) in zip(knots, knots[1:]):
        area = (b - a) * (v + w) / 2
        if area > 0:
            rest = part * whole - F.lit(done)
            slope = (w - v) / (b - a)
            root = F.sqrt(F.greatest(F.lit(0.0), F.lit(float(v * v)) + 2 * slope * rest))
            pieces.append(((done + area) / whole, F.lit(float(a)) + F.try_divide(2 * rest, F.lit(float(v)) + root)))
        done += area
    for end, time in reversed(pieces):
        out = F.when(part <= end, F.coalesce(time, F.lit(0.0))).otherwise(out)
    return out


def targets(sizes: DataFrame, curriculum: Sequence[Knots], most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, curve, target) for sizes (source, size): one row per source.

    Curves go to sources in code point order, null last, over and over. A source that would get more
    than `most` times its words gets that, and the excess is shared by weight among the others. Sorted
    by limit over weight, the sources at their limit come first: the first source that stays within its
    limit, when all before it have theirs, fixes the level of all after it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1  # one row per source
    weights = F.array(*[F.lit(float(integral(k))) for k in curriculum])
    per = per.withColumn("curve", F.pmod(rank, F.lit(len(curriculum)))).withColumn("weight", F.get(weights, F.col("curve")))
    limit = (most * F.col("source_size")).alias("limit")
    by_level = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    per = per.withColumn("limit", limit).withColumn("place", F.row_number().over(by_level))
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    after = by_level.rowsBetween(W.currentRow, W.unboundedFollowing)
    every = by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
    per = per.withColumn("weights", F.sum("weight").over(after))
    fits = F.col("rest") * F.col("weight") <= F.col("limit") * F.col("weights")
    per = per.withColumn("first", F.min(F.when(fits, F.struct("place", "rest", "weights"))).over(every))
    target = F.when(F.col("place") < F.col("first.place"), F.col("limit").cast("double")).otherwise(
        F.col("first.rest") * F.col("weight") / F.col("first.weights")
    )
    return per.select("source", "source_size", "curve", target.alias("target"))


def words_before(rows: DataFrame, levels: Sequence[int] = LEVELS) -> DataFrame:
    """Adds `before`: the running sum of `words` in its source before each row, in the order of `shuffle`.

    Sums per prefix of the shuffle key split a source of any size over many tasks; a window never
    holds more rows than a prefix has.
    """
    out, bounds = rows, [0, *levels]
    for low, high in zip(bounds, bounds[1:]):
        outer, inner = F.substring("shuffle", 1, low).alias("outer"), F.substring("shuffle", 1, high).alias("inner")
        sums = rows.groupBy("source", outer, inner).agg(F.sum("words").alias("s"))
        running = W.partitionBy("source", "outer").orderBy("inner").rowsBetween(W.unboundedPreceding, -1)
        base = F.coalesce(F.sum("s").over(running), F.lit(0)).alias(f"base{high}")
        sums = sums.select(F.col("source").alias("k"), "inner", base)
        same = F.col("source").eqNullSafe(F.col("k")) & (F.substring("shuffle", 1, high) == F.col("inner"))
        out = out.join(sums, same).drop("k", "inner")
    last = W.partitionBy("source", F.substring("shuffle", 1, levels[-1])).orderBy("shuffle", "doc_id", "text_key")
    own = F.coalesce(F.sum("words").over(last.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = sum((F.col(f"base{n}") for n in levels), F.lit(0))
    return out.withColumn("before", own + bases).drop(*[f"base{n}" for n in levels])


def schedule(docs: DataFrame, curriculum: Sequence[Knots] = CURRICULUM, most: int = MOST_REPEATS, seed: str = "mix") -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, text_key, source, same, size, source_size,
    target and `positions`, the training times (0 to 1) at which the mix takes the row, in order.

    Size is the number of words; a row is taken once more as long as its middle word lies within the
    source's target, so a source's words differ from its target by half a document at most, and no
    row is taken more than `most` times. The order within a source follows from the id alone, so
    reruns agree. A null or empty text has size 0 and is never taken. A null source is a source, a null
    id an id; `same` counts the rows with this id, text and source, which follow each other. An
    empty table gives no rows. Other columns are not read.
    """
    shuffle = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", text_hash().alias("text_key"), size.alias("size"))
    rows = rows.groupBy("doc_id", "text_key", "source").agg(F.count("*").alias("same"), F.max("size").alias("size"))
    rows = staged(rows.withColumn("shuffle", shuffle).withColumn("words", F.col("same") * F.col("size")), "sizes")
    goals = targets(rows.groupBy("source").agg(F.sum("words").alias("size")), curriculum, most)
    goals = staged(goals, "targets").withColumnRenamed("source", "k")
    placed = words_before(rows).join(goals, F.col("source").eqNullSafe(F.col("k"))).drop("k")
    placed = placed.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("same") - 1)))

    def part(turn: Column) -> Column:
        middle = turn * F.col("source_size") + F.col("before") + F.col("nth") * F.col("size") + F.col("size") / 2
        return F.try_divide(middle, F.col("target"))

    def time(turn: Column) -> Column:
        at = part(turn)
        return F.coalesce(*[F.when(F.col("curve") == i, time_at(k, at)) for i, k in enumerate(curriculum)])

    turns = F.filter(F.sequence(F.lit(0), F.lit(most - 1)), lambda turn: (F.col("size") > 0) & (part(turn) < 1))
    placed = placed.withColumn("positions", F.transform(turns, time))
    return placed.select("doc_id", "text_key", "source", "same", "size", "source_size", "target", "positions")


def mixed(docs: DataFrame, curriculum: Sequence[Knots] = CURRICULUM, most: int = MOST_REPEATS, seed: str = "mix") -> DataFrame:
    """The rows of docs, each as often as the mix takes it, range-sorted by training position.

    All columns of docs are kept and none is added; rows never taken are left out. Of rows that repeat
    an id, text and source, the other columns are taken from any one of them.
    """
    plan = schedule(docs, curriculum, most, seed).filter("size(positions) > 0")
    plan = plan.select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"), F.col("source").alias("__source"), "same", F.explode("positions").alias("__position"))
    plan = staged(plan, "plan")
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__text_key") == F.col("__key"))
    rows = docs.withColumn("__text_key", text_hash())
    out = rows.join(plan.filter("same = 1").drop("same"), same)
    repeated = plan.filter("same > 1").drop("same")
    if repeated.limit(1).count():
        keys = repeated.select("__doc", "__key", "__source").distinct()
        once = rows.join(keys, same, "left_semi").dropDuplicates(["doc_id", "__text_key", "source"])
        out = out.unionByName(once.join(repeated, same))
    out = out.repartitionByRange("__position", "doc_id").sortWithinPartitions("__position", "doc_id")
    return out.select(*docs.columns)
