"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

The windows of an item are its runs of ten words (all its words, if fewer). A document contains a
window only if it contains every shingle of it, so the window's rarest shingle is a sufficient prefix:

1. shingles of the benchmark's windows are ordered by how often the documents use them;
2. each window is represented by its rarest shingle; one that no document uses rules its windows out;
3. document shingles are joined with these; the shingle's offset gives the place the window would
   have, which must lie inside the document (length and positional bounds);
4. the words at that place are compared with the window's.

The benchmark's side is broadcast after its rows are counted; beyond the limit it is joined by a shuffle
that moves shingle hashes only, and texts meet their candidates in a second join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flightops.llm.common import small, staged, text_hash

WINDOW = 10
SHINGLE = 5
BROADCAST_ROWS = 200_000  # rows with one window's text each, about 150 bytes
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["doc_id", "text_key"]


def words(text: str = "text") -> Column:
    """Runs of a-z, 0-9 and non-ASCII characters after A-Z are lower-cased; none for null."""
    split = F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), BETWEEN)
    return F.array_remove(split, "")


def windows(items: DataFrame, length: int = WINDOW) -> DataFrame:
    """(item_id, window, len): each distinct run of `length` words, or all words of a shorter item."""
    rows = items.select("item_id", words().alias("words")).withColumn("n", F.size("words")).filter("n > 0")
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - length, F.lit(0))))
    rows = rows.select("item_id", "words", start.alias("start"), F.least("n", F.lit(length)).alias("len"))
    text = F.array_join(F.slice("words", F.col("start") + 1, F.col("len")), " ")
    return rows.select("item_id", text.alias("window"), "len").distinct()


def _shingle(at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get("words", at + i) for i in range(size)])


def _document_shingles(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """A row for every place and shingle size of every document, with the document's words at hand."""
    rows = docs.select("doc_id", text_hash().alias("text_key"), words().alias("words")).withColumn("n", F.size("words"))
    low = min(sizes)
    places = F.when(F.col("n") >= low, F.sequence(F.lit(0), F.col("n") - low))
    rows = rows.select(*KEY, "words", "n", F.explode(places).alias("at"))
    if len(sizes) == 1:
        return rows.withColumn("h", _shingle(F.col("at"), low))
    fits = [F.when(F.col("at") + s <= F.col("n"), _shingle(F.col("at"), s)) for s in sizes]
    return rows.withColumn("h", F.explode(F.array(*fits))).filter("h is not null")


def _there() -> Column:
    return F.array_join(F.slice("words", F.col("start") + 1, F.col("len")), " ") == F.col("window")


def occurrences(docs: DataFrame, runs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, text_key, start, len, window) for every place where a document contains a window."""
    runs = runs.select("window", "len").distinct()
    sizes = sorted(r[0] for r in runs.select(F.least("len", F.lit(SHINGLE))).distinct().collect())  # 1 to SHINGLE
    if not sizes:
        return docs.select("doc_id", text_hash().alias("text_key")).limit(0).selectExpr("*", "0 AS start", "0 AS len", "'' AS window")
    parts = runs.withColumn("words", F.split("window", " "))
    parts = parts.withColumn("off", F.explode(F.sequence(F.lit(0), F.greatest(F.col("len") - SHINGLE, F.lit(0)))))
    h = F.coalesce(*[F.when(F.least("len", F.lit(SHINGLE)) == s, _shingle(F.col("off"), s)) for s in sizes])
    parts = staged(parts.select("window", "len", "off", h.alias("h")), "windows")

    found = _document_shingles(docs, sizes)
    uses = found.select("h").join(small(parts.select("h").distinct(), 5 * broadcast_rows), "h")
    uses = staged(uses.groupBy("h").agg(F.count("*").alias("uses")), "uses")
    ranked = parts.join(uses, "h", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    rank = F.row_number().over(W.partitionBy("window").orderBy("uses", "h", "off"))
    prefix = ranked.withColumn("rank", rank).filter("rank = 1 and uses > 0").select("h", "window", "len", "off")
    prefix = staged(prefix, "prefix")

    start = (F.col("at") - F.col("off")).alias("start")
    inside = "start >= 0 and start + len <= n"
    if prefix.count() <= broadcast_rows:
        near = found.join(F.broadcast(prefix), "h").select(*KEY, "words", "n", start, "len", "window")
        return near.filter(inside).filter(_there()).select(*KEY, "start", "len", "window")
    near = found.select(*KEY, "n", "at", "h").join(prefix, "h").select(*KEY, "n", start, "len", "window")
    near = near.filter(inside).drop("n").distinct()
    texts = docs.select(F.col("doc_id").alias("d"), text_hash().alias("t"), words().alias("words")).dropDuplicates(["d", "t"])
    both = near.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")))
    return both.filter(_there()).select(*KEY, "start", "len", "window")


def contamination(docs: DataFrame, items: DataFrame, length: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts the words inside any occurrence of a window of items (item_id, text), n_items the
    different items with one. A null or empty text has no words; rows that repeat an id are judged
    each by its own text. Items without words have no windows; those without an id hit words but are
    not counted in n_items. Empty tables give no rows or no hits. Other columns are not read.
    """
    runs = staged(windows(items, length), "runs")
    hits = staged(occurrences(docs, runs, broadcast_rows), "hits")

    spans = hits.groupBy(*KEY, "start").agg(F.max("len").alias("len"))
    before = W.partitionBy(*KEY).orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.col("start") + F.col("len")).over(before), F.lit(0))
    new = F.greatest(F.lit(0), F.col("start") + F.col("len") - F.greatest("start", reach))
    covered = spans.withColumn("new", new).groupBy(*KEY).agg(F.sum("new").alias("n_hit"))

    pairs = hits.select(*KEY, "window").distinct().join(small(runs.select("item_id", "window"), broadcast_rows), "window")
    pairs = pairs.filter("item_id is not null").select(*KEY, F.col("item_id").cast("string").alias("item")).distinct()
    names = F.array_join(F.sort_array(F.collect_list("item")), ",")
    listed = pairs.groupBy(*KEY).agg(F.count("*").alias("n_items"), names.alias("names"))

    result = docs.select("doc_id", text_hash().alias("text_key"), F.size(words()).cast("long").alias("n_words"))
    for part in (covered, listed):
        part = part.withColumnRenamed("doc_id", "d").withColumnRenamed("text_key", "t")
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t"))
        result = result.join(part, same, "left").drop("d", "t")
    return result.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
