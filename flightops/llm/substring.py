"""Repeated passages by content-defined chunking.

A gear hash of the last 16 bytes rolls over a text; a chunk ends where the hash is smaller than at the
16 places before and after. A cut depends on the bytes near it only, so an insertion moves the cuts near
it and no others, and a passage that stands in two documents is cut in the same places in both, wherever
it begins. Unlike cuts where some bits are zero, chunks are seldom much longer than their mean, 33
bytes, so that every passage of fifty words has several whole ones. Chunks are compared by
their 96-bit digest over all documents (among 3e12 chunks the odds of one false repeat are 1 to 16,000): of equal chunks the one in the document with the smallest id, and there
the first one, is the original. Neighbouring repeated chunks make up a passage.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flightops.llm.common import map_texts, small, staged, text_hash
from flightops.operators.skew import behind_own_exchange

WINDOW = 16  # bytes in the hash
RADIUS = 16  # places on either side with larger hashes; a power of two
MOST_BYTES = 2048  # of a chunk; longer ones are cut at multiples of it
LEAST_CHARS = 64  # of repeated chunks in a row that count as a passage
BROADCAST_ROWS = 1_000_000
DIGEST_BYTES = 12

_GEAR = np.random.default_rng(20_240_110).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the chunks of a UTF-8 text end, in bytes and in characters; never inside a character."""
    code = np.frombuffer(raw, np.uint8)
    n = len(code)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rolled, reach = _GEAR[code], 1
    while reach < WINDOW:  # sums over twice as many bytes in each step
        longer = rolled.copy()
        longer[reach:] += rolled[:-reach] << np.uint32(reach)
        rolled, reach = longer, 2 * reach
    edge = np.full(RADIUS, np.iinfo(np.uint32).max, np.uint32)
    least, reach = np.concatenate([edge, rolled, edge]), 1
    while reach < RADIUS:  # minima over twice as many places in each step
        least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
    ends = np.flatnonzero((rolled < least[:n]) & (rolled < least[RADIUS + 1 :])) + 1
    ends = np.append(ends[ends < n], n)
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > MOST_BYTES:
        more = [np.arange(end - gap + MOST_BYTES, end, MOST_BYTES) for end, gap in zip(ends, gaps, strict=True) if gap > MOST_BYTES]
        ends = np.unique(np.concatenate([ends, *more]))
    starts = np.append(np.flatnonzero((code & 0xC0) != 0x80), n)  # of characters
    place = np.unique(np.searchsorted(starts, ends))
    return starts[place], place


def _chunks(texts: list[str | None]) -> list[list]:
    digests, ends, again = [], [], []
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        at, chars = cuts(raw)
        bounds = [0, *at.tolist()]
        digest = [xxhash.xxh3_128_digest(raw[a:b])[:DIGEST_BYTES] for a, b in zip(bounds, bounds[1:])]
        first = np.zeros(len(digest), bool)
        first[list({d: i for i, d in reversed(list(enumerate(digest)))}.values())] = True
        digests.append(digest)
        ends.append(chars.astype(np.int32))
        again.append(~first)
    return [digests, ends, again]


def repeated_passages(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """One row per passage of docs (doc_id, text) that repeats an earlier one:

    doc_id, text_key, start, end (characters, end exclusive), n_chunks, first_doc_id. The last is the
    document that most of its chunks have their original in, the smallest id of several; it is the
    row's own id if the passage repeats itself inside the document. Runs of fewer than `least_chars` characters do
    not count; chunks end at MOST_BYTES bytes at the latest. Rows that share an id are one document and no copies
    of each other; rows without an id copy all others. Texts are read whole, of any length. Null and empty texts have no passages; an empty table gives no rows.
    Other columns are not read.
    """
    rows = docs.select("doc_id", "text", text_hash().alias("text_key"))
    fields = "digests array<binary>, ends array<int>, again array<boolean>"
    cut = map_texts(rows, ["doc_id", "text_key"], fields, _chunks).withColumn("row", F.monotonically_increasing_id())
    cut = staged(cut.filter("size(digests) > 0"), "chunks")

    chunks = cut.select("row", "doc_id", F.posexplode(F.arrays_zip("digests", "again")).alias("at", "chunk"))
    chunks = chunks.select("row", "doc_id", "at", F.col("chunk.digests").alias("digest"), F.col("chunk.again").alias("again"))
    owners = chunks.filter("not again").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    owners = owners.filter("first < last or (first is not null and n > 1)").select("digest", "first")
    owners = behind_own_exchange(owners, "digest")  # so that a chunk that many documents share can be split
    met = chunks.join(owners, "digest", "left").filter("again or (first is not null and (doc_id is null or doc_id > first))")
    met = staged(met.select("row", "at", F.coalesce("first", "doc_id").alias("first")), "repeated")

    island = F.col("at") - F.row_number().over(W.partitionBy("row").orderBy("at"))
    runs = met.withColumn("island", island).groupBy("row", "island")
    runs = runs.agg(F.min("at").alias("low"), F.max("at").alias("high"), F.mode("first", True).alias("first_doc_id"))
    found = cut.select("row", "doc_id", "text_key", "ends").join(runs, "row")
    start = F.when(F.col("low") > 0, F.get("ends", F.col("low") - 1)).otherwise(0)
    spans = found.select(
        "doc_id", "text_key", start.alias("start"), F.get("ends", "high").alias("end"), (F.col("high") - F.col("low") + 1).alias("n_chunks"), "first_doc_id"
    )
    return spans.filter(F.col("end") - F.col("start") >= least_chars)


def without_passages(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs, all columns kept, with the spans (doc_id, text_key, start, end) cut out of their texts.

    The spans of a text do not overlap. A text whose every character is cut out becomes empty.
    """
    cut = F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cuts")
    cut = spans.groupBy(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key")).agg(cut)
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (text_hash() == F.col("__key"))
    rows = docs.join(small(staged(cut, "cuts"), BROADCAST_ROWS), same, "left")
    kept_from = F.concat(F.array(F.lit(0)), F.transform("__cuts", lambda c: c.end))
    kept_to = F.concat(F.transform("__cuts", lambda c: c.start), F.array(F.length("text")))
    kept = F.zip_with(kept_from, kept_to, lambda a, b: F.substring("text", a + 1, b - a))
    text = F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(F.array_join(kept, ""))
    return rows.withColumn("text", text).select(*docs.columns)
