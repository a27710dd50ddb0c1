"""Importance resampling towards a target distribution over hashed n-grams.

A text's bytes are translated by a 256-byte table that lower-cases A-Z and blanks all other ASCII
characters but digits and letters, so that `bytes.split` yields its words; bytes of other characters
stay as they are. The checksum of a word, continued over a blank and the next word, is that of the
two joined by the blank: each n-gram costs one call more than the n-gram before it. Every task reduces its
features to a Counter of buckets; only those are shuffled.

A bucket's gain is the scaled log ratio of its smoothed shares in target and corpus, a document's weight
the sum of the gains of its features. Gumbel noise, fixed by the document's id, turns the highest scores
into a sample without replacement with probabilities in proportion to the weights.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightops.llm.common import pieces, staged
from flightops.llm.ranking import ranked

BUCKETS = 10_000
SCALE = 1000
MOST_WORDS = 3  # of a feature
CHUNK = 1 << 20  # bytes of a text that are split at a time

_kept = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
TABLE = bytes(c if c in _kept else 0x20 for c in bytes(range(256)).lower())


def _spans(blanked: bytes) -> Iterator[bytes]:
    """A translated text in pieces of about CHUNK bytes that end at a blank."""
    at = 0
    while len(blanked) - at > CHUNK:
        end = blanked.find(b" ", at + CHUNK)
        if end < 0:
            break
        yield blanked[at:end]
        at = end
    yield blanked[at:] if at else blanked


def hashed_features(text: str | None) -> Iterator[tuple[int, np.ndarray]]:
    """For each piece of a text, its number of words and the checksums of the n-grams that end in it."""
    before: list[bytes] = []  # the last words of the piece before, each with a blank in front
    for span in _spans((text or "").encode("utf-8", "surrogatepass").translate(TABLE)):
        own = span.split()
        spaced = before + [b" " + w for w in own]
        old = len(before)
        ones = list(map(crc32, [w[1:] for w in before] + own))
        twos = list(map(crc32, spaced[1:], ones))
        threes = list(map(crc32, spaced[2:], twos))
        new = ones[old:] + twos[max(old - 1, 0) :] + threes[max(old - 2, 0) :]
        yield len(own), np.array(new, np.uint32)
        before = spaced[-(MOST_WORDS - 1) :]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all `texts` (column `text`) fall into each bucket.

    Null and empty texts have no features; repeated rows count again; other columns are not read.
    An empty table gives no rows. A text of any length is split a piece at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        for _, part in pieces(batches):
            for text in part:
                for _, sums in hashed_features(text):
                    at, n = np.unique(sums % buckets, return_counts=True)
                    found.update(dict(zip(at.tolist(), n.tolist(), strict=True)))
        columns = [pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "n"])

    counted = texts.select("text").mapInArrow(count, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Each bucket's gain; the two tables of `buckets` rows at most are what comes to the driver."""
    own, wanted = ({r.bucket: r.n for r in counts.collect()} for counts in (corpus, target))
    s_all, t_all = sum(own.values()) + buckets, sum(wanted.values()) + buckets

    def gain(b: int) -> int:
        return math.floor(SCALE * math.log(float(wanted.get(b, 0) + 1) * s_all / (float(own.get(b, 0) + 1) * t_all)))

    return [gain(b) for b in range(buckets)]


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise of an id, a null one reading as empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return math.floor(-SCALE * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], seed: int = 42) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of docs (doc_id, text).

    Null and empty texts have no words and the weight 0. Rows that repeat an id have the same noise.
    """
    table = np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            words, features, weights = [], [], []
            for text in texts:
                n_words = n_features = weight = 0
                for n, sums in hashed_features(text):
                    n_words += n
                    n_features += len(sums)
                    weight += int(table[sums % len(table)].sum())
                words.append(n_words)
                features.append(n_features)
                weights.append(weight)
            ids = part.column("doc_id")
            score = [w + noise(i, seed) for w, i in zip(weights, ids.to_pylist(), strict=True)]
            new = [pa.array(values, pa.int64()) for values in (words, features, weights, score)]
            yield pa.RecordBatch.from_arrays([ids, *new], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long, score long"
    )


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = BUCKETS, seed: int = 42
) -> DataFrame:
    """Every row of docs with its weight, score and, if it is drawn, its rank from 1.

    Of the N rows with at least `least_words` words the floor(percent * N / 100) with the highest scores are
    drawn, ties going to the smaller doc_id, a null id last; rows that repeat an id are rows of their own and equal
    ones stand in any order. An empty `docs` gives no rows, an empty `target` a uniform one.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets), buckets)
    rows = staged(scored(docs, gain, seed), "scored")
    eligible = F.col("n_words") >= least_words
    n = rows.filter(eligible).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    placed = ranked(rows.filter(eligible), order, "place")
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = placed.select(*columns, F.when(F.col("place") < n, F.col("place") + 1).alias("rank"))
    return drawn.unionByName(rows.filter(~eligible).select(*columns, F.lit(None).cast("long").alias("rank")))
