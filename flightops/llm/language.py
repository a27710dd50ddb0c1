"""Language identification by mixtures of languages.

Training counts letter trigrams per language over all labelled rows. A document is then taken as a
mixture: expectation-maximisation estimates which share of its trigrams each language wrote, and the
set of languages is the one with the best likelihood less half the logarithm of the document's
length for each language. The prediction is the language with the largest share, the score that share.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightops.llm.common import map_texts, pieces

UNDETERMINED = "und"
BUCKETS = 1 << 16
MAX_LANGUAGES = 200  # the model is broadcast: this bounds it to 200 * BUCKETS floats
SMOOTHING = 0.5
FIRST_ROUNDS, ROUNDS = 12, 6
MIN_SHARE = 0.02  # languages below it leave the set together, else the smallest leaves alone


@functools.cache
def _letters() -> np.ndarray:
    """1 for each code point that is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucketed trigrams of all texts in one array, and where each text's trigrams end.

    Every letter is the middle of one trigram; what is not a letter counts as one blank. Texts are
    separated by a blank, so no trigram spans two of them.
    """
    lower = [t.lower() for t in texts]
    code = np.frombuffer((" ".join(lower) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    code = np.concatenate([np.zeros(1, "<u4"), code])
    code = np.where(_letters()[code], code, 0).astype(np.uint32)
    middle = np.flatnonzero(code[1:-1]) + 1
    mixed = code[middle - 1] * np.uint32(0x9E3779B1) ^ code[middle] * np.uint32(0x85EBCA77) ^ code[middle + 1] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    ends = np.cumsum([len(t) + 1 for t in lower])
    return (mixed >> np.uint32(16)).astype(np.int64), np.searchsorted(middle, ends, side="right")


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over every row of docs (text, lang) that has both."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch, texts in pieces(batches):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, rows in by_lang.items():
                if lang not in seen and len(seen) >= MAX_LANGUAGES:
                    raise ValueError(f"more than {MAX_LANGUAGES} languages")
                grams, _ = _trigrams(rows)
                seen[lang] = seen.get(lang, 0) + np.bincount(grams, minlength=BUCKETS)
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            columns = [pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])

    known = docs.select("lang", "text").filter("lang is not null and text is not null")
    rows = known.mapInArrow(count, "lang string, bucket int, n long")
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages in order, and per trigram bucket how likely each is against the likeliest."""

    def __init__(self, counts: pd.DataFrame) -> None:
        self.languages = sorted(counts["lang"].unique())
        if len(self.languages) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        n = np.zeros((BUCKETS, len(self.languages)))
        place = {lang: i for i, lang in enumerate(self.languages)}
        n[counts["bucket"], counts["lang"].map(place)] = counts["n"]
        log = np.log(n + SMOOTHING) - np.log(n.sum(axis=0) + SMOOTHING * BUCKETS)
        self.ratio = np.exp(log - log.max(axis=1, keepdims=True, initial=-np.inf)).astype(np.float32)

    def shares(self, grams: np.ndarray) -> np.ndarray:
        """Each language's share of a document's trigrams; 0 outside the chosen set."""
        rows = self.ratio[grams]
        n, k = rows.shape
        chosen = np.arange(k)
        share = np.full(k, 1 / k, np.float32)
        best, best_score = None, -np.inf
        rounds = FIRST_ROUNDS
        while True:
            if len(chosen) > 1:
                for _ in range(rounds):
                    share = share * (rows.T @ (1 / (rows @ share))) / n
            else:
                share = np.ones(1, np.float32)
            score = float(np.log(rows @ share).sum(dtype=np.float64)) - 0.5 * np.log(n) * len(chosen)
            if score > best_score:
                best, best_score = np.zeros(k), score
                best[chosen] = share / share.sum()
            if len(chosen) == 1:
                return best
            keep = share >= MIN_SHARE
            if keep.all() or not keep.any():
                keep = np.arange(len(share)) != share.argmin()
            chosen, share, rows = chosen[keep], share[keep] / share[keep].sum(), np.ascontiguousarray(rows[:, keep])
            rounds = ROUNDS

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        grams, ends = _trigrams([t or "" for t in texts])
        out, at = [], 0
        for end in ends.tolist():
            if end == at or not self.languages:
                out.append((UNDETERMINED, 0.0))
            else:
                share = self.shares(grams[at:end])
                out.append((self.languages[int(share.argmax())], float(min(1.0, share.max()))))
            at = end
        return out


def train(docs: DataFrame) -> Model:
    """Learn from every row of docs (text, lang) with both; no such row gives a model without languages."""
    return Model(trigram_counts(docs).toPandas())  # at most MAX_LANGUAGES * BUCKETS rows


def predict(docs: DataFrame, model: Model, extra: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`extra` columns of docs with the prediction and its score, one row for each row, repeated ones too.

    A text that is null, empty or without letters gets `und` and 0. Equal shares go to the language
    first in code point order. Columns of docs other than text and `extra` are not read; `names` are the
    two new columns' names, for tables that have columns of such a name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(texts: list[str | None]) -> list[list]:
        return list(map(list, zip(*sent.value.predict(texts), strict=True)))

    return map_texts(docs, list(extra), f"`{names[0]}` string, `{names[1]}` double", rows)


def held_out() -> Column:
    """Rows that are not learned from: the id's crc32 leaves 2 when divided by 4 (false for a null id)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
