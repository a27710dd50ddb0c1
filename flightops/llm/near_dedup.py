"""Near-duplicate groups: banded MinHash candidates, sequential Bayesian pruning, exact verification.

1. Every text becomes its set of word shingles (64-bit hashes) and a MinHash signature. Documents with
   the same set are linked without comparison; the smallest id of such a group, its node, stands for it.
2. Nodes that agree in a whole band share a bucket. In a bucket every node is compared with the two
   nodes of smallest and largest id only; after the links found are joined to components, nodes of one
   bucket that still lie in different components are compared as well. Pairs inside a component
   need no comparison, so a bucket of thousands of near copies gives thousands of pairs, not millions,
   and no candidate between different components is left out.
3. A pair is met only if the sizes of its sets and the parities of their shingles' bins allow the
   similarity, which is exact. Then its signatures are compared in batches. With m of n hashes equal and a uniform prior, the
   similarity is Beta(m + 1, n - m + 1) distributed; the pair is dropped once the probability that it
   reaches the threshold is below `miss`. The pairs left are verified on their full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightops.llm.common import map_texts, small, staged, text_hash
from flightops.llm.components import components

BANDS, ROWS = 40, 6  # a pair at 0.8 shares no band with a probability of 5e-6
BATCH = 48  # hashes compared at a time
MISS = 1e-6
MAX_WORDS = 100_000  # entries, some 12 MB, kept in a worker's word table before it starts afresh
BITS = tuple(f"bits{i}" for i in range(16))
BROADCAST_ROWS = 4_000_000  # ids, 16 bytes each

_rng = np.random.default_rng(20_240_101)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()


def shingle_set(text: str, size: int) -> np.ndarray:
    """Hashes of the different runs of `size` words; of all words if there are fewer, of none if none.

    Words are what ASCII white space separates, with A-Z lower-cased.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    one = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    mixed = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        mixed = (mixed ^ one[i : n - size + 1 + i]) * _STEP
        mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed)


def signature(shingles: np.ndarray) -> bytes:
    """16 bits of each minimum; two sets agree in a place with about the probability of their similarity."""
    low = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 256):
        np.minimum(low, (_FACTORS[:, None] * shingles[at : at + 256]).min(axis=1), out=low)
    return (low * _STEP >> np.uint64(48)).astype("<u2").tobytes()


def parities(shingles: np.ndarray) -> list[int]:
    """For each of 1,024 bins, whether an odd number of shingles falls into it, as 16 longs."""
    bins = np.bincount((shingles & np.uint64(64 * len(BITS) - 1)).astype(np.int64), minlength=64 * len(BITS))
    return np.frombuffer(np.packbits((bins & 1).astype(np.uint8)).tobytes(), "<i8").tolist()


def least_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest matches out of n with which the similarity reaches the threshold with probability `miss`."""
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key, n (size of the set), digest of the set, signature and one bit of each of its
    places in four longs; all but n are null for an empty set."""

    def sign(texts: list[str | None]) -> list[list]:
        sets = [shingle_set(t or "", size) for t in texts]
        digests = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        signs = [signature(s) if len(s) else None for s in sets]
        bits = [parities(s) if len(s) else [None] * len(BITS) for s in sets]
        return [[len(s) for s in sets], digests, signs, *map(list, zip(*bits, strict=True))]

    rows = docs.select("doc_id", "text", text_hash().alias("text_key"))
    fields = "n long, digest binary, sig binary, " + ", ".join(f"{b} long" for b in BITS)
    return map_texts(rows, ["doc_id", "text_key"], fields, sign)


def sets_of(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the documents whose id is in `nodes`."""
    wanted = docs.select(F.col("doc_id").alias("node"), "text").join(small(nodes, BROADCAST_ROWS), "node", "left_semi")

    def collect(texts: list[str | None]) -> list[list]:
        return [[shingle_set(t or "", size).view(np.int64) for t in texts]]

    return map_texts(wanted, ["node"], "shingles array<long>", collect).filter("size(shingles) > 0")


def may_reach(one: str, two: str, percent: int) -> Column:
    """Whether the sizes and parities of two sets allow the similarity.

    Bins whose parities differ hold at least one shingle that only one set has, so the sets share at most
    half of what their sizes leave after these.
    """
    a, b = F.col(f"{one}n"), F.col(f"{two}n")
    differ = sum((F.bit_count(F.col(one + c).bitwiseXOR(F.col(two + c))) for c in BITS), F.lit(0))
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((a + b - differ) * (100 + percent) >= 2 * percent * (a + b))


def likely(pairs: DataFrame, live: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) whose signatures leave a chance above `miss` of reaching the threshold."""
    ends = [n for n in range(BATCH, BANDS * ROWS + 1, BATCH)]
    least = [least_matches(n, threshold, miss) for n in ends]

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            one, two = (np.frombuffer(b"".join(frame[c]), "<u2").reshape(len(frame), -1) for c in ("sig_a", "sig_b"))
            alive, matches = np.arange(len(frame)), np.zeros(len(frame), int)
            for end, fewest in zip(ends, least, strict=True):
                part = slice(end - BATCH, end)
                matches[alive] += (one[alive, part] == two[alive, part]).sum(axis=1)
                alive = alive[matches[alive] >= fewest]
            yield frame.iloc[alive][["a", "b"]]

    sig = live.select("node", "sig")
    rows = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")
    return rows.select("a", "b", "sig_a", "sig_b").mapInPandas(compare, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets reach the similarity: 100 * intersection >= percent * union."""
    rows = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    union = F.size("set_a") + F.size("set_b") - common
    return rows.filter(100 * common >= percent * union).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, text_key, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links; rows that repeat an id are one document
    with several texts. A text that is null or has no words has an empty set and is linked with nothing.
    A row whose doc_id is null has the component of its equals, or null if none has an id; it is kept
    only in the latter case. Other columns are not read; an empty table gives no rows.
    """
    signed = staged(signatures(docs, size), "signatures")
    some = signed.filter("n > 0 and doc_id is not null")
    reps = staged(some.groupBy("digest").agg(F.min("doc_id").alias("node")), "sets")
    first = reps.toDF("digest", "doc_id")
    nodes = staged(
        some.join(first, ["digest", "doc_id"]).dropDuplicates(["digest", "doc_id"]).select(F.col("doc_id").alias("node"), "n", "sig", *BITS),
        "nodes",
    )

    # Buckets with at least two nodes.
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    key = F.xxhash64("band", F.substring("sig", F.col("band") * F.lit(2 * ROWS) + 1, F.lit(2 * ROWS)))
    banded = nodes.select("node", "n", "sig", band).select(key.alias("bucket"), "node", "n")
    ends = banded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = staged(banded.join(ends.filter("low < high"), "bucket"), "buckets")
    in_bucket = shared.select("node").distinct()
    live = staged(nodes.join(in_bucket, "node", "left_semi"), "live")
    sets = staged(sets_of(docs, live.select("node").distinct(), size), "shingles")

    def named(rows: DataFrame, side: str) -> DataFrame:
        """Columns of one side of a pair, with its name before them."""
        return rows.select(*[F.col(c).alias(c if c == "bucket" else side + c) for c in rows.columns])

    def links(pairs: DataFrame, name: str) -> DataFrame:
        candidates = staged(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
        left = staged(likely(candidates, live, percent / 100, miss), f"{name}-likely")
        return staged(verified(left, sets, percent), f"{name}-links")

    # Each node of a bucket with the two at its ends.
    sketch = live.select("node", "n", *BITS)
    stars = shared.select("node", "n", F.explode(F.array("low", "high")).alias("other")).filter("node <> other").distinct()
    stars = named(stars.join(sketch, ["node", "n"]), "a_").withColumnRenamed("a_other", "b_node")
    stars = stars.join(named(sketch, "b_"), "b_node").filter(may_reach("a_", "b_", percent))
    found = links(stars.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")), "stars")
    # An id with several texts joins their groups.
    members = some.select("doc_id", "digest").distinct().join(reps, "digest")
    several = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    several = several.filter("a < b").select("doc_id").join(members, "doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    labels = components(found.union(several))

    # What is still in different components of a bucket; the ends are done.
    rest = shared.filter("node <> low and node <> high").join(labels, "node", "left")
    rest = rest.select("bucket", "node", "n", F.coalesce("label", "node").alias("label"))
    mixed = rest.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l < h").select("bucket")
    rest = staged(rest.join(mixed, "bucket", "left_semi"), "rest")
    counts = rest.groupBy("bucket", "label").agg(F.count("*").alias("c"))
    main = counts.groupBy("bucket").agg(F.max_by("label", "c").alias("main"))
    rest = staged(rest.join(main, "bucket").join(sketch, ["node", "n"]), "rest-main")
    one, two = named(rest.filter("label <> main"), "a_"), named(rest.drop("main"), "b_")
    apart = F.expr("a_label <> b_label and (b_label = a_main or a_node < b_node)")
    cross = one.join(two, "bucket").filter(apart & may_reach("a_", "b_", percent))
    more = links(cross.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")), "rest-pairs")
    labels = components(found.union(several).union(more)) if more.limit(1).count() else labels

    component = F.coalesce("label", "node")
    by_set = reps.join(labels, "node", "left").select("digest", component.alias("component"))
    out = signed.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "digest").join(by_set, "digest", "left")
    out = out.select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
