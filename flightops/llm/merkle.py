"""A Merkle manifest of a dataset: per source a tree of its rows, above them a tree of the sources.

Every node's digest is the SHA-256 of the lower-case hex digests of its children, joined. A tree's leaves
stand in order; while several nodes remain, every FANOUT consecutive ones become one node (the last run
may be shorter, even one).

The trees are kept as append logs in postorder. A builder takes an aligned block of FANOUT ** BLOCK_LEVELS
leaves of one tree and writes a node as soon as its last child is there, so the order of completion is the
postorder. A node's place in the log follows in closed form from the sizes of the full subtrees before it, and so
do those of its siblings: a proof is read from the log without links or searches. The roots of a tree's
blocks are the leaves of the next tier, whose blocks are built the same way, until one node remains; a
tier has 1 / 256 of the nodes of the one below. No task holds more than a block, and no block waits for another.

Proofs are handed down the tiers: a block of tree roots gives each of them its siblings and places, a block
below adds its own, and the blocks of rows end with the whole path. Only digests are shuffled, never texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightops.llm.common import staged
from flightops.llm.ranking import ROW_BITS, in_order, light, ranked, runs

FANOUT = 16
BLOCK_LEVELS = 2
BLOCK = FANOUT**BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# A block of a tier: `nodes` are its digests in postorder, 32 bytes each; `width` its leaves, `size` those of its tree.
SEGMENTS = "tree long, block long, size long, width int, nodes binary, root binary"
ROWS = ", doc_ids array<long>, claims array<binary>"
PATHS = "tree long, place long, subroot binary, places array<int>, siblings array<binary>"
PROOFS = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"


def levels(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    found = 0
    while n > 1:
        n, found = -(-n // FANOUT), found + 1
    return found


def position(level: int, index: int, width: int, top: int) -> int:
    """Place in the postorder of the node number `index` of `level`, in a tree of `width` leaves and `top` levels.

    Up to the node's last leaf all leaves are written, of its own and lower levels every node begun, and of the
    higher ones those that were complete one leaf before.
    """
    end = min((index + 1) * FANOUT**level, width)
    begun = sum(-(-end // FANOUT**k) for k in range(1, level + 1))
    complete = sum((end - 1) // FANOUT**k for k in range(level + 1, top + 1))
    return end + begun + complete - 1


def parent(children: list[bytes]) -> bytes:
    return sha256(b"".join(children).hex().encode()).digest()


def append_log(leaves: list[bytes], top: int) -> list[bytes]:
    """The digests of a block's tree of `top` levels in the order of their completion."""
    log: list[bytes] = []
    waiting: list[list[bytes]] = [[] for _ in range(top + 1)]

    def put(level: int, digest: bytes) -> None:
        log.append(digest)
        waiting[level].append(digest)
        if level < top and len(waiting[level]) == FANOUT:
            close(level)

    def close(level: int) -> None:
        children, waiting[level] = waiting[level], []
        put(level + 1, parent(children))

    for digest in leaves:
        put(0, digest)
    for level in range(top):
        if waiting[level]:
            close(level)
    return log


def siblings_of(nodes: bytes, level: int, index: int, width: int, top: int) -> tuple[int, bytes]:
    """The node's place in its run and the digests of the run's others, read from the log at their positions."""
    first = index - index % FANOUT
    last = min(first + FANOUT, -(-width // FANOUT**level))
    others = [32 * position(level, i, width, top) for i in range(first, last) if i != index]
    return index - first, b"".join(nodes[at : at + 32] for at in others)


def fold(own: bytes, place: int, siblings: bytes) -> bytes:
    """The digest above `own`, given the digests of its siblings."""
    return sha256((siblings[: 32 * place] + own + siblings[32 * place :]).hex().encode()).digest()


# --- leaves ---------------------------------------------------------------------------------


def _item(column: Column) -> Column:
    value = column.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(text: Column | None = None) -> Column:
    """A row's digest: its fields, each as a byte count, a colon and the value, or a dash for null."""
    columns = [F.col(f) for f in FIELDS[:-1]] + [F.col("text") if text is None else text]
    return F.unhex(F.sha2(F.concat(*[_item(c) for c in columns]), 256))


# --- building -------------------------------------------------------------------------------


def _build(group: pa.Table) -> pa.Table:
    """One builder: the rows of a block in order, written as a log."""
    group = group.sort_by("rank")
    leaves = group.column("digest").to_pylist()
    size = group.column("size")[0].as_py()
    log = append_log(leaves, min(BLOCK_LEVELS, levels(size)))
    columns = {
        "tree": group.column("tree")[:1],
        "block": group.column("block")[:1],
        "size": group.column("size")[:1],
        "width": pa.array([len(leaves)], pa.int32()),
        "nodes": pa.array([b"".join(log)], pa.binary()),
        "root": pa.array([log[-1]], pa.binary()),
    }
    if "doc_id" in group.column_names:
        columns["doc_ids"] = pa.array([group.column("doc_id").to_pylist()], pa.list_(pa.int64()))
        columns["claims"] = pa.array([group.column("claim").to_pylist()], pa.list_(pa.binary()))
    return pa.table(columns)


def _grow(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The tiers of the trees in `nodes` (tree, rank, digest, size), of which the largest has `most` leaves."""
    tiers: list[DataFrame] = []
    while True:
        schema = SEGMENTS + (ROWS if not tiers else "") * ("doc_id" in nodes.columns)
        blocks = nodes.withColumn("block", F.floor(F.col("rank") / BLOCK).cast("long"))
        tiers.append(staged(blocks.groupBy("tree", "block").applyInArrow(_build, schema), "segments"))
        if most <= BLOCK:
            return tiers
        most = -(-most // BLOCK)
        higher = F.ceil(F.col("size") / BLOCK).cast("long").alias("size")
        nodes = tiers[-1].select("tree", F.col("block").alias("rank"), F.col("root").alias("digest"), higher)


class Manifest(NamedTuple):
    """`tiers` are the logs of the sources' trees from the rows upwards, `tops` those of the tree above them."""

    sources: DataFrame  # source, tree, size
    tiers: list[DataFrame]
    tops: list[DataFrame]
    root: bytes | None


def build(docs: DataFrame, claim: Column | None = None) -> Manifest:
    """The manifest of docs (doc_id, source, lang, n_chars, text).

    Rows of a source stand by doc_id, nulls first, rows that repeat an id by their digest; a null source comes first
    among the sources. Nulls and empty texts are told apart; other columns are not read. `claim` is an expression
    for the digest that a row is to be verified with (null: its own). An empty table has no root.
    """
    own = docs.select("source", "doc_id", leaf().alias("digest"), (F.lit(None).cast("binary") if claim is None else claim).alias("claim"))
    placed = in_order(staged(own, "leaves"), ["source", "doc_id", "digest"])
    spread = staged(runs(placed, ["source"]), "runs")
    sizes = staged(spread.groupBy("source").agg(F.sum("__n").alias("size")), "sizes")
    sources = staged(ranked(sizes, ["source"], "tree"), "sources")
    facts = sources.agg(F.max("size").alias("most"), F.count(F.lit(1)).alias("trees")).first()
    if not facts.trees:
        return Manifest(sources, [], [], None)

    same = F.col("source").eqNullSafe(F.col("__source"))
    trees = sources.select(F.col("source").alias("__source"), "tree", "size")
    starts = spread.join(light(trees, "__source"), same).select("__source", "__part", "__first", "__before", "tree", "size")
    starts = light(staged(starts, "starts"), "__source")
    rows = placed.withColumn("__own", F.shiftright("__at", ROW_BITS)).join(starts, same & (F.col("__own") == F.col("__part")))
    rank = (F.col("__at") - F.col("__first") + F.col("__before")).alias("rank")
    tiers = _grow(rows.select("tree", rank, "digest", "size", "doc_id", "claim"), facts.most)
    roots = tiers[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.col("root").alias("digest"))
    tops = _grow(roots.withColumn("size", F.lit(facts.trees).cast("long")), facts.trees)
    return Manifest(sources, tiers, tops, bytes(tops[-1].first().root))


# --- proofs ---------------------------------------------------------------------------------


def _with_paths(tier: DataFrame, above: DataFrame) -> DataFrame:
    paths = above.select("tree", F.col("place").alias("block"), "subroot", "places", "siblings")
    return tier.join(paths, ["tree", "block"])


def _hand_down(tier: DataFrame, above: DataFrame) -> DataFrame:
    """The paths (PATHS) of the leaves of a tier, given those of its blocks' roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nodes, width, top = row["nodes"], row["width"], min(BLOCK_LEVELS, levels(row["size"]))
                out = []
                for i in range(width):
                    own = [siblings_of(nodes, level, i // FANOUT**level, width, top) for level in range(top)]
                    places, siblings = ([x[k] for x in own] for k in (0, 1))
                    out.append((row["tree"], row["block"] * BLOCK + i, row["subroot"], places + row["places"], siblings + row["siblings"]))
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary()))
                columns = [pa.array(values, kind) for values, kind in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "place", "subroot", "places", "siblings"])

    return _with_paths(tier, above).mapInArrow(run, PATHS)


def _paths_of_blocks(manifest: Manifest) -> DataFrame:
    """The paths from the roots of the blocks of rows to the root of all."""
    nothing = [F.lit(None).cast("binary").alias("subroot"), F.array().cast("array<int>").alias("places"), F.array().cast("array<binary>").alias("siblings")]
    above = manifest.tops[-1].select("tree", F.col("block").alias("place"), *nothing)
    for tier in reversed(manifest.tops):
        above = _hand_down(tier, above)
    # A leaf of the tree above is the one root block of a source's tree, whose root is the subroot.
    above = above.select(F.col("place").alias("tree"), F.lit(0).cast("long").alias("place"), "places", "siblings")
    above = above.join(manifest.tiers[-1].select("tree", F.col("root").alias("subroot")), "tree").select("tree", "place", "subroot", "places", "siblings")
    for tier in reversed(manifest.tiers[1:]):
        above = _hand_down(tier, staged(above, "paths"))
    return staged(above, "paths")


def proofs(manifest: Manifest, with_siblings: bool = False) -> DataFrame:
    """One row per row of the manifest: doc_id, leaf, subroot, proof_sha256, folded_root, digests in hex.

    The proof is the list of siblings from the leaf to the root, level by level and left to right (`siblings`, if
    wanted, one string for each level); folded_root is what it makes of the row's claim, or of its own leaf without one.
    """
    schema = PROOFS + ", places array<int>, siblings array<string>" * with_siblings
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nodes, width, top = row["nodes"], row["width"], min(BLOCK_LEVELS, levels(row["size"]))
                subroot = row["subroot"].hex()
                out = []
                for first in range(0, width, FANOUT):
                    # Above the first level the path is that of the whole run.
                    higher = [siblings_of(nodes, level, first // FANOUT**level, width, top) for level in range(1, top)]
                    higher += zip(row["places"], row["siblings"], strict=True)
                    tail = [(64 * place, found.hex().encode()) for place, found in higher]
                    joined = b"".join(found for _, found in tail)
                    for i in range(first, min(first + FANOUT, width)):
                        at = 32 * position(0, i, width, top)
                        digest = nodes[at : at + 32].hex()
                        place, found = siblings_of(nodes, 0, i, width, top) if top else (0, b"")
                        path = [(64 * place, found.hex().encode()), *tail] if top else tail
                        claim = row["claims"][i]
                        node = digest.encode() if claim is None else claim.hex().encode()
                        for cut, others in path:
                            node = sha256(others[:cut] + node + others[cut:]).hexdigest().encode()
                        proof = sha256(path[0][1] + joined if top else joined).hexdigest()
                        extra = ([c // 64 for c, _ in path], [o.decode() for _, o in path]) if with_siblings else ()
                        out.append((row["doc_ids"][i], digest, subroot, proof, node.decode(), *extra))
                kinds = [pa.int64(), *[pa.string()] * 4, *([pa.list_(pa.int32()), pa.list_(pa.string())] if with_siblings else [])]
                columns = [pa.array(values, kind) for values, kind in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    if manifest.root is None:
        return manifest.sources.limit(0).select(*[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in schema.split(", ")])
    return _with_paths(manifest.tiers[0], _paths_of_blocks(manifest)).mapInArrow(run, schema)
