"""Token ids as flat binary files.

A folder of token files holds, for each part k,

* `part-k.bin`: the ids of its documents one after the other, little-endian unsigned integers,
* `part-k.off`: n + 1 little-endian 64-bit offsets into the part, counted in ids,
* `part-k.key`: n little-endian 64-bit document ids, then n bytes that are 0 where the id is null,

and a Parquet table `parts` with (part, n_docs, n_tokens). A part's place in the whole corpus is the
prefix sum of the token counts before it, so no task waits for another one's count. Readers map the
files into memory.

Tasks write under a name of their own and then rename, and only parts listed in `parts` are read:
a task that runs twice, or on an executor that is lost, leaves nothing that is read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flightops.llm.common import slices
from flightops.session import shared_dir

PARTS = "part int, n_docs long, n_tokens long"
MAX_WORDS = 120_000  # entries of a word table, of which a worker has two: some 25 MB each
GROUP_BYTES = 4_000_000  # of text that are encoded at a time
SEPARATOR = "\0"
WORD_END = r"(\pL)([.,;:!?])"
NOT_SIMPLE = r"\pM|\x{0130}|<\|"


class WordEncoder:
    """Encodes texts with a tokenizer whose tokens never cross a blank or line feed.

    That holds for the pre-tokenizers that split on white space and drop it. Arrow splits the texts and
    numbers their different words; each of these is looked up once, new ones are encoded by the library, in lines with
    a separator that is one token of its own, and the ids of all words are gathered in one step.

    Two tables hold the words seen lately. When the newer one is full the older is dropped, so that frequent words
    stay and memory is bounded.
    """

    def __init__(self, path: str, dtype: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = dtype
        self.words: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        alone = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.separator = alone[0] if len(alone) == 1 else None
        lower = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in ("Ab", "ab")]
        apart = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in ("ab. c", "ab . c")]
        self.simple = lower[0] == lower[1] and apart[0] == apart[1]

    def _simplified(self, texts: pa.Array) -> pa.Array:
        """Texts with fewer different words and the same ids, for a tokenizer that ignores case and cuts words at marks.

        Texts with combining signs (which may join a letter or a mark), with the one letter whose lower case has such a
        sign, or with what may be a special string stay as they are.
        """
        if not self.simple:
            return texts
        spaced = pc.replace_substring_regex(pc.utf8_lower(texts), WORD_END, r"\1 \2")
        return pc.if_else(pc.match_substring_regex(texts, NOT_SIMPLE), texts, spaced)

    def _ids(self, words: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, self.dtype) for e in found]

    def _encoded(self, words: list[str]) -> dict[str, bytes]:
        """The ids of different words, from the library."""
        odd = [w for w in words if SEPARATOR in w] if self.separator is not None else words
        new = {w: x.tobytes() for w, x in zip(odd, self._ids(odd), strict=True)}
        rest = [w for w in words if w not in new]
        lines = [rest[i : i + 200] for i in range(0, len(rest), 200)]
        joined = [f" {SEPARATOR} ".join(line) + f" {SEPARATOR}" for line in lines]
        for line, ids in zip(lines, self._ids(joined), strict=True):
            ends = np.flatnonzero(ids == self.separator)
            raw, width, at = ids.tobytes(), ids.itemsize, 0
            for w, end in zip(line, ends.tolist(), strict=True):
                new[w] = raw[at * width : end * width]
                at = end + 1
        return new

    def _looked_up(self, words: list[str]) -> list[bytes]:
        """The ids of each of a list of different words."""
        newer, older = self.words, self.older
        found = list(map(newer.get, words))
        unknown = []
        for i, ids in enumerate(found):
            if ids is None:
                word = words[i]
                ids = older.get(word)
                if ids is None:
                    unknown.append(i)
                else:
                    found[i] = newer[word] = ids
        new = self._encoded([words[i] for i in unknown])
        newer.update(new)
        for i in unknown:
            found[i] = new[words[i]]
        if len(newer) > MAX_WORDS:
            self.words, self.older = {"": b""}, newer
        return found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (none null) one after the other, and how many each has."""
        split = pc.split_pattern(pc.replace_substring(self._simplified(texts), "\n", " "), " ")
        numbered = split.flatten().dictionary_encode()
        found = self._looked_up(numbered.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(found), self.dtype)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // flat.itemsize
        word = numbered.indices.to_numpy()
        n = sizes[word]
        # Where each word's ids begin in `flat`, less where they begin in the result, for every id.
        shift = np.repeat((np.cumsum(sizes) - sizes)[word] - (np.cumsum(n) - n), n)
        ids = flat[shift + np.arange(len(shift))]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        cuts = np.concatenate([np.zeros(1, np.int64), np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
        return ids, np.diff(ends[cuts])

    def long(self, text: str) -> np.ndarray:
        """The ids of one long text, a stretch of words at a time."""
        out, at = [], 0
        while at < len(text):
            end = text.find(" ", at + GROUP_BYTES // 4)
            end = len(text) if end < 0 else end
            out.append(self(pa.array([text[at:end]], pa.string()))[0])
            at = end
        return np.concatenate(out)


_encoders: dict[tuple[str, str], WordEncoder] = {}


def _encoder(path: str, dtype: str) -> WordEncoder:
    if (path, dtype) not in _encoders:
        _encoders[path, dtype] = WordEncoder(path, dtype)
    return _encoders[path, dtype]


def id_dtype(vocabulary: int) -> str:
    """The narrowest unsigned type that holds every id."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _uri(spark: SparkSession, folder: str) -> str:
    """`folder` with the scheme of the cluster's file system, as its files are opened outside Spark too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", full)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record batches put together or cut so that each holds about GROUP_BYTES of text, or one longer text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in slices(batches, GROUP_BYTES):
        own = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
        if held and size + own > GROUP_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(part)
        size += own
    if held:
        yield pa.concat_batches(held)


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    folder: str | None = None,
    order: list[Column] | None = None,
    dtype: str = "<u2",
) -> str:
    """Encode `docs` (doc_id, text) and write them in the order given; returns the folder.

    Order is by doc_id (nulls first), rows that repeat an id by text. A null text is an empty one: its
    only token is `end_id`, which closes every document. `tokenizer` is the path of a tokenizer file
    that exists on every executor. An empty table gives an empty `parts` table. Other columns
    are not read. `dtype` must hold every id; a larger one raises an error.
    """
    spark = docs.sparkSession
    folder = _uri(spark, folder or shared_dir(spark, "tokens"))
    keys = order or [F.col("doc_id"), F.xxhash64("text")]
    names = [f"__order{i}" for i in range(len(keys))]
    rows = docs.select("doc_id", "text", *(k.alias(n) for k, n in zip(keys, names, strict=True)))
    rows = rows.repartitionByRange(*names).sortWithinPartitions(*names).select("doc_id", "text")
    if end_id > np.iinfo(dtype).max:
        raise ValueError(f"{end_id} does not fit into {dtype}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), _encoder(tokenizer, dtype)
        fs, base = pafs.FileSystem.from_uri(folder)
        name, own = f"{base}/part-{part:06d}", uuid.uuid4().hex
        offsets, ids, out = [np.zeros(1, "<i8")], [], None
        total = 0
        for group in _groups(batches):
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{name}.{own}.bin")
            texts = pc.fill_null(group.column("text"), "")
            if group.num_rows == 1 and texts.nbytes > 2 * GROUP_BYTES:
                found = encode.long(texts[0].as_py())
                counts = np.array([len(found)])
            else:
                found, counts = encode(texts)
            places = np.cumsum(counts)
            out.write(np.insert(found, places, end_id).astype(dtype, copy=False).tobytes())
            ends = (np.cumsum(counts + 1) + total).astype("<i8")
            total = int(ends[-1])
            offsets.append(ends)
            ids.append(group.column("doc_id"))
        if out is None:
            return
        out.close()
        key = pa.chunked_array(ids)
        there = key.is_valid().to_numpy().astype("u1")
        values = key.fill_null(0).to_numpy().astype("<i8")
        for kind, content in (
            ("off", np.concatenate(offsets).tobytes()),
            ("key", values.tobytes() + there.tobytes()),
        ):
            with fs.open_output_stream(f"{name}.{own}.{kind}") as stream:
                stream.write(content)
        for kind in ("bin", "off", "key"):
            fs.move(f"{name}.{own}.{kind}", f"{name}.{kind}")
        counts = [pa.array([part], pa.int32()), pa.array([len(key)], pa.int64()), pa.array([total], pa.int64())]
        yield pa.RecordBatch.from_arrays(counts, names=["part", "n_docs", "n_tokens"])

    rows.mapInArrow(write, PARTS).write.parquet(f"{folder.rstrip('/')}/parts")
    return folder


def _mapped(fs: pafs.FileSystem, path: str) -> pa.Buffer:
    """The bytes of a file, mapped where the file system allows it."""
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.memory_map(path).read_buffer()
    with fs.open_input_file(path) as stream:
        return stream.read_buffer()


def read_tokens(spark: SparkSession, folder: str, dtype: str = "<u2", with_ids: bool = False) -> DataFrame:
    """One row per document of a token folder, read from its files.

    Columns: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (unsigned, over the
    ids as little-endian unsigned 32-bit integers) and, if wanted, ids.
    """
    parts = spark.read.schema(PARTS).parquet(f"{folder.rstrip('/')}/parts")
    # One row per file; the running sum gives each file its base.
    parts = parts.withColumn("base", F.sum("n_tokens").over(W.orderBy("part")) - F.col("n_tokens"))
    count = max(1, parts.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for frame in frames:
            for row in frame.itertuples(index=False):
                name, n = f"{base}/part-{row.part:06d}", row.n_docs
                ids = np.frombuffer(_mapped(fs, f"{name}.bin"), dtype)
                off = np.frombuffer(_mapped(fs, f"{name}.off"), "<i8")
                key = _mapped(fs, f"{name}.key")
                keys = pd.array(np.frombuffer(key, "<i8", n), dtype="Int64")
                keys[np.frombuffer(key, "u1", n, 8 * n) == 0] = pd.NA
                for at in range(0, n, 1024):
                    to = min(at + 1024, n)
                    docs = [ids[off[i] : off[i + 1]].astype("<u4") for i in range(at, to)]
                    out = {
                        "doc_id": keys[at:to],
                        "start": off[at:to] + row.base,
                        "n_tokens": np.diff(off[at : to + 1]),
                        "ids_crc32": [zlib.crc32(x.tobytes()) for x in docs],
                    }
                    yield pd.DataFrame(out | ({"ids": docs} if with_ids else {}))

    return parts.repartitionByRange(count, "part").mapInPandas(read, schema)
