"""Token counts, with huge texts encoded in overlapping chunks that are spliced where both must agree.

A byte-level tokenizer scans a text from left to right into pieces and merges bytes inside a piece
only. Where a piece begins, the rest of the scan depends on nothing before it. So if a chunk whose
scan is known to be that of the whole text and the chunk after it both begin a piece at the same place,
the second scan is that of the whole text from there on: the place is stable, and the ids before it
from the first chunk and after it from the second are those of the whole text. The first chunk begins
with the text, which starts the induction. A chunk's last characters prove nothing, since a piece or a
special string may go on behind its end; they are a margin that no splice may lie in.

If two chunks share no stable place, the first is extended by an overlap twice as wide. A text that is one single piece
ends up being encoded at once, whatever its length.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightops.llm.common import map_texts

CHUNK = 32_768  # characters
OVERLAP = 512
LOOK_AHEAD = 16  # the pieces' own pattern looks three characters ahead at most


class Counter:
    """Counts the ids of texts as the library gives them, without tokens that it would add."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        from tokenizers import Tokenizer

        if not path.endswith(".json"):
            raise ValueError(f"not a tokenizer of the tokenizers library: {path}")
        with open(path, encoding="utf-8") as file:
            text = file.read()
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        shape = json.loads(text)
        added = shape.get("added_tokens") or []
        self.chunk, self.overlap = chunk, overlap
        self.margin = LOOK_AHEAD + max((len(t["content"]) for t in added), default=0)
        scan = shape.get("pre_tokenizer") or {}
        # The proof needs the scan described above on the text as it is; others are encoded whole.
        self.stable = (
            shape.get("normalizer") is None
            and scan.get("type") == "ByteLevel"
            and scan.get("use_regex", True)
            and not scan.get("add_prefix_space", True)
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        )

    def _encode(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    @staticmethod
    def _starts(encoding, start: int, low: int, high: int, backwards: bool) -> dict[int, int]:
        """Where pieces begin in [low, high), and the index of the first id of each."""
        pieces, offsets, found = encoding.word_ids, encoding.offsets, {}
        n = len(pieces)
        for i in range(n - 1, -1, -1) if backwards else range(n):
            at = start + offsets[i][0]
            if at < low if backwards else at >= high:
                break
            if low <= at < high and (i == 0 or pieces[i] != pieces[i - 1]):
                found[at] = i
        return found

    def spliced(self, text: str) -> int:
        """The number of ids of a text of more than one chunk."""
        total, overlap = 0, self.overlap
        true_at = start = first = 0  # the left chunk's ids from `first` on, at `true_at`, are proven
        end = min(len(text), self.chunk + overlap)
        left = self._encode(text[:end])
        while end < len(text):
            right_start = max(end - overlap, true_at)
            right_end = min(len(text), right_start + self.chunk + overlap)
            right = self._encode(text[right_start:right_end])
            low, high = max(right_start, true_at + 1), end - self.margin
            known = self._starts(left, start, low, high, backwards=True)
            other = self._starts(right, right_start, low, high, backwards=False)
            common = known.keys() & other.keys()
            if common:
                cut = max(common)
                total += known[cut] - first
                left, start, end, true_at, first = right, right_start, right_end, cut, other[cut]
                overlap = self.overlap
            else:
                overlap *= 2
                start, first, end = true_at, 0, min(len(text), end + overlap)
                left = self._encode(text[start:end])
        return total + len(left) - first

    def __call__(self, texts: list[str | None]) -> list[int]:
        counts = [0] * len(texts)
        short = [i for i, t in enumerate(texts) if t and (len(t) <= self.chunk + self.overlap or not self.stable)]
        found = self.tokenizer.encode_batch_fast([texts[i] for i in short], add_special_tokens=False)
        for i, encoding in zip(short, found, strict=True):
            counts[i] = len(encoding)
        for i, t in enumerate(texts):
            if self.stable and t and len(t) > self.chunk + self.overlap:
                counts[i] = self.spliced(t)
        return counts


@functools.lru_cache(maxsize=1)
def _counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs (doc_id, text).

    A null text counts like an empty one: no bytes, no tokens. Strings of special tokens inside a text
    are those tokens, as is the library's default. Repeated rows and null ids are rows like others; other columns
    are not read; an empty table gives no rows. Long texts are encoded a chunk at a time. `tokenizer` is the path of a
    tokenizer file on every executor.
    """

    def compute(texts: list[str | None]) -> list[list]:
        return [_counter(tokenizer)(texts)]

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = map_texts(rows, ["doc_id", "n_bytes"], "n_tokens long", compute)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
