"""Resampling, token counts and the Merkle manifest against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from flightops.llm import merkle, queries, resample, token_counts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, rank long, bucket int, __at string"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def documents(spark, rows):
    """Rows (doc_id, source, lang, n_chars, text) with columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(*r, 7, 7, "x") for r in rows], SCHEMA)


def odd_rows():
    words = "alpha Beta gamma déjà VU 日本語 it's 42 x_y".split()
    rng = random.Random(3)
    rows = [(i, f"s{i % 3}", "en", 5, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(80)]
    rows += [(100, None, None, None, None), (101, "s0", "", 0, ""), (102, "s1", "fr", 3, " \n\t.,"), (None, "s1", "fr", 3, "one two")]
    rows += [(None, "s1", "fr", 3, "three"), (5, "s0", "en", 9, "repeated id"), rows[7], (103, "s9", "en", 1, "ÀÉ É word " * 5000)]
    return rows


# --- resampling -----------------------------------------------------------------------------


def plain_features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_resampling(rows, target, percent, least):
    own, wanted = (Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in plain_features(t)[1]) for texts in ([r[4] for r in rows], target))
    s_all, t_all = sum(own.values()) + 10000, sum(wanted.values()) + 10000
    found = []
    for r in rows:
        words, features = plain_features(r[4])
        weight = sum(
            math.floor(1000 * math.log((wanted[b] + 1) * s_all / ((own[b] + 1) * t_all)))
            for b in (zlib.crc32(f.encode()) % 10000 for f in features)
        )
        h = int(hashlib.sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        found.append((r[0], len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((f for f in found if f[1] >= least), key=lambda f: (-f[4], f[0] is None, f[0] or 0))
    drawn = [(f[0], f[2], f[3], f[4], i + 1) for i, f in enumerate(able[: percent * len(able) // 100])]
    rest = able[percent * len(able) // 100 :] + [f for f in found if f[1] < least]
    return drawn + [(f[0], f[2], f[3], f[4], None) for f in rest]


def by_text(rows):
    return sorted(map(str, rows))


def test_resampling_equals_plain_version(spark, monkeypatch):
    monkeypatch.setattr(resample, "CHUNK", 64)
    rows, target = odd_rows(), ["alpha beta déjà", None, "", "gamma 42"]
    assert any(len((r[4] or "")) > 64 for r in rows)
    got = resample.resampled(documents(spark, rows).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), 30)
    assert by_text(tuple(r) for r in got.collect()) == by_text(plain_resampling(rows, target, 30, 20))


def test_pieces_of_a_text_have_its_features(monkeypatch):
    text = "a bb ccc dddd " * 40 + "x" * 300 + " tail end"
    whole = [int(s) for _, sums in resample.hashed_features(text) for s in sums]
    monkeypatch.setattr(resample, "CHUNK", 10)
    cut = list(resample.hashed_features(text))
    assert len(cut) > 10 and sorted(int(s) for _, sums in cut for s in sums) == sorted(whole)
    assert sorted(zlib.crc32(f.encode()) for f in plain_features(text)[1]) == sorted(whole)


def test_resampling_of_empty_tables(spark):
    none = documents(spark, []).select("text")
    assert resample.resampled(documents(spark, []), none).count() == 0
    got = resample.resampled(documents(spark, odd_rows()), none, 100).collect()
    assert len(got) == len(odd_rows()) and sum(r["rank"] is not None for r in got) == sum(len(plain_features(r[4])[0]) >= 20 for r in odd_rows())


# --- token counts ---------------------------------------------------------------------------

PARTS = ["a", "b", " ", "  ", "\n", "'s", "'re", "'", "<|endoftext|>", "<|endo", "ext|>", "1", "23", "!", "?!", "é", "日", "İ", "\t", "x" * 20, " " * 30, " "]


def test_spliced_counts_equal_whole_ones():
    small, rng, spliced = token_counts.Counter(BYTE_BPE, chunk=48, overlap=40), random.Random(5), 0
    for _ in range(4000):
        text = "".join(rng.choices(PARTS, k=rng.randint(20, 200)))
        if len(text) > 88:
            spliced += 1
            assert small.spliced(text) == len(small.tokenizer.encode(text, add_special_tokens=False)), text
    assert spliced > 2000


@pytest.mark.parametrize("text", ["x" * 5000, " " * 5000, "<|endoftext|>" * 400, "'" * 3000 + "re", "a " * 3000])
def test_overlaps_widen_over_long_pieces(text):
    small = token_counts.Counter(BYTE_BPE, chunk=48, overlap=40)
    assert small.spliced(text) == len(small.tokenizer.encode(text, add_special_tokens=False))


def test_token_counts_of_odd_rows(spark):
    library = Tokenizer.from_file(BYTE_BPE)
    rows = [*odd_rows(), (200, "s0", "en", 1, "word <|endoftext|> it's " * 4000), (201, "s0", "en", 1, "y" * 70_000)]
    assert len(rows[-1][4]) > token_counts.CHUNK + token_counts.OVERLAP
    got = token_counts.token_counts(documents(spark, rows).repartition(4), BYTE_BPE, limit=40)
    want = [(r[0], len((r[4] or "").encode()), n := len(library.encode(r[4] or "", add_special_tokens=False)), n > 40) for r in rows]
    assert by_text(tuple(r) for r in got.collect()) == by_text(want)
    assert token_counts.token_counts(documents(spark, []), BYTE_BPE).count() == 0


def test_tokenizers_without_the_proof_encode_whole_texts(tmp_path):
    other = token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"), chunk=20, overlap=5)
    text = "Some words, İstanbul's. " * 20
    assert not other.stable and other([text]) == [len(other.tokenizer.encode(text, add_special_tokens=False))]
    cut = json.loads(open(BYTE_BPE, encoding="utf-8").read())
    cut["truncation"] = {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}
    (tmp_path / "t.json").write_text(json.dumps(cut))
    assert token_counts.Counter(str(tmp_path / "t.json"))(["one two three four five"]) == [5]
    with pytest.raises(ValueError):
        token_counts.Counter("x.model")


# --- Merkle manifest ------------------------------------------------------------------------


@pytest.mark.parametrize("width", [1, 2, 15, 16, 17, 31, 32, 33, 200, 255, 256])
def test_positions_are_those_of_the_completed_nodes(width):
    """Every node's digest is found at its closed-form position, whatever the size of the last run."""
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(width)]
    top = merkle.levels(width)
    log, level = merkle.append_log(leaves, top), leaves
    for k in range(top + 1):
        assert [log[merkle.position(k, i, width, top)] for i in range(len(level))] == level
        level = [merkle.parent(level[i : i + 16]) for i in range(0, len(level), 16)]
    assert len(log) == len({merkle.position(k, i, width, top) for k in range(top + 1) for i in range(-(-width // 16**k))})


def digest_of(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    return digest_of(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def plain_tree(level):
    """Root and, for each leaf, its siblings: (place, digests) from the bottom."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, path in enumerate(paths):
            run = level[at[i] // 16 * 16 :][:16]
            path.append((at[i] % 16, run[: at[i] % 16] + run[at[i] % 16 + 1 :]))
            at[i] //= 16
        level = [digest_of(*level[k : k + 16]) for k in range(0, len(level), 16)]
    return level[0], paths


def plain_manifest(rows):
    key = lambda r: (r[1] is not None, (r[1] or "").encode())
    trees = []
    for _, group in itertools.groupby(sorted(rows, key=key), key=key):
        group = sorted(group, key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r, r[4])))
        trees.append((group, *plain_tree([plain_leaf(r, r[4]) for r in group])))
    root, tops = plain_tree([t[1] for t in trees])
    out = []
    for (group, subroot, paths), top in zip(trees, tops, strict=True):
        for row, path in zip(group, paths, strict=True):
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4]) if bad else row[4]
            folded = plain_leaf(row, text)
            for place, others in path + top:
                folded = digest_of(*others[:place], folded, *others[place:])
            proof = digest_of(*(d for _, others in path + top for d in others))
            out.append((row[0], plain_leaf(row, row[4]), subroot, root, proof, folded, folded == root))
    return out


def run_manifest(spark, rows, tmp_path):
    documents(spark, rows).repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in queries.QUERIES["op13_merkle_manifest"](spark, str(tmp_path)).collect()]


def test_manifest_equals_plain_version_over_several_tiers(spark, tmp_path):
    """One source of more than a block of rows, and more than a block of sources."""
    rows = [(i, "hot", "en", i % 9, f"Text Nº {i}") for i in range(600)]
    rows += [(1000 + i, f"é{i}", None, None, f"Own {i}") for i in range(270)]
    want = plain_manifest(rows)
    assert by_text(run_manifest(spark, rows, tmp_path)) == by_text(want)
    assert {w[-1] for w in want} == {True, False}


def test_manifest_of_odd_rows(spark, tmp_path):
    rows = odd_rows()
    assert by_text(run_manifest(spark, rows, tmp_path)) == by_text(plain_manifest(rows))


def test_manifest_of_one_row_and_of_none(spark, tmp_path):
    one = [(1, "s", "en", 1, "lower")]
    found = run_manifest(spark, one, tmp_path / "one")
    assert found == plain_manifest(one) and found[0][1] == found[0][2] == found[0][3]
    assert run_manifest(spark, [], tmp_path / "none") == []


def test_proofs_carry_their_siblings(spark):
    rows = [(i, "a", "en", 1, str(i)) for i in range(20)] + [(50, "b", "en", 1, "b")]
    manifest = merkle.build(documents(spark, rows))
    for r in merkle.proofs(manifest, with_siblings=True).collect():
        node = r.leaf
        for place, others in zip(r.places, r.siblings, strict=True):
            node = digest_of(others[: 64 * place], node, others[64 * place :])
        assert node == r.folded_root == manifest.root.hex()
    assert manifest.tiers[0].agg(F.sum("width")).first()[0] == 21
