"""Token files, decontamination, languages, near duplicates and repeated passages against brute force."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from compare import connect, differences
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flightops.llm import decontaminate, language, near_dedup, substring, token_output
from flightops.llm.common import BATCH_ROWS, session_for_texts, table
from flightops.llm.oracle import ORACLE
from flightops.llm.queries import END_ID, QUERIES, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, start string"


@pytest.fixture(scope="module")
def texts_session(spark):
    return session_for_texts(spark)


def documents(spark, rows):
    """(doc_id, text) as documents, with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, "x") for i, t in rows], SCHEMA)


ODD = [(5, None), (None, "no id here"), (3, ""), (1, " \n\t "), (2, "One"), (2, "One"), (2, "other one"), (9, "a b " * 30_000), (8, "…—!")]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(texts_session, sf_dir, name):
    assert differences(QUERIES[name](texts_session, sf_dir), connect(sf_dir), ORACLE[name]) is None


# --- token files --------------------------------------------------------------------------


def test_token_files_hold_every_id_in_order(texts_session):
    rows = [*ODD, (4, "It's a test's 'll <|endoftext|> İstanbul ΣΑΣ. x\x1cy 12,5 foo., é \0 z \0")]
    folder = token_output.write_tokens(documents(texts_session, rows).repartition(3), tokenizer_path(), END_ID)
    found = token_output.read_tokens(texts_session, folder, with_ids=True).orderBy("start").collect()
    library = Tokenizer.from_file(tokenizer_path())
    ids = {r: [*library.encode(r[1] or "", add_special_tokens=False).ids, END_ID] for r in rows}
    assert [f.doc_id for f in found] == [None, 1, 2, 2, 2, 3, 4, 5, 8, 9]
    assert sorted(tuple(f.ids) for f in found) == sorted(tuple(ids[r]) for r in rows)
    assert [f.start for f in found] == np.cumsum([0, *[f.n_tokens for f in found]])[:-1].tolist()
    for f in found:
        assert len(f.ids) == f.n_tokens
        assert f.ids_crc32 == zlib.crc32(np.array(f.ids, "<u4").tobytes())


def test_word_table_restarts_without_changing_ids(monkeypatch):
    monkeypatch.setattr(token_output, "MAX_WORDS", 40)
    encode = token_output.WordEncoder(tokenizer_path(), "<u2")
    library = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(1)
    for _ in range(20):
        text = " ".join(rng.choice(["Wort,", "mañana.", "été", "the", "X9-y", "don't"]) + str(rng.randint(0, 99)) * rng.randint(0, 1) for _ in range(30))
        assert encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


PIECES = (
    ["a", "Word", "GAZİ", "BELEDİYESİ", "İ", "ſ", "é", "É", "J", "\u030c", "\u0307", "ÀÉ", "ß", "ẞ", "ŉ", "Σ", "ΑΣ", "I", "\u212a", "日本"]
    + ["'s", "'RE", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", ",", ".", "!", "?!", ";", ":", "12", "\t", "\u00a0", "\0", "\r"]
)


def test_ids_of_random_texts_equal_the_librarys():
    """Marks, letters whose lower case has a combining sign, combining signs, special strings."""
    encode, rng = token_output.WordEncoder(tokenizer_path(), "<u2"), random.Random(2)
    texts = ["".join(rng.choice(PIECES) + rng.choice(["", "", "", " ", "\n"]) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    ids, counts = encode(pa.array(texts))
    want = encode.tokenizer.encode_batch(texts, add_special_tokens=False)
    at = 0
    for text, w, n in zip(texts, want, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == w.ids, text
        at += n
    assert at == len(ids)


def test_long_texts_are_encoded_in_stretches(texts_session, monkeypatch):
    monkeypatch.setattr(token_output, "GROUP_BYTES", 64)
    encode = token_output.WordEncoder(tokenizer_path(), "<u2")
    text = "A long text, with İ and é.\n" * 30 + "x" * 200 + " end"
    assert encode.long(text).tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids
    batch = pa.record_batch({"text": pa.array(["short", text, None, "", "b c", text])})
    assert [t for g in token_output._groups(iter([batch])) for t in g.column("text").to_pylist()] == batch.column("text").to_pylist()


def test_no_documents_give_no_tokens(texts_session):
    empty = documents(texts_session, [])
    assert token_output.read_tokens(texts_session, token_output.write_tokens(empty, tokenizer_path(), END_ID)).count() == 0


def test_wide_ids(texts_session):
    docs = documents(texts_session, [(1, "the end")])
    folder = token_output.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), 70_000, dtype="<u4")
    assert token_output.read_tokens(texts_session, folder, "<u4", with_ids=True).first().ids[-1] == 70_000
    assert (token_output.id_dtype(65_536), token_output.id_dtype(65_537)) == ("<u2", "<u4")


# --- decontamination ----------------------------------------------------------------------


def _brute_contamination(docs, items, length=10):
    import hashlib
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: word.findall((t or "").translate(lower))
    out = []
    for doc_id, text in docs:
        w, hit, found = split(text), set(), set()
        for item, passage in items:
            p = split(passage)
            n = min(len(p), length)
            runs = {tuple(p[i : i + n]) for i in range(len(p) - n + 1)} if p else ()
            for at in range(len(w) - n + 1 if n else 0):
                if tuple(w[at : at + n]) in runs:
                    hit |= set(range(at, at + n))
                    found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_ROWS, 0])
def test_contamination_equals_brute_force(texts_session, limit):
    rng = random.Random(3)
    vocabulary = ["Ab", "b", "c", "É", "é", "d-e", "12", "ñ"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, text(14)), (2, text(3)), (2, text(11)), (10, text(10)), (11, "x"), (12, ""), (13, None), (14, "É b"), (15, text(25))]
    docs = [(i, text(rng.randint(0, 40))) for i in range(60)] + ODD + [(100, items[0][1] + " " + items[8][1]), (101, "y X y"), (101, "x")]
    given = texts_session.createDataFrame([(*i, "z") for i in items], "item_id long, text string, window string")
    found = decontaminate.contamination(documents(texts_session, docs), given, broadcast_rows=limit)
    assert sorted(map(tuple, found.collect()), key=str) == _brute_contamination(docs, items)


def test_contamination_without_items_or_documents(texts_session):
    none = texts_session.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.contamination(documents(texts_session, ODD), none).collect()] == [0] * len(ODD)
    some = texts_session.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(documents(texts_session, []), some).count() == 0


def test_contamination_reads_small_batches(texts_session, sf_dir):
    size = "spark.sql.parquet.columnarReaderBatchSize"
    texts_session.conf.unset(size)
    found = QUERIES["op2_decontamination"](texts_session, sf_dir)
    assert int(texts_session.conf.get(size)) == BATCH_ROWS
    assert found.count() == table(texts_session, sf_dir, "documents").count()


# --- languages ----------------------------------------------------------------------------


def test_held_out_accuracy(texts_session):
    found = QUERIES["op3_language_id"](texts_session, "/root/testdata/sf0.01")
    right = found.join(table(texts_session, "/root/testdata/sf0.01", "documents"), "doc_id")
    scores = right.filter("held_out").selectExpr("avg(int(lang = lang_pred)) as a", "min(score) as l", "max(score) as h").first()
    assert scores.a > 0.99
    assert 0 < scores.l <= scores.h <= 1
    expected = [zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in found.select("doc_id").collect()]
    assert expected == [r.held_out for r in found.select("held_out").collect()]


def test_mixtures_and_odd_texts(texts_session):
    learned = [("en", "the house and the garden with this thing"), ("fr", "le jardin et la maison avec une chose"), (None, "x"), ("de", None)]
    model = language.train(texts_session.createDataFrame([(t, lang) for lang, t in learned * 5], "text string, lang string"))
    assert model.languages == ["en", "fr"]
    both = model.shares(language._trigrams(["the house and the garden " * 9 + "le jardin et la maison " * 6])[0])
    assert 0.45 < both[0] < 0.75
    docs = documents(texts_session, [*ODD, (20, "THE GARDEN"), (21, "ŧ" * 50), (22, "12 34")])
    found = language.predict(docs, model).collect()
    by_id = defaultdict(list)
    for r in found:
        by_id[r.doc_id].append((r.lang_pred, r.score))
    assert len(found) == len(ODD) + 3
    for i in (5, 3, 1, 8, 22):
        assert by_id[i] == [("und", 0.0)]
    assert by_id[20] == [("en", 1.0)]
    assert by_id[2][0] in by_id[2][1:]
    kept = language.predict(docs.withColumn("score", F.lit("mine")), model, ("doc_id", "score"), ("a", "b"))
    assert kept.columns == ["doc_id", "score", "a", "b"]


def test_nothing_to_learn_from(texts_session):
    model = language.train(documents(texts_session, []))
    assert [(r.lang_pred, r.score) for r in language.predict(documents(texts_session, [(1, "abc")]), model).collect()] == [("und", 0.0)]
    assert language.predict(documents(texts_session, []), model).count() == 0


# --- near duplicates ----------------------------------------------------------------------


def brute_components(rows, size, percent=80):
    """doc_id -> smallest reachable doc_id, for rows with different ids."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        runs = [tuple(w[k : k + size]) for k in range(len(w) - size + 1)] or ([tuple(w)] if w else [])
        sets[i] = frozenset(runs)
    label = {i: i for i in sets}
    links = []
    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                links.append((a, b))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label, {i: len(s) for i, s in sets.items()}


def _varied(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10_000)}"
    return " ".join(out)


@pytest.mark.parametrize("size", [2, 5])
def test_groups_equal_brute_force(texts_session, size):
    rng = random.Random(size)
    rows = []
    for group in range(4):
        base = [f"w{rng.randrange(3_000)}" for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(25):
            rows.append((len(rows) * 7 % 1009, _varied(rng, base, rng.randrange(0, 2 + len(base) // 9))))
    rows += [(2000 + i, t) for i, t in enumerate(["Solo", "solo", "a b", "A  B", "", None, "x " * 20_000])]
    rng.shuffle(rows)
    label, sizes = brute_components(rows, size)
    found = near_dedup.near_duplicates(documents(texts_session, rows), size=size).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in found} == {i: (label[i], sizes[i], label[i] == i) for i, _ in rows}


def test_repeated_and_missing_ids(texts_session):
    rows = [(4, "a b c d"), (7, "a b c d"), (7, "k l m n"), (9, "k l m n"), (None, "k l m n"), (None, "alone here"), (3, None), (3, None)]
    found = near_dedup.near_duplicates(documents(texts_session, rows), size=2).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in found), key=str) == sorted(
        [(4, 4, True), (7, 4, False), (7, 4, False), (9, 4, False), (None, 4, False), (None, None, True), (3, 3, True), (3, 3, True)], key=str
    )
    assert near_dedup.near_duplicates(documents(texts_session, []), size=2).count() == 0


def test_pruning_keeps_what_reaches_the_threshold():
    rng = np.random.default_rng(1)
    for n in (30, 400):
        one = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        two = np.concatenate([one[: n - n // 10], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)])
        a, b = (np.frombuffer(near_dedup.signature(np.unique(x)), "<u2") for x in (one, two))
        assert (a == b).sum() >= near_dedup.least_matches(len(a), 0.8, near_dedup.MISS)
        differ = sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(near_dedup.parities(one), near_dedup.parities(two), strict=True))
        assert differ <= 2 * (n // 10)
    assert near_dedup.least_matches(240, 0.8, 1e-6) < 240 * 0.8


# --- repeated passages --------------------------------------------------------------------


def test_every_passage_of_fifty_words_is_found(texts_session):
    docs = [(r.doc_id, r.text) for r in table(texts_session, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    owners = defaultdict(set)
    for i, text in docs:
        w = text.split(" ")
        for k in range(len(w) - 50):
            owners[" ".join(w[k : k + 51])].add(i)
    must = set().union(*[ids - {min(ids)} for ids in owners.values() if len(ids) > 1])
    spans = QUERIES["op10_substring_dedup"](texts_session, "/root/testdata/sf0.01").collect()
    assert must <= {s.doc_id for s in spans}
    texts = dict(docs)
    for s in spans:
        assert s.end - s.start >= substring.LEAST_CHARS
        assert s.first_doc_id <= s.doc_id
    whole = [s for s in spans if s.n_chunks > 8 and s.first_doc_id != s.doc_id]
    shared = [s for s in whole if any(texts[s.doc_id][k : k + 60] in texts[s.first_doc_id] for k in range(s.start, s.end - 60, 20))]
    assert len(shared) > 0.95 * len(whole)


def test_insertions_shift_no_other_cut():
    rng = random.Random(5)
    text = "".join(rng.choice("abcdé ñ.") for _ in range(4000))
    before = set(np.array(substring.cuts(text.encode())[1]) - len(text))
    after = set(np.array(substring.cuts(("xyz" * 7 + text).encode())[1]) - len(text) - 21)
    assert len(before ^ after) <= 8
    chars = substring.cuts(text.encode())[1]
    assert chars[-1] == len(text)


def test_odd_texts_have_no_passages_and_cutting_keeps_rows(texts_session):
    rng = random.Random(6)
    passage = " ".join(f"word{rng.randrange(999)}" for _ in range(80))
    rows = [*ODD, (30, f"first {passage} end"), (31, f"é second one {passage}"), (31, f"é second one {passage}"), (None, passage)]
    docs = documents(texts_session, rows)
    spans = substring.repeated_passages(docs)
    found = {(s.doc_id, s.first_doc_id) for s in spans.collect() if s.doc_id != 9}
    assert found == {(31, 30), (None, 30)}
    kept = substring.without_passages(docs, spans)
    assert kept.columns == docs.columns
    texts = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert len(texts) == len(rows)
    assert all(len(t) < 300 for i, t in texts if i == 31)
    assert (30, f"first {passage} end") in texts
    assert (5, None) in texts
    assert substring.repeated_passages(documents(texts_session, [])).count() == 0


def _plain_chunks(text):
    """Ends of the chunks in characters, byte by byte."""
    raw, gear = text.encode(), substring._GEAR.tolist()
    n, reach = len(raw), substring.RADIUS
    rolled = [sum(gear[raw[i - j]] << j for j in range(min(i + 1, substring.WINDOW))) % (1 << 32) for i in range(n)]
    ends = {n}
    for i in range(n - 1):
        if all(rolled[i] < rolled[j] for j in range(max(0, i - reach), min(n, i + reach + 1)) if j != i):
            ends.add(i + 1)
    while any((raw + b" ")[e] & 0xC0 == 0x80 for e in ends):
        ends = {e + ((raw + b" ")[e] & 0xC0 == 0x80) for e in ends}
    return [len(raw[:e].decode()) for e in sorted(ends)]


def test_repeated_passages_equal_plain_chunks_in_a_dictionary(texts_session):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvwxyzäéß語") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [some(60) for _ in range(4)]
    docs = {}
    for i in range(40):
        parts = [some(rng.randint(0, 40)), rng.choice(shared) if i % 2 else "", some(rng.randint(0, 9)), rng.choice(shared) if i % 5 == 0 else ""]
        docs[i * 3 - 20] = "".join(parts)
    docs[500] = docs[1] + docs[1]

    owner, expected = {}, []
    for doc, text in sorted(docs.items()):
        ends = _plain_chunks(text) if text else []
        pieces = list(zip([0, *ends], ends))
        again = []
        for a, b in pieces:
            again.append(owner.get(text[a:b]))
            owner.setdefault(text[a:b], doc)
        at = 0
        while at < len(pieces):
            low = at
            while at < len(pieces) and again[at] is not None:
                at += 1
            if at > low:
                start, end = pieces[low][0], pieces[at - 1][1]
                n = Counter(again[low:at])
                if end - start >= substring.LEAST_CHARS:
                    expected.append((doc, start, end, at - low, min(d for d in n if n[d] == max(n.values()))))
            at += 1
    rows = texts_session.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = substring.repeated_passages(rows).select("doc_id", "start", "end", "n_chunks", "first_doc_id").collect()
    assert len(expected) > 20
    assert sorted(tuple(r) for r in found) == sorted(expected)
