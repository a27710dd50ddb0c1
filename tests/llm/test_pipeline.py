"""The pipeline against the same steps in plain Python."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from test_text_operators import _brute_contamination, brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from flightops.llm import language
from flightops.llm.common import session_for_texts, staged, table


def _expected(sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    items = pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    learned = docs[[zlib.crc32(str(i).encode()) % 4 != 2 for i in docs.doc_id]]
    counts = []
    for lang, rows in learned.groupby("lang"):
        n = np.bincount(language._trigrams(rows.text.tolist())[0], minlength=language.BUCKETS)
        counts.append(pd.DataFrame({"lang": lang, "bucket": np.flatnonzero(n), "n": n[n > 0]}))
    model = language.Model(pd.concat(counts))
    docs = docs[[p != "und" and s >= corpus_pipeline.LEAST_SHARE for p, s in model.predict(docs.text.tolist())]]
    label, _ = brute_components(list(zip(docs.doc_id, docs.text)), 5)
    docs = docs[[label[i] == i for i in docs.doc_id]]
    hit = {r[0] for r in _brute_contamination(zip(docs.doc_id, docs.text), list(zip(items.item_id, items.text))) if r[-1]}
    docs = docs[~docs.doc_id.isin(hit)]
    return docs, _mix(docs)


def _mix(docs):
    """(position, doc_id) of every copy, in order."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in zip(docs.doc_id, docs.text)}
    of = defaultdict(list)
    for i, s in zip(docs.doc_id, docs.source):
        of[s].append(i)
    weights = dict(zip(sorted(of), itertools.cycle((5, 2, 1))))
    ends = dict(zip(sorted(of), itertools.cycle(((6, 4), (1, 3), (1, 1)))))
    total = {s: sum(size[i] for i in ids) for s, ids in of.items()}
    goal, free, left = {}, set(of), float(sum(total.values()))
    while free:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        goal |= share if not over else {s: 3.0 * total[s] for s in over}
        left -= sum(goal[s] for s in over)
        free = free - over if over else set()
    out = []
    for s, ids in of.items():
        done = 0
        for i in sorted(ids, key=lambda i: hashlib.md5(f"mix:{i}".encode()).hexdigest()):
            for turn in range(3):
                part = (turn * total[s] + done + size[i] / 2) / goal[s]
                if part < 1:
                    v, w = ends[s]
                    area = part * (v + w) / 2
                    out.append((2 * area / (v + (v * v + 2 * (w - v) * area) ** 0.5), i))
            done += size[i]
    return sorted(out)


def test_run_equals_plain_python(spark, sf_dir):
    kept, order = _expected(sf_dir)
    found = corpus_pipeline.run(spark, sf_dir).orderBy("start").collect()
    assert [r.doc_id for r in found] == [i for _, i in order]
    library = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path(corpus_pipeline.TOKENIZER))
    texts = dict(zip(kept.doc_id, kept.text))
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, corpus_pipeline.END_ID] for i, t in texts.items()}
    assert [r.start for r in found] == np.cumsum([0, *[len(ids[i]) for _, i in order]])[:-1].tolist()
    assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes()) for r in found)


def test_stages_keep_columns_and_handle_odd_rows(spark, sf_dir):
    session_for_texts(spark)
    docs = table(spark, sf_dir, "documents")
    words = docs.first().text
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, words, "en", "a", 1), (1, words, "en", "a", 1), (2, words, None, "a", None), (None, words, "en", "a", 1)]
    odd = spark.createDataFrame([(*r, "mine", 0.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double")
    for frame, left in ((odd, [5, 1, 1, 1]), (odd.limit(0), [0, 0, 0, 0])):
        for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], left, strict=False):
            frame = staged(stage(spark, frame, sf_dir), name)
            assert frame.columns == odd.columns
            if name in ("near_dedup", "language_id"):
                assert frame.count() <= max(expected, 5)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "token_output"]


@pytest.mark.parametrize("stage", range(4))
def test_empty_input(spark, sf_dir, stage):
    session_for_texts(spark)
    empty = table(spark, sf_dir, "documents").limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, empty, sf_dir).count() == 0
