"""Preferences, exact search, URL filters, mixing and personal data against brute force and small cases."""

from __future__ import annotations

import itertools
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightops.llm import mixing, pii, preference, tagger, topk, url_filter
from flightops.llm.common import session_for_texts, table
from flightops.llm.queries import QUERIES, URL_RULES


@pytest.fixture(scope="module")
def llm(spark):
    return session_for_texts(spark)


# --- preferences --------------------------------------------------------------------------

TURNS = "array<struct<role:string,text:string>>"


def test_prefix_is_rendered_once_and_completions_are_masked(llm):
    rows = [
        (1, [("user", "q"), ("assistant", "good")], [("user", "q"), ("assistant", "bad"), ("user", "hm")]),
        (2, [("user", "q")], [("user", "other")]),
        (3, [("user", None), ("assistant", "x")], [("user", None), ("assistant", "x")]),
        (4, None, [("assistant", "y")]),
        (4, None, [("assistant", "y")]),
        (None, [], []),
    ]
    pairs = llm.createDataFrame([(*r, "p") for r in rows], f"pair_id long, chosen {TURNS}, rejected {TURNS}, prompt string")
    found = preference.format_preferences(pairs).collect()
    assert len(found) == 6
    by_id = {r.pair_id: r for r in found}
    first = by_id[1]
    assert (first.prefix_turns, first.prompt) == (1, "<|user|>\nq\n")
    assert [(s.text, s.train) for s in first.chosen] == [("<|assistant|>\ngood\n", True)]
    assert [s.train for s in first.rejected] == [True, False]
    assert (by_id[2].prefix_turns, by_id[2].prompt) == (0, "")
    assert (by_id[3].prefix_turns, by_id[3].chosen, by_id[3].rejected) == (2, [], [])
    assert (by_id[4].chosen, len(by_id[4].rejected)) == ([], 1)
    assert preference.format_preferences(pairs.limit(0)).count() == 0


def test_every_turn_is_in_the_prompt_or_a_completion(llm, sf_dir):
    turns = table(llm, sf_dir, "conversations")
    given = defaultdict(list)
    for r in turns.orderBy("conv_id", "turn").collect():
        given[r.conv_id].append(f"<|{r.role}|>\n{r.text}\n")
    found = preference.format_preferences(preference.with_foreign_ending(turns)).collect()
    assert {r.pair_id: r.prompt + "".join(s.text for s in r.chosen) for r in found} == {k: "".join(v) for k, v in given.items()}


def test_conversations_with_missing_values(llm):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, 0, None, None), (0, None, "user", "b"), (0, 3, "assistant", "c")]
    turns = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.pair_id: r for r in preference.format_preferences(preference.with_foreign_ending(turns)).collect()}
    assert set(found) == {0, 1, None}
    assert len(found[1].chosen) + found[1].prefix_turns == 3


# --- exact search -------------------------------------------------------------------------


def _brute_top(rows, asked, k):
    out = []
    for q, v in asked:
        scored = {(-(sum(a * b for a, b in zip(v, w))), i) for i, w in rows if i != q}
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block", "queries"), [(7, 3), (4096, 100)])
def test_search_is_exact_with_ties_and_zeros(llm, block, queries):
    rng = random.Random(block)
    rows = [(i, tuple(rng.randint(-9, 9) * (rng.random() < 0.6) for _ in range(6))) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(15)] + [(200, (0,) * 6), (201, (10**9, -(10**9), 5, 0, 0, 1))]
    vectors = llm.createDataFrame([(i, list(v), 1) for i, v in rows + rows[:5]], "vec_id long, v array<long>, score int")
    asked = [(i, v) for i, v in rows if i % 3 == 0]
    found = topk.top_k(vectors, vectors.filter("vec_id % 3 = 0"), 5, block, queries).collect()
    assert sorted(tuple(r) for r in found) == _brute_top(rows, asked, 5)


def test_search_on_embeddings_equals_numpy(llm, sf_dir):
    rows = table(llm, sf_dir, "embeddings").toPandas()
    matrix = np.floor(np.stack(rows.embedding).astype(float) * 256).astype(int)
    expected = []
    for at in np.flatnonzero(rows.vec_id % 50 == 0):
        scores = matrix @ matrix[at]
        best = [j for j in np.lexsort((rows.vec_id, -scores)) if j != at][:5]
        expected += [(rows.vec_id[at], n + 1, rows.vec_id[j], scores[j]) for n, j in enumerate(best)]
    assert sorted(tuple(r) for r in QUERIES["op6_topk_search"](llm, sf_dir).collect()) == sorted(expected)


def test_vectors_that_take_no_part(llm):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (50, [0.001, -0.001]), (None, [1.0, 1.0])]
    vectors = llm.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", topk.integers().alias("v"))
    assert {r.vec_id: r.v for r in vectors.collect() if r.v}[50] == [0, -1]
    found = topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5).collect()
    assert sorted(tuple(r) for r in found) == [(0, 1, 50, -512), (50, 1, 0, -512)]
    assert topk.top_k(vectors.limit(0), vectors.limit(0), 5).count() == 0


# --- URL filters --------------------------------------------------------------------------

URLS = {
    "http://A.Example.com/en/1?x#y": ("a.example.com", "/en/1", "example.com/en/", "block"),
    "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
    "http://m.www.example.com/en/x": ("m.www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "http://notexample.com/en/x": ("notexample.com", "/en/x", "com/", "allow"),
    "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"),
    "http://x.net/es": ("x.net", "/es", None, "allow"),
    "http://x.com": ("x.com", "", None, "allow"),
    "http://cheap-pills.example.org/a": ("cheap-pills.example.org", "/a", None, "block"),
    "http://blog.casino-win.example.net/de/2": ("blog.casino-win.example.net", "/de/2", None, "block"),
    "http://city-museum.example.org/a://b?c": ("city-museum.example.org", "/a://b", None, "allow"),
    "no scheme": ("", "", None, None),
    "": ("", "", None, None),
    None: ("", "", None, None),
    "x://" + "é/" * 20_000: ("é", "/é" * 19_999 + "/", None, None),
}


def test_rules_and_model_judge_urls(llm):
    pages = llm.createDataFrame([(i, u, "h", 0.1) for i, u in enumerate([*URLS, None])], "page_id long, url string, host string, score double")
    found = {r.page_id: r for r in url_filter.judged(pages, URL_RULES).collect()}
    assert len(found) == len(URLS) + 1
    for i, (host, path, rule, verdict) in enumerate(URLS.values()):
        row = found[i]
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == verdict or (verdict is None and row.verdict in ("allow", "block"))
        assert 0 < row.score < 1
    model = url_filter.Model([0.0] * url_filter.BUCKETS)
    assert url_filter.judged(pages.limit(0), URL_RULES, model).count() == 0
    assert {r.verdict for r in url_filter.judged(pages, (), model).collect()} == {"allow"}


def test_training_separates_held_out_names(llm):
    rows = url_filter.labelled_urls(llm)
    bucket = F.pmod(F.xxhash64("host"), F.lit(4))
    model = url_filter.train(rows.filter(bucket > 0))
    scored = url_filter.featured(rows.filter(bucket == 0)).select("label", (model.margin() > 0).cast("int").alias("p"))
    assert scored.filter("label = p").count() > 0.85 * scored.count()
    assert url_filter.train(rows.limit(0)).weights == [0.0] * url_filter.BUCKETS


# --- mixing -------------------------------------------------------------------------------


def test_mix_meets_its_targets(llm, sf_dir):
    rows = QUERIES["op8_mixing"](llm, sf_dir)
    docs = table(llm, sf_dir, "documents").select("doc_id", "source")
    per = rows.join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("m"))
    for r in per.collect():
        assert abs(r.t - r.g) <= r.m / 2 + 1e-6
    assert rows.filter("taken > 3 * size or taken % greatest(size, 1) <> 0").count() == 0
    total = rows.agg(F.sum("size")).first()[0]
    assert per.agg(F.sum("g")).first()[0] == pytest.approx(total)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, QUERIES["op8_mixing"](llm, sf_dir).collect()))


def _waterfill(sizes, most=3):
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s)), itertools.cycle((5, 2, 1))))
    goal, free, left = {}, set(sizes), float(sum(sizes.values()))
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return goal | share
        for s in over:
            goal[s] = float(most * sizes[s])
            left -= goal[s]
        free -= over


def test_targets_equal_repeated_sharing(llm):
    rng = random.Random(2)
    for n in (1, 2, 5, 9):
        sizes = {(f"s{i}" if i else None): rng.choice([0, 1, 7, 50, 900]) for i in range(n)}
        given = llm.createDataFrame(list(sizes.items()), "source string, size long")
        found = {r.source: r.target for r in mixing.targets(given, mixing.CURRICULUM).collect()}
        assert found == pytest.approx(_waterfill(sizes))


def test_positions_invert_the_integral(llm):
    knots = ((0, 1), (0.25, 3), (0.5, 0), (1, 2))
    whole = mixing.integral(knots)
    grid = np.linspace(0, 1, 100_001)
    weight = np.interp(grid, [k[0] for k in knots], [k[1] for k in knots])
    done = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2) / 100_000]) / whole
    parts = [0.0, 0.01, 0.3, 0.5, 0.77, 0.999]
    rows = llm.createDataFrame([(p,) for p in parts], "p double").select("p", mixing.time_at(knots, F.col("p")).alias("t")).collect()
    assert [r.t for r in rows] == pytest.approx([float(np.interp(r.p, done, grid)) for r in rows], abs=1e-4)


def test_mixed_rows_follow_the_schedule(llm):
    rows = [(i, "w " * (i % 7), "ab"[i % 2], i) for i in range(200)]
    rows += [(500, "same words", "a", 1)] * 4 + [(None, "no id", None, 2), (501, None, "a", 3), (502, "", None, 4), (503, "w " * 9000, "a", 5)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, source string, size long")
    plan = mixing.schedule(docs)
    assert plan.count() == len(rows)
    expected = Counter()
    for r in plan.collect():
        expected[r.doc_id] += len(r.positions)
        assert all(0 <= t <= 1 for t in r.positions)
        assert r.positions == sorted(r.positions)
    found = mixing.mixed(docs)
    assert found.columns == docs.columns
    assert Counter(r.doc_id for r in found.collect()) == +expected
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_the_first_source_fades(llm, sf_dir):
    plan = mixing.schedule(table(llm, sf_dir, "documents")).select("source", F.explode("positions").alias("t"), "size")
    early = plan.groupBy("source").agg((F.sum(F.when(F.col("t") < 0.5, F.col("size"))) / F.sum("size")).alias("e"))
    share = {r.source: r.e for r in early.collect()}
    ranked = sorted(share)
    assert np.mean([share[s] for s in ranked[0::3]]) > 0.5 > np.mean([share[s] for s in ranked[1::3]])


# --- personal data ------------------------------------------------------------------------

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def _plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fits = (
                kind == 0
                or (kind == 1 and all(int(x) <= 255 for x in m.group().split(".")))
                or (kind == 2 and 12 <= len(digits) <= 19 and pii.luhn(digits))
                or (kind == 3 and 9 <= len(digits) <= 15)
            )
            if fits:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(4)
    texts = ["".join(rng.choice("a1.@_+- ()4b%é") for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    texts += ["4111 1111 1111 1111", "001.2.3.255 256.1.1.1", "+1 (743) 555-3824", "a@b.c_d@e.f", "9" * 100_000, "a" * 100_000 + "@"]
    for text in texts:
        assert pii.base_spans(text)[0] == _plain_spans(text) if len(text) < 1000 else pii.base_spans(text)[0] == []


def test_windows_cover_every_anchor():
    rng = random.Random(7)
    for n in (0, 1, 95, 96, 97, 500):
        text = "".join(rng.choice("ab  1@"[: 4 + rng.randrange(3)]) for _ in range(n))
        every = range(0, max(1, n - pii.WIDTH + pii.STEP), pii.STEP)
        assert pii.window_starts(text) == [a for a in every if re.search("[0-9@]", text[a : a + pii.WIDTH])]


def test_reconciling_finds_the_best_set():
    rng = random.Random(8)
    for _ in range(200):
        spans = []
        for _ in range(rng.randint(0, 7)):
            a = rng.randint(0, 20)
            spans.append((a, 0, a + rng.randint(1, 8), float(rng.randint(1, 9))))
        lead = {s[:3]: max(x[3] for x in spans if x[:3] == s[:3]) for s in spans}
        best = 0.0
        for n in range(len(lead) + 1):
            for some in itertools.combinations(lead, n):
                if all(a[2] <= b[0] for a, b in itertools.pairwise(sorted(some))):
                    best = max(best, sum(lead[s] for s in some))
        chosen = pii.reconciled(spans)
        assert sum(lead[s] for s in chosen) == best


class _Marks:
    """A tagger that finds the runs of one mark, as far as its window shows them."""

    def decode(self, x):
        mark = tagger.char_classes("@")[0]
        on = x == mark
        before = np.concatenate([np.zeros((len(x), 1), bool), on[:, :-1]], axis=1)
        return np.where(on, np.where(before, 2, 1), 0), np.where(on, 5.0, 0.0)


def test_spans_of_any_length_and_place_are_found_once():
    for size in (7, 47, 48, 49, 60, 95, 96, 97, 144, 145, 300):
        for at in (0, 1, 40, 47, 48, 49, 95, 96, 97, 150):
            for tail in (0, 1, 100):
                text = "a" * at + "@" * size + "a" * tail
                assert pii.added_spans(_Marks(), [text], [[]]) == [[(at, 0, at + size)]], (size, at, tail)
                touched = [(at + size - 1, 1, at + size + 5)]
                assert pii.added_spans(_Marks(), [text], [touched]) == [[]]
    assert pii.added_spans(_Marks(), ["", "a1", "@" * 9], [[], [], []]) == [[], [], [(0, 0, 9)]]


def test_parts_join_only_where_cut_ends_meet():
    whole, left, right, both = (False, False), (True, False), (False, True), (True, True)
    part = lambda a, b, cut, kind=0: (a, kind, b, 2.0 * (b - a), *cut)
    assert pii.joined([part(3, 9, whole)]) == [(3, 0, 9, 2.0)]
    assert pii.joined([part(40, 96, right), part(48, 100, left)]) == [(40, 0, 100, 2.0)]
    assert pii.joined([part(40, 96, right), part(48, 144, both), part(96, 150, left)]) == [(40, 0, 150, 2.0)]
    assert pii.joined([part(40, 96, right), part(48, 100, left, 1)]) == []
    assert pii.joined([part(40, 96, right), part(96, 100, left)]) == []  # they do not overlap
    assert pii.joined([part(40, 48, right), part(40, 70, whole)]) == [(40, 0, 70, 2.0)]


def test_dense_long_texts_take_proportional_time():
    text = "call +49 151 2345678, mail a.b@c.de, pay 4111 1111 1111 1111 or 10.2.3.4; " * 4000
    base = pii.base_spans(text)[0]
    began = time.perf_counter()
    assert len(base) >= 16_000
    assert len(pii.added_spans(_Marks(), [text], [base])[0]) == 0
    found = pii._Spans(base)
    assert all(found.meeting(at, at + 96) for at in range(0, len(text), 48))
    assert time.perf_counter() - began < 20


def test_gradients_and_best_paths():
    rng = np.random.default_rng(3)
    model = tagger.Tagger(hidden=4)
    x, y = rng.integers(0, 20, (3, 6)), rng.integers(0, 3, (3, 6))
    _, grad = model._gradients(x, y)
    for name, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was, step = model.p[name][at], 1e-5
        losses = []
        for shift in (step, -step):
            model.p[name][at] = was + shift
            losses.append(model._gradients(x, y)[0])
        model.p[name][at] = was
        assert (losses[0] - losses[1]) / (2 * step) == pytest.approx(g[at], rel=1e-3, abs=1e-6)
    tags, _ = model.decode(x)
    for row in tags:
        for before, after in itertools.pairwise([0, *row]):
            assert after % 2 or not after or before in (after, after - 1)


def test_tagger_learns_and_adds_mistyped_numbers(llm):
    docs = table(llm, "/root/testdata/sf0.1", "documents")
    model = pii.train(docs.filter("doc_id % 2 = 0"))
    held = pii.labelled_windows(docs.filter("doc_id % 2 = 1")).distinct().limit(400).collect()
    x = np.zeros((len(held), pii.WIDTH), int)
    for i, r in enumerate(held):
        x[i, : len(r.window)] = tagger.char_classes(r.window)
    y = np.array([r.tags for r in held])
    tags, _ = model.decode(x)
    assert (tags == y)[y > 0].mean() > 0.97
    assert (tags == y)[y == 0].mean() > 0.99
    lead = "the then other and of words, in " * 4
    rows = [(1, f"{lead}4737097684299439 {lead}"), (2, f"{lead}4737097684299438 {lead}"), (3, None), (4, ""), (4, ""), (5, lead), (None, "a@b.co")]
    given = llm.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, spans string")
    found = defaultdict(list)
    for r in pii.find(given, model).collect():
        found[r.doc_id].append([(s.kind, s.base) for s in r.spans])
    assert found[1] == [[("card", True)]]
    assert found[2] == [[("card", False)]]
    assert (found[3], found[4], found[5]) == ([[]], [[], []], [[]])
    assert found[None] == [[("email", True)]]
    assert [r.spans for r in pii.find(given.filter("doc_id = 2"), None).collect()] == [[]]
    assert pii.find(given.limit(0), None).count() == 0
    assert pii.train(given.limit(0)) is None


def test_pii_query_counts_the_patterns_spans(llm, sf_dir):
    import hashlib

    texts = {r.doc_id: r.text for r in table(llm, sf_dir, "documents").collect()}
    for r in QUERIES["op9_pii"](llm, sf_dir).collect():
        spans = _plain_spans(texts[r.doc_id])
        counts = Counter(tagger.KINDS[k] for _, k, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in tagger.KINDS)
        base = [f"{tagger.KINDS[k]}:{a}:{b}" for a, k, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert not set(base) - set(r.spans.split(","))
