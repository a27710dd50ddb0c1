"""Personal data: fixed patterns, and a character BiLSTM-CRF that adds what they miss.

The tagger learns from labelled spans in windows of text: a bounded sample of the windows in which the
patterns find something or nothing, without those where a match failed its check (a number that is no
valid card may be a mistyped one). It reads overlapping windows over the whole text. A span must hold
a digit or an `@`, so windows without either are passed over, unless a span of the next window is cut
there; no span is lost by that. The spans of all windows are reconciled per text: parts of one span that
overlapping windows cut are joined, however long it is, and of the spans that overlap, the set with the
largest total lead stays.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightops.llm.common import map_texts
from flightops.llm.tagger import KINDS, Tagger, char_classes

WIDTH, STEP = 96, 48  # characters in a window and between two windows' starts
LABELLED_WINDOWS = 600  # the most windows that training uses
LEAST_CHARS, LEAST_LEAD = 7, 1.0  # of a span that the tagger adds; the lead is per character
BATCH = 1024

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]")
DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # start, kind, end


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the longest local part before an `@` that a domain follows."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            floor = match.end()
            found.append((start, floor))
        at = text.find("@", floor if match else at + 1)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, by start and kind, and the matches that failed their check."""
    good: list[Span] = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    bad: list[Span] = []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            fits = all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m.group().split("."))
            (good if fits else bad).append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            fits = 12 <= len(digits) <= 19 and luhn(digits)
            (good if fits else bad).append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                fits = 9 <= len(DIGIT.findall(m.group())) <= 15
                (good if fits else bad).append((m.start(), 3, m.end()))
    return sorted(good), bad


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an `@`."""
    starts: list[int] = []
    last = max(0, -(-(len(text) - WIDTH) // STEP)) * STEP
    for m in ANCHOR.finditer(text):
        low = max(0, (m.start() - WIDTH) // STEP + 1) * STEP
        for at in range(max(low, starts[-1] + STEP if starts else 0), min(m.start(), last) + 1, STEP):
            starts.append(at)
    return starts


def reconciled(spans: list[tuple[int, int, int, float]]) -> list[Span]:
    """Of spans (start, kind, end, lead), those without overlaps whose leads have the largest sum."""
    spans = sorted(set(spans), key=lambda s: (s[2], s[0], s[1], s[3]))
    ends, best = [s[2] for s in spans], [(0.0, -1, -1)]
    for i, (start, _, _, lead) in enumerate(spans):
        before = min(bisect_right(ends, start), i)
        take = best[before][0] + lead
        best.append((take, i, before) if take > best[-1][0] else (best[-1][0], -1, i))
    out, at = [], len(spans)
    while at > 0:
        _, i, before = best[at]
        if i >= 0:
            out.append(spans[i][:3])
        at = before
    return out[::-1]


Part = tuple[int, int, int, float, bool, bool]  # start, kind, end, lead, cut at the start, cut at the end


def joined(parts: list[Part]) -> list[tuple[int, int, int, float]]:
    """Spans (start, kind, end, mean lead): the whole parts, and chains of overlapping parts that cut ends link.

    A chain counts if neither of its ends is cut; the mean is that over the characters of all its parts.
    """
    out: list[tuple[int, int, int, float]] = []
    start = kind = end = size = 0
    lead, first, last = 0.0, True, True

    def close() -> None:
        if size and not first and not last:
            out.append((start, kind, end, lead / size))

    for a, k, b, own, left, right in sorted(parts, key=lambda p: (p[1], p[0], p[2])):
        if not (size and last and left and k == kind and a < end):
            close()
            start, kind, end, size, lead, first, last = a, k, b, 0, 0.0, left, right
        elif b >= end:
            end, last = b, right
        size, lead = size + b - a, lead + own
    close()
    return out


def tagged_parts(model: Tagger, texts: list[str]) -> list[list[Part]]:
    """What the tagger finds in each window of each text; a window next to a cut part is read as well."""
    found: list[list[Part]] = [[] for _ in texts]
    places = [(i, at) for i, text in enumerate(texts) for at in window_starts(text)]
    known = set(places)
    while places:
        near: set[tuple[int, int]] = set()
        for low in range(0, len(places), BATCH):
            group = places[low : low + BATCH]
            x = np.zeros((len(group), WIDTH), np.int64)
            for row, (i, at) in enumerate(group):
                code = char_classes(texts[i][at : at + WIDTH])
                x[row, : len(code)] = code
            tags, lead = model.decode(x)
            for row in np.flatnonzero(tags.any(axis=1)).tolist():
                i, at = group[row]
                line, n = tags[row], len(texts[i])
                for first in np.flatnonzero(line % 2 == 1).tolist():
                    end = first + 1
                    while end < WIDTH and line[end] == line[first] + 1:
                        end += 1
                    left, right = first == 0 and at > 0, end == WIDTH and at + end < n
                    near.update([(i, at - STEP)] * left + [(i, at + STEP)] * right)
                    stop = min(at + end, n)
                    own = float(lead[row, first : stop - at].sum())
                    if stop > at + first:
                        found[i].append((at + first, int(line[first] - 1) // 2, stop, own, left, right))
        places = sorted(near - known)
        known |= near
    return found


def added_spans(model: Tagger, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """The tagger's spans of each text that do not touch the text's base spans."""
    out = []
    for text, parts, own in zip(texts, tagged_parts(model, texts), base, strict=True):
        starts: list[int] = []  # of the characters that base spans cover, as runs
        ends: list[int] = []
        for a, _, b in sorted(own):
            if ends and a <= ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        free = []
        for a, kind, b, mean in joined(parts):
            run = bisect_right(ends, a)
            touches = run < len(starts) and starts[run] < b
            if not touches and b - a >= LEAST_CHARS and mean >= LEAST_LEAD and ANCHOR.search(text, a, b):
                free.append((a, kind, b, mean * (b - a)))
        out.append(reconciled(free))
    return out


class _Spans:
    """Spans by start, for looking up those that meet a window."""

    def __init__(self, spans: list[Span]) -> None:
        self.spans = spans
        self.starts = [s[0] for s in spans]
        self.reach = list(accumulate((s[2] for s in spans), max))

    def meeting(self, low: int, high: int) -> list[Span]:
        some = self.spans[bisect_right(self.reach, low) : bisect_left(self.starts, high)]
        return [s for s in some if s[2] > low]


def labelled_windows(docs: DataFrame) -> DataFrame:
    """(window, tags): windows of docs (text) with a digit or an `@`, labelled by the patterns' spans.

    Windows where a match failed its check or a span is cut are left out.
    """

    def label(texts: list[str | None]) -> list[list]:
        out = []
        for text in texts:
            rows = []
            starts = window_starts(text) if text else []
            good, bad = base_spans(text) if starts else ([], [])
            good, bad = _Spans(good), _Spans(sorted(bad))
            for at in starts:
                end = at + WIDTH
                near = good.meeting(at, end)
                short = any(s[1] != 2 or s[2] - s[0] > 9 for s in bad.meeting(at, end))
                if short or any(s[0] < at or s[2] > end for s in near):
                    continue
                tags = np.zeros(WIDTH, np.int32)
                for start, kind, stop in reversed(near):
                    tags[start - at : stop - at] = 2 * kind + 2
                    tags[start - at] = 2 * kind + 1
                rows.append({"window": text[at:end], "tags": tags.tolist()})
            out.append(rows)
        return [out]

    rows = map_texts(docs, [], "rows array<struct<window:string,tags:array<int>>>", label)
    return rows.select(F.inline("rows"))


def train(docs: DataFrame, windows: int = LABELLED_WINDOWS) -> Tagger | None:
    """A tagger from at most `windows` different labelled windows of docs, first in hash order.

    Half of the sample may be windows without a span. None if there is no window with a span.
    """
    rows = labelled_windows(docs).groupBy("window").agg(F.min("tags").alias("tags"))
    order = F.xxhash64("window")
    some = F.exists("tags", lambda t: t > 0)
    parts = [rows.filter(some), rows.filter(~some)]
    known, empty = (part.orderBy(order, "window").limit(windows // 2).collect() for part in parts)
    if not known:
        return None
    x, y = np.zeros((2, len(known) + len(empty), WIDTH), np.int64)
    for i, (window, tags) in enumerate([*known, *empty]):
        x[i, : len(window)], y[i] = char_classes(window), tags
    model = Tagger()
    model.fit(x, y)
    return model.narrow()


SPANS = "spans array<struct<start:int,kind:string,end:int,base:boolean>>"


def find(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """doc_id and spans for every row of docs (doc_id, text), repeated ones too.

    A span has start and end in characters (end exclusive), its kind, and whether a pattern found it;
    spans stand by start, then in the order of KINDS. Spans of different patterns may overlap, those
    the tagger adds overlap none. Texts are read whole, in time proportional to their length, and a span may be
    of any length. A null text is an empty one, without spans; an empty table gives no
    rows. Without a model the patterns' spans are all. Other columns are not read.
    """

    def spans(texts: list[str | None]) -> list[list]:
        texts = [t or "" for t in texts]
        base = [base_spans(t)[0] for t in texts]
        more = added_spans(model, texts, base) if model else [[] for _ in texts]
        out = []
        for good, extra in zip(base, more, strict=True):
            rows = sorted([(*s, True) for s in good] + [(*s, False) for s in extra])
            out.append([{"start": a, "kind": KINDS[k], "end": b, "base": own} for a, k, b, own in rows])
        return [out]

    return map_texts(docs, ["doc_id"], SPANS, spans)


def listed(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
