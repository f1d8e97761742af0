"""Periodic runs of words by Baier's grouping.

A run is a longest stretch of words with smallest period q. Each run holds a Lyndon
root: under one of the two orders of the words, the longest Lyndon word that starts at
the root's place is one period long. So the method is:

1. Phase one of Baier's suffix sorter groups a document's suffixes by their longest
   Lyndon prefix. Groups are taken from the highest down. A member's left neighbour, if
   it lies in a lower group, is extended by the member (by k of them where k equal ones
   follow each other) and moves to a new group right above its old one. A group's
   context length, at the time it is taken, is the Lyndon array at its members: no
   suffix array is needed. Done for the order of the word numbers and for its reverse.
2. A place i with Lyndon length p is a root if the words from i on repeat p words later;
   the common extensions of i and i + p to both sides (LCE) bound the run.
3. Runs found from several roots or under both orders are one run.

The grouping is in lockstep: a step takes the highest group left of *every* document of
a slice, so that numpy works on thousands of words at a time. Documents of like length
share a slice; a slice holds about ``SLICE_BYTES`` of text (a longer text is one of its
own), which bounds memory. No shuffle.

Defined cases: a null text counts as empty; a text without words has no run and an
empty collapsed text; repeated rows are kept; a null doc_id is kept. Other columns are
not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A run holds at least so many words and so many periods.
MIN_WORDS, MIN_PERIODS = 24, 3
SLICE_BYTES = 6 << 20

_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


class Words:
    """The words of a slice's documents as numbers, in order of first sight within their
    document: document d has the places from ``base[d]`` on, ``size[d]`` of them, and an
    end mark (-1) after them; place 0 is an end mark too, so every document has one on
    both sides."""

    def __init__(self, docs: list[list]):
        self.size = np.fromiter(map(len, docs), np.int64, len(docs))
        self.base = 1 + np.cumsum(self.size + 1) - (self.size + 1)
        self.word = np.full(1 + int((self.size + 1).sum()), -1, np.int64)
        for b, words in zip(self.base.tolist(), docs):
            seen = dict(zip(dict.fromkeys(words), count()))
            self.word[b:b + len(words)] = list(map(seen.__getitem__, words))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), then start[1], ..."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def lyndon_lengths(w: Words, reverse: bool = False) -> np.ndarray:
    """At every place the length of the longest Lyndon word that starts there (0 at end
    marks). Any order of the words serves; here a document's first word is in the middle,
    its second new word above it, its third below both, and so on. A word below all words
    before it ends every Lyndon word that starts before it, so the document falls into
    stretches that are grouped each on its own; under the reverse order the words that
    are above all before do the same."""
    k = w.word
    odd = (k & 1).astype(bool)
    value = np.where(odd, (k + 1) >> 1, -(k >> 1))
    rows = np.repeat(np.arange(len(w.size)), w.size + 1)
    highest = np.maximum.accumulate(k[1:] + rows * (int(k.max()) + 2))
    new = np.append([True, True], np.diff(highest) != 0)  # document starts and first sights
    cut = new & (~odd if not reverse else odd | (k == 0))
    cut[k < 0] = False
    cut[w.base[w.size > 0]] = True
    at = np.flatnonzero(cut)
    ends = np.append(at[1:], len(k))
    marks = np.cumsum(k < 0)
    size = ends - at - (marks[ends - 1] - marks[at])
    length = (k >= 0).astype(np.int64)
    long = size > 1
    at, size = at[long], size[long]
    if len(at):
        places = _ranges(at, size)
        length[places] = _grouped(-value[places] if reverse else value[places], size)
    return length


def _grouped(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Lyndon lengths of separate stretches (``size`` words each), in lockstep: a step
    takes the highest group left of every stretch. Each stretch gets an end mark, which
    is below every word and never taken."""
    n, lanes = len(value), len(size)
    low = 1 + np.cumsum(size + 1) - (size + 1)
    places = 1 + n + lanes
    lane = np.repeat(np.arange(lanes), size)
    of_word = 1 + np.arange(n) + lane
    width = int(value.max()) - int(value.min()) + 2
    key = np.empty(places, np.int64)
    key[0] = -1
    key[of_word] = lane * width + (value - int(value.min()) + 1)
    key[low + size] = np.arange(lanes) * width
    # Suffixes by group, groups ascending within a stretch; a group is named by its first slot.
    suffix = np.argsort(key, kind="stable")
    slot = np.empty(places, np.int64)
    slot[suffix] = np.arange(places)
    ordered = key[suffix]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    group = np.empty(places, np.int64)
    group[suffix] = np.repeat(starts, np.diff(starts, append=places))
    group[0] = places  # stands left of every first word: never lower
    end = np.zeros(places, np.int64)
    end[starts] = np.append(starts[1:], places)
    context = np.ones(places, np.int64)
    left = np.arange(-1, places - 1)  # the place whose context ends right before, or 0
    left[low] = 0
    moving = np.zeros(places, bool)
    length = np.zeros(places, np.int64)

    top = low + size + 1
    while len(low):
        members = suffix[top - 1]
        own = group[members]
        taken = top - own
        top = own
        if taken.max() > 1:
            members, own = suffix[_ranges(own, taken)], np.repeat(own, taken)
        u = context[own]
        length[members] = u
        before = left[members]
        at = group[before]
        times = None
        chained = at == own
        if chained.any():  # equal neighbours: one extension by all of them
            by_place = np.argsort(members)
            members, before, at, u, own, chained = (x[by_place] for x in (members, before, at, u, own, chained))
            leaders = np.flatnonzero(~chained)
            times = np.diff(leaders, append=len(members))
            members, before, at, u, own = (x[leaders] for x in (members, before, at, u, own))
        lower = at < own
        if not lower.all():
            members, before, at, u = members[lower], before[lower], at[lower], u[lower]
            times = None if times is None else times[lower]
        grown = u if times is None else u * times
        left[members + grown] = before
        among = end[at] - at > 1
        if not among.all():  # a group of one keeps its name
            alone = ~among
            context[at[alone]] += grown[alone]
            before, at, grown = before[among], at[among], grown[among]
            times = None if times is None else times[among]
        if len(at):
            _split(at, before, grown, times, group, end, context, suffix, slot, moving)
        alive = top > low + 1
        if not alive.all():
            low, top = low[alive], top[alive]
    return length[of_word]


def _split(old, mover, grown, times, group, end, context, suffix, slot, moving) -> None:
    """Move each ``mover`` out of its ``old`` group into a new one right above; movers that
    grew by more repeats (``times``) come higher."""
    by_group = np.argsort(old if times is None else old * len(group) + times, kind="stable")
    old, mover, grown = old[by_group], mover[by_group], grown[by_group]
    first = np.append(True, old[1:] != old[:-1])
    heads = np.flatnonzero(first)
    n_moved = np.diff(heads, append=len(old))
    stay_end = end[old[heads]] - n_moved
    target = _ranges(stay_end, n_moved)
    # Suffixes that stay give up the group's last slots for those that the movers leave.
    moving[mover] = True
    there = suffix[target]
    displaced = there[~moving[there]]
    moving[mover] = False
    if len(displaced):
        from_slot = slot[mover]
        vacated = from_slot[from_slot < np.repeat(stay_end, n_moved)]
        suffix[vacated] = displaced
        slot[displaced] = vacated
    suffix[target] = mover
    slot[mover] = target
    if times is not None:
        times = times[by_group]
        first[1:] |= times[1:] != times[:-1]
    names = np.flatnonzero(first)
    sizes = np.diff(names, append=len(old))
    name = target[names]
    contexts = context[old[names]] + grown[names]
    end[old[heads]] = stay_end
    end[name] = name + sizes
    context[name] = contexts
    group[mover] = np.repeat(name, sizes)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common start of two equally long arrays, read in growing blocks."""
    at, block = 0, 64
    while at < len(a):
        differ = a[at:at + block] != b[at:at + block]
        if differ.any():
            return at + int(differ.argmax())
        at, block = at + block, block * 4
    return len(a)


def find_runs(w: Words, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(place, length, period) of every run of at least ``min_words`` words and
    ``min_periods`` (2 or more) periods, sorted."""
    if min_periods < 2:
        raise ValueError("a run holds two periods at least")
    s, found = w.word, set()
    for reverse in (False, True):
        length = lyndon_lengths(w, reverse)
        root = np.flatnonzero(length)
        p = length[root]
        # From its first root on, a run of c periods repeats for (c - 2) periods and one word at least.
        for half in (0, 2, 1):  # cheap looks at both ends and the middle of that stretch
            offset = (min_periods - 2) * p * half // 2
            inside = root + p + offset < len(s)
            root, p, offset = root[inside], p[inside], offset[inside]
            equal = (s[root + offset] == s[root + p + offset]) & (s[root + offset] >= 0)
            root, p = root[equal], p[equal]
        order = np.lexsort((root, p))
        last = (0, -1)  # period and last place of the run before
        for i, q in zip(root[order].tolist(), p[order].tolist()):
            if last[0] == q and i + (min_periods - 1) * q <= last[1]:
                continue  # a further root of it
            ahead = _common(s[i:len(s) - q], s[i + q:])
            back = _common(s[i - 1::-1], s[i + q - 1:q - 1:-1]) if i else 0
            start, n = i - back, back + ahead + q
            last = (q, start + n - 1)
            if n >= max(min_words, min_periods * q):
                found.add((start, n, q))
    return sorted(found)


def _slice_rows(ids: list, texts: list[bytes], schema: pa.Schema, min_words: int, min_periods: int) -> pa.RecordBatch:
    docs = [t.split() for t in texts]  # on bytes: ASCII white space only
    w = Words(docs)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    places = w.base.tolist()
    found = find_runs(w, min_words, min_periods)
    owner = np.searchsorted(w.base, [r[0] for r in found], side="right") - 1 if found else []
    for d, (place, n, q) in zip(owner, found):
        runs[d].append((place - places[d], n, q))
    collapsed = []
    for words, own in zip(docs, runs):
        if own:
            kept = np.ones(len(words), bool)
            for start, n, q in own:
                kept[start + q:start + n] = False
            words = [words[i] for i in np.flatnonzero(kept)]
        collapsed.append(b" ".join(words))
    best = [min(own, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if own else None for own in runs]
    as_rows = lambda r: dict(zip(("start", "length", "period"), r))
    return pa.record_batch([
        ids, w.size.tolist(), [[as_rows(r) for r in own] for own in runs],
        [b and as_rows(b) for b in best], pa.array(collapsed, pa.binary()).cast(pa.string())], schema=schema)


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """(doc_id, n_words, runs, strongest, collapsed): the runs of every document by start,
    then period; the one of greatest exponent (ties: smallest start, then period; null
    without runs); and the words outside of what repeats, joined by one space: a word
    goes if a run holds it after the run's first period."""
    from pyspark.sql.pandas.types import to_arrow_schema
    given = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    schema = T.StructType([given.schema["doc_id"], T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(_RUN)), T.StructField("strongest", _RUN),
                           T.StructField("collapsed", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}  # by length class: doc_ids, texts, [bytes]
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").fill_null(b"")):
                text = text.as_py()
                ids, texts, size = held.setdefault((len(text) >> 10).bit_length(), ([], [], [0]))
                ids.append(doc)
                texts.append(text)
                size[0] += len(text) + 64
                if size[0] >= SLICE_BYTES:
                    del held[(len(text) >> 10).bit_length()]
                    yield _slice_rows(ids, texts, arrow, min_words, min_periods)
        rest = [(i, t) for ids, texts, _ in held.values() for i, t in zip(ids, texts)]
        at, n = 0, 0
        for k, (_, t) in enumerate(rest):
            n += len(t) + 64
            if n >= SLICE_BYTES or k == len(rest) - 1:
                yield _slice_rows(*map(list, zip(*rest[at:k + 1])), arrow, min_words, min_periods)
                at, n = k + 1, 0

    return given.mapInArrow(run, schema)
