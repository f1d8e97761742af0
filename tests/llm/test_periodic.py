"""Lyndon arrays and runs against their definitions, the query against its contract."""
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF_SMALL
from helpers import docs, odd_texts

from vacanta.llm import periodic as P
from vacanta.llm import queries


def longest_lyndon(s: list) -> list[int]:
    return [max(j - i for j in range(i + 1, len(s) + 1) if all(s[i:j] < s[k:j] for k in range(i + 1, j))) for i in range(len(s))]


def runs(s: list, min_words: int, min_periods: int) -> list[tuple[int, int, int]]:
    """Every stretch by period; one whose words have a smaller period is another period's."""
    out, s = [], np.unique(np.array(s, object), return_inverse=True)[1] if len(s) else np.empty(0, int)
    for q in range(1, len(s) // min_periods + 1):
        equal = np.concatenate([[0], s[:-q] == s[q:], [0]]).astype(int)
        for i, j in zip(np.flatnonzero(np.diff(equal) == 1), np.flatnonzero(np.diff(equal) == -1)):
            n = int(j - i) + q
            if n >= max(min_words, min_periods * q) and not any((s[i:i + n - r] == s[i + r:i + n]).all() for r in range(1, q)):
                out.append((int(i), n, q))
    return sorted(out)


def test_lyndon_arrays():
    rng = random.Random(1)
    for _ in range(150):
        texts = [[rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(0, 22))] for _ in range(rng.randrange(1, 9))]
        w = P.Words(texts)
        for sign, lengths in ((1, P.lyndon_lengths(w)), (-1, P.lyndon_lengths(w, reverse=True))):
            for b, text in zip(w.base, texts):
                numbers = w.word[b:b + len(text)].tolist()
                order = [sign * ((k + 1) // 2 if k % 2 else -(k // 2)) for k in numbers]
                assert lengths[b:b + len(text)].tolist() == longest_lyndon(order)


def test_runs_equal_definition():
    rng = random.Random(2)
    for _ in range(120):
        texts = []
        for _ in range(rng.randrange(1, 7)):
            s = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(0, 14))]
            texts.append((s * rng.randrange(1, 5))[:40] + s[:rng.randrange(4)])
        w = P.Words(texts)
        for least, periods in ((1, 2), (1, 3), (6, 3), (2, 4)):
            expected = sorted((b + i, n, q) for b, s in zip(w.base.tolist(), texts) for i, n, q in runs(s, least, periods))
            assert P.find_runs(w, least, periods) == expected, (texts, least, periods)
    with pytest.raises(ValueError):
        P.find_runs(w, 1, 1)


def test_very_long_repeats():
    """One word, a period of many words, and nested periods, each in a long text."""
    block = list(range(5000))
    nested = ([1, 2] * 20 + [3]) * 400
    w = P.Words([[7] * 100_000, block * 6 + block[:9], nested])
    got = {(i - w.base[np.searchsorted(w.base, i, "right") - 1], n, q) for i, n, q in P.find_runs(w)}
    assert {(0, 100_000, 1), (0, 30_009, 5000), (0, 16_400, 41), (0, 40, 2), (41, 40, 2)} <= got
    assert len(got) == 3 + 400


def contract(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), None if doc is None else zlib.crc32(str(doc).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = runs(words, 24, 3)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(found), *best, best[0] is not None and math.floor(1000 * best[1] / best[2]) or None,
            sha("".join(f"{s},{k},{q}\n" for s, k, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def check(spark, tmp_path, given, rows):
    given.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 6 + ["string"] * 2
    key = lambda r: (r[0] is None, r[0] or 0, r[6:])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((contract(*r) for r in rows), key=key)


def test_odd_documents(spark, tmp_path):
    rng = random.Random(8)
    rows = odd_texts(rng) + [(30 + k, " ".join(rng.choice(["aa", "b"]) for _ in range(120))) for k in range(120)]
    rows += [(400, "go " * 30_000), (401, "a b c d " * 40), (402, "x y z " * 9 + "x y"), (403, ("p q " * 13 + "r ") * 5)]
    check(spark, tmp_path, docs(spark, rows), rows)


def test_no_documents(spark, tmp_path):
    check(spark, tmp_path, docs(spark, []), [])


def test_periodic_query(spark, tmp_path):
    given = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    check(spark, tmp_path, given, [tuple(r) for r in given.select("doc_id", "text").collect()])


def test_slices_do_not_matter(spark, monkeypatch):
    given = docs(spark, odd_texts(random.Random(8)) + [(k, "one two three " * (k % 40)) for k in range(300)])
    whole = sorted(map(str, P.periodic_runs(given).collect()))
    small = sorted(map(str, P.periodic_runs(given.repartition(7)).collect()))
    assert whole == small
