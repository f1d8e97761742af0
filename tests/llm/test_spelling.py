"""Spelling variants against all pairs, forms against chains followed one by one."""
import random
import re
import zlib
from collections import Counter, defaultdict

from conftest import SF_SMALL
from helpers import docs, odd_texts
from pyspark.sql import functions as F

from vacanta.llm import queries, spelling


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts: dict, ratio: int = 10) -> dict:
    """word -> (n, n_near, form, form_n, root) by the deletions that two words share."""
    by_cut = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            by_cut[w[:i] + w[i + 1:]].add(w)
        by_cut[w].add(w)
    out = {}
    for w in counts:
        cuts = {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}
        near = sorted({v for c in cuts for v in by_cut[c] if one_edit(w, v)}, key=lambda v: (-counts[v], v))
        form = near[0] if near and counts[near[0]] >= ratio * counts[w] else None
        out[w] = (counts[w], len(near), form, counts[form] if form else None)
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w] = (*out[w][:4], root)
    return out


def counted(rows, spoil=None, least=7, times=2) -> dict:
    counts = Counter()
    for doc, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for w in re.findall("[a-zÀ-ÿ]+", low):
            counts[spoil(doc, w) if spoil else w] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= times}


def as_dict(df) -> dict:
    rows = df.select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: tuple(r)[1:] for r in rows}


def test_index_equals_pairs():
    rng = random.Random(5)
    words = list({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))) for _ in range(400)})
    index = spelling.PositionIndex(words)
    for q in words[:150] + ["", "zzz", "ab"]:
        near, shared = index.near(q, 2)
        assert {words[i] for i in spelling._members(near)} == {w for w in words if one_edit(q, w)}, q
        assert {words[i] for i in spelling._members(shared)} == {w for w in words if len(q) >= 2 and w[:2] == q[:2]}


def test_equals_brute_force(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(7, 12))) for _ in range(60)]
    counts = {}
    for w in base:
        n = rng.choice([2, 30, 30, 400, 5000])
        counts[w] = n
        for _ in range(12):
            i, c = rng.randrange(len(w)), rng.choice("abcdeé")
            v = rng.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:]])
            if len(v) >= 7:
                counts[v] = rng.choice([2, 2, 3, max(2, n // 10)])
    counts |= {"chainaa": 3, "chainab": 40, "chainbb": 500, "cchainbb": 6000, "cchainbbq": 70_000}
    counts["x" * 3000] = 5
    counts["x" * 2999] = 50
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    expected = brute(counts)
    assert any(r[4] != w and expected[r[2]][2] for w, r in expected.items() if r[2])  # chains of two forms
    assert as_dict(spelling.variant_groups(table)) == expected


def test_hot_shard_in_blocks(spark):
    """One first part holds all words: its shard is cut into blocks, nothing is lost or counted twice."""
    rng = random.Random(2)
    counts = {"commonprefix" + "".join(rng.choice("abc") for _ in range(rng.randrange(3, 7))): rng.choice([2, 5, 300]) for _ in range(400)}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    expected = brute(counts)
    assert as_dict(spelling.variant_groups(table, block_words=16)) == expected
    assert as_dict(spelling.variant_groups(table, block_chars=500)) == expected


def test_vocabulary(spark):
    rng = random.Random(3)
    rows = odd_texts(rng) + [(20, "Straßen ÀÉÎÕÜßẞ straßen"), (21, "İstanbul istanbul x×÷abcdefg x×÷abcdefg"), (22, "Abcdefgh" * 3000 + " " + "abcdefgh" * 3000)]
    given = docs(spark, rows)
    got = {r["word"]: r["n"] for r in spelling.vocabulary(given).collect()}
    assert got == counted(rows)
    spoilt = {r["word"]: r["n"] for r in spelling.vocabulary(given, spoil=queries.misspelt).collect()}
    assert spoilt == counted(rows, queries.misspelt)
    none = spelling.variant_groups(spelling.vocabulary(given.where("doc_id < 0")))
    assert none.count() == 0


def test_spelling_query(spark):
    """The registered query on a whole table against its contract."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]

    def spoil(doc, w):
        h = zlib.crc32(f"{doc}:{w}".encode())
        return w if h % 31 else w[:h % len(w)] + w[h % len(w) + 1:]
    got = queries.QUERIES["op11_spelling_variants"](spark, SF_SMALL)
    assert as_dict(got) == brute(counted(rows, spoil))
    assert [f.dataType.simpleString() for f in got.select("word", "form", "root", "n", "n_near", "form_n").schema] == ["string"] * 3 + ["bigint"] * 3
    assert got.where(F.col("n") < 2).count() == 0
