"""SimHash fingerprints, BK-trees, links and components against brute force."""
import random

import numpy as np
import xxhash
from conftest import SF_SMALL
from helpers import docs, odd_texts, sentence

from vacanta.llm import queries, simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(pairs, n):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    found = groups(near, len(rows))
    low = {}
    for g, (doc, _) in zip(found, rows):
        if doc is not None:
            low[g] = min(low.get(g, doc), doc)
    return sorted((str(d), f"{p:016x}", str(low.get(g))) for (d, _), p, g in zip(rows, prints, found))


def test_fingerprint_is_the_definition():
    rng = random.Random(1)
    for _, t in odd_texts(rng) + [(0, "One two"), (0, "A b\tC\nd A b\tC"), (0, sentence(rng, 300))]:
        assert simhash.fingerprint(t.encode() if t is not None else None) == plain_fingerprint(t)


def test_tree_search_finds_all_in_the_radius():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = values[:100] ^ (np.uint64(1) << rng.integers(0, 63, 100, dtype=np.uint64))
    values = np.unique(np.concatenate([values, near]))
    found = {(int(n), int(q)) for n, own in simhash.BKTree(values).search(values, 3) for q in own}
    assert found == {(i, j) for i in range(len(values)) for j in range(len(values))
                     if np.bitwise_count(values[i] ^ values[j]) <= 3}


def test_links_of_a_hot_shard_in_parts(spark):
    """Near copies that share nearly all bits, split into parts of a few members."""
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    values = {centre}
    for _ in range(400):
        v = rng.choice(sorted(values)) if rng.random() < 0.3 else centre
        for _ in range(rng.randrange(1, 6)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    values |= {rng.getrandbits(64) for _ in range(100)}
    values = sorted(values)
    expected = groups([(i, j) for i in range(len(values)) for j in range(i)
                       if (values[i] ^ values[j]).bit_count() <= 3], len(values))
    distinct = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    for size in (16, 4096):
        edges = simhash.links(distinct, part_size=size)
        at = {v: i for i, v in enumerate(values)}
        pairs = [(at[r.a % (1 << 64)], at[r.b % (1 << 64)]) for r in edges.collect()]
        assert groups(pairs, len(values)) == expected


def test_more_blocks_give_the_same_links(monkeypatch, spark):
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(80)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values]
    distinct = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in set(values)], "fp long")
    found = []
    for blocks in (4, 5, 6):
        monkeypatch.setattr(simhash, "block_count", lambda n, radius=3, b=blocks: b)
        found.append(sorted((r.a, r.b) for r in simhash.components(simhash.links(distinct)).toDF("a", "b").collect()))
    assert found[0] == found[1] == found[2]


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 1100)]
    got = dict(simhash.components(spark.createDataFrame(path + star + [(7, 7)], "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(200)) and got[5000] == 1000
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_equal_brute_force(spark):
    rng = random.Random(2)
    base = [sentence(rng, 200) for _ in range(12)]
    rows = [(100 + k, t) for k, t in enumerate(base)]
    for k in range(40):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "x"
        rows.append((50 + k, " ".join(words)))
    rows += [r for r in odd_texts(rng) if r[0] != 4]
    given = docs(spark, rows)
    got = simhash.near_duplicates(given).collect()
    assert sorted((str(r.doc_id), f"{r.fp % (1 << 64):016x}", str(r.component_id)) for r in got) == brute(rows)

    kept = simhash.deduplicate(given)
    assert kept.columns == given.columns
    expected = {c for _, _, c in brute(rows)}
    ids = [str(r.doc_id) for r in kept.collect()]
    assert set(ids) == expected and len(ids) == len(expected)
    assert simhash.near_duplicates(given.limit(0)).count() == 0 == simhash.deduplicate(given.limit(0)).count()


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = queries.queries()["op8_simhash"](spark, SF_SMALL)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got.collect()) == brute(rows)
