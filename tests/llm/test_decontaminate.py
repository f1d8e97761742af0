"""Spaced seeds: lossless masks, brute force, odd tables, the DuckDB statement."""
import itertools
import random
import re

from conftest import SF_SMALL
from helpers import docs, odd_texts, sentence

from vacanta.llm import decontaminate as D
from vacanta.llm import queries
from vacanta.plans.compare import compare


def test_masks_find_every_window_with_the_allowed_substitutions():
    spans = [{o + k for o in m} for m in D.MASKS for k in range(D.WINDOW - max(m))]
    for changed in itertools.combinations(range(D.WINDOW), D.SUBSTITUTIONS):
        assert any(not span & set(changed) for span in spans), changed


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(texts, items):
    out = {}
    for doc, text in texts:
        d = words(text)
        for item, content in items:
            b = words(content)
            if len(b) < D.MIN_ITEM_TOKENS:
                continue
            width = min(D.WINDOW, len(b))
            needed = width if len(b) < D.WINDOW else D.WINDOW - D.SUBSTITUTIONS
            for diagonal in range(-len(b) + 1, len(d)):
                same = [0 <= j + diagonal < len(d) and d[j + diagonal] == b[j] for j in range(len(b))]
                best = max(sum(same[s:s + width]) for s in range(len(b) - width + 1))
                if best >= needed:
                    n, at = out.get((doc, item), (0, diagonal))
                    out[doc, item] = (max(n, best), min(at, diagonal))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(3)
    items = [(k, sentence(rng, rng.choice([7, 8, 10, 12, 13, 14, 25]))) for k in range(12)]
    items += [(12, None), (13, ""), (0, items[0][1])]
    texts = []
    for k in range(60):
        own = words(sentence(rng, 20))
        item = words(items[rng.randrange(12)][1])
        for _ in range(rng.randrange(4)):  # substitutions
            item[rng.randrange(len(item))] = "changed"
        cut = rng.randrange(4)
        at = rng.choice([0, 5, len(own)])
        texts.append((k, " ".join(own[:at] + item[cut:] + own[at:]).upper() + "!!"))
    texts += [t for t in odd_texts(rng) if t[0] != 4]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): (r.n_matched, r.doc_start) for r in D.overlaps(docs(spark, texts), bench).collect()}
    expected = brute(texts, items[:-1])
    assert got == expected and len(expected) > 20
    # The same rows without the broadcast.
    far = {(r.doc_id, r.item_id): (r.n_matched, r.doc_start)
           for r in D.overlaps(docs(spark, texts), bench, max_broadcast_bytes=0).collect()}
    assert far == expected
    kept = D.decontaminate(docs(spark, texts), bench)
    assert kept.columns == docs(spark, texts).columns
    leaked = {d for d, _ in expected}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in texts if d not in leaked)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
    given = docs(spark, ["a b c d e f g h i j k l m n"])
    assert D.overlaps(given, none).count() == 0
    assert D.overlaps(given.limit(0), some).count() == 0
    assert D.decontaminate(given, none).count() == 1
    assert D.decontaminate(given, some).count() == 0


def test_no_python_in_the_plan(spark, capsys):
    queries.queries()["op4_decontamination"](spark, SF_SMALL).explain()
    assert "Python" not in (plan := capsys.readouterr().out) and "Arrow" not in plan


def test_matches_duckdb(spark, duck):
    r = compare(queries.queries()["op4_decontamination"](spark, SF_SMALL), duck, queries.oracle_sql()["op4_decontamination"])
    assert r["match"], r
