"""Trie counts against a segmentation of each word on its own."""
import random

import public_tokenizers
from conftest import SF_SMALL
from helpers import docs, odd_texts

from vacanta.llm import queries
from vacanta.llm import token_counts as K

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def best(word, scores, byte_score):
    """(score, -tokens) of the best segmentation, by recursion over the last piece."""
    table = [(0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(table[end - 1][0] + byte_score * size, table[end - 1][1] - size)]
        for start in range(end):
            if word[start:end] in scores:
                options.append((table[start][0] + scores[word[start:end]], table[start][1] - 1))
        table.append(max(options))
    return table[-1]


def test_trie_equals_single_words():
    scores = K.unigram_scores(MODEL)
    low = min(scores.values())
    trie, rng = K.Trie(scores), random.Random(4)
    words = ["▁" + "".join(rng.choice("abeinrst日é") for _ in range(rng.randrange(1, 12))) for _ in range(800)]
    words += ["▁the", "▁there", "▁therefore", "▁", "▁" + "a" * 300, "▁🙂x"]
    for w in words + words:
        n, score = trie.insert(w)
        assert (score, -n) == best(w, scores, low), w


def test_long_pre_tokens_are_scored_alone():
    scores, rng = K.unigram_scores(MODEL), random.Random(6)
    trie = K.Trie(scores)
    for n in (1, 40, K.LONG + 50):
        word = "▁" + "".join(rng.choice("abeinrst日é") for _ in range(n))
        assert trie.alone(word) == trie.insert(word)
        score, tokens = best(word, scores, min(scores.values())) if n < 100 else (trie.alone(word)[1], -trie.alone(word)[0])
        assert trie.alone(word) == (-tokens, score)
    assert len(trie.score) < 60  # the long one left no nodes


def test_prefixes_are_computed_once():
    trie = K.Trie({"a": -1, "ab": -1, "b": -3})
    trie.insert("ab")
    nodes = len(trie.score)
    assert trie.insert("ab") == (1, -1) and len(trie.score) == nodes
    trie.insert("abb")
    assert len(trie.score) == nodes + 1


def test_documents(spark):
    scores = K.unigram_scores(MODEL)
    low, rows = min(scores.values()), odd_texts(random.Random(5))
    rows = [(d, t if t is None or len(t) < 20_000 else t[:3000]) for d, t in rows]
    want = []
    for d, t in rows:
        found = [best("▁" + w.decode(), scores, low) for w in (t or "").encode().split()]
        want.append((str(d), len(found), -sum(n for _, n in found), sum(s for s, _ in found)))
    for limit in (1_000_000, 50):  # a trie that starts anew gives the same
        got = K.token_counts(docs(spark, rows), MODEL, max_nodes=limit).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_tokens, r.score) for r in got) == sorted(want)
    assert K.token_counts(docs(spark, rows).limit(0), MODEL).count() == 0


def test_query(spark):
    scores = K.unigram_scores(MODEL)
    low, known = min(scores.values()), {}
    got = {r.doc_id: r for r in queries.queries()["op9_token_counts"](spark, SF_SMALL).collect()}
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        words = r.text.encode().split()
        for w in words:
            if w not in known:
                known[w] = best("▁" + w.decode(), scores, low)
        assert got[r.doc_id].n_tokens == -sum(known[w][1] for w in words) and got[r.doc_id].n_words == len(words)
