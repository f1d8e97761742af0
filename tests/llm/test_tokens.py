"""Whole-text ids, packing and token files against the tokenizers library."""
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import SF_SMALL
from helpers import docs, odd_texts
from tokenizers import Tokenizer

from vacanta.llm import huffman, pack, queries
from vacanta.llm.common import new_path, stored
from vacanta.llm.tokens import Encoder, token_ids

FILES = [("byte_bpe_50k.json", 0), ("word_bpe_49k.json", 1)]
ODD = ["", " ", "a  b", "\tx y", "a\n\nb c", "it's John's we'll", "x \n y", "a\t b", "a\t \tb", "日本語 テキスト", "é́ İstanbul ΣΑΣ ς",
       "<|endoftext|> hi", "a b c  d", "1234 5.6 ,,, ''s", "\0zero \0", "end ", "don't stop!!! a'll", "''re x're", "A\r\nB",
       "a\x1cb c\x85 d", "́x ́y", "x" * 5000, "\n", "\nx", "x\n", "a,b c.d\ne;f", "''", "don ' t"]


@pytest.mark.parametrize("name,end", FILES)
def test_units_give_the_ids_of_whole_texts(spark, name, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    rng = random.Random(0)
    texts += ["".join(rng.choice("ab'sé .,\n\t !Z9") for _ in range(30)) for _ in range(500)]
    for cache in (1 << 20, 10):
        coder = Encoder(public_tokenizers.path(name), end, max_units=cache)
        for k in range(0, len(texts), 50):
            for text, ids in zip(texts[k:k + 50], coder.encode(texts[k:k + 50])):
                assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, end], repr(text)


def test_fullest_and_plan():
    rng = random.Random(1)
    for _ in range(200):
        room = rng.randrange(1, 40)
        available = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        items = [k for k, c in available.items() for _ in range(c)]
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums if s + x <= room}
        best = pack.fullest(available, room)
        assert sum(k * c for k, c in best.items()) == max(sums)
        assert all(c <= available[k] for k, c in best.items())
    counts = Counter(min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    bins = pack.plan(dict(counts))
    used = Counter()
    for times, own in bins:
        assert times > 0 and sum(k * c for k, c in own.items()) <= 2048
        used.update({k: c * times for k, c in own.items()})
    assert used == counts
    least = -(-sum(k * c for k, c in counts.items()) // 2048)
    assert sum(t for t, _ in bins) <= least * 1.005 + 1


def ids_of(rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in rows]


def check_packing(got, rows, capacity=2048):
    documents, places = ids_of(rows), {}
    pieces = Counter()
    for d, ids in documents:
        n = len(ids)
        first = (n - 1) % capacity + 1
        for k, (a, b) in enumerate([(0, first), *((a, a + capacity) for a in range(first, n, capacity))]):
            pieces[d, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(len(i) for _, i in documents)
    return len(places), -(-total // capacity)


def test_packing_of_odd_documents(spark):
    from pyspark.sql import functions as F
    rows = odd_texts(random.Random(6)) + [(50 + k, "w " * (300 * k % 2500)) for k in range(30)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = pack.pack(docs(spark, rows), path)
    used, least = check_packing(packed.withColumn("ids_crc32", F.crc32("ids")).collect(), rows)
    assert used <= least + 3
    assert pack.pack(docs(spark, rows).limit(0), path).count() == 0


def test_packing_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    used, least = check_packing(queries.queries()["op5_packing"](spark, SF_SMALL).collect(), rows)
    assert used <= least + 1


def huffman_cost(counts):
    import heapq
    heap = list(counts)
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    return total


def test_code_lengths_are_optimal_and_limited():
    rng = random.Random(8)
    counts = {s: rng.randrange(1, 1000) for s in range(300)}
    lengths = huffman.code_lengths(counts)
    assert sum(counts[s] * b for s, b in lengths.items()) == huffman_cost(counts.values())
    steep = {s: 1 << s for s in range(40)}  # unlimited codes would have 39 bits
    lengths = huffman.code_lengths(steep, 8)
    assert max(lengths.values()) <= 8 and sum(2.0 ** -b for b in lengths.values()) <= 1
    assert huffman.code_lengths({}) == {} and huffman.code_lengths({5: 9}) == {5: 1}


def test_round_trip_of_all_segment_sizes():
    rng = np.random.default_rng(0)
    ids = (rng.zipf(1.3, 5000) % 49408).astype(np.uint32)
    code = huffman.Code(huffman.code_lengths(dict(Counter(ids.tolist()))))
    for n in (0, 1, 2, 255, 256, 257, 512, 1000, 5000):
        bits, marks = code.encode(ids[:n])
        assert code.decode(bits, marks, n).tolist() == ids[:n].tolist()


def test_token_file_round_trip(spark, monkeypatch):
    rows = odd_texts(random.Random(7))
    path = public_tokenizers.path("word_bpe_49k.json")
    given = stored(token_ids(docs(spark, rows), path, 1), "ids")
    folder = new_path(spark, "file")
    huffman.write(given, folder)
    got = sorted(huffman.read(spark, folder).collect(), key=lambda r: r.start)
    want = sorted(((r.doc_id is not None, r.doc_id or 0, r.ids) for r in given.collect()))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    empty = new_path(spark, "empty")
    huffman.write(stored(token_ids(docs(spark, rows).limit(0), path, 1), "none"), empty)
    assert huffman.read(spark, empty).count() == 0


def test_token_file_query(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    at, want = 0, []
    for d, t in rows:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        want.append((d, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    got = queries.queries()["op10_token_files"](spark, SF_SMALL).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want


SPECIAL = ["<|endoftext|>", "a <|endoftext|> b", "x<|startoftext|>y <|ENDOFTEXT|>", "<|endoftext|><|endoftext|>  ", "no <|endoftext| here"]


@pytest.mark.parametrize("name,end", FILES)
def test_special_strings_as_the_library_reads_them(name, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    coder = Encoder(public_tokenizers.path(name), end, special=True)
    for text, ids in zip(SPECIAL + ODD, coder.encode(SPECIAL + ODD)):
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, end], repr(text)


def test_queries_on_special_strings(spark, tmp_path):
    """op5 and op10 give the ids of the plain library, counts included."""
    rows = [(k, t) for k, t in enumerate(SPECIAL + ["plain words here", None])]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    for query, name, end in (("op5_packing", FILES[0][0], 0), ("op10_token_files", FILES[1][0], 1)):
        tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        want = {}
        for d, t in rows:
            ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]
            want[d] = zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        got = queries.queries()[query](spark, str(tmp_path)).collect()
        assert {r["doc_id"]: r["ids_crc32"] for r in got} == want and len(got) == len(rows)


def test_ids_that_do_not_fit_raise(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    with pytest.raises(Exception, match="does not fit"):
        token_ids(docs(spark, ["a text"]), path, 1 << 17, kind="<u2").collect()
    assert token_ids(docs(spark, ["a text"]), path, 1 << 17).count() == 1


def test_counts_beside_the_ids(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    found = token_ids(docs(spark, [(None, "a b a"), (2, None)]).repartition(3), path, 1, counted=True)
    total = Counter()
    for r in found.where("counts IS NOT NULL").collect():
        assert r.doc_id is None and r.ids is None
        total.update({k: int(n) for k, n in enumerate(np.frombuffer(r.counts, np.int64)) if n})
    want = Counter()
    for r in found.where("counts IS NULL").collect():
        want.update(np.frombuffer(r.ids, "<u4").tolist())
    assert total == want and sum(want.values()) == 5
