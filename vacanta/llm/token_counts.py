"""Unigram token counts over a trie of pre-tokens.

A pre-token is a run of characters that are not ASCII white space, with the word mark
``▁`` before it. Its token count is that of its best segmentation under a unigram
model: the pieces of a public vocabulary, each scored by Zipf's law from its rank in
the file (no model is trained). The best score of a prefix depends on the prefix
alone, so distinct pre-tokens are inserted into a trie, each node gets its forward
score once for all pre-tokens that share the prefix, and terminals keep the counts.
A task builds its trie as it reads documents; when it reaches ``max_nodes`` it starts
anew, which bounds memory and changes no result.

Equal scores: fewer tokens, then the longer last piece. A character that is no piece
costs its UTF-8 bytes as byte tokens. Scores are whole numbers, so sums are exact.

Defined cases: a null or empty text counts zero; repeated rows and null doc_ids keep
their rows; other columns are not read.
"""
from __future__ import annotations

import math
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_batches

MARK = "▁"
#: Longer pre-tokens share no prefix worth keeping and are scored on their own, in constant memory.
LONG = 4096


def unigram_scores(model_file: str) -> dict[str, int]:
    """piece -> score in millionths of a nat, -ln(rank + 2), rank as in the file."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return {model.id_to_piece(i): -round(1e6 * math.log(i + 2)) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}


class Trie:
    """Nodes are numbers; ``score`` and ``count`` hold the best segmentation of the prefix
    that leads to a node."""

    def __init__(self, scores: dict[str, int]):
        self.pieces = scores
        self.longest = max(map(len, scores), default=0)
        self.byte_score = min(scores.values(), default=-1)
        self.clear()

    def clear(self) -> None:
        self.edge: dict[tuple[int, str], int] = {}
        self.score, self.count = [0], [0]

    def alone(self, word: str) -> tuple[int, int]:
        """(tokens, score) without the trie: only the last ``longest`` prefixes are kept."""
        recent = deque([(0, 0)], maxlen=self.longest + 1)
        for end, char in enumerate(word, 1):
            size = len(char.encode("utf-8", "surrogatepass"))
            score, count = recent[-1]
            best, tokens = score + self.byte_score * size, count + size
            for length in range(1, min(end, self.longest) + 1):
                piece = self.pieces.get(word[end - length:end])
                if piece is not None:
                    before, n = recent[-length]
                    if before + piece > best or before + piece == best and n + 1 <= tokens:
                        best, tokens = before + piece, n + 1
            recent.append((best, tokens))
        return recent[-1][1], recent[-1][0]

    def insert(self, word: str) -> tuple[int, int]:
        """(tokens, score) of a pre-token; only nodes that are new are computed."""
        if len(word) > LONG:
            return self.alone(word)
        edge, score, count, pieces = self.edge, self.score, self.count, self.pieces
        path, node = [0], 0
        for end, char in enumerate(word, 1):
            following = edge.get((node, char))
            if following is None:
                size = len(char.encode("utf-8", "surrogatepass"))
                best, tokens = score[node] + self.byte_score * size, count[node] + size
                for length in range(1, min(end, self.longest) + 1):
                    piece = pieces.get(word[end - length:end])
                    if piece is not None:
                        before = path[end - length]
                        total, n = score[before] + piece, count[before] + 1
                        if total > best or total == best and n <= tokens:
                            best, tokens = total, n
                following = edge[node, char] = len(score)
                score.append(best)
                count.append(tokens)
            node = following
            path.append(node)
        return count[node], score[node]


class _Terminals(dict):
    """pre-token (UTF-8) -> (tokens, score)."""

    def __init__(self, trie: Trie, max_nodes: int):
        super().__init__()
        self.trie, self.max_nodes = trie, max_nodes

    def __missing__(self, word: bytes) -> tuple[int, int]:
        found = self.trie.insert(MARK + word.decode("utf-8"))
        if len(self.trie.score) > self.max_nodes:
            self.trie.clear()
            self.clear()
        self[word] = found
        return found


def token_counts(docs: DataFrame, model_file: str, max_nodes: int = 1_000_000) -> DataFrame:
    """(doc_id, n_words, n_tokens, score) of every whole text. ``model_file`` must exist on
    every executor."""
    def run(batch: pa.RecordBatch, terminals: _Terminals) -> pa.RecordBatch:
        words, tokens, scores = [], [], []
        for text in batch.column("text").cast(pa.binary()):
            own = (text.as_py() or b"").split()  # on bytes: ASCII white space only
            found = [*map(terminals.__getitem__, own)]
            words.append(len(own))
            tokens.append(sum(n for n, _ in found))
            scores.append(sum(s for _, s in found))
        return pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": pa.array(words, pa.int64()),
                                "n_tokens": pa.array(tokens, pa.int64()), "score": pa.array(scores, pa.int64())})

    given = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    schema = T.StructType([given.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_tokens", "score"))])
    return map_batches(given, run, schema,
                       setup=lambda: _Terminals(Trie(unigram_scores(model_file)), max_nodes))
