"""Token ids of whole texts with a public tokenizers file.

Most words of a corpus are repeats, so a text is cut into units whose ids do not
depend on their neighbours, each distinct unit is encoded once per worker by the
tokenizers library, and a text's ids are gathered from the units by numpy. Cuts are
made only where both pre-tokenizers cut anyway: before one space or line break that
stands between two characters that are not white space. Texts with any other white
space at such a place are encoded whole by the library. ``tests/llm/test_tokens.py``
holds the ids against whole-text encoding.
"""
from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_slices

#: Byte-level alphabet of the tokenizer files: printable bytes stand for themselves,
#: the others for the characters from 256 on, in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: chr(b) for b in _PRINTABLE} | {
    b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Units, each followed by a space: a mark of its place, one run of Latin letters and one
#: run of ASCII punctuation (two pre-tokens), or anything else.
_UNITS = r"({})([A-Za-zÀ-ÖØ-öø-ɏ]*)([!-/:-@\[-`{{-~]*) |([^ ]*) "
_JOINED_UNITS, _WORD_UNITS = re.compile(_UNITS.format(r"[\n\0]?")), re.compile(_UNITS.format(""))


class _Parts(dict):
    """Ids of a pre-token, which the file's own model merges; units share their letters and
    marks."""

    def __init__(self, model):
        super().__init__({"": ()})
        self.tokenize = model.tokenize

    def __missing__(self, text: str) -> tuple[int, ...]:
        # Printable ASCII stands for itself.
        own = text.replace(" ", "Ġ") if text.isascii() and text != "\n" else text.encode().decode("latin-1").translate(_ALPHABET)
        if len(self) > 100_000:  # units that share a part are mostly learnt close together
            self.clear()
            self[""] = ()
        ids = self[text] = tuple([t.id for t in self.tokenize(own)])
        return ids


class Encoder:
    """``joined``: a space belongs to the word after it (byte-level files); otherwise
    white space is dropped and letters are lower-cased (word files). Strings of special
    tokens in a text are ordinary text, or with ``special`` their ids, which is what the
    library does unless told otherwise; such texts are encoded whole."""

    def __init__(self, path: str, end_id: int, max_units: int = 800_000, special: bool = False):
        import json

        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.model, self.end_id, self.max_units = self.tokenizer.model, end_id, max_units
        with open(path, encoding="utf-8") as f:
            self.joined = json.load(f).get("normalizer") is None
        self._reset()

    def _reset(self) -> None:
        self.parts = _Parts(self.model)
        self.units: dict[str | None, int] = {None: 0}  # unit -> row of the id table, -1: not cut safely
        self.flat, self.start, self.length = array("i", [self.end_id]), array("i", [0]), array("i", [1])

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _word(self, unit: str, found: tuple[str, ...]) -> tuple[int, ...] | list[int]:
        _, letters, marks, other = found
        lower = letters.lower()
        if other or len(lower) != len(letters):  # a letter that became a letter and a mark
            return self.whole(unit)
        return self.parts[lower] + self.parts[marks]

    def _joined(self, unit: str, found: tuple[str, ...]) -> tuple[int, ...] | list[int] | None:
        """None if the unit's cuts were not safe ones."""
        lead, letters, marks, other = found
        if other:
            lead = unit[0] if unit[0] in "\n\0" else ""
            rest = unit[len(lead):]
            if rest[0].isspace() or rest[-1].isspace():
                return None
            return self.whole((lead or " ").rstrip("\0") + rest)
        if lead == "\n":
            first, before = self.parts["\n"], ""
        else:
            first, before = (), "" if lead else " "
        if letters:
            return first + self.parts[before + letters] + self.parts[marks]
        return first + self.parts[before + marks] if marks else None

    def _learn(self, units: list[str]) -> None:
        """Add new units to the id table: one pass of the pattern over all of them."""
        pattern, of = (_JOINED_UNITS, self._joined) if self.joined else (_WORD_UNITS, self._word)
        found = [of(*x) for x in zip(units, pattern.findall(" ".join(units) + " "))]
        safe = [x for x in found if x is not None]
        ends = np.cumsum([len(x) for x in safe], dtype=np.int64) + len(self.flat)
        row = len(self.start)
        self.length.extend([len(x) for x in safe])
        self.start.extend([len(self.flat), *ends[:-1].tolist()] if safe else [])
        self.flat.extend(chain.from_iterable(safe))
        rows = count(row)
        self.units.update((u, -1 if x is None else next(rows)) for u, x in zip(units, found))

    def _cut(self, text: str) -> str | None:
        """The text with a space between its units, None if it has to be encoded whole; a line
        break leads its unit, the first unit of a byte-level text has a leading NUL."""
        if any(x in text for x in self.special):
            return None
        if not self.joined:
            return text.replace("\n", " ")
        if not text or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "\0" in text:
            return None
        return "\0" + text.replace("\n", " \n")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of each text, with the end id."""
        if len(self.units) > self.max_units:
            self._reset()
        # Arrow splits the texts and numbers their distinct units; Python sees each of these once.
        cut = [self._cut(t) for t in texts]
        lists = pa.compute.split_pattern(pa.array(cut, pa.string()), " ")
        numbered = lists.flatten().dictionary_encode()
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        if new := [u for u in distinct if u not in self.units]:
            self._learn(new)
        counts = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy().astype(np.int64)
        # Each text's units, then the end mark, whose row is 0.
        texts_before = np.repeat(np.arange(len(texts)), counts)
        rows = np.zeros(len(texts_before) + len(texts), np.int64)
        known = np.fromiter(map(self.units.__getitem__, distinct), np.int64, len(distinct))
        rows[np.arange(len(texts_before)) + texts_before] = known[numbered.indices.to_numpy()]
        last = np.cumsum(counts + 1) - 1
        safe = np.array([c is not None for c in cut], bool)
        if len(rows):
            safe &= np.minimum.reduceat(rows, last - counts) >= 0
        flat, start, length = (np.frombuffer(x, np.int32) for x in (self.flat, self.start, self.length))
        n = length[rows]
        ends = np.cumsum(n, dtype=np.int64)
        ids = flat[np.repeat(start[rows] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].astype(np.uint32)
        edges = [0, *ends[last].tolist()]
        return [ids[edges[k]:edges[k + 1]] if safe[k] else np.array([*self.whole(t), self.end_id], np.uint32)
                for k, t in enumerate(texts)]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int, special: bool = False) -> Encoder:
    """One per Python worker, kept between tasks."""
    if (path, end_id, special) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, end_id, special] = Encoder(path, end_id, special=special)
    return _ENCODERS[path, end_id, special]


def encoded(batch: pa.RecordBatch, coder: Encoder, slice_bytes: int = 2 << 20) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, ids of the rows from there on), a slice of the batch's texts at a time."""
    column = batch.column("text").fill_null("")
    for a, b in in_slices(column, slice_bytes):
        yield a, coder.encode(column[a:b].to_pylist())


def narrowest(path: str) -> str:
    """The narrowest kind of number that holds every id of the file."""
    from tokenizers import Tokenizer
    greatest = max(Tokenizer.from_file(path).get_vocab().values(), default=0)
    return "<u2" if greatest < 1 << 16 else "<u4"


def token_ids(docs: DataFrame, path: str, end_id: int, kind: str = "<u4", special: bool = False, counted: bool = False) -> DataFrame:
    """(doc_id, ids): ids of the whole text (null: empty) as numbers of ``kind`` (one too small
    for an id raises), the end id last. ``path`` must exist on every executor. With
    ``counted``, a column ``counts`` beside them, null but in one further row per task,
    which has nothing else: how often the task wrote each id (8-byte numbers by id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, most = encoder(path, end_id, special), int(np.iinfo(kind).max)
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for a, ids in encoded(batch, coder):
                flat = np.concatenate(ids)
                if int(flat.max()) > most:
                    raise OverflowError(f"id {flat.max()} does not fit numbers of kind {kind}")
                out = {"doc_id": batch.column("doc_id").slice(a, len(ids)),
                       "ids": pa.array([x.astype(kind, copy=False).tobytes() for x in ids], pa.binary())}
                if counted:
                    own = np.bincount(flat, minlength=len(counts))
                    own[:len(counts)] += counts
                    counts, out["counts"] = own, pa.nulls(len(ids), pa.binary())
                yield pa.record_batch(out)
        if counted and len(counts):
            yield pa.record_batch({"doc_id": pa.nulls(1, doc_type), "ids": pa.nulls(1, pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})

    from pyspark.sql.pandas.types import to_arrow_type
    given = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    doc_type = to_arrow_type(given.schema["doc_id"].dataType)
    fields = [given.schema["doc_id"], T.StructField("ids", T.BinaryType()), *[T.StructField("counts", T.BinaryType())] * counted]
    if counted:
        fields[0] = T.StructField("doc_id", fields[0].dataType, True)
    return given.mapInArrow(run, T.StructType(fields))
