"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A fixed mask keeps some positions of a token span and ignores the others. Every
span of a document is hashed under each mask and joined to the hashes of the
benchmark items, so a span still hits when the tokens at its ignored positions
were substituted. On the diagonal of each hit the aligned tokens are compared: an overlap is
a window of ``WINDOW`` benchmark tokens of which at most ``SUBSTITUTIONS`` differ
on the same diagonal.

The two masks are lossless for that rule: wherever two of 13 tokens are
substituted, one mask fits at some offset of the window without touching them
(``tests/llm/test_decontaminate.py`` enumerates all cases). The result therefore
equals an exhaustive comparison.

Tokens are runs of letters and digits in lower case. Defined cases: a null or
empty text has no tokens and no overlap; items shorter than the window must occur
whole and unchanged; items under ``MIN_ITEM_TOKENS`` tokens are no evidence; rows
that share a doc_id (null included) are reported under it together; an empty table
on either side gives no rows. Other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW = 13
SUBSTITUTIONS = 2
MIN_ITEM_TOKENS = 8
#: Offsets that count, of a span of ten tokens.
MASKS = ((0, 1, 2, 4, 7, 9), (0, 3, 4, 5, 8, 9))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def _seeds(array: Column, masks: list[tuple[int, tuple[int, ...]]]) -> Column:
    """Per mask, the hashes of the spans from each position on that the mask fits."""
    def of(number: int, mask: tuple[int, ...]) -> Column:
        last = F.size(array) - 1 - max(mask)
        return F.when(last >= 0, F.transform(
            F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(number), *[array[i + o] for o in mask])))
    return F.array(*[of(number, mask) for number, mask in masks])


def overlaps(docs: DataFrame, benchmark: DataFrame, max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, item_id, n_matched, doc_start): ``n_matched`` is the largest number of
    equal tokens in a qualifying window, ``doc_start`` the token of the document at which
    the item would have to begin for such a window (it may be negative)."""
    items = stored(benchmark.select("item_id", _hashes(F.col("text")).alias("item"))
                   .where(F.size("item") >= MIN_ITEM_TOKENS).distinct(), "items")
    # At most one number per length under the window.
    short = [r[0] for r in items.select(F.size("item")).where(F.size("item") < WINDOW).distinct().collect()]
    masks = list(enumerate(MASKS)) + [(len(MASKS) + n, tuple(range(n))) for n in sorted(short)]

    def exploded(df: DataFrame, array: str, *keep: str) -> DataFrame:
        per_mask = df.select(*keep, F.posexplode(_seeds(F.col(array), masks)).alias("mask", "seeds"))
        return per_mask.select(*keep, "mask", F.posexplode("seeds").alias("pos", "seed"))

    own = F.element_at(F.array(*[F.lit(n) for _, n in [(m, len(mask)) for m, mask in masks]]), F.col("mask") + 1)
    table = (exploded(items.withColumn("n", F.size("item")), "item", "item_id", "n")
             .where(F.when(F.col("mask") < len(MASKS), F.col("n") >= WINDOW).otherwise(F.col("n") == own))
             .select("seed", "item_id", F.col("pos").alias("item_pos")).distinct())
    table = stored(table, "seeds")
    row_bytes = 64  # three numbers in a hashed relation
    if table.count() * row_bytes <= max_broadcast_bytes:
        table = F.broadcast(table)

    # Padded by what may be substituted, so that windows across a document's edges are covered.
    pad = F.array_repeat(F.lit(0).cast("long"), SUBSTITUTIONS)
    key = F.xxhash64("text").alias("text_hash")
    spans = exploded(docs.where("text IS NOT NULL").select("doc_id", key, F.concat(pad, _hashes(F.col("text")), pad).alias("doc")),
                     "doc", "doc_id", "text_hash")
    hits = (spans.join(table, "seed")
            .select("doc_id", "text_hash", "item_id", (F.col("pos") - F.col("item_pos") - SUBSTITUTIONS).alias("diagonal"))
            .distinct())
    found = stored(hits.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("item_id", "diagonal")).alias("hits")), "hits")
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "hits")

    # The hit documents again, each diagonal compared token by token.
    met = docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"]) == found["_hash"]))
    met = (met.select("doc_id", _hashes(F.col("text")).alias("doc"), "hits")
           .select("doc_id", "doc", F.explode("hits").alias("hit"))
           .select("doc_id", "doc", "hit.item_id", "hit.diagonal").join(items, "item_id"))
    doc, item, diagonal = F.col("doc"), F.col("item"), F.col("diagonal")

    def equal(j: Column) -> Column:
        at = j + diagonal
        return F.when((at >= 0) & (at < F.size(doc)) & (F.get(doc, at) == F.get(item, j)), 1).otherwise(0)

    width = F.least(F.size(item), F.lit(WINDOW))
    equals = F.transform(F.sequence(F.lit(0), F.size(item) - 1), equal)
    best = F.array_max(F.transform(
        F.sequence(F.lit(1), F.size("equals") - F.col("width") + 1),
        lambda i: F.aggregate(F.slice("equals", i, F.col("width")), F.lit(0), lambda a, x: a + x)))
    checked = (met.select("doc_id", "item_id", "diagonal", equals.alias("equals"), width.alias("width"))
               .select("doc_id", "item_id", "diagonal", "width", best.alias("best")))
    needed = F.when(F.col("width") < WINDOW, F.col("width")).otherwise(WINDOW - SUBSTITUTIONS)
    return (checked.where(F.col("best") >= needed)
            .groupBy("doc_id", "item_id")
            .agg(F.max("best").alias("n_matched"), F.min("diagonal").alias("doc_start")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that overlap a benchmark item; columns unchanged."""
    leaked = stored(overlaps(docs, benchmark).select(F.col("doc_id").alias("_leaked")).distinct(), "leaked")
    return docs.join(leaked, docs["doc_id"].eqNullSafe(leaked["_leaked"]), "left_anti")


#: DuckDB statement of ``overlaps``: every pair of equal tokens on every diagonal, no seeds.
SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
bt AS (SELECT item_id, len(w) AS n, least(len(w), 13) AS width, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS j
       FROM b WHERE len(w) >= 8),
dt AS (SELECT rid, doc_id, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS p FROM d),
m AS (SELECT rid, doc_id, item_id, n, width, p - j AS diagonal, j FROM dt JOIN bt USING (t)),
big AS (SELECT rid, doc_id, item_id, n, width, diagonal FROM m GROUP BY ALL HAVING count(*) >= least(n, 11)),
starts AS (SELECT *, unnest(range(0, n - width + 1)) AS s FROM big),
best AS (SELECT s.doc_id, s.item_id, s.rid, s.diagonal, s.width, s.s, count(*) AS best
         FROM starts s JOIN m ON m.rid = s.rid AND m.item_id = s.item_id AND m.n = s.n AND m.diagonal = s.diagonal
              AND m.j BETWEEN s.s AND s.s + s.width - 1
         GROUP BY ALL)
SELECT doc_id, item_id, CAST(max(best) AS INTEGER) AS n_matched, CAST(min(diagonal) AS INTEGER) AS doc_start
FROM best WHERE best >= CASE WHEN width < 13 THEN width ELSE 11 END
GROUP BY doc_id, item_id
"""
