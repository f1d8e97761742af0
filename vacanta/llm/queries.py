"""The registered queries of the training-data operators, each over its whole table,
and the DuckDB statements of those that SQL can express."""
from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (cotrain, decontaminate, html_template, huffman, linkgraph, pack, periodic, pii, rules_forest, simhash, spelling,
               token_counts, tokens, warc)
from .common import new_path, stored, table

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op4_decontamination": decontaminate.SQL}


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file, the same on every machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def pii_key(spark: SparkSession) -> bytes:
    """The secret under which surrogates are drawn; a deployment sets its own."""
    return spark.conf.get("spark.vacanta.pii.key", "a key for tests only").encode()


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_template.extract(table(spark, sf_dir, "pages", ["page_id", "url", "html"]))


@query
def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates in place of personal data."""
    return pii.pseudonymise(table(spark, sf_dir, "documents", ["doc_id", "text"]), pii_key(spark))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdict of every document."""
    judged = rules_forest.judge(table(spark, sf_dir, "documents", ["doc_id", "text"]),
                                table(spark, sf_dir, "labels", ["doc_id", "quality"]))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "score")


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item, with the item."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents", ["doc_id", "text"]),
                                  table(spark, sf_dir, "benchmark", ["item_id", "text"]))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    packed = pack.pack(table(spark, sf_dir, "documents", ["doc_id", "text"]), tokenizer("byte_bpe_50k.json"), special=True)
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return cotrain.classify(docs, cotrain.fit(docs, table(spark, sf_dir, "labels", ["doc_id", "quality"])))


@query
def op7_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return linkgraph.judge(table(spark, sf_dir, "pages", ["page_id", "url", "html"]), URL_RULES)


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents", ["doc_id", "text"]),
                                     tokenizer("piece_bpe_32k.model"))


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from the token file."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    path, file = new_path(spark, "token_file"), tokenizer("word_bpe_49k.json")
    kind = tokens.narrowest(file)
    found = stored(tokens.token_ids(docs, file, end_id=1, kind=kind, special=True, counted=True), "ids")
    huffman.write(found.where("counts IS NULL").select("doc_id", "ids"), path, kind, found.where("counts IS NOT NULL").select("counts"))
    return huffman.read(spark, path).select(
        "doc_id", "start", F.expr("length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def misspelt(doc_id: int | None, word: str) -> str:
    """``word`` with one code point less where 31 divides the hash of the document's id (null:
    empty) and the word."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    at = h % len(word)
    return word if h % 31 else word[:at] + word[at + 1:]


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the corpus with the form that it is a variant of."""
    words = spelling.vocabulary(table(spark, sf_dir, "documents", ["doc_id", "text"]), spoil=misspelt)
    return spelling.variant_groups(words)


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts from a place on replaced by repeats of the words there, where ten
    divides the hash of the document's id."""
    h, n = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.size("words")
    hashed = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.filter(
        F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("words"))
    placed = hashed.withColumn("n", F.when(n > 0, n)).withColumn("a", F.floor(F.col("h") / 10) % F.col("n")).withColumn(
        "p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)"))
    return placed.select("doc_id", F.when(F.col("n").isNull(), F.col("text")).otherwise(F.array_join(F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))),
        " ")).alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document."""
    found = periodic.periodic_runs(with_repeats(table(spark, sf_dir, "documents", ["doc_id", "text"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, F.concat(r.period, F.lit("\n"))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives."""
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages", ["page_id", "url", "html"]), path, "2024-01-01T00:00:00Z")
    found = stored(warc.read(spark, path).drop("payload"), "warc_pages")
    warc.verify_revisits(found)
    return found.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        F.col("refers_to").cast("long").alias("refers_to"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
