"""Small tables with the cases that every operator must take."""
import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, seed string, ids string, fp string, own string"
WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "And", "naïve", "straße", "word,", "end."]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def docs(spark, texts, first=0):
    """documents with clashing extra columns from [(doc_id, text)] or texts."""
    rows = [(t if isinstance(t, tuple) else (first + k, t)) for k, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t), "s", "i", "f", "o") for i, t in rows], DOCS)


def odd_texts(rng: random.Random):
    """(doc_id, text): null, empty, blank, very long, repeated rows, ties, a null id."""
    long = sentence(rng, 30_000)
    return [(1, None), (2, ""), (3, " \t\n "), (4, long), (5, "same text here twice over"), (5, "same text here twice over"),
            (6, "same text here twice over"), (None, "no id for this text"), (None, None), (7, "x" * 20_000), (8, " é ß")]
