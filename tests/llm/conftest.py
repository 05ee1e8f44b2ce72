import pytest
from pyspark.sql import functions as F

WORDS = "the quick brown fox jumps over a lazy dog while seven small birds watch from an old stone wall near water".split()


def prose(seed: int, n: int) -> str:
    """``n`` words, the same for the same seed."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x % len(WORDS)] + str(x // 1000 % 97))
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and
    extra columns named like the operators' own."""
    rows = [
        (1, prose(1, 80), "en", "a"), (2, prose(1, 80), "en", "a"), (3, None, "en", "a"), (4, "", None, "b"),
        (5, "  \n\t ", "de", None), (6, "one", "de", "b"), (7, prose(2, 20_000), "en", "a"), (8, "x " * 5_000, "fr", "a"),
        (9, prose(3, 60), "fr", "b"), (9, prose(3, 60), "fr", "b"), (None, prose(4, 40), "en", "a"),
        (None, None, None, None), (10, "!!! ### 123", "en", "a"), (11, prose(5, 30) + "\n" + prose(5, 30), "de", "a"),
        (12, "naïve café " + prose(6, 50), "fr", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = ("key", "digest", "label", "id", "n", "h", "size", "start", "length", "score", "line", "host", "stats", "order",
             "item_id", "u", "v", "held_out", "n_words")
    return docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(extra)))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def prose_of():
    return prose
