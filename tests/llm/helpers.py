"""Small tables for the operators: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua quis nostrud".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(n))


def odd_rows():
    """Rows that each operator must stand."""
    return [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 3), (4, "word", "en", None, 4), (5, prose(1, 60), "en", "a", 1), (5, prose(1, 60), "en", "a", 1),
        (6, prose(1, 60), "de", "b", 1), (None, prose(2, 60), "de", "b", 1), (7, prose(3, 30_000), "en", "a", 1), (8, "é😀中 " * 400, "fr", "c", 1), (9, "\x00a\x00b" * 300, "fr", "c", 1),
    ]


def clashing(df):
    """The same rows with columns whose names operators might use for themselves."""
    from pyspark.sql import functions as F

    for name in ("node", "key", "comp", "kept", "sha", "cut", "g", "d2", "words", "kept_id", "score", "label", "piece", "rank", "salt", "found"):
        df = df.withColumn(name, F.lit("x"))
    return df
