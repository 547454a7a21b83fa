"""Awkward tables for every operator."""

import random

CLASHING = "digest old winner key row skey bucket before after tid head part seeds label position n_tokens band reason score toxic window first last".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def words(n: int, seed: int = 0, size: int = 4000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def frame(spark, rows):
    """Rows of (doc_id, text[, lang[, source]]) with columns of clashing names beside them."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, *("en", "a")[len(r) - 2 :])[:4] if len(r) < 4 else r
        full.append((doc_id, text, lang, source, None if text is None else len(text), *CLASHING))
    return spark.createDataFrame(full, SCHEMA)


def awkward(spark):
    long = words(30_000, 9)
    return frame(
        spark,
        [
            (1, words(200, 1)), (2, words(200, 1)), (2, words(200, 1)), (3, words(200, 1) + " x"), (4, None), (None, words(200, 1)), (None, None), (5, ""), (6, ""), (7, "   \n\t "),
            (8, "one"), (9, "one two"), (10, long, None, None), (11, long, "xx", "b"), (12, "é漢字 \U0001f600 " * 50, None, "b"), (13, "x " * 300, "en", None), (13, "same id, other text"),
        ],
    )


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
