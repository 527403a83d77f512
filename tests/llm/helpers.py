"""Inputs that every operator must take: nulls, empty and long texts, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own.
CLASHING = ["fp", "n", "key", "root", "ids", "size", "words", "block", "spans", "stratum", "start", "first", "rules", "n_words", "u", "v", "row", "tree", "leaf", "other", "at", "label", "held_out", "w", "own", "id", "phrase"]


def words(rng, n, stems=("an", "be", "co", "du", "el", "fi", "go", "hu")):
    return ["".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def corpus(spark, seed=3, extra=True):
    rng = random.Random(seed)
    rows = []
    for i in range(40):
        text = " ".join(words(rng, rng.randint(25, 120))).capitalize() + "."
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), len(text)))
    base = rows[5][1]
    rows += [
        (100, base, "en", "a", len(base)),
        (101, base.upper(), "en", "a", len(base)),
        (102, base + " extra", "en", "b", len(base) + 6),
        (103, None, None, None, None),
        (104, "", "en", "a", 0),
        (105, " \n\t ", "de", "b", 4),
        (106, "one", "de", "b", 3),
        (107, "ünï çødé 🙂 " * 30, None, "z", 330),
        (108, " ".join(words(rng, 30_000)), "en", "a", None),
        (109, "same line here\n" * 50, "en", "c", 750),
        (None, base, "en", "a", len(base)),
        (None, None, None, None, None),
        rows[7],
        rows[7],
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("x").alias(c) for c in CLASHING])
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
