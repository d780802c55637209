"""Tables with everything that may be wrong with a table."""

import random

from pyspark.sql import functions as F

LONG = "Long words. " * 4000 + "x" * 5000

#: Extra columns that operators may use as names inside.
CLASHES = ("id", "ids", "key", "size", "word", "block", "label", "node", "set", "run", "n", "digest", "edge", "bucket", "n_deleted", "lang_pred")


def sentences(seed, count, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()):
    rng = random.Random(seed)
    return " ".join(" ".join(rng.choice(words) for _ in range(rng.randint(3, 9))).capitalize() + "." for _ in range(count))


def texts():
    base = sentences(1, 12)
    near = base.replace("alpha", "omega", 1)
    return [
        (1, base, "en", "b"),
        (2, base, "en", "b"),
        (3, near, "en", "a"),
        (4, sentences(2, 9), "de", None),
        (5, None, "en", "a"),
        (6, "", "en", "b"),
        (7, " \t\n ", None, "c"),
        (8, "one", "fr", "c"),
        (9, "one  two\nthree", "fr", "d"),
        (10, "One\ttwo three", "fr", "d"),
        (11, "12 34 !?", "de", "b"),
        (12, LONG, "es", "é"),
        (None, base, "en", "b"),
        (None, sentences(3, 4), None, None),
        (4, sentences(2, 9), "de", None),
        (13, base + "\n" + sentences(5, 3), "en", "a"),
        (14, "été ſtraße 日本語 <|endoftext|> \u200b\U0001f600", "fr", "a"),
        (15, "a\n\nb\n\nc", "en", "a"),
        (16, "a\n\nb\n\nd", "en", "a"),
    ]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    frame = frame.withColumn("n_chars", F.char_length("text").cast("long"))
    return frame.withColumns({name: F.lit(f"extra {name}") for name in CLASHES})


def empty(spark):
    return documents(spark, [])
