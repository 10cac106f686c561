"""Documents with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = "the of and river stone light house winter garden paper silver window morning quiet river's harbor copper meadow lantern orchard velvet thunder marble pocket candle summit".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward(spark, seed=1):
    rng = random.Random(seed)
    long = prose(rng, 30_000)
    rows = [(i, prose(rng, rng.randint(1, 60)), "en", "s", 1) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "", 0), (102, " \n\t ", None, "s", 3), (103, long, "en", "s", 1), (104, "x" * 50_000, None, "s", 1), (105, "Straße İstanbul 日本語 😀 don't\r\nΣΑΣ", "de", "s", 1), (106, "!!! ??? 123", "en", "s", 1)]
    rows += [rows[3], rows[3], (107, rows[4][1], "en", "s", 1), (None, "no id here at all", "en", "s", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    """docs with columns named like the operators' outputs."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("mine") for c in ("score", "predicted", "n_tokens", "ids", "kept", "component_id", "host", "rule", "pii", "n_words", "row", "term", "node", "rep", "held_out", "x", "label", "h")})
