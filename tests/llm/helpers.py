"""Small corpora with every awkward case: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

import random

from pyspark.sql import functions as F

CLASHES = ("row_id", "size", "shard", "slot", "copies", "digest", "fp", "kept", "score", "p", "bucket", "n", "component_id", "key", "pack", "weight", "label", "x", "held_out", "url", "host", "target")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Documents of (doc_id, text, lang, source) with extra columns."""
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    return df.select("*", *(F.lit(f"extra {c}").alias(c) for c in CLASHES))


def words(seed, n, stock="alpha beta gamma delta omega kappa sigma lambda tau rho phi chi psi zeta eta theta iota mu nu xi".split()):
    r = random.Random(seed)
    return " ".join(r.choice(stock) + str(r.randrange(40)) for _ in range(n))


def awkward():
    """Rows that no operator may stumble over."""
    long_ = " ".join([words(1, 4000)] * 3)
    return [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, None), (4, "x", "en", "b"), (4, "x", "en", "b"), (None, words(2, 30), "en", "b"), (None, None, None, None),
        (5, long_, "de", "a"), (6, words(3, 80), "de", "a"), (7, words(3, 80), "fr", None), (8, "ha " * 500, "en", "c"), (9, "żółć 你好 \U0001f600   x", "pl", "c"), (10, "a" * 5000, "en", "a"),
    ]
