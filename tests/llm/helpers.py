"""Small tables for the training-data operators' tests."""

import random

from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                   StructField("source", StringType()), StructField("n_chars", LongType())])

WORDS = "the of and to in that it was for on are with as his they be at one have this from or had by hot word but what some we".split()


def sentence(rng: random.Random, n: int, words=WORDS) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


def docs_df(spark, texts, first=0, lang="en"):
    rows = [(k + first, t, lang, "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def odd_texts(rng: random.Random) -> list:
    """NULL, empty, blank, repeated, non-ASCII and very long texts."""
    return [None, "", " \n\t ", "one", "one", "É ü 漢字 \U0001f600 ﬁ", sentence(rng, 40), sentence(rng, 9000), "x" * 70_000,
            sentence(rng, 15), "A-B_c.d e"]
