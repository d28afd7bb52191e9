"""Rows that every operator must take: nulls, blanks, very long texts, ties, repeats, clashing columns."""

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators make themselves
        T.StructField("sig", T.StringType()),
        T.StructField("shard", T.StringType()),
        T.StructField("n_tokens", T.StringType()),
        T.StructField("term", T.StringType()),
        T.StructField("weight", T.StringType()),
    ]
)

WORDS = "the of and to in a is that for it as was with be by on not he are this or his from at which".split()


def text(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7919 + i * i * 31 + i * (seed % 13)) % len(WORDS)] + (str((seed * 31 + i) % 97) if i % 3 else "") for i in range(n))


def odd_rows() -> list[tuple]:
    extra = ("x",) * 5
    plain = [(i, text(i, 120), "en", f"s{i % 3}", 1) for i in range(20)]
    odd = [
        (20, None, "en", "s0", None),
        (21, "", None, None, 0),
        (22, " \n\t ", "en", "s1", 4),
        (23, text(3, 120), "en", "s1", 1),  # a copy
        (24, text(3, 120).upper(), None, "s1", 1),  # and one in capitals
        (25, "word", "en", "s2", 4),
        (26, "x" * 30_000, "en", "s2", 1),
        (27, text(99, 20_000), "en", "s0", 1),
        (28, "日本語のテキスト 😀 <|endoftext|> don't it's", "ja", "s0", 1),
        (29, None, None, None, None),
        (None, text(5, 60), "en", "s0", 1),
        (None, None, None, None, None),
        (3, text(3, 120), "en", "s0", 1),  # a repeated row
        (3, text(3, 120), "en", "s0", 1),
    ]
    return [r + extra for r in plain + odd]


def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
