"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame that is written and read again before the next one.  All
but the last return the columns of documents.

A document with a null text or without words is gone after the first stage.  A null
id is no reason to go, and rows without an id are nobody's near duplicates.
Repeated rows stay together until the third stage leaves one of them.  An
empty table gives no row in any stage; other columns are carried along.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidepool.llm.jaccard_join import Rule, representatives
from tidepool.llm.language_id import keep_identified
from tidepool.llm.mixing import mixed_documents
from tidepool.llm.packing import pack
from tidepool.llm.queries import tokenizer_path
from tidepool.llm.quality_rules import keep_good
from tidepool.llm.runtime import dropped, shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a fertility band rejects go."""
    return keep_good(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"), tokenizer_path("byte_bpe_50k.json"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language isn't known with a probability of one half at least go."""
    return keep_identified(docs, least=0.5)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word n-grams, Jaccard of 0.8 at least) the document with the smallest id stays."""
    return representatives(docs, Rule(words=5, percent=80))


def temperature_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, none more than twice; no document is left out."""
    return mixed_documents(docs, max_repetition=2.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), capacity=1024, end_id=0)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("temperature_mixing", temperature_mixing),
    ("packing", packing),
]

#: SQL can't tokenize or fit a model; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_dir(spark)}/tidepool/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if before is not None:
                dropped(spark, before)  # the stage that read it is written
            before = docs
    return docs
