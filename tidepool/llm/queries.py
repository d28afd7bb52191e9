"""The queries of this subpackage over the documents and pages tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .hash_ring import assign
from .html_text import extract
from .imatch import fingerprints
from .jaccard_join import Rule, classes
from .language_id import identify
from .language_model import perplexity
from .mixing import BLOCK_TOKENS, temperature_mix
from .native_sql import mixing_sql, ring_sql
from .packing import pack
from .quality_rules import quality
from .runtime import table
from .token_counts import token_counts


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies, by its name."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: words, symbols, repeats, the measures of both vocabularies and the verdict; without a word the base rule fails it."""
    return quality(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), tokenizer_path("byte_bpe_50k.json"))


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and pass that the budget takes, no source more than twice; a null source is a source of its own."""
    return temperature_mix(table(spark, sf_dir, "documents"), max_repetition=2.0)


def op3_bounded_load_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its shard of 16 and gapless slot under the law `rows`; a null text has size 1."""
    return assign(table(spark, sf_dir, "documents"), shards=16)


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: fingerprints of its text and of its edited text, and their likenesses; a null text is empty."""
    return fingerprints(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: the language predicted and its probability; `und` for a text without letters."""
    return identify(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its bytes, tokens and whether they are over 1024; a null text is empty."""
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)


def op7_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per piece of a document in a sequence of 1024 tokens; a null or empty text is one token, its end."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), capacity=1024, end_id=0)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: the size of its set and the smallest id of its component; a text without words is linked with nothing."""
    return classes(table(spark, sf_dir, "documents"), Rule(words=4, percent=85))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its tokens, the base score and the trigram model's; a null text is one token, its end."""
    return perplexity(table(spark, sf_dir, "documents"), order=3)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per page: its main text, empty if it has none."""
    return extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_tokeniser_fertility, op2_temperature_mixing, op3_bounded_load_ring, op4_imatch, op5_language_id, op6_token_counts, op7_cost_balanced_packing, op8_jaccard_join, op9_kneser_ney, op10_html_extraction)
}

ORACLE_SQL: dict[str, str] = {
    "op2_temperature_mixing": mixing_sql(2.0, BLOCK_TOKENS, 17),
    "op3_bounded_load_ring": ring_sql(16, 128),
    "op8_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT reach.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY reach.doc_id
""",
}
