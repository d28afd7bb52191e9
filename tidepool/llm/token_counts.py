"""Token counts by compiled finite-state tokenizers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ship
from .textbatch import slices
from .transducer import compiled


def token_counts(docs: DataFrame, vocab_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the tokens of each text as the vocabulary's own library gives them.

    Returns one row per input row: ``doc_id`` (the value of id_col), ``n_bytes``
    (UTF-8), ``n_tokens``, ``over_limit`` (n_tokens > limit).  A null text counts
    as empty: 0 bytes, 0 tokens.  A null id stays null; repeated rows are
    counted each; an empty table gives an empty one; other columns are ignored.
    vocab_path must be readable on the workers.  One pass, no shuffle: whatever
    the length of a text, it is stepped in chunks of fixed size.
    """
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(vocab_path)
        for batch in batches:
            sizes, tokens = [], []
            for _, _, texts in slices(batch.column(1)):
                sizes.append(np.diff(texts.off))
                tokens.append(machine.counts(texts))
            if sizes:
                n = np.concatenate(tokens)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
