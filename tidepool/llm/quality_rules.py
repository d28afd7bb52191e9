"""Quality rules by tokeniser fertility."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import ship
from .textbatch import Texts, row_keys, segment_hashes, slices, windows
from .transducer import compiled

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_WINDOW = 3
#: n tokens reach log2(n) bits at most; the least entropy asked for is never more than this share of it.
ENTROPY_SHARE = 0.72
BROAD_ENTROPY_SHARE = 0.67


@dataclass(frozen=True)
class Band:
    """Outside of it a text is rejected: characters per token, share of byte-fallback tokens, bits per token.

    entropy: the floor for 256 tokens; it rises by so many bits with each doubling up to 1,448.
    """

    chars_per_token: tuple[float, float]
    fallback_share: float
    entropy: float
    rise: float = 0.0


#: Bands by language, for the multilingual vocabulary.  They were set with a margin
#: below the labelled good documents whose crc32(doc_id as text) is even; the tests
#: report on the others.
LANGUAGE_BANDS = {
    "en": Band((2.25, 6.5), 0.03, 5.7, 0.2),
    "de": Band((2.38, 6.5), 0.07, 5.7, 0.2),
    "es": Band((2.18, 6.5), 0.06, 5.65, 0.2),
    "fr": Band((2.05, 6.5), 0.05, 5.65, 0.2),
}
#: Bands by script, for texts of any other or unknown language.
SCRIPT_BANDS = {
    "latin": Band((1.9, 7.0), 0.15, 5.0),
    "cyrillic": Band((1.2, 7.0), 0.25, 4.5),
    "greek": Band((0.9, 7.0), 0.40, 4.5),
    "arabic": Band((0.9, 7.0), 0.40, 4.5),
    "cjk": Band((0.3, 4.0), 0.90, 4.5),
    "other": Band((0.25, 7.0), 0.95, 4.0),
}
#: The same for the second vocabulary, which is mostly English: by language as
#: above, by script wide, as the sample tables have no such documents.
BROAD_LANGUAGE_BANDS = {
    "en": Band((2.20, 6.5), 0.10, 5.7, 0.2),
    "de": Band((2.05, 6.5), 0.15, 5.6, 0.2),
    "es": Band((1.80, 6.5), 0.22, 5.5, 0.2),
    "fr": Band((1.88, 6.5), 0.23, 5.5, 0.2),
}
BROAD_SCRIPT_BANDS = {
    "latin": Band((1.2, 7.0), 0.50, 4.5),
    "cyrillic": Band((0.3, 7.0), 1.0, 3.5),
    "greek": Band((0.3, 7.0), 1.0, 3.5),
    "arabic": Band((0.3, 7.0), 1.0, 3.5),
    "cjk": Band((0.2, 4.0), 1.0, 3.5),
    "other": Band((0.2, 7.0), 1.0, 3.5),
}
#: Where the letters of a script lie.
SCRIPTS = {
    "latin": ((0x41, 0x5B), (0x61, 0x7B), (0xC0, 0x250), (0x1E00, 0x1F00)),
    "greek": ((0x370, 0x400), (0x1F00, 0x2000)),
    "cyrillic": ((0x400, 0x530),),
    "arabic": ((0x600, 0x780),),
    "cjk": ((0x3040, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7B0)),
}

STATS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean",
    "chars_per_token": "double", "fallback_share": "double", "token_entropy": "double", "broad_chars_per_token": "double",
    "broad_fallback_share": "double", "broad_token_entropy": "double", "band": "string",
}

_symbol = np.zeros(256, dtype=bool)
_symbol[[ord(c) for c in SYMBOLS]] = True


@lru_cache(maxsize=4)
def _fragments(vocab_path: str, classes_of: str) -> np.ndarray:
    """Which tokens are not whole characters: what a vocabulary falls back to for characters it lacks."""
    machine = compiled(vocab_path, classes_of)
    out = np.zeros(machine.vocab.size, dtype=bool)
    for i, b in machine.vocab.tokens.items():
        try:
            b.decode()
        except UnicodeDecodeError:
            out[i] = True
    return out


def script_of(text: bytes) -> str:
    """The script most of the letters belong to; ties go to the first listed."""
    code = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    n = {name: sum(int(((code >= a) & (code < b)).sum()) for a, b in ranges) for name, ranges in SCRIPTS.items()}
    best = max(n, key=n.get)
    return best if n[best] else "other"


def base_counts(t: Texts) -> dict[str, np.ndarray]:
    """Words, their characters, symbols, repeated lines and repeated 3-word windows of each row."""
    words = t.words()
    chars = (t.data & 0xC0) != 0x80
    out = {"n_words": words.count, "word_chars": t.sums(chars & words.inside), "n_symbols": t.sums(_symbol[t.data])}

    # lines: cut at \n and at the beginning of rows; the newline itself is not part of a line
    newline = t.data == 0x0A
    first = np.zeros(len(t.data), dtype=bool)
    first[1:] = newline[:-1]
    first[t.off[:-1][t.off[:-1] < len(t.data)]] = True
    start = np.flatnonzero(first)
    line = segment_hashes(t.data, start, ~newline)
    has_word = np.add.reduceat(words.inside, start) > 0 if len(start) else np.zeros(0, dtype=bool)
    rows = np.searchsorted(t.off, start, side="right") - 1
    length = np.diff(np.append(start, len(t.data)))
    length -= np.add.reduceat(newline, start) if len(start) else 0
    key = row_keys(line ^ length.astype(np.uint64), rows)[has_word]
    distinct = np.unique(key, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(rows[has_word], minlength=t.n) - np.bincount(rows[has_word][distinct], minlength=t.n)

    h, at = windows(words.hashes(), words.row_off, REPEAT_WINDOW)
    word_row = words.rows()
    key = row_keys(h, word_row[at])
    order = np.argsort(key)
    same = np.zeros(len(key) + 1, dtype=bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    often = at[order[same[1:] | same[:-1]]]
    covered = np.zeros(len(word_row), dtype=bool)
    for k in range(REPEAT_WINDOW):
        covered[often + k] = True
    out["n_repeat_words"] = np.bincount(word_row[covered], minlength=t.n)
    return out


def fertility(t: Texts, vocab_path: str, classes_of: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters per token, share of tokens that are pieces of characters, entropy in bits; 0 for no tokens."""
    machine = compiled(vocab_path, classes_of)
    ids, off = machine.ids(t)
    n = np.diff(off)
    some = np.maximum(n, 1)
    rows = np.repeat(np.arange(t.n), n)
    share = np.bincount(rows, weights=_fragments(vocab_path, classes_of)[ids], minlength=t.n) / some
    key, count = np.unique(rows * machine.vocab.size + ids, return_counts=True)
    row = key // machine.vocab.size
    p = count / some[row]
    return t.n_chars() / some, share, np.bincount(row, weights=-p * np.log2(p), minlength=t.n)


def least_entropy(floor: np.ndarray, rise: np.ndarray, n_tokens: np.ndarray, share: float) -> np.ndarray:
    """The floor of a band, higher for more tokens, lower where so few can hardly reach it."""
    bits = np.log2(np.maximum(n_tokens, 1))
    return np.minimum(floor + rise * np.clip(bits - 8, -2, 2.5), share * bits)


def within(t: Texts, measures: tuple[np.ndarray, ...], bands: list[Band], entropy_share: float) -> np.ndarray:
    """Whether each row's three measures by a vocabulary lie in its band."""
    cpt, share, entropy = measures
    low, high, most, floor, rise = np.array([(*b.chars_per_token, b.fallback_share, b.entropy, b.rise) for b in bands], dtype=float).reshape(-1, 5).T
    return (cpt >= low) & (cpt <= high) & (share <= most) & (entropy >= least_entropy(floor, rise, t.n_chars() / np.where(cpt > 0, cpt, 1), entropy_share))


def judge(t: Texts, langs: list[str | None], vocab_path: str, broad_path: str) -> dict[str, np.ndarray | list]:
    """All statistics and the verdict for each row."""
    out: dict = base_counts(t)
    n, repeat = out["n_words"], out["n_repeat_words"]
    out["base_failed"] = (n < MIN_WORDS) | (100 * repeat > 50 * n)
    own, broad = fertility(t, vocab_path, broad_path), fertility(t, broad_path, broad_path)
    names = [g if g in LANGUAGE_BANDS else script_of(t.row_text(i)) for i, g in enumerate(langs)]
    inside = within(t, own, [LANGUAGE_BANDS.get(g) or SCRIPT_BANDS[g] for g in names], ENTROPY_SHARE)
    inside &= within(t, broad, [BROAD_LANGUAGE_BANDS.get(g) or BROAD_SCRIPT_BANDS[g] for g in names], BROAD_ENTROPY_SHARE)
    out |= {"kept": inside & ~out["base_failed"], "band": names}
    out |= dict(zip(("chars_per_token", "fallback_share", "token_entropy"), own, strict=True))
    out |= dict(zip(("broad_chars_per_token", "broad_fallback_share", "broad_token_entropy"), broad, strict=True))
    return out


def _judged(batch: pa.RecordBatch, text: int, lang: int, vocab_path: str, broad_path: str) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
    """The rows of each slice of a batch, and their columns of STATS."""
    langs = batch.column(lang).to_pylist()
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    for a, b, t in slices(batch.column(text)):
        stats = judge(t, langs[a:b], vocab_path, broad_path)
        yield batch.slice(a, b - a), [pa.array(stats[c], kinds[k]) for c, k in STATS.items()]


def quality(docs: DataFrame, vocab_path: str, broad_path: str) -> DataFrame:
    """Statistics and verdict of each document.

    vocab_path, broad_path: two vocabularies; the three measures by either are
    held against bands of their own.  The second's file also defines the letter
    and digit classes.  Returns doc_id and the columns of STATS, one row
    per input row.  A null text is empty: it has no words and fails the base
    rule.  A null or unknown ``lang`` is judged by the script of the text.  An
    empty table gives an empty one; other columns are ignored.  No shuffle.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, stats in _judged(batch, 1, 2, vocab_path, broad_path):
                yield pa.RecordBatch.from_arrays([rows.column(0), *stats], names=["doc_id", *STATS])

    src = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{c} {k}" for c, k in STATS.items())]))


def keep_good(docs: DataFrame, vocab_path: str, broad_path: str) -> DataFrame:
    """The rows whose verdict is to keep them, with all their columns.

    A null text fails the base rule and goes; a null id is no reason to go;
    repeated rows stay or go together; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")
    kept = list(STATS).index("kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, stats in _judged(batch, text, lang, vocab_path, broad_path):
                yield rows.filter(pc.fill_null(stats[kept], False))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
