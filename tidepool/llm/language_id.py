"""Language identification by sparse multinomial logistic regression on character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import ship
from .textbatch import Texts, mix64, slices
from .transducer import release

#: Hashed features and the lengths of the n-grams.
FEATURES = 1 << 16
ORDERS = (1, 2, 3)
UNKNOWN = "und"


@dataclass(frozen=True)
class Training:
    """sample_rows bounds the labelled rows that the classifier is fitted on; the rest is FTRL-proximal's."""

    sample_rows: int = 1600
    max_languages: int = 256
    epochs: int = 6
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.05
    held_back: float = 0.25
    seed: int = 5


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


_fold = np.zeros(0x110000, dtype=np.int32)  # 0: not looked at yet, 1: not a letter, else the lower-case letter


def _letters(code: np.ndarray) -> np.ndarray:
    got = _fold[code]
    if len(got) and not got.all():
        for c in np.unique(code[got == 0]):
            ch = chr(c)
            _fold[c] = ord(ch.lower()[0]) if ch.isalpha() else 1
        got = _fold[code]
    return got


def documents(t: Texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, features, counts) of each row that has a letter; what isn't a letter counts as a blank."""
    code = np.frombuffer(t.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    fold = _letters(code).astype(np.uint64)
    off = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])[t.off]
    grams = []
    key = np.zeros(len(fold), dtype=np.uint64)
    for n in ORDERS:
        if len(fold) < n:
            break
        key = key[: len(fold) - n + 1] * np.uint64(0x110000) + fold[n - 1 :]
        grams.append((mix64(key + np.uint64(n << 58)) >> np.uint64(48)).astype(np.int64) & (FEATURES - 1))
    is_letter = np.concatenate([[0], np.cumsum(fold > 1)])
    for i in range(t.n):
        a, b = off[i], off[i + 1]
        if is_letter[b] > is_letter[a]:
            own = np.concatenate([g[a : b - n + 1] for n, g in zip(ORDERS, grams, strict=False) if b - a >= n])
            count = np.bincount(own, minlength=FEATURES)
            at = np.flatnonzero(count)
            yield i, at, count[at]


def vector(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(count)) * idf[at]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], df: np.ndarray, n_docs: int, how: Training) -> Model:
    """FTRL-proximal with elastic net, then one temperature for the logits of rows held back."""
    languages = tuple(sorted({r[2] for r in rows}))
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    k = len(languages)
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))
    rng = np.random.default_rng(how.seed)
    order = rng.permutation(len(rows))
    cut = int(len(rows) * how.held_back) if len(rows) >= 8 else 0
    back, train = order[:cut], order[cut:]
    label = np.array([languages.index(r[2]) for r in rows], dtype=np.int64)
    data = [(np.append(a, FEATURES), np.append(vector(a, c, idf), 1.0)) for a, c, _ in rows]

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = -(z - np.sign(z) * how.l1) / ((how.beta + np.sqrt(n)) / how.alpha + how.l2)
        w[np.abs(z) <= how.l1] = 0
        return w

    for _ in range(how.epochs):
        for i in rng.permutation(train):
            at, x = data[i]
            own_z, own_n = z[at], n[at]
            w = weights(own_z, own_n)
            g = _softmax(x @ w)
            g[label[i]] -= 1
            grad = x[:, None] * g
            step = (np.sqrt(own_n + grad * grad) - np.sqrt(own_n)) / how.alpha
            z[at] = own_z + grad - step * w
            n[at] = own_n + grad * grad
    w = weights(z, n)
    temperature = 1.0
    if cut:
        logits = np.array([data[i][1] @ w[data[i][0]] for i in back])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 241))
        loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(cut), label[back]], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return Model(languages, idf.astype(np.float32), w[:-1].astype(np.float32), w[-1].astype(np.float32), temperature)


def may_learn(doc_id: Column) -> Column:
    """Whether a row's label may be learnt from: four rows of five, by a checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(True))


def train(docs: DataFrame, how: Training = Training()) -> Model | None:
    """Fit on docs (doc_id, text, lang); None if no row has a label and a letter.

    Document frequencies come from all labelled rows that may be learnt from;
    the weights from a sample of them, by a hash of the id, with about equally
    many rows of each language and ``sample_rows`` in all.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(may_learn(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    count = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(how.max_languages + 1).collect()}
    if len(count) > how.max_languages:
        raise ValueError(f"more than {how.max_languages} labels")
    if not count:
        return None
    share = how.sample_rows / len(count)
    chance = F.element_at(F.create_map(*(F.lit(x) for g, n in count.items() for x in (g, min(1.0, share / n)))), F.col("lang"))
    sampled = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) < chance * float(1 << 30)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        df = np.zeros(FEATURES, dtype=np.int64)
        n = 0
        label, idx, cnt = [], [], []
        for batch in batches:
            langs, chosen = batch.column(1), batch.column(2)
            for first, _, t in slices(batch.column(0)):
                for i, at, count in documents(t):
                    df[at] += 1
                    n += 1
                    if chosen[first + i].as_py():
                        label.append(langs[first + i].as_py())
                        idx.append(at.astype("<u4").tobytes())
                        cnt.append(count.astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.string()), pa.array(idx, pa.binary()), pa.array(cnt, pa.binary()), pa.array([None] * len(label), pa.int64())], names=["lang", "at", "n", "docs"])
        if n:
            seen = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([seen.astype("<u4").tobytes()], pa.binary()), pa.array([df[seen].astype("<u4").tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["lang", "at", "n", "docs"])

    from .runtime import dropped, written

    spark = docs.sparkSession
    parts = written(spark, rows.select("text", "lang", sampled.alias("chosen")).mapInArrow(frequencies, "lang string, at binary, n binary, docs long"), "language-features")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES, dtype=np.int64), 0
        for batch in batches:
            for at, count, docs_ in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                df[np.frombuffer(at, "<u4")] += np.frombuffer(count, "<u4")
                n += docs_
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["df", "docs"])

    df, n = np.zeros(FEATURES, dtype=np.int64), 0
    for r in parts.filter("docs IS NOT NULL").select("at", "n", "docs").coalesce(8).mapInArrow(summed, "df binary, docs long").collect():  # a vector of FEATURES per task
        df += np.frombuffer(r.df, dtype=np.int64)
        n += r.docs
    sample = [(np.frombuffer(r.at, "<u4").astype(np.int64), np.frombuffer(r.n, "<u4").astype(np.int64), r.lang) for r in parts.filter("lang IS NOT NULL").limit(2 * how.sample_rows).collect()]
    dropped(spark, parts)
    sample.sort(key=lambda s: (s[2], s[0].tobytes(), s[1].tobytes()))
    return fit(sample, df, n, how) if sample else None


def predict(t: Texts, model: Model | None) -> tuple[list[str], np.ndarray]:
    """Language and calibrated probability of each row."""
    label, score = [UNKNOWN] * t.n, np.zeros(t.n)
    if model is not None and len(t.data):
        for i, at, count in documents(t):
            z = vector(at, count, model.idf) @ model.weights[at] + model.bias
            p = _softmax(z / model.temperature)
            best = int(p.argmax())
            label[i], score[i] = model.languages[best], p[best]
    return label, score


def identify(docs: DataFrame, how: Training = Training()) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; the model is fitted on the same table.

    A null text, or one without letters, is ``und`` with score 0, as is every
    text if nothing could be learnt.  A null id isn't held out.  Of equal scores
    the first language by name wins.  Repeated rows get equal rows; an empty
    table gives an empty one; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, how))  # FEATURES floats for each of max_languages at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for first, last, t in slices(batch.column(2)):
                label, score = predict(t, model.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.array(label, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    src = docs.select("doc_id", (~may_learn(F.col("doc_id"))).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.5, how: Training = Training()) -> DataFrame:
    """The rows whose language is known with at least that probability, with all their columns.

    Where nothing could be learnt (no row with a label that may be learnt from)
    no language is known of any row, and all rows with a letter are kept.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, how))
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for first, last, t in slices(batch.column(text)):
                if model.value is None:
                    keep = np.zeros(t.n, dtype=bool)
                    keep[[i for i, _, _ in documents(t)] if len(t.data) else []] = True
                else:
                    label, score = predict(t, model.value)
                    keep = (score >= least) & (np.array(label) != UNKNOWN)
                yield batch.slice(first, last - first).filter(pa.array(keep))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
