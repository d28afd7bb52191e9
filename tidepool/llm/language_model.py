"""Interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark.

The model lies in the shared folder as sorted arrays, which workers memory-map:

* words: the 64-bit hashes of all words in files by their topmost bits,
  sorted, with their counts; a word's number is its place in all of them;
* bigrams: in ranges of the first word's number, sorted keys (first << 32 |
  second) and their counts in a byte each, larger counts beside;
* for each first word the total of its bigrams and how many of them were seen
  once, twice and more often; for each word after how many words it was seen;
* with order 3, trigrams: in ranges of the number of the bigram they begin with
  (its place in all bigrams), keys (bigram << 32 | third) and counts as above,
  and for each bigram the total of its trigrams and how many were seen once, twice
  and more often.  The bigrams' counts are then of the different words before
  them; those at the begin of a text, which have none, keep their own.

Counting is by sorted runs: a task sends each range's distinct keys once, as
compressed differences.  Nothing is pruned.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import pack_counts, pack_keys, summed, unpack_counts, unpack_keys
from .runtime import dropped, shared_dir, ship, written
from .shared_files import load, save
from .textbatch import Texts, slices

#: Training texts to a shard of words.
SHARD_TEXTS = 4096
#: Training tokens to a range of bigrams or trigrams: what one task sorts.
RANGE_TOKENS = 1 << 23
#: Distinct keys that a task gathers before it sends them.
RUN = 1 << 22
#: The numbers that stand for the text's begin and end among word hashes.
BEGIN, END = np.uint64(0x0B0E61D4C3A59687), np.uint64(0xE0D5A1B2C7F83946)
_BIG = 255
#: Files that a worker holds open.
MOST_MAPS = 256

_RUN = "part int, keys binary, counts binary"


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the numbers that hold for all of them."""

    folder: str
    shard_bits: int
    offsets: tuple[int, ...]  # first number of each word shard, and one past the last
    bounds: tuple[int, ...]  # first word of each range of bigrams
    tokens: int
    words: int
    discounts: tuple[float, float, float]  # of bigrams seen once, twice, more often
    low_discounts: tuple[float, float, float]  # of words seen after one word, two, more
    low_total: int
    low_weight: float  # of the uniform distribution
    order: int = 2
    pair_offsets: tuple[int, ...] = (0,)  # first number of each range's bigrams, and one past the last
    top_ranges: int = 0
    top_discounts: tuple[float, float, float] = (0.0,) * 3  # of trigrams

    @property
    def ranges(self) -> int:
        return len(self.bounds)


def _run(part: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pack_keys(keys)], pa.binary()), pa.array([pack_counts(counts)], pa.binary())], names=["part", "keys", "counts"])


def _merged(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a group's runs and their counts; a null run has none."""
    none = [np.zeros(0, dtype=np.uint64)]
    keys = none + [unpack_keys(b) for b in group.column("keys").to_pylist() if b is not None]
    counts = none + [unpack_counts(b) for b in group.column("counts").to_pylist() if b is not None]
    return summed(np.concatenate(keys), np.concatenate(counts))


def _save_counts(folder: str, name: str, counts: np.ndarray) -> None:
    """Counts in a byte each, and the larger ones beside."""
    save(folder, f"{name}.counts", np.minimum(counts, _BIG).astype(np.uint8))
    big = np.flatnonzero(counts >= _BIG)
    save(folder, f"{name}.big", np.concatenate([big.astype("<u8"), counts[big].astype("<u8")]))


def _kinds(context: np.ndarray, counts: np.ndarray, size: int) -> list[np.ndarray]:
    """For each context the total of its counts, and how many are one, two and more."""
    total = np.bincount(context, weights=counts.astype(np.float64), minlength=size).astype(np.uint64)
    return [total, *(np.bincount(context[(counts == k) if k < 3 else (counts >= 3)], minlength=size) for k in (1, 2, 3))]


def _save_firsts(folder: str, r: int, first: np.ndarray, counts: np.ndarray, size: int) -> None:
    total, *kinds = _kinds(first, counts, size)
    save(folder, f"first-{r}.stats", np.stack([total & np.uint64(0xFFFFFFFF), total >> np.uint64(32), *kinds], axis=1).astype("<u4").ravel())


def _exact(counts: np.ndarray, big: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The counts at places of arrays made by _save_counts."""
    c = counts[at].astype(np.float64)
    over = np.flatnonzero(c == _BIG)
    if len(over):
        pairs = big.reshape(2, -1)
        c[over] = pairs[1][np.searchsorted(pairs[0], at[over])]
    return c


def _found(keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key lies in sorted ones, and whether it does."""
    if not len(keys):
        return np.zeros(len(key), dtype=np.int64), np.zeros(len(key), dtype=bool)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return at, keys[at] == key


def _smoothed(c: np.ndarray, total: np.ndarray, kinds: list[np.ndarray], d: tuple[float, ...], low: np.ndarray) -> np.ndarray:
    """Discounted relative counts and the rest by ``low``; ``low`` alone after a context never seen."""
    seen = total > 0
    weight = (d[0] * kinds[0] + d[1] * kinds[1] + d[2] * kinds[2])[seen] / total[seen]
    out = low.copy()
    cut = np.choose(np.minimum(c, 3).astype(np.int64), (0.0, *d))
    out[seen] = np.maximum(c - cut, 0)[seen] / total[seen] + weight * low[seen]
    return out


class Runs:
    """Gathers keys and sends sorted distinct runs, cut by ``bounds`` (the first key of each part)."""

    def __init__(self, bounds: np.ndarray):
        self.bounds, self.keys, self.counts, self.held = bounds, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held >= RUN:
            keys, counts = summed(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts, self.held = [keys], [counts], len(keys)
            if self.held >= RUN // 2:
                yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            keys, counts = summed(np.concatenate(self.keys), np.concatenate(self.counts))
            cut = np.append(np.searchsorted(keys, self.bounds), len(keys))
            for part in range(len(self.bounds)):
                a, b = cut[part], cut[part + 1]
                if a < b:
                    yield _run(part, keys[a:b], counts[a:b])
        self.keys, self.counts, self.held = [], [], 0


def tokens(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and then its end; and where texts begin, and the end."""
    w = t.words(lower=True)
    off = w.row_off + np.arange(t.n + 1)
    out = np.insert(w.hashes(), w.row_off[1:], END)
    return out, off


# -- words ----------------------------------------------------------------


def shard_bounds(bits: int) -> np.ndarray:
    """The least hash of each shard."""
    return np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)


def _word_runs(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    runs = Runs(shard_bounds(bits))
    for batch in batches:
        for _, _, t in slices(batch.column(0)):
            keys, counts = np.unique(tokens(t)[0], return_counts=True)
            yield from runs.add(np.append(keys, BEGIN), np.append(counts, 0).astype(np.uint64))
    yield from runs.send()


@lru_cache(maxsize=2)
def _opened(model: Model) -> Arrays:
    return Arrays(model)


class Maps:
    """A model's files, mapped when they are asked for; of those the last MOST_MAPS stay open."""

    def __init__(self, folder: str):
        self.folder = folder
        self.open: OrderedDict[str, np.ndarray] = OrderedDict()

    def get(self, name: str, kind: str) -> np.ndarray:
        if name in self.open:
            self.open.move_to_end(name)
        else:
            self.open[name] = load(self.folder, name, kind)
            if len(self.open) > MOST_MAPS:
                self.open.popitem(last=False)  # its file is closed once no one uses the array
        return self.open[name]


class Arrays:
    """A model's arrays, by shard and range."""

    def __init__(self, m: Model):
        self.m = m
        self.maps = Maps(m.folder)
        self.bounds = np.array(m.bounds, dtype=np.int64)
        self.top_bounds = first_words(m.pair_offsets[-1], m.top_ranges)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and counts of sorted distinct hashes."""
        number, count = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        cut = np.append(np.searchsorted(hashes, shard_bounds(self.m.shard_bits)), len(hashes))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            if self.m.offsets[s] == self.m.offsets[s + 1]:
                continue
            own, keys = hashes[cut[s] : cut[s + 1]], self.maps.get(f"word-{s}.keys", "<u8")
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == own)
            number[cut[s] + hit] = self.m.offsets[s] + at[hit]
            count[cut[s] + hit] = self.maps.get(f"word-{s}.counts", "<u8")[at[hit]]
        return number, count

    def range_of(self, r: int) -> tuple:
        own = "pair" if self.m.order == 2 else "near"
        names = (("pair-{}.keys", "<u8"), (own + "-{}.counts", "u1"), (own + "-{}.big", "<u8"), ("first-{}.stats", "<u4"), ("second-{}.after", "<u4"))
        return tuple(self.maps.get(n.format(r), k) for n, k in names)

    def keys_of(self, r: int) -> np.ndarray:
        return self.maps.get(f"pair-{r}.keys", "<u8")

    def pair_numbers(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of sorted keys of bigrams that the model has."""
        number = np.empty(len(keys), dtype=np.int64)
        cut = np.append(np.searchsorted(keys, self.bounds.astype(np.uint64) << np.uint64(32)), len(keys))
        for r in np.flatnonzero(np.diff(cut)).tolist():
            a, b = cut[r], cut[r + 1]
            if a < b:
                number[a:b] = self.m.pair_offsets[r] + np.searchsorted(self.keys_of(r), keys[a:b])
        return number

    def seconds(self, start: int, end: int) -> np.ndarray:
        """The second words of the bigrams with these numbers."""
        off = self.m.pair_offsets
        parts = [self.keys_of(r)[max(0, start - off[r]) : end - off[r]] for r in range(self.m.ranges) if off[r] < end and off[r + 1] > start]
        return np.concatenate([np.zeros(0, dtype=np.uint64), *parts]) & np.uint64(0xFFFFFFFF)

    def top_of(self, r: int) -> tuple:
        names = (("top-{}.keys", "<u8"), ("top-{}.counts", "u1"), ("top-{}.big", "<u8"), ("context-{}.stats", "u1"), ("context-{}.big", "<u8"))
        return tuple(self.maps.get(n.format(r), k) for n, k in names)

    def low(self, numbers: np.ndarray) -> np.ndarray:
        """Probability of sorted words whatever comes before, -1 being unknown."""
        after = np.zeros(len(numbers))
        cut = np.append(np.searchsorted(numbers, self.bounds), len(numbers))
        for r in np.flatnonzero(np.diff(cut)).tolist():
            own = numbers[cut[r] : cut[r + 1]]
            after[cut[r] : cut[r + 1]] = self.maps.get(f"second-{r}.after", "<u4")[own - int(self.bounds[r])]
        d = np.choose(np.minimum(after, 3).astype(np.int64), (0.0, *self.m.low_discounts))
        return np.maximum(after - d, 0) / max(1, self.m.low_total) + self.m.low_weight / (self.m.words + 1)

    def probability(self, first: np.ndarray, second: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs sorted by first and second, -1 being unknown, and their numbers; low: the second word's own probability."""
        out, number = low.copy(), np.full(len(first), -1, dtype=np.int64)
        cut = np.append(np.searchsorted(first, self.bounds), len(first))
        for r in np.flatnonzero(np.diff(cut)).tolist():
            a, b = cut[r], cut[r + 1]
            keys, counts, big, stats, _ = self.range_of(r)
            f = first[a:b]
            own = stats.reshape(-1, 5)[f - int(self.bounds[r])].astype(np.float64)
            at, hit = _found(keys, (f.astype(np.uint64) << np.uint64(32)) | np.maximum(second[a:b], 0).astype(np.uint64))
            hit &= second[a:b] >= 0
            c = np.zeros(b - a)
            c[hit] = _exact(counts, big, at[hit])
            if self.m.order > 2:
                number[a:b][hit] = self.m.pair_offsets[r] + at[hit]
            out[a:b] = _smoothed(c, own[:, 0] + own[:, 1] * 2.0**32, [own[:, k] for k in (2, 3, 4)], self.m.discounts, low[a:b])
        return out, number

    def top(self, pair: np.ndarray, third: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Of trigrams sorted by the number of their first two words; low: the third word's probability after the second."""
        out = low.copy()
        cut = np.append(np.searchsorted(pair, self.top_bounds), len(pair))
        for r in np.flatnonzero(np.diff(cut)).tolist():
            a, b = cut[r], cut[r + 1]
            keys, counts, big, stats, big_stats = self.top_of(r)
            context = pair[a:b] - int(self.top_bounds[r])
            own = stats.reshape(-1, 4)[context].astype(np.float64)
            over = np.flatnonzero(own[:, 0] == _BIG)
            if len(over):
                exact = big_stats.reshape(5, -1)
                own[over] = exact[1:, np.searchsorted(exact[0], context[over])].T
            at, hit = _found(keys, (pair[a:b].astype(np.uint64) << np.uint64(32)) | np.maximum(third[a:b], 0).astype(np.uint64))
            hit &= third[a:b] >= 0
            c = np.zeros(b - a)
            c[hit] = _exact(counts, big, at[hit])
            out[a:b] = _smoothed(c, own[:, 0], [own[:, k] for k in (1, 2, 3)], self.m.top_discounts, low[a:b])
        return out


def first_words(words: int, ranges: int) -> np.ndarray:
    """The first number of each range."""
    return np.array([words * r // ranges for r in range(ranges)], dtype=np.int64)


def _cuts(counts: np.ndarray, tokens: int) -> list[int]:
    """Where in a shard of words new ranges begin: about so many tokens each, and a word with as many has its own."""
    before = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
    step = before // tokens
    often = np.flatnonzero(counts >= tokens)
    at = np.concatenate([np.flatnonzero(step[1:] > step[:-1]) + 1, often])
    return [int(x) for x in np.unique(at) if 0 < x < len(counts)]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many n-grams were seen once, twice, three and four times."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9  # too few n-grams to estimate from
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * more / less, 0.0), float(k)) for k, less, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def train(docs: DataFrame, order: int = 2, range_tokens: int = RANGE_TOKENS) -> Model | None:
    """Count a model of docs (text); None if there are no rows."""
    if order not in (2, 3):
        raise ValueError(f"order {order}: a model is of order 2 or 3")
    spark = docs.sparkSession
    ship(spark)
    folder = f"{shared_dir(spark)}/tidepool/model-{uuid.uuid4().hex}"
    texts = docs.select(F.col("text").cast("string").alias("text"))
    bits = min(16, max(1, (docs.count() // SHARD_TEXTS).bit_length()))  # words are numbered in 32 bits, so 2**16 shards never hold more than 2**16 words each

    def every(parts: int, schema: str) -> DataFrame:
        """A row without a run for each part, so that the files of all are made."""
        return spark.range(parts).select(*(F.col("id").cast("int").alias(c) if c == "part" else F.lit(None).cast(k).alias(c) for c, k in (x.strip().split(" ") for x in schema.split(","))))

    def save_words(group: pa.Table) -> pa.Table:
        keys, counts = _merged(group)
        s = group.column("part")[0].as_py()
        save(folder, f"word-{s}.keys", keys.astype("<u8"))
        save(folder, f"word-{s}.counts", counts.astype("<u8"))
        return pa.table({"part": pa.array([s], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64()), "known": pa.array([int((counts > 0).sum())], pa.int64()), "cuts": pa.array([_cuts(counts, range_tokens)], pa.list_(pa.int64()))})

    found = {r.part: r for r in texts.mapInArrow(lambda batches: _word_runs(batches, bits), _RUN).groupBy("part").applyInArrow(save_words, "part int, n long, tokens long, known long, cuts array<long>").collect()}  # a row per shard
    if not found:
        return None
    offsets = [0]
    for s in range(1 << bits):
        offsets.append(offsets[-1] + (found[s].n if s in found else 0))
    if offsets[-1] >= 1 << 32:
        raise ValueError("more than 2**32 distinct words: bigram keys need wider numbers")
    n_tokens, known = sum(r.tokens for r in found.values()), sum(r.known for r in found.values())
    starts, held = {0, *first_words(offsets[-1], 4).tolist()}, 0
    for s in sorted(found):
        starts |= {offsets[s] + c for c in found[s].cuts}
        held = 0 if found[s].cuts else held + found[s].tokens
        if held >= range_tokens:
            starts.add(offsets[s + 1])
            held = 0
    bounds = np.array(sorted(b for b in starts if b < offsets[-1]), dtype=np.int64)
    ranges = len(bounds)
    model = Model(folder, bits, tuple(offsets), tuple(bounds.tolist()), n_tokens, known, (0.0,) * 3, (0.0,) * 3, 0, 1.0)

    def pair_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = _opened(model)
        begin = arrays.look_up(np.array([BEGIN]))[0][0]
        runs = Runs(bounds.astype(np.uint64) << np.uint64(32))
        for batch in batches:
            for _, _, t in slices(batch.column(0)):
                h, off = tokens(t)
                distinct, inverse = np.unique(h, return_inverse=True)
                number = arrays.look_up(distinct)[0][inverse]
                keys, counts = np.unique((_before(number, off, begin) << 32 | number).astype(np.uint64), return_counts=True)
                yield from runs.add(keys, counts.astype(np.uint64))
        yield from runs.send()

    def save_pairs(group: pa.Table) -> pa.Table:
        keys, counts = _merged(group)
        r = group.column("part")[0].as_py()
        start, end = int(bounds[r]), int(bounds[r + 1]) if r + 1 < ranges else offsets[-1]
        save(folder, f"pair-{r}.keys", keys.astype("<u8"))
        first = (keys >> np.uint64(32)).astype(np.int64)
        if order == 2:
            _save_counts(folder, f"pair-{r}", counts)
            _save_firsts(folder, r, first - start, counts, end - start)
        else:  # of own counts only those at the begin of a text are needed
            save(folder, f"open-{r}.counts", counts[first == _opened(model).look_up(np.array([BEGIN]))[0][0]].astype("<u8"))
        second, after = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
        return after_runs(second, after, bounds.astype(np.uint64), [r, len(keys), *_of_counts(counts)])

    def after_runs(keys: np.ndarray, counts: np.ndarray, at: np.ndarray, n: list[int]) -> pa.Table:
        """Runs of keys, cut by ``at``, and a row with part -1 for n."""
        cut = np.append(np.searchsorted(keys, at), len(keys))
        rows = [(p, pack_keys(keys[a:b]), pack_counts(counts[a:b]), None) for p, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b]
        rows.append((-1, None, None, n))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["part", "keys", "counts", "n"])

    paired = written(spark, texts.mapInArrow(pair_runs, _RUN).union(every(ranges, _RUN)).groupBy("part").applyInArrow(save_pairs, _RUN + ", n array<long>"), "model-after")
    each = [r.n for r in paired.filter("part < 0").select("n").collect()]  # a row per range
    total = [sum(x) for x in zip(*each, strict=True)][1:]

    def save_after(group: pa.Table) -> pa.Table:
        keys, counts = _merged(group)
        r = group.column("part")[0].as_py()
        start, end = int(bounds[r]), int(bounds[r + 1]) if r + 1 < ranges else offsets[-1]
        dense = np.zeros(end - start, dtype="<u4")
        dense[keys.astype(np.int64) - start] = counts
        save(folder, f"second-{r}.after", dense)
        return pa.table({"part": pa.array([r], pa.int32()), "n": pa.array([[*_of_counts(dense), int((dense >= 3).sum())]], pa.list_(pa.int64()))})

    low = {r.part: r.n for r in paired.filter("part >= 0").select("part", "keys", "counts").union(every(ranges, _RUN)).groupBy("part").applyInArrow(save_after, "part int, n array<long>").collect()}  # a row per range
    dropped(spark, paired)
    kinds = [sum(x) for x in zip(*low.values(), strict=True)]
    d = discounts(kinds[:4])
    weight = (d[0] * kinds[0] + d[1] * kinds[1] + d[2] * kinds[4]) / max(1, total[0])
    model = replace(model, discounts=discounts(total[1:]), low_discounts=d, low_total=total[0], low_weight=weight)
    if order == 2:
        return model

    # -- trigrams --
    if total[0] >= 1 << 32:
        raise ValueError("more than 2**32 distinct bigrams: trigram keys need wider numbers")
    size = {x[0]: x[1] for x in each}
    pair_offsets = [0]
    for r in range(ranges):
        pair_offsets.append(pair_offsets[-1] + size.get(r, 0))
    tops = min(max(4, -(-n_tokens // range_tokens)), total[0])
    model = replace(model, order=3, pair_offsets=tuple(pair_offsets), top_ranges=tops)
    top_bounds = first_words(total[0], tops)

    def top_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = _opened(model)
        begin = arrays.look_up(np.array([BEGIN]))[0][0]
        runs = Runs(top_bounds.astype(np.uint64) << np.uint64(32))
        for batch in batches:
            for _, _, t in slices(batch.column(0)):
                h, off = tokens(t)
                distinct, inverse = np.unique(h, return_inverse=True)
                number = arrays.look_up(distinct)[0][inverse].astype(np.uint64)
                pairs, inverse = np.unique((_before(number, off, begin) << np.uint64(32)) | number, return_inverse=True)
                pair = arrays.pair_numbers(pairs)[inverse].astype(np.uint64)
                later = np.ones(len(h), dtype=bool)
                later[off[:-1]] = False  # a text's first token has but one before it
                at = np.flatnonzero(later)
                keys, counts = np.unique((pair[at - 1] << np.uint64(32)) | number[at], return_counts=True)
                yield from runs.add(keys, counts.astype(np.uint64))
        yield from runs.send()

    def save_tops(group: pa.Table) -> pa.Table:
        keys, counts = _merged(group)
        r = group.column("part")[0].as_py()
        start, end = int(top_bounds[r]), int(top_bounds[r + 1]) if r + 1 < tops else total[0]
        save(folder, f"top-{r}.keys", keys.astype("<u8"))
        _save_counts(folder, f"top-{r}", counts)
        context = (keys >> np.uint64(32)).astype(np.int64) - start
        stats = np.stack(_kinds(context, counts, end - start)).astype(np.uint64)
        big = np.flatnonzero(stats[0] >= _BIG)
        save(folder, f"context-{r}.stats", np.minimum(stats, _BIG).astype(np.uint8).T.ravel())
        save(folder, f"context-{r}.big", np.concatenate([big.astype("<u8"), stats[:, big].astype("<u8").ravel()]))
        last, before = np.unique((_opened(model).seconds(start, end)[context] << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF)), return_counts=True)
        return after_runs(last, before, bounds.astype(np.uint64) << np.uint64(32), _of_counts(counts))

    def save_near(group: pa.Table) -> pa.Table:
        r = group.column("part")[0].as_py()
        if r < 0:
            n = np.sum(group.column("n").to_pylist(), axis=0).tolist()
        else:
            keys, counts = _merged(group)
            pairs, own = load(folder, f"pair-{r}.keys", "<u8"), load(folder, f"open-{r}.counts", "<u8")
            first = (pairs >> np.uint64(32)).astype(np.int64)
            near = np.zeros(len(pairs), dtype=np.uint64)
            near[np.searchsorted(pairs, keys)] = counts
            near[first == _opened(model).look_up(np.array([BEGIN]))[0][0]] = own
            start, end = int(bounds[r]), int(bounds[r + 1]) if r + 1 < ranges else offsets[-1]
            _save_counts(folder, f"near-{r}", near)
            _save_firsts(folder, r, first - start, near, end - start)
            n = _of_counts(near)
        return pa.table({"part": pa.array([r], pa.int32()), "n": pa.array([n], pa.list_(pa.int64()))})

    counted = texts.mapInArrow(top_runs, _RUN).union(every(tops, _RUN)).groupBy("part").applyInArrow(save_tops, _RUN + ", n array<long>")
    kinds = {r.part: r.n for r in counted.union(every(ranges, _RUN + ", n array<long>")).groupBy("part").applyInArrow(save_near, "part int, n array<long>").collect()}  # a row per range
    near = [sum(x) for x in zip(*(n for part, n in kinds.items() if part >= 0), strict=True)]
    return replace(model, discounts=discounts(near), top_discounts=discounts(kinds[-1]))


def _before(number: np.ndarray, off: np.ndarray, begin: int) -> np.ndarray:
    """The word before each token; at the begin of a text the begin's own number."""
    out = np.empty_like(number)
    out[1:] = number[:-1]
    out[off[:-1]] = begin
    return out


def learns(doc_id: Column) -> Column:
    """Whether a row belongs to the training part: six of seven, by a checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 != 2, F.lit(True))


def score(t: Texts, model: Model | None) -> tuple[np.ndarray, ...]:
    """Tokens, known tokens, base score and score of each row."""
    h, off = tokens(t)
    n = np.diff(off)
    row = np.repeat(np.arange(t.n), n)
    if model is None:
        zero = np.zeros(t.n)
        return n, zero.astype(np.int64), zero, zero  # nothing learnt: one unknown token, of probability 1
    arrays = _opened(model)
    distinct, inverse = np.unique(h, return_inverse=True)
    number, count = arrays.look_up(distinct)
    base = np.log10((count + 1) / (model.tokens + model.words + 1))[inverse]
    own = np.bincount(row, weights=(count > 0)[inverse], minlength=t.n).astype(np.int64)

    low_of = np.argsort(number, kind="stable")
    low = np.empty(len(distinct))
    low[low_of] = arrays.low(number[low_of])
    begin = arrays.look_up(np.array([BEGIN]))[0][0]
    first = _before(number[inverse], off, begin)
    key, back = np.unique((first + 1) << 32 | inverse, return_inverse=True)
    f, which = (key >> 32) - 1, key & 0xFFFFFFFF
    order = np.lexsort((number[which], f))
    p = np.empty(len(key))
    pair = np.empty(len(key), dtype=np.int64)
    p[order], pair[order] = arrays.probability(f[order], number[which][order], low[which][order])
    logs = np.log10(p)[back]
    if model.order > 2:
        before = _before(pair[back], off, -1)
        at = np.flatnonzero(before >= 0)
        third = number[inverse][at]
        at = at[np.argsort((before[at].astype(np.uint64) << np.uint64(32)) | np.maximum(third, 0).astype(np.uint64), kind="stable")]
        logs[at] = np.log10(arrays.top(before[at], number[inverse[at]], p[back[at]]))
    return n, own, np.bincount(row, weights=base, minlength=t.n), np.bincount(row, weights=logs, minlength=t.n)


def perplexity(docs: DataFrame, order: int = 2, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row.

    The model, of order 2 or 3, is counted over the rows of the same table that aren't held out.
    A null text is empty: one token, the end.  A null id isn't held out.
    Repeated rows count and score like any other; where nothing could be learnt
    scores are 0.  An empty table gives no row; other columns are ignored.
    """
    model = train(docs.filter(learns(F.col("doc_id"))), order, range_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, t in slices(batch.column(2)):
                n, known, base, own = score(t, model)
                size = last - first
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, size), batch.column(1).slice(first, size), pa.array(n), pa.array(known), pa.array(np.full(size, model.tokens if model else 0)), pa.array(base), pa.array(own), pa.array(10.0 ** (-own / n))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    src = docs.select("doc_id", (~learns(F.col("doc_id"))).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
