"""Exact Jaccard self-join on word n-grams by rare-first prefix filtering.

Texts with the same set of n-grams are one class, named by a hash of the set.
All n-grams are put in one order, rarest first; two sets that reach the threshold
share an n-gram among the first few of each (the prefix), so only n-grams of
prefixes are joined.  Candidates are pruned by the lengths of the sets, by the
positions and the number of the shared n-grams, and by a bound on the overlap of the rest (the
counts of both sets in SUFFIX_BINS ranges of the hash), and each pair that is
left is verified once on the words of both texts.

The order comes from counts over all texts.  A run of texts sends each n-gram's
leading bits once to the range that counts them (``_counted``); what comes back is
how frequent the run's n-grams are, without those that no other text has.  These
come first in the order and are never joined, so they leave no row at all.

Links are found in rounds.  In each, of all classes that share a prefix n-gram
only pairs with one leader are verified, per component found so far: the class
whose prefix is the most common, which is the least edited one of a group of near
copies and the same one for nearly all of its n-grams.  Then pairs of classes already connected are passed over,
and the last round verifies every pair that is left, so no link between
different components is missed and a group of n near copies costs about n pairs.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .runs import pack_counts, pack_keys, summed, unpack_counts, unpack_keys
from .runtime import dropped, looked_up, ship, written
from .textbatch import Texts, mix64, slices, windows
from .transducer import release

#: Bytes of text to a run: what is counted, sent and looked up together.
RUN_BYTES = 8 << 20
#: N-grams to a range of counts: what one task sorts.
RANGE_GRAMS = 1 << 22
SUFFIX_BINS = 32
#: Classes whose sizes differ by less than this factor are in one band of lengths.
BAND = 1.02
#: Rounds with leaders before the one that verifies all pairs left.
LEADER_ROUNDS = 1
#: So many classes (8 bytes each) are looked for by a broadcast, more by a shuffle.
BROADCAST_SETS = 1 << 20


@dataclass(frozen=True)
class Rule:
    """Two sets link when 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80

    def least_overlap(self, total):
        """The least intersection of two linked sets whose sizes sum to ``total``."""
        return -(-self.percent * total // (100 + self.percent))

    def prefix(self, n):
        """How many n-grams of a set of n are joined."""
        return n - -(-self.percent * n // 100) + 1


def shingle_sets(t: Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hashes end to end, sorted and distinct in each row; where rows begin and the end)."""
    w = t.words(lower=True)
    h = w.hashes()
    grams, at = windows(h, w.row_off, words)
    row = w.rows()[at]
    few = np.flatnonzero((w.count > 0) & (w.count < words))
    if len(few):
        # a shorter text is one n-gram of all its words
        short = []
        for i in few:
            own = h[w.row_off[i] : w.row_off[i + 1]]
            key = np.uint64(len(own))
            for x in own:
                key = mix64(np.array([key ^ x]))[0]
            short.append(key)
        grams, row = np.concatenate([grams, np.array(short, dtype=np.uint64)]), np.concatenate([row, few])
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    first = np.ones(len(grams), dtype=bool)
    first[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[first], row[first]
    return grams, np.searchsorted(row, np.arange(t.n + 1))


def signatures(grams: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for the empty one."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(grams ^ np.uint64(0x5BD1E995)), dtype=np.uint64)])
    n = np.diff(off)
    sig = mix64((total[off[1:]] - total[off[:-1]]) ^ mix64(n.astype(np.uint64)))
    sig[n == 0] = 0
    return sig


def _described(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n, sig, bins, run, text of every row; of equal sets in a run one keeps its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        name, held, seen = 0, RUN_BYTES, set()
        for batch in batches:
            for first, last, t in slices(batch.column(1)):
                if held + len(t.data) > RUN_BYTES:
                    name, held, seen = uuid.uuid4().int >> 65, 0, set()
                held += len(t.data)
                grams, off = shingle_sets(t, rule.words)
                n, sig = np.diff(off), signatures(grams, off)
                new = [bool(s) and s not in seen and seen.add(s) is None for s in sig.tolist()]
                rows = np.repeat(np.arange(t.n), n)
                bins = np.bincount(rows * SUFFIX_BINS + (grams >> np.uint64(59)).astype(np.int64), minlength=t.n * SUFFIX_BINS).astype("<u4").tobytes()
                width = 4 * SUFFIX_BINS
                text = batch.column(1).slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(n), pa.array(sig.view(np.int64)), pa.array([bins[i * width : (i + 1) * width] if new[i] else None for i in range(t.n)], pa.binary()), pa.array(np.full(t.n, name)), text.take(pa.array([i if new[i] else None for i in range(t.n)], pa.int64()))],
                    names=["doc_id", "n", "sig", "bins", "run", "text"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n long, sig long, bins binary, run long, text string")


_COUNTED = "part int, run long, keys binary, counts binary"


def _counted(texts: DataFrame, rule: Rule, total: int) -> tuple[DataFrame, np.uint64]:
    """How frequent the n-grams of each run are (run, keys, ranks), without those of one text only; and what a hash is shifted by.

    An n-gram is counted by the leading bits of its hash, 10 more than it takes
    to number all; where two share them both only seem more frequent.  A run
    sends a key once, however many of its texts have it.
    """
    shift = np.uint64(max(0, 64 - (total.bit_length() + 10)))
    parts = max(1, -(-total // RANGE_GRAMS))
    bounds = np.array([(part << 64) // parts for part in range(parts)], dtype=np.uint64) >> shift

    def sent(name: int, keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        own, counts = np.unique(np.concatenate(keys), return_counts=True)
        cut = np.append(np.searchsorted(own, bounds), len(own))
        rows = [(p, name, pack_keys(own[a:b]), pack_counts(counts[a:b])) for p, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "run", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, keys = None, []
        for batch in batches:
            names = np.asarray(batch.column(0))
            cuts = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else []
            for a, b in zip(cuts, [*cuts[1:], len(names)], strict=True):
                if keys and names[a] != name:
                    yield from sent(name, keys)
                    keys = []
                name = int(names[a])
                keys += [shingle_sets(t, rule.words)[0] >> shift for _, _, t in slices(batch.column(1).slice(a, b - a))]
        if keys:
            yield from sent(name, keys)

    def shared(group: pa.Table) -> pa.Table:
        runs = group.column("run").to_pylist()
        keys = [unpack_keys(b) for b in group.column("keys").to_pylist()]
        every, count = summed(np.concatenate(keys), np.concatenate([unpack_counts(b) for b in group.column("counts").to_pylist()]))
        every, count = every[count > 1], count[count > 1]
        rank = np.minimum(255, np.round(8 * np.log2(count))).astype(np.uint8)
        rows = []
        for name, own in zip(runs, keys, strict=True):
            at = np.minimum(np.searchsorted(every, own), max(0, len(every) - 1))
            hit = every[at] == own if len(every) else np.zeros(len(own), dtype=bool)
            if hit.any():
                rows.append((name, pack_keys(own[hit]), zlib.compress(rank[at[hit]].tobytes(), 1)))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["run", "keys", "ranks"])

    return texts.select("run", "text").mapInArrow(run, _COUNTED).groupBy("part").applyInArrow(shared, "run long, keys binary, ranks binary"), shift


def _prefixes(texts: DataFrame, rule: Rule, total: int) -> DataFrame:
    """gram, sig, n, pos, common for the n-grams in the prefix of each set that others have too.

    common: how frequent the n-grams of the prefix are on average; the base of a
    group of near copies has none of their own rare n-grams and so the highest.
    """
    ranks, shift = _counted(texts, rule, total)

    def prefix(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = np.concatenate([np.zeros(0, np.uint64), *(unpack_keys(b) for b in right.column("keys").to_pylist())])
        rank = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(zlib.decompress(b), dtype=np.uint8) for b in right.column("ranks").to_pylist())])
        order = np.argsort(keys)
        keys, rank = keys[order], rank[order]
        out = [[] for _ in range(5)]
        for _, _, t in slices(left.column("text")):
            grams, off = shingle_sets(t, rule.words)
            sig, n = signatures(grams, off), np.diff(off)
            row = np.repeat(np.arange(t.n), n)
            rare = np.zeros(len(grams), dtype=np.uint8)
            if len(keys):
                own = grams >> shift
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                rare = np.where(keys[at] == own, rank[at], 0)
            order = np.lexsort((grams, rare, row))
            grams, rare = grams[order], rare[order]
            pos = np.arange(len(grams)) - off[row]
            take = pos < rule.prefix(n)[row]
            common = (1000 * np.bincount(row[take], weights=rare[take], minlength=t.n) / np.maximum(rule.prefix(n), 1)).astype(np.int32)
            take &= rare > 0
            for a, v in zip(out, (grams[take].view(np.int64), sig[row[take]].view(np.int64), n[row[take]].astype(np.int32), pos[take].astype(np.int32), common[row[take]]), strict=True):
                a.append(v)
        kinds = (np.int64, np.int64, np.int32, np.int32, np.int32)
        return pa.Table.from_arrays([pa.array(np.concatenate([np.zeros(0, k), *a])) for a, k in zip(out, kinds, strict=True)], names=["gram", "sig", "n", "pos", "common"])

    by_run = texts.select("run", "text").groupBy("run").cogroup(ranks.groupBy("run"))
    return by_run.applyInArrow(prefix, "gram long, sig long, n int, pos int, common int")


def _least(rule: Rule, na: Column, nb: Column) -> Column:
    return F.ceil((na + nb) * rule.percent / (100 + rule.percent))


def _possible(rule: Rule, a: str, b: str) -> Column:
    """Length and positional filters for two rows of the same n-gram.

    The first n-gram that two linked sets share leaves room for the least overlap
    in both, so rows beyond that position needn't name the pair: another row does.
    """
    na, nb, pa_, pb = (F.col(f"{x}.{c}") for c in ("n", "pos") for x in (a, b))
    least = _least(rule, na, nb)
    return (100 * F.least(na, nb) >= rule.percent * F.greatest(na, nb)) & (pa_ <= na - least) & (pb <= nb - least)


def _alike(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Suffix filter: pairs whose sets could still overlap enough, from their counts by range of hash."""
    both = pairs.join(sets.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("bins").alias("ba")), "a").join(sets.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("bins").alias("bb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ba, bb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, SUFFIX_BINS).astype(np.int64) for c in (3, 5))
            total = np.asarray(batch.column(2)) + np.asarray(batch.column(4))
            most = np.minimum(ba, bb).sum(axis=1)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(most >= rule.least_overlap(total)))

    return both.select("a", "b", "na", "ba", "nb", "bb").mapInArrow(run, "a long, b long")


def _words(text: str, size: int) -> set[tuple[bytes, ...]]:
    """The n-grams of a text, as the words themselves."""
    own = text.encode().lower().split()
    return set(zip(*(own[i:] for i in range(size)), strict=False)) if len(own) >= size else {tuple(own)}


def _verified(texts: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets reach the threshold, by their words."""
    spark = texts.sparkSession
    asked = written(spark, pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), "jaccard-asked")
    few = asked.count() <= BROADCAST_SETS
    found = texts.select("sig", "text").join(F.broadcast(asked) if few else asked, "sig", "left_semi")
    # a set may come from several runs: any of its texts has all of its n-grams
    sets = written(spark, found.groupBy("sig").agg(F.first("text").alias("text")), "jaccard-sets")
    both = pairs.select("a", "b").join(sets.select(F.col("sig").alias("a"), F.col("text").alias("ta")), "a").join(sets.select(F.col("sig").alias("b"), F.col("text").alias("tb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        last: dict[int, tuple[int | None, set]] = {0: (None, set()), 1: (None, set())}
        for batch in batches:
            ok = []
            for i, ends in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                for k, end in enumerate(ends):
                    if last[k][0] != end:  # neighbours often share an end
                        last[k] = end, _words(batch.column(2 + k)[i].as_py(), rule.words)
                x, y = last[0][1], last[1][1]
                same = len(x & y)
                ok.append(100 * same >= rule.percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    out = written(spark, both.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long"), "jaccard-links")
    dropped(spark, asked)
    dropped(spark, sets)
    return out


def _rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return rows.withColumn("root", F.col("sig"))
    return rows.join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))


def _named(joined: DataFrame, x: str, y: str, rule: Rule) -> DataFrame:
    """Each pair once, the smaller name first.

    The positional filter once more, over all n-grams that named the pair: the
    overlap is at most their number and what follows the last of them in the set
    with less left.
    """
    low = F.col(f"{x}.sig") < F.col(f"{y}.sig")
    pick = lambda c, p, q: F.when(low, F.col(f"{p}.{c}")).otherwise(F.col(f"{q}.{c}"))
    ends = [pick(c, p, q).alias(f"{c}_{e}") for c in ("sig", "n", "pos") for e, p, q in (("a", x, y), ("b", y, x))]
    pairs = joined.select(*ends).groupBy(F.col("sig_a").alias("a"), F.col("sig_b").alias("b")).agg(F.first("n_a").alias("na"), F.first("n_b").alias("nb"), F.max("pos_a").alias("la"), F.max("pos_b").alias("lb"), F.count(F.lit(1)).alias("met"))
    na, nb = F.col("na"), F.col("nb")
    most = F.col("met") + F.least(na - F.col("la"), nb - F.col("lb")) - 1
    return pairs.filter(most >= _least(rule, na, nb)).select("a", "b")


def _leader_pairs(posts: DataFrame, rule: Rule) -> DataFrame:
    """Each class with its n-gram's leader, unless they are connected already."""
    lead = posts.groupBy("gram").agg(F.max(F.struct("common", "sig", "n", "pos", "root")).alias("l"))
    p = posts.alias("p").join(lead.select(F.col("gram").alias("g"), F.col("l.*")).alias("l"), F.col("p.gram") == F.col("g"))
    return _named(p.filter((F.col("p.root") != F.col("l.root")) & _possible(rule, "p", "l")), "p", "l", rule)


def _all_pairs(posts: DataFrame, rule: Rule) -> DataFrame:
    """Every pair of an n-gram whose classes are not connected yet.

    Sizes are dealt to narrow bands.  What a band holds of an n-gram (its least
    size, the largest size that one of its rows could link with, its roots) says
    whether a row can meet a partner there; only such rows are joined with it, so
    many texts that share a passage too short for a link make no pairs.
    """
    n, band = F.col("n"), F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND))).cast("int")
    cap = F.floor((n - F.col("pos")) * (100 + rule.percent) / rule.percent) - n  # the largest size that _possible allows beside this row
    rows = posts.withColumn("band", band).withColumn("cap", cap)
    held = rows.groupBy("gram", "band").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("cap").alias("top"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    bands = held.groupBy("gram").agg(F.collect_list(F.struct("band", "least", "most", "top", "lo", "hi")).alias("bands"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("gram", "bands")
    meets = lambda b: (b["band"] <= F.col("band")) & (b["least"] <= F.col("cap")) & (b["top"] >= n) & (100 * b["most"] >= rule.percent * n) & ((b["lo"] != F.col("root")) | (b["hi"] != F.col("root")))
    asks = rows.join(bands, "gram").withColumn("at", F.explode(F.filter("bands", meets))).select("gram", F.col("at.band").alias("band"), "sig", "n", "pos", "root")
    p = asks.alias("p").join(rows.alias("q"), (F.col("p.gram") == F.col("q.gram")) & (F.col("p.band") == F.col("q.band")))
    larger = (F.col("q.n") < F.col("p.n")) | (F.col("q.n") == F.col("p.n")) & (F.col("q.sig") < F.col("p.sig"))
    return _named(p.filter(larger & (F.col("p.root") != F.col("q.root")) & _possible(rule, "p", "q")), "p", "q", rule)


def classes(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text).

    component_id is the smallest doc_id reachable over links, the row's own
    included.  A text is lower-cased (A-Z) and cut into words; fewer words than
    the rule's are one n-gram; a null text or one without words has an empty set
    and links with nothing.  Repeated rows link like copies.  Rows with a null id
    take part, but no component is named after a null unless all its ids are.
    An empty table gives no row; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    described = written(spark, _described(docs, rule), "jaccard-rows")
    texts = described.filter("text IS NOT NULL")
    sets = texts.groupBy("sig").agg(F.first("n").alias("n"), F.first("bins").alias("bins"))
    total = texts.agg(F.sum("n")).collect()[0][0] or 0

    # n-grams that two classes have in their prefixes; a class that several runs hold counts once
    prefixes = written(spark, _prefixes(texts, rule, total), "jaccard-prefixes")
    shared = prefixes.groupBy("gram").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).filter("lo <> hi").select("gram")
    posts = written(spark, prefixes.join(shared, "gram", "left_semi").groupBy("gram", "sig").agg(*(F.first(c).alias(c) for c in ("n", "pos", "common"))), "jaccard-posts")
    dropped(spark, prefixes)

    links, roots = [], None
    for k in range(LEADER_ROUNDS + 1):
        rooted = _rooted(posts, roots)
        found = _leader_pairs(rooted, rule) if k < LEADER_ROUNDS else _all_pairs(rooted, rule)
        pairs = written(spark, _alike(found, sets, rule), "jaccard-pairs")
        if not pairs.isEmpty():
            links.append(_verified(texts, pairs, rule))
            if roots is not None:
                dropped(spark, roots)
            roots = written(spark, components(reduce(DataFrame.union, links)), "jaccard-roots")
        dropped(spark, pairs)

    rows = described.select("doc_id", "n", "sig")
    names = _names(rows.filter("n > 0"), roots)
    worded = looked_up(rows.filter("n > 0"), names, "sig").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
    none = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = written(spark, worded.unionByName(none), "jaccard-classes")
    for used in (described, posts, names, *links, *([] if roots is None else [roots])):
        dropped(spark, used)
    return out


def _names(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """sig and the least doc_id of its component, for every class that isn't a row of its own."""
    spark = rows.sparkSession
    each = rows.groupBy("sig").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    if roots is None:
        return written(spark, each.filter("rows > 1").select("sig", "least"), "jaccard-names")
    linked = written(spark, roots.select(F.col("node").alias("sig"), "root").join(each.select("sig", "least"), "sig"), "jaccard-linked")
    of_root = looked_up(linked.select("sig", "root"), linked.groupBy("root").agg(F.min("least").alias("least")), "root").select("sig", "least")
    alone = each.filter("rows > 1").join(linked.select("sig"), "sig", "left_anti").select("sig", "least")
    out = written(spark, of_root.unionByName(alone), "jaccard-names")
    dropped(spark, linked)
    return out


def representatives(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One document of each component, that with the smallest id, with all its columns.

    Of several rows with that id one stays, the least by text and then by the
    other columns.  Rows without words are nobody's duplicates and stay, and so
    do rows without an id, which can't be named.
    """
    keep = classes(docs, rule).filter((F.col("doc_id") == F.col("component_id")) & (F.col("n_shingles") > 0)).select("doc_id").distinct()
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rest = ["text", *(c for c in docs.columns if c not in ("doc_id", "text"))]
    first = docs.filter(worded).join(keep, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("_row"))
    one = first.select(*(F.col("doc_id") if c == "doc_id" else F.col(f"_row.{c}").alias(c) for c in docs.columns))
    return one.unionByName(docs.filter(~worded | F.col("doc_id").isNull()))
