"""Mixing, sharding, fingerprints, languages, joins, models: against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm.components import components
from tidepool.llm.hash_ring import assign, ring, segments
from tidepool.llm.imatch import fingerprints
from tidepool.llm.jaccard_join import Rule, classes, representatives
from tidepool.llm.language_id import identify, keep_identified
from tidepool.llm.language_model import discounts, perplexity
from tidepool.llm.mixing import mixed_documents, solve, temperature_mix

from .cases import DOCS, SF, documents, empty, odd, odd_rows, text


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, *("x",) * 5) for i, t in enumerate(texts)], DOCS)


# -- mixing ------------------------------------------------------------------


def test_exponent_meets_its_target(spark):
    shares = [("a", 1000), ("b", 100), ("c", 10)]
    df = spark.createDataFrame(shares, "source string, n_tokens long")
    rows = {r.source: r for r in solve(df, max_repetition=3.0).collect()}
    alpha = 1 - math.log(3) / math.log(100)
    z = sum(n**alpha for _, n in shares)
    assert all(math.isclose(rows[s].weight, n**alpha / z, rel_tol=1e-6) for s, n in shares)
    got = solve(df, target_entropy=1.2).collect()
    assert math.isclose(-sum(r.weight * math.log2(r.weight) for r in got), 1.2, abs_tol=1e-6)
    assert {round(r.exponent, 9) for r in solve(df, target_entropy=0.1).collect()} == {1.0}
    assert {round(r.exponent, 9) for r in solve(df, max_repetition=1000.0).collect()} == {0.0}
    with pytest.raises(ValueError):
        solve(df)


def test_mixture_spends_its_budget(spark):
    docs = documents(spark)
    rows = temperature_mix(docs, max_repetition=1.5, block_tokens=500).collect()
    times = Counter(r.doc_id for r in rows)
    assert set(times) == {r.doc_id for r in docs.collect()} and set(times.values()) <= {1, 2}
    for s in {r.source for r in rows}:
        own = sorted((r for r in rows if r.source == s), key=lambda r: r.position)
        assert all(a.position + a.n_tokens == b.position for a, b in zip(own, own[1:], strict=False))
        assert own[-1].position < max(1, own[0].target_tokens) <= own[-1].position + own[-1].n_tokens
    cut = temperature_mix(docs, target_entropy=2.0, budget=5000, block_tokens=500).collect()
    assert 5000 <= sum(r.n_tokens for r in cut) < 5000 + sum(max([r.n_tokens for r in cut if r.source == s]) for s in {r.source for r in cut})


def test_mixing_odd_rows(spark):
    rows = temperature_mix(odd(spark), max_repetition=1.0).collect()
    assert Counter(repr(r.doc_id) for r in rows) == Counter(repr(r[0]) for r in odd_rows())
    out = mixed_documents(odd(spark), max_repetition=1.0)
    assert out.columns == odd(spark).columns and out.count() == len(odd_rows())
    assert temperature_mix(empty(spark), max_repetition=2.0).count() == 0


def test_exponent_of_many_sources(spark):
    """Sources of equal size are one entry of what is bisected over."""
    many = spark.range(3000).select(F.concat(F.lit("s"), "id").alias("source"), F.when(F.col("id") < 2999, 10).otherwise(1000).cast("long").alias("n_tokens"))
    got = solve(many, max_repetition=5.0).collect()
    alpha = 1 - math.log(5) / math.log(100)
    q = [10 / 30_990] * 2999 + [1000 / 30_990]
    z = sum(x**alpha for x in q)
    assert len(got) == 3000 and math.isclose(max(r.weight for r in got), q[-1] ** alpha / z, rel_tol=1e-6) and math.isclose(sum(r.weight for r in got), 1, rel_tol=1e-9)


def test_sums_by_groups_of_blocks_follow_the_permutation(spark):
    """Many blocks: each pass is the source's blocks one after another, none cut but the last."""
    rows = temperature_mix(documents(spark), max_repetition=1.5, block_tokens=50).collect()
    for s in {r.source for r in rows}:
        for p in {r["pass"] for r in rows if r.source == s}:
            own = sorted((r for r in rows if r.source == s and r["pass"] == p), key=lambda r: (r.position, r.n_tokens))
            assert all(a.position + a.n_tokens == b.position for a, b in zip(own, own[1:], strict=False))
            turns = [r.block for r in own if r.n_tokens]
            assert sum(a != b for a, b in zip(turns, turns[1:], strict=False)) == len(set(turns)) - 1


@pytest.mark.parametrize("name", ["op2_temperature_mixing", "op3_bounded_load_ring"])
def test_native_queries_equal_their_sql(spark, name):
    import duckdb

    from tidepool.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())


# -- sharding ------------------------------------------------------------------


def test_ring_moves_cells_to_the_new_shard_only():
    a, b = ring(16, 32), ring(17, 32)
    assert all(x == y or y == 16 for x, y in zip(a, b, strict=True)) and set(b) == set(range(17))


@pytest.mark.parametrize("shards", [65, 300])
def test_many_shards_all_own_cells(spark, shards):
    assert set(ring(shards, 32)) == set(range(shards))
    rows = assign(docs_of(spark, [f"t{i}" for i in range(2 * shards + 5)]), shards).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == 2 * shards + 5 and set(sizes) == set(range(shards)) and set(sizes.values()) == {2, 3}


def test_overflow_goes_on_clockwise():
    assert segments({0: 5, 1: 1}, [0, 1, 2, 0], 3) == [(0, 0, 2, 0, 0), (1, 0, 1, 1, 0), (0, 2, 3, 1, 1), (0, 3, 5, 2, 0)]


@pytest.mark.parametrize("which", [documents, odd])
def test_shards_are_even(spark, which):
    docs = which(spark)
    rows = assign(docs, 16).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    n = docs.count()
    sizes = [len(slots[s]) for s in range(16)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    texts = Counter((repr(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((repr(r.doc_id), r.size, r.text_crc32) for r in rows) == texts


def test_one_hot_text(spark):
    rows = assign(docs_of(spark, ["same"] * 300 + [f"t{i}" for i in range(20)]), 16).collect()
    assert {c for c in Counter(r.shard for r in rows).values()} == {20}
    assert assign(empty(spark), 16).count() == 0


def test_a_full_shard_cuts_one_group_of_equal_texts(spark):
    texts = [f"t{i // 3}" for i in range(6000)]
    shards, groups = {}, defaultdict(set)
    for n in (16, 17):
        shards[n] = {r.doc_id: r.shard for r in assign(docs_of(spark, texts), n).collect()}
    for i, t in enumerate(texts):
        groups[t].add(shards[16][i])
    moved = [(shards[16][i], shards[17][i]) for i in range(len(texts)) if shards[16][i] != shards[17][i]]
    to_new, between = sum(b == 16 for _, b in moved), sum(b != 16 for _, b in moved)
    assert sum(len(v) > 1 for v in groups.values()) < 0.05 * len(groups)
    assert to_new == 6000 // 17 and between < 0.05 * len(texts)  # a seventeenth must move; about 2 % more do


def test_slack_leaves_more_rows_where_they_were(spark):
    docs = docs_of(spark, [f"t{i}" for i in range(6000)])
    a, b = ({r.doc_id: r.shard for r in assign(docs, n, slack=0.25).collect()} for n in (16, 17))
    assert max(Counter(a.values()).values()) <= math.ceil(375 * 1.25) and {r.law for r in assign(docs, 16, slack=0.25).collect()} == {"bounded"}
    assert sum(a[i] != b[i] != 16 for i in a) <= 0.005 * len(a)


def test_a_hot_text_is_numbered_in_parts(spark):
    docs = docs_of(spark, ["hot"] * 9000 + [f"t{i}" for i in range(3000)])
    rows = assign(docs, 16).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == 12_000 and all(sorted(v) == list(range(750)) for v in slots.values())


# -- fingerprints ------------------------------------------------------------------


@pytest.mark.parametrize("which", [documents, odd])
def test_fingerprints(spark, which):
    docs = which(spark)
    rows = fingerprints(docs).collect()
    order = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter()
    for i, (doc, t) in enumerate(order):
        nxt, k = order[(i + 1) % len(order)][1], len(t) // 4
        want[repr(doc), len(t), hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()] += 1
    assert Counter((repr(r.doc_id), r.n_chars, r.edited_sha256) for r in rows) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def test_fingerprints_tell_edits_from_others(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows, texts = fingerprints(docs).collect(), {r.doc_id: r.text for r in docs.collect()}
    same = defaultdict(set)
    for r in rows:
        same[texts[r.doc_id]].add(r.fingerprint)
    assert all(len(v) == 1 for v in same.values())
    assert sum(r.near_edited for r in rows) / len(rows) > 0.3 > 20 * sum(r.near_next for r in rows) / len(rows)
    assert fingerprints(empty(spark)).count() == 0 and fingerprints(docs_of(spark, ["a b c d"])).count() == 1


def brute_prints(texts):
    """Fingerprints by the method's own steps, in Python."""
    import re
    import struct

    import xxhash

    from tidepool.llm import imatch

    signed = lambda v: v - (1 << 64) if v >> 63 else v
    terms = [list(dict.fromkeys(signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w)) for t in texts]

    def parts(own):
        out = []
        for g in range(imatch.GROUPS):
            h = 42
            for x in (mine := [x for x in sorted(own) if (x % (1 << 64)) >> 60 == g]):
                h = xxhash.xxh64(struct.pack("<q", x), seed=h).intdigest()
            out.append(f"{h:x}" if mine else "-")
        return ":".join(out)

    def fingerprint(text, own, known):
        level = max(0, math.floor(math.log2(max(len(own), 1) / (imatch.GROUPS * imatch.TERMS_PER_GROUP))))
        thin = lambda lst, k: [x for x in lst if (x >> 24) & ((1 << k) - 1) == 0]
        own = [x for x in thin(own, level) if x in known]
        whole = xxhash.xxh64(text.encode(), seed=42).intdigest()
        return f"{level}|{parts(own)}|{parts(thin(own, level + 1))}" if own else f"={whole:x}"

    return terms, fingerprint


def test_fingerprints_equal_brute_force(spark):
    from tidepool.llm import imatch

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    terms, fingerprint = brute_prints(list(texts.values()))
    df, n = Counter(x for own in terms for x in own), len(texts)
    known = {x for x, c in df.items() if max(imatch.MIN_DOCS, n * imatch.MIN_SHARE) <= c <= max(imatch.MIN_DOCS, n * imatch.MAX_SHARE)}
    want = {i: fingerprint(t, own, known) for (i, t), own in zip(texts.items(), terms, strict=True)}
    rows = fingerprints(docs).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == want
    order = sorted(texts)
    edited = {}
    for i, k in enumerate(order):
        t, nxt = texts[k], texts[order[(i + 1) % len(order)]]
        edited[k] = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
    terms, fingerprint = brute_prints(list(edited.values()))
    assert {r.doc_id: r.edited_fingerprint for r in rows} == {k: fingerprint(t, own, known) for (k, t), own in zip(edited.items(), terms, strict=True)}


def test_fingerprints_by_ids_of_text_and_one_id_for_all(spark):
    docs = documents(spark).select(F.format_string("k%06d", "doc_id").alias("doc_id"), "text")
    plain = {r.doc_id: tuple(r)[1:] for r in fingerprints(documents(spark)).collect()}
    assert {int(r.doc_id[1:]): tuple(r)[1:] for r in fingerprints(docs).collect()} == plain
    one = spark.range(20_000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("a b c "), F.col("id") % 9).alias("text"))
    assert fingerprints(one).count() == 20_000


# -- languages ------------------------------------------------------------------


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = identify(docs).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark):
    rows = identify(odd(spark)).collect()
    assert len(rows) == len(odd_rows())
    by = {r.doc_id: r.lang_pred for r in rows if r.doc_id is not None}
    assert by[20] == by[21] == by[22] == by[29] == "und" and by[1] == "en"
    assert identify(empty(spark)).count() == 0
    unlabelled = odd(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in identify(unlabelled).collect()} == {"und"}
    assert keep_identified(odd(spark)).columns == odd(spark).columns


def test_without_a_model_lettered_documents_stay(spark):
    rows = odd(spark).withColumn("lang", F.lit(None).cast("string"))
    assert Counter(repr(r.doc_id) for r in keep_identified(rows).collect()) == Counter(repr(r[0]) for r in odd_rows() if any(c.isalpha() for c in r[1] or ""))
    blind = spark.createDataFrame([(i, text(i, 9), "en") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0], "doc_id long, text string, lang string")
    assert keep_identified(blind).count() == blind.count() > 0
    assert keep_identified(empty(spark)).count() == 0 and keep_identified(blind.withColumn("text", F.lit(""))).count() == 0


# -- n-gram Jaccard join -----------------------------------------------------------


def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(set(zip(*(w[i:] for i in range(4)), strict=False)) if len(w) >= 4 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((repr(doc), len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows))


def test_classes_equal_brute_force(spark):
    base = [f"w{i}" for i in range(120)]
    chain = [" ".join(base[: 40 + k] + [f"v{k}_{j}" for j in range(3)]) for k in range(0, 24, 3)]
    near = [" ".join(base[:i] + [f"e{i}"] + base[i + 1 :]) for i in range(2, 110, 6)]  # each near the base, few near each other
    common = [" ".join([f"own{i}_{j}" for j in range(9)] + base[:20]) for i in range(12)]  # a shared passage
    texts = [*chain, " ".join(base), *near, *common, "a b c", "A B C", "a b", "", None, "a b c d", " a  b\nc\td "]
    docs = docs_of(spark, texts)
    got = Counter((repr(r.doc_id), r.n_shingles, r.component_id) for r in classes(docs, Rule(4, 85)).collect())
    assert got == brute_classes(list(enumerate(texts)))


@pytest.mark.parametrize("which", [documents, odd])
def test_classes_of_tables(spark, which):
    rows = [(r.doc_id, r.text) for r in which(spark).collect()]
    assert Counter((repr(r.doc_id), r.n_shingles, r.component_id) for r in classes(which(spark), Rule(4, 85)).collect()) == brute_classes(rows)


def test_one_of_each_class_stays(spark):
    assert classes(empty(spark)).count() == 0
    out = representatives(odd(spark))
    assert out.columns == odd(spark).columns
    ids = Counter(r.doc_id for r in out.collect())
    assert ids[3] == 1 and 23 not in ids and 24 not in ids and ids[20] == 1 and ids[None] == 2


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(-5, -9)]
    for size in (1 << 20, 20):
        got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), size).collect()}
        assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, -5: -9, -9: -9}


# -- language model ---------------------------------------------------------------


def brute_scores(rows):
    toks = [[*(t or "").encode().lower().split(), 1] for _, t in rows]
    learn = [t for (doc, _), t in zip(rows, toks, strict=True) if doc is None or zlib.crc32(str(doc).encode()) % 7 != 2]
    c, b = Counter(), Counter()
    for t in learn:
        c.update(t)
        b.update(zip([0, *t[:-1]], t, strict=True))
    after, total, kinds = Counter(w for _, w in b), Counter(), defaultdict(lambda: [0, 0, 0])
    for (v, _), n in b.items():
        total[v] += n
        kinds[v][min(n, 3) - 1] += 1
    high = discounts([sum(n == k for n in b.values()) for k in (1, 2, 3, 4)])
    low_n = [sum(n == k for n in after.values()) for k in (1, 2, 3, 4)]
    low = discounts(low_n)
    rest = (low[0] * low_n[0] + low[1] * low_n[1] + low[2] * sum(n >= 3 for n in after.values())) / len(b)
    n_all, size = sum(c.values()), len(c)

    def cut(n, d):
        return max(n - d[min(n, 3) - 1], 0) if n else 0

    def p(v, w):
        one = cut(after[w], low) / len(b) + rest / (size + 1)
        if not total[v]:
            return one
        return cut(b[v, w], high) / total[v] + sum(map(lambda x, y: x * y, high, kinds[v])) / total[v] * one

    return [(len(t), sum(c[w] > 0 for w in t), n_all, sum(math.log10((c[w] + 1) / (n_all + size + 1)) for w in t), sum(math.log10(p(v, w)) for v, w in zip([0, *t[:-1]], t, strict=True))) for t in toks], p, c


@pytest.mark.parametrize("which", [documents, odd])
def test_scores_equal_brute_force(spark, which):
    rows = [(r.doc_id, r.text) for r in which(spark).collect()]
    want, p, c = brute_scores(rows)
    key = lambda x: tuple(round(v, 5) for v in x)
    got = perplexity(which(spark)).collect()
    assert Counter(key((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)) for r in got) == Counter(map(key, want))
    for v in (b"the", 0):
        assert math.isclose(sum(p(v, w) for w in c) + p(v, None), 1, rel_tol=1e-9)


def brute_trigrams(rows):
    """Score of each row by order 3: own counts for trigrams, different words before for bigrams."""
    toks = [[*(t or "").encode().lower().split(), 1] for _, t in rows]
    learn = [t for (doc, _), t in zip(rows, toks, strict=True) if doc is None or zlib.crc32(str(doc).encode()) % 7 != 2]
    words, pairs, top = set(), Counter(), Counter()
    for t in learn:
        words.update(t)
        pairs.update(zip([0, *t[:-1]], t, strict=True))
        top.update(zip([0, *t[:-2]], t[:-1], t[1:], strict=False))
    near = Counter((v, w) for _, v, w in top) + Counter({k: n for k, n in pairs.items() if k[0] == 0})
    assert near.keys() == pairs.keys()

    def level(counts):
        d, total, kinds = discounts([sum(n == k for n in counts.values()) for k in (1, 2, 3, 4)]), Counter(), defaultdict(lambda: [0, 0, 0])
        for gram, n in counts.items():
            total[gram[:-1]] += n
            kinds[gram[:-1]][min(n, 3) - 1] += 1

        def p(gram, low):
            if not total[gram[:-1]]:
                return low
            n = counts.get(gram, 0)
            own = n - d[min(n, 3) - 1] if n else 0
            return (max(own, 0) + low * sum(map(lambda x, y: x * y, d, kinds[gram[:-1]]))) / total[gram[:-1]]

        return p

    one, two, three = level({(w,): n for w, n in Counter(w for _, w in pairs).items()}), level(near), level(top)

    def p(u, v, w):
        low = two((v, w), one((w,), 1 / (len(words) + 1)))
        return low if u is None else three((u, v, w), low)

    score = [sum(math.log10(p(*g)) for g in zip([None, 0, *t[:-2]][: len(t)], [0, *t[:-1]], t, strict=True)) for t in toks]
    return score, p, words, near, top


@pytest.mark.parametrize("which", [documents, odd])
def test_trigram_scores_equal_brute_force(spark, which):
    rows = [(r.doc_id, r.text) for r in which(spark).collect()]
    want, p, words, near, top = brute_trigrams(rows)
    got = [r.score for r in perplexity(which(spark), order=3).collect()]
    assert len(got) == len(want) and all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(sorted(got), sorted(want), strict=True))
    for u, v, _ in list(top)[:2]:
        assert math.isclose(sum(p(u, v, w) for w in words) + p(u, v, None), 1, rel_tol=1e-9)
    with pytest.raises(ValueError):
        perplexity(which(spark), order=4)


def test_ranges_follow_the_tokens_and_few_files_stay_open(spark, tmp_path):
    from tidepool.llm import language_model as lm

    rows = [(r.doc_id, r.text) for r in odd(spark).collect()]
    want = sorted(round(x, 8) for x in brute_trigrams(rows)[0])
    assert sorted(round(r.score, 8) for r in perplexity(odd(spark), order=3, range_tokens=300).collect()) == want
    model = lm.train(odd(spark), range_tokens=300)
    assert model.ranges > 20 and list(model.bounds) == sorted(set(model.bounds))
    assert lm._cuts(np.array([5, 1, 900, 1, 2, 300, 4]), 300) == [2, 3, 5, 6]
    for i in range(2 * lm.MOST_MAPS):
        (tmp_path / f"f{i}").write_bytes(bytes(8))
    maps = lm.Maps(str(tmp_path))
    for i in range(2 * lm.MOST_MAPS):
        assert maps.get(f"f{i}", "<u8").tolist() == [0]
    mapped = open("/proc/self/maps").read().count(str(tmp_path))
    assert len(maps.open) == lm.MOST_MAPS >= mapped


def test_query_scores_by_trigrams(spark):
    from tidepool.llm.queries import op9_kneser_ney

    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    want = brute_trigrams(rows)[0]
    got = [r.score for r in op9_kneser_ney(spark, SF).collect()]
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(sorted(got), sorted(want), strict=True))


def test_no_rows_no_model(spark):
    assert perplexity(empty(spark)).count() == 0
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    only = spark.createDataFrame([(i, text(i, 9)) for i in held], "doc_id long, text string")
    assert {(r.held_out, r.n_known, r.train_tokens, r.score) for r in perplexity(only).collect()} == {(True, 0, 0, 0.0)}
