"""Transducers, token counts, packing, fertility: against the libraries and brute force."""

import base64
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidepool.llm.packing import balance, pack
from tidepool.llm.quality_rules import STATS, base_counts, keep_good, quality
from tidepool.llm.textbatch import Texts
from tidepool.llm.token_counts import token_counts
from tidepool.llm.transducer import compiled, encode_all

from .cases import documents, empty, odd, odd_rows

BYTE, MULTI = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_any_text_is_tokenized_as_by_the_library(texts):
    lib = Tokenizer.from_file(BYTE)
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert encode_all(compiled(BYTE), texts) == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_hard_texts(library):
    parts = ["'s", "'re", "'", "''", " ", "  ", "\n", " \n", "\t", "a", "The", "ing", "1", "123", "é", "中", "😀", "\xa0", "...", "###", "'lll", "<|endoftext|>", "²", "x'd y", "\x85"]
    rng = random.Random(2)
    texts = ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(2000)]
    texts += ["", "a" * 5000, " " * 3000, "\n" * 700 + "x", "x" * 256, "é" * 600, "ab " * 2000]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    machine = compiled(BYTE)
    assert encode_all(machine, texts) == want
    assert machine.counts(Texts.of(texts)).tolist() == [len(w) for w in want]


def test_rank_file():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [r[1] or "" for r in odd_rows()]
    assert encode_all(compiled(MULTI, BYTE), texts) == [lib.encode_ordinary(t) for t in texts]


def test_flushing_the_table_changes_nothing(library):
    from tidepool.llm.transducer import Transducer, _classifier, load_json

    small = Transducer(load_json(BYTE), _classifier(library), max_states=50)
    texts = [r[1] or "" for r in odd_rows()]
    for t in texts:
        assert encode_all(small, [t]) == [library.encode(t, add_special_tokens=False).ids]


def test_counts(spark, library):
    for docs in (odd(spark), documents(spark)):
        want = sorted(repr((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids))) for r in docs.collect())
        got = token_counts(docs, BYTE, 1024).collect()
        assert sorted(repr((r.doc_id, r.n_bytes, r.n_tokens)) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts(empty(spark), BYTE, 1024).count() == 0


def test_packing_is_a_round_trip(spark, library):
    docs = documents(spark)
    want = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    rows = pack(docs, BYTE).collect()
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, ids in want.items():
        at = 0
        for r in sorted(parts[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert 1024 * len(sequences) < 1.01 * sum(map(len, want.values())) + 1024


def test_packing_odd_rows(spark):
    rows = pack(odd(spark), BYTE, group_rows=8).collect()
    assert sum(r.length for r in rows) == sum(r.n_tokens + 1 for r in token_counts(odd(spark), BYTE, 1).collect())
    assert pack(empty(spark), BYTE).count() == 0


def test_balance_fills_and_levels():
    rng = random.Random(3)
    lengths = [rng.randrange(1, 1024) for _ in range(500)]
    out = balance(lengths, 1024, 1.0, 1 / 4096)
    used = Counter()
    for _, _, n, at, _ in out:
        used[at] += n
    assert sum(used.values()) == sum(lengths) and len(used) == -(-sum(lengths) // 1024) and max(used.values()) <= 1024
    assert balance([], 1024, 1, 1) == [] and balance([5], 1024, 1, 1) == [(0, 0, 5, 0, 0)]


def brute(t: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    count = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if count[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_base_counts():
    texts = [r[1] for r in odd_rows()] + ["a\na\n\n \na\n a\n", "\n", "x y z x y z", "a b c a b c d a b", "é ü ß #*$", "\r\na\r\na"]
    got = base_counts(Texts.of(texts))
    names = list(STATS)[:5]
    assert [tuple(int(got[c][i]) for c in names) for i in range(len(texts))] == [brute(t or "") for t in texts]


def test_quality_of_the_labelled_half_that_set_no_band(spark):
    """The bands were set on documents with an even checksum; these have an odd one."""
    odd_half = lambda i: zlib.crc32(str(i).encode()) % 2 == 1
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect() if odd_half(r.doc_id)}
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1)
    rows = [r for r in quality(docs, MULTI, BYTE).collect() if r.doc_id in labels and not r.base_failed]
    good, bad = ([r for r in rows if labels[r.doc_id] == q] for q in (1, 0))
    assert len(good) > 1500 and sum(not r.kept for r in good) <= 0.002 * len(good)
    assert len(bad) > 150 and sum(r.kept for r in bad) < 0.15 * len(bad)


def test_quality(spark):
    docs = documents(spark)
    rows = quality(docs, MULTI, BYTE).collect()
    assert all(not r.kept for r in rows if r.base_failed)
    assert keep_good(docs, MULTI, BYTE).count() == sum(r.kept for r in rows)
    assert quality(odd(spark), MULTI, BYTE).count() == len(odd_rows())
    assert keep_good(odd(spark), MULTI, BYTE).columns == odd(spark).columns
    assert quality(empty(spark), MULTI, BYTE).count() == 0


def test_verdicts_equal_brute_force(spark):
    """Measures and verdict of each document from the libraries' own tokens."""
    from tidepool.llm import quality_rules as q

    docs = documents(spark).collect()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    multi = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lib = Tokenizer.from_file(BYTE)
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}, special_tokens={})

    def whole(b):
        try:
            b.decode()
        except UnicodeDecodeError:
            return False
        return True

    def measures(text, ids, bytes_of):
        n = max(1, len(ids))
        return len(text) / n, sum(not whole(bytes_of(i)) for i in ids) / n, -sum(c / n * np.log2(c / n) for c in Counter(ids).values())

    def inside(m, band, n, share):
        floor = min(band.entropy + band.rise * min(max(np.log2(max(n, 1)) - 8, -2), 2.5), share * np.log2(max(n, 1)))
        return band.chars_per_token[0] <= m[0] <= band.chars_per_token[1] and m[1] <= band.fallback_share and m[2] >= floor

    got = {r.doc_id: r for r in quality(documents(spark), MULTI, BYTE).collect()}
    for d in docs:
        r, text = got[d.doc_id], d.text or ""
        a, b = multi.encode_ordinary(text), lib.encode(text, add_special_tokens=False).ids
        own, broad = measures(text, a, multi.decode_single_token_bytes), measures(text, b, plain.decode_single_token_bytes)
        assert np.allclose(own, (r.chars_per_token, r.fallback_share, r.token_entropy)) and np.allclose(broad, (r.broad_chars_per_token, r.broad_fallback_share, r.broad_token_entropy))
        words = text.encode().split()
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        bands = [t.get(d.lang) or u[r.band] for t, u in ((q.LANGUAGE_BANDS, q.SCRIPT_BANDS), (q.BROAD_LANGUAGE_BANDS, q.BROAD_SCRIPT_BANDS))]
        want = not failed and inside(own, bands[0], len(a), q.ENTROPY_SHARE) and inside(broad, bands[1], len(b), q.BROAD_ENTROPY_SHARE)
        assert (r.base_failed, r.kept) == (failed, want), d.doc_id


def test_entropy_and_share():
    from tidepool.llm.quality_rules import fertility

    machine, t = compiled(BYTE), "naïve 日本 the the the"
    ids = encode_all(machine, [t])[0]
    p = np.array(list(Counter(ids).values())) / len(ids)
    cpt, share, entropy = fertility(Texts.of([t, ""]), BYTE, BYTE)
    assert np.isclose(cpt[0], len(t) / len(ids)) and np.isclose(entropy[0], -(p * np.log2(p)).sum())
    whole = 0
    for i in ids:
        try:
            machine.vocab.tokens[i].decode()
            whole += 1
        except UnicodeDecodeError:
            pass
    assert np.isclose(share[0], 1 - whole / len(ids)) and cpt[1] == share[1] == entropy[1] == 0


def test_short_clean_texts_are_not_held_to_the_entropy_of_long_ones(spark):
    from tidepool.llm.quality_rules import LANGUAGE_BANDS, judge

    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang").filter("lang in ('en', 'de', 'es', 'fr')").collect()
    good = [(r.lang, " ".join(r.text.split()[:50])) for r in rows if labels.get(r.doc_id) == 1]
    out = judge(Texts.of([t for _, t in good]), [g for g, _ in good], MULTI, BYTE)
    low = [i for i, (g, _) in enumerate(good) if not out["base_failed"][i] and out["token_entropy"][i] < LANGUAGE_BANDS[g].entropy and out["chars_per_token"][i] >= LANGUAGE_BANDS[g].chars_per_token[0]]
    assert low and all(out["kept"][i] for i in low)


def test_what_only_the_second_vocabulary_finds_abnormal_goes(spark):
    from tidepool.llm.quality_rules import LANGUAGE_BANDS, fertility, judge

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 1500").sort("doc_id")
    english, spanish = (" ".join([w for r in docs.filter(f"lang = '{g}'").limit(8).collect() for w in r.text.split()][:600]) for g in ("en", "es"))
    out, broad = judge(Texts.of([english, spanish]), ["en", "en"], MULTI, BYTE), fertility(Texts.of([english, spanish]), BYTE, BYTE)
    for name, values in zip(("broad_chars_per_token", "broad_fallback_share", "broad_token_entropy"), broad, strict=True):
        assert name in STATS and np.allclose(out[name], values)
    b = LANGUAGE_BANDS["en"]  # the first vocabulary has nothing against Spanish that is said to be English
    assert not out["base_failed"].any() and out["fallback_share"][1] <= b.fallback_share and out["chars_per_token"][1] >= b.chars_per_token[0] and out["token_entropy"][1] >= b.entropy
    assert out["kept"].tolist() == [True, False]


def test_a_long_text_without_a_boundary_is_quick(spark):
    """State maps of chunks are composed: letters of one kind, in a period, and at random."""
    import time

    machine, library = compiled(BYTE), Tokenizer.from_file(BYTE)
    rnd = random.Random(3)
    for unit in ("a" * 1000, "abc", "thequickbrownfox", "".join(rnd.choice("etaoinshrdlucmfwyp") for _ in range(1 << 19))):
        text = (unit * (1 + (1 << 19) // len(unit)))[: 1 << 19]
        machine.counts(Texts.of([text]))  # compiles the transitions that it takes
        began = time.perf_counter()
        got = int(machine.counts(Texts.of([text]))[0])
        took = time.perf_counter() - began
        part = text[:40_000]  # the library takes long for more
        assert machine.ids(Texts.of([part]))[0].tolist() == library.encode(part, add_special_tokens=False).ids
        assert got > 0 and took < 2, (unit[:20], took)


def test_packing_deals_one_id_over_groups(spark):
    same = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same words again").alias("text"))
    rows = pack(same, BYTE, group_rows=1000).groupBy(F.shiftright("sequence_id", 32).alias("g")).agg(F.countDistinct("sequence_id").alias("n"), F.sum("length").alias("t")).collect()
    assert len(rows) == 30 and all(r.n == -(-r.t // 1024) for r in rows)
