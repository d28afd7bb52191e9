"""The stages on a small table, each against what its decisions must be."""

from collections import Counter, defaultdict
from itertools import combinations

import corpus_pipeline
import pytest
from tidepool.llm.quality_rules import quality
from tidepool.llm.queries import tokenizer_path

from .cases import SF, empty, odd, odd_rows


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "quality_rules":
            verdict = quality(before, tokenizer_path("byte_bpe_multi_50k.tiktoken"), tokenizer_path("byte_bpe_50k.json")).filter("kept")
            assert {r.doc_id for r in kept[name]} == {r.doc_id for r in verdict.collect()}
    ids = lambda name: {r.doc_id for r in kept[name]}
    assert ids("language_id") <= ids("quality_rules") and len(ids("language_id")) > 0.95 * len(ids("quality_rules"))
    texts = [r.text for r in kept["jaccard_join"]]
    assert len(set(texts)) == len(texts) and ids("temperature_mixing") == ids("jaccard_join")
    assert ids("packing") == ids("temperature_mixing")
    assert corpus_pipeline.ORACLE_SQL is None and "packing" == corpus_pipeline.STAGES[-1][0]


def least_of_groups(rows, words, percent):
    """The smallest id of each group of rows (id, text) linked by brute force."""
    sets, holders = {}, defaultdict(list)
    for doc, t in rows:
        w = (t or "").encode().lower().split()
        sets[doc] = set(zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else ({tuple(w)} if w else set())
        for g in sets[doc]:
            holders[g].append(doc)
    root = {doc: doc for doc in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in Counter(pair for own in holders.values() for pair in combinations(own, 2)).items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {find(i) for i in sets}


def test_near_duplicates_go_by_five_words_and_four_fifths(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = least_of_groups(rows, 5, 80)
    assert want < least_of_groups(rows, 4, 85)  # the table tells the two rules apart
    assert {r.doc_id for r in corpus_pipeline.jaccard_join(spark, docs, "").select("doc_id").collect()} == want


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows_and_empty_tables(spark, name, stage):
    """Each stage by itself, so that odd rows get to the later ones too."""
    docs = odd(spark)
    rows = Counter(map(tuple, docs.collect()))
    out = stage(spark, docs, SF)
    got = out.collect()
    assert stage(spark, empty(spark), SF).count() == 0
    if name == "packing":
        ends = Counter(repr(r.doc_id) for r in got if r.start + r.length == r.doc_tokens)
        assert ends == Counter(repr(r[0]) for r in odd_rows())
        return
    assert out.columns == docs.columns and set(map(tuple, got)) <= set(rows)
    kept = Counter(map(tuple, got))
    if name == "quality_rules":
        assert kept <= rows and not any((r.text or "").strip() == "" for r in got)
    elif name == "language_id":
        assert kept <= rows and not any(r.text is None for r in got)
    elif name == "jaccard_join":
        ids = [r.doc_id for r in got if r.doc_id is not None]
        assert kept <= rows and len(ids) == len(set(ids)) and 24 not in ids and 23 not in ids
        assert sum(r.doc_id is None for r in got) == sum(r[0] is None for r in odd_rows())
        assert {20, 21, 22, 29} <= set(ids)  # without words: linked with nothing
    else:
        assert set(kept) == set(rows) and all(rows[r] <= n <= 2 * rows[r] for r, n in kept.items())
