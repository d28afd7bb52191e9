"""I-Match fingerprints: hashes of the mid-frequency terms under several random lexicons.

Terms whose document frequency lies in a band (a band of inverse document
frequency) form the lexicon.  It is split at random into GROUPS sub-lexicons; a
document's distinct terms in one of them, sorted, hash to one part of its
fingerprint.  A long document would have so many terms in each that any edit
changed every part, so terms are first thinned by a hash to a level at which a
few are left for each part.  Two neighbouring levels are kept, since an edit can
move a document by one.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import written

GROUPS = 16
#: Terms for each group at a document's level, before the lexicon is looked at: so many to twice as many.
TERMS_PER_GROUP = 2
#: The band of document frequencies, as shares of all documents, and its least number of documents.
MIN_SHARE, MAX_SHARE, MIN_DOCS = 1e-4, 0.2, 2
#: Documents to a range of ids, in which the next document is looked for, and the most ranges:
#: beyond 100 million documents ranges grow, and their sorts spill.
RANGE_ROWS, MOST_RANGES = 1536, 1 << 16
#: A lexicon of at most so many terms (8 bytes each) is broadcast; a larger one is joined by shuffling.
BROADCAST_TERMS = 2_000_000
#: What separates words.
BLANKS = r"[\x20\x09-\x0D]+"


def terms(text: Column) -> Column:
    """Distinct 64-bit hashes of a text's lower-cased words."""
    words = F.filter(F.split(F.lower(text), BLANKS), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS) -> DataFrame:
    """The terms in the band, counted over all documents.

    At most (mean distinct terms of a document) / min_share terms can be in it,
    however many documents there are.
    """
    n = docs.count()
    df = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.filter((F.col("df") >= max(min_docs, n * min_share)) & (F.col("df") <= max(min_docs, n * max_share))).select("term")


def _level(n: Column) -> Column:
    """How often a document's terms are halved."""
    return F.greatest(F.lit(0), F.floor(F.log2(F.greatest(n, F.lit(1)) / F.lit(GROUPS * TERMS_PER_GROUP)))).cast("int")


def _thinned(own: Column, level: Column) -> Column:
    """The terms left at a level: those in whose hash that many bits are 0."""
    mask = F.pow(F.lit(2.0), level).cast("long") - 1
    return F.filter(own, lambda t: F.shiftright(t, 24).bitwiseAND(mask) == 0)


def _parts(tagged: Column) -> Column:
    """One hash for each group's terms, '-' for none; tagged: sorted terms with their groups."""
    by_group = F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda g: F.transform(F.filter(tagged, lambda x: x["g"] == g), lambda x: x["t"]))
    return F.concat_ws(":", F.transform(by_group, lambda own: F.when(F.size(own) > 0, F.lower(F.hex(F.xxhash64(own)))).otherwise("-")))


def _tagged(own: Column) -> Column:
    return F.transform(F.array_sort(own), lambda t: F.struct(F.shiftrightunsigned(t, 60).cast("int").alias("g"), t.alias("t")))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts at the level where two fingerprints agree most; 1 for equal fingerprints.

    Parts that are empty on both sides don't count; levels that only one of the
    two has don't either, and without a common level the likeness is 0.
    """
    fa, fb = F.split(a, r"\|"), F.split(b, r"\|")

    def share(x: Column, y: Column) -> Column:
        pairs = F.zip_with(F.split(x, ":"), F.split(y, ":"), lambda p, q: F.when((p == "-") & (q == "-"), None).otherwise((p == q).cast("double")))
        used = F.filter(pairs, lambda z: z.isNotNull())
        return F.coalesce(F.try_divide(F.aggregate(used, F.lit(0.0), lambda s, z: s + z), F.size(used)), F.lit(0.0))

    la, lb = F.get(fa, F.lit(0)).try_cast("int"), F.get(fb, F.lit(0)).try_cast("int")
    a1, a2, b1, b2 = (F.get(f, F.lit(i)) for f in (fa, fb) for i in (1, 2))
    met = F.when(la == lb, F.greatest(share(a1, b1), share(a2, b2))).when(la == lb + 1, share(a1, b2)).when(lb == la + 1, share(a2, b1))
    return F.when(a == b, 1.0).otherwise(F.coalesce(met, F.lit(0.0)))


def _bounds(docs: DataFrame, ranges: int) -> list:
    """The least id of each range but the first; ids of any type that can be ordered."""
    if isinstance(docs.schema["doc_id"].dataType, T.NumericType):
        return sorted(set(docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 100_000)).collect()[0][0] or []))
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL").repartitionByRange(ranges, "doc_id")
    return sorted(r.least for r in ids.groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("least")).collect())[1:]  # an id per range


def _in_ranges(docs: DataFrame) -> DataFrame:
    """Rows with a range of ids each, and in every range, marked as ghost, the first row of the next.

    So each row's successor in order of id is in its own range.  The last range
    gets the first row of all.  The bounds are one literal of the plan.
    """
    ranges = min(MOST_RANGES, max(2, -(-docs.count() // RANGE_ROWS)))
    bounds, kind = _bounds(docs, ranges), docs.schema["doc_id"].dataType
    text = json.dumps(bounds, default=str)
    cut = F.from_json(F.lit(text), T.ArrayType(kind))
    # how many bounds are not above the id, by halving steps; a null id has none
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length())))) if bounds else F.array().cast("array<int>")
    place = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(cut, at + step - 1) <= F.col("doc_id"), step).otherwise(0))
    ranged = docs.select("doc_id", "text", place.alias("range"))
    heads = ranged.groupBy("range").agg(F.min(F.struct("doc_id", "text")).alias("head"))  # a row per range
    every = Window.orderBy("range")
    whole = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # only numbers of ranges meet in one task
    goes_to = ranged.select("range").distinct().select(F.col("range").alias("own"), F.coalesce(F.lag("range").over(every), F.max("range").over(whole)).alias("to"))
    ghosts = heads.join(F.broadcast(goes_to), F.col("range") == F.col("own")).select("head.doc_id", "head.text", F.col("to").alias("range"), F.lit(True).alias("ghost"))  # MOST_RANGES rows at most
    return ranged.withColumn("ghost", F.lit(False)).unionByName(ghosts)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text, and its edited form: the last quarter replaced by the next text's beginning.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, one row per input row.  A null text is empty.  Rows
    follow each other by id, of equal ids by text, null ids first; the last is
    followed by the first, a lone row by itself.  A text with no term in the
    lexicon has a fingerprint of its own hash, like nothing but equal texts.  An
    empty table gives no row; other columns are ignored.  Whole texts are
    shuffled once, by range of ids; ranges hold about equally many rows.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = written(spark, lexicon(src), "imatch-lexicon")
    if known.count() <= BROADCAST_TERMS:
        known = F.broadcast(known)

    order = Window.partitionBy("range").orderBy("ghost", "doc_id", "text")
    rows = _in_ranges(src).select("range", "ghost", "doc_id", "text", F.row_number().over(order).alias("rn"), F.coalesce(F.lead("text").over(order), F.lit("")).alias("next"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("quarter", F.floor(F.col("n_chars") / 4).cast("int"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("quarter")).cast("int")), F.substring(F.col("next"), F.lit(1), F.col("quarter")))
    rows = rows.withColumn("edited", edited)
    rows = rows.select(
        "range", "rn", "ghost", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array(*(F.struct(F.lit(side).alias("side"), F.xxhash64(c).alias("h"), terms(F.col(c)).alias("own")) for side, c in enumerate(("text", "edited")))).alias("sides"),
    )
    rows = rows.withColumn("sides", F.transform("sides", lambda s: F.struct(s["side"].alias("side"), s["h"].alias("h"), _level(F.size(s["own"])).alias("level"), s["own"].alias("own"))))
    rows = rows.withColumn("sides", F.transform("sides", lambda s: F.struct(s["side"].alias("side"), s["h"].alias("h"), s["level"].alias("level"), _thinned(s["own"], s["level"]).alias("own"))))

    # look the thinned terms up and bring each row's together again; the range already holds all of them
    keep = ["ghost", "doc_id", "n_chars", "edited_sha256"]
    each = rows.select("range", "rn", *keep, F.inline("sides")).select("range", "rn", *keep, "side", "h", "level", F.explode_outer("own").alias("term"))
    found = each.join(known.withColumn("listed", F.lit(True)), "term", "left")
    of = lambda side, c: F.first(F.when(F.col("side") == side, F.col(c)), ignorenulls=True)
    got = found.groupBy("range", "rn").agg(
        *(F.first(c).alias(c) for c in keep),
        *(of(s, c).alias(f"{c}{s}") for s in (0, 1) for c in ("h", "level")),
        *(F.collect_list(F.when(F.col("listed") & (F.col("side") == s), F.col("term"))).alias(f"own{s}") for s in (0, 1)),
    )
    for s in (0, 1):
        got = got.withColumn(f"at{s}", _tagged(F.col(f"own{s}"))).withColumn(f"up{s}", _tagged(_thinned(F.col(f"own{s}"), F.col(f"level{s}") + 1)))
        whole = F.concat_ws("|", F.col(f"level{s}").cast("string"), _parts(F.col(f"at{s}")), _parts(F.col(f"up{s}")))
        got = got.withColumn(f"f{s}", F.when(F.size(f"own{s}") > 0, whole).otherwise(F.concat(F.lit("="), F.lower(F.hex(f"h{s}")))))
    got = got.withColumn("next_f", F.lead("f0").over(Window.partitionBy("range").orderBy("rn")))
    return got.filter(~F.col("ghost")).select("doc_id", "n_chars", "edited_sha256", F.col("f0").alias("fingerprint"), F.col("f1").alias("edited_fingerprint"), likeness(F.col("f0"), F.col("f1")).alias("near_edited"), likeness(F.col("f0"), F.col("next_f")).alias("near_next"))
