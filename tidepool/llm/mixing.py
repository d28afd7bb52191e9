"""Mixing sources to target weights by temperature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import written

#: Bisection steps; each halves the interval of the exponent.
STEPS = 48
#: Tokens of a block, on average.
BLOCK_TOKENS = 1 << 18
#: Blocks of a pass are summed in so many groups (a power of two) first.
GROUP_BITS = 12
#: So many sources are broadcast, more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: What a word is made of.
WORD = r"[^\x20\x09-\x0D]+"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _raised(e: Column, exponent: Column) -> Column:
    """Sum of all shares raised to a power; e: distinct shares q that m sources have each."""
    return F.aggregate(e, F.lit(0.0), lambda a, x: a + x["m"] * F.pow(x["q"], exponent))


def _entropy(e: Column, exponent: Column) -> Column:
    whole = _raised(e, exponent)
    w = lambda x: F.pow(x["q"], exponent) / whole
    return F.aggregate(e, F.lit(0.0), lambda a, x: a - x["m"] * w(x) * F.log2(w(x)))


def _repetition(e: Column, exponent: Column) -> Column:
    """Passes over the most repeated source when the least repeated has one."""
    passes = F.transform(e, lambda x: F.pow(x["q"], exponent) / x["q"])
    return F.coalesce(F.array_max(passes) / F.array_min(passes), F.lit(1.0))


def exponent_of(sources: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None) -> DataFrame:
    """One row: exponent, whole (the sum of the raised shares), total (all tokens).

    sources: source, tokens.  The exponent lies in [0, 1]: 1 keeps the shares, 0
    levels them.  With target_entropy the largest exponent that reaches it is
    sought, with max_repetition the smallest that keeps within it; a target out
    of reach ends at the bound.  Sources of equal size are one entry of the array
    that is bisected over: n tokens make at most sqrt(2 n) entries, however many
    the sources.
    """
    if (target_entropy is None) == (max_repetition is None):
        raise ValueError("give either target_entropy or max_repetition")
    some = sources.filter("tokens > 0")
    each = some.groupBy("tokens").agg(F.count(F.lit(1)).alias("m"))
    one = each.agg(F.array_sort(F.collect_list(F.struct("tokens", "m"))).alias("each")).withColumn("total", F.aggregate("each", F.lit(0).cast("long"), lambda a, x: a + x["tokens"] * x["m"]))
    one = one.withColumn("e", F.transform("each", lambda x: F.struct((x["tokens"] / F.col("total")).alias("q"), x["m"].alias("m"))))
    e = F.col("e")

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["low"] + acc["high"]) / 2
        # low always has enough of what is asked for (entropy), high does (repetition)
        flat = _entropy(e, mid) >= target_entropy if target_entropy is not None else _repetition(e, mid) > max_repetition
        return F.struct(F.when(flat, mid).otherwise(acc["low"]).alias("low"), F.when(flat, acc["high"]).otherwise(mid).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high")), halve)
    if max_repetition is not None:
        exponent = F.when(_repetition(e, F.lit(0.0)) <= max_repetition, 0.0).otherwise(found["high"])
    else:
        exponent = F.when(_entropy(e, F.lit(1.0)) >= target_entropy, 1.0).otherwise(found["low"])
    return one.withColumn("exponent", exponent).select("exponent", _raised(e, F.col("exponent")).alias("whole"), "total")


def solve(docs: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None) -> DataFrame:
    """source, tokens, total, share, exponent, weight for each source of docs (source, n_tokens); see exponent_of."""
    per = written(docs.sparkSession, docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "mixing-sources")
    rows = per.join(F.broadcast(exponent_of(per, target_entropy, max_repetition)))  # one row
    share = F.when(F.col("tokens") > 0, F.col("tokens") / F.col("total")).otherwise(0.0)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("total"), F.col("exponent")) / F.col("whole")).otherwise(0.0)
    return rows.select("source", "tokens", "total", share.alias("share"), "exponent", weight.alias("weight"))


def _order(seed: int, *cols: Column) -> Column:
    """A number of 60 bits for the values: a digest, so that any engine gives the same."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 17) -> DataFrame:
    """Realise the weights: one row for each time that a document is to be used.

    docs: row_key, source, n_tokens (one row per key).  ``budget`` is the tokens
    of the mixture; by default it is the least with which every source is used
    up once, so no document is left out.  A source's budget is spent in passes;
    each pass takes the source's blocks in an order of its own, and in a block
    the documents in an order of its own, until the budget is spent: whole
    passes come first, the last block taken is cut at the document that reaches
    the budget.  Documents without tokens are used in every whole pass.
    Blocks are dealt by a hash of the key: no window holds more than a block.

    Returns row_key, source, pass, block, position (tokens of the source's
    stream before the document), n_tokens, exponent, weight, target_tokens.
    """
    weights = solve(docs, target_entropy, max_repetition)
    # one whole pass of the source with the least weight for its tokens
    least = weights.agg(F.min(F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))).alias("least"))
    size = F.lit(float(budget)) if budget is not None else 1.0 / F.col("least")
    target = F.when(F.col("tokens") > 0, F.round(F.col("weight") * size)).otherwise(0).cast("long")
    plan = weights.join(F.broadcast(least)).withColumn("target_tokens", target if budget is not None else F.greatest(target, F.col("tokens")))  # one row
    plan = plan.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)))
    plan = plan.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("target_tokens") / F.col("tokens"))).otherwise(1).cast("int"))
    plan = plan.withColumn("rest", F.when(F.col("tokens") > 0, F.col("target_tokens") - F.col("whole") * F.col("tokens")).otherwise(0))
    per_source = written(docs.sparkSession, plan.select(F.col("source").alias("_s"), "tokens", "exponent", "weight", "target_tokens", "blocks", "whole", "rest"), "mixing-plan")
    if per_source.count() <= BROADCAST_SOURCES:
        per_source = F.broadcast(per_source)

    key = [F.col(f"row_key.{c}") for c in docs.schema["row_key"].dataType.names] if docs.schema["row_key"].dataType.typeName() == "struct" else [F.col("row_key")]
    rows = docs.join(per_source, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("block", F.pmod(_order(seed, *key), F.col("blocks")))
    passes = F.sequence(F.lit(0), F.col("whole") - F.when(F.col("rest") > 0, 0).otherwise(1))
    rows = rows.filter((F.col("whole") > 0) | (F.col("rest") > 0)).withColumn("pass", F.explode(passes))

    # where each block begins in its pass: sums within groups of blocks, and over the groups
    sums = rows.groupBy("source", "pass", "block").agg(F.sum("n_tokens").alias("block_sum")).withColumn("turn", _order(seed + 1, F.col("pass"), F.col("block"))).withColumn("grp", F.shiftright("turn", 60 - GROUP_BITS))
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inner = F.sum("block_sum").over(until(Window.partitionBy("source", "pass", "grp").orderBy("turn", "block")))
    outer = F.sum("group_sum").over(until(Window.partitionBy("source", "pass").orderBy("grp")))
    groups = sums.groupBy("source", "pass", "grp").agg(F.sum("block_sum").alias("group_sum")).select(F.col("source").alias("_gs"), F.col("pass").alias("_gp"), F.col("grp").alias("_g"), F.coalesce(outer, F.lit(0)).alias("group_start"))
    starts = sums.withColumn("before", F.coalesce(inner, F.lit(0))).join(groups, F.col("source").eqNullSafe(F.col("_gs")) & (F.col("pass") == F.col("_gp")) & (F.col("grp") == F.col("_g")))
    starts = starts.select(F.col("source").alias("_s"), F.col("pass").alias("_p"), F.col("block").alias("_b"), (F.col("before") + F.col("group_start")).alias("block_start"))

    inside = until(Window.partitionBy("source", "pass", "block").orderBy(_order(seed + 2, F.col("pass"), *key), "row_key"))
    rows = rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("pass") == F.col("_p")) & (F.col("block") == F.col("_b")))
    at = F.col("block_start") + F.col("before")
    rows = rows.filter((F.col("pass") < F.col("whole")) | (at < F.col("rest")))
    extra = [c for c in ("copies",) if c in docs.columns]
    return rows.select("row_key", "source", *extra, "pass", "block", (F.col("pass") * F.col("tokens") + at).alias("position"), "n_tokens", "exponent", "weight", "target_tokens")


def _keyed(docs: DataFrame) -> DataFrame:
    """A key for each distinct row, its id and 120 bits of a digest of its text: equal rows are used together."""
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")))
    half = lambda k: F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("long")
    return docs.withColumn("row_key", F.struct(F.col("doc_id").alias("id"), half(0).alias("a"), half(1).alias("b")))


def _units(docs: DataFrame) -> DataFrame:
    """row_key, source, n_tokens, copies: what is mixed.  The texts are read once for it."""
    keyed = _keyed(docs.select("doc_id", F.col("text").cast("string").alias("text"), "source")).select("row_key", "source", n_tokens(F.col("text")).alias("n"))
    return written(docs.sparkSession, keyed.groupBy("row_key", "source").agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("copies")), "mixing-units")


def temperature_mix(docs: DataFrame, **how) -> DataFrame:
    """``mix`` for documents (doc_id, text, source): doc_id, source, pass, block, position, n_tokens and the weights.

    A null source is a source of its own, a null text has no tokens.  Equal rows
    are one unit of the permutation and come out as often as they came in.  An
    empty table gives no row; other columns are ignored.
    """
    used = mix(_units(docs), **how).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return used.select(F.col("row_key.id").alias("doc_id"), "source", "pass", "block", "position", "n_tokens", F.round("exponent", 9).alias("exponent"), F.round("weight", 9).alias("weight"), "target_tokens")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents themselves, each as often as the mixture uses it."""
    times = mix(_units(docs), **how).groupBy("row_key", "source").agg(F.count(F.lit(1)).alias("_times")).select(F.col("row_key").alias("_key"), F.col("source").alias("_source"), "_times")
    keyed = _keyed(docs)
    on = (F.col("row_key.a") == F.col("_key.a")) & (F.col("row_key.b") == F.col("_key.b")) & F.col("row_key.id").eqNullSafe(F.col("_key.id")) & F.col("source").eqNullSafe(F.col("_source"))
    out = keyed.join(times, on).withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return out.select(*docs.columns)
