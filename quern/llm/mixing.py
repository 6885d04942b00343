"""Mixing sources to target token weights by entropy balancing.

Every document gets a rate; among all rates that bring each source to its token target, those nearest to 1 in
relative entropy are exponential tilts exp(lambda * size) of the document's size, held at the copy limit. The
convex dual has one multiplier per source. Newton iterations solve all of them together, each step being one Spark
aggregate over the (source, size, count) table, safeguarded by bisection. Rates are
then rounded into whole copies: size by size from the longest,
carrying the tokens not yet placed on to the next size, so that a source ends within about one short document of its
target; which documents of a size get the extra copy is decided by their hash, so reruns agree.

Targets: all sources stay in a Spark table. A source is held at the limit where limit * size / weight is below the level
that the others share; the level rises with each round of two sums until no other source is.

Defined results: a null or blank text has size 0 and is taken 0 times; a null source is a source, the last; rows that
repeat count each; an empty table gives an empty result. Other columns are ignored.
No source is ever held by the driver, however many there are. Rounding holds the distinct sizes of one source in a task, as counts: a few
100,000 numbers, however many documents there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import discard, if_small, partitions, ranked, written

WEIGHTS, LIMIT = (5, 2, 1), 3
BROADCAST_SIZES = 300_000  # (source, size) counts that are broadcast; more are joined by shuffle


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """key, source_size, target of sources (key, tokens; keys as from source_key()): shares of all tokens by weight, weights
    repeating in the order of the sources; none above `limit` times its source, the excess shared again by weight."""
    last = F.col("key") == "n"
    dealt = sources.repartitionByRange(partitions(sources.sparkSession), last, "key").withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "sources")
    rows = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    starts = rows.select("part", before.alias("start"))
    nth = F.col("start") + F.row_number().over(W.partitionBy("part").orderBy(last, "key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(nth, F.lit(len(weights))) + 1).cast("int"))
    held = written(dealt.join(F.broadcast(starts), "part").select("key", "tokens", weight.alias("weight")), "weights")
    level, was = 0.0, None
    while level != was:
        capped = F.col("tokens") * limit < F.col("weight") * level
        whole, taken, free = held.agg(F.sum("tokens"), F.sum(F.when(capped, F.col("tokens") * limit).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        was, level = level, max(level, (whole - taken) / free) if free else level
    target = F.least(F.col("tokens") * float(limit), F.col("weight") * level)
    return held.select("key", F.col("tokens").alias("source_size"), target.alias("target"))


def tilts(hist: DataFrame, facts: DataFrame, limit: float = LIMIT, tolerance: float = 1e-9, rounds: int = 100) -> DataFrame:
    """key, multiplier: where the sum of n * size * min(limit, exp(multiplier * size)) over a source's sizes (hist: key, size, n) is
    its target (facts: key, source_size, target); infinite where only rates of `limit`, or of 0, reach it.

    Newton iterations on the dual, one Spark job a step for all sources: the step's gradient and slope are partial sums over
    the size counts. A step that leaves the interval known to hold the solution is replaced by its middle.
    """
    whole, goal = F.col("source_size").cast("double"), F.col("target")
    scale = F.greatest(F.lit(1.0), whole / F.greatest(F.lit(1.0), F.col("documents").cast("double")))
    even, over = (whole <= 0) | (F.abs(goal - whole) <= tolerance * whole), goal >= limit * whole * (1 - 1e-12)
    start = F.when(even, 0.0).when(over, float("inf")).when(goal <= 0, float("-inf")).otherwise(0.0)
    docs = hist.groupBy("key").agg(F.sum("n").alias("documents"))
    state = facts.join(docs.hint("merge"), "key").select("key", "target", scale.alias("scale"), start.alias("at"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), (even | over | (goal <= 0)).alias("done"))
    state = written(state, "tilts")
    x = F.col("size") / F.col("scale")
    rate = F.exp(F.least(F.col("at") * x, F.lit(50.0)))
    mass = F.col("n") * F.col("size")
    for _ in range(rounds):
        left = state.where("not done")
        if not left.limit(1).count():
            break
        sums = hist.join(if_small(left, BROADCAST_SIZES) or left.hint("merge"), "key").groupBy("key").agg(
            F.sum(mass * F.least(rate, F.lit(float(limit)))).alias("got"), F.sum(F.when(rate < limit, mass * x * rate).otherwise(0.0)).alias("slope")
        )
        miss = F.col("got") - F.col("target")
        low, high = F.when(miss < 0, F.col("at")).otherwise(F.col("low")), F.when(miss < 0, F.col("high")).otherwise(F.col("at"))
        known = left.join(sums.hint("merge"), "key").select("key", "target", "scale", "at", "slope", miss.alias("miss"), low.alias("low"), high.alias("high"))
        newton = F.col("at") - F.col("miss") / F.nullif(F.col("slope"), F.lit(0.0))
        bounded = (F.col("low") > float("-inf")) & (F.col("high") < float("inf"))
        middle = F.when(bounded, (F.col("low") + F.col("high")) / 2).otherwise(F.col("at") * 2 + F.when(F.col("miss") < 0, 1.0).otherwise(-1.0))
        step = F.when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(middle)
        near = F.abs("miss") <= tolerance * F.col("target")
        moved = known.select("key", "target", "scale", F.when(near, F.col("at")).otherwise(step).alias("at"), "low", "high", (near | (step == F.col("at"))).alias("done"))
        new = written(state.where("done").unionByName(moved), "tilts")
        discard(state)
        state = new
    return state.select("key", (F.col("at") / F.col("scale")).alias("multiplier"))


def rates(size: np.ndarray, multiplier: float, limit: float) -> np.ndarray:
    """Copies a document of each size would get, before rounding."""
    with np.errstate(invalid="ignore", over="ignore"):
        return np.where(size > 0, np.minimum(limit, np.exp(np.minimum(multiplier * size, 50.0))), 0.0)


def source_key() -> Column:
    """The source as a text that is never null: s and its name, or n."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """For every row of `docs` (doc_id, text, source): doc_id, text_hash, key of the source, size, source_size, target, times (copies)."""
    size = F.coalesce(F.expr(r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')"), F.lit(0)).cast("long")
    slim = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key().alias("key"), size.alias("size"), F.xxhash64("text").alias("text_hash")), "sizes")
    hist = written(slim.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "size-counts")
    facts = targets(hist.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("tokens")), weights, limit)

    def rounded(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False)
        goal = float(pdf["target"].iloc[0])
        x, n = pdf["size"].to_numpy(np.float64), pdf["n"].to_numpy(np.int64)
        rate = rates(x, float(pdf["multiplier"].iloc[0]), float(limit))
        copies, miss = np.zeros(len(x), np.int64), goal - float((n * x * rate).sum())
        for k in range(len(x)):  # each size between its rate rounded down and up, so as to keep the miss small
            if x[k] > 0:
                wish = n[k] * x[k] * rate[k] + miss
                copies[k] = min(max(n[k] * int(rate[k]), int(np.floor(wish / x[k] + 0.5))), n[k] * min(limit, int(np.ceil(rate[k]))))
                miss = wish - copies[k] * x[k]
        for k in range(len(x)):  # what is still missing or too much goes to the longest documents that it can hold
            if 0 < x[k] <= abs(miss) + x[k] / 2:
                more = min(max(-copies[k], int(np.floor(miss / x[k] + 0.5))), limit * n[k] - copies[k])
                copies[k] += more
                miss -= more * x[k]
        return pdf[["key", "size", "n", "source_size", "target"]].assign(copies=copies)

    facts = written(facts, "targets")
    known = facts.join(tilts(hist, facts, float(limit)).hint("merge"), "key")
    joined = hist.join(if_small(known, BROADCAST_SIZES) or known.hint("merge"), "key")
    plan = written(joined.groupBy("key").applyInPandas(rounded, "key string, size long, n long, source_size long, target double, copies long"), "copies")
    dealt = slim.join(if_small(plan, BROADCAST_SIZES) or plan.hint("merge"), ["key", "size"])
    whole, extra = F.floor(F.col("copies") / F.col("n")), F.col("copies") % F.col("n")
    even = dealt.where(extra == 0).withColumn("times", whole)
    odd = ranked(dealt.where(extra != 0), ["key", "size"], ["doc_id", "text_hash"], "n", "rank").withColumn("times", whole + (F.col("rank") < extra).cast("long")).drop("rank")
    return even.unionByName(odd.select(*even.columns)).select("doc_id", "text_hash", "key", "size", "source_size", "target", "times")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of `docs`."""
    out = mixed(docs, weights, limit)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
