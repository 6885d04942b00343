"""Table operations: alignment checks, first-seen rows, overlays, map edits, discrete quantiles, shares, range lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def first_seen(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row of each key, the first by `order` (dropDuplicates would keep any)."""
    return df.withColumn("_nth", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_nth = 1").drop("_nth")


def misaligned(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, with the side; empty when both are aligned."""
    a, b = left.select(*keys).distinct().withColumn("_l", F.lit(1)), right.select(*keys).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, keys, "full_outer")
    return both.where("_l is null or _r is null").select(*keys, F.when(F.col("_l").isNull(), "right").otherwise("left").alias("only_in"))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """`changes` in place of the rows with their keys, and in addition."""
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def overlay(base: DataFrame, texts: DataFrame, key: str, maps: str, entry: str) -> DataFrame:
    """Map column `maps` with `entry` set to texts.value where there is one, else removed."""
    joined = base.join(texts.select(key, F.col("value").alias("_value")), key, "left")
    without = F.map_filter(F.col(maps), lambda k, _: k != entry)
    return joined.withColumn(maps, F.when(F.col("_value").isNull(), without).otherwise(F.map_concat(without, F.create_map(F.lit(entry), F.col("_value"))))).drop("_value")


def shares(df: DataFrame, key: str) -> DataFrame:
    """`key`, n, share (per cent of all rows)."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counted.crossJoin(F.broadcast(counted.agg(F.sum("n").alias("_all")))).select(key, "n", (100.0 * F.col("n") / F.col("_all")).alias("share"))


def discrete_quantiles(df: DataFrame, by: str, value: str, places: dict[str, Column]) -> DataFrame:
    """For each group the values at 0-based places of the sorted list; places are Columns of n.

    Equal values are counted first. The counts are dealt by ranges of group and value; the rows of a range start where
    those of the ranges before it end, so a group of any number of different values is never in one task.
    """
    from quern.sources.scratch import written

    counted = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_c"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(counted.repartitionByRange(parts, by, value).withColumn("_part", F.spark_partition_id()), "quantiles")
    sizes = dealt.groupBy(by, "_part").agg(F.sum("_c").alias("_size"))  # a row a group and range
    before = W.partitionBy(by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(F.col(by).alias("_by"), F.col("_part").alias("_of"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"), F.sum("_size").over(W.partitionBy(by)).alias("n"))
    own = dealt.join(F.broadcast(starts), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_of"))).drop("_by", "_of")
    run = own.withColumn("_to", F.col("_start") + F.sum("_c").over(W.partitionBy(by, "_part").orderBy(value)))
    at = lambda p: F.min(F.when((F.col("_to") > p) & (F.col("_to") - F.col("_c") <= p), F.col(value)))
    return run.groupBy(by, "n").agg(*[at(p).alias(name) for name, p in places.items()])


def range_lookup(asked: DataFrame, rows: DataFrame, key: str, most: int = 20) -> DataFrame:
    """ask_id with the rows of keys a..b, all or nothing: both ends must exist, and b - a < `most`.

    A range has few keys, so it is spelt out and joined by equality: no theta join.
    """
    good = asked.where((F.col("a") <= F.col("b")) & (F.col("b") - F.col("a") < most))
    spelt = good.select("ask_id", "a", "b", F.explode(F.sequence("a", "b")).alias(key))
    hits = spelt.join(rows, key)
    w = W.partitionBy("ask_id")
    ends = F.max((F.col(key) == F.col("a")).cast("int")).over(w) + F.max((F.col(key) == F.col("b")).cast("int")).over(w)
    return hits.withColumn("_ends", ends).where("_ends = 2").drop("_ends")


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds `name`: 0, 1, ... in this order over all rows, by ranges of it: no task holds all of them. Ties need a tie-break."""
    from quern.sources.scratch import written

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = {f"_o{k}": c for k, c in enumerate(order)}
    dealt = written(df.withColumns(keys).repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "ranges")
    rows = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    starts = rows.select("_part", before.alias("_start"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*keys)) - 1
    return dealt.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + own).drop("_part", "_start", *keys)


def seeded_sample(df: DataFrame, key: str, n: int, seed: str = "450") -> DataFrame:
    """n rows in the order of md5(seed and key): the same everywhere and always."""
    return df.withColumn("_h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))).orderBy("_h", key).limit(n).drop("_h")


def retrieval_metrics(ranks: DataFrame, at: tuple[int, ...] = (1, 3, 5, 10, 120)) -> DataFrame:
    """hits at k and the mean reciprocal rank of (query_id, rank); rank null: gold not found."""
    hits = [F.count_if(F.col("rank") <= k).alias(f"hit_{k}") for k in at]
    return ranks.agg(F.count(F.lit(1)).alias("n"), *hits, F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 9).alias("mrr"))


def dropped(df: DataFrame, keep: Column, by: str) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and `by`, kept, left_out: how many of each group stayed and how many did not."""
    good = F.coalesce(keep, F.lit(False))
    return df.where(good), df.groupBy(by).agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("left_out"))


def observed(df: DataFrame, keep: Column, reasons: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """The rows that stay, and an observation of how many stayed and how many had each reason to go. It counts in the pass that
    reads the rows: ask it (`.get`) after an action on all of them."""
    seen = Observation()
    good = F.coalesce(keep, F.lit(False))
    return df.observe(seen, F.count_if(good).alias("kept"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in reasons.items()]).where(good), seen


def match_totals(pairs: DataFrame, ours: str, theirs: str) -> DataFrame:
    """One row: agree, differ, unmatched (nothing found), silent (found, but without a ruling). `pairs`: found (boolean), both columns."""
    found, said = F.coalesce("found", F.lit(False)), F.col(theirs).isNotNull()
    return pairs.agg(
        F.count_if(found & said & F.col(ours).eqNullSafe(F.col(theirs))).alias("agree"), F.count_if(found & said & ~F.col(ours).eqNullSafe(F.col(theirs))).alias("differ"),
        F.count_if(~found).alias("unmatched"), F.count_if(found & ~said).alias("silent"),
    )


def differing(left: DataFrame, right: DataFrame, keys: list[str], form=lambda c: c) -> DataFrame:
    """`keys`, ours, theirs of texts (keys, text) that differ in this form or that only one side has, of which nothing may be left in it."""
    side = lambda df, text, name: df.select(*keys, F.col("text").alias(text), F.lit(True).alias(name))
    both = side(left, "ours", "_l").join(side(right, "theirs", "_r"), keys, "full_outer")
    alone = F.col("_l").isNull() | F.col("_r").isNull()
    return both.where(alone | ~form(F.col("ours")).eqNullSafe(form(F.col("theirs")))).drop("_l", "_r")


def described(df: DataFrame, facts: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """`df` with the first of the facts (name, ...) of its name; null where there are none. Facts are metadata of few rows."""
    from quern.operators.sizes import if_small

    return df.join(if_small(first_seen(facts, name, order)), name, "left")


def spread(scores: DataFrame, by: str, value: str) -> DataFrame:
    """`by`, n, least, median (lower middle) of a value."""
    n = F.col("n")
    return discrete_quantiles(scores, by, value, {"least": F.lit(0), "median": F.floor((n - 1) / 2)})


def ceil_div(a: Column, b: Column) -> Column:
    """Whole division of numbers above 0, rounded up; in whole numbers throughout."""
    return F.call_function("div", a + b - 1, b)


def fractional(number: Column) -> Column:
    """Whether an id has a fraction: a note attached to a record, not one of its own."""
    return F.coalesce(number.cast("string").contains("."), F.lit(False))
