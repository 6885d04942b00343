"""Broadcast joins whose small side has a checked size; joins on keys of which some are hot on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` hinted for broadcast if it has at most `rows` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def grid_join(left: DataFrame, right: DataFrame, key: str, per: int = 20_000) -> DataFrame:
    """`left` joined with `right` on `key`. Rows of a key that has more than `per` on a side are dealt over a grid: as many stripes
    a side as it has lots of `per`, each of which meets all stripes of the other. So no task gets more than a lot of each side, however
    hot a key is; what the grid sends twice is what has to meet."""
    n = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > per)
    hot = n(left, "_l").join(n(right, "_r"), key, "full_outer")  # fewer keys than rows / per
    stripes = lambda name: F.coalesce(F.ceil(F.col(name) / per), F.lit(1)).cast("int")
    hot = if_small(hot.select(key, stripes("_l").alias("_nl"), stripes("_r").alias("_nr")))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        rows = df.join(hot, key, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_nl", "_nr")})
        mine = F.pmod(F.xxhash64(*df.columns), F.col(f"_n{own}").cast("long")).cast("int")
        return rows.withColumn(f"_{own}", mine).withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col(f"_n{other}") - 1))).drop("_nl", "_nr")

    return dealt(left, "l", "r").join(dealt(right, "r", "l"), [key, "_l", "_r"]).drop("_l", "_r")
