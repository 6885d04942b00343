"""What the operators share: the shared folder, cutting lineage, folds, vectorised byte n-grams, ranks without hot tasks."""

from __future__ import annotations

import sys
import types

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.sources.scratch import Scratch, discard, release, shared_dir, written

__all__ = ["Scratch", "discard", "release", "shared_dir", "written"]

M64 = (1 << 64) - 1


def state() -> dict:
    """A dictionary that lives as long as this Python process, also when functions arrive pickled by value."""
    module = sys.modules.setdefault("_quern_process_state", types.ModuleType("_quern_process_state"))
    return module.__dict__.setdefault("values", {})


def if_small(df: DataFrame, rows: int) -> DataFrame | None:
    """`df` hinted for broadcast if it has at most `rows` rows, else None: take another way."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else None


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Whole texts go to Python in batches of at most `rows` rows and about `size` bytes (one row at least), which bounds a
    worker's memory; smaller settings stay.

    It sets spark.sql.execution.arrow.maxRecordsPerBatch and maxBytesPerBatch of the session and leaves them so: DataFrames made
    here run later.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(name).rstrip("bB"))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Recent(dict):
    """What `make` gave for the keys asked for lately: two generations of at most `size` keys each, so memory is bounded and
    what is asked for often is never made twice in a row."""

    def __init__(self, make, size: int) -> None:
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        self[key] = got
        return got


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def ranked(df: DataFrame, keys: list[str], order: list[str], n: str, rank: str, per: int = 512) -> DataFrame:
    """Adds `rank`: 0, 1, ... within the rows of equal `keys`, of which column `n` says how many there are.

    A group of more than `per` rows is dealt over several salts by the hash of `order`; the ranks of a salt
    start where those of the salt before end. No task holds a whole hot group. Ranks follow salt and `order`.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.greatest(F.lit(1), F.ceil(F.col(n) / per)).cast("long")))
    by = [*keys, "_salt"]
    counts = salted.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy(*keys).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    own = salted.withColumn("_own", F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)
    return own.join(starts, by).withColumn(rank, F.col("_start") + F.col("_own")).drop("_salt", "_start", "_own")


def spread_join(rows: DataFrame, table: DataFrame, key: str, n: str, per: int = 2000) -> DataFrame:
    """`rows` joined with `table`, which has one row a key and in column `n` how many of `rows` have that key.

    Keys of more than `per` rows are dealt over salts, so that no task gets all of one. There are fewer of those keys than
    rows / per; they are broadcast up to 100,000.
    """
    salts = F.ceil(F.col(n) / per).cast("int")
    hot = table.where(F.col(n) > per).select(key, salts.alias("_salts"))
    small = if_small(hot, 100_000)
    dealt = rows.join(hot.hint("merge") if small is None else small, key, "left")
    dealt = dealt.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_salts", F.lit(1)).cast("long")).cast("int")).drop("_salts")
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return dealt.join(spread.hint("merge"), [key, "_salt"]).drop("_salt")


def gram_counts(texts: list[bytes], size: int, orders: tuple[int, ...] = (1, 2, 3), seed: int = 1, block: int = 1 << 20) -> np.ndarray:
    """Counts of byte n-grams of each text, hashed to `size` columns (a power of two). Runs of blanks count nothing."""
    out = np.zeros((len(texts), size), np.float32)
    shift = np.uint64(64 - size.bit_length() + 1)
    for row, text in enumerate(texts):
        for start in range(0, len(text), block):  # very long texts in blocks that overlap by what an n-gram needs
            b = np.frombuffer(text[start : start + block + max(orders) - 1], np.uint8).astype(np.uint64)
            for order in orders:
                n = min(len(b) - order + 1, block)
                if n <= 0:
                    continue
                code = b[:n] + np.uint64(1)
                for k in range(1, order):
                    code = code * np.uint64(257) + b[k : n + k] + np.uint64(1)
                if order > 1:
                    code = code[~((b[:n] == 32) & (b[1 : n + 1] == 32))]
                h = (code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(order * seed)) * np.uint64(0xD6E8FEB86659FD93) >> shift
                out[row] += np.bincount(h.astype(np.int64), minlength=size)
    return out
