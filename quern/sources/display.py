"""A display store: wide rows in order of their key, in small row groups with bloom filters, for lookups of some of them.

A lookup of up to FEW keys is a filter on the key that reaches the files: of a file only the row groups are read whose
range of keys and bloom filter may hold one of them. More keys are joined, and the join's own runtime filter prunes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.sizes import if_small

FEW, GROUP_BYTES, PER_FILE = 1000, 1 << 20, 20_000


def store(rows: DataFrame, path: str, key: str, group_bytes: int = GROUP_BYTES, per_file: int = PER_FILE) -> None:
    """Writes `rows` in files by ranges of the key, about `per_file` rows each, with row groups of about `group_bytes`."""
    n = rows.count()
    dealt = rows.repartitionByRange(max(1, -(-n // per_file)), key).sortWithinPartitions(key)
    (
        dealt.write.option("parquet.block.size", group_bytes).option("parquet.block.size.row.check.min", 100).option("parquet.page.size.row.check.min", 100)
        .option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", max(1000, per_file)).parquet(path)
    )


def lookup(spark: SparkSession, path: str, wanted: DataFrame, key: str) -> DataFrame:
    """The stored rows of the keys in `wanted` (key, ...), with its columns; keys that aren't there have nulls."""
    stored = spark.read.parquet(path)
    keys = [r[0] for r in wanted.select(key).distinct().limit(FEW + 1).collect()]
    if len(keys) <= FEW:
        stored = stored.where(F.col(key).isin(keys))
        return wanted.join(F.broadcast(stored), key, "left") if keys else wanted.join(stored, key, "left")
    there = stored.join(if_small(wanted.select(key).distinct()), key, "left_semi")
    return wanted.join(there, key, "left")
