"""A table in hash buckets with versions: an upsert rewrites the buckets that its keys fall into and refers to all others.

Under the table's folder, `data` holds a folder for each write with one for each bucket in it; `versions` holds a small JSON file for
each version that names the folder of every bucket. A version exists once its file does; the file is made without
overwriting, so of two writers of the same version one fails and nothing is half done. Readers of an older version
keep it until vacuum(). What a version costs is the buckets that changed, never the table.

Defined results: a null in a key is a value like others; rows that repeat a key in the changes are an error; changes without a row
make a version that refers to all that was; columns that the changes lack are null in their rows (upsert) or stay (patch).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


@dataclass(frozen=True)
class Version:
    number: int
    keys: list[str]
    buckets: int
    schema: str
    folders: dict[str, str]  # bucket -> folder below the table's; a bucket without rows has none
    batch: int | None  # the last stream batch that is in it


def _fs(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(conf), where, jvm.org.apache.hadoop.fs.Path


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The versions that there are, oldest first."""
    fs, where, _ = _fs(spark, f"{path}/versions")
    if not fs.exists(where):
        return []
    return sorted(int(f.getPath().getName().removesuffix(".json")) for f in fs.listStatus(where) if f.getPath().getName().endswith(".json"))


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    number = number if number is not None else numbers(spark, path)[-1]
    return Version(**json.loads(spark.read.text(f"{path}/versions/{number}.json", wholetext=True).first()[0]))


def _commit(spark: SparkSession, path: str, made: Version) -> Version:
    fs, where, _ = _fs(spark, f"{path}/versions/{made.number}.json")
    out = fs.create(where, False)  # fails if the version is there
    out.write(json.dumps(vars(made)).encode())
    out.close()
    return made


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _written(df: DataFrame, path: str, keys: list[str], buckets: int) -> dict[str, str]:
    """The folders of the buckets that `df` has rows in, written anew."""
    spark, folder = df.sparkSession, f"data/{uuid.uuid4().hex}"
    placed = df.withColumn("_bucket", bucket_of(keys, buckets))
    # the salt lets a large bucket be written by several tasks
    placed.repartition("_bucket", F.pmod(F.xxhash64(*df.columns), F.lit(2))).sortWithinPartitions("_bucket", *keys).write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    fs, where, _ = _fs(spark, f"{path}/{folder}")
    names = [f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory()]
    return {n.removeprefix("_bucket="): f"{folder}/{n}" for n in names}


def create(df: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> Version:
    """Version 0 of a table at `path`."""
    return _commit(df.sparkSession, path, Version(0, keys, buckets, df.schema.simpleString(), _written(df, path, keys, buckets), None))


def _schema(of: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(of)


def read(spark: SparkSession, path: str, number: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The rows of a version, the last if none is named; of some buckets only, if asked."""
    v = version(spark, path, number)
    folders = [f"{path}/{f}" for k, f in sorted(v.folders.items()) if only is None or int(k) in only]
    return spark.read.schema(_schema(v.schema)).parquet(*folders) if folders else spark.createDataFrame([], _schema(v.schema))


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys])


def _changed(changes: DataFrame, path: str, merge, batch: int | None) -> Version:
    spark = changes.sparkSession
    v = version(spark, path)
    if batch is not None and v.batch is not None and batch <= v.batch:
        return v  # this batch is in it already
    keyed = changes.groupBy(*v.keys).agg(F.count(F.lit(1)).alias("_n"), bucket_of(v.keys, v.buckets).alias("_bucket"))
    touched = keyed.groupBy("_bucket").agg(F.max("_n").alias("n")).collect()  # `buckets` rows at most
    if any(r["n"] > 1 for r in touched):
        raise ValueError(f"the changes repeat a key of {v.keys}")
    only = [r["_bucket"] for r in touched]
    rows = merge(read(spark, path, v.number, only), changes, v.keys)
    folders = {k: f for k, f in v.folders.items() if int(k) not in only}
    if only:
        folders |= _written(rows, path, v.keys, v.buckets)
    return _commit(spark, path, Version(v.number + 1, v.keys, v.buckets, v.schema, folders, v.batch if batch is None else batch))


def upsert(changes: DataFrame, path: str, batch: int | None = None) -> Version:
    """The next version: `changes` in place of the rows of their keys, and in addition. A stream's `batch` is taken once."""

    def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
        kept = old.alias("old").join(new.select(*keys).alias("new"), _same(keys), "left_anti")
        return kept.unionByName(new, allowMissingColumns=True).select(*old.columns)

    return _changed(changes, path, merge, batch)


def patch(changes: DataFrame, path: str) -> Version:
    """The next version: the columns of `changes` set in the rows of their keys; keys that aren't there are left out."""

    def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
        own = [c for c in new.columns if c not in keys]
        both = old.alias("old").join(new.withColumn("_hit", F.lit(True)).alias("new"), _same(keys), "left")
        return both.select(*[F.when(F.col("_hit"), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) if c in own else F.col(f"old.{c}").alias(c) for c in old.columns])

    return _changed(changes, path, merge, None)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes all but the last `keep` versions and the buckets that none of those names; says how many folders went."""
    every = numbers(spark, path)
    named = {f for n in every[-keep:] for f in version(spark, path, n).folders.values()}
    fs, _, where = _fs(spark, path)
    for n in every[:-keep]:
        fs.delete(where(f"{path}/versions/{n}.json"), False)
    gone = 0
    for write in fs.listStatus(where(f"{path}/data")):
        held = [f.getPath() for f in fs.listStatus(write.getPath()) if f.isDirectory()]
        old = [b for b in held if f"data/{write.getPath().getName()}/{b.getName()}" not in named]
        for b in held if len(old) < len(held) else [write.getPath()]:
            if b in old or b == write.getPath():
                fs.delete(b, True)
        gone += len(old)
    return gone
