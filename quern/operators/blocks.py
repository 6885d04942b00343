"""Vectors stored as blocks of half precision, scored block by block, with an exact second look at what may be among the best.

A block is a row: the ids of up to BLOCK vectors, their unit rows as packed float16, and the greatest distance of a row from what was
rounded to it. Blocks are built in chunks of the ids' hash; a chunk is written into a staging folder and renamed into place, so a
build that was stopped goes on with the chunks that are missing, and readers see whole chunks only.

With unit queries a score from half precision is off by at most that distance, e. So whatever is among the k best by exact
scores has at least the k-th rounded score less 2 e: those candidates are few, and are scored again by the vectors themselves.

Defined results: null vectors, and vectors with null or non-finite components, are left out; a vector of zeros scores 0; ids that
repeat are vectors of their own; an empty table gives no blocks and no hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.operators import dense
from quern.sources.files import exists
from quern.sources.scratch import written

BLOCK, CHUNKS, AT_ONCE = 2048, 16, 8
SCHEMA = "n int, width int, ids binary, rows binary, error double"
MOST_QUERIES = 4096


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _packed(ids: np.ndarray, v: np.ndarray) -> dict:
    unit = _unit(v)
    half = unit.astype("<f2")
    error = np.linalg.norm(unit - half.astype(np.float64), axis=1).max()
    return {"n": len(ids), "width": v.shape[1], "ids": ids.astype("<i8").tobytes(), "rows": half.tobytes(), "error": float(error)}


def missing(spark: SparkSession, path: str, chunks: int = CHUNKS) -> list[int]:
    """The chunks that a build at `path` still has to make."""
    return [k for k in range(chunks) if not exists(spark, f"{path}/chunk={k}")]


def build(vectors: DataFrame, path: str, chunks: int = CHUNKS, block: int = BLOCK, at_once: int = AT_ONCE) -> None:
    """The blocks of `vectors` (doc_id, v) at `path`, or those of the chunks that are missing there; `at_once` of them a job."""
    spark = vectors.sparkSession
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("v").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & finite)
    good = good.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def out(chunk: int, rows: list) -> pd.DataFrame:
            return pd.DataFrame([{"chunk": chunk} | _packed(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64))])

        for pdf in batches:
            for chunk, part in pdf.groupby("chunk"):
                held.setdefault(chunk, []).extend(zip(part["doc_id"], part["v"]))
                while len(held[chunk]) >= block:
                    rows, held[chunk] = held[chunk][:block], held[chunk][block:]
                    yield out(chunk, rows)
            if sum(map(len, held.values())) >= 4 * block:  # sorted by chunk: what is held of earlier ones is done
                for chunk in [c for c in held if c != pdf["chunk"].iloc[-1] and held[c]]:
                    yield out(chunk, held.pop(chunk))
        for chunk, rows in held.items():
            if rows:
                yield out(chunk, rows)

    todo = missing(spark, path, chunks)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path
    fs = where(path).getFileSystem(conf)
    fs.mkdirs(where(path))
    for start in range(0, len(todo), at_once):
        now = todo[start : start + at_once]
        staged = f"{path}/_staging-{uuid.uuid4().hex}"
        rows = good.where(F.col("chunk").isin(now)).repartition("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(8))).sortWithinPartitions("chunk", "doc_id")
        rows.mapInPandas(run, f"chunk int, {SCHEMA}").write.partitionBy("chunk").parquet(staged)
        for k in now:
            made = where(f"{staged}/chunk={k}")
            if not fs.exists(made):  # a chunk without vectors is done, too
                fs.mkdirs(made)
            fs.rename(made, where(f"{path}/chunk={k}"))
        fs.delete(where(staged), True)


def opened(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{SCHEMA}, chunk int").parquet(path)


def rounding(blocks: DataFrame) -> float:
    """The greatest error that half precision makes in any score of a unit query."""
    return blocks.agg(F.max("error")).first()[0] or 0.0


def candidates(queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, rough of what may be among the k best vectors of each query (query_id, v). The blocks are read once for
    every MOST_QUERIES or so of them, of which the driver holds one lot at a time."""
    spark = queries.sparkSession
    lots = -(-queries.count() // MOST_QUERIES)
    if lots > 1:
        dealt = queries.withColumn("lot", F.pmod(F.xxhash64("query_id"), F.lit(2 * lots)))
        parts = [written(candidates(dealt.where(F.col("lot") == n).drop("lot"), blocks, k), "candidates") for n in range(2 * lots)]
        return reduce(DataFrame.unionByName, parts)
    rows = queries.select("query_id", "v").collect()
    q = _unit(np.array([r["v"] for r in rows], np.float64)) if rows else np.zeros((0, 1))
    slack = 2 * rounding(blocks) + 4e-6  # scores are ordered as rounded to six digits, and summed in float32
    held = spark.sparkContext.broadcast((np.array([r["query_id"] for r in rows], np.int64), q.astype(np.float32), slack))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, m, slack = held.value
        best = np.full((len(q_ids), k), -np.inf, np.float32)
        found: list[tuple[np.ndarray, ...]] = []
        for pdf in batches if len(q_ids) else ():
            for n, width, ids, raw in zip(pdf["n"], pdf["width"], pdf["ids"], pdf["rows"]):
                s = m @ np.frombuffer(raw, "<f2").reshape(n, width).astype(np.float32).T
                best = -np.partition(-np.hstack([best, s]), k - 1, 1)[:, :k]
                i, j = np.nonzero(s >= best[:, k - 1 :] - slack)
                found.append((i, np.frombuffer(ids, "<i8")[j], s[i, j]))
                if sum(len(x[0]) for x in found) > 4 * best.size:
                    found = [_kept(found, best[:, k - 1], slack)]
        if found:
            i, d, s = _kept(found, best[:, k - 1], slack)
            yield pd.DataFrame({"query_id": q_ids[i], "doc_id": d, "rough": s.astype(np.float64)})

    near = blocks.select("n", "width", "ids", "rows").mapInPandas(run, "query_id long, doc_id long, rough double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("rough").desc()))
    least = near.withColumn("place", place).where(F.col("place") <= k).groupBy("query_id").agg(F.min("rough").alias("least"), F.count(F.lit(1)).alias("n"))
    return near.join(F.broadcast(least), "query_id").where((F.col("n") < k) | (F.col("rough") >= F.col("least") - slack)).select("query_id", "doc_id", "rough")


def _kept(found: list, floor: np.ndarray, slack: float) -> tuple[np.ndarray, ...]:
    i, d, s = (np.concatenate(x) for x in zip(*found))
    good = s >= floor[i] - slack
    return i[good], d[good], s[good]


def topk(queries: DataFrame, blocks: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score: the candidates by the exact cosines of `vectors` (doc_id, v); the k best are among them."""
    near = candidates(queries, blocks, k).select("query_id", "doc_id")
    return dense.pair_scores(near, queries, vectors)
