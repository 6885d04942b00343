"""Exact top-k search by block-at-a-time pruning.

Vectors become whole numbers, floor(64 * x). They are brought into an order in which alike ones lie together: each goes
to the nearest of `PIVOTS` pivots (vectors of a bounded sample), each pivot's vectors, dealt over groups of about
`GROUP` rows, are halved again and again at the median of their widest component. Ranges of this order are blocks of
at most `BLOCK` vectors; a block keeps the maximum and minimum of each component (its "terms") and its vectors as a forward
index, all in the narrowest whole numbers that hold them. Vectors are shuffled once, into blocks.

Queries come in batches of about `QUERIES`, one broadcast each, and every batch scans the blocks. For a query, the sum over
components of what a block can contribute at most bounds all its scores; blocks are visited by falling bound and scored
through their forward index until the next bound is below the k-th score found so far. The search starts with the k-th
score of a bounded sample, the same threshold everywhere; so no task starts from nothing and few candidates leave a task.

Scoring all of N vectors by queries that are a share of N stays quadratic where no bound can prune, as in vectors without any
structure; `block_counts` tells how many blocks were scored. What is shuffled and broadcast isn't: N vectors once, and at
most k rows a query and task.

Defined results: vectors that are null, or hold a null or a component that isn't finite, take no part, neither as
queries nor as candidates, as do rows with a null vec_id; a shorter vector counts as if filled up with zeros; rows with the
query's own vec_id are the query's own; rows that repeat a query's vec_id ask once, with the least of their vectors; repeated
candidates are candidates each; ties go to the smaller vec_id. Other columns are ignored. Numbers are 64-bit integers, as scores
are: a component of 2^57 or more becomes 2^63 - 1, and a score among the k best that doesn't fit in 64 bits is an OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.llm.common import Scratch, partitions, written

K, BLOCK, GROUP, QUERIES, PIVOTS, SEEDS = 20, 64, 2048, 8192, 128, 4096
CHUNK = 1 << 14  # vectors that a task holds at a time, at least one block


def whole(embedding: Column) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * 64).cast("long"))


def usable(rows: DataFrame) -> DataFrame:
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), e).where(F.col("vec_id").isNotNull() & e.isNotNull() & finite)


def matrix(rows, width: int, kind: str = "int64") -> np.ndarray:
    out = np.zeros((len(rows), width), kind)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def halved(v: np.ndarray, block: int = BLOCK) -> list[np.ndarray]:
    """Row numbers of blocks of at most `block` alike vectors: halves at the median of the component that varies most."""
    todo, out = [np.arange(len(v))], []
    while todo:
        at = todo.pop()
        if len(at) <= block:
            out.append(at)
            continue
        x = v[at].astype(np.float64)
        x = x[:, int(np.argmax(x.var(0)))]
        order = np.argsort(x, kind="stable")
        cut = -(-(len(at) // 2) // block) * block
        todo += [at[order[cut:]], at[order[:cut]]]
    return out


def exact_kind(most: float) -> type:
    """The fastest type in which sums of products up to `most` are exact."""
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def pruned(q_ids: np.ndarray, q: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int = K, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, candidate ids, scores) of each query's k best candidates by (score, smaller id) in these blocks (ids,
    vectors), of those that reach `least`; and how many blocks each query has scored."""
    count, width = len(blocks), q.shape[1]
    scored = np.zeros(len(q), np.int64)
    top, low = np.stack([b.max(0) for _, b in blocks]), np.stack([b.min(0) for _, b in blocks])
    largest = max(abs(int(top.max(initial=0))), abs(int(low.min(initial=0))))
    kind = exact_kind(float(np.abs(q).max(initial=0)) * largest * width)
    q, top, low = q.astype(kind), top.astype(kind), low.astype(kind)
    lowest = -float("inf") if kind is not object else -(1 << 200)
    kth = np.full(len(q), lowest, kind)
    if least is not None and kind is not object:
        kth = np.maximum(kth, least.astype(kind))
    bound = np.where(q > 0, q, 0) @ top.T + np.where(q < 0, q, 0) @ low.T
    visit = np.argsort(-bound.astype(np.float64), 1, kind="stable")
    size = max(len(i) for i, _ in blocks)
    ids, there = np.full((count, size), -1, np.int64), np.zeros((count, size), bool)
    index = np.zeros((count, size, width), kind)
    for n, (i, v) in enumerate(blocks):
        ids[n, : len(i)], there[n, : len(i)], index[n, : len(i)] = i, True, v
    best, best_ids = np.full((len(q), k), lowest, kind), np.full((len(q), k), np.iinfo(np.int64).max)
    active, first = np.arange(len(q)), 0
    while first < count and len(active):
        last = min(count, max(1, 2 * first))  # so many places of the visiting order at once: 1, 1, 2, 4, 8, ...
        at = visit[active, first:last].ravel()
        by_block = np.argsort(at, kind="stable")
        edges = np.flatnonzero(np.diff(at[by_block], prepend=-1))
        for a, z in zip(edges, [*edges[1:], len(at)]):  # queries that visit the same block score it together
            b, rows = at[by_block[a]], active[by_block[a:z] // (last - first)]
            rows = rows[bound[rows, b] >= kth[rows]]
            scored[rows] += 1
            score = q[rows] @ index[b].T
            reach = (score >= kth[rows][:, None]) & there[b][None, :] & (ids[b][None, :] != q_ids[rows][:, None])
            hit = reach.any(1)
            if not hit.any():
                continue
            rows, score, reach = rows[hit], score[hit], reach[hit]
            both = np.hstack([best[rows], np.where(reach, score, lowest)])
            both_ids = np.hstack([best_ids[rows], np.where(reach, ids[b][None, :], np.iinfo(np.int64).max)])
            pick = np.lexsort((both_ids, -both), 1)[:, :k] if kind is not object else np.array([sorted(range(both.shape[1]), key=lambda j, r=r: (-both[r, j], both_ids[r, j]))[:k] for r in range(len(both))])
            best[rows], best_ids[rows] = np.take_along_axis(both, pick, 1), np.take_along_axis(both_ids, pick, 1)
            kth[rows] = np.maximum(kth[rows], best[rows, k - 1])
        if last < count:
            active = active[bound[active, visit[active, last]] >= kth[active]]
        first = last
    at, j = np.nonzero(best != lowest)
    return at, best_ids[at, j], best[at, j].astype(np.int64), scored


def _forward_index(good: DataFrame, width: int, kind: str, pivots: np.ndarray, group: int, block: int) -> DataFrame:
    """ids and vectors (binary) of blocks. Vectors go to their nearest pivot; those of a pivot are dealt into groups of about `group`."""
    held = good.sparkSession.sparkContext.broadcast((pivots, (pivots.astype(np.float64) ** 2).sum(1) / 2))

    @F.pandas_udf("int")
    def nearest(rows: pd.Series) -> pd.Series:
        p, half = held.value
        out = np.zeros(len(rows), np.int32)
        for start in range(0, len(rows), 4096):
            out[start : start + 4096] = (matrix(rows.iloc[start : start + 4096], width, "float64") @ p.T - half).argmax(1)
        return pd.Series(out)

    near = good.select("vec_id", "v", nearest("v").alias("cell"))
    cells = near.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("parts"))  # PIVOTS rows at most
    # the row's place, not its values: a vector that repeats often is dealt as well
    dealt = near.withColumn("place", F.monotonically_increasing_id()).join(F.broadcast(cells), "cell").withColumn("part", F.pmod("place", "parts").cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v, ids = matrix(pdf["v"], width, kind), pdf["vec_id"].to_numpy(np.int64)
        return pd.DataFrame([(ids[at].tobytes(), v[at].tobytes()) for at in halved(v, block)], columns=["ids", "vectors"])

    return dealt.groupBy("cell", "part").applyInPandas(run, "ids binary, vectors binary")


def search(rows: DataFrame, is_query: Column, k: int = K, group: int = GROUP, queries: int = QUERIES, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all `rows` (vec_id, embedding) but its own, for every row where `is_query`."""
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = _found(rows, is_query, k, group, queries, block).where("vec_id is not null")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def block_counts(rows: DataFrame, is_query: Column, k: int = K, group: int = GROUP, queries: int = QUERIES, block: int = BLOCK) -> DataFrame:
    """query_id, blocks_scored, blocks of the same search."""
    found = _found(rows, is_query, k, group, queries, block).where("vec_id is null")
    return found.groupBy("query_id").agg(F.sum("score").alias("blocks_scored"), F.sum("blocks").alias("blocks"))


def _found(rows: DataFrame, is_query: Column, k: int, group: int, queries: int, block: int) -> DataFrame:
    """query_id, vec_id, score, blocks: each task's k best a query; with vec_id null, how many of its blocks a query scored."""
    spark = rows.sparkSession
    schema = "query_id long, vec_id long, score long, blocks long"
    scratch = Scratch()
    vectors = usable(rows).select("vec_id", whole(F.col("embedding")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    good = scratch.written(vectors, "vectors")
    n, width, low, high = good.agg(F.count(F.lit(1)), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    if not n:
        scratch.discard()
        return spark.createDataFrame([], schema)
    width, low, high = max(1, width), low or 0, high or 0
    kind = next(t for t in ("int8", "int16", "int32", "int64") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    lot = F.xxhash64("vec_id", F.lit(2))
    share = F.lit(4 * SEEDS / n) if n > 4 * SEEDS else F.lit(1.0)
    few = F.pmod(lot, F.lit(1 << 30)) / float(1 << 30) < share
    sample = good.where(few).orderBy(lot, "vec_id", "v").limit(SEEDS).select("vec_id", "v").toArrow().to_pydict()
    seed_ids, seeds = np.array(sample["vec_id"], np.int64), matrix(sample["v"], width)
    pivots = np.unique(seeds[:: max(1, len(seeds) // PIVOTS)], axis=0)[:PIVOTS] if len(seeds) else np.zeros((1, width), np.int64)
    index = written(_forward_index(good, width, kind, pivots, group, block), "blocks")
    asked = good.where("q").groupBy("vec_id").agg(F.min("v").alias("v"))
    batches = max(1, -(-asked.count() // queries))
    asked = scratch.written(asked.withColumn("batch", F.pmod(F.xxhash64("vec_id"), F.lit(batches)).cast("int")).repartition(partitions(spark), "batch"), "queries")
    out = None
    for number in range(batches):
        own = asked.where(F.col("batch") == number).select("vec_id", "v").toArrow().to_pydict()
        if own["vec_id"]:
            part = _batch(index, np.array(own["vec_id"], np.int64), matrix(own["v"], width), seed_ids, seeds, kind, k, schema)
            if batches == 1:
                out = part
            else:
                part = written(part, "found")
                out = part if out is None else out.unionByName(part)
    scratch.discard()
    return spark.createDataFrame([], schema) if out is None else out


def _seeded(q_ids: np.ndarray, q: np.ndarray, seed_ids: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """The k-th score of each query among the seeds but its own; minus infinity where there are fewer."""
    out = np.full(len(q), -float("inf"))
    most = float(np.abs(q).max(initial=0)) * float(np.abs(seeds).max(initial=0)) * q.shape[1]
    kind = exact_kind(most)
    if kind is object or len(seeds) < k:
        return out
    for start in range(0, len(q), 512):
        score = (q[start : start + 512].astype(kind) @ seeds.T.astype(kind)).astype(np.float64)
        score[q_ids[start : start + 512, None] == seed_ids[None, :]] = -float("inf")
        out[start : start + 512] = np.partition(score, len(seeds) - k, 1)[:, len(seeds) - k]
    return out


def _batch(index: DataFrame, q_ids: np.ndarray, q: np.ndarray, seed_ids: np.ndarray, seeds: np.ndarray, kind: str, k: int, schema: str) -> DataFrame:
    held = index.sparkSession.sparkContext.broadcast((q_ids, q, _seeded(q_ids, q, seed_ids, seeds, k)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, asked, least = held.value
        width = asked.shape[1]
        best_ids, best = np.full((len(ids), k), np.iinfo(np.int64).max), np.full((len(ids), k), -(1 << 62))
        filled = np.zeros(len(ids), np.int64)
        least, scored, seen = least.copy(), np.zeros(len(ids), np.int64), 0
        blocks, rows = [], 0

        def take() -> None:
            at, found, scores, own = pruned(ids, asked, blocks, k, least)
            scored[:] += own
            for row in np.unique(at):
                a, z = np.searchsorted(at, (row, row + 1))
                i, s = np.concatenate([best_ids[row, : filled[row]], found[a:z]]), np.concatenate([best[row, : filled[row]], scores[a:z]])
                pick = np.lexsort((i, -s))[:k]
                filled[row] = len(pick)
                best_ids[row, : len(pick)], best[row, : len(pick)] = i[pick], s[pick]
                if len(pick) == k:
                    least[row] = max(least[row], float(best[row, k - 1])) if abs(int(best[row, k - 1])) < 1 << 53 else least[row]

        for pdf in batches:
            for i, v in zip(pdf["ids"], pdf["vectors"]):
                i = np.frombuffer(i, np.int64)
                blocks.append((i, np.frombuffer(v, kind).reshape(len(i), width)))
                rows, seen = rows + len(i), seen + 1
                if rows >= CHUNK:
                    take()
                    blocks, rows = [], 0
        if blocks:
            take()
        if seen:
            at, j = np.nonzero(np.arange(k)[None, :] < filled[:, None])
            yield pd.DataFrame({"query_id": ids[at], "vec_id": best_ids[at, j], "score": best[at, j], "blocks": 0})
            yield pd.DataFrame({"query_id": ids, "vec_id": pd.array([None] * len(ids), "Int64"), "score": scored, "blocks": seen})

    return index.mapInPandas(run, schema)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


#: The same by all inner products.
ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""
