"""Dense search: cosine of a set of queries against all vectors, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import vectors as fv
from quern.sources.scratch import written

BLOCK_QUERIES = 4096


def cosine_scores(queries: DataFrame, vectors: DataFrame, k: int | None = None) -> DataFrame:
    """query_id, doc_id, score of queries (query_id, v) against vectors (doc_id, v); the k best of each task, if given."""
    return _found(queries, vectors, k).where("doc_id is not null").select("query_id", "doc_id", "score")


def cosine_pool(queries: DataFrame, vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, doc_id, score of what may be among the k best; query_id, s, ss, n: sum, sum of squares and number of all
    scores), from one pass over the vectors, without a row for each query and vector. Where the vectors have a surface and the
    queries the surfaces that they search, both are by query and surface."""
    by = ["query_id", "surface"] if "surface" in vectors.columns else ["query_id"]
    found = written(_found(queries, vectors, k), "cosines")
    sums = found.where("doc_id is null").groupBy(*by).agg(F.sum("score").alias("s"), F.sum("ss").alias("ss"), F.sum("n").alias("n"))
    return found.where("doc_id is not null").select(*by, "doc_id", "score"), sums


def _found(queries: DataFrame, vectors: DataFrame, k: int | None) -> DataFrame:
    """Scores, and with doc_id null a task's sum, sum of squares and number of scores.

    Queries are dealt by a hash into blocks of about BLOCK_QUERIES; only one block at a time is on the driver and broadcast, each
    block scans the vectors once.
    """
    count = queries.count()
    if count <= BLOCK_QUERIES:
        return _block(queries, vectors, k)
    blocks = -(-count // BLOCK_QUERIES)
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    out = None
    for number in range(blocks):
        part = written(_block(dealt.where(F.col("block") == number), vectors, k), "block")
        out = part if out is None else out.unionByName(part)
    return out


def _pruned(q: np.ndarray, d: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query by rounded score, ties to the smaller id."""
    order = np.lexsort((d, -np.round(s, 6), q))
    q, d, s = q[order], d[order], s[order]
    first = np.flatnonzero(np.diff(q, prepend=-1))
    nth = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return q[nth < k], d[nth < k], s[nth < k]


def _block(queries: DataFrame, vectors: DataFrame, k: int | None) -> DataFrame:
    surfaced = "surface" in vectors.columns
    rows = queries.select("query_id", "v", *["surfaces"] * surfaced).collect()  # one block of queries
    q_ids = np.array([r[0] for r in rows], np.int64)
    q = np.array([r[1] for r in rows], np.float64) if rows else np.zeros((0, 1))
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    asks: dict[str, list[int]] = {}
    for at, r in enumerate(rows):
        for surface in set(r["surfaces"]) if surfaced else {""}:
            asks.setdefault(surface, []).append(at)
    held = vectors.sparkSession.sparkContext.broadcast((q_ids, q, {s: np.array(at) for s, at in asks.items()}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, m, asks = held.value
        # of each surface: sums a query, how many vectors, the least score that still counts, and what has been found so far
        sums = {s: np.zeros((2, len(at))) for s, at in asks.items()}
        seen, floor, best, waits = dict.fromkeys(asks, 0), {s: np.full(len(at), -np.inf) for s, at in asks.items()}, {}, {}

        def cut(surface: str) -> None:
            parts = [best.get(surface), *waits.pop(surface, [])]
            q, d, s = (np.concatenate(x) for x in zip(*[p for p in parts if p is not None]))
            best[surface] = q, d, s = _pruned(q, d, s, k)
            size = np.bincount(q, minlength=len(asks[surface]))
            last = np.cumsum(size) - 1
            floor[surface] = np.where(size >= k, s[np.maximum(last, 0)] - 1e-6, -np.inf)

        def frame(surface: str, at, d, s, ss=0.0, n=0) -> pd.DataFrame:
            return pd.DataFrame({"query_id": ids[at], "surface": surface, "doc_id": d, "score": s, "ss": ss, "n": n})

        for pdf in batches:
            for surface, whole in pdf.groupby("surface", sort=False) if surfaced else [("", pdf)]:
                if surface not in asks:
                    continue
                for start in range(0, len(whole), 2048):
                    part = whole.iloc[start : start + 2048]
                    v = np.stack(part["v"].to_list()).astype(np.float64)
                    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                    at = asks[surface]
                    s, d = m[at] @ v.T, part["doc_id"].to_numpy(np.int64)
                    sums[surface] += s.sum(1), (s * s).sum(1)
                    seen[surface] += len(d)
                    if k is None:
                        yield frame(surface, np.repeat(at, len(d)), np.tile(d, len(at)), s.ravel())
                        continue
                    i, j = np.nonzero(s >= floor[surface][:, None])
                    waits.setdefault(surface, []).append((i, d[j], s[i, j]))
                    if sum(len(w[0]) for w in waits[surface]) >= 2 * k * len(at):
                        cut(surface)
        for surface, at in asks.items():
            if waits.get(surface):
                cut(surface)
            if surface in best:
                q, d, s = best[surface]
                yield frame(surface, at[q], d, s)
            yield frame(surface, at, pd.array([None] * len(at), "Int64"), *sums[surface], seen[surface])

    out = vectors.select("doc_id", "v", *["surface"] * surfaced).mapInPandas(run, "query_id long, surface string, doc_id long, score double, ss double, n long")
    return out if surfaced else out.drop("surface")


def pair_scores(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """The pairs (query_id, doc_id and, where the vectors have one, surface) that have both vectors, with their score."""
    by = ["doc_id", "surface"] if "surface" in vectors.columns else ["doc_id"]
    rows = pairs.join(queries.select("query_id", F.col("v").alias("_q")), "query_id").join(vectors.select(*by, F.col("v").alias("_d")), by)
    return rows.select("query_id", *by, fv.cosine(F.col("_q"), F.col("_d")).alias("score"))
