"""Quality classification by nearest-neighbour voting in a latent-semantic space.

A document's terms are hashed byte n-grams of its whole text and of its shape (letters become a or A, digits 0), and
coarse measures of repetition. They are damped, weighted by inverse document frequency and projected on the leading
singular vectors of a labelled sample. The sample's vectors are broadcast; every document meets all of them in
blocked, exact cosine products, and its `NEIGHBOURS` nearest vote for their labels with a weight of their
similarity. Votes are weighted back to the labels' frequency.

The sample holds at most `SAMPLE` labelled documents, half of each label where there are enough, those with the least
hash of doc_id; so what is broadcast is bounded by SAMPLE * LATENT numbers. Labels are counted over all rows.

Defined results: null texts count as empty ones and get a score like any other text; a null doc_id is in neither
fold; rows that repeat a doc_id in `labels` count as low quality if one of them says so, labels other than 0 and 1 not at
all; of rows that repeat a doc_id in the documents, the least text teaches;
without labels of both kinds the score is the share of label 1 (0.5 without any). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.llm.common import encoded, fold, gram_counts, small_batches

CONTENT, SHAPE, SAMPLE, LATENT, NEIGHBOURS, CUT = 1024, 512, 4000, 64, 21, 0.7
_SHAPE = bytes(
    97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 if c <= 32 else c for c in range(256)
)
_BINS = 10


def terms(texts: list[str]) -> np.ndarray:
    raw = [encoded(t) for t in texts]
    content = np.log1p(gram_counts([b.lower() for b in raw], CONTENT, (3,), 5))
    shape = np.log1p(gram_counts([b.translate(_SHAPE) for b in raw], SHAPE, (1, 2, 3), 9))
    extra = np.zeros((len(texts), 4 * _BINS), np.float32)
    for row, b in enumerate(raw):
        words = b.split()
        n = max(1, len(words))
        pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
        signs = sum(len(w) == 1 and not w.isalpha() for w in words) / n  # a letter alone (a, I, y) is a word
        upper = sum(len(w) > 1 and w.isupper() for w in words) / n
        for k, value in enumerate((len(set(words)) / n ** 0.8, pairs, signs, upper)):
            extra[row, k * _BINS + min(_BINS - 1, int(value * _BINS))] = 1
    unit = lambda x: x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
    return np.hstack([0.5 * unit(content), unit(shape), unit(extra)])


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weight: np.ndarray  # of a vote for label 0, for label 1
    prior: float

    def latent(self, texts: list[str]) -> np.ndarray:
        z = (terms(texts) * self.idf) @ self.axes
        return z / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-9)

    def score(self, texts: list[str]) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(texts), self.prior)
        cosine = self.latent(texts) @ self.vectors.T
        return self.vote(cosine)

    def vote(self, cosine: np.ndarray) -> np.ndarray:
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, 1)[:, :k]
        vote = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6).astype(np.float64) ** 4 * self.weight[self.labels[near]]
        return (vote * self.labels[near]).sum(1) / vote.sum(1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on labelled rows of fold 0, 1 and 3."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where((fold(F.col("doc_id")) != 2) & F.col("label").isin(0, 1))
    marks = marks.groupBy("doc_id").agg(F.min("label").alias("label"))
    count = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = sum(count.values())
    prior = count.get(1, 0) / whole if whole else 0.5
    empty = Model(np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0, int), np.ones(2), prior)
    if len(count) < 2:
        return empty
    half = sample // 2
    share = F.when(F.col("label") == 0, (half + 10 * half**0.5) / count[0]).otherwise((half + 10 * half**0.5) / count[1])
    lot = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    nth = F.row_number().over(W.partitionBy("label").orderBy("lot", "doc_id"))
    chosen = marks.withColumn("lot", lot).where(F.col("lot") < share).withColumn("nth", nth).where(F.col("nth") <= half).select("doc_id", "label")  # `sample` rows at most
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = terms(list(pdf["text"])).astype(np.float16)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "x": [r.tobytes() for r in x]})

    rows = taught.mapInPandas(run, "doc_id long, label int, x binary").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], bytes(r["x"])))
    y = np.array([r["label"] for r in rows], int)
    if len(set(y)) < 2:
        return empty
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    x = x * idf
    rng = np.random.default_rng(11)
    rank = min(LATENT, len(x), x.shape[1])
    base = x @ rng.standard_normal((x.shape[1], rank + 16)).astype(np.float32)
    for _ in range(4):
        base = x @ (x.T @ np.linalg.qr(base)[0])
    q = np.linalg.qr(base)[0]
    axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32)
    z = x @ axes
    z /= np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-9)
    weight = np.array([count[0] / whole / (y == 0).mean(), count[1] / whole / (y == 1).mean()])
    return Model(idf, axes, z, y, weight, prior)


def judge(spark: SparkSession, model: Model, cut: float = CUT) -> Callable[[Column], Column]:
    """A column function: text -> struct<score, predicted>."""
    small_batches(spark)
    held = spark.sparkContext.broadcast(vars(model))  # arrays: a class is only known to the driver

    @F.pandas_udf("score double, predicted int")
    def run(column: pd.Series) -> pd.DataFrame:
        texts, score = [t or "" for t in column], np.zeros(len(column))
        for start in range(0, len(texts), 256):
            score[start : start + 256] = Model(**held.value).score(texts[start : start + 256])
        score = np.clip(score, 0.0, 1.0)
        return pd.DataFrame({"score": score, "predicted": (score >= cut).astype("int32")})

    return run


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` (doc_id, text) -> doc_id, held_out, score, predicted, one row each."""
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), judge(docs.sparkSession, model)(F.col("text")).alias("p"))
    return rows.select("doc_id", F.coalesce(fold(doc_id) == 2, F.lit(False)).alias("held_out"), "p.score", "p.predicted")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predicted(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
