"""Importance resampling towards a target distribution, by hashed word runs: external sort-count.

One pass over the texts writes each block of documents as one packed uint16 stream of feature buckets, with where each
document's part of it ends. Streams are sorted and run-length encoded for the counts of all documents and of the
target's texts; of these there are at most `buckets`, whatever the data's size. A bucket's gain is the logarithm of how much likelier
the target makes it. Then the streams, not the texts, are read again: gains are gathered along them and summed between the
documents' ends by np.add.reduceat. A document's score is its weight with Gumbel noise drawn from its id; the highest scores
are a sample without replacement in proportion to the weights, and the same again in each run.

Places in the order of scores come from ranges of it, so no task holds all documents and none are dropped.

Defined results: a null or empty text has no words, 0 features and weight 0; a null doc_id draws its noise from the seed alone and
comes last among ties; rows that repeat a doc_id are each a document of their own, with the same noise; an empty table
gives an empty result, an empty target counts as 0 everywhere. Other columns are ignored, whatever their names. A block holds up to
1,000 documents and about 8 MB of text, or one longer text, which is taken as a whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import small_batches, written
from quern.operators.tables import numbered

BUCKETS, ORDERS, SEED, LEAST_WORDS, PERCENT = 10_000, (1, 1), "2024", 20, 10
#: Words in UTF-8 with A-Z lower-cased: digits, letters and all beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_STREAM = "ids array<long>, words array<long>, ends array<long>, stream binary"


def features(text: bytes | None, buckets: int = BUCKETS, orders: tuple[int, int] = ORDERS) -> tuple[int, np.ndarray]:
    """How many words a text has, and the bucket of each of its runs of words, of all orders from the first to the last."""
    words = _WORD.findall(text.lower()) if text else []
    got = [np.fromiter(map(zlib.crc32, words), np.uint32, len(words))] if orders[0] <= 1 else []
    for k in range(max(2, orders[0]), orders[1] + 1):
        runs = [zlib.crc32(b" ".join(words[i : i + k])) for i in range(len(words) - k + 1)]
        got.append(np.array(runs, np.uint32))
    return len(words), (np.concatenate(got) % np.uint32(buckets)).astype("<u2") if got else np.zeros(0, "<u2")


def streams(docs: DataFrame, buckets: int = BUCKETS, orders: tuple[int, int] = ORDERS, key: str = "doc_id") -> DataFrame:
    """A row a block of documents (key, text): their ids, numbers of words, ends in the stream, and the packed buckets."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket must fit in 16 bits")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            found = [features(t, buckets, orders) for t in pdf["text"]]
            ends = np.cumsum([len(f) for _, f in found])
            ids = [None if pd.isna(i) else int(i) for i in pdf["id"]]
            yield pd.DataFrame({"ids": [ids], "words": [[n for n, _ in found]], "ends": [ends.tolist()], "stream": [np.concatenate([f for _, f in found]).tobytes()]})

    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("id"), F.col("text").cast("binary").alias("text")).mapInPandas(run, _STREAM)


def bucket_counts(packed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all streams: sorted and run-length encoded block by block, runs summed in each task and then by Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for pdf in batches:
            for stream in pdf["stream"]:
                s = np.sort(np.frombuffer(stream, "<u2"))
                first = np.flatnonzero(np.diff(s, prepend=-1, append=-1).astype(bool)) if len(s) else np.zeros(1, np.int64)
                total[s[first[:-1]]] += np.diff(first)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": held, "n": total[held]})

    out = np.zeros(buckets, np.int64)
    for r in packed.select("stream").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `buckets` rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of how much likelier the target makes a bucket), with one added to every count."""
    s, t, n = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weights(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the sum of a document's gains, gathered along the streams."""
    held = packed.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, words, ends, stream in zip(pdf["ids"], pdf["words"], pdf["ends"], pdf["stream"]):
                ends = np.asarray(ends, np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                some, total = ends > starts, np.zeros(len(ends), np.int64)
                if some.any():  # of none, reduceat would give the next one's first
                    total[some] = np.add.reduceat(held.value[np.frombuffer(stream, "<u2")], starts[some])
                yield pd.DataFrame({"doc_id": pd.array(list(ids), "Int64"), "n_words": words, "n_features": ends - starts, "weight": total})

    return packed.mapInPandas(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise of an id, in thousandths: from the first 32 bits of sha256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, target_key: str, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, orders: tuple[int, int] = ORDERS, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of all `docs` (doc_id, text): rank is null where a document isn't drawn."""
    packed = written(streams(docs, buckets, orders), "streams")
    gain = gains(bucket_counts(packed, buckets), bucket_counts(streams(target, buckets, orders, target_key), buckets))
    scored = written(weights(packed, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    fit = F.col("n_words") >= least_words
    drawn = scored.where(fit).count() * percent // 100
    placed = numbered(scored, [(~fit).cast("int"), -F.col("score"), F.col("doc_id").isNull().cast("int"), F.coalesce("doc_id", F.lit(0)), F.col("n_features"), F.col("weight")])
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).cast("long").alias("rank"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id")


#: crc32 by its table of 256 remainders, for each distinct word once.
ORACLE_SQL = r"""
WITH tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS w FROM d),
dc AS (SELECT doc_id, w, count(*) AS n FROM dw GROUP BY 1, 2),
v AS (SELECT DISTINCT w FROM dw UNION SELECT w FROM b),
x AS (SELECT w, list_prepend(4294967295, list_transform(range(octet_length(encode(w))), lambda i: CAST('0x' || substr(hex(w), 2 * i + 1, 2) AS BIGINT))) AS l, t FROM v, tab),
k AS (SELECT w, xor(list_reduce(l, lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1])), 4294967295) % 10000 AS bucket FROM x),
s AS (SELECT bucket, sum(n) AS s FROM dc JOIN k USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (w) GROUP BY 1),
m AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS ss, (SELECT coalesce(sum(t), 0) FROM t) AS tt),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000)::DOUBLE / ((s + 1)::DOUBLE * (tt + 10000)::DOUBLE))) AS BIGINT) AS g FROM s LEFT JOIN t USING (bucket), m),
p AS (SELECT doc_id, sum(n * g) AS weight FROM dc JOIN k USING (w) JOIN g USING (bucket) GROUP BY 1),
q AS (SELECT doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN p USING (doc_id)),
z AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score, n_features >= 20 AS fit FROM q),
o AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS r, (SELECT 10 * count(*) // 100 FROM z WHERE fit) AS n FROM z)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN fit AND r <= n THEN r END AS rank FROM o"""
