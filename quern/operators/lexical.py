"""Lexical search: index statistics and Okapi BM25.

A search touches the documents once: tokens are made and counted inside the scan, only those that some query asks for go
on, and scores are summed a query and document at a time. No postings of unasked terms are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.functions.text import normalize_latin, tokens
from quern.operators.sizes import BROADCAST_ROWS, grid_join, if_small
from quern.sources.scratch import written

K1, B = 1.5, 0.75
FEW_FIRST = 2000  # so many words are sought in a document by a set in the plan
Tokenize = Callable[[Column], Column]


def words(text: Column) -> Column:
    return tokens(normalize_latin(text))


def term_statistics(docs: DataFrame, tokenize: Tokenize = words) -> DataFrame:
    """term, df, cf, idf over all documents (doc_id, text): one explode and one shuffle give both counts."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    w = tokenize(F.col("text"))
    own = docs.select(F.explode(w).alias("term"), F.lit(0).alias("d")).unionAll(docs.select(F.explode(F.array_distinct(w)).alias("term"), F.lit(1).alias("d")))
    both = own.groupBy("term").agg(F.count_if(F.col("d") == 1).alias("df"), F.count_if(F.col("d") == 0).alias("cf"))
    return both.crossJoin(F.broadcast(n)).select("term", "df", "cf", idf(F.col("n"), F.col("df")).alias("idf"))


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def bm25(queries: DataFrame, docs: DataFrame, tokenize: Tokenize = words, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, doc_id, score of every document that shares a term with a query (query_id, text)."""
    asked = queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))
    # one check for all: document frequencies are needed of no more terms than are asked for
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda df: df)
    cut = docs.select("doc_id", tokenize(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("dl"), "t")
    totals = cut.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    # outer, as for a plain explode the optimiser adds a filter that makes all tokens once more; the join drops the nulls
    hits = cut.select("doc_id", "dl", F.explode_outer("t").alias("term")).join(small(asked.select("term").distinct()), "term")
    tf = hits.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    part = idf(F.col("n"), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.nullif(F.col("avgdl"), F.lit(0.0))))
    weighed = tf.join(small(df), "term").crossJoin(F.broadcast(totals)).select("doc_id", "term", part.alias("s"))
    # a word that many queries and many documents have is dealt over a grid of tasks
    met = weighed.join(F.broadcast(asked), "term") if few else grid_join(weighed, asked, "term")
    return met.groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"))


def containing(docs: DataFrame, passages: DataFrame, width: int = 3) -> DataFrame:
    """query_id, doc_id of the documents (doc_id, text) whose text holds a passage (query_id, text) as it is.

    Passages meet documents by equality: runs of `width` blank-separated words of a document, hashed, against one run of a
    passage that is sure to be whole words in any text around it, the one that begins with its longest word; passages of fewer whole
    words by all of these, the others, of no whole word, by their first three characters (or all of fewer). Of a document's
    runs only those are made that begin as a passage's run does, unless there are more than FEW_FIRST such words. Then the texts
    themselves decide.
    """
    parts = F.split(F.col("text"), " ")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))  # the first and last word may go on in the text around
    rows = passages.where(F.col("text").isNotNull()).withColumn("inner", inner).withColumn("n", F.least(F.size("inner"), F.lit(width)))
    run = lambda words, n: F.xxhash64(F.array_join(words, " "), n)
    starts = F.transform(F.slice("inner", F.lit(1), F.size("inner") - F.col("n") + 1), lambda w: F.length(w))
    begins = F.array_position(starts, F.array_max(starts)).cast("int")
    keyed = rows.where("n > 0").select("query_id", F.col("text").alias("_passage"), "n", F.slice("inner", begins, F.col("n")).alias("run"))
    keyed = keyed.select("query_id", "_passage", "n", run(F.col("run"), F.col("n")).alias("key"), F.get("run", F.lit(0)).alias("first"))
    small = F.broadcast if keyed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else (lambda df: df)
    sizes = sorted(r["n"] for r in keyed.select("n").distinct().collect())  # 1 to `width`
    firsts = keyed.select("n", "first").distinct().limit(FEW_FIRST + 1).collect()
    words = docs.select("doc_id", F.split("text", " ").alias("w"))

    def runs(n: int) -> Column:
        at = F.sequence(F.lit(1), F.size("w") - n + 1)
        if len(firsts) <= FEW_FIRST:
            at = F.filter(at, lambda i: F.get("w", i - 1).isin([r["first"] for r in firsts if r["n"] == n]))
        every = F.transform(at, lambda i: run(F.slice("w", i, F.lit(n)), F.lit(n)))
        return F.when(F.size("w") >= n, every).otherwise(F.array().cast("array<bigint>"))

    keys = [runs(n) for n in sizes]
    empty = docs.select(F.lit(None).cast("long").alias("query_id"), "doc_id", F.lit(None).cast("string").alias("_passage")).where("false")
    pairs = words.select("doc_id", F.explode_outer(F.array_distinct(F.concat(*keys))).alias("key")).join(small(keyed), "key").select("query_id", "doc_id", "_passage").distinct() if keys else empty
    loose = rows.where("n = 0").select("query_id", F.col("text").alias("_passage"), F.least(F.length("text"), F.lit(3)).alias("size"))
    lengths = sorted(r["size"] for r in loose.select("size").distinct().collect())  # 0 to 3
    grams = lambda n: F.when(F.length("text") >= n, F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda i: F.substring("text", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    for n in lengths:
        own = loose.where(F.col("size") == n).select("query_id", "_passage", F.substring("_passage", 1, n).alias("key"))
        held = docs.where("text is not null").select("doc_id", F.explode(F.array_distinct(grams(n)) if n else F.array(F.lit(""))).alias("key"))
        few = own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        pairs = pairs.unionByName((held.join(F.broadcast(own), "key") if few else grid_join(held, own, "key")).select("query_id", "doc_id", "_passage"))
    pairs = written(pairs, "passages")
    return docs.select("doc_id", "text").join(if_small(pairs), "doc_id").where(F.col("text").contains(F.col("_passage"))).select("query_id", "doc_id").distinct()


def top(scores: DataFrame, k: int, by: str | list[str] = "query_id", score: str = "score", tie: str = "doc_id", digits: int = 6) -> DataFrame:
    """Adds rank; the k best by rounded score, ties to the smaller id."""
    order = W.partitionBy(by).orderBy(F.round(score, digits).desc(), tie)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
