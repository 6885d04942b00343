"""Score fusion over candidate pools: z-scores, min-max, reciprocal ranks; best surface; kind boost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.operators.sizes import if_small
from quern.sources.scratch import written

DENSE, LEXICAL, BOOST, RRF_K = 0.70, 0.30, 0.10, 60
POOL_ROWS = 500_000  # candidates of all queries that are broadcast, some 50 MB


def sums(scores: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """`by`, s, ss, n: sum, sum of squares and number of scores."""
    return scores.groupBy(*by).agg(F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("ss"), F.count(F.lit(1)).alias("n"))


def moments(summed: DataFrame, n: int | None = None, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """`by`, mean, sd of sums(); over `n` documents if given, those without a score counting as 0."""
    count = F.col("n") if n is None else F.lit(n)
    mean = F.col("s") / count
    return summed.select(*by, mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / count - mean * mean)).alias("sd"))


def z(score: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd > 0, (score - mean) / sd).otherwise(0.0)


def weighted_z(dense: DataFrame, dense_sums: DataFrame, cosine_of, lexical: DataFrame, n_lexical: int | DataFrame, k: int = 400, w_dense: float = DENSE, w_lexical: float = LEXICAL, lexical_sums: DataFrame | None = None, lexical_of=None) -> DataFrame:
    """query_id, doc_id, dense, lexical, zd, zl, score: the k best of either retriever, fused by z-scores over the whole surface; a
    score that a text doesn't have is 0. Where the scores have a surface, each is a corpus of its own.

    `dense` and `dense_sums`: the best and the sums of all, as from dense.cosine_pool(); `cosine_of`: from pairs (query_id,
    doc_id) to their scores; `n_lexical`: how many documents the lexical retriever has, by surface (surface, n) if there are any.
    `lexical`: all its scores; or what may be among its best, with `lexical_sums` and `lexical_of` as the dense retriever has them.
    """
    from quern.operators.lexical import top

    by = ("query_id", "surface") if "surface" in dense.columns else ("query_id",)
    best = lambda df: top(df, k, [*by]).select(*by, "doc_id")
    pool = written(best(dense).union(best(lexical.where("score > 0"))).distinct(), "fused")
    d, summed = moments(dense_sums, None, by), sums(lexical, by) if lexical_sums is None else lexical_sums
    # of all scores only the pool's are sent
    own = lexical.join(if_small(pool, POOL_ROWS), [*by, "doc_id"], "left_semi") if lexical_of is None else lexical_of(pool)
    l = moments(summed, n_lexical, by) if isinstance(n_lexical, int) else moments(summed.drop("n").join(F.broadcast(n_lexical), "surface"), None, by)  # noqa: E741  # a row a surface
    both = pool.join(cosine_of(pool).withColumnRenamed("score", "dense"), [*by, "doc_id"], "left").join(own.withColumnRenamed("score", "lexical"), [*by, "doc_id"], "left")
    both = both.join(d.select(*by, F.col("mean").alias("dm"), F.col("sd").alias("ds")), [*by], "left").join(l.select(*by, F.col("mean").alias("lm"), F.col("sd").alias("ls")), [*by], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    both = both.select(*by, "doc_id", zero("dense").alias("dense"), zero("lexical").alias("lexical"), z(zero("dense"), zero("dm"), zero("ds")).alias("zd"), z(zero("lexical"), zero("lm"), zero("ls")).alias("zl"))
    return written(both.withColumn("score", w_dense * F.col("zd") + w_lexical * F.col("zl")), "fused")


def weight_grid(pool: DataFrame, gold: DataFrame, weights: list[float], digits: int = 5) -> DataFrame:
    """w, query_id, rank: for each dense weight w (the lexical one is 1 - w) the place of a query's first gold text (query_id,
    doc_id) in its pool (query_id, doc_id, zd, zl) fused anew; null where the pool has none. The retrievers run once for the whole grid."""
    marked = pool.join(gold.select("query_id", "doc_id", F.lit(True).alias("_gold")), ["query_id", "doc_id"], "left")
    each = marked.withColumn("w", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    order = W.partitionBy("w", "query_id").orderBy(F.round(F.col("w") * F.col("zd") + (1 - F.col("w")) * F.col("zl"), digits).desc(), "doc_id")
    found = each.withColumn("rank", F.row_number().over(order)).where("_gold").groupBy("w", "query_id").agg(F.min("rank").alias("rank"))
    asked = gold.select("query_id").distinct().withColumn("w", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    return asked.join(found, ["w", "query_id"], "left")


def min_max(score: Column, by: str = "query_id") -> Column:
    w = W.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (score - low) / (high - low)).otherwise(0.0)


def reciprocal_ranks(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """query_id, doc_id, score from ranked lists (query_id, doc_id, rank from 1)."""
    out = lists[0].select("query_id", "doc_id", "rank")
    for df in lists[1:]:
        out = out.unionByName(df.select("query_id", "doc_id", "rank"))
    return out.groupBy("query_id", "doc_id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def best_surface(scores: DataFrame, first: str) -> DataFrame:
    """query_id, record, score, surface: the best of a record's surfaces, ties to `first`, then by name."""
    order = F.struct(F.round("score", 6).alias("score"), (F.col("surface") == first).alias("first"), F.col("surface"))
    low = F.struct((-F.round("score", 6)).alias("s"), (F.col("surface") != first).alias("f"), F.col("surface"))
    return scores.groupBy("query_id", "record").agg(F.max(order)["score"].alias("score"), F.min(low)["surface"].alias("surface"))


def kind_boost(scores: DataFrame, boost: float = BOOST) -> DataFrame:
    """Adds or takes `boost` times the spread of a query's pool, by whether kind is the wanted one (null: none is)."""
    w = W.partitionBy("query_id")
    spread = F.max("score").over(w) - F.min("score").over(w)
    spread = F.when(spread == 0, 1.0).otherwise(spread)
    return scores.withColumn("score", F.col("score") + F.when(F.col("wanted").isNull(), 0.0).when(F.col("kind") == F.col("wanted"), boost * spread).otherwise(-boost * spread))
