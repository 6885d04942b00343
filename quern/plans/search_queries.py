"""Queries over retrieval, fusion, deduplication and decisions, each with its SQL equivalent.

Benchmark passages are the search queries; a document's source stands for its kind (src0: ayah, others: hadith), its
language for a surface; vector vec_id belongs to the document of that id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.functions import vectors
from quern.operators import answers, blocks, decision, dedup, dense, fusion, index, lexical, search, tables
from quern.operators.sizes import if_small
from quern.plans.text_queries import word_list
from quern.sources.files import table
from quern.sources.scratch import shared_dir, written

POOL, FINAL = 120, 12  # shortlist of a query and finalists for the decision queries


def _queries(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _index(spark, d) -> index.Index:
    """The kept index of the documents, built by the first query that asks for it."""
    return index.kept(spark, f"{d}/documents.parquet", table(spark, d, "documents").select("doc_id", "text"))


def _scores(spark, d) -> DataFrame:
    return index.search(_index(spark, d), _queries(spark, d)).drop("surface")


def _lexical_top(spark, d, k) -> DataFrame:
    """The k best documents of each query, by rank."""
    return lexical.top(index.best(_index(spark, d), _queries(spark, d), k).drop("surface"), k)


#: tok: words of each document; bm: score of each query and document that share a term.
BM25 = f"""
tok AS (SELECT doc_id, {word_list('text')} AS w FROM documents),
dl AS (SELECT doc_id, len(w) AS dl FROM tok), nn AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM tok) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({word_list('text')}) AS term FROM benchmark),
bm AS (SELECT query_id, tf.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
       FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl ON dl.doc_id = tf.doc_id CROSS JOIN nn GROUP BY 1, 2)"""
#: de: cosine of each query's vector (vec_id = item_id) with all vectors.
DENSE = """
de AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score
       FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id CROSS JOIN embeddings c)"""


def _rank_sql(source: str, score: str = "score", alias: str = "rank") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 6) DESC, doc_id) AS {alias} FROM {source}"


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))


def _query_vectors(spark, d) -> DataFrame:
    return _vectors(spark, d).join(if_small(_queries(spark, d).select(F.col("query_id").alias("doc_id"))), "doc_id", "left_semi").withColumnRenamed("doc_id", "query_id")


def _dense_top(spark, d, k) -> DataFrame:
    """The k best vectors of each query, by rank."""
    return lexical.top(dense.cosine_scores(_query_vectors(spark, d), _vectors(spark, d), k), k)


def tf_df_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.term_statistics(table(spark, d, "documents")).withColumn("idf", F.round("idf", 6))


TF_DF_STATS = f"""
WITH tok AS (SELECT doc_id, {word_list('text')} AS w FROM documents), e AS (SELECT doc_id, unnest(w) AS term FROM tok), n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf, round(ln(1 + (any_value(n) - count(DISTINCT doc_id) + 0.5) / (count(DISTINCT doc_id) + 0.5)), 6) AS idf FROM e CROSS JOIN n GROUP BY term"""


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """One scan of the texts, without an index; index_topk asks the kept one."""
    scores = lexical.bm25(_queries(spark, d), table(spark, d, "documents").select("doc_id", "text"))
    return lexical.top(scores, 10).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def index_topk(spark: SparkSession, d: str) -> DataFrame:
    return _lexical_top(spark, d, 10).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


BM25_TOPK = f"WITH {BM25} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM ({_rank_sql('bm')}) WHERE rank <= 10"


INDEX_TOPK = BM25_TOPK


def bm25_zscore(spark: SparkSession, d: str) -> DataFrame:
    scores, sums = index.pool(_index(spark, d), _queries(spark, d), 10)
    m = fusion.moments(sums, table(spark, d, "documents").count())
    ranked = lexical.top(scores.drop("surface"), 10).join(m, "query_id")
    return ranked.select("query_id", "doc_id", "rank", F.round(fusion.z(F.col("score"), F.col("mean"), F.col("sd")), 5).alias("z"))


MOMENTS = """
bmm AS (SELECT query_id, sum(score) / any_value(n) AS lm, sqrt(greatest(0, sum(score * score) / any_value(n) - pow(sum(score) / any_value(n), 2))) AS ls FROM bm CROSS JOIN nn GROUP BY 1)"""
BM25_ZSCORE = f"WITH {BM25}, {MOMENTS} SELECT query_id, doc_id, rank, round((score - lm) / ls, 5) AS z FROM ({_rank_sql('bm')}) JOIN bmm USING (query_id) WHERE rank <= 10"


def _asked(spark, d) -> DataFrame:
    return _vectors(spark, d).where(F.col("doc_id") % 100 == 0).withColumnRenamed("doc_id", "query_id")


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Queries: every vector whose id is divisible by 100; candidates: all others."""
    scores = dense.cosine_scores(_asked(spark, d), _vectors(spark, d), 12).where("query_id <> doc_id")
    return lexical.top(scores, 10).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


_COS = """cs AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, c.label AS label, q.label AS q_label, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score
       FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)"""
COSINE_TOPK = f"WITH {_COS} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM ({_rank_sql('cs')}) WHERE rank <= 10"


def half_topk(spark: SparkSession, d: str) -> DataFrame:
    """As cosine_topk, from blocks of half precision; what may be among the best is scored again by the vectors themselves."""
    path = f"{shared_dir(spark)}/quern-blocks-{index.fingerprint(spark, f'{d}/embeddings.parquet')}"
    blocks.build(_vectors(spark, d), path)
    scores = blocks.topk(_asked(spark, d), blocks.opened(spark, path), _vectors(spark, d), 11).where("query_id <> doc_id")
    return lexical.top(scores, 10).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


HALF_TOPK = COSINE_TOPK


def cosine_label_precision(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    top = cosine_topk(spark, d).join(labels, "doc_id").join(labels.select(F.col("doc_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return top.groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("own")).alias("same"))


COSINE_LABEL_PRECISION = f"WITH {_COS} SELECT q_label AS own, count(*) AS n, count(*) FILTER (label = q_label) AS same FROM ({_rank_sql('cs')}) WHERE rank <= 10 GROUP BY 1"


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    """Norm of each label's mean vector, and the mean of the norms; sums a component at a time, so no group is gathered."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", "embedding", vectors.norm(F.col("embedding")).alias("norm"))
    each = rows.select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("m"))
    pooled = each.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("mean_norm"))
    own = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("norm").alias("norm"))
    return own.join(pooled, "label").select("label", "n", F.round("norm", 6).alias("norm"), F.round("mean_norm", 6).alias("mean_norm"))


VECTOR_NORMS = """
WITH e AS (SELECT label, vec_id, unnest(range(len(embedding))) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
     m AS (SELECT label, k, avg(x) AS m FROM e GROUP BY 1, 2), v AS (SELECT label, vec_id, sqrt(sum(x * x)) AS norm FROM e GROUP BY 1, 2)
SELECT label, n, round(norm, 6) AS norm, round(mean_norm, 6) AS mean_norm
FROM (SELECT label, count(*) AS n, avg(norm) AS norm FROM v GROUP BY 1) JOIN (SELECT label, sqrt(sum(m * m)) AS mean_norm FROM m GROUP BY 1) USING (label)"""


def _hybrid(spark, d) -> DataFrame:
    """Fusion over all documents; one without a vector has a dense score of 0."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return answers.hybrid_pool(_queries(spark, d), docs, _query_vectors(spark, d), _vectors(spark, d), index=_index(spark, d))


_FUSED = f"""{MOMENTS},
dmm AS (SELECT query_id, avg(score) AS dm, stddev_pop(score) AS ds FROM de GROUP BY 1),
pool AS (SELECT query_id, doc_id FROM ({_rank_sql('de')}) WHERE rank <= 400 UNION SELECT query_id, doc_id FROM ({_rank_sql('bm')}) WHERE rank <= 400),
fu AS (SELECT p.query_id, p.doc_id, coalesce(de.score, 0) AS dense, coalesce(bm.score, 0) AS lexical,
         CASE WHEN coalesce(ds, 0) > 0 THEN (coalesce(de.score, 0) - dm) / ds ELSE 0 END AS zd, CASE WHEN coalesce(ls, 0) > 0 THEN (coalesce(bm.score, 0) - lm) / ls ELSE 0 END AS zl
       FROM pool p LEFT JOIN de USING (query_id, doc_id) LEFT JOIN bm USING (query_id, doc_id) LEFT JOIN dmm ON dmm.query_id = p.query_id LEFT JOIN bmm ON bmm.query_id = p.query_id)"""


def fuse_zscore(spark: SparkSession, d: str) -> DataFrame:
    return lexical.top(_hybrid(spark, d), 10, digits=5).select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


FUSE_ZSCORE = f"""WITH {BM25}, {DENSE}, {_FUSED}, f AS (SELECT query_id, doc_id, 0.7 * zd + 0.3 * zl AS score FROM fu)
SELECT query_id, doc_id, rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, doc_id) AS rank FROM f) WHERE rank <= 10"""


def fuse_minmax(spark: SparkSession, d: str) -> DataFrame:
    pool = _hybrid(spark, d).select("query_id", "doc_id", fusion.min_max(F.col("dense")).alias("a"), fusion.min_max(F.col("lexical")).alias("b"))
    return lexical.top(pool.withColumn("score", 0.65 * F.col("a") + 0.35 * F.col("b")), 10).select("query_id", "doc_id", "rank", F.round("score", 5).alias("score"))


FUSE_MINMAX = f"""WITH {BM25}, {DENSE}, {_FUSED},
m AS (SELECT *, min(dense) OVER w AS d0, max(dense) OVER w AS d1, min(lexical) OVER w AS l0, max(lexical) OVER w AS l1 FROM fu WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, doc_id, 0.65 * CASE WHEN d1 > d0 THEN (dense - d0) / (d1 - d0) ELSE 0 END + 0.35 * CASE WHEN l1 > l0 THEN (lexical - l0) / (l1 - l0) ELSE 0 END AS score FROM m)
SELECT query_id, doc_id, rank, round(score, 5) AS score FROM ({_rank_sql('f')}) WHERE rank <= 10"""


def fuse_rrf(spark: SparkSession, d: str) -> DataFrame:
    lists = [_dense_top(spark, d, 400), _lexical_top(spark, d, 400)]
    return lexical.top(fusion.reciprocal_ranks(lists), 10, digits=9).select("query_id", "doc_id", "rank", F.round("score", 9).alias("score"))


FUSE_RRF = f"""WITH {BM25}, {DENSE},
r AS (SELECT query_id, doc_id, rank FROM ({_rank_sql('de')}) WHERE rank <= 400 UNION ALL SELECT query_id, doc_id, rank FROM ({_rank_sql('bm')}) WHERE rank <= 400),
f AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score FROM r GROUP BY 1, 2)
SELECT query_id, doc_id, rank, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f) WHERE rank <= 10"""


def _kind(source) -> F.Column:
    return F.when(source == "src0", "ayah").otherwise("hadith")


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """Weighted fusion, then the kind boost: even queries want an ayah, odd ones name no kind."""
    kinds = table(spark, d, "documents").select("doc_id", _kind(F.col("source")).alias("kind"))
    pool = _hybrid(spark, d).join(kinds, "doc_id", "left").withColumn("kind", F.coalesce("kind", F.lit("hadith"))).withColumn("wanted", F.when(F.col("query_id") % 2 == 0, "ayah"))
    return lexical.top(fusion.kind_boost(pool), 12, digits=5).select("query_id", "doc_id", "rank", "kind", F.round("score", 4).alias("score"))


HYBRID_TOPK = f"""WITH {BM25}, {DENSE}, {_FUSED},
f AS (SELECT query_id, fu.doc_id, CASE WHEN source = 'src0' THEN 'ayah' ELSE 'hadith' END AS kind, 0.7 * zd + 0.3 * zl AS s FROM fu LEFT JOIN documents USING (doc_id)),
b AS (SELECT *, max(s) OVER (PARTITION BY query_id) - min(s) OVER (PARTITION BY query_id) AS spread FROM f),
k AS (SELECT query_id, doc_id, kind, CASE WHEN query_id % 2 = 1 THEN s WHEN kind = 'ayah' THEN s + 0.1 * CASE WHEN spread = 0 THEN 1 ELSE spread END ELSE s - 0.1 * CASE WHEN spread = 0 THEN 1 ELSE spread END END AS score FROM b)
SELECT query_id, doc_id, rank, kind, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, doc_id) AS rank FROM k) WHERE rank <= 12"""


def surface_max(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "documents").select("doc_id", F.to_json(F.struct(F.col("source").alias("record"), F.col("lang").alias("surface"))).alias("label"))
    scores = index.best_by(_index(spark, d), _queries(spark, d), labels).withColumn("label", F.from_json("label", "record string, surface string"))
    return fusion.best_surface(scores.select("query_id", "label.record", "label.surface", "score"), "en")


SURFACE_MAX = f"""WITH {BM25}, s AS (SELECT query_id, source AS record, lang AS surface, round(max(score), 6) AS score FROM bm JOIN documents USING (doc_id) GROUP BY 1, 2, 3)
SELECT query_id, record, score, surface FROM (SELECT *, row_number() OVER (PARTITION BY query_id, record ORDER BY score DESC, surface <> 'en', surface) AS k FROM s) WHERE k = 1"""


#: Languages of the documents, in order; each is a surface, and four documents in a row stand for the forms of one record.
SURFACES = ("de", "en", "es", "fr")


def search_surfaces(spark: SparkSession, d: str) -> DataFrame:
    """The best records of each query over English and a language of its own, fused a surface at a time; then the kind boost."""
    own = F.element_at(F.array(*map(F.lit, SURFACES)), (F.col("query_id") % len(SURFACES) + 1).cast("int"))
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("surface"))
    kept = index.kept(spark, f"{d}/documents.parquet", docs, "surfaces-")
    with_surfaces = lambda df: df.withColumn("surfaces", F.array_distinct(F.array(F.lit("en"), own)))
    spoken = _vectors(spark, d).join(docs.select("doc_id", "surface"), "doc_id")
    records = docs.select("doc_id", (F.col("doc_id") - F.col("doc_id") % 4).alias("record"))
    best = answers.surface_pool(with_surfaces(_queries(spark, d)), kept, with_surfaces(_query_vectors(spark, d)), spoken, records, "en")
    pool = best.withColumns({"kind": F.when(F.col("record") % 12 == 0, "ayah").otherwise("hadith"), "wanted": F.when(F.col("query_id") % 3 == 0, "ayah")})
    return lexical.top(fusion.kind_boost(pool), 12, tie="record", digits=4).select("query_id", "record", "surface", "rank", F.round("score", 4).alias("score"))


SEARCH_SURFACES = f"""WITH tok AS (SELECT doc_id, lang, {word_list('text')} AS w FROM documents), nn AS (SELECT lang, count(*) AS n, avg(len(w)) AS avgdl FROM tok GROUP BY 1),
tf AS (SELECT doc_id, lang, dl, term, count(*) AS tf FROM (SELECT doc_id, lang, len(w) AS dl, unnest(w) AS term FROM tok) GROUP BY 1, 2, 3, 4), df AS (SELECT lang, term, count(*) AS df FROM tf GROUP BY 1, 2),
qs AS (SELECT DISTINCT item_id AS query_id, unnest(['en', {list(SURFACES)!r}[CAST(item_id % 4 AS BIGINT) + 1]]) AS lang FROM benchmark), qt AS (SELECT DISTINCT item_id AS query_id, unnest({word_list('text')}) AS term FROM benchmark),
bm AS (SELECT query_id, lang, tf.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
       FROM qt JOIN qs USING (query_id) JOIN tf USING (lang, term) JOIN df USING (lang, term) JOIN nn USING (lang) GROUP BY 1, 2, 3),
de AS (SELECT q.vec_id AS query_id, lang, c.vec_id AS doc_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score
       FROM embeddings q JOIN qs ON qs.query_id = q.vec_id JOIN documents d USING (lang) JOIN embeddings c ON c.vec_id = d.doc_id),
bmm AS (SELECT query_id, lang, sum(score) / any_value(n) AS lm, sqrt(greatest(0, sum(score * score) / any_value(n) - pow(sum(score) / any_value(n), 2))) AS ls FROM bm JOIN nn USING (lang) GROUP BY 1, 2),
dmm AS (SELECT query_id, lang, avg(score) AS dm, stddev_pop(score) AS ds FROM de GROUP BY 1, 2),
pool AS (SELECT query_id, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lang ORDER BY round(score, 6) DESC, doc_id) AS r FROM de) WHERE r <= 400
         UNION SELECT query_id, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lang ORDER BY round(score, 6) DESC, doc_id) AS r FROM bm) WHERE r <= 400),
fu AS (SELECT query_id, lang, doc_id, 0.7 * CASE WHEN coalesce(ds, 0) > 0 THEN (coalesce(de.score, 0) - dm) / ds ELSE 0 END + 0.3 * CASE WHEN coalesce(ls, 0) > 0 THEN (coalesce(bm.score, 0) - lm) / ls ELSE 0 END AS score
       FROM pool LEFT JOIN de USING (query_id, lang, doc_id) LEFT JOIN bm USING (query_id, lang, doc_id) LEFT JOIN dmm USING (query_id, lang) LEFT JOIN bmm USING (query_id, lang)),
be AS (SELECT query_id, doc_id - doc_id % 4 AS record, round(score, 6) AS s, lang AS surface, row_number() OVER (PARTITION BY query_id, doc_id - doc_id % 4 ORDER BY round(score, 6) DESC, lang <> 'en', lang) AS k FROM fu),
sp AS (SELECT *, max(s) OVER (PARTITION BY query_id) - min(s) OVER (PARTITION BY query_id) AS spread FROM be WHERE k = 1),
bo AS (SELECT query_id, record, surface, s + CASE WHEN query_id % 3 <> 0 THEN 0 WHEN record % 12 = 0 THEN 0.1 ELSE -0.1 END * CASE WHEN spread = 0 THEN 1 ELSE spread END AS score FROM sp)
SELECT query_id, record, surface, rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, record) AS rank FROM bo) WHERE rank <= 12"""


def _gold(spark, d) -> DataFrame:
    """query_id, doc_id: documents that hold a query's passage."""
    return lexical.containing(table(spark, d, "documents").select("doc_id", "text"), _queries(spark, d))


def hit_at_k_mrr(spark: SparkSession, d: str) -> DataFrame:
    ranked = _lexical_top(spark, d, 120).select("query_id", "doc_id", "rank")
    best = _gold(spark, d).join(ranked, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return tables.retrieval_metrics(best)


HIT_AT_K_MRR = f"""WITH {BM25}, r AS (SELECT query_id, doc_id, rank FROM ({_rank_sql('bm')}) WHERE rank <= 120),
g AS (SELECT item_id AS query_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)), b AS (SELECT g.query_id, min(rank) AS rank FROM g LEFT JOIN r USING (query_id, doc_id) GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (rank <= 1) AS hit_1, count(*) FILTER (rank <= 3) AS hit_3, count(*) FILTER (rank <= 5) AS hit_5, count(*) FILTER (rank <= 10) AS hit_10,
       count(*) FILTER (rank <= 120) AS hit_120, round(avg(coalesce(1.0 / rank, 0)), 9) AS mrr FROM b"""


GRID = [k / 10 for k in range(11)]


def fusion_grid(spark: SparkSession, d: str) -> DataFrame:
    """Hits and mean reciprocal rank of the documents that hold a passage, for each weight of the dense retriever."""
    ranks = fusion.weight_grid(_hybrid(spark, d), written(_gold(spark, d), "gold"), GRID)  # read twice, found once
    hits = [F.count_if(F.col("rank") <= k).alias(f"hit_{k}") for k in (1, 3, 10)]
    return ranks.groupBy("w").agg(F.count(F.lit(1)).alias("n"), *hits, F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


FUSION_GRID = f"""WITH {BM25}, {DENSE}, {_FUSED}, gold AS (SELECT item_id AS query_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)), g AS (SELECT k / 10.0::DOUBLE AS w FROM range(11) r(k)),
rk AS (SELECT w, query_id, doc_id, row_number() OVER (PARTITION BY w, query_id ORDER BY round(w * zd + (1 - w) * zl, 5) DESC, doc_id) AS rank FROM fu CROSS JOIN g),
be AS (SELECT w, query_id, min(rank) AS rank FROM (SELECT DISTINCT query_id, doc_id FROM gold) gold CROSS JOIN g LEFT JOIN rk USING (w, query_id, doc_id) GROUP BY 1, 2)
SELECT w, count(*) AS n, count(*) FILTER (rank <= 1) AS hit_1, count(*) FILTER (rank <= 3) AS hit_3, count(*) FILTER (rank <= 10) AS hit_10, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM be GROUP BY 1"""


def exact_dups_copies(spark: SparkSession, d: str) -> DataFrame:
    """Each text that has copies of its kind, with its class and how many there are."""
    docs = table(spark, d, "documents").withColumn("words", F.array_join(lexical.words(F.col("text")), " "))
    return dedup.exact_copies(docs, F.col("words"), _kind(F.col("source"))).where("n > 1")


EXACT_DUPS_COPIES = f"""WITH k AS (SELECT doc_id, source = 'src0' AS verse, array_to_string({word_list('text')}, ' ') AS k FROM documents)
SELECT * FROM (SELECT doc_id, min(doc_id) OVER w AS class_id, count(*) OVER w AS n FROM k WHERE k <> '' WINDOW w AS (PARTITION BY verse, k)) WHERE n > 1"""


def blank_copies(spark: SparkSession, d: str) -> DataFrame:
    """Texts without words are nobody's copies: the same operator on the documents' texts, every tenth of them blanked."""
    words = F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.array_join(lexical.words(F.col("text")), " "))
    out = dedup.exact_copies(table(spark, d, "documents").withColumn("words", words), F.col("words"))
    return out.groupBy("n").agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("doc_id") == F.col("class_id")).alias("classes"))


BLANK_COPIES = f"""WITH k AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE array_to_string({word_list('text')}, ' ') END AS k FROM documents),
c AS (SELECT doc_id, CASE WHEN k = '' THEN doc_id ELSE min(doc_id) OVER w END AS class_id, CASE WHEN k = '' THEN 1 ELSE count(*) OVER w END AS n FROM k WINDOW w AS (PARTITION BY k))
SELECT n, count(*) AS texts, count(*) FILTER (doc_id = class_id) AS classes FROM c GROUP BY 1"""


def _word_sets(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", lexical.words(F.col("text")).alias("tokens"))


def containment_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of classes of equal sets; containment_members has the members."""
    return dedup.containment_pairs(_word_sets(spark, d))


def containment_members(spark: SparkSession, d: str) -> DataFrame:
    return dedup.containment_classes(_word_sets(spark, d))


#: Classes of equal word sets: id, t, n; and the documents' sets: doc_id, t.
_SETS = f"st AS (SELECT doc_id, list_sort(list_distinct({word_list('text')})) AS t FROM documents), cl AS (SELECT min(doc_id) AS id, t, len(t) AS n FROM st WHERE len(t) >= 6 GROUP BY t)"
CONTAINMENT_PAIRS = f"""WITH {_SETS}, e AS (SELECT id, n, unnest(t) AS w FROM cl)
SELECT a.id AS x, b.id AS y, count(*) AS shared, CAST(least(any_value(a.n), any_value(b.n)) AS BIGINT) AS smaller FROM e a JOIN e b ON a.w = b.w AND a.id < b.id
GROUP BY 1, 2 HAVING count(*) >= 0.8 * least(any_value(a.n), any_value(b.n)) - 1e-9"""
CONTAINMENT_MEMBERS = f"WITH {_SETS} SELECT doc_id, id AS class_id FROM st JOIN cl USING (t)"


def gold_family(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a query's passage, and how many of the looser family (by containment) each has among them: members of
    its own class but itself, and of the classes linked with it."""
    gold = _gold(spark, d)
    ids = gold.select("doc_id").distinct()
    sets = _word_sets(spark, d).join(ids, "doc_id", "left_semi")
    classes = written(dedup.containment_classes(sets, dedup.FAMILY_TOKENS), "family")
    sizes = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = dedup.containment_pairs(sets, dedup.FAMILY_CONTAINED, dedup.FAMILY_TOKENS).select("x", "y")
    both = pairs.union(pairs.select("y", "x")).join(sizes.withColumnRenamed("class_id", "y"), "y").groupBy(F.col("x").alias("class_id")).agg(F.sum("n").alias("more"))
    family = classes.join(sizes, "class_id").join(both, "class_id", "left").select("doc_id", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("family"))
    return gold.join(family, "doc_id", "left").select("query_id", "doc_id", F.coalesce("family", F.lit(0)).alias("family"))


GOLD_FAMILY = f"""
WITH g AS (SELECT item_id AS query_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)), ids AS (SELECT DISTINCT doc_id FROM g),
     t AS (SELECT doc_id, list_distinct({word_list('text')}) AS t FROM documents JOIN ids USING (doc_id)), s AS (SELECT doc_id, t, len(t) AS n FROM t WHERE len(t) >= 5),
     p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.doc_id <> b.doc_id WHERE len(list_intersect(a.t, b.t)) >= 0.6 * least(a.n, b.n) - 1e-9)
SELECT query_id, doc_id, count(y) AS family FROM g LEFT JOIN p ON x = doc_id GROUP BY 1, 2"""


def _pool(spark, d, k=POOL) -> DataFrame:
    kinds = table(spark, d, "documents").select("doc_id", "source", _kind(F.col("source")).alias("kind"))
    top = _lexical_top(spark, d, k).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))
    return written(top.join(kinds, "doc_id"), "pool")  # read by each step of a decision, found once


_POOL_SQL = f"""{BM25}, pool AS (SELECT query_id, doc_id, rank, round(score, 6) AS score, source, CASE WHEN source = 'src0' THEN 'ayah' ELSE 'hadith' END AS kind
                 FROM ({_rank_sql('bm')}) JOIN documents USING (doc_id) WHERE rank <= {POOL})"""


def _wanted(spark, d) -> DataFrame:
    """query_id, wanted: what the passages ask for with a word of that kind behind some of them."""
    q = _queries(spark, d)
    words = F.concat(lexical.words(F.col("text")), _cue())
    return q.select("query_id", search.wanted_kind(words).alias("wanted"))


def _cue() -> F.Column:
    return F.when(F.col("query_id") % 4 == 0, F.array(F.lit("verse"))).when(F.col("query_id") % 4 == 1, F.array(F.lit("hadith"))).when(F.col("query_id") % 4 == 2, F.array(F.lit("verse"), F.lit("hadith"))).otherwise(F.array().cast("array<string>"))


_WANTED_SQL = "CASE query_id % 4 WHEN 0 THEN 'ayah' WHEN 1 THEN 'hadith' END"


def wanted_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The kind that a passage with cue words asks for, and the words that are left for the literal match."""
    words = F.concat(_cue(), F.when(F.col("query_id") % 5 == 0, F.array().cast("array<string>")).otherwise(lexical.words(F.col("text"))))
    rows = _queries(spark, d).withColumn("words", words)
    return rows.select("query_id", search.wanted_kind(F.col("words")).alias("wanted"), F.array_join(search.literal_words(F.col("words")), " ").alias("literal"))


WANTED_KINDS = f"""WITH q AS (SELECT item_id AS query_id, array_to_string({word_list('text')}, ' ') AS t FROM benchmark)
SELECT query_id, {_WANTED_SQL} AS wanted, CASE WHEN query_id % 5 = 0 THEN CASE query_id % 4 WHEN 0 THEN 'verse' WHEN 1 THEN 'hadith' WHEN 2 THEN 'verse hadith' ELSE '' END ELSE t END AS literal FROM q"""


def _texts(spark, d, found: DataFrame | None = None) -> DataFrame:
    """Texts with their words: of all documents, or of those that `found` has."""
    docs = table(spark, d, "documents")
    docs = docs if found is None else search.held(docs, found)
    words = lexical.words(F.col("text"))
    book = F.when(F.col("source") == "src1", 0).when(F.col("source") == "src2", 1).otherwise(2)
    return docs.select("doc_id", _kind(F.col("source")).alias("kind"), F.array_distinct(words).alias("tokens"), words.alias("shown"), book.alias("book"), F.col("doc_id").alias("number"))


def _ranked(spark, d) -> DataFrame:
    """The whole fused pool of each query by boosted rank, with kind and words."""
    fused = _hybrid(spark, d).select("query_id", "doc_id", "score")
    return search.ranked(fused, _texts(spark, d, fused), _wanted(spark, d))


#: fr: the same in SQL; pl: for each report those that it is a variant of; gc: the walk that collapses variants.
_RANKED_SQL = f"""{BM25}, {DENSE}, {_FUSED},
fk AS (SELECT query_id, doc_id, CASE WHEN source = 'src0' THEN 'ayah' ELSE 'hadith' END AS kind, {_WANTED_SQL} AS wanted, 0.7 * zd + 0.3 * zl AS s FROM fu JOIN documents USING (doc_id)),
fs AS (SELECT *, max(s) OVER (PARTITION BY query_id) - min(s) OVER (PARTITION BY query_id) AS spread FROM fk),
fb AS (SELECT query_id, doc_id, kind, wanted, s + CASE WHEN wanted IS NULL THEN 0 WHEN kind = wanted THEN 0.1 ELSE -0.1 END * CASE WHEN spread = 0 THEN 1 ELSE spread END AS score FROM fs),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, doc_id) AS rank FROM fb)"""
_WALK_SQL = f"""{_RANKED_SQL}, ts AS (SELECT doc_id, list_sort(list_distinct(w)) AS t, array_to_string(w, ' ') AS shown, len(w) AS nw FROM tok JOIN documents USING (doc_id) WHERE source <> 'src0'),
te AS (SELECT doc_id, len(t) AS n, unnest(t) AS w FROM ts WHERE len(t) >= 6),
rl AS (SELECT a.doc_id AS x, b.doc_id AS y FROM te a JOIN te b ON a.w = b.w AND a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING count(*) >= 0.8 * least(any_value(a.n), any_value(b.n))
       UNION SELECT a.doc_id, b.doc_id FROM ts a JOIN ts b ON a.t = b.t AND len(a.t) >= 2 AND a.doc_id <> b.doc_id UNION SELECT a.doc_id, b.doc_id FROM ts a JOIN ts b ON a.shown = b.shown AND a.nw >= 2 AND a.doc_id <> b.doc_id),
pl AS (SELECT x AS doc_id, list(y) AS partners FROM rl GROUP BY 1),
walk AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS kept, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS BIGINT) AS variant_of FROM fr UNION ALL
  SELECT query_id, step + 1, CASE WHEN twin IS NULL THEN list_append(kept, d) ELSE kept END, d, twin
  FROM (SELECT w.query_id, w.step, w.kept, fr.doc_id AS d, list_filter(w.kept, lambda x: list_contains(coalesce(pl.partners, []), x))[1] AS twin
        FROM walk w JOIN fr ON fr.query_id = w.query_id AND fr.rank = w.step + 1 LEFT JOIN pl ON pl.doc_id = fr.doc_id WHERE len(w.kept) < 24)),
gc AS (SELECT query_id, doc_id, CAST(list_position(kept, coalesce(variant_of, doc_id)) AS BIGINT) AS kept_rank, variant_of FROM walk WHERE step > 0)"""


def greedy_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Distinct texts of the whole fused pool."""
    return dedup.greedy_collapse(_ranked(spark, d).select("query_id", "rank", "doc_id", "kind", "tokens", "shown"), 24)


GREEDY_COLLAPSE = f"WITH RECURSIVE {_WALK_SQL} SELECT query_id, doc_id, kept_rank, variant_of FROM gc"


def _found(spark, d) -> DataFrame:
    fused = _hybrid(spark, d).select("query_id", "doc_id", "score")
    return search.shortlist(fused, _texts(spark, d, fused), _wanted(spark, d))


def search_full(spark: SparkSession, d: str) -> DataFrame:
    """A search from query to shortlist: fusion, boost of the wanted kind, collapse, both kinds, best copies."""
    return _found(spark, d).select("query_id", "place", "doc_id", "kind", F.round("score", 4).alias("score"), "reserve", F.array_join(F.transform("variants", lambda x: x.cast("string")), ",").alias("variants"))


def kind_quota(spark: SparkSession, d: str) -> DataFrame:
    """The quota alone, on the fused pool's first 24 as they come."""
    pool = _ranked(spark, d).select("query_id", "rank", "doc_id", "kind").withColumns({"place": F.when(F.col("rank") <= 24, F.col("rank")), "barred": F.lit(False)})
    return dedup.kind_quota(pool, 24, 12)


#: s2: the quota's texts by `pos`, from s0: query_id, doc_id, kind, rank, ins, bar, place.
_QUOTA_SQL = """c1 AS (SELECT query_id, greatest(0, 12 - count(*) FILTER (kind = 'ayah' AND ins)) AS short FROM s0 GROUP BY 1),
e1 AS (SELECT query_id, doc_id FROM (SELECT s0.*, short, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM s0 JOIN c1 USING (query_id) WHERE kind = 'ayah' AND NOT ins AND NOT bar) WHERE k <= short),
n1 AS (SELECT query_id, count(*) AS n FROM e1 GROUP BY 1),
o1 AS (SELECT query_id, doc_id FROM (SELECT s0.*, n, row_number() OVER (PARTITION BY query_id ORDER BY place DESC) AS k FROM s0 JOIN n1 USING (query_id) WHERE kind <> 'ayah' AND ins) WHERE k <= n),
s1 AS (SELECT s0.*, (ins AND o1.doc_id IS NULL) OR e1.doc_id IS NOT NULL AS in1, bar OR o1.doc_id IS NOT NULL AS gone, e1.doc_id IS NOT NULL AS res,
         CASE WHEN e1.doc_id IS NOT NULL THEN 1000000 + rank ELSE place END AS pos FROM s0 LEFT JOIN e1 USING (query_id, doc_id) LEFT JOIN o1 USING (query_id, doc_id)),
c2 AS (SELECT query_id, greatest(0, 12 - count(*) FILTER (kind = 'hadith' AND in1)) AS short FROM s1 GROUP BY 1),
e2 AS (SELECT query_id, doc_id FROM (SELECT s1.*, short, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM s1 JOIN c2 USING (query_id) WHERE kind = 'hadith' AND NOT in1 AND NOT gone) WHERE k <= short),
n2 AS (SELECT query_id, count(*) AS n FROM e2 GROUP BY 1),
o2 AS (SELECT query_id, doc_id FROM (SELECT s1.*, n, row_number() OVER (PARTITION BY query_id ORDER BY pos DESC) AS k FROM s1 JOIN n2 USING (query_id) WHERE kind <> 'hadith' AND in1) WHERE k <= n),
s2 AS (SELECT query_id, s1.doc_id, kind, CASE WHEN e2.doc_id IS NOT NULL THEN 2000000 + rank ELSE pos END AS pos, res OR e2.doc_id IS NOT NULL AS reserve
       FROM s1 LEFT JOIN e2 USING (query_id, doc_id) LEFT JOIN o2 USING (query_id, doc_id) WHERE (in1 AND o2.doc_id IS NULL) OR e2.doc_id IS NOT NULL)"""
_PLACED = "SELECT query_id, doc_id, kind, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS place, reserve FROM s2"
KIND_QUOTA = f"""WITH {_RANKED_SQL}, s0 AS (SELECT query_id, doc_id, kind, rank, rank <= 24 AS ins, false AS bar, rank AS place FROM fr), {_QUOTA_SQL}
SELECT * FROM ({_PLACED}) WHERE place <= 24"""
#: sf: the shortlist of a search.
_SEARCH_SQL = f"""{_WALK_SQL}, sw AS (SELECT fr.query_id, fr.doc_id, kind, rank, wanted, gc.doc_id IS NOT NULL AND variant_of IS NULL AS ins, variant_of IS NOT NULL AS bar, coalesce(kept_rank, rank) AS place
  FROM fr LEFT JOIN gc ON gc.query_id = fr.query_id AND gc.doc_id = fr.doc_id), s0 AS (SELECT * FROM sw WHERE wanted IS NULL), {_QUOTA_SQL},
li AS (SELECT query_id, doc_id, kind, place, false AS reserve FROM sw WHERE wanted IS NOT NULL AND ins UNION ALL SELECT * FROM ({_PLACED}) WHERE place <= 24),
cp AS (SELECT li.query_id, place, li.doc_id AS doc_id, false AS variant FROM li UNION ALL SELECT li.query_id, place, gc.doc_id, true FROM gc JOIN li ON li.query_id = gc.query_id AND li.doc_id = gc.variant_of),
bk AS (SELECT cp.*, CASE source WHEN 'src1' THEN 0 WHEN 'src2' THEN 1 ELSE 2 END AS book FROM cp JOIN documents USING (doc_id)),
bb AS (SELECT query_id, place, arg_min(doc_id, (book, doc_id)) AS best, min(book) AS best_book, max(CASE WHEN NOT variant THEN doc_id END) AS own, max(CASE WHEN NOT variant THEN book END) AS own_book,
         list_sort(coalesce(list(doc_id) FILTER (variant), [])) AS others FROM bk GROUP BY 1, 2),
sf AS (SELECT li.query_id, li.place, CASE WHEN best_book < own_book THEN best ELSE own END AS doc_id, li.kind, fr.score, reserve,
       array_to_string(CASE WHEN best_book < own_book THEN list_concat([own], list_filter(others, lambda x: x <> best)) ELSE others END, ',') AS variants
FROM li JOIN bb ON bb.query_id = li.query_id AND bb.place = li.place JOIN fr ON fr.query_id = li.query_id AND fr.doc_id = li.doc_id)"""
SEARCH_FULL = f"WITH RECURSIVE {_SEARCH_SQL} SELECT query_id, place, doc_id, kind, round(score, 4) AS score, reserve, variants FROM sf"


def best_copy_swap(spark: SparkSession, d: str) -> DataFrame:
    """Of each group of equal texts, the copy in the best source."""
    keyed = table(spark, d, "documents").select("doc_id", F.md5(F.array_join(lexical.words(F.col("text")), " ").cast("binary")).alias("k"), "source")
    place = F.when(F.col("source") == "src1", 0).when(F.col("source") == "src2", 1).otherwise(2)
    return dedup.best_copy(keyed, "k", place, F.regexp_extract("source", r"(\d+)", 1).cast("int")).select(F.col("k").alias("text_md5"), F.col("best"))


BEST_COPY_SWAP = f"""WITH k AS (SELECT doc_id, source, md5(array_to_string({word_list('text')}, ' ')) AS k FROM documents)
SELECT k AS text_md5, doc_id AS best FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE source WHEN 'src1' THEN 0 WHEN 'src2' THEN 1 ELSE 2 END, CAST(substr(source, 4) AS BIGINT), doc_id) AS r FROM k) WHERE r = 1"""

LOGIT, NONE = 1 / 10, 2.0  # the default judge: a tenth of the BM25 score against a constant for no match


def _judged(spark, d) -> DataFrame:
    return decision.choice(decision.groups(_pool(spark, d)), F.col("score") * LOGIT, NONE)


_JUDGED_SQL = f"""{_POOL_SQL}, gr AS (SELECT *, CAST(floor((rank - 1) / 12) AS BIGINT) AS group_id, 'c' || ((rank - 1) % 12) AS option FROM pool),
ju AS (SELECT *, exp(score * {LOGIT}) / (sum(exp(score * {LOGIT})) OVER g + exp({NONE})) AS p, exp({NONE}) / (sum(exp(score * {LOGIT})) OVER g + exp({NONE})) AS p_none FROM gr WINDOW g AS (PARTITION BY query_id, group_id)),
nt AS (SELECT *, row_number() OVER (PARTITION BY query_id, group_id ORDER BY round(p, 9) DESC, rank) AS nth, max(round(p, 9)) OVER (PARTITION BY query_id, group_id) >= round(p_none, 9) AS won FROM ju)"""


def group_chunks(spark: SparkSession, d: str) -> DataFrame:
    return decision.groups(_pool(spark, d)).select("query_id", "doc_id", F.col("group_id").cast("long").alias("group_id"), "option")


GROUP_CHUNKS = f"WITH {_JUDGED_SQL} SELECT query_id, doc_id, group_id, option FROM gr"


def group_argmax(spark: SparkSession, d: str) -> DataFrame:
    return decision.winners(_judged(spark, d)).select("query_id", F.col("group_id").cast("long").alias("group_id"), "doc_id", F.round("p", 6).alias("p"))


GROUP_ARGMAX = f"WITH {_JUDGED_SQL} SELECT query_id, group_id, doc_id, round(p, 6) AS p FROM nt WHERE nth = 1 AND round(p, 9) >= round(p_none, 9)"


def runner_up(spark: SparkSession, d: str) -> DataFrame:
    return decision.winners(_judged(spark, d), runner_up=0.1).select("query_id", F.col("group_id").cast("long").alias("group_id"), "nth", "doc_id")


RUNNER_UP = f"WITH {_JUDGED_SQL} SELECT query_id, group_id, nth, doc_id FROM nt WHERE won AND (nth = 1 OR (nth = 2 AND p >= 0.1))"


def finalists(spark: SparkSession, d: str) -> DataFrame:
    return decision.finalists(decision.winners(_judged(spark, d), runner_up=0.05), FINAL).select("query_id", "doc_id", "final_rank")


_FINAL_SQL = f"""{_JUDGED_SQL}, wi AS (SELECT * FROM nt WHERE won AND (nth = 1 OR (nth = 2 AND p >= 0.05))),
fi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(p, 9) DESC, rank) AS final_rank FROM wi) WHERE final_rank <= {FINAL})"""
FINALISTS = f"WITH {_FINAL_SQL} SELECT query_id, doc_id, final_rank FROM fi"


def family_sum(spark: SparkSession, d: str) -> DataFrame:
    """Final choice among the finalists with its report's probability, its copies' words being mostly the same, and its band."""
    last = decision.finalists(decision.winners(_judged(spark, d), runner_up=0.05), FINAL)
    last = written(decision.choice(last.select("query_id", "doc_id", "rank", "score", "kind"), F.col("score") * LOGIT, NONE, ("query_id",)), "finalists")
    final = last.join(_texts(spark, d, last).select("doc_id", "tokens"), "doc_id").withColumns({"wanted": F.lit(None).cast("string"), "quote_ok": F.lit(None).cast("boolean")})
    return search.picked(final).select("query_id", "doc_id", F.round("p_report", 6).alias("p_family"), "verdict")


FAMILY_SUM = f"""WITH {_FINAL_SQL}, ch AS (SELECT query_id, doc_id, rank, kind, exp(score * {LOGIT}) / (sum(exp(score * {LOGIT})) OVER q + exp({NONE})) AS p, exp({NONE}) / (sum(exp(score * {LOGIT})) OVER q + exp({NONE})) AS pn FROM fi WINDOW q AS (PARTITION BY query_id)),
on1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(p, 9) DESC, rank) AS k FROM ch) WHERE k = 1 AND round(p, 9) >= round(pn, 9)),
tk AS (SELECT doc_id, list_sort(list_distinct(w)) AS t FROM tok WHERE doc_id IN (SELECT doc_id FROM ch)),
fam AS (SELECT a.doc_id AS x, b.doc_id AS y FROM tk a JOIN tk b ON a.doc_id <> b.doc_id WHERE (least(len(a.t), len(b.t)) >= 5 AND len(list_intersect(a.t, b.t)) >= CAST(0.6 AS DOUBLE) * least(len(a.t), len(b.t))) OR (len(a.t) >= 2 AND a.t = b.t)),
su AS (SELECT on1.query_id, on1.doc_id, on1.p + coalesce((SELECT sum(ch.p) FROM ch JOIN fam ON fam.y = ch.doc_id AND fam.x = on1.doc_id WHERE ch.query_id = on1.query_id AND ch.kind = 'hadith' AND on1.kind = 'hadith'), 0) AS pf FROM on1)
SELECT query_id, doc_id, round(pf, 6) AS p_family, CASE WHEN round(pf, 9) >= 0.7 THEN 'confident' WHEN round(pf, 9) >= 0.45 THEN 'tentative' ELSE 'unsure' END AS verdict FROM su"""


def topic_list(spark: SparkSession, d: str) -> DataFrame:
    """Relevance: a candidate's score over its query's best; severity from its labels."""
    w = W.partitionBy("query_id")
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    severity = F.when(F.col("kind") == "ayah", "quran").when(F.col("toxic") == 1, "mawdu").when(F.col("quality") == 0, "daif").when(F.col("quality") == 1, "sahih").otherwise("unknown")
    pool = _pool(spark, d).join(labels, "doc_id", "left").withColumn("severity", severity).withColumn("relevance", F.col("score") / F.max("score").over(w))
    return decision.listed(pool).select("query_id", "doc_id", "place", "severity", F.round("relevance", 6).alias("relevance"))


TOPIC_LIST = f"""WITH {_POOL_SQL}, l AS (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY 1),
s AS (SELECT query_id, p.doc_id, CASE WHEN kind = 'ayah' THEN 'quran' WHEN toxic = 1 THEN 'mawdu' WHEN quality = 0 THEN 'daif' WHEN quality = 1 THEN 'sahih' ELSE 'unknown' END AS severity,
        score / max(score) OVER (PARTITION BY query_id) AS relevance FROM pool p LEFT JOIN l USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE severity WHEN 'quran' THEN 0 WHEN 'sahih' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END, round(relevance, 9) DESC, doc_id) AS place FROM s WHERE relevance >= 0.75)
SELECT query_id, doc_id, place, severity, round(relevance, 6) AS relevance FROM r WHERE place <= 8"""


def _chance(key, salt: str) -> F.Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string")).cast("binary")), 1, 6), 16, 10).cast("long") / 16777215.0


def _chance_sql(key: str, salt: str) -> str:
    return f"CAST(('0x' || left(md5('{salt}' || CAST({key} AS VARCHAR)), 6)) AS BIGINT) / 16777215.0"


_ROUTED = ("p_general", "p_personal", "p_question", "p_judge", "p_islamic", "p_specific", "p_saying", "pick_p")
_FLAGS = ("names_kind", "starts_as_question", "is_question_form", "has_ruling_word", "pick_passes")


def router(spark: SparkSession, d: str) -> DataFrame:
    """Decision table over class probabilities drawn from a hash of each conversation turn."""
    key = F.concat_ws(":", "conv_id", "turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", key.alias("k"))
    columns = {n: _chance(F.col("k"), n) * (0.5 if n in ("p_general", "p_personal") else 1.0) for n in _ROUTED} | {n: _chance(F.col("k"), n) < 0.4 for n in _FLAGS}
    columns |= {"n_finalists": F.floor(_chance(F.col("k"), "nf") * 3), "n_relevant": F.floor(_chance(F.col("k"), "nr") * 3)}
    return decision.route(rows.withColumns(columns)).select("conv_id", "turn", "verdict")


def _router_sql() -> str:
    columns = [f"{_chance_sql('k', n)} * {0.5 if n in ('p_general', 'p_personal') else 1.0} AS {n}" for n in _ROUTED]
    columns += [f"{_chance_sql('k', n)} < 0.4 AS {n}" for n in _FLAGS] + [f"floor({_chance_sql('k', 'nf')} * 3) AS n_finalists", f"floor({_chance_sql('k', 'nr')} * 3) AS n_relevant"]
    band = "CASE WHEN pick_p >= 0.7 THEN 'confident' WHEN pick_p >= 0.45 THEN 'tentative' ELSE 'unsure' END"
    return f"""WITH c AS (SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS k FROM conversations), v AS (SELECT *, {', '.join(columns)} FROM c),
q AS (SELECT *, p_general + p_personal AS r, CASE WHEN is_question_form AND p_islamic >= 0.5 THEN p_question ELSE 0 END AS qn, NOT (names_kind AND NOT starts_as_question) OR has_ruling_word AS early,
        p_specific < 0.35 AND p_saying < 0.6 AS pool FROM v), h AS (SELECT *, r + qn + p_judge >= 0.75 AS held FROM q)
SELECT conv_id, turn, CASE
  WHEN early AND NOT has_ruling_word AND (p_judge >= 0.5 OR (held AND p_judge >= greatest(r, qn))) THEN 'out_of_scope'
  WHEN early AND held AND qn > r AND NOT has_ruling_word THEN 'question'
  WHEN early AND held AND r > 0 THEN CASE WHEN p_personal >= p_general THEN 'ruling_personal' ELSE 'ruling_general' END
  WHEN n_finalists = 0 AND NOT pool THEN 'no_match'
  WHEN pick_passes AND (NOT pool OR pick_p >= 0.9) THEN {band}
  WHEN pool AND n_relevant > 0 THEN 'topic' WHEN pick_passes THEN {band} ELSE 'no_match' END AS verdict FROM h"""


def verdict_bands(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("query_id")
    best = _judged(spark, d).where("group_id = 0").withColumn("top", F.max("p").over(w)).where("p = top").groupBy("query_id").agg(F.max("p").alias("p"))
    return best.select(decision.band(F.round(F.col("p") * 3, 9)).alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


VERDICT_BANDS = f"""WITH {_JUDGED_SQL}, b AS (SELECT query_id, max(p) AS p FROM ju WHERE group_id = 0 GROUP BY 1)
SELECT CASE WHEN round(p * 3, 9) >= 0.7 THEN 'confident' WHEN round(p * 3, 9) >= 0.45 THEN 'tentative' ELSE 'unsure' END AS verdict, count(*) AS n FROM b GROUP BY 1"""


def _knocked_out(spark, d) -> tuple[DataFrame, DataFrame]:
    """What is left of all distinct texts in a seeded order, after groups of 20 and on until at most 12 a query are left; and who won
    a group of the first round."""
    docs = table(spark, d, "documents").withColumn("words", F.array_join(lexical.words(F.col("text")), " "))
    one = dedup.exact_copies(docs, F.col("words"), _kind(F.col("source"))).where("doc_id = class_id").join(docs.where("words <> ''").select("doc_id"), "doc_id", "left_semi")
    order = F.md5(F.concat(F.lit("450"), F.col("doc_id").cast("string")).cast("binary"))
    places = written(tables.numbered(one.select("doc_id"), [order, F.col("doc_id")]), "places")
    texts = places.count()
    found = index.likeliest(_index(spark, d), _queries(spark, d), index.Groups(places, texts, 20, LOGIT, NONE, decision.RUNNER_UP))
    judged = found.withColumn("score", F.round("score", 6))
    rounds: list[DataFrame] = []

    def cut(df: DataFrame) -> DataFrame:
        rounds.append(written(df, "knockout"))
        return rounds[-1]

    out = decision.knockout(judged, texts, F.col("score") * LOGIT, cut, no_match=NONE)
    return out, rounds[0]


def knockout_rounds(spark: SparkSession, d: str) -> DataFrame:
    return _knocked_out(spark, d)[0].select("query_id", "doc_id", "round", F.round("p", 6).alias("p"))


def _knockout_sql(rounds: int = 6) -> str:
    """CTEs: a1 has the winners of the first round, a6 who is left."""
    share = "exp(score * {l}) / (sum(exp(score * {l})) OVER g{more} + exp({n})) AS p, exp({n}) / (sum(exp(score * {l})) OVER g{more} + exp({n})) AS p_none"
    # groups' sums have an order of their own; rounding hides it
    fill = share.format(l=LOGIT, n=NONE, more=" + least(20, texts - 20 * group_id) - count(*) OVER g")
    later = share.format(l=LOGIT, n=NONE, more="")
    sql = f"""WITH {BM25}, dt AS (SELECT doc_id, source = 'src0' AS verse, array_to_string({word_list('text')}, ' ') AS k FROM documents),
un AS (SELECT min(doc_id) AS doc_id FROM dt WHERE k <> '' GROUP BY verse, k), pc AS (SELECT doc_id, row_number() OVER (ORDER BY md5('450' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS place, count(*) OVER () AS texts FROM un),
j1 AS (SELECT query_id, doc_id, place, texts, round(score, 6) AS score, CAST(floor(place / 20) AS BIGINT) AS group_id FROM bm JOIN pc USING (doc_id)),
c1 AS (SELECT *, {fill} FROM j1 WINDOW g AS (PARTITION BY query_id, group_id)),
n1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, group_id ORDER BY round(p, 9) DESC, place) AS nth, max(round(p, 9)) OVER (PARTITION BY query_id, group_id) >= round(p_none, 9) AS won FROM c1),
a1 AS (SELECT query_id, doc_id, place, score, p, CAST(1 AS BIGINT) AS round FROM n1 WHERE won AND (nth = 1 OR (nth = 2 AND p >= 0.25)))"""
    for k in range(2, rounds + 1):
        sql += f""",
b{k} AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS alive, CAST(floor((row_number() OVER (PARTITION BY query_id ORDER BY round(p, 9) DESC, place) - 1) / 12) AS BIGINT) AS group_id FROM a{k - 1}),
m{k} AS (SELECT * EXCLUDE (p) FROM b{k} WHERE alive > 12 AND round = {k - 1}),
c{k} AS (SELECT *, {later} FROM m{k} WINDOW g AS (PARTITION BY query_id, group_id)),
n{k} AS (SELECT *, row_number() OVER (PARTITION BY query_id, group_id ORDER BY round(p, 9) DESC, place) AS nth, max(round(p, 9)) OVER (PARTITION BY query_id, group_id) >= round(p_none, 9) AS won FROM c{k}),
w{k} AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS stay, row_number() OVER (PARTITION BY query_id ORDER BY round(p, 9) DESC, place) AS k FROM n{k} WHERE won AND (nth = 1 OR (nth = 2 AND p >= 0.25))),
a{k} AS (SELECT query_id, doc_id, place, score, p, round FROM b{k} WHERE alive <= 12 OR round < {k - 1} UNION ALL SELECT query_id, doc_id, place, score, p, CAST({k} AS BIGINT) FROM w{k} WHERE stay < alive OR k <= 12)"""
    return sql


def quote_containment(spark: SparkSession, d: str) -> DataFrame:
    """Whether a passage's words are in its best document, which of them are missing, and where."""
    top = written(_lexical_top(spark, d, 1).select("query_id", "doc_id"), "first")
    q = _queries(spark, d).select("query_id", lexical.words(F.col("text")).alias("qw"))
    t = search.held(table(spark, d, "documents"), top).select("doc_id", F.array_distinct(lexical.words(F.col("text"))).alias("tw"))
    rows = top.join(q, "query_id").join(t, "doc_id")
    missing = decision.missing_positions(F.col("qw"), F.col("tw"))
    return rows.select("query_id", "doc_id", decision.quote_contained(F.col("qw"), F.col("tw")).alias("contained"), F.array_join(F.transform(missing, lambda i: i.cast("string")), ",").alias("missing"))


QUOTE_CONTAINMENT = f"""WITH {BM25}, t1 AS (SELECT query_id, doc_id FROM ({_rank_sql('bm')}) WHERE rank = 1),
x AS (SELECT query_id, t1.doc_id, {word_list('b.text')} AS qw, tok.w AS tw FROM t1 JOIN benchmark b ON item_id = query_id JOIN tok ON tok.doc_id = t1.doc_id),
y AS (SELECT *, list_filter(range(len(qw)), lambda i: NOT list_contains(tw, qw[i + 1])) AS m FROM x)
SELECT query_id, doc_id, CASE WHEN len(qw) = 0 THEN true WHEN len(qw) <= 2 THEN len(m) = 0 ELSE (len(qw) - len(m)) / len(qw) >= 0.5 END AS contained, array_to_string(m, ',') AS missing FROM y"""

_PLAIN = (
    tf_df_stats, bm25_topk, index_topk, bm25_zscore, cosine_topk, half_topk, cosine_label_precision, vector_norms, fuse_zscore, fuse_minmax, fuse_rrf, hybrid_topk, surface_max, search_surfaces, hit_at_k_mrr, fusion_grid,
    exact_dups_copies, blank_copies, containment_pairs, containment_members, gold_family, kind_quota, best_copy_swap, group_chunks, group_argmax, runner_up, finalists, family_sum, topic_list, verdict_bands,
    quote_containment, wanted_kinds, greedy_collapse, search_full,
)
QUERIES = {f.__name__: f for f in (*_PLAIN, router, knockout_rounds)}
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in _PLAIN} | {"router": _router_sql(), "knockout_rounds": _knockout_sql() + " SELECT query_id, doc_id, round, round(p, 6) AS p FROM a6"}
