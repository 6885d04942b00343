"""From raw documents to packed sequences: language ID, quality, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the
columns of `documents`. run() writes each stage's rows into the shared folder and reads them again.

Defined results: null or empty texts and texts without a letter are rejected by the first stage; rows with a null doc_id
pass deduplication, as nothing links them; of rows that repeat a doc_id, one stays after deduplication; a document
that the mix takes several times comes out as several rows; empty tables pass through empty; extra columns pass through whatever their names. The mixing stage
meets rows of no doc_id, one source and one text under one key, dealt over salts when they are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import language, mixing, near_dedup, packing, quality
from quern.llm.common import ranked, written

#: Language ID rejects documents whose language is more likely wrong than right; the quality stage those that op7 predicts as 0.
LEAST_SURE = 0.5
#: Per cent. op4's 85 binds op4 alone; 26 bands of 5 rows miss a pair at 0.8 with probability (1 - 0.8 ** 5) ** 26 < 4e-5.
NEAR = 80


def _held(docs: DataFrame) -> Column:
    """A whole row as one column, beside which no other name can clash; select("row.*") gives it back."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language.judge(spark, language.fit(docs))(F.col("text"))
    rows = docs.select(_held(docs), found.alias("found"))
    return rows.where((F.col("found.lang_pred") != "und") & (F.col("found.score") >= LEAST_SURE)).select("row.*")


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(_held(docs), quality.judge(spark, model)(F.col("text")).alias("found"))
    return rows.where(F.col("found.predicted") == 1).select("row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(docs, NEAR)
    rows = docs.join(found.where(~F.col("kept")).select("doc_id").distinct().hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if again:
        rows = rows.where("doc_id is null").unionByName(rows.where("doc_id is not null").dropDuplicates(["doc_id"]))
    return rows


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keys = {"id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "hash": F.xxhash64("text"), "source_key": mixing.source_key()}
    times = mixing.mixed(docs).groupBy("doc_id", "text_hash", "key").agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("rows"))
    times = times.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text_hash").alias("hash"), F.col("key").alias("source_key"), "times", "rows")
    joined = docs.select(_held(docs), *[c.alias(k) for k, c in keys.items()]).join(times.hint("merge"), [*keys])
    if times.where("rows > 1").limit(1).count():
        joined = ranked(joined, [*keys], [*keys], "rows", "rank")
        joined = joined.withColumn("times", F.floor(F.col("times") / F.col("rows")) + (F.col("rank") < F.col("times") % F.col("rows")).cast("long"))
    return joined.where("times > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("language ID", by_language),
    ("quality classifier", by_quality),
    ("MinHash near-dedup", without_near_duplicates),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

#: SQL can't express the trained models and the sketches; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
