"""Steps of searches that must not grow with what they don't need."""

from pyspark.sql import functions as F

from quern.operators import dedup, lexical
from quern.plans import search_queries as sq
from quern.sources import display

SMALL = "/root/testdata/sf0.001"


def test_words_are_made_of_the_found_texts_alone(spark):
    found = spark.range(0, 50, 7).withColumnRenamed("id", "doc_id")
    texts = sq._texts(spark, SMALL, found).select("doc_id", "tokens")
    assert {r["doc_id"] for r in texts.collect()} == set(range(0, 50, 7))
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_replace") < plan.index("LeftSemi")  # the plan's root comes first


def test_collapse_of_hashes_is_that_of_words(spark):
    rows = [(1, 1, 10, "hadith", list("abcdefgh"), list("abcdefgh")), (1, 2, 11, "hadith", list("abcdefgx"), list("abcdefgx")), (1, 3, 12, "ayah", list("abcdefgh"), list("abcdefgh")),
            (1, 4, 13, "hadith", ["q"], ["q", "q"]), (1, 5, 14, "hadith", ["q"], ["q", "q"]), (1, 6, 15, "hadith", [], [])]
    pool = spark.createDataFrame(rows, "query_id long, rank int, doc_id long, kind string, tokens array<string>, shown array<string>")
    sent = pool.select("query_id", "rank", "doc_id", "kind").join(dedup.compared(pool.select("doc_id", "tokens", "shown")), "doc_id")
    told = lambda df: sorted((r["doc_id"], r["kept_rank"], r["variant_of"]) for r in dedup.greedy_collapse(df, 10).collect())
    assert told(sent) == told(pool) == [(10, 1, None), (11, 1, 10), (12, 2, None), (13, 3, None), (14, 3, 13), (15, 4, None)]


def test_passages_are_sought_where_their_runs_begin(spark, monkeypatch):
    texts = ["x aa bbbb cc dd ee y", "bbbb cc", "aa bbbb cc dd", "q aa bbbb cc ddd", "", None, "aa  bbbb cc dd ee", "zz bbbb cc dd ee bbbb cc dd", "a\nb c d e"]
    passages = ["aa bbbb cc dd", "cc", "x aa", "bbbb cc dd ee", "aa  bbbb cc", "", "e", "b c d", None, "q aa bbbb cc dd"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(passages)), "query_id long, text string")
    told = lambda df: sorted((r["query_id"], r["doc_id"]) for r in df.collect())
    want = sorted((q, d) for q, p in enumerate(passages) for d, t in enumerate(texts) if p is not None and t is not None and p in t)
    found = lexical.containing(docs, asked)
    assert told(found) == want
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()  # reading it again doesn't search again
    monkeypatch.setattr(lexical, "FEW_FIRST", 0)
    assert told(lexical.containing(docs, asked)) == want


def test_display_store_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("a"))
    display.store(rows, f"{tmp_path}/d", "doc_id")
    files = {r[0]: r[1] for r in spark.read.parquet(f"{tmp_path}/d").groupBy(F.input_file_name()).count().collect()}
    assert len(files) >= 4 and max(files.values()) < 40_000 and sum(files.values()) == 100_000
