"""Kept index, versioned tables, half-precision blocks, display store, judge, streams: small cases against what must come out."""

import json
import os
import subprocess
import sys
import uuid
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import blocks, dense, fusion, index, judge, lexical, tables
from quern.sources import display, versions
from quern.streaming import events as ev

ROOT = Path(__file__).resolve().parent.parent
DOCS = [(1, "the cat sat on the mat", "en"), (2, "a dog sat", "en"), (3, "le chat est sur la table", "fr"), (4, "", "en"), (5, None, "fr"), (6, "cat cat dog", None), (7, "the the the", "en")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scores(df, *keys):
    return {tuple(r[k] for k in keys): round(r["score"], 9) for r in df.collect()}


# kept index


def test_index_gives_the_scores_of_a_scan_without_opening_the_texts(spark, tmp_path):
    source = f"{tmp_path}/docs.parquet"
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string").write.parquet(source)
    docs = spark.read.parquet(source).select("doc_id", "text")
    asked = spark.createDataFrame([(1, "Cat sat?"), (2, "unknown"), (3, ""), (4, None), (5, "the dog the")], "query_id long, text string")
    made = index.build(docs, f"{tmp_path}/index")
    found = index.search(made, asked)
    assert scores(found, "query_id", "doc_id") == scores(lexical.bm25(asked, docs), "query_id", "doc_id") and {r["surface"] for r in found.collect()} == {"all"}
    read = plan(index.search(made, asked.where("query_id = 1")))
    assert "docs.parquet" not in read and "bucket" in read.split("PartitionFilters: [")[1].split("]")[0] and "PushedFilters: [IsNotNull(term)" in read or "In(term" in read
    assert index.opened(spark, made.path) == made
    with pytest.raises(FileExistsError):
        index.build(docs, made.path)


def test_index_prunes_to_the_buckets_of_the_terms(spark, tmp_path):
    rows = [(k, " ".join(f"w{k * 7 + j}" for j in range(30))) for k in range(200)]
    made = index.build(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/index")
    one = index.search(made, spark.createDataFrame([(1, "w70")], "query_id long, text string"))
    files = {r[0] for r in made.table("postings").select(F.input_file_name()).distinct().collect()}
    bucket = index.asked(made, spark.createDataFrame([(1, "w70")], "query_id long, text string")).first()["bucket"]
    read = {f for f in files if f"bucket={bucket}/" in f}
    assert len(files) >= 8 and len(read) == 1 and one.count() == sum("w70" in t.split() for _, t in rows)


def test_index_deals_a_hot_term_over_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "PER_FILE", 100)
    rows = [(k, "hot") for k in range(1000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join what is so small
    made = index.build(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/index")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert made.table("postings").select(F.input_file_name()).distinct().count() >= 3
    assert index.search(made, spark.createDataFrame([(1, "hot")], "query_id long, text string")).count() == 1000


def test_kept_index_follows_its_files(spark, tmp_path):
    source = f"{tmp_path}/docs.parquet"
    docs = lambda: spark.read.parquet(source).select("doc_id", "text")
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string").write.parquet(source)
    first = index.kept(spark, source, docs())
    assert index.kept(spark, source, docs()).path == first.path
    spark.createDataFrame([(9, "new cat", "en")], "doc_id long, text string, lang string").write.mode("append").parquet(source)
    second = index.kept(spark, source, docs())
    asked = spark.createDataFrame([(1, "cat")], "query_id long, text string")
    assert second.path != first.path and {r["doc_id"] for r in index.search(second, asked).collect()} == {1, 6, 9}


def test_empty_index(spark, tmp_path):
    made = index.build(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/index")
    assert index.search(made, spark.createDataFrame([(1, "cat")], "query_id long, text string")).count() == 0


def test_surfaces_are_corpora_of_their_own(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, surface string")
    made = index.build(docs, f"{tmp_path}/index")
    asked = spark.createDataFrame([(1, "the cat", ["en"]), (2, "chat cat", ["en", "fr"]), (3, "cat", ["xx"])], "query_id long, text string, surfaces array<string>")
    got = scores(index.search(made, asked), "query_id", "surface", "doc_id")
    for surface in ("en", "fr"):
        own = docs.where(F.col("surface") == surface).select("doc_id", "text")
        want = scores(lexical.bm25(asked.where(F.array_contains("surfaces", surface)).select("query_id", "text"), own), "query_id", "doc_id")
        assert {(q, d): s for (q, f, d), s in got.items() if f == surface} == want
    assert {f for _, f, _ in got} == {"en", "fr"}  # a null surface isn't searched


# dense


def test_dense_emits_k_rows_a_query_and_task(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((3000, 8))
    v[100:1100] = v[100]  # one vector a thousand times
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    vectors = spark.createDataFrame(rows, "doc_id long, v array<double>").coalesce(2)
    asked = spark.createDataFrame([(q, v[q * 50].tolist()) for q in range(20)], "query_id long, v array<double>")
    found = dense._found(asked, vectors, 5)
    assert found.where("doc_id is not null").count() <= 2 * 20 * 5
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {}
    for q in range(20):
        s = unit @ unit[q * 50]
        for d in sorted(range(3000), key=lambda d: (-round(s[d], 6), d))[:5]:
            want[q, d] = round(s[d], 6)
    got = {(r["query_id"], r["doc_id"]): round(r["score"], 6) for r in lexical.top(dense.cosine_scores(asked, vectors, 5), 5).collect()}
    assert got == want
    sums = {r["query_id"]: (r["s"], r["ss"], r["n"]) for r in dense.cosine_pool(asked, vectors, 5)[1].collect()}
    assert all(sums[q] == pytest.approx((float((unit @ unit[q * 50]).sum()), float(((unit @ unit[q * 50]) ** 2).sum()), 3000)) for q in range(20))


def test_weight_grid(spark):
    pool = spark.createDataFrame([(1, 1, 3.0, 0.0), (1, 2, 0.0, 3.0), (1, 3, 2.0, 2.0), (2, 1, 1.0, 1.0)], "query_id long, doc_id long, zd double, zl double")
    gold = spark.createDataFrame([(1, 2), (2, 9)], "query_id long, doc_id long")
    got = {(r["w"], r["query_id"]): r["rank"] for r in fusion.weight_grid(pool, gold, [0.0, 0.5, 1.0]).collect()}
    assert got == {(0.0, 1): 1, (0.5, 1): 3, (1.0, 1): 3, (0.0, 2): None, (0.5, 2): None, (1.0, 2): None}


# half precision


def vectors_of(spark, n=300, width=16, seed=2):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, width))
    v[40:60] = v[40]
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(1000, None), (1001, [float("nan")] * width), (1002, [0.0] * width)]
    return spark.createDataFrame(rows, "doc_id long, v array<double>")


def test_blocks_find_the_exact_best(spark, tmp_path):
    vectors = vectors_of(spark)
    blocks.build(vectors, f"{tmp_path}/b", chunks=4, block=32)
    stored = blocks.opened(spark, f"{tmp_path}/b")
    assert stored.agg(F.sum("n")).first()[0] == 301 and stored.where("n > 32").count() == 0
    assert 0 < blocks.rounding(stored) < 2e-3
    asked = vectors.where("doc_id % 30 = 0 and doc_id < 300").withColumnRenamed("doc_id", "query_id")
    good = vectors.where("v is not null and doc_id <> 1001")
    want = scores(lexical.top(dense.cosine_scores(asked, good), 7), "query_id", "doc_id")
    got = scores(lexical.top(blocks.topk(asked, stored, good, 7), 7), "query_id", "doc_id")
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_blocks_in_lots_of_queries(spark, tmp_path, monkeypatch):
    vectors = vectors_of(spark, 60)
    blocks.build(vectors, f"{tmp_path}/b", chunks=2)
    asked = vectors.where("doc_id < 20").withColumnRenamed("doc_id", "query_id")
    whole = {tuple(r)[:2] for r in blocks.candidates(asked, blocks.opened(spark, f"{tmp_path}/b"), 3).collect()}
    monkeypatch.setattr(blocks, "MOST_QUERIES", 8)
    assert {tuple(r)[:2] for r in blocks.candidates(asked, blocks.opened(spark, f"{tmp_path}/b"), 3).collect()} == whole


def test_a_stopped_build_goes_on(spark, tmp_path, monkeypatch):
    vectors, path, calls = vectors_of(spark), f"{tmp_path}/b", []

    def build(**k):
        blocks.build(vectors, path, chunks=6, block=16, at_once=2, **k)

    class Killed(Exception):
        pass

    def number():
        calls.append(1)
        if len(calls) == 2:
            raise Killed
        return uuid.UUID(int=len(calls))

    monkeypatch.setattr(blocks.uuid, "uuid4", number)
    with pytest.raises(Killed):  # in its second job
        build()
    monkeypatch.undo()
    assert blocks.missing(spark, path, 6) == [2, 3, 4, 5]
    before = {p: p.stat().st_mtime_ns for p in Path(path).rglob("chunk=[01]/*.parquet")}
    build()
    assert not blocks.missing(spark, path, 6) and blocks.opened(spark, path).agg(F.sum("n")).first()[0] == 301
    assert before and before == {p: p.stat().st_mtime_ns for p in Path(path).rglob("chunk=[01]/*.parquet")}


def test_no_vectors(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, v array<double>")
    blocks.build(empty, f"{tmp_path}/b", chunks=2)
    stored = blocks.opened(spark, f"{tmp_path}/b")
    assert blocks.topk(empty.withColumnRenamed("doc_id", "query_id"), stored, empty, 3).count() == 0


# versions


def table_of(spark, n=400):
    return spark.createDataFrame([(k, f"n{k}", float(k)) for k in range(n)] + [(None, "null", 0.0)], "k long, name string, x double")


def test_upsert_rewrites_only_the_buckets_of_its_keys(spark, tmp_path):
    path = f"{tmp_path}/t"
    first = versions.create(table_of(spark), path, ["k"], 16)
    assert len(first.folders) == 16
    changes = spark.createDataFrame([(5, "five", 55.0), (-1, "new", 1.0), (None, "void", 2.0)], "k long, name string, x double")
    second = versions.upsert(changes, path)
    rewritten = {b for b in second.folders if second.folders[b] != first.folders[b]}
    assert 1 <= len(rewritten) <= 3
    got = {r["k"]: (r["name"], r["x"]) for r in versions.read(spark, path).collect()}
    assert got == {k: (f"n{k}", float(k)) for k in range(400)} | {5: ("five", 55.0), -1: ("new", 1.0), None: ("void", 2.0)}
    assert versions.read(spark, path, 0).count() == 401 and versions.read(spark, path, 0).where("k = 5").first()["name"] == "n5"


def test_patch_sets_columns_of_what_is_there(spark, tmp_path):
    path = f"{tmp_path}/t"
    versions.create(table_of(spark, 20), path, ["k"], 4)
    versions.patch(spark.createDataFrame([(3, None), (99, "no")], "k long, name string"), path)
    rows = {r["k"]: (r["name"], r["x"]) for r in versions.read(spark, path).collect()}
    assert rows[3] == (None, 3.0) and rows[4] == ("n4", 4.0) and 99 not in rows and len(rows) == 21


def test_versions_are_whole_or_not_there(spark, tmp_path):
    path = f"{tmp_path}/t"
    versions.create(table_of(spark, 20), path, ["k"], 4)
    one = spark.createDataFrame([(3, "a", 0.0)], "k long, name string, x double")
    versions.upsert(one, path)
    with pytest.raises(Exception, match="already exists|AlreadyExists"):  # another writer of the same version was first
        versions._commit(spark, path, versions.version(spark, path, 1))
    with pytest.raises(ValueError, match="repeat"):
        versions.upsert(one.union(one), path)
    assert versions.numbers(spark, path) == [0, 1]
    same = versions.upsert(one.where("false"), path)
    assert same.folders == versions.version(spark, path, 1).folders
    assert json.loads(Path(f"{path}/versions/1.json").read_text())["number"] == 1


def test_vacuum_keeps_what_is_named(spark, tmp_path):
    path = f"{tmp_path}/t"
    versions.create(table_of(spark, 40), path, ["k"], 4)
    for k in range(3):
        versions.upsert(spark.createDataFrame([(k, "x", 0.0)], "k long, name string, x double"), path)
    assert versions.vacuum(spark, path, 1) >= 1 and versions.numbers(spark, path) == [3]
    assert versions.read(spark, path).count() == 41


def test_a_batch_that_is_sent_again_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    versions.create(table_of(spark, 20), path, ["k"], 4)
    one = spark.createDataFrame([(3, "a", 0.0)], "k long, name string, x double")
    assert versions.upsert(one, path, 0).number == 1 and versions.upsert(one.withColumn("name", F.lit("b")), path, 0).number == 1
    assert versions.upsert(one.withColumn("name", F.lit("c")), path, 1).number == 2
    assert versions.read(spark, path).where("k = 3").first()["name"] == "c"


# display store


def test_lookups_read_few_row_groups(spark, tmp_path):
    path = f"{tmp_path}/d"
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string").cast("binary")).alias("a"), F.sha2(F.col("id").cast("string").cast("binary"), 512).alias("b"))
    display.store(rows, path, "doc_id", group_bytes=64_000)
    wanted = spark.createDataFrame([(1, 7), (2, 19_000), (3, -5)], "query_id long, doc_id long")
    got = {r["query_id"]: r["a"] for r in display.lookup(spark, path, wanted, "doc_id").collect()}
    assert got[3] is None and {k: bool(v) for k, v in got.items()} == {1: True, 2: True, 3: False}
    few = spark.read.parquet(path).where(F.col("doc_id").isin([7, 19_000, -5]))
    execution = few._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    leaf = execution.executedPlan().collectLeaves().apply(0)
    assert leaf.metrics().apply("numOutputRows").value() < 5_000
    many = display.lookup(spark, path, spark.range(0, 4000, 2).withColumnRenamed("id", "doc_id"), "doc_id")
    assert many.where("a is not null").count() == 2000


# judge


def some_judge():
    def judge(requests):
        if any(r["query_id"] == 66 for r in requests):
            raise ConnectionError("gone")
        out = []
        for r in requests:
            if r["query_id"] == 7:
                out.append(TimeoutError("slow"))
            elif r["query_id"] == 8:
                out.append({"tokens": 1, "answers": {}})
            else:
                out.append({"tokens": sum(len(q["prompt"]) for q in r["questions"]), "answers": {q["key"]: {"yes": 0.25} if q["kind"] == "noul" else {o["option"]: 1 / len(q["options"]) for o in q["options"]} for q in r["questions"]}})
        return out

    return judge


def test_failed_requests_stay_with_their_queries(spark):
    rows = [(q, g, f"c{o}", None if o else "text") for q in (1, 2, 7, 8) for g in range(3) for o in range(2)]
    grouped = spark.createDataFrame(rows, "query_id long, group_id long, option string, text string")
    ask = judge.choices(grouped, "pick").unionByName(judge.nouls(grouped.select("query_id").distinct(), F.lit("broad"), F.lit("is it?")))
    replies = judge.called(ask, some_judge, 2)
    totals = {r["query_id"]: (r["requests"], r["tokens"], r["failed"], r["status"]) for r in judge.totals(replies).collect()}
    assert totals == {1: (2, 18, 0, "decided"), 2: (2, 18, 0, "decided"), 7: (2, 0, 2, "decision_unavailable"), 8: (2, 0, 2, "decision_unavailable")}
    said = {(r["query_id"], r["key"], r["option"]): r["p"] for r in judge.answers(replies).collect()}
    assert {q for q, *_ in said} == {1, 2} and said[1, "broad", "yes"] == 0.25 and said[2, "g1", "c0"] == 0.5


def test_a_judge_that_fails_as_a_whole(spark):
    ask = judge.nouls(spark.createDataFrame([(66,)], "query_id long"), F.lit("k"), F.lit("p"))
    assert judge.totals(judge.called(ask, some_judge)).first()["status"] == "decision_unavailable"
    assert judge.totals(judge.called(ask.where("false"), some_judge)).count() == 0


# streams

EVENTS = "event_id long, user_id long, time timestamp, sec double"


def event_rows(rows):
    import datetime as dt

    zero = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    return [(i, u, zero + dt.timedelta(seconds=s), (zero + dt.timedelta(seconds=s)).timestamp()) for i, u, s in rows]


def put(spark, folder, rows):
    spark.createDataFrame(event_rows(rows), EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_state_of_the_limiter_ends(spark, tmp_path):
    source, out, notes = f"{tmp_path}/in", f"{tmp_path}/out", []
    listener = ev.Progress(notes.append)
    spark.streams.addListener(listener)

    def run():
        stream = spark.readStream.schema(EVENTS).parquet(source)
        with ev.keyed_state(spark):
            return ev.drained(ev.streaming_limit(stream, 2, 60.0, "10 seconds"), out)

    try:
        put(spark, source, [(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 2, 3), (2, 1, 1)])  # event 2 comes twice
        first = {r["event_id"]: r["allowed"] for r in run().collect()}
        assert first == {1: True, 2: True, 3: False, 4: True}
        put(spark, source, [(5, 3, 1000), (6, 1, 1001)])
        put(spark, source, [(7, 9, 5000)])
        got = {r["event_id"]: r["allowed"] for r in run().collect()}
        assert got == first | {5: True, 6: True, 7: True}
        put(spark, source, [(8, 9, 9000)])
        run()
    finally:
        spark.streams.removeListener(listener)
    held = [n["state"] for n in notes]
    assert max(held) >= 3 and held[-1] < max(held)


def test_windows_of_a_stream_are_all_there_and_replays_change_nothing(spark, tmp_path):
    source = f"{tmp_path}/in"
    put(spark, source, [(k, k % 3, 600 * k) for k in range(20)])
    stream = spark.readStream.schema(EVENTS).parquet(source).withWatermark("time", "10 minutes")
    counts = stream.groupBy(F.window("time", "1 hour").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")
    got = ev.upserted(counts, f"{tmp_path}/out", ["start", "user_id"])
    assert got.agg(F.sum("n")).first()[0] == 20
    before = versions.numbers(spark, f"{tmp_path}/out/table")
    again = versions.upsert(got.withColumn("n", F.lit(0).cast("long")), f"{tmp_path}/out/table", 0)
    assert versions.numbers(spark, f"{tmp_path}/out/table") == before and again.number == before[-1]
    put(spark, source, [(100, 0, 100), (101, 0, 12000)])
    assert ev.upserted(counts, f"{tmp_path}/out", ["start", "user_id"]).agg(F.sum("n")).first()[0] >= 21


def test_drop_counts_come_from_the_pass_that_writes(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("",), (None,), ("bb",)], "t string")
    kept, seen = tables.observed(rows, F.length("t") > 0, {"empty": F.col("t") == "", "null": F.col("t").isNull()})
    kept.write.parquet(f"{tmp_path}/kept")
    assert seen.get == {"kept": 2, "empty": 1, "null": 1}


def test_quantiles_of_one_group_of_many_values(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), (F.col("id") * 0.5).alias("v")).union(spark.createDataFrame([(None, 1.0), ("h", None)], "g string, v double"))
    n = F.col("n")
    got = {r["g"]: (r["n"], r["low"], r["mid"], r["high"]) for r in tables.discrete_quantiles(df, "g", "v", {"low": F.lit(0), "mid": F.floor(n / 2), "high": n - 1}).collect()}
    assert got == {"g": (5000, 0.0, 1250.0, 2499.5), None: (1, 1.0, 1.0, 1.0)}


# executors


def test_executors_need_no_copy_of_the_library(tmp_path):
    """Workers are started elsewhere, with the path to the library known to the driver's process alone."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
import __spark_entry__
every = __spark_entry__.queries()
for name in {{names}}:
    if name in every:
        every[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        print("ran", name)
"""
    names = ["chain_split", "cosine_topk", "rate_limit_exact", "judged_tokens", "op3_language", "op7_quality", "op8_html", "op11_resampling", "op13_cost_packing"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code.replace("{names}", repr(names))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert run.returncode == 0, run.stderr[-2000:]
    assert run.stdout.count("ran") >= 4


# hot keys


def test_grid_join_deals_hot_keys(spark):
    from quern.operators.sizes import grid_join

    left = spark.createDataFrame([(1 if k < 500 else k, k) for k in range(600)] + [(None, -1)], "k long, a long")
    right = spark.createDataFrame([(1 if k < 300 else k, -k) for k in range(700)] + [(None, 1)], "k long, b long")
    key = lambda df: sorted((r["k"], r["a"], r["b"]) for r in df.collect())
    got = grid_join(left, right, "k", 50)
    assert sorted(got.columns) == ["a", "b", "k"] and key(got) == key(left.join(right, "k"))


def test_bm25_beyond_a_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(d[0], d[1]) for d in DOCS], "doc_id long, text string")
    asked = spark.createDataFrame([(q, "the cat sat") for q in range(30)], "query_id long, text string")
    want = scores(lexical.bm25(asked, docs), "query_id", "doc_id")
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 5)
    assert scores(lexical.bm25(asked, docs), "query_id", "doc_id") == want


def test_passages_of_no_whole_word_need_no_nested_loop(spark):
    texts = ["abcdef ghi", "xabc", "ab", "", None, "a", "ghij abc", "c d e f"]
    passages = ["abc", "ab", "a", "f g", "zz", "", "def ghi", "d e", None, "c d e f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(passages)), "query_id long, text string")
    found = lexical.containing(docs, asked)
    assert {(r["query_id"], r["doc_id"]) for r in found.collect()} == {(q, d) for q, p in enumerate(passages) for d, t in enumerate(texts) if p is not None and t is not None and p in t}
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


def test_crosscheck_meets_by_equality(spark):
    from quern.operators import corpus

    records = [(1, "مسلم", "35"), (2, "مسلم", "5"), (3, "البخاري", "35"), (4, "مسلم", ""), (5, "مسلم", "12a"), (6, "مسلم", None)]
    hits = [(1, "صحيح مسلم", "35"), (2, "صحيح مسلم", "ص 35 / 5"), (3, "صحيح البخاري", "135"), (4, None, "35"), (5, "مسلم", "12a"), (6, "مسلم", None), (7, "مسلم", "5 5")]
    ours, theirs = spark.createDataFrame(records, "id long, token string, number string"), spark.createDataFrame(hits, "hit_id long, source string, page string")
    got = corpus.crosschecked(ours, theirs)
    assert {(r["id"], r["hit_id"]) for r in got.collect()} == {(1, 1), (1, 2), (2, 2), (2, 7), (5, 5)} and got.count() == 5
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_index_sums_scores_without_sending_them(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"cat w{k % 5} cat") for k in range(50)], "doc_id long, text string")
    made = index.build(docs, f"{tmp_path}/index")
    asked = spark.createDataFrame([(1, "cat w1"), (2, "cat")], "query_id long, text string")
    assert "hashpartitioning(query_id" not in plan(index.search(made, asked))


def test_pools_and_shortlists_are_found_once(spark):
    from quern.plans import search_queries as sq

    folder = "/root/testdata/sf0.001"
    for df in (sq._pool(spark, folder), sq._found(spark, folder)):
        assert not [f for f in df.inputFiles() if "documents" in f or "quern-index" in f or "quern-lexical" in f]
