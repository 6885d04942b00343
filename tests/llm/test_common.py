"""Shared helpers."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from quern.llm import common


def test_ranked_deals_hot_groups_over_salts(spark):
    rows = [(k % 3 if k < 50 else 7, k) for k in range(400)]
    df = spark.createDataFrame(rows, "g long, i long")
    df = df.join(df.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g")
    got = defaultdict(list)
    for r in common.ranked(df, ["g"], ["i"], "n", "rank", per=10).collect():
        got[r["g"]].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and len(got[7]) == 350
    again = {(r["i"], r["rank"]) for r in common.ranked(df.repartition(7), ["g"], ["i"], "n", "rank", per=10).collect()}
    assert again == {(r["i"], r["rank"]) for r in common.ranked(df, ["g"], ["i"], "n", "rank", per=10).collect()}


def test_scratch_is_deleted(spark):
    scratch = common.Scratch()
    df = scratch.written(spark.range(10), "test")
    path = df._quern_path.removeprefix("file:")
    assert df.count() == 10
    scratch.discard()
    import os

    assert not os.path.exists(path)


def test_shared_dir_is_read_from_the_session(spark):
    class Session:
        class conf:  # noqa: N801
            get = staticmethod({"spark.checkpoint.dir": "file:///shared/"}.get)

    assert common.shared_dir(Session) == "file:///shared"
    assert common.shared_dir(spark)


def test_a_cluster_must_name_its_shared_folder():
    import pytest

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        common.shared_dir(Session)


def test_spread_join_deals_hot_keys_over_salts(spark):
    rows = spark.createDataFrame([(1 if k < 300 else k, k) for k in range(400)], "g long, i long")
    table = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("g <> 399")
    got = common.spread_join(rows, table, "g", "n", 20).collect()
    assert sorted((r["g"], r["i"], r["n"]) for r in got) == sorted((r["g"], r["i"], 300 if r["g"] == 1 else 1) for r in rows.collect() if r["g"] != 399)
    assert got[0].asDict().keys() == {"g", "i", "n"}


def test_if_small(spark):
    assert common.if_small(spark.range(5), 5) is not None and common.if_small(spark.range(6), 5) is None


def test_gram_counts():
    x = common.gram_counts([b"ab", b"", b"a  b"], 64, (1, 2))
    assert x.sum(1).tolist() == [3, 0, 6]
    text = bytes(range(97, 123)) * 7 + b"   end"
    assert (common.gram_counts([text], 256) == common.gram_counts([text], 256, block=5)).all()


def test_recent_keeps_what_is_asked_for_often():
    made = []
    cache = common.Recent(lambda k: made.append(k) or k * 2, 3)
    for k in (1, 2, 3, 1, 4, 1, 5, 1, 6, 1):
        assert cache[k] == k * 2
    assert made.count(1) == 1 and len(cache) + len(cache.old) <= 6


def test_a_machine_is_fitted_on_one_copy_of_its_sample():
    import tracemalloc

    from quern.llm import svm

    x = np.random.default_rng(1).random((1000, 512)).astype(np.float16) / 16
    y = np.where(x[:, 0] > x[:, 1], 1, -1)
    tracemalloc.start()
    svm.train(x, y, epochs=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1.5 * 8 * x.size  # three copies in doubles before
