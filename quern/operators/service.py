"""A batch of requests answered as a service would: length, limit, cache, then the answer, each request in its order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import squeeze
from quern.sources.scratch import written
from quern.streaming.events import sliding_limit

LEAST_CHARS, MOST_CHARS, LIMIT, SECONDS = 3, 300, 30, 60.0
TOO_SHORT, TOO_LONG, LIMITED, UNAVAILABLE = "too_short", "too_long", "limited", "decision_unavailable"


class Unavailable(Exception):
    """What an answering function raises when its judge can't be reached. Any other error is an error."""


def served(requests: DataFrame, cache: DataFrame, answer: Callable[[DataFrame], DataFrame], limit: int = LIMIT, seconds: float = SECONDS, least: int = LEAST_CHARS, most: int = MOST_CHARS, progress: Callable[[str, int, int], None] | None = None) -> DataFrame:
    """event_id, query, status, cached, answer of every request (event_id, user_id, ts, query).

    First the length of the query with its white space squeezed, then the user's sliding limit, which counts hits of the cache
    as well; then the cache (query, answer); what is left is answered once for each different query, and comes from the cache for
    all but the first of its requests. `answer`: from (query) to (query, answer). If it raises Unavailable, or has no row for a
    query, that is `decision_unavailable`: no text is handed over without a decision. `progress(step, done, of)` is called as
    steps are done.
    """
    note = progress or (lambda step, done, of: None)
    rows = requests.select("event_id", "user_id", "ts", squeeze(F.coalesce("query", F.lit(""))).alias("query"))
    size = F.length("query")
    rows = written(rows.withColumn("status", F.when(size < least, TOO_SHORT).when(size > most, TOO_LONG)), "requests")
    note("length", 1, 4)
    allowed = sliding_limit(rows.where("status is null"), limit, seconds)
    rows = rows.join(allowed.select("event_id", "allowed"), "event_id", "left")
    rows = rows.withColumn("status", F.coalesce("status", F.when(~F.col("allowed"), LIMITED))).drop("allowed")
    rows = written(rows.join(cache.select("query", F.col("answer").alias("kept")), "query", "left"), "limited")
    note("cache", 2, 4)
    open_ = rows.where("status is null and kept is null")
    asked = open_.groupBy("query").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("first"))
    try:
        fresh = written(answer(asked.select("query")).select("query", "answer"), "answers")
    except Unavailable:
        fresh = asked.where("false").select("query", F.lit(None).cast("string").alias("answer"))
    note("answer", 3, 4)
    out = rows.join(fresh.join(asked, "query"), "query", "left")
    found = F.coalesce("kept", "answer")
    status = F.coalesce("status", F.when(found.isNull(), UNAVAILABLE).otherwise("answered"))
    again = F.coalesce(F.col("answer").isNotNull() & (F.col("event_id") != F.col("first")), F.lit(False))
    cached = F.col("status").isNull() & (F.col("kept").isNotNull() | again)
    out = out.select("event_id", "query", status.alias("status"), cached.alias("cached"), F.when(F.col("status").isNull(), found).alias("answer"))
    note("done", 4, 4)
    return out
