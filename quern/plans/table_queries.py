"""Queries over table operations, report aggregates and event windows, each with its SQL equivalent."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import lexical, service, tables
from quern.operators.sizes import if_small
from quern.sources import versions
from quern.sources.files import table
from quern.sources.scratch import shared_dir, written
from quern.streaming import events as ev


def counter_share(spark: SparkSession, d: str) -> DataFrame:
    return tables.shares(table(spark, d, "documents"), "source").withColumn("share", F.round("share", 6))


COUNTER_SHARE = "SELECT source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY 1"


def nested_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Nested counters by (flag, status): how many orders have it, how many distinct suppliers, how many lines."""
    g = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return g.agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_suppkey").alias("suppliers"), F.count(F.lit(1)).alias("n"))


NESTED_COVERAGE = "SELECT l_returnflag, l_linestatus, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_suppkey) AS suppliers, count(*) AS n FROM lineitem GROUP BY 1, 2"


def discrete_quantiles(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    places = {"low": F.lit(0), "median": F.floor(n / 2), "p95": F.floor(n * 0.95), "high": n - 1}
    return tables.discrete_quantiles(table(spark, d, "documents"), "lang", "n_chars", places)


DISCRETE_QUANTILES = """
WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, n, min(CASE WHEN k = 0 THEN n_chars END) AS low, min(CASE WHEN k = floor(n / 2) THEN n_chars END) AS median,
       min(CASE WHEN k = floor(n * 0.95) THEN n_chars END) AS p95, min(CASE WHEN k = n - 1 THEN n_chars END) AS high FROM r GROUP BY 1, 2"""


def integrity_counts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    bad = tables.misaligned(o, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"])
    texts = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.trim("text") == "").alias("empty"), F.count_if(F.length("text") < 25).alias("short"))
    return bad.agg(F.count_if(F.col("only_in") == "left").alias("no_lines"), F.count_if(F.col("only_in") == "right").alias("no_order")).crossJoin(texts)


INTEGRITY_COUNTS = """
SELECT (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS no_lines,
       (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS no_order,
       count(*) AS n, count(*) FILTER (trim(text) = '') AS empty, count(*) FILTER (length(text) < 25) AS short FROM documents"""


def crosscheck_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement matrix of two gradings: a document's quality label against that of its exact copies' first one."""
    keyed = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("k")).join(table(spark, d, "labels"), "doc_id")
    first = keyed.groupBy("k").agg(F.min_by("quality", "doc_id").alias("theirs"))
    both = keyed.join(first, "k")
    return both.groupBy(F.col("quality").alias("ours")).pivot("theirs", [0, 1]).agg(F.count(F.lit(1))).select("ours", F.coalesce(F.col("0"), F.lit(0)).alias("theirs_0"), F.coalesce(F.col("1"), F.lit(0)).alias("theirs_1"))


CROSSCHECK_AGREEMENT = """
WITH k AS (SELECT doc_id, md5(text) AS k, quality FROM documents JOIN labels USING (doc_id)), f AS (SELECT k, arg_min(quality, doc_id) AS theirs FROM k GROUP BY k)
SELECT quality AS ours, count(*) FILTER (theirs = 0) AS theirs_0, count(*) FILTER (theirs = 1) AS theirs_1 FROM k JOIN f USING (k) GROUP BY 1"""


def not_located_anti(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = lexical.containing(table(spark, d, "documents").select("doc_id", "text"), asked)
    return asked.join(found, "query_id", "left_anti").select(F.col("query_id").alias("item_id"))


NOT_LOCATED_ANTI = "SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))"


def has_hit_semi(spark: SparkSession, d: str) -> DataFrame:
    late = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 45")
    return table(spark, d, "orders").join(late, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


HAS_HIT_SEMI = "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity >= 45) GROUP BY 1"


def range_lookup(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("ask_id"), F.col("p_partkey").alias("a"), (F.col("p_partkey") + F.col("p_size") - 1).alias("b"))
    hits = tables.range_lookup(asked, table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey")
    return hits.groupBy("ask_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 4).alias("total"))


RANGE_LOOKUP = """
WITH q AS (SELECT p_partkey AS ask_id, p_partkey AS a, p_partkey + p_size - 1 AS b FROM part WHERE p_size >= 1 AND p_size - 1 < 20)
SELECT ask_id, count(*) AS n, round(sum(s_acctbal), 4) AS total FROM q JOIN supplier ON s_suppkey BETWEEN a AND b
WHERE EXISTS (SELECT 1 FROM supplier x WHERE x.s_suppkey = a) AND EXISTS (SELECT 1 FROM supplier y WHERE y.s_suppkey = b) GROUP BY 1"""


def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return tables.seeded_sample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 150)


SEEDED_SAMPLE = "SELECT doc_id, lang FROM documents ORDER BY md5('450' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 150"


def first_seen(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_suppkey", "l_extendedprice")
    return tables.first_seen(rows, "l_partkey", [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")]).select("l_partkey", "l_orderkey", "l_linenumber")


FIRST_SEEN = """
SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem) WHERE k = 1"""


def upsert_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Customers of one segment get a new balance, a new one comes in."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    changed = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name", (F.col("c_acctbal") + 100).alias("c_acctbal"))
    new = spark.range(1).select(F.lit(-1).cast("long").alias("c_custkey"), F.lit("new").alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    return tables.upsert(c, changed.unionByName(new), ["c_custkey"]).withColumn("c_acctbal", F.round("c_acctbal", 4))


UPSERT_OVERLAY = """
SELECT c_custkey, c_name, round(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END, 4) AS c_acctbal FROM customer UNION ALL SELECT -1, 'new', 0.0"""


def map_edit(spark: SparkSession, d: str) -> DataFrame:
    """Translations as a map: entry `fr` is set from an overlay where it has the row, else removed."""
    n = table(spark, d, "nation").select("n_nationkey", F.create_map(F.lit("en"), F.col("n_name"), F.lit("fr"), F.lit("?")).alias("m"))
    texts = table(spark, d, "nation").where("n_regionkey < 2").select("n_nationkey", F.lower("n_name").alias("value"))
    out = tables.overlay(n, texts, "n_nationkey", "m", "fr")
    return out.select("n_nationkey", F.try_element_at("m", F.lit("en")).alias("en"), F.try_element_at("m", F.lit("fr")).alias("fr"), F.size("m").cast("long").alias("entries"))


MAP_EDIT = "SELECT n_nationkey, n_name AS en, CASE WHEN n_regionkey < 2 THEN lower(n_name) END AS fr, CAST(CASE WHEN n_regionkey < 2 THEN 2 ELSE 1 END AS BIGINT) AS entries FROM nation"


def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("nation").agg(F.count(F.lit(1)).alias("n"), F.count("segment").alias("with_segment"))


UNION_BY_NAME = "SELECT nation, count(*) AS n, count(segment) AS with_segment FROM (SELECT c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_nationkey, NULL FROM supplier) GROUP BY 1"


def sections_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Chapter names by a map lookup; a key that isn't there gives null."""
    names = table(spark, d, "region").where("r_regionkey < 4").agg(F.map_from_entries(F.collect_list(F.struct(F.col("r_regionkey").cast("string"), "r_name"))).alias("sections"))
    n = table(spark, d, "nation").crossJoin(F.broadcast(names))
    return n.select("n_name", F.try_element_at("sections", F.col("n_regionkey").cast("string")).alias("section"))


SECTIONS_LOOKUP = "SELECT n_name, r_name AS section FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey < 4"


def rollup_revenue(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(if_small(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # noqa: E741
    out = l.rollup("n_regionkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return out.select("n_regionkey", "l_returnflag", "n", "revenue")


ROLLUP_REVENUE = """
SELECT n_regionkey, l_returnflag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, l_returnflag)"""


def latency_report(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"), F.round(F.avg("value") * 0.042, 6).alias("cost"))
    n = F.col("n")
    mid = tables.discrete_quantiles(table(spark, d, "events"), "event_type", "value", {"median": F.floor(n / 2)})
    return e.join(mid.drop("n"), "event_type")


LATENCY_REPORT = """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
     m AS (SELECT event_type, min(value) AS median FROM r WHERE k = floor(n / 2) GROUP BY 1)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most, round(avg(value) * 0.042, 6) AS cost, any_value(median) AS median FROM events JOIN m USING (event_type) GROUP BY 1"""


def rate_limit_range(spark: SparkSession, d: str) -> DataFrame:
    hits = ev.recent_hits(table(spark, d, "events"), 86400.0)
    return hits.select("event_id", "hits", (F.col("hits") > 3).alias("over"))


RATE_LIMIT_RANGE = """
WITH h AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS hits FROM events)
SELECT event_id, hits, hits > 3 AS over FROM h"""


def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    return ev.tumbling(ev.with_time(table(spark, d, "events"))).select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


TUMBLING_COUNTS = "SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    return ev.sliding(ev.with_time(table(spark, d, "events"))).select(F.unix_seconds("start").alias("start"), "n")


SLIDING_COUNTS = """
SELECT CAST(floor(epoch(ts) / 3600) * 3600 - o AS BIGINT) AS start, count(*) AS n FROM events CROSS JOIN (VALUES (0), (3600)) v(o) GROUP BY 1"""


def session_counts(spark: SparkSession, d: str) -> DataFrame:
    return ev.sessions(ev.with_time(table(spark, d, "events"))).select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


SESSION_COUNTS = """
WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER w < 1800000000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
     s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(t) AS start, max(t) + 1800000000 AS "end", count(*) AS n FROM s GROUP BY user_id, s"""


def rate_limit_exact(spark: SparkSession, d: str) -> DataFrame:
    return ev.sliding_limit(table(spark, d, "events"), 3, 86400.0)


#: Each user's events one after the other: e has them by place, r the state behind each.
_BY_USER = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events)"
RATE_LIMIT_EXACT = f"""WITH RECURSIVE {_BY_USER},
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST([] AS DOUBLE[]) AS log, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BOOLEAN) AS allowed FROM e UNION ALL
  SELECT user_id, k, CASE WHEN len(l) < 3 THEN list_append(l, t) ELSE l END, event_id, len(l) < 3
  FROM (SELECT e.user_id, e.k, e.event_id, e.t, list_filter(r.log, lambda x: e.t - x <= 86400) AS l FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
SELECT event_id, user_id, allowed FROM r WHERE k > 0"""


def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    """A bucket of cost and one of requests."""
    return ev.token_bucket(table(spark, d, "events"), "value", 0.01, 100.0, 2.0).withColumn("wait", F.round("wait", 4))


TOKEN_BUCKET = f"""WITH RECURSIVE {_BY_USER},
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST(100 AS DOUBLE) AS cost_level, CAST(2 AS DOUBLE) AS request_level, CAST(NULL AS DOUBLE) AS now, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS DOUBLE) AS wait FROM e UNION ALL
  SELECT user_id, k, least(100, c + w * CAST(0.01 AS DOUBLE)) - need, least(2, q + w * 2) - 1, begin + w, event_id, begin + w - t
  FROM (SELECT *, greatest(0, (need - c) / CAST(0.01 AS DOUBLE), (1 - q) / 2) AS w
    FROM (SELECT *, least(100, cost_level + (begin - coalesce(now, begin)) * CAST(0.01 AS DOUBLE)) AS c, least(2, request_level + (begin - coalesce(now, begin)) * 2) AS q
      FROM (SELECT e.*, r.cost_level, r.request_level, r.now, least(e.value, 100) AS need, CASE WHEN r.now IS NULL THEN e.t ELSE greatest(e.t, r.now) END AS begin FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))))
SELECT event_id, user_id, round(wait, 4) AS wait FROM r WHERE k > 0"""


def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    return ev.last_use_hits(table(spark, d, "events"), "event_type", 2)


CACHE_HITS = f"""WITH RECURSIVE {_BY_USER},
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS held, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BOOLEAN) AS hit FROM e UNION ALL
  SELECT user_id, k, CASE WHEN len(h) > 2 THEN h[len(h) - 1:] ELSE h END, event_id, hit
  FROM (SELECT e.user_id, e.k, e.event_id, list_contains(r.held, e.event_type) AS hit, list_append(list_filter(r.held, lambda x: x <> e.event_type), e.event_type) AS h FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
SELECT event_id, hit FROM r WHERE k > 0"""


def match_totals(spark: SparkSession, d: str) -> DataFrame:
    """Quality labels against those of a text's first copy: agreeing, differing, without a copy, with an unlabelled one."""
    keyed = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("k"))
    labels = table(spark, d, "labels").select("doc_id", "quality")
    first = keyed.groupBy("k").agg(F.min("doc_id").alias("first"))
    theirs = labels.select(F.col("doc_id").alias("first"), F.col("quality").alias("theirs"))
    rows = keyed.join(labels, "doc_id").join(first, "k").join(theirs, "first", "left").withColumn("found", F.col("first") < F.col("doc_id"))
    return tables.match_totals(rows, "quality", "theirs")


MATCH_TOTALS = """
WITH k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first FROM documents),
r AS (SELECT l.quality AS ours, t.quality AS theirs, first < k.doc_id AS found FROM k JOIN labels l ON l.doc_id = k.doc_id LEFT JOIN labels t ON t.doc_id = k.first)
SELECT count(*) FILTER (found AND theirs IS NOT NULL AND ours IS NOT DISTINCT FROM theirs) AS agree, count(*) FILTER (found AND theirs IS NOT NULL AND ours IS DISTINCT FROM theirs) AS differ,
       count(*) FILTER (NOT found) AS unmatched, count(*) FILTER (found AND theirs IS NULL) AS silent FROM r"""


def served_requests(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests: some too short, a limit a user, a cache that knows some queries, an answer for most others."""
    kind = F.col("event_type")
    query = F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(kind, F.lit("  "), (F.col("event_id") % 7).cast("string")))
    requests = table(spark, d, "events").select("event_id", "user_id", "ts", query.alias("query"))
    known = table(spark, d, "events").select(F.concat(kind, F.lit(" 1")).alias("query")).distinct().withColumn("answer", F.upper("query"))
    out = service.served(requests, known, lambda asked: asked.where("query not like '% 3'").withColumn("answer", F.md5(F.col("query").cast("binary"))), 3, 86400.0)
    return out.select("event_id", "status", "cached", "answer")


SERVED_REQUESTS = f"""WITH RECURSIVE q AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type || ' ' || CAST(event_id % 7 AS VARCHAR) END AS query FROM events),
e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM q WHERE length(query) >= 3),
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST([] AS DOUBLE[]) AS log, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BOOLEAN) AS allowed FROM e UNION ALL
  SELECT user_id, k, CASE WHEN len(l) < 3 THEN list_append(l, t) ELSE l END, event_id, len(l) < 3
  FROM (SELECT e.user_id, e.k, e.event_id, e.t, list_filter(r.log, lambda x: e.t - x <= 86400) AS l FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)),
s AS (SELECT q.event_id, query, ts, CASE WHEN length(query) < 3 THEN 'too_short' WHEN NOT allowed THEN 'limited' WHEN query LIKE '% 3' THEN 'decision_unavailable' ELSE 'answered' END AS status FROM q LEFT JOIN r ON r.event_id = q.event_id)
SELECT event_id, status, status = 'answered' AND (query LIKE '% 1' OR row_number() OVER (PARTITION BY query, status ORDER BY ts, event_id) > 1) AS cached, CASE WHEN status = 'answered' THEN CASE WHEN query LIKE '% 1' THEN upper(query) ELSE md5(query) END END AS answer FROM s"""


def _stream(spark, d) -> tuple[DataFrame, str]:
    base = shared_dir(spark)
    schema = table(spark, d, "events").schema
    return ev.as_stream(spark, d, "events.parquet", schema), f"{base}/stream-{uuid.uuid4().hex}"


def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Windows of a stream, each batch's updates put over what is there; the last windows are open, and there."""
    stream, path = _stream(spark, d)
    out = ev.upserted(ev.tumbling(stream.withWatermark("time", "10 minutes")), path, ["start", "event_type"])
    return out.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


STREAM_TUMBLING = TUMBLING_COUNTS


def stream_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """The limiter on a stream of all events, each once; a user's state ends a day after the last one."""
    stream, path = _stream(spark, d)
    with ev.keyed_state(spark):
        return ev.drained(ev.streaming_limit(stream, 3, 86400.0), path).select("event_id", "user_id", "allowed")


STREAM_RATE_LIMIT = RATE_LIMIT_EXACT


def versioned_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Customers in hash buckets; one in 97 gets a new balance, a new one comes in: the last version of the table."""
    path = f"{shared_dir(spark)}/quern-customers-{uuid.uuid4().hex}"
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    versions.create(c, path, ["c_custkey"])
    changed = c.where("c_custkey % 97 = 5").withColumn("c_acctbal", F.col("c_acctbal") + 100)
    new = spark.range(1).select(F.lit(-1).cast("long").alias("c_custkey"), F.lit("new").alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    versions.upsert(changed.unionByName(new), path)
    versions.patch(c.where("c_custkey % 97 = 6").select("c_custkey", F.upper("c_name").alias("c_name")), path)
    return versions.read(spark, path).withColumn("c_acctbal", F.round("c_acctbal", 4))


VERSIONED_UPSERT = """
SELECT c_custkey, CASE WHEN c_custkey % 97 = 6 THEN upper(c_name) ELSE c_name END AS c_name, round(CASE WHEN c_custkey % 97 = 5 THEN c_acctbal + 100 ELSE c_acctbal END, 4) AS c_acctbal FROM customer UNION ALL SELECT -1, 'new', 0.0"""


def observed_drops(spark: SparkSession, d: str) -> DataFrame:
    """How many documents a length filter keeps and leaves out, counted in the pass that writes the kept ones."""
    n = F.length(F.trim("text"))
    kept, seen = tables.observed(table(spark, d, "documents"), n >= 400, {"empty": F.coalesce(n, F.lit(0)) == 0, "short": (n > 0) & (n < 400)})
    written(kept.select("doc_id", "text"), "kept")
    return spark.createDataFrame([tuple(seen.get[k] for k in ("kept", "empty", "short"))], "kept long, empty long, short long")


OBSERVED_DROPS = """
SELECT count(*) FILTER (length(trim(text)) >= 400) AS kept, count(*) FILTER (length(trim(coalesce(text, ''))) = 0) AS empty, count(*) FILTER (length(trim(text)) BETWEEN 1 AND 399) AS short FROM documents"""


_PLAIN = (
    counter_share, nested_coverage, discrete_quantiles, integrity_counts, crosscheck_agreement, not_located_anti, has_hit_semi, range_lookup, seeded_sample, first_seen, upsert_overlay,
    map_edit, union_by_name, sections_lookup, rollup_revenue, latency_report, rate_limit_range, tumbling_counts, sliding_counts, session_counts,
    rate_limit_exact, token_bucket, cache_hits, match_totals, served_requests,
    stream_tumbling, stream_rate_limit, versioned_upsert, observed_drops,
)
QUERIES = {f.__name__: f for f in _PLAIN}
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in _PLAIN}
