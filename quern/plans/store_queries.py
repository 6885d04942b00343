"""Queries over sources and sinks, records, reports and small forms, on rows made from the tables, each with its SQL equivalent."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import answers, corpus, tables
from quern.plans import script_queries as sc
from quern.plans import search_queries as sq
from quern.plans.text_queries import md5
from quern.sources import files
from quern.sources.files import table
from quern.sources.scratch import shared_dir, written


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"


def jsonl_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Two folders of JSON lines that share a third of the documents: the first folder's row stands for those."""
    docs, n = table(spark, d, "documents"), F.col("doc_id")
    paths = [_place(spark, "lines-a"), _place(spark, "lines-b")]
    for path, keep, tag in ((paths[0], n % 3 < 2, "a"), (paths[1], n % 3 > 0, "b")):
        files.write_json_lines(docs.where(keep).select(n.cast("string").alias("id"), F.lit(tag).alias("tag"), md5(F.col("text")).alias("text_md5")), path)
    return files.first_seen_files(spark, paths, "id string, tag string, text_md5 string", "id").select("id", "tag", "text_md5")


JSONL_FIRST_SEEN = "SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 < 2 THEN 'a' ELSE 'b' END AS tag, md5(text) AS text_md5 FROM documents"


def edition_rows(spark: SparkSession, d: str) -> DataFrame:
    """Whole-file JSON editions, one a nation, of its suppliers as reports; section names looked up, and an edition that isn't there."""
    s = table(spark, d, "supplier")
    none, number = F.lit(None).cast("string"), F.col("s_suppkey").cast("string")
    grade = F.array(F.struct(F.lit("g").alias("name"), F.when(F.col("s_acctbal") > 0, "Sahih").otherwise("Daif").alias("grade")))
    report = F.struct(number.alias("hadithnumber"), none.alias("arabicnumber"), F.col("s_name").alias("text"), F.struct((F.col("s_suppkey") % 4).cast("int").alias("book")).alias("reference"), grade.alias("grades"))
    sections = F.create_map(F.lit("1"), F.lit("first"), F.lit("2"), F.lit("second"))
    whole = s.groupBy("s_nationkey").agg(F.sort_array(F.collect_list(report)).alias("hadiths"))  # a file's own rows
    path = _place(spark, "editions")
    lines = whole.select("s_nationkey", F.to_json(F.struct(F.struct(sections.alias("sections")).alias("metadata"), "hadiths")).alias("value"))
    lines.write.partitionBy("s_nationkey").text(path)  # a file each
    rows = files.edition(spark, f"{path}-absent").unionByName(files.edition(spark, path))
    return rows.select("hadithnumber", "text", F.col("book").cast("long").alias("book"), "section", F.col("grades")[0]["grade"].alias("grade"))


EDITION_ROWS = """SELECT CAST(s_suppkey AS VARCHAR) AS hadithnumber, s_name AS text, CAST(s_suppkey % 4 AS BIGINT) AS book, CASE s_suppkey % 4 WHEN 1 THEN 'first' WHEN 2 THEN 'second' END AS section,
  CASE WHEN s_acctbal > 0 THEN 'Sahih' ELSE 'Daif' END AS grade FROM supplier"""


def surface_folders(spark: SparkSession, d: str) -> DataFrame:
    """Records of four documents each with their texts by language, fanned out into a folder a language; what a resumed build would
    still have to do for six languages."""
    docs = table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 4).cast("string").alias("id"), "lang").agg(F.min_by("text", "doc_id").alias("text"))
    records = docs.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("lang", "text"))).alias("surfaces"))
    path = _place(spark, "surfaces")
    files.write_surfaces(records, path)
    have = spark.read.schema("id string, text string, lang string").parquet(path).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    wanted = spark.createDataFrame([(x,) for x in ("de", "en", "es", "fr", "id", "tr")], "lang string")
    return have.unionByName(files.missing_partitions(wanted, spark, path).select("lang", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("chars")))


SURFACE_FOLDERS = """WITH s AS (SELECT doc_id // 4 AS id, lang, arg_min(text, doc_id) AS text FROM documents GROUP BY 1, 2)
SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM s WHERE trim(text) <> '' GROUP BY 1 UNION ALL SELECT lang, 0, 0 FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('id'), ('tr')) v(lang) WHERE lang NOT IN (SELECT lang FROM s)"""


def answer_cache(spark: SparkSession, d: str) -> DataFrame:
    """Answers of two versions kept; some of the second's are given anew: what the cache has for the second."""
    q, path = table(spark, d, "benchmark").select("item_id", F.col("text").alias("query")), _place(spark, "cache")
    files.keep_answers(q.withColumn("answer", F.lit("old")), path, "v1")
    files.keep_answers(q.where("item_id % 2 = 0").withColumn("answer", F.concat(F.lit("new "), "query")), path, "v2")
    files.keep_answers(q.where("item_id % 4 = 0").withColumn("answer", F.reverse("query")), path, "v2")
    return files.cached_answers(spark, path, "v2").select(md5(F.col("query")).alias("query_md5"), md5(F.col("answer")).alias("answer_md5"))


ANSWER_CACHE = "SELECT md5(text) AS query_md5, md5(CASE WHEN item_id % 4 = 0 THEN reverse(text) ELSE 'new ' || text END) AS answer_md5 FROM benchmark WHERE item_id % 2 = 0"

_TEXTS = {"no_match": "nothing found", "tentative": "perhaps", "else": "found"}


def small_forms(spark: SparkSession, d: str) -> DataFrame:
    """Small string and number functions over the documents' words, ids and lengths."""
    n, arabic = F.col("doc_id"), sc._arabic(F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars", arabic.alias("arabic")).join(sc._spoken(spark, d).select("doc_id", "a"), "doc_id")
    tanween = F.concat(F.col("a"), F.when(n % 2 == 0, "ࣰ ا ").otherwise("ࣰ ن"), F.lit("x"))
    cited = F.when(n % 4 != 0, F.concat(F.floor(n / 4).cast("string"), F.lit(".02")))
    verdict = F.when(n % 3 == 0, "no_match").when(n % 3 == 1, "tentative").otherwise("confident")
    number = F.when(n % 3 == 0, F.concat(n.cast("string"), F.lit(".5"))).otherwise(n.cast("string"))
    citation = text.muslim_citation(n.cast("int"), cited)
    return rows.select(
        "doc_id", text.join_open_tanween(tanween).alias("tanween"), md5(text.visible(F.col("arabic"))).alias("visible_md5"), md5(text.skeleton(F.col("arabic"))).alias("skeleton_md5"),
        text.filled("{a}/{b}?{a}", a=F.col("source"), b=F.lit(None).cast("string")).alias("filled"), text.short_name(F.concat(F.when(n % 2 == 0, "سنن ").otherwise("موطأ "), F.col("source")), ["سنن", "صحيح"]).alias("short"),
        citation["number"].alias("number"), citation["intro"].alias("intro"), text.message(verdict, (n % 10) / 10.0, _TEXTS, "say more").alias("message"),
        text.percent((n % 130).cast("double") / 100.0 - 0.1).cast("long").alias("percent"), tables.ceil_div(F.col("n_chars"), F.lit(7)).alias("parts"), tables.fractional(number).alias("fraction"),
    )


SMALL_FORMS = f"""WITH {sc._SPOKEN_SQL}, v AS (SELECT doc_id, source, n_chars, {sc._VISIBLE_SQL} AS v FROM documents)
SELECT doc_id, a || CASE WHEN doc_id % 2 = 0 THEN 'ࣰا x' ELSE 'ࣰ نx' END AS tanween, md5(v) AS visible_md5,
  md5(trim(regexp_replace(regexp_replace(translate(v, 'آأإٱٲٳٵؤئء', 'اااااااوي'), '[^\\p{{L}}\\s]', '', 'g'), '\\s+', ' ', 'g'))) AS skeleton_md5, source || '/?' || source AS filled,
  CASE WHEN doc_id % 2 = 0 THEN source ELSE 'موطأ ' || source END AS short, CASE WHEN doc_id % 4 = 0 THEN doc_id ELSE doc_id // 4 END AS number, doc_id % 4 = 0 AND doc_id <= 92 AS intro,
  CASE doc_id % 3 WHEN 0 THEN 'nothing found' || CASE WHEN doc_id % 10 < 3.5 THEN ' say more' ELSE '' END WHEN 1 THEN 'perhaps' ELSE 'found' END AS message,
  CAST(greatest(0, least(100, round((CAST(doc_id % 130 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(0.1 AS DOUBLE)) * 100))) AS BIGINT) AS percent, (n_chars + 6) // 7 AS parts, doc_id % 3 = 0 AS fraction FROM sp JOIN v USING (doc_id)"""


def case_checks(spark: SparkSession, d: str) -> DataFrame:
    """Answers held against what their cases allow: verdicts, texts by id or among the variants, kinds, rulings; totals by source."""
    n, none = F.col("doc_id"), F.lit(None)
    ref = lambda c: F.concat(F.lit("d"), c.cast("string"))
    variants = F.array(F.struct(ref(n).alias("ref")), F.struct(ref(n + 1).alias("ref")), F.struct(ref(n + 1).alias("ref")))
    shown = F.struct(ref(n).alias("id"), sq._kind(F.col("source")).alias("kind"), F.col("text").alias("matn"), F.lit("sahih").alias("severity"), text_refs(variants, ref(n)).alias("variants"))
    rows = table(spark, d, "documents").select(
        "source", F.when(n % 2 == 0, "topic").otherwise("confident").alias("verdict"), F.array(shown).alias("shown"), F.array(F.lit("w")).alias("wording"), (n % 5 == 0).alias("ruling"),
        F.when(n % 7 < 5, F.array(F.lit("topic"), F.lit("confident"))).otherwise(F.array(F.lit("no_match"))).alias("want_verdicts"), F.array(F.concat(F.lit("id:"), ref(n + n % 3))).alias("want_has"),
        F.lit("ayah").alias("want_kind"), F.when(n % 11 == 0, F.lit(True)).alias("want_ruling"), none.cast("array<string>").alias("want_wording"), none.cast("string").alias("not_sound"),
    )
    return answers.case_totals(answers.check(rows), "source")


def text_refs(variants: F.Column, own: F.Column) -> F.Column:
    return answers.shown_variants(variants, own)


CASE_CHECKS = """WITH c AS (SELECT source, NOT (doc_id % 7 >= 5 OR doc_id % 3 = 2 OR (doc_id % 2 = 0 AND source <> 'src0') OR (doc_id % 11 = 0 AND doc_id % 5 <> 0)) AS good FROM documents)
SELECT source, count(*) FILTER (good) AS passed, count(*) AS n FROM c GROUP BY ROLLUP (source)"""


def traced_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Where each document that holds a passage stands: among the 400 best of the dense retriever, in the lexical one, in the fusion."""
    watched = sq._gold(spark, d)
    return answers.traced(sq._dense_top(spark, d, 400), sq._scores(spark, d), sq._hybrid(spark, d).withColumn("score", F.round("score", 5)), watched)


TRACED_RANKS = f"""WITH {sq.BM25}, {sq.DENSE}, {sq._FUSED}, g AS (SELECT item_id AS query_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
a AS (SELECT query_id, doc_id, rank AS dense_rank FROM ({sq._rank_sql('de')}) WHERE rank <= 400), b AS (SELECT query_id, doc_id, rank AS lexical_rank FROM ({sq._rank_sql('bm')})),
f AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(0.7 * zd + 0.3 * zl, 5) DESC, doc_id) AS rank FROM fu)
SELECT query_id, doc_id, dense_rank, lexical_rank, rank FROM g LEFT JOIN a USING (query_id, doc_id) LEFT JOIN b USING (query_id, doc_id) LEFT JOIN f USING (query_id, doc_id)"""


def edition_differences(spark: SparkSession, d: str) -> DataFrame:
    """Two editions of the documents: one with other marks, which is no difference, some letters more, some texts missing."""
    docs = table(spark, d, "documents").select("doc_id", sc._arabic(F.coalesce("text", F.lit(""))).alias("text"))
    n = F.col("doc_id")
    other = docs.where(n % 10 != 9).withColumn("text", F.when(n % 3 == 0, F.concat("text", F.lit("ّ"))).when(n % 5 == 0, F.concat("text", F.lit("ق"))).otherwise(F.col("text")))
    out = tables.differing(docs, other, ["doc_id"], text.skeleton)
    return out.select("doc_id", F.col("theirs").isNull().alias("missing"))


EDITION_DIFFERENCES = "SELECT doc_id, doc_id % 10 = 9 AS missing FROM documents WHERE doc_id % 10 = 9 OR (doc_id % 3 <> 0 AND doc_id % 5 = 0)"


def described_sources(spark: SparkSession, d: str) -> DataFrame:
    """Each source with the language and length of its first document; a source without documents has none."""
    docs = table(spark, d, "documents")
    named = docs.select("source").distinct().unionByName(spark.createDataFrame([("none",)], "source string"))
    return tables.described(named, docs.select("source", "doc_id", "lang", "n_chars"), "source", [F.col("doc_id")])


DESCRIBED_SOURCES = "SELECT source, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1 UNION ALL SELECT 'none', NULL, NULL, NULL"


def health(spark: SparkSession, d: str) -> DataFrame:
    return answers.health(table(spark, d, "documents"), "v1")


HEALTH = "SELECT count(*) AS records, count(DISTINCT lang) AS languages, 'v1' AS version FROM documents"


def json_nested(spark: SparkSession, d: str) -> DataFrame:
    """A nested counter as a JSON column and back: lines by status inside return flags, and events' properties by a schema."""
    each = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    nested = each.groupBy("l_returnflag").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linestatus").alias("status"), "n"))).alias("by_status"))
    shown = written(nested.select(F.col("l_returnflag").alias("key"), F.to_json("by_status").alias("json")), "nested")
    back = shown.withColumn("own", F.from_json("json", "array<struct<status:string,n:bigint>>"))
    counted = back.select("key", "json", F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("total"))
    props = table(spark, d, "events").select("event_type", F.from_json("props", "k bigint, missing string").alias("p"))
    own = props.groupBy(F.col("event_type").alias("key")).agg(F.to_json(F.struct(F.max("p.k").alias("k"), F.max("p.missing").alias("missing"))).alias("json"), F.sum("p.k").alias("total"))
    return counted.unionByName(own)


JSON_NESTED = """WITH e AS (SELECT l_returnflag AS key, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT key, CAST(to_json(list(struct_pack(status := status, n := n) ORDER BY status)) AS VARCHAR) AS json, CAST(sum(n) AS BIGINT) AS total FROM e GROUP BY 1
UNION ALL SELECT event_type, '{"k":' || max(CAST(json_extract(props, '$.k') AS BIGINT)) || '}', CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) FROM events GROUP BY 1"""


def cosine_spread(spark: SparkSession, d: str) -> DataFrame:
    """Least and median cosine of each query's ten best."""
    out = tables.spread(sq.cosine_topk(spark, d), "query_id", "score")
    return out.select("query_id", "n", "least", "median")


COSINE_SPREAD = f"""WITH {sq._COS}, t AS (SELECT query_id, round(score, 6) AS score FROM ({sq._rank_sql('cs')}) WHERE rank <= 10), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score) - 1 AS k, count(*) OVER (PARTITION BY query_id) AS n FROM t)
SELECT query_id, any_value(n) AS n, min(score) AS least, min(CASE WHEN k = (n - 1) // 2 THEN score END) AS median FROM r GROUP BY 1"""


def verse_records(spark: SparkSession, d: str) -> DataFrame:
    """Parts as verses of chapters of a hundred: records with names, refs and their surfaces in two languages."""
    p = table(spark, d, "part").select((F.floor(F.col("p_partkey") / 100) + 1).alias("chapter"), (F.col("p_partkey") % 100 + 1).alias("verse"), F.col("p_name").alias("text"), F.col("p_partkey").alias("k"))
    chapters = p.groupBy(F.col("chapter").alias("id")).agg(F.count(F.lit(1)).alias("verses")).withColumn("name", F.concat(F.lit("chapter "), F.col("id").cast("string")))
    spoken = p.select("chapter", "verse", F.explode(F.array(F.struct(F.lit("en").alias("lang"), F.col("text").alias("text")), F.struct(F.lit("fr").alias("lang"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("Le "), F.col("text"))).alias("text")))).alias("s")).select("chapter", "verse", "s.lang", "s.text")
    made = corpus.verses(p.select("chapter", "verse", "text"), p.select("chapter", "verse", "text"), chapters, corpus.surfaces(spoken, ["chapter", "verse"]))
    return made.select("id", "surah_name", F.col("ayah").cast("long").alias("ayah"), "ref", "severity", F.size("surfaces").cast("long").alias("n_surfaces"), F.try_element_at("surfaces", F.lit("fr")).alias("fr"))


VERSE_RECORDS = """WITH p AS (SELECT p_partkey // 100 + 1 AS c, p_partkey % 100 + 1 AS v, p_name AS t, p_partkey AS k FROM part)
SELECT 'quran:' || c || ':' || v AS id, 'chapter ' || c AS surah_name, v AS ayah, 'chapter ' || c || ': ' || v AS ref, 'quran' AS severity, CAST(CASE WHEN length(trim(t)) >= 8 THEN 1 ELSE 0 END + CASE WHEN k % 3 = 0 AND length(trim('Le ' || t)) >= 8 THEN 1 ELSE 0 END AS BIGINT) AS n_surfaces,
  CASE WHEN k % 3 = 0 AND length(trim('Le ' || t)) >= 8 THEN trim(regexp_replace(lower(regexp_replace('Le ' || t, '[^\\p{L}\\p{N}\\s]', ' ', 'g')), '\\s+', ' ', 'g')) END AS fr FROM p"""


def report_records(spark: SparkSession, d: str) -> DataFrame:
    """Documents as reports of a book cited by a second number: number, ref, the preferred grader's grade, its basis and class; and the
    statistics of the records."""
    return _reports(spark, d).select("id", "number", "ref", "grade_raw", "grade_basis", "severity", "action", "split_rule", F.size("graders").cast("long").alias("n_graders"))


def _reports(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    rows = sc._spoken(spark, d).join(table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id")
    grade = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("grade"))
    given = F.array(grade("first", F.when(n % 3 == 0, "").otherwise("Daif")), grade("best", F.when(F.col("quality") == 1, "Sahih").otherwise("-")))
    t = F.when(n % 9 == 0, " ").otherwise(F.concat(sc._put(sc.CHAINS["prophet_speech"][0]), F.lit(" "), F.col("body")))
    edition = rows.select(n.cast("string").alias("hadithnumber"), F.when(n % 2 == 0, F.concat(F.floor(n / 2).cast("string"), F.lit(".1"))).alias("arabicnumber"), t.alias("text"), (n % 4).cast("int").alias("book"), F.lit("s").alias("section"), given.alias("grades"))
    none = spark.createDataFrame([], "hadithnumber string, surfaces map<string,string>, translations map<string,string>")
    return corpus.reports(edition, "muslim", "صحيح مسلم", False, none, "best", True)


REPORT_RECORDS = """WITH l AS (SELECT doc_id AS n, max(quality) AS q FROM labels JOIN documents USING (doc_id) GROUP BY 1), g AS (SELECT *, n % 2 = 1 AND n <= 92 AS intro, CASE WHEN q = 1 THEN 'Sahih' WHEN n % 3 <> 0 THEN 'Daif' END AS picked FROM l WHERE n % 9 <> 0),
b AS (SELECT *, CASE WHEN intro THEN 'none' WHEN picked IS NULL THEN 'none' ELSE 'cited' END AS basis, CASE WHEN n % 2 = 0 THEN n // 2 ELSE n END AS num FROM g)
SELECT 'muslim:' || n AS id, CAST(n AS VARCHAR) AS number, CASE WHEN intro THEN 'صحيح مسلم' ELSE 'صحيح مسلم (' || num || ')' END AS ref, CASE WHEN intro THEN '' ELSE picked END AS grade_raw, basis AS grade_basis,
  CASE WHEN basis = 'none' THEN 'unknown' WHEN picked = 'Sahih' THEN 'sahih' ELSE 'daif' END AS severity, {action}[CASE WHEN basis = 'none' THEN 'unknown' WHEN picked = 'Sahih' THEN 'sahih' ELSE 'daif' END] AS action, 'prophet_speech' AS split_rule, CAST(CASE WHEN n % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS n_graders FROM b"""


def record_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the same records by kind, book, rule and basis."""
    made = _reports(spark, d).withColumn("surfaces", F.when(F.col("book") == 1, F.create_map(F.lit("en"), F.lit("x"), F.lit("fr"), F.lit("y"))).when(F.col("book") == 2, F.create_map(F.lit("en"), F.lit("x"))))
    return corpus.statistics(made)


RECORD_STATISTICS = """WITH l AS (SELECT doc_id AS n, max(quality) AS q FROM labels JOIN documents USING (doc_id) GROUP BY 1), g AS (SELECT n, CASE WHEN (n % 2 = 1 AND n <= 92) OR (q <> 1 AND n % 3 = 0) THEN 'none' ELSE 'cited' END AS basis FROM l WHERE n % 9 <> 0)
SELECT 'kind' AS what, 'hadith' AS key, count(*) AS n FROM g UNION ALL SELECT 'collection_key', 'muslim', count(*) FROM g UNION ALL SELECT 'split_rule', 'prophet_speech', count(*) FROM g UNION ALL SELECT 'grade_basis', basis, count(*) FROM g GROUP BY 2
UNION ALL SELECT 'surface', 'en', count(*) FROM g WHERE n % 4 IN (1, 2) UNION ALL SELECT 'surface', 'fr', count(*) FROM g WHERE n % 4 = 1"""


def _actions() -> str:
    from quern.functions.grades import ACTIONS

    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in ACTIONS.items()) + "}"


REPORT_RECORDS = REPORT_RECORDS.replace("{action}", _actions())

_PLAIN = (
    jsonl_first_seen, edition_rows, surface_folders, answer_cache, small_forms, case_checks, traced_ranks, edition_differences, described_sources, health, json_nested, cosine_spread,
    verse_records, report_records, record_statistics,
)
QUERIES = {f.__name__: f for f in _PLAIN}
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in _PLAIN}
