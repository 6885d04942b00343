"""Queries over text functions, grades and parsers, each with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import grades, parse, text
from quern.operators.lexical import words
from quern.sources.files import table

#: SQL of normalize_latin and of its words.
LATIN = r"trim(regexp_replace(lower(regexp_replace({c}, '[^\p{{L}}\p{{N}}\s]', ' ', 'g')), '\s+', ' ', 'g'))"
WORDS = "list_filter(string_split(" + LATIN + ", ' '), lambda x: x <> '')"


def latin(c: str) -> str:
    return LATIN.format(c=c)


def word_list(c: str) -> str:
    return WORDS.format(c=c)


def md5(c) -> F.Column:
    return F.md5(c.cast("binary"))


def norm_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("surface", text.surface_text(F.col("lang"), F.col("text")))
    return docs.select("doc_id", "lang", md5(F.col("surface")).alias("surface_md5"), F.size(text.tokens(F.col("surface"))).cast("long").alias("n_tokens"))


NORM_TOKENS = f"SELECT doc_id, lang, md5({latin('text')}) AS surface_md5, CAST(len({word_list('text')}) AS BIGINT) AS n_tokens FROM documents"

# The documents hold no Arabic, so their vocabulary is written in Arabic letters, one for each Latin one.
LATIN_LETTERS, ARABIC_LETTERS = "abcdefghijklmnopqrstuvwxyz", "ابتنهويلكمسعرفقدحجشصضطظغخذ"


def light_stem_vocab(spark: SparkSession, d: str) -> DataFrame:
    vocab = table(spark, d, "documents").select(F.explode(words(F.col("text"))).alias("w")).distinct()
    return vocab.select(F.translate("w", LATIN_LETTERS, ARABIC_LETTERS).alias("word")).select("word", text.light_stem(F.col("word")).alias("stem"), text.bare(F.col("word")).alias("bare"))


def _strip_sql(column: str, suffix: str, least: int) -> str:
    return f"CASE WHEN ends_with({column}, '{suffix}') AND length({column}) - {len(suffix)} >= {least} THEN left({column}, length({column}) - {len(suffix)}) ELSE {column} END"


def _first_sql(column: str, prefixes) -> str:
    cases = " ".join(f"WHEN starts_with({column}, '{p}') AND length({column}) - {len(p)} >= 2 THEN substr({column}, {len(p) + 1})" for p in prefixes)
    return f"CASE {cases} ELSE {column} END"


def _light_stem_sql() -> str:
    steps = ["CASE WHEN starts_with(s, 'و') AND length(s) > 3 THEN substr(s, 2) ELSE s END", _first_sql("s", text.STEM_PREFIXES)]
    steps += [_strip_sql("s", x, 3) for x in text.STEM_SUFFIXES_3] + [_strip_sql("s", x, 2) for x in text.STEM_SUFFIXES_2]
    sql = f"SELECT DISTINCT translate(unnest({word_list('text')}), '{LATIN_LETTERS}', '{ARABIC_LETTERS}') AS word FROM documents"
    out = f"WITH v AS ({sql}), t0 AS (SELECT word, word AS s FROM v)"
    for k, step in enumerate(steps):
        out += f", t{k + 1} AS (SELECT word, {step} AS s FROM t{k})"
    return out + f" SELECT word, s AS stem, {_first_sql('word', text.ARTICLES)} AS bare FROM t{len(steps)}"


def lang_detect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.detect(F.col("text")).alias("detected"), text.mostly_arabic(F.col("text")).alias("mostly_arabic"))


def _lang_detect_sql() -> str:
    hits = {k: f"len(list_intersect(list_distinct(w), {v.split()!r}))" for k, v in text.STOP_WORDS.items()}
    columns = ", ".join(f"{v} AS h_{k}" for k, v in hits.items())
    best = "greatest(" + ", ".join(f"h_{k}" for k in hits) + ")"
    cases = " ".join(f"WHEN h_{k} = {best} THEN '{k}'" for k in hits)
    return f"""
WITH w AS (SELECT doc_id, text, {word_list('text')} AS w, len(regexp_extract_all(text, '[a-zA-Z]')) AS latin,
             len(regexp_extract_all(text, '[؀-ۿ]')) AS arabic, len(regexp_extract_all(text, '[{text.URDU_ONLY}]')) AS urdu,
             len(regexp_extract_all(text, '[{text.SCRIPTS['bn']}]')) AS bn, len(regexp_extract_all(text, '[{text.SCRIPTS['ta']}]')) AS ta,
             len(regexp_extract_all(text, '[{text.SCRIPTS['ru']}]')) AS ru FROM documents),
     h AS (SELECT *, {columns}, greatest(bn, ta, ru) AS top FROM w)
SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'ar'
    WHEN top > 0 AND top >= greatest(arabic, latin) THEN CASE WHEN bn = top THEN 'bn' WHEN ta = top THEN 'ta' ELSE 'ru' END
    WHEN arabic > 0 AND arabic >= latin THEN CASE WHEN urdu >= 2 THEN 'ur' ELSE 'ar' END
    WHEN latin > 0 THEN CASE WHEN {best} = 0 THEN 'en' {cases} END ELSE 'ar' END AS detected,
    coalesce(arabic / nullif(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}\\p{{M}}_]')), 0) > 0.5, false) AS mostly_arabic
FROM h"""


def html_strip(spark: SparkSession, d: str) -> DataFrame:
    bare = text.squeeze(text.strip_tags(F.col("html")))
    return table(spark, d, "pages").select("page_id", md5(bare).alias("text_md5"), F.length(bare).cast("long").alias("n_chars"))


HTML_STRIP = r"""
WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS t FROM pages)
SELECT page_id, md5(t) AS text_md5, CAST(length(t) AS BIGINT) AS n_chars FROM t"""


def html_extract(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    return table(spark, d, "pages").select(
        "page_id",
        F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract(html, '<html lang="([^"]*)"', 1).alias("lang"),
        F.array_join(F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), 1), " ").alias("links"),
        F.size(F.regexp_extract_all(html, F.lit("<p>"), 0)).cast("long").alias("paragraphs"),
    )


HTML_EXTRACT = """
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
       array_to_string(regexp_extract_all(html, '<a href="([^"]*)"', 1), ' ') AS links, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS paragraphs
FROM pages"""


def clean_edges(spark: SparkSession, d: str) -> DataFrame:
    c = text.clean_display(F.col("text"))
    return table(spark, d, "documents").select("doc_id", md5(c).alias("clean_md5"), F.length(c).cast("long").alias("n_chars"))


_EDGE_SQL = "[" + text.EDGE_NOISE.replace("'", "''") + "]+"
CLEAN_EDGES = rf"""
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
     e AS (SELECT doc_id, trim(regexp_replace(regexp_replace(t, '^{_EDGE_SQL}', ''), '{_EDGE_SQL}$', '')) AS e FROM t)
SELECT doc_id, md5(e) AS clean_md5, CAST(length(e) AS BIGINT) AS n_chars FROM e"""


def mid_window(spark: SparkSession, d: str) -> DataFrame:
    w = words(F.col("text"))
    phrase = text.middle(w, 7)
    url = F.concat(F.lit("https://example.org/search?q="), text.quoted_url(phrase))
    return table(spark, d, "documents").select("doc_id", phrase.alias("phrase"), url.alias("url"), text.token_estimate(F.col("text")).alias("estimate"), md5(text.clipped(F.col("text"))).alias("clip_md5"))


MID_WINDOW = f"""
WITH w AS (SELECT doc_id, text, {word_list('text')} AS w FROM documents),
     p AS (SELECT *, array_to_string(list_slice(w, CAST(greatest(0, floor((len(w) - 7) / 2)) AS BIGINT) + 1, CAST(greatest(0, floor((len(w) - 7) / 2)) AS BIGINT) + 7), ' ') AS phrase FROM w)
SELECT doc_id, phrase, 'https://example.org/search?q=' || replace(url_encode(phrase), '%2F', '/') AS url,
       CAST(floor(length(text) * CAST(1.06 AS DOUBLE)) + 2 AS BIGINT) AS estimate, md5(replace(left(text, 420), '"', '''')) AS clip_md5 FROM p"""

#: Grade strings for the labelled documents: by quality, toxicity and source; every branch of the tables occurs.
GRADES = ("Sahih", "Hasan", "Daif", "Very Daif", "Sahih Isnaad", "Hasan Sahih", "Mawdu", "Daif Munkar", "Sahih Mauquf", "Isnaad Daif", "Unrated", "-", "Batil upon Hadith")


def _graded(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    at = F.pmod(F.col("doc_id") + 3 * F.col("quality") + 5 * F.col("toxic"), F.lit(len(GRADES))).cast("int")
    return docs.withColumn("grade", F.get(F.array(*map(F.lit, GRADES)), at))


_GRADED = f"SELECT d.doc_id, d.source, l.quality, l.toxic, list_extract({list(GRADES)!r}, CAST((d.doc_id + 3 * l.quality + 5 * l.toxic) % {len(GRADES)} AS BIGINT) + 1) AS grade FROM documents d JOIN labels l USING (doc_id)"


def severity_map(spark: SparkSession, d: str) -> DataFrame:
    g = F.col("grade")
    rows = _graded(spark, d).select("doc_id", "grade", grades.label(g).alias("label"), grades.severity(g).alias("severity"), grades.scope(g).alias("scope"))
    return rows.withColumn("action", grades.action(F.col("severity")))


def _map_sql(values: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}"


def _severity_sql() -> str:
    cases = " ".join(f"WHEN list_has_any(low, {list(v)!r}) THEN '{k}'" for k, v in grades.CLASSES.items())
    return f"""
WITH g AS ({_GRADED}), t AS (SELECT doc_id, grade, regexp_extract_all(grade, '[a-zA-Z]+') AS t, list_transform(regexp_extract_all(grade, '[a-zA-Z]+'), lambda x: lower(x)) AS low FROM g),
     s AS (SELECT *, CASE {cases} ELSE 'unknown' END AS severity FROM t)
SELECT doc_id, grade, CASE WHEN trim(grade) IN ('', '-') THEN NULL ELSE coalesce({_map_sql(grades.PHRASES)}[array_to_string(low, ' ')],
         array_to_string(list_transform(t, lambda x: coalesce({_map_sql(grades.TERMS)}[lower(x)], x)), ' ')) END AS label,
       severity, CASE WHEN list_has_any(low, ['isnaad', 'sanad']) THEN 'isnaad' ELSE 'hadith' END AS scope, {_map_sql(grades.ACTIONS)}[severity] AS action
FROM s"""


def term_coverage(spark: SparkSession, d: str) -> DataFrame:
    each = _graded(spark, d).select("source", F.explode(grades.terms(F.col("grade"))).alias("t"))
    return each.groupBy("source").agg(F.count_if(F.lower("t").isin(*grades.TERMS)).alias("known"), F.count(F.lit(1)).alias("total"))


TERM_COVERAGE = f"""
WITH g AS ({_GRADED}), e AS (SELECT source, unnest(regexp_extract_all(grade, '[a-zA-Z]+')) AS t FROM g)
SELECT source, count(*) FILTER (lower(t) IN {tuple(grades.TERMS)!r}) AS known, count(*) AS total FROM e GROUP BY source"""

#: Free rulings, one for each branch, and their normal forms' classes.
RULINGS = ("سكت عنه", "موضوع", "لا يصح", "ليس بصحيح", "إسناده ضعيف", "صحيح", "على شرط مسلم", "حسن", "غريب", "")


def free_rulings(spark: SparkSession, d: str) -> DataFrame:
    at = F.pmod("doc_id", F.lit(len(RULINGS))).cast("int")
    rows = table(spark, d, "labels").select("doc_id", F.get(F.array(*map(F.lit, RULINGS)), at).alias("ruling"))
    return rows.select(grades.severity_of_ruling(F.col("ruling")).alias("severity")).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


FREE_RULINGS = f"""
WITH r AS (SELECT CAST(doc_id % {len(RULINGS)} AS BIGINT) AS k FROM labels)
SELECT list_extract(['none', 'mawdu', 'daif', 'daif', 'daif', 'sahih', 'sahih', 'hasan', 'unknown', 'unknown'], k + 1) AS severity, count(*) AS n FROM r GROUP BY 1"""


def preferred_pick(spark: SparkSession, d: str) -> DataFrame:
    """Line items stand for graders of an order: supplier as the grader, return flag as the grade ('N' is no ruling)."""
    g = F.struct(F.col("l_linenumber").alias("nth"), F.concat(F.lit("s"), F.pmod("l_suppkey", F.lit(5))).alias("grader"), F.nullif(F.col("l_returnflag"), F.lit("N")).alias("grade"))
    orders = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.array_sort(F.collect_list(g)).alias("g"))
    picked, main = grades.pick_grade(F.col("g"), "s1"), grades.main_grader(F.col("g"), "s2", F.lit("A"))
    return orders.select("order_id", picked["grader"].alias("grader"), picked["grade"].alias("grade"), main["grader"].alias("main_grader"), main["grade"].alias("main_grade"))


PREFERRED_PICK = """
WITH g AS (SELECT l_orderkey AS order_id, l_linenumber AS nth, 's' || (l_suppkey % 5) AS grader, nullif(l_returnflag, 'N') AS grade FROM lineitem),
     p AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY CASE WHEN grade IS NULL THEN 2 WHEN grader = 's1' THEN 0 ELSE 1 END, nth, grader, grade NULLS FIRST) AS a,
                  row_number() OVER (PARTITION BY order_id ORDER BY CASE WHEN grade = 'A' AND grader = 's2' THEN 0 WHEN grade = 'A' THEN 1 ELSE 2 END, nth, grader, grade NULLS FIRST) AS b FROM g)
SELECT o.order_id, CASE WHEN x.grade IS NOT NULL THEN x.grader END AS grader, x.grade AS grade, y.grader AS main_grader, y.grade AS main_grade
FROM (SELECT DISTINCT order_id FROM g) o JOIN p x ON x.order_id = o.order_id AND x.a = 1 JOIN p y ON y.order_id = o.order_id AND y.b = 1"""


def citation_parse(spark: SparkSession, d: str) -> DataFrame:
    """References spelt from orders in three forms; the parser has to give them back."""
    o = F.col("o_orderkey")
    ref = F.format_string("surah %d:%d", F.pmod(o, F.lit(114)) + 1, F.pmod(o, F.lit(7)) + 1)
    query = F.when(o % 3 == 0, ref).when(o % 3 == 1, F.concat(ref, F.lit(" - "), (F.pmod(o, F.lit(7)) + 3).cast("string"))).otherwise(F.format_string("bukhari no %d", o))
    c = parse.citation(F.col("query"))
    rows = table(spark, d, "orders").select("o_orderkey", query.alias("query"))
    return rows.select("o_orderkey", c["chapter"].alias("chapter"), c["first"].alias("first"), c["last"].alias("last"), F.size(c["numbers"]).cast("long").alias("n_numbers"))


CITATION_PARSE = """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderkey % 114 + 1 AS BIGINT) END AS chapter, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderkey % 7 + 1 AS BIGINT) END AS first,
       CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey % 7 + 1 AS BIGINT) WHEN 1 THEN CAST(o_orderkey % 7 + 3 AS BIGINT) END AS last,
       CAST(CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS BIGINT) AS n_numbers FROM orders"""


def json_props(spark: SparkSession, d: str) -> DataFrame:
    keys = F.json_object_keys("props")
    return table(spark, d, "events").select("event_type", F.explode(keys).alias("key")).groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"))


JSON_PROPS = "SELECT event_type, key, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS key FROM events) GROUP BY 1, 2"

QUERIES = {f.__name__: f for f in (norm_tokens, light_stem_vocab, lang_detect, html_strip, html_extract, clean_edges, mid_window, severity_map, term_coverage, free_rulings, preferred_pick, citation_parse, json_props)}
ORACLES = {
    "norm_tokens": NORM_TOKENS, "light_stem_vocab": _light_stem_sql(), "lang_detect": _lang_detect_sql(), "html_strip": HTML_STRIP, "html_extract": HTML_EXTRACT,
    "clean_edges": CLEAN_EDGES, "mid_window": MID_WINDOW, "severity_map": _severity_sql(), "term_coverage": TERM_COVERAGE, "free_rulings": FREE_RULINGS,
    "preferred_pick": PREFERRED_PICK, "citation_parse": CITATION_PARSE, "json_props": JSON_PROPS,
}
