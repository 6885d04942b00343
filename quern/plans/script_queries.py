"""Queries over Arabic-script forms, parsers, citations and harvested pages, on rows made from the tables.

The documents hold no Arabic, so their letters are written as Arabic ones, marks and variants among them. What the parsers are
to find is put around the documents' words, the orders' keys and the parts' numbers; the SQL makes the same parts and says what
has to come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import grades, parse, text
from quern.operators import answers, corpus, lookup
from quern.operators.lexical import words
from quern.plans.text_queries import ARABIC_LETTERS, LATIN_LETTERS, md5, word_list
from quern.sources.files import table

LATIN, ARABIC = "abcdefghijklmnopqrstuvwxyz", "َبتنهويلإكمسعرىقدحجشةصئظآخ"


def _arabic(c) -> F.Column:
    return F.translate(F.lower(c), LATIN, ARABIC)


_ARABIC_SQL = f"translate(lower(text), '{LATIN}', '{ARABIC}')"


def _kept_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate({c}, '{text.ALEF_VARIANTS[0]}', '{text.ALEF_VARIANTS[1]}'), '[^ء-ي٠-٩a-zA-Z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


_VISIBLE_SQL = f"translate({_ARABIC_SQL}, '{text.INVISIBLE}', '')"


def arabic_forms(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("a")
    md5 = lambda c: F.md5(c.cast("binary"))
    rows = table(spark, d, "documents").select("doc_id", _arabic(F.col("text")).alias("a"))
    return rows.select("doc_id", md5(text.fold(a)).alias("folded"), md5(text.normalize(a)).alias("normal"), md5(text.plain(a)).alias("plain"), md5(text.surface_text(F.lit("ar"), a)).alias("surface"), text.mostly_arabic(a).alias("mostly_arabic"))


_FOLDED_SQL = f"translate({_VISIBLE_SQL}, '{text.FOLD[0]}', '{text.FOLD[1]}')"
ARABIC_FORMS = f"""SELECT doc_id, md5(translate({_ARABIC_SQL}, '{text.FOLD[0]}', '{text.FOLD[1]}')) AS folded, md5({_kept_sql(_FOLDED_SQL)}) AS normal, md5({_kept_sql(_VISIBLE_SQL)}) AS plain, md5({_kept_sql(_FOLDED_SQL)}) AS surface,
  coalesce(len(regexp_extract_all({_ARABIC_SQL}, '[؀-ۿ]')) / nullif(len(regexp_extract_all({_ARABIC_SQL}, '[\\p{{L}}\\p{{N}}\\p{{M}}_]')), 0) > 0.5, false) AS mostly_arabic FROM documents"""


TAIL = "في هذا الكتاب كله"  # behind each body, so that none is too short to be one
NAMES = ("زيد", "عمرو")


def _spoken(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, a, b (two names), body: the first words of each document in Arabic letters, without marks."""
    w = words(F.translate(F.lower("text"), LATIN_LETTERS, ARABIC_LETTERS))
    nth = lambda k: F.coalesce(F.get("w", F.lit(k)), F.lit(NAMES[k]))
    rows = table(spark, d, "documents").select("doc_id", w.alias("w"))
    return rows.select("doc_id", nth(0).alias("a"), nth(1).alias("b"), F.concat_ws(" ", F.array_join(F.slice("w", 1, 20), " "), F.lit(TAIL)).alias("body"))


_W_SQL = word_list(f"translate(lower(text), '{LATIN_LETTERS}', '{ARABIC_LETTERS}')")
_SPOKEN_SQL = f"sw AS (SELECT doc_id, {_W_SQL} AS w FROM documents), sp AS (SELECT doc_id, coalesce(w[1], '{NAMES[0]}') AS a, coalesce(w[2], '{NAMES[1]}') AS b, array_to_string(w[1:20], ' ') || ' {TAIL}' AS body FROM sw)"

#: For each rule the text before a body and behind it, and how much of both the parser has to give to the body.
CHAINS = {
    "prophet_speech": ("حدثنا {a} عن {b} أن رسول الله صلى الله عليه وسلم قال:", "", " ", ""),
    "quote": ("حدثنا {a} عن {b}", '"', ' "', '"'),
    "an_prophet": ("حدثنا {a} عن {b}", "ان النبي دخل ", " ان النبي دخل ", ""),
    "after_chain": ("اخبرنا {a} قال حدثنا {b} قال", "", " ", ""),
    "unsplit": ("", "", "", ""),
}
REMARKS = ("قال أبو عيسى هذا حديث حسن", "وفي الباب عن {a} و{b}")


def _put(template: str) -> F.Column:
    return text.filled(template, a=F.col("a"), b=F.col("b"))


def _put_sql(template: str) -> str:
    return f"replace(replace('{template}', '{{a}}', a), '{{b}}', b)"


def _by_turn(turns: list[F.Column]) -> F.Column:
    return F.element_at(F.array(*turns), (F.col("doc_id") % len(turns) + 1).cast("int"))


def chain_split(spark: SparkSession, d: str) -> DataFrame:
    """Five ways in which a body may begin, and a blank text, put around the documents' words."""
    spelt = [F.concat(_put(chain), F.lit(between), F.col("body"), F.lit(end)) for chain, _, between, end in CHAINS.values()]
    rows = _spoken(spark, d).withColumn("s", parse.split_chain(_by_turn([*spelt, F.lit(" ")])))
    return rows.select("doc_id", "s.chain", md5(F.col("s.body")).alias("body_md5"), "s.rule")


def _turns_sql(values: list[str]) -> str:
    return f"CASE doc_id % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


CHAIN_SPLIT = f"""WITH {_SPOKEN_SQL} SELECT doc_id, {_turns_sql([_put_sql(c) for c, *_ in CHAINS.values()] + ["''"])} AS chain,
  md5({_turns_sql([f"'{mine}' || body || '{end}'" for _, mine, _, end in CHAINS.values()] + ["''"])}) AS body_md5, {_turns_sql([f"'{k}'" for k in (*CHAINS, 'empty')])} AS rule FROM sp"""


def remark_split(spark: SparkSession, d: str) -> DataFrame:
    """A compiler's remark behind a body, one before it (where too little is left of the body), and none."""
    body = F.col("body")
    spelt = [*[F.concat(body, F.lit(". "), _put(r)) for r in REMARKS], F.concat(F.lit("قال أبو داود "), body), body]
    rows = _spoken(spark, d).withColumn("s", parse.split_remark(_by_turn(spelt)))
    return rows.select("doc_id", md5(F.col("s.core")).alias("core_md5"), "s.remark")


REMARK_SPLIT = f"""WITH {_SPOKEN_SQL} SELECT doc_id, md5({_turns_sql(["body", "body", "'قال أبو داود ' || body", "body"])}) AS core_md5,
  {_turns_sql([_put_sql(r) for r in REMARKS] + ["''", "''"])} AS remark FROM sp"""


def display_forms(spark: SparkSession, d: str) -> DataFrame:
    """Quotes, stops, direction marks and blanks around the documents' words; numbers in brackets behind some."""
    number = F.concat(F.lit(" ("), F.col("doc_id").cast("string"), F.lit(")"))
    shown = _by_turn([F.concat(F.lit("  «"), "body", F.lit("».")), F.concat("body", number), F.concat(F.lit("\u200f\""), F.col("body"), F.lit("\"؛ ")), F.lit(None).cast("string")])
    rows = _spoken(spark, d).withColumn("t", shown)
    return rows.select("doc_id", md5(text.clean_display(F.col("t"))).alias("shown_md5"), text.last_number(F.col("t")).alias("number"))


DISPLAY_FORMS = f"""WITH {_SPOKEN_SQL} SELECT doc_id, md5({_turns_sql(["body", "body || ' (' || doc_id || ')'", "body", "''"])}) AS shown_md5, CASE WHEN doc_id % 4 = 1 THEN CAST(doc_id AS VARCHAR) END AS number FROM sp"""

PER_CHAPTER, DIGITS = 100, "ابتثجحخدذر"
_BOOK_KEYS = tuple(lookup.BOOK_NAMES)


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Parts as verses, a hundred of them a chapter, whose name spells its number; suppliers as reports of six books."""
    surah = F.floor(F.col("p_partkey") / PER_CHAPTER).cast("int") + 1
    name = F.concat(F.lit("ال"), F.translate(surah.cast("string"), "0123456789", DIGITS))
    ayah = (F.col("p_partkey") % PER_CHAPTER + 1).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    verses = table(spark, d, "part").select(F.concat_ws(":", F.lit("quran"), surah, ayah).alias("id"), F.lit("ayah").alias("kind"), surah.alias("surah"), name.alias("surah_name"), ayah.alias("ayah"), F.lit("quran").alias("collection_key"), F.concat_ws(": ", name, ayah).alias("ref"))
    book = F.element_at(F.array(*map(F.lit, _BOOK_KEYS)), (F.col("s_suppkey") % len(_BOOK_KEYS) + 1).cast("int"))
    number = F.col("s_suppkey").cast("string")
    reports = table(spark, d, "supplier").select(F.concat_ws(":", book, number).alias("id"), F.lit("hadith").alias("kind"), none("int").alias("surah"), none("string").alias("surah_name"), none("int").alias("ayah"), book.alias("collection_key"), F.concat(book, F.lit(" ("), number, F.lit(")")).alias("ref"))
    return verses.unionByName(reports)


_VERSES_SQL = f"vs AS (SELECT p_partkey // {PER_CHAPTER} + 1 AS s, p_partkey % {PER_CHAPTER} + 1 AS a FROM part)"


def citation_lookup(spark: SparkSession, d: str) -> DataFrame:
    """References spelt from the orders' keys: a verse, a range of up to five, a named chapter's verse, a book's number, none."""
    o = F.col("o_orderkey")
    s, a = (o % 40 + 1).cast("string"), (o % 97 + 1).cast("string")
    named = F.concat(F.lit("سورة ال"), F.translate(s, "0123456789", DIGITS), F.lit(" آية "), a)
    spelt = [F.concat_ws(":", s, a), F.concat(F.lit("surah "), s, F.lit(":"), a, F.lit("-"), (o % 97 + 1 + o % 5).cast("string")), named, F.concat(F.lit("bukhari no "), (o % 60).cast("string")), F.lit("كلام عن الصبر")]
    query = F.element_at(F.array(*spelt), (F.floor(o / 2) % 5 + 1).cast("int"))
    asked = table(spark, d, "orders").select(o.alias("query_id"), query.alias("query"))
    return lookup.lookup(asked, _records(spark, d)).select("query_id", "id")


CITATION_LOOKUP = f"""WITH {_VERSES_SQL}, q AS (SELECT o_orderkey AS query_id, CAST(floor(o_orderkey / 2) AS BIGINT) % 5 AS t, o_orderkey % 40 + 1 AS s, o_orderkey % 97 + 1 AS a, o_orderkey % 97 + 1 + CASE WHEN CAST(floor(o_orderkey / 2) AS BIGINT) % 5 = 1 THEN o_orderkey % 5 ELSE 0 END AS b, o_orderkey % 60 AS n FROM orders)
SELECT query_id, 'quran:' || q.s || ':' || vs.a AS id FROM q JOIN vs ON vs.s = q.s AND vs.a BETWEEN q.a AND q.b WHERE t < 3 AND (SELECT count(*) FROM vs e WHERE e.s = q.s AND e.a IN (q.a, q.b)) = CASE WHEN q.a = q.b THEN 1 ELSE 2 END
UNION ALL SELECT query_id, 'bukhari:' || s_suppkey FROM q JOIN supplier ON s_suppkey = n AND s_suppkey % {len(_BOOK_KEYS)} = 0 WHERE t = 3"""


def chapter_named(spark: SparkSession, d: str) -> DataFrame:
    """Chapters named on their own, with a word too many, and without the word for chapter; by the customers' keys."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("ال"), F.translate((k % 30 + 1).cast("string"), "0123456789", DIGITS))
    spelt = [F.concat(F.lit("اقرأ سورة "), name), F.concat(F.lit("سورة "), name, F.lit(" والصبر")), name, F.concat(F.lit("سورة "), name)]
    asked = table(spark, d, "customer").select(k.alias("query_id"), F.element_at(F.array(*spelt), (k % 4 + 1).cast("int")).alias("query"))
    return lookup.named_chapter(asked, _records(spark, d), ["ايه"]).select("query_id", F.col("place").cast("long").alias("place"), "id")


CHAPTER_NAMED = f"WITH {_VERSES_SQL} SELECT c_custkey AS query_id, a AS place, 'quran:' || s || ':' || a AS id FROM customer JOIN vs ON s = c_custkey % 30 + 1 WHERE c_custkey % 4 IN (0, 3)"

_RESULT = '<div class="hadith">{n} - <b>{body}</b></div><div class="hadith-info"><span>الراوي:</span> {a}<br><span>المصدر:</span> {source}<br>الصفحة أو الرقم: {n}</div>'
SOURCES = ("صحيح مسلم", "سنن الترمذي")


def harvest(spark: SparkSession, d: str) -> DataFrame:
    """Result pages made of the documents' words, two results a page and the second without facts, harvested and held against the
    documents' own numbers."""
    source = _by_turn([F.lit(x) for x in SOURCES])
    number = F.col("doc_id").cast("string")
    page = F.concat(text.filled(_RESULT, n=number, body=F.col("body"), a=F.col("a"), source=source), text.filled('<div class="hadith">2 - {b}</div>', b=F.col("b")))
    rows = _spoken(spark, d).select("doc_id", F.posexplode(corpus.harvested(F.when(F.col("doc_id") % 5 != 0, page).otherwise("<p>nothing</p>"))).alias("k", "g"))
    g = F.col("g")
    found = rows.select("doc_id", F.col("k").cast("long").alias("k"), md5(g["text"]).alias("text_md5"), g["rawi"].alias("rawi"), g["source"].alias("source"), g["page"].alias("page"))
    return found.withColumn("same", corpus.same_record(F.coalesce("source", F.lit("")), F.coalesce("page", F.lit("")), F.lit("مسلم"), F.col("doc_id").cast("string")).cast("long"))


HARVEST = f"""WITH {_SPOKEN_SQL}, on2 AS (SELECT *, {_turns_sql([f"'{x}'" for x in SOURCES])} AS src FROM sp WHERE doc_id % 5 <> 0)
SELECT doc_id, CAST(0 AS BIGINT) AS k, md5(body) AS text_md5, a AS rawi, src AS source, CAST(doc_id AS VARCHAR) AS page, CAST(CASE WHEN src = '{SOURCES[0]}' THEN 1 ELSE 0 END AS BIGINT) AS same FROM on2
UNION ALL SELECT doc_id, 1, md5(b), NULL, NULL, NULL, 0 FROM on2"""


def honest_answers(spark: SparkSession, d: str) -> DataFrame:
    """Whether a first hit does no harm to who asked for a document's first words: half of the hits hold them, some are graded weak; and
    the graders' names."""
    severity = F.when(F.col("toxic") == 1, "mawdu").when(F.col("quality") == 0, "daif").otherwise("sahih")
    rows = _spoken(spark, d).join(table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality")), "doc_id")
    phrase = F.concat_ws(" ", "a", "b")
    hit = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("قال: "), F.col("a"), F.lit("، "), F.col("b"), F.lit(" "), F.col("body"))).otherwise("شيء آخر")
    names = (*grades.GRADERS, "Nobody")
    grader = F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names) + 1).cast("int"))
    return rows.select("doc_id", answers.honest(hit, phrase, severity).cast("long").alias("honest"), grades.grader_label(grader).alias("grader"))


HONEST_ANSWERS = f"""WITH {_SPOKEN_SQL}, l AS (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY 1)
SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 OR toxic = 1 OR quality = 0 THEN 1 ELSE 0 END AS BIGINT) AS honest, {list((*grades.GRADERS.values(), "Nobody"))!r}[CAST(doc_id % {len(grades.GRADERS) + 1} AS BIGINT) + 1] AS grader FROM sp JOIN l USING (doc_id)"""

_PLAIN = (arabic_forms, chain_split, remark_split, display_forms, citation_lookup, chapter_named, harvest, honest_answers)
QUERIES = {f.__name__: f for f in _PLAIN}
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in _PLAIN}
