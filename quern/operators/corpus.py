"""Corpus building: records of verses and of reports from their editions, integrity checks, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import grades, parse
from quern.functions.text import clean_display, muslim_citation, normalize, surface_text
from quern.operators.tables import misaligned
from quern.operators.sizes import if_small

LEAST_SURFACE = 8
VERSE_GRADE = "قرآن كريم"
INHERENT, CITED, NONE = "inherent", "cited", "none"


def surfaces(translations: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, surfaces, translations: maps by language of (keys, lang, text) with texts of some length."""
    good = translations.withColumn("text", F.trim("text")).where(F.length("text") >= LEAST_SURFACE)
    rows = good.select(*keys, "lang", "text", surface_text(F.col("lang"), F.col("text")).alias("surface"))
    one = rows.groupBy(*keys, "lang").agg(F.min("text").alias("text"), F.min("surface").alias("surface"))
    entry = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", c))))
    return one.groupBy(*keys).agg(entry("surface").alias("surfaces"), entry("text").alias("translations"))


def verses(shown: DataFrame, matched: DataFrame, chapters: DataFrame, translated: DataFrame) -> DataFrame:
    """Records of verses: shown and matched editions (chapter, verse, text), chapters (id, name, verses), surfaces by (chapter, verse).

    The build fails if the editions are not aligned or a chapter has another number of verses than it should.
    """
    off = misaligned(shown, matched, ["chapter", "verse"])
    if off.limit(1).count():
        raise ValueError(f"editions are not aligned: {off.take(5)}")
    seen = shown.groupBy("chapter").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("chapter", "id")
    wrong = chapters.join(seen, "id", "full_outer").where(~F.coalesce(F.col("n") == F.col("verses"), F.lit(False)))
    if wrong.limit(1).count():
        raise ValueError(f"chapters with another number of verses: {wrong.take(5)}")
    rows = shown.join(matched.select("chapter", "verse", F.col("text").alias("match")), ["chapter", "verse"]).join(if_small(chapters.select(F.col("id").alias("chapter"), "name")), "chapter")
    rows = rows.join(translated, ["chapter", "verse"], "left")
    ref = F.concat_ws(": ", "name", "verse")
    return rows.select(
        F.concat_ws(":", F.lit("quran"), "chapter", "verse").alias("id"), F.lit("ayah").alias("kind"), F.lit("quran").alias("collection_key"),
        F.col("chapter").cast("int").alias("surah"), F.col("name").alias("surah_name"), F.col("verse").cast("int").alias("ayah"), ref.alias("ref"),
        clean_display(F.col("text")).alias("text"), clean_display(F.col("text")).alias("matn"), normalize(F.col("match")).alias("match_text"),
        F.coalesce("surfaces", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("surfaces"), "translations",
        F.lit(VERSE_GRADE).alias("grade"), F.lit("quran").alias("grade_basis"), F.lit("quran").alias("severity"), F.lit("safe_to_cite").alias("action"), F.lit("ayah").alias("scope"),
    )


def reports(edition: DataFrame, key: str, name: str, inherent: bool, translated: DataFrame, preferred: str, cited_by_second_number: bool = False) -> DataFrame:
    """Records of one book: hadithnumber, arabicnumber, text, book, section, grades -> records; empty texts are left out.

    A book whose reports are sound by inclusion grants that grade, but not to its introduction.
    """
    c = F.col
    rows = edition.withColumn("s", parse.split_chain(c("text"))).where((c("s.rule") != "empty") & (normalize(c("s.body")) != ""))
    cite = muslim_citation(c("hadithnumber").try_cast("int"), F.nullif(c("arabicnumber"), F.lit("")))
    number = cite["number"].cast("string") if cited_by_second_number else c("hadithnumber")
    intro = cite["intro"] if cited_by_second_number else F.lit(False)
    given = F.transform(F.filter(F.coalesce("grades", F.array().cast("array<struct<name:string,grade:string>>")), lambda g: F.coalesce(g["grade"], F.lit("")) != ""), lambda g: F.struct(g["name"].alias("grader"), g["grade"].alias("grade"), grades.label(g["grade"]).alias("label")))
    rows = rows.withColumns({"graders": given, "intro": intro}).withColumn("picked", grades.pick_grade(c("graders"), preferred)["grade"])
    raw = F.when(c("intro"), "").when(F.lit(inherent), "Sahih").otherwise(c("picked"))
    basis = F.when(c("intro"), NONE).when(F.lit(inherent), INHERENT).when(c("picked").isNull(), NONE).otherwise(CITED)
    rows = rows.withColumns({"grade_raw": raw, "grade_basis": basis}).withColumn("severity", F.when(c("grade_basis") == NONE, "unknown").otherwise(grades.severity(c("grade_raw"))))
    rows = rows.withColumn("k", F.concat_ws(":", F.lit(key), "hadithnumber")).join(translated.withColumnRenamed("hadithnumber", "_n"), c("hadithnumber") == c("_n"), "left")
    return rows.select(
        c("k").alias("id"), F.lit("hadith").alias("kind"), F.lit(name).alias("collection"), F.lit(key).alias("collection_key"),
        c("hadithnumber").alias("number"), c("arabicnumber").alias("arabic_number"), c("book"), c("section"), F.when(c("intro"), F.lit(name)).otherwise(F.concat(F.lit(name + " ("), number, F.lit(")"))).alias("ref"),
        clean_display(c("text")).alias("text"), clean_display(c("s.chain")).alias("sanad"), clean_display(c("s.body")).alias("matn"), normalize(c("s.body")).alias("match_text"), c("s.rule").alias("split_rule"),
        grades.label(c("grade_raw")).alias("grade"), "grade_raw", "grade_basis", "severity", grades.action(c("severity")).alias("action"),
        F.when(c("grade_basis") == CITED, grades.scope(c("grade_raw"))).otherwise("hadith").alias("scope"), "graders", "surfaces", "translations",
    )


def statistics(records: DataFrame) -> DataFrame:
    """what, key, n: records by kind, collection, split rule and grade basis; records with a surface in each language."""
    parts = [records.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("what"), "key", "n") for c in ("kind", "collection_key", "split_rule", "grade_basis")]
    langs = records.select(F.explode(F.map_keys("surfaces")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(F.lit("surface").alias("what"), "key", "n")
    out = langs
    for p in parts:
        out = out.unionByName(p)
    return out


LABELS = {"rawi": "الراوي", "muhaddith": "المحدث", "source": "المصدر", "page": "الصفحة أو الرقم", "ruling": "خلاصة حكم المحدث"}  # fixed values: labels of a result page


def harvested(html: Column) -> Column:
    """array<struct<text, rawi, muhaddith, source, page, ruling>> from a page of results: div.hadith and the info block behind it."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?s)<div[^>]*class="hadith"[^>]*>.*?(?=<div[^>]*class="hadith"|\z)'), 0)
    strip = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"\s+", " "))

    def one(b: Column) -> Column:
        said = F.regexp_extract(b, r'(?s)<div[^>]*class="hadith"[^>]*>(.*?)</div>', 1)
        info = F.regexp_replace(F.regexp_replace(F.regexp_extract(b, r'(?s)class="hadith-info"[^>]*>(.*)', 1), "(?i)<br */?>|</(?:div|p|span)>", "\n"), "<[^>]+>", "")
        field = lambda label: F.nullif(strip(F.regexp_extract(info, rf"(?m)^\s*{label}\s*:?\s*([^\n]*)", 1)), F.lit(""))
        return F.struct(F.regexp_replace(strip(said), r"^\d+\s*-\s*", "").alias("text"), *[field(v).alias(k) for k, v in LABELS.items()])

    return F.transform(blocks, one)


def same_record(source: Column, page: Column, token: Column, number: Column) -> Column:
    """Whether a harvested ruling is about our record: the collection's name in its source, our number as its page or within it."""
    quoted = F.concat(F.lit(r"(^|\D)\Q"), number, F.lit(r"\E($|\D)"))
    return normalize(source).contains(normalize(token)) & ((F.trim(page) == number) | F.regexp(page, quoted))


def crosschecked(records: DataFrame, hits: DataFrame) -> DataFrame:
    """The columns of records (id, token, number, ...) and hits (hit_id, source, page, ...) of which a hit is about the record.

    The predicate is same_record(). A number that it finds on a page is one of the page's runs of digits, whole, or the page itself; so
    records and hits meet by equality of those, and the predicate decides: no record meets every hit.
    """
    runs = lambda c: F.regexp_extract_all(c, F.lit(r"\d+"), 0)
    number = F.coalesce("number", F.lit(""))
    ours = records.withColumn("_key", F.coalesce(F.get(runs(number), F.lit(0)), number))
    page = F.coalesce("page", F.lit(""))
    theirs = hits.withColumn("_key", F.explode(F.array_distinct(F.concat(runs(page), F.array(F.trim(page))))))
    same = same_record(F.coalesce("source", F.lit("")), page, F.col("token"), number)
    return ours.join(theirs, "_key").where(same & (number != "")).drop("_key").dropDuplicates(["id", "hit_id"])


def agreement(matched: DataFrame, ours: str, theirs: str) -> DataFrame:
    """`ours`, `theirs`, n: how often each pair of rulings meets; the matrix in long form."""
    return matched.groupBy(ours, theirs).agg(F.count(F.lit(1)).alias("n"))
