"""Citations looked up rather than searched: chapter and verses, book and number, a chapter named on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.functions.parse import CITED
from quern.functions.text import last_number, normalize, tokens, western_digits
from quern.operators.sizes import if_small

MOST_VERSES = 20
# Words that may stand around a reference without changing it, words for a chapter, names of books.
ASKING = "اعطني عطني ابي ابغي هات وش ايش نص اعرض اقرا ما هي لي فسر تفسير اشرح شرح".split()
VERSE_FILLER = ASKING + "سوره السوره سورت ايه الايه ايات الايات رقم من الي في و قران القران الكريم quran qur an koran surah sura surat ayah ayat aya verse verses chapter from to of the al and".split()
CHAPTER_WORDS = "سوره السوره surah sura surat chapter".split()
BOOK_FILLER = ASKING + "حديث الحديث رقم رواه اخرجه في صحيح سنن جامع الجامع كتاب الامام عند hadith hadeeth hadis number no num nr sahih saheeh sunan jami al at an as the in of imam narrated by ref reference book".split()
NAMED_FILLER = "اقرا ابي ابغي عطني اعطني هات وش ايش اعرض نص كامله كلها ابحث عن".split()
BOOK_NAMES = {
    "bukhari": ("البخاري", "بخاري", "bukhari", "albukhari", "bukhary"),
    "muslim": ("مسلم", "muslim"),
    "abudawud": ("أبو داود", "أبي داود", "ابوداود", "abu dawud", "abu dawood", "abu daud", "abi dawud", "abudawud", "abu dawoud"),
    "tirmidhi": ("الترمذي", "ترمذي", "tirmidhi", "tirmizi", "tirmithi"),
    "nasai": ("النسائي", "نسائي", "nasai", "nasa i", "nisai", "nasaee"),
    "ibnmajah": ("ابن ماجه", "ابن ماجة", "ibn majah", "ibn maja", "ibnmajah", "ibn majjah"),
}
_DECIMAL = r"^[0-9]+$"


def _words(values) -> Column:
    return F.array(*map(F.lit, values))


def parsed(queries: DataFrame) -> DataFrame:
    """query_id, query with nums (numbers in order), rest (other words), chapter, first, last of an explicit reference."""
    q = western_digits(F.coalesce("query", F.lit("")))
    words = tokens(F.lower(normalize(q)))
    part = lambda k: F.regexp_extract(q, CITED, k).try_cast("int")
    return queries.select(
        "query_id", "query", F.transform(F.filter(words, lambda w: w.rlike(_DECIMAL)), lambda w: w.try_cast("int")).alias("nums"), F.filter(words, lambda w: ~w.rlike(_DECIMAL)).alias("rest"),
        part(1).alias("chapter"), part(2).alias("first"), F.coalesce(part(3), part(2)).alias("last"),
    )


def named(parsed_queries: DataFrame, names: DataFrame, filler: list[str]) -> DataFrame:
    """query_id, value: the longest name (array of at most 3 words) in the rest of a query around which all is filler."""
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size("rest"), F.lit(1))), lambda i: i + n - 1 <= F.size("rest")), lambda i: F.struct(n.alias("n"), i.alias("i"), F.array_join(F.slice("rest", i, n), " ").alias("name"), F.concat(F.slice("rest", F.lit(1), i - 1), F.slice("rest", i + n, F.size("rest"))).alias("around")))))
    tries = parsed_queries.where(F.size("rest") > 0).select("query_id", F.explode(spans).alias("s")).select("query_id", "s.*").where(F.size(F.array_except("around", _words(filler))) == 0)
    hits = tries.join(if_small(names), "name")
    order = W.partitionBy("query_id").orderBy(F.col("n").desc(), "i", "value")
    return hits.withColumn("k", F.row_number().over(order)).where("k = 1").select("query_id", "value")


def chapter_names(records: DataFrame) -> DataFrame:
    """name, value (chapter) of the verses' chapters, also without the article. There are few chapters."""
    rows = records.where("kind = 'ayah'").select("surah", F.lower(normalize(F.col("surah_name"))).alias("name")).distinct().where("name <> ''")
    first = F.element_at(F.split("name", " "), 1)
    bare = rows.where(first.startswith("ال") & (F.length(first) > 3)).select("surah", F.expr("substr(name, 3)").alias("name"))
    return rows.select("surah", "name").union(bare).groupBy("name").agg(F.max("surah").alias("value"))


def lookup(queries: DataFrame, records: DataFrame) -> DataFrame:
    """query_id, id, place: the records that a reference names; queries without one have no row.

    `records`: id, kind, surah, surah_name, ayah, collection_key, ref. A range of verses is all or nothing.
    """
    p = parsed(queries).where((F.size("nums") > 0) & (F.size("nums") <= 3))
    by_name = named(p, chapter_names(records), VERSE_FILLER).withColumnRenamed("value", "named_chapter")
    books = p.sparkSession.createDataFrame([(n, k) for k, v in BOOK_NAMES.items() for n in v], "raw string, value string").select(F.lower(normalize(F.col("raw"))).alias("name"), "value").distinct()
    by_book = named(p, books, BOOK_FILLER).withColumnRenamed("value", "book")
    p = p.join(by_name, "query_id", "left").join(by_book, "query_id", "left")
    n, nums, explicit = F.size("nums"), F.col("nums"), F.col("chapter").isNotNull()
    all_filler = F.size(F.array_except("rest", _words(VERSE_FILLER))) == 0
    num = lambda k: F.get(nums, F.lit(k))
    has_name = F.col("named_chapter").isNotNull()
    second = has_name & (n == 2) & explicit & (num(0) == F.col("named_chapter"))
    words_say = (n == 2) & (F.size("rest") > 0) & all_filler & F.arrays_overlap("rest", _words(CHAPTER_WORDS))
    s = F.when(has_name & (n < 3), F.col("named_chapter")).when(~has_name & explicit & all_filler, F.col("chapter")).when(~has_name & words_say & F.col("book").isNull(), num(0))
    a = F.when(second, num(1)).when(has_name, num(0)).when(explicit & all_filler, F.col("first")).otherwise(num(1))
    b = F.when(second, num(1)).when(has_name, F.coalesce(num(1), num(0))).when(explicit & all_filler, F.col("last")).otherwise(num(1))
    asked = p.select("query_id", s.alias("surah"), a.alias("a"), b.alias("b")).where("surah is not null and a <= b and b - a < 20")
    spelt = asked.select("query_id", "surah", "a", "b", F.explode(F.sequence("a", "b")).alias("ayah"))
    hits = spelt.join(records.where("kind = 'ayah'").select("id", "surah", "ayah"), ["surah", "ayah"])
    w = W.partitionBy("query_id")
    whole = (F.min("ayah").over(w) == F.col("a")) & (F.max("ayah").over(w) == F.col("b"))
    verses = hits.withColumn("whole", whole).where("whole").select("query_id", "id", F.col("ayah").alias("place"))
    cited = records.where("kind = 'hadith'").select("id", F.col("collection_key").alias("book"), last_number(F.col("ref")).try_cast("int").alias("number"))
    book_asked = p.where(F.col("book").isNotNull() & ~has_name & ~(explicit & all_filler) & (n == 1)).select("query_id", "book", num(0).alias("number"))
    found = book_asked.join(cited, ["book", "number"]).select("query_id", "id", F.row_number().over(W.partitionBy("query_id").orderBy("id")).alias("place"))
    return verses.unionByName(found)


def named_chapter(queries: DataFrame, records: DataFrame, request_words: list[str]) -> DataFrame:
    """query_id, id, place: the verses, in order, of a chapter named after a word for chapter, all else being filler."""
    words = tokens(normalize(F.coalesce("query", F.lit(""))))
    at = F.array_position("w", "سوره")
    at = F.when(at > 0, at).otherwise(F.array_position("w", "السوره"))
    rows = queries.select("query_id", words.alias("w")).withColumn("at", at.cast("int")).where("at > 0")
    tries = rows.select("query_id", "w", "at", F.explode(F.array(F.lit(2), F.lit(1))).alias("n")).where(F.size("w") >= F.col("at") + F.col("n"))
    around = F.concat(F.slice("w", F.lit(1), F.col("at") - 1), F.slice("w", F.col("at") + F.col("n") + 1, F.size("w")))
    tries = tries.select("query_id", "n", F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ").alias("name"), around.alias("around")).where(F.size(F.array_except("around", _words([*NAMED_FILLER, *request_words]))) == 0)
    hit = tries.join(if_small(chapter_names(records)), "name").groupBy("query_id").agg(F.max_by("value", "n").alias("surah"))
    return hit.join(records.where("kind = 'ayah'").select("id", "surah", "ayah"), "surah").select("query_id", "id", F.col("ayah").alias("place"))
