"""Functions and operators on hand-made rows."""

import hashlib
import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from quern.functions import grades, parse, text, vectors
from quern.operators import answers, corpus, decision, dedup, encode, fusion, index, lexical, lookup, search, service, tables
from quern.plans import answer_queries
from quern.sources import fetch, files
from quern.streaming import events


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(column).collect()]


def test_normal_forms(spark):
    rows = ["الْحَمْدُ", "ٱلۡحَمۡدُ لِلَّهِ", "أإآى ؤئة", "a-b_C ١٢", None, "  x y ", "ـــم‏"]
    assert values(spark, text.normalize(F.col("x")), rows) == ["الحمد", "الحمد لله", "اااي ويه", "a b C ١٢", "", "x y", "م"]
    assert values(spark, text.plain(F.col("x")), ["شيئًا نسائه ٱ"]) == ["شيئا نسائه ا"]
    assert values(spark, text.normalize_latin(F.col("x")), ["Été, L'ÂGE!", "İx", None]) == ["été l âge", "i̇x", ""]
    assert values(spark, text.clean_display(F.col("x")), [' "«قال: نعم».. ', "‏a  b‎", None, '""']) == ["قال: نعم", "a b", "", ""]
    assert values(spark, text.join_open_tanween(F.col("x")), ["صَبۡرࣰ ا", "بِنَآءࣰ وَأَنزَلَ"]) == ["صَبۡرࣰا", "بِنَآءࣰ وَأَنزَلَ"]
    assert values(spark, text.western_digits(F.col("x")), ["٢٥٥ ۱۲"]) == ["255 12"]


def test_stems(spark):
    pairs = {"والنوم": "نوم", "نومكم": "نوم", "وال": "وال", "لله": "لل", "الصلاه": "صلا", "كتابها": "كتاب", "مسلمون": "مسلم", "ولد": "ولد"}
    assert values(spark, text.light_stem(F.col("x")), list(pairs)) == list(pairs.values())
    assert values(spark, text.bare(F.col("x")), ["وبالحق", "واحد", "الا", "للناس"]) == ["حق", "واحد", "الا", "ناس"]


def test_detect(spark):
    rows = {"حديث عن الصبر": "ar", "یہ کیا ہے": "ur", "хадис о терпении": "ru", "ধৈর্য": "bn", "பொறுமை": "ta", "the verse of light": "en", "le verset sur la patience": "fr", "sabir ile ilgili bir ayet": "tr", "ayat yang tentang sabar": "id", "zzz": "en", "12": "ar", None: "ar"}
    assert values(spark, text.detect(F.col("x")), list(rows)) == list(rows.values())


def test_small_functions(spark):
    assert values(spark, text.middle(F.split("x", " "), 3), ["a b c d e f g", "a b", "a b c d"]) == ["c d e", "a b", "a b c"]
    assert values(spark, text.quoted_url(F.col("x")), ["a b/é+"]) == ["a%20b/%C3%A9%2B"]
    assert values(spark, text.last_number(F.col("x")), ["book (12) (34) ", "none"]) == ["34", None]
    got = values(spark, text.muslim_citation(F.col("a"), F.col("b")), [(153, "35.02"), (20, None), (300, None)], "a int, b string")
    assert [(r["number"], r["intro"]) for r in got] == [(35, False), (20, True), (300, False)]
    assert values(spark, text.mostly_arabic(F.col("x")), ["سلام a", "abc س", "", None]) == [True, False, False, False]


def test_grades(spark):
    rows = ["Very Daif", "Sahih Isnaad", "hasan foo", "-", None, "Sahih (Daif)", "Batil", "xyz"]
    assert values(spark, grades.severity(F.col("x")), rows) == ["daif", "sahih", "hasan", "unknown", "unknown", "daif", "mawdu", "unknown"]
    assert values(spark, grades.label(F.col("x")), rows)[:5] == ["ضعيف جدًا", "صحيح الإسناد", "حسن foo", None, None]
    assert values(spark, grades.scope(F.col("x")), rows)[:3] == ["hadith", "isnaad", "hadith"]
    free = {"ليس بصحيح": "daif", "لم يحكم عليه": "none", "باطل": "mawdu", "إسناده ضعيف": "daif", "صحيح": "sahih", "حسن": "hasan", "x": "unknown", None: "unknown"}
    assert values(spark, grades.severity_of_ruling(F.col("x")), list(free)) == list(free.values())


def test_split_chain_and_remark():
    said = "حدثنا فلان عن فلان أن رسول الله صلى الله عليه وسلم قال: هذا كلام طويل يكفي"
    assert parse.chain_and_body(said)[1:] == ("هذا كلام طويل يكفي", "prophet_speech")
    assert parse.chain_and_body('حدثنا فلان عن فلان "كلام طويل جدا هنا"')[2] == "quote"
    assert parse.chain_and_body("حدثنا فلان عن فلان ان النبي دخل المسجد يوما")[2] == "an_prophet"
    assert parse.chain_and_body("اخبرنا فلان قال حدثنا فلان قال نعم هذا كلام طويل من صاحبه في امر من الامور كلها")[2] == "after_chain"
    assert parse.chain_and_body("كلام بلا سند")[2] == "unsplit" and parse.chain_and_body(" ")[2] == "empty" and parse.chain_and_body(None)[2] == "empty"
    core, remark = parse.core_and_remark("انما الاعمال بالنيات والنيات. قال أبو عيسى هذا حديث حسن")
    assert core == "انما الاعمال بالنيات والنيات" and remark.startswith("قال أبو عيسى")
    assert parse.core_and_remark("لا شيء هنا") == ("لا شيء هنا", "") and parse.core_and_remark(None) == ("", "")


def test_citation(spark):
    got = values(spark, parse.citation(F.col("x")), ["البقرة ٢:٢٥٥", "2 : 3 - 7", "no numbers", None])
    assert [(r["chapter"], r["first"], r["last"]) for r in got] == [(2, 255, 255), (2, 3, 7), (None, None, None), (None, None, None)]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [[1.0, 0.0], [9.0, 9.0], [0.0, 1.0]], [1, 0, 1])], "a array<float>, b array<float>, m array<array<float>>, k array<int>")
    r = df.select(vectors.norm(F.col("a")), vectors.cosine(F.col("a"), F.col("b")), vectors.mean_pool(F.col("m"), F.col("k"))).first()
    assert r[0] == 5 and r[1] == pytest.approx(0.96) and r[2] == pytest.approx([0.7071067811865476] * 2)


def test_bm25_by_hand_and_engine_switch(spark):
    docs = spark.createDataFrame([(1, "red red fish"), (2, "blue fish"), (3, "sky"), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "Red fish!"), (2, "nothing")], "query_id long, text string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in lexical.bm25(q, docs).collect()}
    idf = lambda df: math.log(1 + (4 - df + 0.5) / (df + 0.5))
    part = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 1.5))
    assert set(got) == {(1, 1), (1, 2)} and got[1, 1] == pytest.approx(idf(1) * part(2, 3) + idf(2) * part(1, 3))
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0])], "doc_id long, v array<float>")
    qv = spark.createDataFrame([(1, [0.0, 1.0])], "query_id long, v array<float>")
    order = lambda a, b: [r["doc_id"] for r in answers.hybrid_search(q, docs, qv, v, 3, a, b).orderBy("rank").collect()]
    assert order(0, 1) == [1, 2] and order(1, 0) == [3, 2, 1] and set(order(0.7, 0.3)) == {1, 2, 3}


def test_fusion_parts(spark):
    s = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0)], "query_id long, doc_id long, score double")
    m = fusion.moments(fusion.sums(s), 4).first()
    assert (m["mean"], m["sd"]) == (1.5, pytest.approx(1.6583123951777))
    lists = [spark.createDataFrame(r, "query_id long, doc_id long, rank int") for r in ([(1, 7, 1), (1, 8, 2)], [(1, 8, 1)])]
    got = {r["doc_id"]: r["score"] for r in fusion.reciprocal_ranks(lists).collect()}
    assert got[8] == pytest.approx(1 / 62 + 1 / 61) and got[7] == pytest.approx(1 / 61)


def test_greedy_collapse_is_not_transitive(spark):
    a, b, c = "abcdefghij", "abcdefghxy", "abcdefwvxy"  # a~b, b~c, but not a~c
    rows = [(1, 1, 10, "hadith", list(a), ["s"]), (1, 2, 11, "hadith", list(b), ["t"]), (1, 3, 12, "hadith", list(c), ["u"]), (1, 4, 13, "ayah", list(a), ["s"]), (1, 5, 14, "hadith", ["q", "r"], ["v", "w"]), (1, 6, 15, "hadith", ["r", "q"], ["z"]), (1, 7, 16, "hadith", ["n"], ["v", "w"])]
    df = spark.createDataFrame(rows, "query_id long, rank int, doc_id long, kind string, tokens array<string>, shown array<string>")
    got = {r["doc_id"]: (r["kept_rank"], r["variant_of"]) for r in dedup.greedy_collapse(df, 10).collect()}
    assert got == {10: (1, None), 11: (1, 10), 12: (2, None), 13: (3, None), 14: (4, None), 15: (4, 14), 16: (4, 14)}
    assert {r["doc_id"] for r in dedup.greedy_collapse(df, 2).collect()} == {10, 11, 12}


def test_tournament(spark):
    rows = [(1, i, i, float(s)) for i, s in enumerate([5, 1, 1, 0, 4.9, 0.1], 1)]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, rank int, score double")
    won = decision.winners(decision.choice(decision.groups(df, 3), F.col("score"), 2.0), runner_up=0.02)
    assert sorted(r["doc_id"] for r in won.collect()) == [1, 5]
    none = decision.winners(decision.choice(decision.groups(df, 3), F.col("score"), 9.0))
    assert none.count() == 0
    out = {r["query_id"]: r["verdict"] for r in answers.answered(df, F.col("score"), 2.0).collect()}
    assert out == {1: "confident"}
    close = spark.createDataFrame([(1, 1, 1, 0.9), (1, 2, 2, 0.85), (2, 3, 1, 1.5), (2, 4, 2, 1.45)], "query_id long, doc_id long, rank int, score double")
    # no_match wins the first query's group: neither its first nor its runner-up goes on
    won = decision.winners(decision.choice(close.withColumn("group_id", F.lit(0)), F.col("score"), 1.0), runner_up=0.2)
    assert sorted(r["doc_id"] for r in won.collect()) == [3, 4]


ROUTE = dict(p_general=0.0, p_personal=0.0, p_question=0.0, p_judge=0.0, p_islamic=1.0, p_specific=0.9, p_saying=0.0, names_kind=False, starts_as_question=False, is_question_form=False, has_ruling_word=False, n_finalists=3, pick_passes=True, pick_p=0.8, n_relevant=0)


@pytest.mark.parametrize(
    ("change", "verdict"),
    [
        ({}, "confident"), ({"pick_p": 0.45}, "tentative"), ({"pick_p": 0.44}, "unsure"), ({"p_judge": 0.5}, "out_of_scope"), ({"p_judge": 0.5, "names_kind": True}, "confident"),
        ({"p_judge": 0.5, "names_kind": True, "starts_as_question": True}, "out_of_scope"), ({"p_question": 0.8, "is_question_form": True}, "question"), ({"p_question": 0.8}, "confident"),
        ({"p_question": 0.8, "is_question_form": True, "p_islamic": 0.4}, "confident"), ({"p_general": 0.8}, "ruling_general"), ({"p_general": 0.4, "p_personal": 0.4}, "ruling_personal"),
        ({"n_finalists": 0}, "no_match"), ({"p_specific": 0.34}, "confident"), ({"p_specific": 0.34, "n_relevant": 2}, "topic"), ({"p_specific": 0.34, "n_relevant": 2, "pick_p": 0.9}, "confident"),
        ({"p_specific": 0.34, "p_saying": 0.6, "n_relevant": 2}, "confident"), ({"pick_passes": False}, "no_match"), ({"n_finalists": 0, "p_specific": 0.2, "pick_passes": False}, "no_match"),
    ],
)
def test_router(spark, change, verdict):
    row = ROUTE | change
    assert decision.route(spark.createDataFrame([row])).first()["verdict"] == verdict


def test_lookup(spark):
    rows = [(f"quran:{s}:{a}", "ayah", s, n, a, "quran", f"{n}: {a}") for s, n, size in ((1, "الفاتحة", 7), (2, "البقرة", 30), (112, "الإخلاص", 4)) for a in range(1, size + 1)]
    rows += [("bukhari:1", "hadith", None, None, None, "bukhari", "صحيح البخاري (1)"), ("muslim:153", "hadith", None, None, None, "muslim", "صحيح مسلم (35)"), ("muslim:154", "hadith", None, None, None, "muslim", "صحيح مسلم (35)")]
    records = spark.createDataFrame(rows, "id string, kind string, surah int, surah_name string, ayah int, collection_key string, ref string")
    asked = {
        "البقرة 5": ["quran:2:5"], "سورة البقرة من ٢ الى ٤": ["quran:2:2", "quran:2:3", "quran:2:4"], "البقرة 2:7": ["quran:2:7"], "بقرة 7": ["quran:2:7"], "1:2-3": ["quran:1:2", "quran:1:3"], "1:2-9": [],
        "2:1-21": [], "2:1-20": [f"quran:2:{a}" for a in range(1, 21)], "البخاري 1": ["bukhari:1"], "مسلم 35": ["muslim:153", "muslim:154"], "sahih muslim hadith no 35": ["muslim:153", "muslim:154"],
        "surah 112 verse 2": ["quran:112:2"], "حديث عن الصبر 5": [], "البقرة": [], "1 2 3 4": [], "": [],
    }
    q = spark.createDataFrame([(i, k) for i, k in enumerate(asked)], "query_id long, query string")
    got = {i: [] for i in range(len(asked))}
    for r in lookup.lookup(q, records).orderBy("query_id", "place").collect():
        got[r["query_id"]].append(r["id"])
    assert {k: sorted(got[i]) for i, k in enumerate(asked)} == {k: sorted(v) for k, v in asked.items()}
    named = lookup.named_chapter(spark.createDataFrame([(1, "اقرأ سورة الإخلاص"), (2, "سورة الإخلاص والصبر"), (3, "الإخلاص")], "query_id long, query string"), records, ["ايه"])
    assert [(r["query_id"], r["id"]) for r in named.orderBy("place").collect()] == [(1, f"quran:112:{a}") for a in range(1, 5)]


def test_corpus(spark, tmp_path):
    e = spark.createDataFrame([(1, 1, "الحمد لله رب"), (1, 2, "الرحمن الرحيم")], "chapter int, verse int, text string")
    chapters = spark.createDataFrame([(1, "الفاتحة", 2)], "id int, name string, verses int")
    t = corpus.surfaces(spark.createDataFrame([(1, 1, "en", "Praise be to God"), (1, 1, "fr", "court"), (1, 2, "ur", "مہربان نہایت رحم")], "chapter int, verse int, lang string, text string"), ["chapter", "verse"])
    got = {r["id"]: r for r in corpus.verses(e, e, chapters, t).collect()}
    assert got["quran:1:1"]["surfaces"] == {"en": "praise be to god"} and got["quran:1:2"]["ref"] == "الفاتحة: 2"
    with pytest.raises(ValueError, match="aligned"):
        corpus.verses(e, e.limit(1), chapters, t)
    with pytest.raises(ValueError, match="number of verses"):
        corpus.verses(e, e, spark.createDataFrame([(1, "x", 3)], "id int, name string, verses int"), t)
    path = tmp_path / "book.json"
    path.write_text('{"metadata":{"sections":{"1":"One"}},"hadiths":[{"hadithnumber":"5","arabicnumber":"","text":"كلام طويل بلا سند","reference":{"book":1},"grades":[{"name":"B","grade":"Daif"},{"name":"A","grade":"Sahih"}]},{"hadithnumber":"815.2","text":"  ","reference":{"book":9},"grades":[]}]}', encoding="utf-8")
    edition = files.edition(spark, str(path))
    none = spark.createDataFrame([], "hadithnumber string, surfaces map<string,string>, translations map<string,string>")
    rows = corpus.reports(edition, "x", "كتاب", False, none, "A").collect()
    assert [(r["id"], r["section"], r["severity"], r["grade_basis"], r["ref"], r["split_rule"]) for r in rows] == [("x:5", "One", "sahih", "cited", "كتاب (5)", "unsplit")]
    intro = corpus.reports(edition, "m", "مسلم", True, none, "A", True).first()
    assert (intro["severity"], intro["action"], intro["grade_basis"]) == ("unknown", "warn_unverified", "none")
    assert files.edition(spark, str(tmp_path / "absent.json")).count() == 0
    records = corpus.verses(e, e, chapters, t).withColumn("split_rule", F.lit(None).cast("string"))
    stats = {(r["what"], r["key"]): r["n"] for r in corpus.statistics(records).collect()}
    assert stats == {("kind", "ayah"): 2, ("collection_key", "quran"): 2, ("grade_basis", "quran"): 2, ("surface", "en"): 1, ("surface", "ur"): 1}


def test_harvest(spark):
    page = '<div class="hadith">1 - <b>text one</b></div><div class="hadith-info"><span>الراوي:</span> A<br><span>المصدر:</span> صحيح مسلم<br>الصفحة أو الرقم: 35</div><div class="hadith">2 - two</div>'
    (got,) = values(spark, corpus.harvested(F.col("x")), [page])
    assert [(g["text"], g["rawi"], g["source"], g["page"]) for g in got] == [("text one", "A", "صحيح مسلم", "35"), ("two", None, None, None)]
    same = values(spark, corpus.same_record(F.col("s"), F.col("p"), F.lit("مسلم"), F.col("n")), [("صحيح مسلم", "35", "35"), ("صحيح مسلم", "2/35", "35"), ("صحيح مسلم", "135", "35"), ("البخاري", "35", "35"), ("مسلم", "3604x1", "3604.1")], "s string, p string, n string")
    assert same == [True, True, False, False, False]


def test_answers(spark):
    p = spark.createDataFrame([(1, d, x) for d, x in ((10, 0.5), (11, 0.2), (12, 0.15), (13, 0.06), (14, 0.05), (15, 0.04))], "query_id long, doc_id long, p double")
    chosen = spark.createDataFrame([(1, 10, [12])], "query_id long, doc_id long, family array<long>")
    assert [r["doc_id"] for r in answers.alternatives(p, chosen).orderBy("place").collect()] == [11, 13, 14]
    g = spark.createDataFrame([(1, i, t) for i, t in enumerate([50, 60, 20, 200, 1])], "query_id long, group_id long, tokens long")
    assert [r["request"] for r in answers.packed_requests(g, 100).orderBy("group_id").collect()] == [0, 1, 1, 2, 3]
    recs = spark.createDataFrame([("a", "ayah", "quran", {"en": "<b>Hi</b> there"}), ("b", "hadith", "x", {"en": "سلام"}), ("c", "hadith", "x", {"fr": "oui"})], "id string, kind string, collection_key string, translations map<string,string>")
    credit = spark.createDataFrame([("ayah", "en", None, "Unknown"), ("hadith", "fr", "x", "Z")], "kind string, lang string, collection_key string, author string")
    got = {r["id"]: r["translation"] for r in answers.translation(recs, credit, F.lit("en")).collect()}
    assert got["a"]["text"] == "Hi there" and got["a"]["translator"] is None and got["b"] is None and got["c"] is None
    assert answers.translation(recs, credit, F.lit("fr")).where("id = 'c'").first()["translation"]["translator"] == "Z"
    schema = "verdict string, shown array<struct<id:string,kind:string,matn:string,severity:string,variants:array<string>>>, wording array<string>, ruling string, want_verdicts array<string>, want_has array<string>, want_kind string, want_ruling string, want_wording array<string>, not_sound string"
    shown = [("q:1", "ayah", "قُلْ هو", "quran", ["v:2"])]
    cases = [("confident", shown, None, None, ["confident"], ["id:v:2"], None, None, None, None), ("topic", shown, None, None, ["confident"], ["text:قل هو", "id:x"], "hadith", None, None, None), ("confident", shown, ["w"], "general", None, ["id:zzz"], None, "personal", ["w"], "غائب")]
    assert [r["failures"] for r in answers.check(spark.createDataFrame(cases, schema)).collect()] == [[], ["verdict", "kind"], ["has", "ruling", "not_sound"]]


def test_tables(spark):
    rows = spark.createDataFrame([("a", v) for v in (3.0, 1.0, 2.0, 2.0)], "g string, v double")
    r = tables.discrete_quantiles(rows, "g", "v", {"lo": F.lit(0), "mid": F.floor(F.col("n") / 2), "hi": F.col("n") - 1}).first()
    assert (r["lo"], r["mid"], r["hi"]) == (1.0, 2.0, 3.0)
    ranks = spark.createDataFrame([(1, 1), (2, 4), (3, None)], "query_id long, rank int")
    m = tables.retrieval_metrics(ranks).first()
    assert (m["hit_1"], m["hit_5"], m["mrr"]) == (1, 2, pytest.approx(1.25 / 3))
    one = tables.seeded_sample(spark.range(100), "id", 7).collect()
    assert [r["id"] for r in one] == sorted(range(100), key=lambda i: hashlib.md5(f"450{i}".encode()).hexdigest())[:7]


def test_files(spark, tmp_path):
    records = spark.createDataFrame([("a", {"en": "x", "fr": "y"}), ("b", {"en": " "})], "id string, surfaces map<string,string>")
    files.write_surfaces(records, str(tmp_path / "s"))
    wanted = spark.createDataFrame([("en",), ("de",)], "lang string")
    assert [r["lang"] for r in files.missing_partitions(wanted, spark, str(tmp_path / "s")).collect()] == ["de"]
    for name, rows in (("one", [("a", "1")]), ("two", [("a", "2"), ("b", "3")])):
        files.write_json_lines(spark.createDataFrame(rows, "id string, number string"), str(tmp_path / name))
    got = files.first_seen_files(spark, [str(tmp_path / "one"), str(tmp_path / "two")], "id string, number string", "id")
    assert {(r["id"], r["number"]) for r in got.collect()} == {("a", "1"), ("b", "3")}
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(str(tmp_path / "old"))
    new = files.upsert_into(spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), str(tmp_path / "old"), str(tmp_path / "new"), ["k"])
    assert {tuple(r) for r in new.collect()} == {(1, "a"), (2, "c"), (3, "d")}
    manifest = files.split_with_manifest(spark, str(tmp_path / "one")).collect()
    assert sum(r["bytes"] for r in manifest) > 0 and "| id |" in files.markdown(records.select("id"), "T")


def test_limiters(spark):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    times = [i * 1.0 for i in range(31)] + [60.0, 60.5, 61.5, 200.0]
    rows = [(i, start + dt.timedelta(seconds=t), 1, "x", 30.0) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    got = {r["event_id"]: r["allowed"] for r in events.sliding_limit(df, 30, 60.0).collect()}
    log, want = deque(), {}
    for i, t in enumerate(times):
        while log and t - log[0] > 60:
            log.popleft()
        want[i] = len(log) < 30
        if want[i]:
            log.append(t)
    assert got == want and not got[30] and got[34]
    waits = [r["wait"] for r in events.token_bucket(df.where("event_id < 5"), "value", 10.0, 60.0).orderBy("event_id").collect()]
    assert waits == pytest.approx([0.0, 0.0, 1.0, 3.0, 5.0])


def test_fetch(tmp_path):
    asked = []

    def read(url):
        asked.append(url)
        if url.startswith("m://2"):
            return b"x" * 2000
        raise OSError("down")

    mirrors = {"a://": ["m://1/", "m://2/"]}
    to = str(tmp_path / "d" / "f.json")
    assert fetch.fetched("a://x", to, mirrors=mirrors, read=read, pause=0) == to and asked == ["a://x", "m://1/x", "m://2/x"]
    assert fetch.fetched("a://x", to, read=read, pause=0) == to and len(asked) == 3
    assert fetch.fetched("b://x", str(tmp_path / "g"), required=False, read=read, pause=0) is None
    with pytest.raises(RuntimeError):
        fetch.fetched("b://x", str(tmp_path / "g"), read=read, pause=0)


def test_encode(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", "red fish"), ("b", "en", "red fish red"), ("c", "fr", "ciel"), ("d", "fr", " ")], "id string, lang string, text string")
    path = str(tmp_path / "emb")
    encode.resumed(rows.where("lang = 'en'"), encode.hashing_encoder(32), path)
    before = spark.read.parquet(path).count()
    encode.resumed(rows, encode.hashing_encoder(32), path)
    got = {r["id"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert before == 2 and set(got) == {"a", "b", "c"} and all(sum(x * x for x in v) == pytest.approx(1) for v in got.values())
    error = encode.half_error(spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.3, 0.7])], "doc_id long, v array<float>"))
    assert 0 < error < 1e-3


def test_swap(spark):
    rows = spark.createDataFrame([(1, 10, 1, None), (1, 11, 1, 10), (1, 12, 1, 10), (1, 20, 2, None), (1, 21, 2, 20)], "query_id long, doc_id long, kept_rank int, variant_of long")
    places = spark.createDataFrame([(10, 2, 1), (11, 1, 5), (12, 0, 9), (20, 1, 7), (21, 1, 2)], "doc_id long, place int, number int")
    got = {r["kept_rank"]: (r["doc_id"], r["variants"]) for r in dedup.swapped(rows, places).collect()}
    assert got == {1: (12, [10, 11]), 2: (20, [21])}


def test_parts_and_cache(spark, tmp_path):
    manifest = files.write_in_parts(spark.range(100).coalesce(1), str(tmp_path / "p"), 30)
    rows = manifest.collect()
    kept = spark.createDataFrame(rows, manifest.schema)
    assert len(rows) == 4 and files.changed_parts(kept, str(tmp_path / "p")).count() == 0
    with open(tmp_path / "p" / rows[0]["file"], "a") as f:
        f.write("{}")
    for crc in (tmp_path / "p").glob(".*.crc"):
        crc.unlink()
    assert [r["file"] for r in files.changed_parts(kept, str(tmp_path / "p")).collect()] == [rows[0]["file"]]
    cache = str(tmp_path / "cache")
    assert files.cached_answers(spark, cache, "1").count() == 0
    for answer in ("old", "new"):
        files.keep_answers(spark.createDataFrame([("q", answer)], "query string, answer string"), cache, "1")
    assert [tuple(r) for r in files.cached_answers(spark, cache, "1").collect()] == [("q", "new")] and files.cached_answers(spark, cache, "2").count() == 0


def test_more_small_functions(spark):
    assert values(spark, text.skeleton(F.col("x")), ["ٱلۡحَمۡدُ، (أول)", None]) == ["الحمد اول", ""]
    assert values(spark, text.short_name(F.col("x"), ["سنن", "صحيح"]), ["صحيح مسلم", "موطأ"]) == ["مسلم", "موطأ"]
    assert values(spark, text.filled("a {k}: {t}", k=F.col("x"), t=F.lit("z")), ["b", None]) == ["a b: z", "a : z"]
    assert values(spark, text.percent(F.col("x")), [0.456, 1.2, -1.0], "x double") == [46, 100, 0]
    texts = {"no_match": "none", "tentative": "maybe", "else": "found"}
    assert values(spark, text.message(F.col("v"), F.col("s"), texts, "say more"), [("no_match", 0.1), ("no_match", 0.5), ("tentative", 0.1), ("confident", 0.9)], "v string, s double") == ["none say more", "none", "maybe", "found"]


def test_knockout_reads_every_text(spark, tmp_path):
    rng = random.Random(7)
    texts, none, cuts = 200, 1.0, []

    def cut(df):
        path = str(tmp_path / f"round{len(cuts)}")
        df.write.parquet(path)
        cuts.append(path)
        return spark.read.parquet(path)

    logits = {(q, p): rng.choice([0.0] * (q + 1) + [round(rng.uniform(0.5, 4), 3)]) for q in range(6) for p in range(texts)}
    rows = [(q, 1000 + p, p, x) for (q, p), x in logits.items() if x > 0]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, place long, score double")
    got = {(r["query_id"], r["place"]) for r in decision.knockout(df, texts, F.col("score"), cut, no_match=none).collect()}

    def round_of(q, groups):
        out = []
        for g in groups:
            e = [math.exp(logits[q, p]) for p in g]
            whole = sum(e) + math.exp(none)
            order = sorted(range(len(g)), key=lambda k: (-round(e[k] / whole, 9), k))
            if round(e[order[0]] / whole, 9) >= round(math.exp(none) / whole, 9):
                out.append((g[order[0]], e[order[0]] / whole))
                if len(g) > 1 and e[order[1]] / whole >= 0.25:
                    out.append((g[order[1]], e[order[1]] / whole))
        return [p for p, _ in sorted(out, key=lambda x: (-round(x[1], 9), x[0]))]

    want = set()
    for q in range(6):
        alive = round_of(q, [range(s, min(s + 20, texts)) for s in range(0, texts, 20)])
        while len(alive) > 12:
            left = round_of(q, [alive[s : s + 12] for s in range(0, len(alive), 12)])
            if len(left) >= len(alive):
                alive = left[:12]
                break
            alive = left
        want |= {(q, p) for p in alive}
    assert got == want and cuts


def test_search_parts(spark):
    words = lambda x: F.split(F.col(x), " ")
    asked = ["ايه عن النوم", "hadith on sleep", "verse and hadith", "sleep", "verse", "حديث سنه"]
    assert values(spark, search.wanted_kind(words("x")), asked) == ["ayah", "hadith", None, None, "ayah", "hadith"]
    assert values(spark, F.array_join(search.literal_words(words("x")), " "), asked) == ["عن النوم", "on sleep", "and", "sleep", "verse", "سنه"]
    urls = {"objection": "o://", "creed": "c://"}
    got = values(spark, search.referred(F.col("k"), F.col("l"), urls, "objection", ("objection",)), [("creed", "en"), ("objection", "fr"), ("x", "de"), ("objection", "ar"), (None, None)], "k string, l string")
    assert got == ["c://", "o://?lang=fr", "o://?lang=en", "o://", "o://"]
    got = values(spark, search.linked(F.col("k"), F.split(F.col("w"), " "), F.lit(2), F.lit(255), "s://{q}", "v://{chapter}/{verse}", 2), [("ayah", "a"), ("hadith", "a b c d")], "k string, w string")
    assert got == ["v://2/255", "s://b%20c"]
    assert values(spark, search.subject_url(words("x"), ("ما", "حكم"), "s://{q}", "h://"), ["ما حكم البيع", "ما"]) == ["s://" + "%D8%A7%D9%84%D8%A8%D9%8A%D8%B9", "h://"]


def test_knockout_answers(spark):
    asked = spark.createDataFrame([(1, False, 0.9), (2, False, 0.1), (3, True, 0.0), (4, True, None)], "query_id long, broad boolean, p_fatwa double")
    final = spark.createDataFrame([(q, d, 1, "hadith", t, p, 0.1, None, None) for q, d, t, p in ((1, 10, ["a"], 0.8), (2, 10, list("abcdef"), 0.5), (2, 11, list("abcdez"), 0.3), (3, 12, ["x"], 0.8))], "query_id long, doc_id long, rank int, kind string, tokens array<string>, p double, p_none double, wanted string, quote_ok boolean")
    listed = spark.createDataFrame([(3, 20, 1), (3, 21, 2)], "query_id long, doc_id long, place int")
    got = {r["query_id"]: (r["verdict"], r["doc_id"], r["texts"]) for r in search.knockout_answered(asked, final, listed).collect()}
    assert got == {1: ("fatwa_request", None, 0), 2: ("confident", 10, 0), 3: ("topic", None, 2), 4: ("no_match", None, 0)}
    won = spark.createDataFrame([(1, k, "hadith", [f"w{k % 3}", "x"], 1.0 - k / 100, k) for k in range(70)], "query_id long, doc_id long, kind string, tokens array<string>, p double, place int")
    assert [r["doc_id"] for r in search.knockout_topic(won).orderBy("place").collect()] == [0, 1, 2]
    unsure = final.where("query_id = 2 and doc_id = 10").withColumn("wanted", F.lit("ayah"))
    assert search.picked(unsure).count() == 0 and search.picked(unsure.withColumn("p", F.lit(0.7))).count() == 1
    assert search.picked(final.withColumn("quote_ok", F.lit(False))).count() == 0


def test_reports_and_totals(spark):
    checked = spark.createDataFrame([("a", []), ("a", ["kind"]), ("b", [])], "case string, failures array<string>")
    assert {(r["case"], r["passed"], r["n"]) for r in answers.case_totals(checked, "case").collect()} == {("a", 1, 2), ("b", 1, 1), (None, 2, 3)}
    requests = spark.createDataFrame([(1, 0, 10), (1, 0, 5), (1, 1, 7)], "query_id long, request long, tokens long")
    assert tuple(answers.token_totals(requests).first()) == (1, 2, 22)
    kept, counts = tables.dropped(spark.createDataFrame([("a", "x"), ("a", " "), ("b", None)], "k string, t string"), F.trim("t") != "", "k")
    assert kept.count() == 1 and {tuple(r) for r in counts.collect()} == {("a", 1, 1), ("b", 0, 1)}
    left = spark.createDataFrame([(1, "A b"), (2, "c"), (3, "d")], "k long, text string")
    right = spark.createDataFrame([(1, "a B"), (2, "x"), (4, "e")], "k long, text string")
    assert {r["k"] for r in tables.differing(left, right, ["k"], F.lower).collect()} == {2, 3, 4}
    facts = spark.createDataFrame([("e", "second", 2), ("e", "first", 1)], "edition string, author string, n int")
    assert [r["author"] for r in tables.described(spark.createDataFrame([("e",), ("f",)], "edition string"), facts, "edition", [F.col("n")]).orderBy("edition").collect()] == ["first", None]
    assert values(spark, tables.ceil_div(F.col("a"), F.lit(3)), [(7,), (6,), (0,)], "a long") == [3, 2, 0]
    assert values(spark, tables.fractional(F.col("a")), [("815.2",), ("815",), (None,)], "a string") == [True, False, False]
    assert [tuple(r) for r in tables.spread(spark.createDataFrame([("a", 0.5), ("a", 0.9), ("a", 0.1)], "k string, v double"), "k", "v").select("n", "least", "median").collect()] == [(3, 0.1, 0.5)]
    one = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5)], "query_id long, doc_id long, score double")
    seen = answers.traced(one, one.where("doc_id = 2"), one, one.select("query_id", "doc_id")).orderBy("doc_id").collect()
    assert [(r["dense_rank"], r["lexical_rank"], r["rank"]) for r in seen] == [(1, None, 1), (2, 1, 2)]
    choice = spark.createDataFrame([(1, 5, 1, 3.0, 0.5), (2, 6, 1, -3.0, 0.9)], "query_id long, doc_id long, rank int, score double, sure double")
    got = {r["query_id"]: (r["verdict"], r["doc_id"]) for r in answers.decided_once(choice, F.col("score"), 0.0, F.col("sure")).collect()}
    assert got == {1: ("tentative", 5), 2: ("no_match", None)}
    assert "more rows" in files.markdown(spark.range(5), "T", 3) and "more rows" not in files.markdown(spark.range(3), "T", 3)


def test_parts_by_bytes(spark, tmp_path):
    (tmp_path / "big.bin").write_bytes(bytes(range(256)) * 40)
    manifest = files.split_bytes(spark, str(tmp_path / "big.bin"), str(tmp_path / "parts"), 3000)
    kept = spark.createDataFrame(manifest.collect(), manifest.schema)
    assert sorted(r["bytes"] for r in kept.collect()) == [1240, 3000, 3000, 3000]
    assert (tmp_path / "again.bin").exists() is False and files.rejoined(spark, kept, str(tmp_path / "parts"), str(tmp_path / "again.bin"))
    assert (tmp_path / "again.bin").read_bytes() == (tmp_path / "big.bin").read_bytes()
    (tmp_path / "parts" / "part-00001").write_bytes(b"x")
    (tmp_path / "parts" / ".part-00001.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        files.rejoined(spark, kept, str(tmp_path / "parts"), str(tmp_path / "again2.bin"))


def test_pages_and_source_lists(tmp_path):
    tries = []

    def read(url):
        tries.append(url)
        if len(tries) == 2:
            raise OSError("slow down")
        return url.encode()

    rows = fetch.paged(lambda k: f"p{k}", range(1, 4), lambda body: [{"page": body.decode()}], read=read, wait=lambda s: None)
    assert [r["page"] for r in rows] == ["p1", "p2", "p3"] and tries == ["p1", "p2", "p2", "p3"]
    with pytest.raises(OSError):
        fetch.paged(lambda k: "x", range(1), lambda body: [], read=lambda url: (_ for _ in ()).throw(OSError()), wait=lambda s: None)
    listed = fetch.source_list({"verse": "a://{edition}.json"}, {"ar": {"kind": "verse", "editions": ["u"], "required": True}, "en": {"kind": "verse", "editions": ["v", "w"]}}, str(tmp_path))
    assert [(u, r) for u, _, r in listed] == [("a://u.json", True), ("a://v.json", False), ("a://w.json", False)]
    seen = []
    got = fetch.fetched_all(listed, progress=lambda *a: seen.append(a), read=lambda url: b"x" * 2000 if "w" not in url else (_ for _ in ()).throw(OSError()), pause=0)
    assert len(got) == 2 and seen[-1] == ("fetch", 3, 3)


def test_service_does_not_answer_without_a_decision(spark):
    import datetime as dt

    rows = [(1, 1, dt.datetime(2024, 1, 1), "  red   fish "), (2, 1, dt.datetime(2024, 1, 1, 0, 0, 1), "known"), (3, 2, dt.datetime(2024, 1, 1), "x"), (4, 2, dt.datetime(2024, 1, 1), "y" * 501), (5, 1, dt.datetime(2024, 1, 1, 0, 0, 2), "third")]
    requests = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, query string")
    cache = spark.createDataFrame([("known", "kept")], "query string, answer string")

    def broken(asked):
        raise service.Unavailable("no judge")

    steps = []
    got = {r["event_id"]: (r["status"], r["cached"], r["answer"]) for r in service.served(requests, cache, broken, 2, 60.0, progress=lambda *a: steps.append(a)).collect()}
    assert got == {1: ("decision_unavailable", False, None), 2: ("answered", True, "kept"), 3: ("too_short", False, None), 4: ("too_long", False, None), 5: ("limited", False, None)}
    assert [s[0] for s in steps] == ["length", "cache", "answer", "done"]
    good = {r["event_id"]: r["answer"] for r in service.served(requests, cache, lambda a: a.withColumn("answer", F.upper("query")), 9).collect()}
    assert good[1] == "RED FISH" and good[5] == "THIRD"


def test_two_buckets_and_hot_users(spark):
    import datetime as dt

    rows = [(k, dt.datetime(2024, 1, 1), 1, "x", 1.0) for k in range(5)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    waits = [r["wait"] for r in events.token_bucket(df, "value", 10.0, 60.0, 2.0).orderBy("event_id").collect()]
    assert waits == pytest.approx([0.0, 0.0, 0.5, 1.0, 1.5])
    n = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        many = spark.range(100).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("ts"), (F.col("id") % 3 == 0).cast("long").alias("user_id"))
        assert events.sliding_limit(many, 5, 1000.0).where("allowed").count() == 10
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)


def test_passages_are_found_as_they_stand(spark):
    docs = ["x a b c d e f y", "a b c d ex", "q", "ab c", "", None, "zz a  b cc", "one two"]
    asked = ["a b c d e", "c d", "q", "a  b c", "b", "two", ""]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    p = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    got = {(r["query_id"], r["doc_id"]) for r in lexical.containing(d, p).collect()}
    assert got == {(i, k) for i, t in enumerate(asked) for k, x in enumerate(docs) if x is not None and t in x}


def test_service_answers_a_query_once(spark):
    import datetime as dt

    rows = [(k, k, dt.datetime(2024, 1, 1, 0, 0, k), q) for k, q in enumerate(["fish", "ab", "abc", "fish", "fish ", "y" * 300, "y" * 301])]
    requests = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, query string")
    none = spark.createDataFrame([], "query string, answer string")
    got = {r["event_id"]: (r["status"], r["cached"]) for r in service.served(requests, none, lambda asked: asked.withColumn("answer", F.upper("query"))).collect()}
    assert got == {0: ("answered", False), 1: ("too_short", False), 2: ("answered", False), 3: ("answered", True), 4: ("answered", True), 5: ("answered", False), 6: ("too_long", False)}
    with pytest.raises(ZeroDivisionError):  # a mistake is no missing judge
        service.served(requests, none, lambda asked: asked.limit(1 // 0))


def test_editions_differ_where_one_has_a_text_without_letters(spark):
    left = spark.createDataFrame([(1, "12."), (2, "12."), (3, None)], "k long, text string")
    right = spark.createDataFrame([(1, "7"), (4, "")], "k long, text string")
    assert {r["k"] for r in tables.differing(left, right, ["k"], text.skeleton).collect()} == {2, 3, 4}


def test_honest_holds_a_saying_in_another_script(spark):
    rows = [("قال: èê، èê و", "èê èê", "sahih"), ("شيء آخر", "èê èê", "sahih"), ("èê", " . ", "sahih"), (None, "èê", "sahih"), ("", "èê", "daif")]
    assert values(spark, answers.honest(F.col("t"), F.col("p"), F.col("s")), rows, "t string, p string, s string") == [True, False, False, False, True]


def test_honest_holds_no_saying_by_the_letters_of_one_script(spark):
    """Of a saying in two scripts, a hit must hold all letters, not those alone that the Arabic form keeps."""
    rows = [("شيء آخر", "ñ خ", "sahih"), ("قال: ñ، خ و", "ñ خ", "sahih"), ("قَالَ: Ñ، إخ", "ñ اخ", "sahih"), ("قَالَ: إخ", "أَخ", "sahih"), ("الف", None, "sahih")]
    assert values(spark, answers.honest(F.col("t"), F.col("p"), F.col("s")), rows, "t string, p string, s string") == [False, True, True, True, False]


def test_knockout_breaks_equal_probabilities_by_place(spark):
    """Three texts of one score, of which the first had a rival in round one and so the least probability there."""
    scores = {0: 5.0, 1: 3.5, 20: 5.0, 40: 5.0} | {20 * k: 3.0 for k in range(3, 13)}
    df = spark.createDataFrame([(1, p, p, s) for p, s in scores.items()], "query_id long, doc_id long, place long, score double")
    left = decision.knockout(df, 260, F.col("score"), lambda x: x.localCheckpoint(), no_match=1.0).collect()
    assert {r["place"] for r in left if r["place"] in (0, 20, 40)} == {0}


def test_knockout_widens_no_more_than_the_likeliest(spark, monkeypatch):
    """Of the first round's winners, which are some of every group, only those that a list may take are met with their texts."""
    asked, texts = [], answer_queries.sq._texts
    monkeypatch.setattr(answer_queries.sq, "_texts", lambda s, d, found=None: asked.append(found) or texts(s, d, found))
    rows = answer_queries.knockout_run(spark, "/root/testdata/sf0.001").collect()
    assert rows and len(asked) == 1 and asked[0].groupBy("query_id").count().agg(F.max("count")).first()[0] <= search.KNOCKOUT_TOPIC + decision.FINALISTS
    many = spark.createDataFrame([(1, k, k, 0.5) for k in range(200)], "query_id long, doc_id long, place long, p double")
    assert sorted(r["place"] for r in search.knockout_likeliest(many).collect()) == list(range(search.KNOCKOUT_TOPIC))


def test_containment_counts_meetings_in_blocks(spark, monkeypatch):
    """Over several blocks of prefixes all pairs are found."""
    monkeypatch.setattr(dedup, "BLOCK_TOKENS", 100)
    rng = random.Random(3)
    sets = {k: {f"w{rng.randrange(14)}" for _ in range(rng.randrange(6, 20))} for k in range(60)}
    df = dedup.containment_pairs(spark.createDataFrame([(k, list(t)) for k, t in sets.items()], "doc_id long, tokens array<string>"))
    one = {frozenset(t): k for k, t in reversed(sets.items())}
    want = {(min(a, b), max(a, b)) for s, a in one.items() for t, b in one.items() if a != b and min(len(s), len(t)) >= 6 and len(s & t) >= 0.8 * min(len(s), len(t)) - 1e-9}
    assert {(r["x"], r["y"]) for r in df.collect()} == want and want


def test_containment_widens_no_pair_by_its_tokens(spark, monkeypatch):
    """Pairs are many more than sets: they come with their counts from where they meet, by hashes that no two words share."""
    tags, hashed = [], dedup._hashed
    monkeypatch.setattr(dedup, "written", lambda df, tag: tags.append((tag, df.columns)) or df.localCheckpoint())
    monkeypatch.setattr(dedup, "_hashed", lambda w, seed: hashed(w, seed) if seed else F.pmod(hashed(w, seed), F.lit(3)))
    rows = [(1, [f"w{k}" for k in range(10)]), (2, [f"w{k}" for k in range(2, 40)]), (3, [f"w{k}" for k in range(3, 13)]), (4, [f"w{k}" for k in range(2, 40)])]
    found = dedup.containment_pairs(spark.createDataFrame(rows, "doc_id long, tokens array<string>"))
    assert sorted(map(tuple, found.select("x", "y", "shared", "smaller").collect())) == [(1, 2, 8, 10), (2, 3, 10, 10)]
    assert ("meeting", ["small", "large", "shared", "smaller"]) in tags


def test_knockout_judges_groups_where_they_meet(spark, tmp_path):
    """Round one by index.likeliest() takes who it takes by all scores, and has far fewer rows than queries times texts."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(k, " ".join(rng.choices("abcdefgh", k=rng.randrange(0, 9)))) for k in range(300)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b"), (2, "c d e"), (3, "h"), (4, "x")], "query_id long, text string")
    places = spark.createDataFrame([(k, (k * 7) % 293) for k in range(293)], "doc_id long, place long")
    made = index.build(docs, f"file://{tmp_path}/index")
    scores = index.search(made, asked).select("query_id", "doc_id", F.round("score", 6).alias("score")).join(places, "doc_id")
    few = index.likeliest(made, asked, index.Groups(places, 293, 20, 2.0, 3.0, decision.RUNNER_UP)).withColumn("score", F.round("score", 6))
    of = lambda df: sorted((r["query_id"], r["place"], r["round"], round(r["p"], 8)) for r in decision.knockout(df, 293, F.col("score") * 2.0, lambda x: x.localCheckpoint(), no_match=3.0).collect())
    assert of(few) == of(scores) and of(few)
    assert few.count() < scores.count() / 3
    assert index.likeliest(made, asked.where("false"), index.Groups(places, 293, 20, 2.0, 3.0, decision.RUNNER_UP)).count() == 0
