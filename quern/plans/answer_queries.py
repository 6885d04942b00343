"""Queries over answers: late materialisation, alternatives, translations, final verdicts, overlap of retrievers, corpus preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import grades, parse, text
from quern.operators import answers, corpus, decision, dedup, index, judge, lexical, search
from quern.plans import search_queries as sq
from quern.plans.text_queries import latin, md5, word_list
from quern.sources import display
from quern.sources.files import exists, table
from quern.sources.scratch import shared_dir, written


def hydrate_topk(spark: SparkSession, d: str) -> DataFrame:
    display = table(spark, d, "documents").select("doc_id", "lang", "source", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return answers.hydrated(sq._lexical_top(spark, d, 5).select("query_id", "rank", "doc_id"), display)


HYDRATE_TOPK = f"WITH {sq.BM25} SELECT query_id, rank, doc_id, lang, source, md5(text) AS text_md5 FROM ({sq._rank_sql('bm')}) JOIN documents USING (doc_id) WHERE rank <= 5"


def alternatives(spark: SparkSession, d: str) -> DataFrame:
    """The likeliest candidates of the first group but the chosen one and those of its source."""
    judged = sq._judged(spark, d).where("group_id = 0").select("query_id", "doc_id", "rank", "source", "p", "p_none")
    chosen = decision.winners(judged, ("query_id",)).select("query_id", "doc_id", "source")
    family = judged.select("query_id", "source", F.col("doc_id").alias("copy")).join(chosen, ["query_id", "source"]).groupBy("query_id", "doc_id").agg(F.collect_list("copy").alias("family"))
    out = answers.alternatives(judged, family, least=0.02)
    return out.select("query_id", "doc_id", "place", F.round("p", 6).alias("p"))


ALTERNATIVES = f"""WITH {sq._JUDGED_SQL}, g0 AS (SELECT * FROM nt WHERE group_id = 0), ch AS (SELECT query_id, doc_id, source FROM g0 WHERE nth = 1 AND round(p, 9) >= round(p_none, 9)),
al AS (SELECT g0.query_id, g0.doc_id, g0.p, row_number() OVER (PARTITION BY g0.query_id ORDER BY round(g0.p, 9) DESC, g0.doc_id) AS place FROM g0 LEFT JOIN ch USING (query_id)
       WHERE g0.p >= 0.02 AND (ch.doc_id IS NULL OR (g0.doc_id <> ch.doc_id AND g0.source <> ch.source)))
SELECT query_id, doc_id, place, round(p, 6) AS p FROM al WHERE place <= 3"""


def final_verdicts(spark: SparkSession, d: str) -> DataFrame:
    out = answers.answered(sq._pool(spark, d), F.col("score") * sq.LOGIT, sq.NONE)
    return out.select("query_id", "verdict", "doc_id", F.round("p", 6).alias("p"))


FINAL_VERDICTS = f"""WITH {sq._JUDGED_SQL}, w1 AS (SELECT * FROM nt WHERE nth = 1 AND round(p, 9) >= round(p_none, 9)),
f1 AS (SELECT query_id, doc_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(p, 9) DESC, rank) AS k FROM w1) WHERE k <= 12),
c1 AS (SELECT *, exp(score * {sq.LOGIT}) / (sum(exp(score * {sq.LOGIT})) OVER q + exp({sq.NONE})) AS p2, exp({sq.NONE}) / (sum(exp(score * {sq.LOGIT})) OVER q + exp({sq.NONE})) AS n2 FROM f1 WINDOW q AS (PARTITION BY query_id)),
b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(p2, 9) DESC, rank) AS k FROM c1) WHERE k = 1 AND round(p2, 9) >= round(n2, 9)), a1 AS (SELECT DISTINCT query_id FROM pool)
SELECT a1.query_id, CASE WHEN doc_id IS NULL THEN 'no_match' WHEN round(p2, 9) >= 0.7 THEN 'confident' WHEN round(p2, 9) >= 0.45 THEN 'tentative' ELSE 'unsure' END AS verdict, doc_id, round(p2, 6) AS p FROM a1 LEFT JOIN b1 USING (query_id)"""


def translation_choice(spark: SparkSession, d: str) -> DataFrame:
    """A source's first text in each language as translations of a record, for readers of French; credits by language."""
    first = table(spark, d, "documents").groupBy("source", "lang").agg(F.min_by("text", "doc_id").alias("text"))
    records = first.groupBy(F.col("source").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("lang", "text"))).alias("translations"))
    records = records.select("id", F.when(F.col("id") == "src0", "ayah").otherwise("hadith").alias("kind"), F.col("id").alias("collection_key"), "translations")
    credits = table(spark, d, "documents").select(F.lit("hadith").alias("kind"), "lang", F.col("source").alias("collection_key")).distinct().withColumn("author", F.when(F.col("collection_key") == "src1", "Unknown").otherwise(F.concat(F.lit("by "), "collection_key")))
    out = answers.translation(records, credits, F.lit("fr"))
    return out.select("id", F.md5(F.col("translation.text").cast("binary")).alias("text_md5"), F.col("translation.translator").alias("translator"))


TRANSLATION_CHOICE = """
WITH f AS (SELECT source, arg_min(text, doc_id) AS t FROM documents WHERE lang = 'fr' GROUP BY 1), s AS (SELECT DISTINCT source FROM documents)
SELECT s.source AS id, md5(regexp_replace(t, '<[^>]+>', '', 'g')) AS text_md5, CASE WHEN t IS NOT NULL AND s.source NOT IN ('src0', 'src1') THEN 'by ' || s.source END AS translator FROM s LEFT JOIN f USING (source)"""


def retriever_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How many of the ten best documents of both retrievers are the same, for queries with a vector."""
    a = sq._dense_top(spark, d, 10).select("query_id", "doc_id")
    b = sq._lexical_top(spark, d, 10).select("query_id", "doc_id")
    sets = lambda df, name: df.groupBy("query_id").agg(F.collect_list("doc_id").alias(name))  # noqa: E731  # ten of each
    return sets(a, "a").join(sets(b, "b"), "query_id").select("query_id", F.size(F.array_intersect("a", "b")).alias("same"))


RETRIEVER_OVERLAP = f"""WITH {sq.BM25}, {sq.DENSE},
a AS (SELECT query_id, list(doc_id) AS a FROM ({sq._rank_sql('de')}) WHERE rank <= 10 GROUP BY 1), b AS (SELECT query_id, list(doc_id) AS b FROM ({sq._rank_sql('bm')}) WHERE rank <= 10 GROUP BY 1)
SELECT query_id, len(list_intersect(a, b)) AS same FROM a JOIN b USING (query_id)"""


def knockout_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Distinct texts with their copies' number, shuffle key and token estimates, marked and plain."""
    docs = table(spark, d, "documents").withColumn("words", F.array_join(lexical.words(F.col("text")), " "))
    one = dedup.exact_copies(docs, F.col("words"), sq._kind(F.col("source"))).where("doc_id = class_id").select("doc_id", "n")
    rows = one.join(docs.where("words <> ''").select("doc_id", F.length(text.plain(F.col("text"))).alias("chars"), text.token_estimate(F.col("text")).alias("marked")), "doc_id")
    return rows.select("doc_id", "n", F.md5(F.concat(F.lit("450"), F.col("doc_id").cast("string")).cast("binary")).alias("turn"), "marked", (F.floor((F.col("chars") + 16) * 0.7) + 2).cast("long").alias("plain"))


#: plain() of a text: invisible marks off, all but Arabic and Latin letters and digits become blanks.
_PLAIN_TEXT = f"trim(regexp_replace(regexp_replace(translate(translate(text, '{text.INVISIBLE}', ''), '{text.ALEF_VARIANTS[0]}', '{text.ALEF_VARIANTS[1]}'), '[^ء-ي٠-٩a-zA-Z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
KNOCKOUT_CORPUS = f"""WITH k AS (SELECT doc_id, source = 'src0' AS verse, array_to_string({word_list('text')}, ' ') AS k FROM documents), g AS (SELECT min(doc_id) AS doc_id, count(*) AS n FROM k WHERE k <> '' GROUP BY verse, k)
SELECT doc_id, n, md5('450' || CAST(doc_id AS VARCHAR)) AS turn, CAST(floor(length(text) * CAST(1.06 AS DOUBLE)) + 2 AS BIGINT) AS marked, CAST(floor((length({_PLAIN_TEXT}) + 16) * CAST(0.7 AS DOUBLE)) + 2 AS BIGINT) AS plain FROM g JOIN documents USING (doc_id)"""


def request_packs(spark: SparkSession, d: str) -> DataFrame:
    """Groups of 12 candidates packed in order into requests of a token budget."""
    tokens = table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))
    grouped = decision.groups(sq._pool(spark, d)).join(tokens, "doc_id").groupBy("query_id", "group_id").agg(F.sum("tokens").alias("tokens"))
    return answers.packed_requests(grouped, 45_000, 300)


REQUEST_PACKS = f"""WITH RECURSIVE {sq._POOL_SQL}, gt AS (SELECT query_id, CAST(floor((rank - 1) / 12) AS BIGINT) AS group_id, sum(CAST(floor(length(text) * CAST(1.06 AS DOUBLE)) + 2 AS BIGINT)) + 300 AS cost FROM pool JOIN documents USING (doc_id) GROUP BY 1, 2),
rp AS (SELECT DISTINCT query_id, CAST(-1 AS BIGINT) AS group_id, CAST(0 AS BIGINT) AS request, CAST(0 AS BIGINT) AS used FROM gt UNION ALL
  SELECT gt.query_id, gt.group_id, CASE WHEN used > 0 AND used + cost > 45000 THEN request + 1 ELSE request END, CAST(CASE WHEN used > 0 AND used + cost > 45000 THEN cost ELSE used + cost END AS BIGINT)
  FROM rp JOIN gt ON gt.query_id = rp.query_id AND gt.group_id = rp.group_id + 1)
SELECT query_id, group_id, request FROM rp WHERE group_id >= 0"""


LOGIT = 1.0  # the default judge of a shortlist: the fused score itself, against sq.NONE for no match


def _short(spark, d) -> DataFrame:
    """The shortlist of a search with words, the wanted kind and the severity of each text."""
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    severity = F.when(F.col("kind") == "ayah", "quran").when(F.col("toxic") == 1, "mawdu").when(F.col("quality") == 0, "daif").when(F.col("quality") == 1, "sahih").otherwise("unknown")
    found = written(sq._found(spark, d).select("query_id", "place", "doc_id", "kind", F.round("score", 6).alias("score"), "reserve"), "found")
    rows = found.join(sq._texts(spark, d, found).select("doc_id", "tokens"), "doc_id").join(sq._wanted(spark, d), "query_id").join(labels, "doc_id", "left")
    return written(rows.withColumn("severity", severity).drop("toxic", "quality"), "short")


#: sh: the shortlist; lo: pairs of looser copies of one report; each walk keeps the first of them, `most` in all.
_SHORT_SQL = f"""{sq._SEARCH_SQL}, lb AS (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY 1),
sh AS (SELECT query_id, sf.doc_id, kind, place AS rank, round(score, 6) AS score, reserve, {sq._WANTED_SQL} AS wanted,
         CASE WHEN kind = 'ayah' THEN 'quran' WHEN toxic = 1 THEN 'mawdu' WHEN quality = 0 THEN 'daif' WHEN quality = 1 THEN 'sahih' ELSE 'unknown' END AS severity FROM sf LEFT JOIN lb ON lb.doc_id = sf.doc_id),
lt AS (SELECT doc_id, list_sort(list_distinct(w)) AS t FROM tok JOIN documents USING (doc_id) WHERE source <> 'src0' AND doc_id IN (SELECT doc_id FROM sh)),
le AS (SELECT doc_id, len(t) AS n, unnest(t) AS w FROM lt WHERE len(t) >= 5),
lo AS (SELECT a.doc_id AS x, b.doc_id AS y FROM le a JOIN le b ON a.w = b.w AND a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING count(*) >= CAST(0.6 AS DOUBLE) * least(any_value(a.n), any_value(b.n))
       UNION SELECT a.doc_id, b.doc_id FROM lt a JOIN lt b ON a.t = b.t AND len(a.t) >= 2 AND a.doc_id <> b.doc_id),
lp AS (SELECT x AS doc_id, list(y) AS partners FROM lo GROUP BY 1)"""


def _loose_walk(source: str, out: str) -> str:
    """`out`: query_id, doc_id, place of the walk over `source`: query_id, doc_id, nth (from 1), most."""
    return f"""{out}_w AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS kept, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS BIGINT) AS twin FROM {source} UNION ALL
  SELECT query_id, step + 1, CASE WHEN t IS NULL THEN list_append(kept, d) ELSE kept END, d, t
  FROM (SELECT w.query_id, w.step, w.kept, s.doc_id AS d, list_filter(w.kept, lambda x: list_contains(coalesce(lp.partners, []), x))[1] AS t
        FROM {out}_w w JOIN {source} s ON s.query_id = w.query_id AND s.nth = w.step + 1 LEFT JOIN lp ON lp.doc_id = s.doc_id WHERE len(w.kept) < s.most)),
{out} AS (SELECT query_id, doc_id, CAST(list_position(kept, doc_id) AS BIGINT) AS place FROM {out}_w WHERE step > 0 AND twin IS NULL)"""


#: Texts that the shortlist holds in reserve serve ruling lists only.
_TOPIC_SQL = f"""{_SHORT_SQL}, tn AS (SELECT *, count(*) FILTER (kind = wanted) OVER (PARTITION BY query_id) AS same FROM sh WHERE NOT reserve),
tq AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth, 24 AS most FROM tn WHERE same < 6 OR kind = wanted), {_loose_walk('tq', 'tp')}"""


def topic_pool(spark: SparkSession, d: str) -> DataFrame:
    return search.topic_pool(_short(spark, d).where("not reserve")).select("query_id", "doc_id", "kind", "place")


TOPIC_POOL = f"WITH RECURSIVE {_TOPIC_SQL} SELECT tp.query_id, tp.doc_id, kind, place FROM tp JOIN sh ON sh.query_id = tp.query_id AND sh.doc_id = tp.doc_id"


def ruling_pool(spark: SparkSession, d: str) -> DataFrame:
    return search.ruling_pool(_short(spark, d))


#: rp: what is judged for a ruling question.
_RULING_SQL = f"""{_SHORT_SQL}, tn AS (SELECT *, count(*) FILTER (kind = wanted) OVER (PARTITION BY query_id) AS same FROM sh),
tq AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth, CASE WHEN wanted IS NULL THEN 12 ELSE 24 END AS most FROM tn WHERE CASE WHEN wanted IS NULL THEN kind = 'hadith' ELSE same < 6 OR kind = wanted END), {_loose_walk('tq', 'tp')},
rp AS (SELECT tp.query_id, tp.doc_id, kind, CASE WHEN wanted IS NULL THEN place + 12 ELSE place END AS place FROM tp JOIN sh ON sh.query_id = tp.query_id AND sh.doc_id = tp.doc_id
  UNION ALL SELECT query_id, doc_id, kind, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM sh WHERE wanted IS NULL AND kind = 'ayah') WHERE place <= 12)"""
RULING_POOL = f"WITH RECURSIVE {_RULING_SQL} SELECT query_id, doc_id, kind, place FROM rp"

#: The default judge of relevance: halfway between sure and a score's share of the query's best one.
_RELEVANCE = "0.5 + 0.5 * score / best"
_BEST_SQL = "mx AS (SELECT query_id, max(score) AS best FROM sh GROUP BY 1)"


def _relevant(pool: DataFrame, short: DataFrame) -> DataFrame:
    best = short.groupBy("query_id").agg(F.max("score").alias("best"))
    rows = pool.join(short.select("query_id", "doc_id", "tokens", "score", "severity"), ["query_id", "doc_id"]).join(best, "query_id")
    return search.relevant(rows, F.expr(_RELEVANCE))


def ruling_list(spark: SparkSession, d: str) -> DataFrame:
    """What a ruling question gets: the relevant texts of its pool, looser copies merged, sounder ones first, at most eight."""
    short = _short(spark, d)
    return _relevant(search.ruling_pool(short), short).select("query_id", "doc_id", "place", "severity", F.round("relevance", 6).alias("relevance"))


_LISTED = "row_number() OVER (PARTITION BY query_id ORDER BY CASE severity WHEN 'quran' THEN 0 WHEN 'sahih' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END, round(relevance, 9) DESC, doc_id) AS place"
RULING_LIST = f"""WITH RECURSIVE {_RULING_SQL}, {_BEST_SQL},
rq AS (SELECT rp.query_id, rp.doc_id, row_number() OVER (PARTITION BY rp.query_id ORDER BY place) AS nth, 1000 AS most FROM rp JOIN sh ON sh.query_id = rp.query_id AND sh.doc_id = rp.doc_id JOIN mx ON mx.query_id = rp.query_id WHERE {_RELEVANCE} >= 0.75),
{_loose_walk('rq', 're')}, rr AS (SELECT re.query_id, re.doc_id, severity, {_RELEVANCE} AS relevance FROM re JOIN sh ON sh.query_id = re.query_id AND sh.doc_id = re.doc_id JOIN mx ON mx.query_id = re.query_id)
SELECT query_id, doc_id, place, severity, round(relevance, 6) AS relevance FROM (SELECT *, {_LISTED} FROM rr) WHERE place <= 8"""


def _quoted(final: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds quote_ok: whether a text (tokens) holds enough of its query's words."""
    words = queries.select("query_id", lexical.words(F.col("text")).alias("qw"))
    return final.join(words, "query_id").withColumn("quote_ok", decision.quote_contained(F.col("qw"), F.col("tokens")))


def answers_full(spark: SparkSession, d: str) -> DataFrame:
    """From query to answer: the search's shortlist without its reserve in groups, finalists, final choice with its report's
    probability, checks of kind and quotation, the list of a broad query (every third), and which of them is the answer."""
    short = _short(spark, d)
    offered = short.where("not reserve").withColumn("rank", F.col("place"))
    last = decision.finalists(decision.winners(decision.choice(decision.groups(offered), F.col("score") * LOGIT, sq.NONE), runner_up=0.05))
    last = decision.choice(last.drop("p", "p_none", "nth"), F.col("score") * LOGIT, sq.NONE, ("query_id",))
    broad = F.col("query_id") % 3 == 0
    listed = _relevant(search.topic_pool(offered).where(broad), short)
    asked = short.select("query_id").distinct().withColumn("broad", broad)
    out = search.answered(asked, _quoted(last, sq._queries(spark, d)), listed)
    return out.select("query_id", "verdict", "doc_id", F.round("p_report", 6).alias("p_report"), "texts")


def _share_sql(over: str, logit: float = LOGIT, more: str = "") -> str:
    whole = f"(sum(exp(score * {logit})) OVER {over}{more} + exp({sq.NONE}))"
    return f"exp(score * {logit}) / {whole} AS p, exp({sq.NONE}) / {whole} AS p_none"


#: From fi (query_id, doc_id, kind, rank, wanted, p, p_none), lo and tok to pk4: the finalist that stands, with its report's probability.
_PICKED_SQL = f"""pk1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(p, 9) DESC, rank) AS k FROM fi) WHERE k = 1 AND round(p, 9) >= round(p_none, 9)),
pk2 AS (SELECT pk1.*, pk1.p + coalesce((SELECT sum(f.p) FROM fi f JOIN lo ON lo.x = pk1.doc_id AND lo.y = f.doc_id WHERE f.query_id = pk1.query_id), 0) AS pr FROM pk1),
qw AS (SELECT item_id AS query_id, {word_list('text')} AS qw FROM benchmark),
pk3 AS (SELECT pk2.query_id, pk2.doc_id, pr, kind, wanted, CASE WHEN round(pr, 9) >= 0.7 THEN 'confident' WHEN round(pr, 9) >= 0.45 THEN 'tentative' ELSE 'unsure' END AS band,
         CASE WHEN len(qw) = 0 THEN true WHEN len(qw) <= 2 THEN len(list_filter(qw, lambda x: list_contains(tok.w, x))) = len(qw) ELSE len(list_filter(qw, lambda x: list_contains(tok.w, x))) / len(qw) >= 0.5 END AS quote_ok
       FROM pk2 JOIN qw USING (query_id) JOIN tok ON tok.doc_id = pk2.doc_id),
pk4 AS (SELECT * FROM pk3 WHERE CASE WHEN wanted IS NOT NULL AND kind <> wanted THEN band = 'confident' ELSE quote_ok END)"""
#: From al (query_id, doc_id, pr, band, n, broad) to the answer.
_ANSWER_SQL = """SELECT query_id, CASE WHEN single THEN band WHEN lists THEN 'topic' WHEN doc_id IS NOT NULL THEN band ELSE 'no_match' END AS verdict, CASE WHEN single OR NOT lists THEN doc_id END AS doc_id,
       CASE WHEN single OR NOT lists THEN round(pr, 6) END AS p_report, CAST(CASE WHEN lists AND NOT single THEN n ELSE 0 END AS BIGINT) AS texts FROM fl"""
_FL_SQL = "fl AS (SELECT *, broad AND n > 0 AS lists, doc_id IS NOT NULL AND (NOT broad OR (band = 'confident' AND round(pr, 9) >= 0.9)) AS single FROM al)"
ANSWERS_FULL = f"""WITH RECURSIVE {_TOPIC_SQL},
gr AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1) / 12) AS BIGINT) AS group_id FROM sh WHERE NOT reserve),
ju AS (SELECT *, {_share_sql('g')} FROM gr WINDOW g AS (PARTITION BY query_id, group_id)),
nt AS (SELECT *, row_number() OVER (PARTITION BY query_id, group_id ORDER BY round(p, 9) DESC, rank) AS nth, max(round(p, 9)) OVER (PARTITION BY query_id, group_id) >= round(p_none, 9) AS won FROM ju),
wi AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(p, 9) DESC, rank) AS k FROM nt WHERE won AND (nth = 1 OR (nth = 2 AND p >= 0.05))),
fi AS (SELECT query_id, doc_id, kind, rank, wanted, {_share_sql('q')} FROM wi WHERE k <= 12 WINDOW q AS (PARTITION BY query_id)), {_PICKED_SQL}, {_BEST_SQL},
rq AS (SELECT tp.query_id, tp.doc_id, row_number() OVER (PARTITION BY tp.query_id ORDER BY place) AS nth, 1000 AS most FROM tp JOIN sh ON sh.query_id = tp.query_id AND sh.doc_id = tp.doc_id JOIN mx ON mx.query_id = tp.query_id WHERE tp.query_id % 3 = 0 AND {_RELEVANCE} >= 0.75),
{_loose_walk('rq', 're')}, nl AS (SELECT query_id, least(count(*), 8) AS texts FROM re GROUP BY 1),
al AS (SELECT a.query_id, pk4.doc_id, pr, band, coalesce(texts, 0) AS n, a.query_id % 3 = 0 AS broad FROM (SELECT DISTINCT query_id FROM sh) a LEFT JOIN pk4 ON pk4.query_id = a.query_id LEFT JOIN nl ON nl.query_id = a.query_id), {_FL_SQL}
{_ANSWER_SQL}"""


def knockout_run(spark: SparkSession, d: str) -> DataFrame:
    """A knockout over the whole corpus from query to answer: a request for a ruling (every seventh) is referred before any text is
    read; who is left is chosen from; a broad query (every third) gets a list from the likeliest winners of the first round."""
    left, first = sq._knocked_out(spark, d)
    likely = written(search.knockout_likeliest(first.select("query_id", "doc_id", "place", "p", "score")).drop("nth"), "likeliest")
    shown = left.select("query_id", "doc_id").union(likely.select("query_id", "doc_id"))  # some 70 a query; no other text is read
    texts = written(sq._texts(spark, d, shown).select("doc_id", "kind", "tokens"), "texts")
    scores = index.pair_scores(sq._index(spark, d), sq._queries(spark, d), left.select("query_id", "doc_id")).select("query_id", "doc_id", F.round("score", 6).alias("score"))
    last = left.select("query_id", "doc_id", "place").join(scores, ["query_id", "doc_id"]).withColumn("rank", F.col("place"))
    final = decision.choice(last, F.col("score") * sq.LOGIT, sq.NONE, ("query_id",)).join(texts, "doc_id").join(sq._wanted(spark, d), "query_id")
    won = likely.join(texts, "doc_id")
    asked = sq._queries(spark, d).select("query_id", (F.col("query_id") % 3 == 0).alias("broad"), F.when(F.col("query_id") % 7 == 0, 0.9).otherwise(0.1).alias("p_fatwa"))
    best = first.groupBy("query_id").agg(F.max("score").alias("best"))
    pool = search.knockout_topic(won).join(won.select("query_id", "doc_id", "tokens", "score"), ["query_id", "doc_id"]).join(best, "query_id").withColumn("severity", F.when(F.col("kind") == "ayah", "quran").otherwise("unknown"))
    listed = search.relevant(pool.where(F.col("query_id") % 3 == 0), F.expr(_RELEVANCE))
    out = search.knockout_answered(asked, _quoted(final, sq._queries(spark, d)), listed)
    return out.select("query_id", "verdict", "doc_id", F.round("p_report", 6).alias("p_report"), "texts")


KNOCKOUT_RUN = f"""{sq._knockout_sql().replace("WITH ", "WITH RECURSIVE ", 1)},
kd AS (SELECT doc_id, CASE WHEN source = 'src0' THEN 'ayah' ELSE 'hadith' END AS kind FROM documents),
lt AS (SELECT doc_id, list_sort(list_distinct(w)) AS t FROM tok JOIN kd USING (doc_id) WHERE kind = 'hadith' AND doc_id IN (SELECT doc_id FROM a1)), le AS (SELECT doc_id, len(t) AS n, unnest(t) AS w FROM lt WHERE len(t) >= 5),
lo AS (SELECT a.doc_id AS x, b.doc_id AS y FROM le a JOIN le b ON a.w = b.w AND a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING count(*) >= CAST(0.6 AS DOUBLE) * least(any_value(a.n), any_value(b.n))
       UNION SELECT a.doc_id, b.doc_id FROM lt a JOIN lt b ON a.t = b.t AND len(a.t) >= 2 AND a.doc_id <> b.doc_id),
lp AS (SELECT x AS doc_id, list(y) AS partners FROM lo GROUP BY 1),
fi AS (SELECT query_id, a6.doc_id, kind, place AS rank, {sq._WANTED_SQL} AS wanted, {_share_sql('q', sq.LOGIT)} FROM a6 JOIN kd USING (doc_id) WINDOW q AS (PARTITION BY query_id)), {_PICKED_SQL},
t1 AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(p, 9) DESC, place) AS nth, 60 AS most FROM a1), tq AS (SELECT * FROM t1 WHERE nth <= 60), {_loose_walk('tq', 'tp')},
mx AS (SELECT query_id, max(score) AS best FROM a1 GROUP BY 1),
rq AS (SELECT tp.query_id, tp.doc_id, row_number() OVER (PARTITION BY tp.query_id ORDER BY tp.place) AS nth, 1000 AS most FROM tp JOIN a1 ON a1.query_id = tp.query_id AND a1.doc_id = tp.doc_id JOIN mx ON mx.query_id = tp.query_id WHERE tp.query_id % 3 = 0 AND {_RELEVANCE} >= 0.75),
{_loose_walk('rq', 're')}, nl AS (SELECT query_id, least(count(*), 8) AS texts FROM re GROUP BY 1),
al AS (SELECT a.query_id, pk4.doc_id, pr, band, coalesce(texts, 0) AS n, a.query_id % 3 = 0 AS broad FROM (SELECT item_id AS query_id FROM benchmark WHERE item_id % 7 <> 0) a LEFT JOIN pk4 ON pk4.query_id = a.query_id LEFT JOIN nl ON nl.query_id = a.query_id), {_FL_SQL}
{_ANSWER_SQL} UNION ALL SELECT item_id, 'fatwa_request', NULL, NULL, 0 FROM benchmark WHERE item_id % 7 = 0"""


def _length_judge():
    """A deterministic judge: an option's logit is half its length modulo 7, that of no match 1; the second request of every seventh
    query fails."""
    import math

    def judge(requests):
        replies = []
        for r in requests:
            if r["query_id"] % 7 == 3 and r["request"] == 1:
                replies.append(TimeoutError("no reply in time"))
                continue
            tokens, found = 0, {}
            for q in r["questions"]:
                tokens += len(q["prompt"]) + sum(len(o["text"]) for o in q["options"])
                if q["kind"] == "noul":
                    found[q["key"]] = {"yes": len(q["prompt"]) % 10 / 10}
                else:
                    e = {o["option"]: math.exp(len(o["text"]) % 7 / 2) for o in q["options"]} | {"no_match": math.e}
                    whole = math.fsum(e.values())
                    found[q["key"]] = {k: v / whole for k, v in e.items()}
            replies.append({"tokens": tokens, "answers": found})
        return replies

    return judge


def judged_tokens(spark: SparkSession, d: str) -> DataFrame:
    """A judge asked of each query's groups of candidates, six questions a request: what that costs, who can't be decided, and the
    likeliest text of the others."""
    pool = decision.groups(sq._pool(spark, d)).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    specific = judge.nouls(sq._queries(spark, d), F.lit("specific"), F.col("text"))
    questions = judge.choices(pool, "Which text?").unionByName(specific)
    replies = written(judge.called(questions, _length_judge, 6), "replies")
    said = judge.answers(replies)
    chosen = said.join(pool.select("query_id", F.concat(F.lit("g"), F.col("group_id").cast("string")).alias("key"), "option", "doc_id", "rank"), ["query_id", "key", "option"])
    best = chosen.groupBy("query_id").agg(F.min(F.struct(-F.round("p", 9), "rank", "doc_id"))["doc_id"].alias("doc_id"))
    yes = said.where("key = 'specific'").select("query_id", F.round("p", 6).alias("specific"))
    return judge.totals(replies).join(best, "query_id", "left").join(yes, "query_id", "left")


JUDGED_TOKENS = f"""WITH {sq._JUDGED_SQL}, tx AS (SELECT gr.query_id, group_id, rank, gr.doc_id, length(replace(left(text, 420), '"', '''')) AS n FROM gr JOIN documents USING (doc_id)),
ks AS (SELECT query_id, 'g' || group_id AS key, sum(n) + 11 AS tokens FROM tx GROUP BY 1, group_id UNION ALL SELECT item_id, 'specific', length(text) FROM benchmark),
rq AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY query_id ORDER BY key) - 1) / 6) AS BIGINT) AS request FROM ks), rr AS (SELECT query_id, request, sum(tokens) AS tokens, query_id % 7 = 3 AND request = 1 AS bad FROM rq GROUP BY 1, 2),
tt AS (SELECT query_id, count(*) AS requests, CAST(sum(CASE WHEN bad THEN 0 ELSE tokens END) AS BIGINT) AS tokens, count(*) FILTER (bad) AS failed FROM rr GROUP BY 1),
pp AS (SELECT *, exp(n % 7 / 2.0) / (sum(exp(n % 7 / 2.0)) OVER (PARTITION BY query_id, group_id) + exp(1)) AS p FROM tx),
bb AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(p, 9) DESC, rank) AS k FROM pp) WHERE k = 1)
SELECT query_id, requests, tokens, failed, CASE WHEN failed > 0 THEN 'decision_unavailable' ELSE 'decided' END AS status, CASE WHEN failed = 0 THEN doc_id END AS doc_id,
       CASE WHEN failed = 0 THEN length(b.text) % 10 / 10.0 END AS specific FROM tt LEFT JOIN bb USING (query_id) JOIN benchmark b ON b.item_id = query_id"""


def crosscheck_hits(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as records of two books, harvested results about them with other rulings: how often each pair meets."""
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = F.col("doc_id")
    book = F.when(n % 2 == 0, "مسلم").otherwise("الترمذي")
    records = labels.select(n.alias("id"), book.alias("token"), n.cast("string").alias("number"), F.when(F.col("quality") == 1, "sahih").otherwise("daif").alias("ours"))
    page = F.when(n % 3 == 0, n.cast("string")).when(n % 3 == 1, F.concat(F.lit("ص "), n.cast("string"), F.lit(" / "), (n + 2).cast("string"))).otherwise(F.concat(n.cast("string"), F.lit("0")))
    source = F.when(n % 5 == 0, "صحيح مسلم").when(n % 5 == 1, "سنن الترمذي").otherwise("جامع مسلم والترمذي")
    ruling = F.when(n % 4 == 0, "موضوع").when(n % 4 == 1, "صحيح").otherwise("إسناده ضعيف")
    hits = table(spark, d, "documents").select(n.alias("hit_id"), source.alias("source"), page.alias("page"), grades.severity_of_ruling(ruling).alias("theirs"))
    return corpus.agreement(corpus.crosschecked(records, hits), "ours", "theirs")


CROSSCHECK_HITS = """WITH r AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'مسلم' ELSE 'الترمذي' END AS token, CASE WHEN max(quality) = 1 THEN 'sahih' ELSE 'daif' END AS ours FROM labels GROUP BY doc_id),
h AS (SELECT doc_id AS n, CASE doc_id % 5 WHEN 0 THEN 'صحيح مسلم' WHEN 1 THEN 'سنن الترمذي' ELSE 'جامع مسلم والترمذي' END AS source, CASE doc_id % 4 WHEN 0 THEN 'mawdu' WHEN 1 THEN 'sahih' ELSE 'daif' END AS theirs,
        CASE doc_id % 3 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN 'ص ' || doc_id || ' / ' || (doc_id + 2) ELSE doc_id || '0' END AS page FROM documents)
SELECT ours, theirs, count(*) AS n FROM r JOIN h ON contains(replace(source, 'والترمذي', 'والترمذي الترمذي'), token) AND list_contains(regexp_extract_all(page, '[0-9]+'), CAST(id AS VARCHAR)) GROUP BY 1, 2"""

REMARK = "قال أبو عيسى هذا حديث حسن"


def hydrate_full(spark: SparkSession, d: str) -> DataFrame:
    """The best texts of each query with all that a reader gets: from the display store the text and its book, the compiler's remark
    off the text, a link where it can be checked, and the words that were searched."""
    path = f"{shared_dir(spark)}/quern-display-{index.fingerprint(spark, f'{d}/documents.parquet')}"
    if not exists(spark, f"{path}/_SUCCESS"):
        body = F.when(sq._kind(F.col("source")) == "hadith", F.concat(F.col("text"), F.lit(". " + REMARK))).otherwise(F.col("text"))
        display.store(table(spark, d, "documents").select("doc_id", "lang", "source", body.alias("matn")), path, "doc_id")
    top = sq._lexical_top(spark, d, 5).select("query_id", "rank", "doc_id")
    rows = display.lookup(spark, path, top, "doc_id").withColumns({"kind": sq._kind(F.col("source")), "parts": parse.split_remark(F.col("matn"))})
    rows = rows.withColumn("core", F.when(F.col("kind") == "hadith", F.col("parts.core")).otherwise(F.col("matn")))
    link = search.linked(F.col("kind"), lexical.words(F.col("core")), F.floor(F.col("doc_id") / 10), F.col("doc_id") % 10, "https://example.org/search?q={q}", "https://example.org/{chapter}/{verse}")
    return rows.select("query_id", "rank", "doc_id", "source", md5(F.col("core")).alias("core_md5"), F.when(F.col("kind") == "hadith", F.col("parts.remark")).alias("remark"), link.alias("link"), md5(text.surface_text(F.col("lang"), F.col("core"))).alias("surface_md5"))


HYDRATE_FULL = f"""WITH {sq.BM25}, t AS (SELECT query_id, rank, doc_id, source, text, CASE WHEN source = 'src0' THEN text ELSE trim(rtrim(text, ' .,،؛"''‏‎')) END AS core FROM ({sq._rank_sql('bm')}) JOIN documents USING (doc_id) WHERE rank <= 5),
w AS (SELECT *, {word_list('core')} AS w FROM t), p AS (SELECT *, array_to_string(list_slice(w, CAST(greatest(0, floor((len(w) - 8) / 2)) AS BIGINT) + 1, CAST(greatest(0, floor((len(w) - 8) / 2)) AS BIGINT) + 8), ' ') AS phrase FROM w)
SELECT query_id, rank, doc_id, source, md5(core) AS core_md5, CASE WHEN source <> 'src0' THEN '{REMARK}' END AS remark,
       CASE WHEN source = 'src0' THEN 'https://example.org/' || (doc_id // 10) || '/' || (doc_id % 10) ELSE 'https://example.org/search?q=' || replace(url_encode(phrase), '%2F', '/') END AS link, md5({latin('core')}) AS surface_md5 FROM p"""


def decided_once(spark: SparkSession, d: str) -> DataFrame:
    """One choice among all 120 candidates of a query, its band on twice its probability."""
    out = answers.decided_once(sq._pool(spark, d), F.col("score") * sq.LOGIT, sq.NONE, F.col("p") * 2)
    return out.select("query_id", "verdict", "doc_id", F.round("p", 6).alias("p"))


DECIDED_ONCE = f"""WITH {sq._POOL_SQL}, ju AS (SELECT *, {_share_sql('q', sq.LOGIT)} FROM pool WINDOW q AS (PARTITION BY query_id)),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(p, 9) DESC, rank) AS k FROM ju) WHERE k = 1 AND round(p, 9) >= round(p_none, 9)), q AS (SELECT DISTINCT query_id FROM pool)
SELECT q.query_id, CASE WHEN doc_id IS NULL THEN 'no_match' WHEN round(p * 2, 9) >= 0.7 THEN 'confident' WHEN round(p * 2, 9) >= 0.45 THEN 'tentative' ELSE 'unsure' END AS verdict, doc_id, round(p, 6) AS p FROM q LEFT JOIN w ON w.query_id = q.query_id"""

_URLS = {"fiqh": "https://example.org/fiqh", "belief": "https://example.org/belief", "objection": "https://example.org/objections"}


def referral_urls(spark: SparkSession, d: str) -> DataFrame:
    """Where a question of a kind is sent, for readers of the documents' languages; a search for the subject words of its text."""
    n = F.col("doc_id")
    kind = F.when(n % 4 == 0, "fiqh").when(n % 4 == 1, "belief").when(n % 4 == 2, "other")
    lang = F.when(n % 5 == 0, F.lit(None).cast("string")).when(n % 5 == 1, "ar").otherwise(F.col("lang"))
    words = lexical.words(F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", kind.alias("kind"), lang.alias("lang"), F.when(n % 3 == 0, F.array(F.lit("the"), F.lit("la"))).otherwise(words).alias("words"))
    home = "https://example.org/"
    return rows.select("doc_id", search.referred(F.col("kind"), F.col("lang"), _URLS, "objection", ("belief", "objection")).alias("refer"), search.subject_url(F.col("words"), ("the", "la", "de", "der"), home + "s?q={q}", home, 6).alias("subject"))


REFERRAL_URLS = f"""WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'fiqh' WHEN 1 THEN 'belief' ELSE 'objection' END AS k, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'ar' ELSE lang END AS lang,
  CASE WHEN doc_id % 3 = 0 THEN [] ELSE list_filter({word_list('text')}, lambda x: x NOT IN ('the', 'la', 'de', 'der'))[1:6] END AS w FROM documents)
SELECT doc_id, CASE k WHEN 'fiqh' THEN 'https://example.org/fiqh' WHEN 'belief' THEN 'https://example.org/belief' ELSE 'https://example.org/objections' END || CASE WHEN k <> 'fiqh' AND lang <> 'ar' THEN CASE WHEN lang = 'fr' THEN '?lang=fr' ELSE '?lang=en' END ELSE '' END AS refer,
  CASE WHEN len(w) > 0 THEN 'https://example.org/s?q=' || replace(url_encode(array_to_string(w, ' ')), '%2F', '/') ELSE 'https://example.org/' END AS subject FROM r"""


_PLAIN = (hydrate_topk, alternatives, final_verdicts, translation_choice, retriever_overlap, knockout_corpus, request_packs, topic_pool, ruling_pool, ruling_list, answers_full, knockout_run, judged_tokens, crosscheck_hits, hydrate_full, decided_once, referral_urls)
QUERIES = {f.__name__: f for f in _PLAIN}
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in _PLAIN}
