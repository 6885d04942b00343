"""Answers: late materialisation, translations, alternatives, messages, case checks, request packing, and search end to end."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.functions.text import ALEF_VARIANTS, fold, mostly_arabic, normalize, normalize_latin, strip_tags, visible
from quern.operators import decision, dense, fusion, lexical
from quern.operators import index as inverted
from quern.operators.sizes import if_small
from quern.sources.scratch import written
from quern.streaming.events import streamed

ALTERNATIVES, LEAST_ALTERNATIVE = 3, 0.05


def hydrated(top: DataFrame, display: DataFrame, key: str = "doc_id") -> DataFrame:
    """The display columns of what the ranking kept; joined after the cut, so only these rows are widened."""
    return top.join(display, key, "left")


def translation(records: DataFrame, credits: DataFrame, lang: Column) -> DataFrame:
    """Adds translation: struct<lang, text, translator> of (id, kind, collection_key, translations) for readers of `lang`.

    None for readers of Arabic, none that is mostly Arabic itself (unless Urdu); tags off; unknown translators are null.
    `credits`: kind, lang, collection_key (null for verses), author.
    """
    text = F.try_element_at("translations", F.col("_lang"))
    rows = records.withColumn("_lang", lang).withColumn("_text", F.when((F.col("_lang") != "ar") & ((F.col("_lang") == "ur") | ~mostly_arabic(text)), F.nullif(text, F.lit(""))))
    c = credits.select(F.col("kind").alias("_k"), F.col("lang").alias("_l"), F.col("collection_key").alias("_c"), "author")
    on = (F.col("kind") == F.col("_k")) & (F.col("_lang") == F.col("_l")) & ((F.col("kind") == "ayah") | (F.col("collection_key") == F.col("_c")))
    joined = rows.join(if_small(c), on, "left")
    author = F.when(~F.col("author").isin("", "Unknown"), F.col("author"))
    shown = F.when(F.col("_text").isNotNull(), F.struct(F.col("_lang").alias("lang"), strip_tags(F.col("_text")).alias("text"), author.alias("translator")))
    return joined.withColumn("translation", shown).drop("_lang", "_text", "_k", "_l", "_c", "author")


def alternatives(probabilities: DataFrame, chosen: DataFrame, most: int = ALTERNATIVES, least: float = LEAST_ALTERNATIVE) -> DataFrame:
    """query_id, doc_id, p, place: the likeliest others, neither the chosen text nor its copies (chosen: query_id, doc_id, family)."""
    out = probabilities.where(F.col("p") >= least).join(chosen.select("query_id", F.col("doc_id").alias("_own"), F.coalesce("family", F.array().cast("array<bigint>")).alias("_family")), "query_id", "left")
    out = out.where(F.col("_own").isNull() | ((F.col("doc_id") != F.col("_own")) & ~F.array_contains("_family", F.col("doc_id"))))
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("p", 9).desc(), "doc_id"))
    return out.withColumn("place", nth).where(F.col("place") <= most).select("query_id", "doc_id", "p", "place")


def shown_variants(variants: Column, own_ref: Column) -> Column:
    """The distinct refs of array<struct<ref, ...>>, without the shown one."""
    return F.array_distinct(F.filter(F.transform(variants, lambda v: v["ref"]), lambda r: r != own_ref))


def check(answers: DataFrame) -> DataFrame:
    """Adds failures (array of names) of answers against what a case allows; null expectations are not checked.

    Columns: verdict, shown array<struct<id, kind, matn, severity, variants array<string>>>, wording array<string>, ruling,
    and want_verdicts, want_has (id:... or text:...), want_kind, want_ruling, want_wording, not_sound.
    """
    c, none = F.col, F.lit(None).cast("string")

    def shows(h: Column) -> Column:
        value = F.regexp_replace(h, "^(id|text):", "")
        return F.exists("shown", lambda t: F.when(h.startswith("id:"), (t["id"] == value) | F.array_contains(t["variants"], value)).otherwise(normalize(t["matn"]).contains(normalize(value))))

    first = F.get("shown", F.lit(0))
    tests = {
        "verdict": ~F.array_contains("want_verdicts", c("verdict")),
        "has": ~F.exists("want_has", shows),
        "kind": (c("verdict") == "topic") & F.exists("shown", lambda t: t["kind"] != c("want_kind")),
        "ruling": ~c("ruling").eqNullSafe(c("want_ruling")),
        "wording": ~c("wording").eqNullSafe(c("want_wording")),
        "not_sound": (c("verdict") == "confident") & first["severity"].isin("sahih", "hasan", "quran") & ~normalize(first["matn"]).contains(normalize(c("not_sound"))),
    }
    wanted = {"verdict": "want_verdicts", "has": "want_has", "kind": "want_kind", "ruling": "want_ruling", "wording": "want_wording", "not_sound": "not_sound"}
    failed = [F.when(c(wanted[k]).isNotNull() & F.coalesce(t, F.lit(False)), k).otherwise(none) for k, t in tests.items()]
    return answers.withColumn("failures", F.array_compact(F.array(*failed)))


def packed_requests(groups: DataFrame, budget: int, overhead: int = 0) -> DataFrame:
    """query_id, group_id, request: groups (query_id, group_id, tokens) in order, a new request whenever the budget would be crossed."""

    def start():
        request, used = 0, 0

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal request, used
            out = []
            for t in pdf["tokens"]:
                cost = int(t) + overhead
                if used and used + cost > budget:
                    request, used = request + 1, 0
                used += cost
                out.append(request)
            return pdf[["query_id", "group_id"]].assign(request=out)

        return step

    rows = groups.select("query_id", F.col("group_id").cast("long").alias("group_id"), F.col("tokens").cast("long").alias("tokens"))
    return streamed(rows, "query_id", ["group_id"], start, "query_id long, group_id long, request long")


def token_totals(requests: DataFrame) -> DataFrame:
    """query_id, requests, tokens: what a search has cost, of its requests (query_id, request, tokens)."""
    return requests.groupBy("query_id").agg(F.countDistinct("request").alias("requests"), F.sum("tokens").alias("tokens"))


def case_totals(checked: DataFrame, by: str) -> DataFrame:
    """`by`, passed, n of checked cases (failures as from check(), `by`), and a row of all with `by` null."""
    passed = F.count_if(F.size("failures") == 0).alias("passed")
    return checked.rollup(by).agg(passed, F.count(F.lit(1)).alias("n"))


def honest(text: Column, phrase: Column, severity: Column) -> Column:
    """Whether a first hit for a saying that isn't sound does no harm: the text holds the saying, or is graded weak or fabricated. A
    saying of which the Arabic normal form drops letters is sought in a form that keeps those of all scripts; one of which that leaves
    nothing, in the form of other languages."""
    held = lambda form: (form(phrase) != "") & form(text).contains(form(phrase))
    whole = lambda c: normalize_latin(F.translate(fold(visible(c)), *ALEF_VARIANTS))
    kept = (normalize(phrase) != "") & (F.lower(normalize(phrase)) == whole(phrase))
    holds = F.coalesce(F.when(kept, held(normalize)).when(whole(phrase) != "", held(whole)).otherwise(held(normalize_latin)), F.lit(False))
    return holds | F.coalesce(severity.isin("mawdu", "daif"), F.lit(False))


def traced(dense: DataFrame, lexical_scores: DataFrame, fused: DataFrame, watched: DataFrame) -> DataFrame:
    """query_id, doc_id, dense_rank, lexical_rank, rank of the watched texts (query_id, doc_id) in each step of a search; null where
    one has no place in it. Scores: query_id, doc_id, score."""
    out = watched
    for df, name in ((dense, "dense_rank"), (lexical_scores, "lexical_rank"), (fused, "rank")):
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "doc_id"))
        out = out.join(df.select("query_id", "doc_id", place.alias(name)), ["query_id", "doc_id"], "left")
    return out


def decided_once(candidates: DataFrame, logit: Column, no_match: float, band_on: Column | None = None) -> DataFrame:
    """query_id, verdict, doc_id, p: one choice among all candidates (query_id, doc_id, rank, ...), its band on the confidence
    column `band_on` (else on p)."""
    chosen = decision.winners(decision.choice(candidates, logit, no_match, ("query_id",)), ("query_id",))
    chosen = chosen.select("query_id", "doc_id", "p", decision.band(F.round(F.col("p") if band_on is None else band_on, 9)).alias("verdict"))
    out = candidates.select("query_id").distinct().join(chosen, "query_id", "left")
    return out.select("query_id", F.coalesce("verdict", F.lit(decision.NO_MATCH)).alias("verdict"), "doc_id", "p")


def hybrid_pool(queries: DataFrame, docs: DataFrame, query_vectors: DataFrame, vectors: DataFrame, k: int = 400, w_dense: float = fusion.DENSE, w_lexical: float = fusion.LEXICAL, index: inverted.Index | None = None) -> DataFrame:
    """query_id, doc_id, dense, lexical, zd, zl, score: the k best of each retriever over all documents, fused. `queries`: query_id,
    text (its literal words); `query_vectors`: query_id, v; `vectors`: doc_id, v. One pass over the vectors, one over the documents,
    or none where they have an `index`."""
    found, summed = dense.cosine_pool(query_vectors, vectors, k)
    scores, sums, of = _lexical(queries, docs, k, index)
    return fusion.weighted_z(found, summed, lambda pairs: dense.pair_scores(pairs, query_vectors, vectors), scores, docs.count(), k, w_dense, w_lexical, sums, of)


def _lexical(queries: DataFrame, docs: DataFrame, k: int, index: inverted.Index | None) -> tuple:
    """What weighted_z() takes of the lexical retriever: by an index the best, the sums and a way to other scores; else all scores."""
    if index is None:
        return written(lexical.bm25(queries, docs), "lexical"), None, None
    scores, sums = inverted.pool(index, queries, k)
    return scores.drop("surface"), sums.drop("surface"), lambda pairs: inverted.pair_scores(index, queries, pairs).drop("surface")


def surface_pool(queries: DataFrame, index: inverted.Index, query_vectors: DataFrame, vectors: DataFrame, records: DataFrame, first: str, k: int = 400, w_dense: float = fusion.DENSE, w_lexical: float = fusion.LEXICAL) -> DataFrame:
    """query_id, record, score, surface: a record's best score over the surfaces that a query searches, each fused as a corpus of its
    own; ties go to the surface `first`, then by name.

    `queries`: query_id, text, surfaces; `query_vectors`: query_id, v, surfaces; `vectors`: doc_id, v, surface; `records`: doc_id,
    record. All surfaces are searched in one pass, of which each query sees its own.
    """
    found, summed = dense.cosine_pool(query_vectors, vectors, k)
    scores, sums = inverted.pool(index, queries, k)
    of = lambda pairs: inverted.pair_scores(index, queries, pairs)
    fused = fusion.weighted_z(found, summed, lambda pairs: dense.pair_scores(pairs, query_vectors, vectors), scores, inverted.sizes(index), k, w_dense, w_lexical, sums, of)
    return fusion.best_surface(fused.join(records, "doc_id"), first)


def hybrid_search(queries: DataFrame, docs: DataFrame, query_vectors: DataFrame, vectors: DataFrame, k: int = 12, w_dense: float = fusion.DENSE, w_lexical: float = fusion.LEXICAL, index: inverted.Index | None = None) -> DataFrame:
    """query_id, doc_id, rank, score. Weights of 0 switch a retriever off without running it."""
    if w_dense == 0:
        return lexical.top(lexical.bm25(queries, docs) if index is None else inverted.best(index, queries, k).drop("surface"), k)
    if w_lexical == 0:
        return lexical.top(dense.cosine_scores(query_vectors, vectors, k), k)
    fused = hybrid_pool(queries, docs, query_vectors, vectors, 400, w_dense, w_lexical, index)
    return lexical.top(fused, k, digits=5).select("query_id", "doc_id", "rank", "score")


def answered(pool: DataFrame, logit: Column, no_match: float) -> DataFrame:
    """query_id, verdict, doc_id, p: groups, finalists, final choice and its band; no_match where nobody beats the way out."""
    asked = pool.select("query_id").distinct()
    last = decision.finalists(decision.winners(decision.choice(decision.groups(pool), logit, no_match)))
    final = decision.winners(decision.choice(last.drop("p", "p_none", "nth"), logit, no_match, ("query_id",)), ("query_id",))
    out = asked.join(final.select("query_id", "doc_id", "p"), "query_id", "left")
    return out.select("query_id", F.when(F.col("doc_id").isNull(), decision.NO_MATCH).otherwise(decision.band(F.round("p", 9))).alias("verdict"), "doc_id", "p")


def health(docs: DataFrame, version: str) -> DataFrame:
    """One row: records, languages, version."""
    return docs.agg(F.count(F.lit(1)).alias("records"), F.countDistinct("lang").alias("languages")).select("records", "languages", F.lit(version).alias("version"))
