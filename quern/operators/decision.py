"""Decisions over ranked candidates: groups, argmax with a way out, tournament rounds, bands, router, lists.

A judge is any function that adds a logit to (query_id, doc_id, ...) rows; the default one is the retrieval score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.functions.grades import SEVERITY_ORDER, literal_map

GROUP, FINALISTS, RUNNER_UP = 12, 12, 0.25
HIGH, LOW = 0.70, 0.45
RELEVANT, MOST_LISTED = 0.75, 8
SPECIFIC, SAYING, HELD, JUDGE, QUESTION_TOPIC, BROAD_SINGLE = 0.35, 0.60, 0.75, 0.50, 0.50, 0.90
NO_MATCH = "no_match"


def groups(ranked: DataFrame, size: int = GROUP, by: str = "query_id", order: str = "rank") -> DataFrame:
    """Adds group_id (from 0) and option (c0, c1, ...): chunks of `size` in order."""
    nth = F.row_number().over(W.partitionBy(by).orderBy(order)) - 1
    return ranked.withColumn("group_id", F.floor(nth / size)).withColumn("option", F.concat(F.lit("c"), (nth % size).cast("string")))


def choice(grouped: DataFrame, logit: Column, no_match: float = 0.0, by: tuple[str, ...] = ("query_id", "group_id"), silent: Column | None = None, known: Column | None = None) -> DataFrame:
    """Adds p (share of the option in its group, with a no_match option of constant logit) and p_none. `silent`: how many options of
    the group have no row because the judge says nothing of them, a logit of 0. `known`: the sum that p is a share of, where the group's
    rows are not all there."""
    w = W.partitionBy(*by)
    e = F.exp(logit)
    whole = F.sum(e).over(w) + F.exp(F.lit(no_match)) + (F.lit(0.0) if silent is None else silent - F.count(F.lit(1)).over(w))
    whole = whole if known is None else known
    return grouped.withColumns({"p": e / whole, "p_none": F.exp(F.lit(no_match)) / whole})


def winners(chosen: DataFrame, by: tuple[str, ...] = ("query_id", "group_id"), runner_up: float | None = None, digits: int = 9) -> DataFrame:
    """The best option of each group unless no_match beats it; with `runner_up`, also the second if it has so much. A group that
    no_match has won sends nobody on."""
    place = W.partitionBy(*by).orderBy(F.round("p", digits).desc(), "rank")
    best = F.max(F.round("p", digits)).over(W.partitionBy(*by))
    out = chosen.withColumns({"nth": F.row_number().over(place), "_won": best >= F.round("p_none", digits)}).where("_won").drop("_won")
    goes_on = F.col("nth") == 1
    if runner_up is not None:
        goes_on = goes_on | ((F.col("nth") == 2) & (F.col("p") >= runner_up))
    return out.where(goes_on)


def finalists(won: DataFrame, most: int = FINALISTS, digits: int = 9) -> DataFrame:
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("p", digits).desc(), "rank"))
    return won.withColumn("final_rank", nth).where(F.col("final_rank") <= most)


def band(p: Column) -> Column:
    return F.when(p >= HIGH, "confident").when(p >= LOW, "tentative").otherwise("unsure")


def family_probability(final: DataFrame, family: DataFrame) -> DataFrame:
    """query_id, doc_id, p, p_family of the chosen candidate: its own probability and that of its copies among the finalists.

    `family`: x, y pairs of copies. Copies only add to the text already chosen.
    """
    w = W.partitionBy("query_id").orderBy(F.round("p", 9).desc(), "rank")
    chosen = final.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("query_id", "doc_id", "p")
    either = family.select(F.col("x").alias("doc_id"), F.col("y").alias("copy")).union(family.select(F.col("y"), F.col("x")))
    copies = chosen.join(either, "doc_id").join(final.select("query_id", F.col("doc_id").alias("copy"), F.col("p").alias("p_copy")), ["query_id", "copy"])
    sums = copies.groupBy("query_id").agg(F.sum("p_copy").alias("more"))
    return chosen.join(sums, "query_id", "left").select("query_id", "doc_id", "p", (F.col("p") + F.coalesce("more", F.lit(0.0))).alias("p_family"))


def knockout(judged: DataFrame, texts: int, judge_logit: Column, cut, first: int = 20, later: int = 12, final: int = 12, no_match: float = 0.0) -> DataFrame:
    """query_id, doc_id, place, p, round: who is left of all texts after rounds of groups; runners-up go on as well.

    `judged`: query_id, doc_id, place of the text in the corpus' fixed order (from 0, of `texts` in all) and what the judge
    needs; texts without a row have a logit of 0 (`no_match` must be more, so none of them wins). Round one takes groups
    of `first` in that order; later ones groups of `later` by falling probability, until at most `final` are left; a round that
    takes nobody out ends it, too. `cut` stores a round's survivors and returns them read back; rounds are few, as each
    leaves at most two of a group. Where `judged` has a column `whole`, as from index.likeliest(), it has of each group of round one no more than
    the texts that may win or come second.
    """
    names = [c for c in judged.columns if c not in ("p", "round", "whole")]
    known = {"known": F.col("whole")} if "whole" in judged.columns else {}
    group = F.floor(F.col("place") / first)
    size = F.least(F.lit(first), F.lit(texts) - group * first)
    won = winners(choice(judged.select(*names, *known.values(), group.alias("group_id"), F.col("place").alias("rank")), judge_logit, no_match, silent=size, **known), runner_up=RUNNER_UP)
    alive, number = cut(won.select(*names, "p", F.lit(1).alias("round"))), 1
    by_p = W.partitionBy("query_id").orderBy(F.round("p", 9).desc(), "place")
    while True:
        counted = alive.withColumn("alive", F.count(F.lit(1)).over(W.partitionBy("query_id")))
        more = counted.where((F.col("alive") > final) & (F.col("round") == number))
        if not more.limit(1).count():
            return alive.select("query_id", "doc_id", "place", "p", "round")
        number += 1
        ranked = more.withColumn("rank", F.row_number().over(by_p))
        # the last round's probability makes the groups; in one, texts of equal probability stand by their place
        grouped = groups(ranked.drop("p"), later).withColumn("rank", F.col("place"))
        won = winners(choice(grouped, judge_logit, no_match), runner_up=RUNNER_UP)
        won = won.withColumn("left", F.count(F.lit(1)).over(W.partitionBy("query_id"))).withColumn("nth", F.row_number().over(by_p))
        stuck = F.col("left") >= F.col("alive")
        # a query that loses nobody is cut to `final` and stays as it is
        won = won.where(~stuck | (F.col("nth") <= final)).select(*names, "p", F.lit(number).alias("round"))
        alive = cut(counted.where((F.col("alive") <= final) | (F.col("round") < number - 1)).select(*names, "p", "round").unionByName(won))


def same_report(a: Column, b: Column, least: float = 0.60, tokens: int = 5) -> Column:
    """Whether two arrays of distinct words are copies of one report: the same ones, or enough of the smaller in the larger."""
    small = F.least(F.size(a), F.size(b))
    return (F.size(F.array_intersect(a, b)) >= least * small) & ((small >= tokens) | ((small >= 2) & (F.size(a) == F.size(b)) & (F.size(F.array_except(a, b)) == 0)))


def listed(relevance: DataFrame, most: int = MOST_LISTED, least: float = RELEVANT) -> DataFrame:
    """The relevant texts of a query: sounder severity first, then relevance, at most `most`."""
    order = F.coalesce(F.try_element_at(literal_map(SEVERITY_ORDER), F.col("severity")), F.lit(1))
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(order, F.round("relevance", 9).desc(), "doc_id"))
    return relevance.where(F.col("relevance") >= least).withColumn("place", nth).where(F.col("place") <= most)


def route(q: DataFrame) -> DataFrame:
    """Adds verdict by the decision table; the first row that fits wins.

    Needs: p_general, p_personal, p_question, p_judge, p_islamic, p_specific, p_saying, names_kind, starts_as_question,
    is_question_form, has_ruling_word, n_finalists, pick_passes, pick_p, n_relevant.
    """
    c = F.col
    ruling = c("p_general") + c("p_personal")
    question = F.when(c("is_question_form") & (c("p_islamic") >= QUESTION_TOPIC), c("p_question")).otherwise(0.0)
    names = c("names_kind") & ~c("starts_as_question")
    held = ruling + question + c("p_judge") >= HELD
    early = ~names | c("has_ruling_word")
    no_word = ~c("has_ruling_word")
    pool = (c("p_specific") < SPECIFIC) & (c("p_saying") < SAYING)
    confident = c("pick_p") >= HIGH
    single = c("pick_passes") & (~pool | (confident & (c("pick_p") >= BROAD_SINGLE)))
    verdict = (
        F.when(early & no_word & ((c("p_judge") >= JUDGE) | (held & (c("p_judge") >= F.greatest(ruling, question)))), "out_of_scope")
        .when(early & held & (question > ruling) & no_word, "question")
        .when(early & held & (ruling > 0), F.when(c("p_personal") >= c("p_general"), "ruling_personal").otherwise("ruling_general"))
        .when((c("n_finalists") == 0) & ~pool, NO_MATCH)
        .when(single, band(c("pick_p")))
        .when(pool & (c("n_relevant") > 0), "topic")
        .when(c("pick_passes"), band(c("pick_p")))
        .otherwise(NO_MATCH)
    )
    return q.withColumn("verdict", verdict)


def quote_contained(content: Column, text_words: Column, least: float = 0.5) -> Column:
    """Whether enough of a quotation's content words are in a text: all of one or two, else `least` of them."""
    found = F.size(F.filter(content, lambda w: F.array_contains(text_words, w)))
    n = F.size(content)
    return F.when(n == 0, True).when(n <= 2, found == n).otherwise(found / n >= least)


def missing_positions(query_words: Column, vocabulary: Column) -> Column:
    """Positions (from 0) of words that are not in the vocabulary."""
    at = F.transform(query_words, lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    return F.transform(F.filter(at, lambda s: ~F.array_contains(vocabulary, s["w"])), lambda s: s["i"])
