"""Ranked lexical search through a tiered index: high-impact postings first, lower tiers only for items that need them.

The index holds a posting for each asked term and document with its impact, which depends on nothing but the document.
Impacts are counted by term and level; from the counts each term gets the levels at which its tiers end and a residual bound
for each tier: the highest impact below it. The first tier holds a term's best 1/64, 512 postings at least, the second its best
1/8, 4,096 at least, the third the rest.

An item is scored on the first tier alone. Its k-th best partial score is a floor under the k-th best score. Terms, by the
least of their weighed residual bounds first, stay out of question as long as the sum of those bounds is below
the floor: a document that holds only such postings can't reach it. If that covers all of an item's terms, all its winners have
been seen, and that is the proof. Items without it fall through: their other terms are read one tier deeper, and in a third
step to the end, after which the proof always holds. Of the seen documents whose partial score and missing bounds reach the
floor, the k with the best partial scores are scored in full first; the least of those k is a higher floor, and only what still
reaches it is scored in full, through its postings in all tiers. So the result is exact, ties included.

Defined results: null texts, and texts without a term, are no documents and match nothing; an item without a known term
gives no row; rows that repeat a doc_id are each a document; a null doc_id comes last among ties; rows that repeat an item_id
ask for the terms of all of them, a null item_id asks nothing; empty tables give an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.llm.common import Scratch, if_small, small_batches, written

K, LENGTH_SHARE = 50, 50
#: Levels of impact; a first and a second tier's share of a term's postings and least number of them.
LEVELS, TIERS = 256, ((64, 512), (8, 4096))
#: So many distinct asked terms go to the tasks as a dictionary (some 100 MB); beyond that postings of all terms are made and joined.
ASKED_TERMS = 1_000_000
#: Rows of (item, term) or (item, document) that are broadcast, some 50 MB; beyond that they are joined by a shuffle.
BROADCAST = 500_000
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, A-Z lower-cased, with repeats."""
    return _TERM.findall(text.lower()) if text else []


def asked_terms(items: DataFrame) -> DataFrame:
    """item_id, term: once each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, t) for i, text in zip(pdf["item_id"], pdf["text"]) for t in {*terms_of(text)}]
            yield pd.DataFrame(rows, columns=["item_id", "term"])

    known = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return known.mapInPandas(run, "item_id long, term binary").distinct()


def postings(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """term, row, doc_id, tf, n (terms of the document, with repeats) of the asked terms (term) in all `docs`. Rows of a null term
    sum up a batch of documents: tf is how many have a term, n how many terms they have. Texts are read once."""
    spark = docs.sparkSession
    few = asked.limit(ASKED_TERMS + 1).count() <= ASKED_TERMS
    held = spark.sparkContext.broadcast({bytes(r["term"]) for r in asked.collect()} if few else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = held.value
        for pdf in batches:
            got, some, size = [], 0, 0
            for row, doc_id, text in zip(pdf["row"], pdf["doc_id"], pdf["text"]):
                terms = terms_of(text)
                if terms:
                    some, size = some + 1, size + len(terms)
                    counts = Counter(terms if wanted is None else filter(wanted.__contains__, terms))
                    got += [(t, row, doc_id, tf, len(terms)) for t, tf in counts.items()]
            got.append((None, None, None, some, size))
            yield pd.DataFrame(got, columns=["term", "row", "doc_id", "tf", "n"]).astype({"row": "Int64", "doc_id": "Int64"})

    small_batches(spark)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    out = numbered.mapInPandas(run, "term binary, row long, doc_id long, tf long, n long")
    return out if few else out.where("term is null").unionByName(out.join(asked, "term", "left_semi"))


def build(docs: DataFrame, asked: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The index (term, row, doc_id, impact, tier), written by tier, and its terms (term, w, r1, r2: weight and residual bounds)."""
    raw = scratch.written(postings(docs, asked), "postings")
    whole = raw.where("term is null").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n, size = whole["docs"], max(whole["terms"], 1)
    m = f"({100 - LENGTH_SHARE} + (({LENGTH_SHARE} * n * {n}L) div {size}L))"
    known = raw.where("term is not null").select("term", "row", "doc_id", F.expr(f"(1000000000 * tf) div (1000 * tf + 20 * {m})").alias("impact"))
    level = F.least(F.lit(LEVELS - 1), F.expr(f"impact * {LEVELS} div 1000000")).cast("int")
    counted = known.groupBy("term", level.alias("level")).agg(F.count(F.lit(1)).alias("c"), F.max("impact").alias("top"))
    by = W.partitionBy("term")  # at most LEVELS rows each
    above = F.sum("c").over(by.orderBy(F.col("level").desc())) - F.col("c")
    counted = counted.withColumns({"df": F.sum("c").over(by), "above": above})
    within = lambda share, least: F.col("above") < F.greatest(F.lit(least), F.floor(F.col("df") / share))
    tier = F.when(within(*TIERS[0]), 1).when(within(*TIERS[1]), 2).otherwise(3)
    below = lambda t: F.coalesce(F.max(F.when(F.col("tier") > t, F.col("top"))), F.lit(0))
    ends = lambda t: F.min(F.when(F.col("tier") <= t, F.col("level")))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1).cast("double")))
    terms = counted.withColumn("tier", tier).groupBy("term", "df").agg(below(1).alias("r1"), below(2).alias("r2"), ends(1).alias("e1"), ends(2).alias("e2"))
    terms = scratch.written(terms.withColumn("w", weight), "terms")
    found = known.withColumn("level", level).join(if_small(terms.select("term", "e1", "e2"), BROADCAST) or terms.select("term", "e1", "e2"), "term")
    tiered = found.select("term", "row", "doc_id", "impact", F.when(F.col("level") >= F.col("e1"), 1).when(F.col("level") >= F.col("e2"), 2).otherwise(3).alias("tier"))
    return scratch.written(tiered, "index", by=["tier"]), terms.select("term", "w", "r1", "r2")


def _bound() -> Column:
    """What a posting that an item hasn't read can add at most."""
    return F.col("w") * F.when(F.col("depth") == 1, F.col("r1")).when(F.col("depth") == 2, F.col("r2")).otherwise(0)


def _partial(index: DataFrame, need: DataFrame, step: int) -> DataFrame:
    """item_id, row, doc_id, partial, covered: what the tiers read so far give a document, and the bounds of its terms found there."""
    read = index.where(F.col("tier") <= step).join(if_small(need, BROADCAST) or need, "term").where(F.col("tier") <= F.col("depth"))
    return read.groupBy("item_id", "row").agg(F.min("doc_id").alias("doc_id"), F.sum(F.col("w") * F.col("impact")).alias("partial"), F.sum(_bound()).alias("covered"))


def _best(scores: DataFrame, score: str, k: int) -> DataFrame:
    order = W.partitionBy("item_id").orderBy(F.col(score).desc(), F.col("doc_id").asc_nulls_last(), "row")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _numbered(every: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(term, w, t; item_id, i; i, t): the pairs of `every` (item_id, term, w), of which there are few, by numbers. Two ints are
    looked up as one long, which the many pairs of postings and documents need."""
    number = lambda df, n: scratch.written(df.distinct().coalesce(1).withColumn(n, F.monotonically_increasing_id().cast("int")), n)
    terms, items = number(every.select("term", "w"), "t"), number(every.select("item_id"), "i")
    pairs = scratch.written(every.join(F.broadcast(terms.select("term", "t")), "term").join(F.broadcast(items), "item_id").select("i", "t"), "pairs")
    return F.broadcast(terms), F.broadcast(items), F.broadcast(pairs)


def _scored(index: DataFrame, every: DataFrame, seen: DataFrame, numbers: tuple[DataFrame, DataFrame, DataFrame] | None) -> DataFrame:
    """item_id, row, doc_id, score: the documents of `seen` (item_id, row) in full, without those of score 0. numbers: of _numbered()."""
    met = lambda left, right: left.join(right.hint("merge") if (small := if_small(right, BROADCAST)) is None else small, "row")
    score = [F.min("doc_id").alias("doc_id"), F.sum("value").alias("score")]
    if numbers:
        terms, items, pairs = numbers
        values = index.join(terms, "term").select("row", "doc_id", "t", (F.col("w") * F.col("impact")).alias("value"))
        rows = met(values, seen.join(items, "item_id").select("row", "i")).join(pairs, ["i", "t"])
        scores = rows.groupBy("i", "row").agg(*score).where("score > 0").join(items, "i")
    else:
        rows = met(index, seen).join(if_small(every, BROADCAST) or every, ["item_id", "term"]).withColumn("value", F.col("w") * F.col("impact"))
        scores = rows.groupBy("item_id", "row").agg(*score).where("score > 0")
    return scores.select("item_id", "row", "doc_id", "score")


def search(index: DataFrame, terms: DataFrame, asked: DataFrame, scratch: Scratch, k: int = K) -> tuple[DataFrame, list[int]]:
    """(item_id, rank, doc_id, score of the k best documents of each item; how many items went on at each step)."""
    need = scratch.written(asked.join(terms, "term").withColumn("depth", F.lit(1)), "need")
    every, seen, went_on = need, None, []
    for step in (1, 2, 3):
        part = scratch.written(_partial(index, need, step), "partial")
        # fewer than k seen: whatever scores above 0 may win
        floor = _best(part, "partial", k).groupBy("item_id").agg(F.when(F.count(F.lit(1)) == k, F.greatest(F.min("partial"), F.lit(1))).otherwise(1).alias("floor"))
        rest = need.withColumn("bound", _bound()).join(floor, "item_id", "left").withColumn("floor", F.coalesce("floor", F.lit(1)))
        up_to = W.partitionBy("item_id").orderBy("bound", "term")
        rest = rest.withColumns({"open": F.sum("bound").over(up_to) >= F.col("floor"), "all": F.sum("bound").over(W.partitionBy("item_id"))})
        judged = scratch.written(rest, "judged")
        open_items = judged.where("open").select("item_id").distinct()
        items = judged.groupBy("item_id").agg(F.max("floor").alias("floor"), F.max("all").alias("all"), F.max("open").alias("open")).where("not open")
        near = part.join(if_small(items, BROADCAST) or items, "item_id").withColumn("most", F.col("partial") + F.col("all") - F.col("covered"))
        near = near.where(F.col("most") >= F.col("floor")).select("item_id", "row", "doc_id", "partial", "most")
        seen = near if seen is None else seen.unionByName(near)
        went_on.append(open_items.count())
        if not went_on[-1]:
            break
        deeper = F.when(F.col("open"), F.lit(step + 1)).otherwise(F.col("depth")).alias("depth")
        need = scratch.written(judged.join(open_items, "item_id", "left_semi").select("item_id", "term", "w", "r1", "r2", deeper), "need")
    seen = scratch.written(seen, "seen")
    every = every.select("item_id", "term", "w")
    leaders = scratch.written(_best(seen, "partial", k).select("item_id", "row"), "leaders")
    numbers = _numbered(every, scratch) if if_small(every, BROADCAST) else None
    floor = _scored(index, every, leaders, numbers).groupBy("item_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(1).alias("floor"))
    floor = scratch.written(floor, "floor")
    left = seen.join(if_small(floor, BROADCAST) or floor, "item_id").where(F.col("most") >= F.col("floor")).select("item_id", "row")
    return _best(_scored(index, every, scratch.written(left, "left"), numbers), "score", k).select("item_id", "rank", "doc_id", "score"), went_on


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of all `docs` (doc_id, text) for each of the items (item_id, text)."""
    scratch = Scratch()
    asked = scratch.written(asked_terms(items), "asked")
    index, terms = build(docs, asked.select("term").distinct(), scratch)
    found = written(search(index, terms, asked, scratch, k)[0], "ranked")
    scratch.discard()
    return found


def op12_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
l AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, n, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, count(*) AS tf FROM l GROUP BY 1, 2, 3),
c AS (SELECT count(*) AS nn, sum(len(w)) AS ll FROM d WHERE len(w) > 0),
f AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, c GROUP BY t, nn),
q AS (SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score FROM q JOIN p USING (t) JOIN f USING (t), c GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50"""
