"""Language identification by hierarchical discrimination.

Features are hashed counts of byte 1-, 2- and 3-grams of the lower-cased whole text, square-rooted and of unit
length. One-versus-rest linear support vector machines choose the language family; inside it, one-versus-one
machines vote on the language. The machines are fitted on the driver, on a sample of at most `SAMPLE` rows
(`PER_LANGUAGE` of each language at most, one of each at least), those with the least hash of doc_id and text. Every
language that occurs in them is learned, however rare it is; the driver holds a row or more of each.

Defined results: null texts and texts without a letter (Unicode category L) are `und`, score 0; an empty text as well; a
null doc_id is in neither fold (held_out false) and teaches nothing; rows that repeat teach as often as they are drawn;
without any usable training row all are `und`. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.llm.common import encoded, fold, gram_counts, small_batches
from quern.llm.svm import train

COLUMNS, SAMPLE, PER_LANGUAGE = 2048, 4000, 800
#: Families of ISO 639-1 codes. A language that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk tt".split(),
    "indic": "hi bn ur mr gu pa ta te".split(),
    "semitic": "ar he am mt".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
_LETTER = regex.compile(r"\p{L}")
_BLANK = bytes(32 if c < 65 or 90 < c < 97 or 122 < c < 128 else c for c in range(256))


def features(texts: list[str]) -> np.ndarray:
    x = np.sqrt(gram_counts([b" " + encoded(t.lower()).translate(_BLANK) + b" " for t in texts], COLUMNS))
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


@dataclass
class Model:
    """Families (names, weights a column each); for each family its languages and the weights of each pair of them."""

    families: list[str]
    top: np.ndarray
    languages: dict[str, list[str]]
    pairs: dict[str, np.ndarray]

    def predict(self, texts: list[str], sharp: float = 4.0) -> tuple[list[str], np.ndarray]:
        x = features(texts)
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        margin = x @ self.top
        p = np.exp(sharp * (margin - margin.max(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        out, score = np.empty(len(x), object), p[np.arange(len(x)), best].astype(np.float64)
        for f, family in enumerate(self.families):
            at = np.flatnonzero(best == f)
            names = self.languages[family]
            if not len(at) or len(names) == 1:
                out[at] = names[0]
                continue
            m = x[at] @ self.pairs[family]
            votes, sums, win = np.zeros((len(at), len(names))), np.zeros((len(at), len(names))), np.zeros((len(at), len(names)))
            for k, (i, j) in enumerate(combinations(range(len(names)), 2)):
                votes[:, i] += m[:, k] >= 0
                votes[:, j] += m[:, k] < 0
                own = 1 / (1 + np.exp(-sharp * np.clip(m[:, k], -20, 20)))
                sums[:, i] += m[:, k]
                sums[:, j] -= m[:, k]
                win[:, i] += own
                win[:, j] += 1 - own
            chosen = (votes + 1e-3 * np.tanh(sums)).argmax(1)
            out[at] = np.array(names, object)[chosen]
            score[at] *= win[np.arange(len(at)), chosen] / (len(names) - 1)
        return list(out), np.clip(score, 0.0, 1.0)


def fit(docs: DataFrame, sample: int = SAMPLE, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fits on rows of fold 0, 1 and 3 with a non-null lang; None if there are none."""
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where((fold(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    lot = F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    often = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(lot).alias("different"))
    counts = {r["lang"]: r["different"] for r in often.collect()}
    if not counts:
        return None
    per = max(1, min(per_language, sample // len(counts)))
    # what comes near the least hashes, more than needed by some standard deviations of counts and estimates; of it, the least ones
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, (1.3 * per + 10 * per**0.5 + 10) / n)])[F.col("lang")]
    nth = F.row_number().over(W.partitionBy("lang").orderBy("lot", "doc_id", "text"))
    drawn = usable.withColumn("lot", lot).where(F.col("lot") < share).withColumn("nth", nth).where(F.col("nth") <= per)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "x": [r.astype(np.float16).tobytes() for r in features(list(pdf["text"]))]})

    rows = sorted(drawn.select("doc_id", "text", "lang").mapInPandas(run, "doc_id long, lang string, x binary").collect(), key=lambda r: (r["lang"], r["doc_id"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows])  # train() makes doubles of what it takes
    lang = np.array([r["lang"] for r in rows])
    family = np.array([FAMILY_OF.get(v, v) for v in lang])
    families = sorted(set(family))
    top = np.stack([train(x, np.where(family == f, 1, -1)) for f in families], 1) if len(families) > 1 else np.zeros((x.shape[1] + 1, 1))
    languages = {f: sorted(set(lang[family == f])) for f in families}
    pairs = {}
    for f, names in languages.items():
        if len(names) > 1:
            pairs[f] = np.stack([train(x[(lang == a) | (lang == b)], np.where(lang[(lang == a) | (lang == b)] == a, 1, -1)) for a, b in combinations(names, 2)], 1).astype(np.float32)
    return Model(families, top.astype(np.float32), languages, pairs)


def judge(spark: SparkSession, model: Model | None) -> Callable[[Column], Column]:
    """A column function: text -> struct<lang_pred, score>."""
    small_batches(spark)
    held = spark.sparkContext.broadcast(model and vars(model))  # arrays and names: a class is only known to the driver

    @F.pandas_udf("lang_pred string, score double")
    def run(column: pd.Series) -> pd.DataFrame:
        texts = [t if t and _LETTER.search(t) else "" for t in column]
        lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        at = [k for k, t in enumerate(texts) if t]
        for start in range(0, len(at), 256) if held.value else ():
            part = at[start : start + 256]
            lang[part], score[part] = Model(**held.value).predict([texts[k] for k in part])
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return run


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` (doc_id, text) -> doc_id, held_out, lang_pred, score, one row each."""
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), judge(docs.sparkSession, model)(F.col("text")).alias("p"))
    return rows.select("doc_id", F.coalesce(fold(doc_id) == 2, F.lit(False)).alias("held_out"), "p.lang_pred", "p.score")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predicted(docs, fit(docs))
