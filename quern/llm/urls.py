"""URL filter: host and path rules, else a character language-model ratio.

Two smoothed variable-order Markov models, one of accepted and one of rejected URLs, give each character's
probability from the longest contexts seen, blended with all shorter ones. A URL's score is the mean over its
characters of log p(rejected) - log p(accepted); it is blocked from a threshold on.

Hosts fall into `LOTS` lots by their hash, and a URL is always scored by models of the other lots: nothing that it or
its host has put into the counts speaks for or against it. The same scores of all URLs calibrate the threshold
(cross-fitting), so the error rates that calibration sees (`Fitted`) are those of the very models that judge.

Training URLs: those whose host has a label that names rejected content (`REJECTED`, fixed words; another set may be
given) are the rejected ones, all others accepted. Every distinct URL of every host is counted; one of a host with n of them weighs
1 / sqrt(n), so that hot hosts are damped and none is dropped. Counts are kept exactly, without
hashing: a Spark table of all distinct runs of ORDERS bytes, from which those of shorter contexts are sums. So each
run has one log ratio a lot. Up to `BROADCAST_GRAMS` runs are broadcast with them; beyond, the ratios are joins of that
table, and URLs meet them by a shuffled join that deals frequent runs over salts.

Defined results: null URLs and URLs without `://` have empty host and path, no rule, score 0 and are allowed, as
nothing speaks against them; URLs with `://` and an empty host count as one host and are judged like others; the longest
fitting rule decides before the models; repeated rows get a row each; a
table without rejected or without accepted training URLs gives score 0 and allows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Scratch, encoded, if_small, spread_join, written

#: Rules of the query: (host, path prefix, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Fixed words that name rejected content in a host's labels.
REJECTED = (
    "ads", "adult", "bet", "bets", "betting", "casino", "cheap", "escort", "gamble", "gambling", "loan", "loans",
    "lottery", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "track", "tracker", "viagra", "warez", "xxx",
)
ORDERS, STRENGTH, LOTS = 6, 2.0, 5
FALSE_BLOCKS = 0.005  # share of accepted URLs, by weight, that calibration may block
BROADCAST_GRAMS, BROADCAST_HOSTS, BLOCK = 500_000, 100_000, 1000
ONE, BIN = 1 << 16, 1e-3  # a weight of 1 (weights are whole numbers, so sums don't depend on their order); width of a score's bin


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for a null URL or one without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host + path), and its verdict; null where none does."""
    text = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def _text(url: str) -> str:
    return url.partition("://")[2]


def _lot(host: str) -> int:
    return zlib.crc32(encoded(host)) % LOTS


def labelled(pages: DataFrame, rejected: Iterable[str] = REJECTED) -> DataFrame:
    """url, host, rejected, weight of every distinct URL with ://."""
    urls = pages.select("url").where(F.col("url").contains("://")).distinct().withColumn("host", host_of(F.col("url")))
    hosts = urls.groupBy("host").agg(F.greatest(F.lit(1), F.round(ONE / F.sqrt(F.count(F.lit(1))))).cast("long").alias("weight"))
    small = if_small(hosts, BROADCAST_HOSTS)
    words = F.split("host", r"[.\-_0-9]+")
    return urls.join(hosts.hint("merge") if small is None else small, "host").select("url", "host", F.arrays_overlap(words, F.array(*map(F.lit, rejected))).alias("rejected"), "weight")


def grams(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDERS bytes up to each character, as one number with the character lowest, URL after URL; how many each URL has."""
    texts = [b"\x02" * (ORDERS - 1) + encoded(_text(u)) + b"\x03" for u in urls]
    b = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    code = np.zeros(max(0, len(b) - ORDERS + 1), np.int64)
    for k in range(ORDERS):
        code = code << 8 | b[k : len(code) + k]
    own = np.ones(len(b), bool)
    own[(np.cumsum(sizes)[:, None] - 1 - np.arange(ORDERS - 1)).ravel()] = False  # these would run into the next URL
    return code[own[: len(code)]], sizes - (ORDERS - 1)


def counts(train: DataFrame) -> DataFrame:
    """gram, n (how often in all URLs) and for each lot the weight of accepted (a0, a1, ...) and of rejected (r0, ...) URLs that
    hold it. All grams of all URLs."""
    names = [f"{kind}{lot}" for kind in "ar" for lot in range(LOTS)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), BLOCK):
                part = pdf.iloc[start : start + BLOCK]
                code, sizes = grams(list(part["url"]))
                found, at = np.unique(code, return_inverse=True)
                column = np.array([_lot(h) for h in part["host"]], np.int64) + LOTS * part["rejected"].to_numpy(np.int64)
                place = at * len(names) + np.repeat(column, sizes)
                sums = np.bincount(place, np.repeat(part["weight"].to_numpy(), sizes), len(found) * len(names)).astype(np.int64).reshape(len(found), -1)
                yield pd.DataFrame({"gram": found, "n": np.bincount(at, minlength=len(found))} | {name: sums[:, k] for k, name in enumerate(names)})

    rows = train.mapInPandas(run, "gram long, n long, " + ", ".join(f"{n} long" for n in names))
    return rows.groupBy("gram").agg(*[F.sum(n).alias(n) for n in ("n", *names)])


def log_ratios(gram: np.ndarray, accepted: np.ndarray, rejected: np.ndarray) -> np.ndarray:
    """log p(rejected) - log p(accepted) of each gram's last byte after the others; all grams of the models are given. Weights are
    rows of models by grams."""
    out = []
    keys = []
    for order in range(ORDERS):
        key = gram & ((1 << 8 * (order + 1)) - 1)
        keys.append((np.unique(key, return_inverse=True)[1], np.unique(key >> 8, return_inverse=True)[1]))
    for weights in zip(accepted, rejected):
        p = [np.full(len(gram), 1 / 256), np.full(len(gram), 1 / 256)]
        for seen, context in keys:  # the longer the context, the later it has its say
            for k, n in enumerate(weights):
                p[k] = (np.bincount(seen, n)[seen] / ONE + STRENGTH * p[k]) / (np.bincount(context, n)[context] / ONE + STRENGTH)
        out.append(np.log(p[1]) - np.log(p[0]))
    return np.array(out)


def _joined_ratios(counted: DataFrame) -> DataFrame:
    """gram, n, ratio (array, one of each lot): the same in Spark, for tables of any size."""
    names = [f"{kind}{lot}" for kind in "ar" for lot in range(LOTS)]
    others = lambda kind, lot: sum((F.col(f"{kind}{k}") for k in range(LOTS) if k != lot), F.lit(0))
    models = counted.select("gram", "n", *[others(kind, lot).alias(f"{kind}{lot}") for kind in "ar" for lot in range(LOTS)])
    rows = models.select("gram", *[F.lit(1 / 256).alias(n) for n in names])
    for order in range(ORDERS):
        key = F.col("gram").bitwiseAND((1 << 8 * (order + 1)) - 1)
        how = "broadcast" if order < 2 else "merge"  # 65,536 rows at most
        seen = models.groupBy(key.alias("key")).agg(*[F.sum(n).alias(f"seen_{n}") for n in names])
        context = models.groupBy(F.shiftright(key, 8).alias("before")).agg(*[F.sum(n).alias(f"context_{n}") for n in names])
        rows = rows.withColumn("key", key).join(seen.hint(how), "key").withColumn("before", F.shiftright("key", 8)).join(context.hint(how), "before")
        rows = rows.select("gram", *[((F.col(f"seen_{n}") / ONE + STRENGTH * F.col(n)) / (F.col(f"context_{n}") / ONE + STRENGTH)).alias(n) for n in names])
    ratio = F.array(*[F.log(f"r{lot}") - F.log(f"a{lot}") for lot in range(LOTS)])
    return rows.select("gram", ratio.alias("ratio")).join(counted.select("gram", "n").hint("merge"), "gram").select("gram", "n", "ratio")


class Ratios:
    """The log ratios of all grams for each lot, broadcast if they are few."""

    def __init__(self, counted: DataFrame, most: int):
        self.held = self.table = None
        if counted.limit(most + 1).count() <= most:
            got = counted.orderBy("gram").toArrow()
            column = {n: got[n].to_numpy() for n in got.column_names}
            models = [np.array([sum(column[f"{kind}{k}"] for k in range(LOTS) if k != lot) for lot in range(LOTS)]) for kind in "ar"]
            self.held = counted.sparkSession.sparkContext.broadcast((column["gram"], log_ratios(column["gram"], *models)))
        else:
            self.table = written(_joined_ratios(counted), "ratios")

    def scored(self, rows: DataFrame) -> DataFrame:
        """`rows` (url, ...) with `score`: the mean ratio over the characters; 0 without ://."""
        lot = F.pmod(F.crc32(host_of(F.col("url"))), F.lit(LOTS)).cast("int")
        if self.held:
            held = self.held

            @F.pandas_udf("double")
            def score(urls: pd.Series, lots: pd.Series) -> pd.Series:
                out, (known, ratio) = np.zeros(len(urls)), held.value
                at = np.array([k for k, u in enumerate(urls) if u and "://" in u], np.int64)
                lots = lots.to_numpy()
                for start in range(0, len(at), BLOCK):
                    part = at[start : start + BLOCK]
                    code, sizes = grams(list(urls.iloc[part]))
                    values = ratio[np.repeat(lots[part], sizes), np.searchsorted(known, code)]
                    out[part] = np.add.reduceat(values, np.cumsum(sizes) - sizes) / sizes
                return pd.Series(out)

            return rows.withColumn("score", score("url", lot))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for start in range(0, len(pdf), BLOCK):
                    part = pdf.iloc[start : start + BLOCK]
                    code, sizes = grams(list(part["url"]))
                    yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), sizes), "lot": np.repeat(part["lot"].to_numpy(), sizes), "gram": code})

        each = rows.select("url").where(F.col("url").contains("://")).distinct().select("url", F.md5("url").alias("id"), lot.alias("lot")).mapInPandas(run, "id string, lot int, gram long")
        met = spread_join(each, self.table, "gram", "n", 100_000)
        scores = met.groupBy("id").agg(F.avg(F.element_at("ratio", F.col("lot") + 1)).alias("score"))
        return rows.withColumn("id", F.md5("url")).join(scores.hint("merge"), "id", "left").drop("id").withColumn("score", F.coalesce("score", F.lit(0.0)))


@dataclass
class Fitted:
    """The models; the threshold; the shares, by weight, of accepted URLs that it blocks and of rejected ones that it blocks, by
    models that haven't seen their hosts."""

    ratios: Ratios
    threshold: float
    false_blocks: float
    caught: float


def fit(pages: DataFrame, most: int = BROADCAST_GRAMS, rejected: Iterable[str] = REJECTED) -> Fitted | None:
    """None if a kind of URLs is missing. The threshold is the least, in steps of BIN, that blocks at most FALSE_BLOCKS of the
    weight of the accepted URLs, and no less than the middle between the means of the two kinds. Where that would lie above the mean
    of the rejected URLs, the kinds overlap and the middle is taken instead; `false_blocks` then tells what it costs."""
    scratch = Scratch()
    train = scratch.written(labelled(pages, rejected), "urls")
    if train.select("rejected").distinct().count() < 2:
        scratch.discard()
        return None
    ratios = Ratios(scratch.written(counts(train), "grams"), most)
    bins = ratios.scored(train).groupBy("rejected", F.floor(F.col("score") / BIN).alias("bin"))
    got = bins.agg(F.sum("weight").alias("weight"), F.sum(F.col("score") * F.col("weight")).alias("sum")).collect()  # as many as scores have bins
    scratch.discard()
    weight = {kind: sum(r["weight"] for r in got if r["rejected"] == kind) for kind in (False, True)}
    mean = {kind: sum(sorted(r["sum"] for r in got if r["rejected"] == kind)) / w for kind, w in weight.items()}
    middle = threshold = (mean[False] + mean[True]) / 2
    above = 0
    for r in sorted((r for r in got if not r["rejected"]), key=lambda r: -r["bin"]):
        above += r["weight"]
        if above > FALSE_BLOCKS * weight[False]:
            threshold = max(middle, (r["bin"] + 1) * BIN)
            break
    if threshold > mean[True]:
        threshold = middle
    share = lambda kind: sum(r["weight"] for r in got if r["rejected"] == kind and (r["bin"] + 0.5) * BIN >= threshold) / weight[kind]
    return Fitted(ratios, float(threshold), share(False), share(True))


def judged(pages: DataFrame, rules=RULES, most: int = BROADCAST_GRAMS, rejected: Iterable[str] = REJECTED) -> DataFrame:
    """page_id, host, path, rule, verdict, score, threshold for every row of `pages` (page_id, url)."""
    fitted = fit(pages, most, rejected)
    threshold = fitted.threshold if fitted else 0.0
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    text, verdict = rule_of(host, path, rules)
    rows = pages.select("page_id", "url")
    rows = fitted.ratios.scored(rows) if fitted else rows.withColumn("score", F.lit(0.0))
    blocked = F.col("url").contains("://") & (F.col("score") >= threshold) if fitted else F.lit(False)
    own = F.coalesce(verdict, F.when(blocked, "block").otherwise("allow"))
    return rows.select("page_id", host.alias("host"), path.alias("path"), text.alias("rule"), own.alias("verdict"), "score", F.lit(threshold).alias("threshold"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
