"""SpotSigs document fingerprints and near-duplicate links.

A spot signature is a common-word anchor with the chain of the next content words after it. A document's fingerprint
is the set of its signatures, written as their sorted 32-bit hashes in hexadecimal. Texts without any anchor are
fingerprinted by their whole word sequence, texts without words by the empty set. Likeness is the Jaccard similarity
of two sets; two empty sets are alike (1.0), an empty and another one are not (0.0).

Links: sets are partitioned by length, so that only neighbouring partitions can reach the threshold; inside, an
inverted index over each set's rarest signatures proposes pairs, and the comparison stops as soon as the signatures
left can't lift it to the threshold (pruned Jaccard). compared() needs the likeness itself of two given pairs a row, with no
threshold, so it prunes nothing; links() does.

Defined results: null text is empty; null doc_ids come first in the order and are kept; rows that repeat a doc_id
follow each other by text; one row alone is its own next document; an empty table gives an empty result. Rows without a
doc_id, or of one doc_id, are one range and so one task, which streams them. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Recent, encoded, partitions, small_batches, state, written

CHAIN = 3
MOST_RANGES = 4096  # of doc_id; a range of any size is streamed, so this bounds the plan, not the rows
#: Frequent function words of English, French, German and Spanish.
ANCHORS = frozenset(
    "the of and a to in is that for it as was with be by on not are from or an this which at "
    "le la les de des du et un une en que qui dans pour est par sur au pas ce avec "
    "der die das und ein eine in den von zu mit ist nicht für auf im dem des als auch "
    "el los las y del se con para una por su lo como más al".split()
)
_WORD = re.compile(r"\w+")


def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(encoded(word), digest_size=8).digest(), "little")


def signatures(text: str, chain: int = CHAIN, anchors: frozenset[str] = ANCHORS) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the spot signatures of a whole text."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint32)
    cache = state().setdefault("spot_hashes", Recent(_word_hash, 150_000))
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    is_anchor = np.fromiter(map(anchors.__contains__, words), bool, len(words))
    content = h[~is_anchor]
    at = np.flatnonzero(is_anchor)
    behind = at - np.arange(len(at))  # content words before each anchor
    mult = np.uint64(0x9E3779B97F4A7C15)
    usable = behind + chain <= len(content)
    if usable.any():
        sig = h[at[usable]]
        for k in range(chain):
            sig = (sig ^ (sig >> np.uint64(29))) * mult + content[behind[usable] + k]
    else:
        sig = np.array([len(words)], np.uint64)
        for k in h:
            sig = (sig ^ (sig >> np.uint64(29))) * mult + k
    sig = (sig ^ (sig >> np.uint64(32))) * mult
    return np.unique((sig >> np.uint64(32)).astype(np.uint32))


def fingerprint(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, threshold: float = 0.0, block: int = 64) -> float:
    """Jaccard similarity of two sorted sets; 0.0 as soon as what has been compared shows that it stays below `threshold`: by the
    lengths alone, else behind each block of the shorter set, when all of the rest being shared would not lift it there."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    if len(a) < threshold * len(b):
        return 0.0
    same, whole = 0, len(a) + len(b)
    for start in range(0, len(a), block if threshold > 0 else len(a)):
        part = a[start : start + block] if threshold > 0 else a
        at = np.searchsorted(b, part)
        same += int((b[np.minimum(at, len(b) - 1)] == part).sum())
        most = same + max(0, len(a) - start - len(part))
        if most < threshold * (whole - most):
            return 0.0
    return same / (whole - same)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, consume, schema: str) -> DataFrame:
    """Applies `consume(iterator of (doc_id, text, next text))`, a generator of data frames, to all rows by ascending doc_id.

    Rows are dealt into ranges of doc_id; the first row of each range is sent along to the range before it (to the
    last one: the very first row), so every row meets its successor in a stream, and memory holds one batch.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    count = min(max(8, 2 * partitions(spark)), MOST_RANGES)
    lowest = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    found = rows.where("doc_id is not null").approxQuantile("doc_id", [k / count for k in range(1, count)], 0.2 / count)
    cuts = sorted({int(x) for x in found})
    lookup = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<bigint>")
    place = F.size(F.filter(lookup, lambda c: c < lowest)) if len(cuts) < 64 else None
    if place is None:
        held = spark.sparkContext.broadcast(np.array(cuts, np.int64))

        @F.pandas_udf("int")
        def place_of(ids: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(held.value, ids.to_numpy(np.int64), "left").astype("int32"))

        place = place_of(lowest)
    ranges = rows.select(place.alias("range"), lowest.alias("low")).groupBy("range").agg(F.min("low").alias("low")).collect()  # one row a range
    if not ranges:
        return rows.mapInPandas(lambda batches: consume(iter(())), schema)
    order = sorted((r["range"], r["low"]) for r in ranges)
    heads = {low: order[k - 1][0] if k else order[-1][0] for k, (_, low) in enumerate(order)}
    sent = spark.createDataFrame(list(heads.items()), "low long, to int")
    firsts = rows.select(lowest.alias("low"), "text").join(F.broadcast(sent), "low").groupBy("low", "to").agg(F.min("text").alias("text"))
    tails = firsts.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("to").alias("range"), F.lit(1).alias("tail"))
    dealt = rows.select("doc_id", "text", place.cast("int").alias("range"), F.lit(0).alias("tail")).unionByName(tails)
    dealt = dealt.repartitionByRange(len(order), "range").sortWithinPartitions("range", "tail", "doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def stream():
            held_row = None
            for pdf in batches:
                for doc_id, text, tail in zip(pdf["doc_id"], pdf["text"], pdf["tail"]):
                    if held_row is not None:
                        yield held_row[0], held_row[1], text
                    held_row = None if tail else (doc_id, text)

        yield from consume(stream())

    return dealt.mapInPandas(run, schema)


def compared(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""

    def consume(stream) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
        out, last_text, last_sig, chars = [], None, None, 0
        for doc_id, text, following in stream:
            sig = last_sig if text is last_text else signatures(text, chain)
            other = edited(text, following)
            changed, near = signatures(other, chain), signatures(following, chain)
            out.append((None if pd.isna(doc_id) else int(doc_id), len(text), hashlib.sha256(encoded(other)).hexdigest(), fingerprint(sig), fingerprint(changed), likeness(sig, changed), likeness(sig, near)))
            last_text, last_sig, chars = following, near, chars + len(text)
            if len(out) >= 2000 or chars > 8_000_000:
                yield frame(out)
                out, chars = [], 0
        yield frame(out)

    return with_next(docs, consume, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def links(docs: DataFrame, threshold: float = 0.8, chain: int = CHAIN) -> tuple[DataFrame, DataFrame]:
    """(membership: doc_id, class_id; pairs of classes: x, y, likeness) for all texts whose likeness reaches `threshold`.

    Equal fingerprints are one class, named by its least doc_id; pairs are between different fingerprints. Texts
    without words are linked with nothing but each other. Null doc_ids take no part.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "sig": [fingerprint(signatures(t or "", chain)) for t in pdf["text"]]})

    slim = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, sig string")
    slim = written(slim.withColumns({"a": F.xxhash64("sig"), "b": F.crc32("sig")}), "spots")
    classes = written(slim.groupBy("a", "b").agg(F.min("doc_id").alias("class_id")), "spot-classes")
    members = slim.select("doc_id", "a", "b").join(classes.hint("merge"), ["a", "b"]).select("doc_id", "class_id")
    reps = written(slim.join(classes.hint("merge"), ["a", "b"]).where("doc_id = class_id and sig <> ''").select("class_id", "sig").dropDuplicates(["class_id"]), "spot-reps")
    n = (F.length("sig") / 8).cast("long")
    every = reps.select("class_id", n.alias("n"), F.explode(F.expr("transform(sequence(0, cast(length(sig) / 8 as int) - 1), i -> substr(sig, i * 8 + 1, 8))")).alias("s"))
    df = every.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    by_df = every.join(df.hint("merge"), "s").groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("o"))
    room = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1 - (F.col("n") - F.size("o"))
    width = 1 / threshold
    part = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(width)) + 1e-9) if threshold < 1 else F.col("n")
    prefix = by_df.where(room > 0).select("class_id", "n", part.alias("part"), F.explode(F.slice("o", F.lit(1), room.cast("int"))["s"]).alias("s"))
    prefix = written(prefix, "spot-prefix")
    left = prefix.select("s", F.col("class_id").alias("x"), F.col("n").alias("nx"), F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = prefix.select("s", F.col("class_id").alias("y"), F.col("n").alias("ny"), "part")
    ordered = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    pairs = left.join(right, ["part", "s"]).where(ordered & (F.col("nx") >= threshold * F.col("ny") - 1e-9)).select("x", "y").distinct()
    with_sets = pairs.join(reps.select(F.col("class_id").alias("x"), F.col("sig").alias("sx")).hint("merge"), "x").join(reps.select(F.col("class_id").alias("y"), F.col("sig").alias("sy")).hint("merge"), "y")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = [likeness(np.frombuffer(bytes.fromhex(a), ">u4"), np.frombuffer(bytes.fromhex(b), ">u4"), threshold - 1e-9) for a, b in zip(pdf["sx"], pdf["sy"])]
            pdf = pdf[["x", "y"]].assign(likeness=np.array(values, float))
            yield pdf[pdf["likeness"] >= threshold - 1e-12]

    return members, with_sets.select("x", "y", "sx", "sy").mapInPandas(compare, "x long, y long, likeness double")


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark.read.parquet(f"{sf_dir}/documents.parquet"))
