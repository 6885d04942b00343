"""MinHash near-duplicate detection by fast similarity sketching, banding and exact verification.

A document's set holds its distinct word shingles. The sketch fills `bands * rows` coordinates in rounds: while
round i < t, every shingle is hashed to one coordinate and a value; in round t + j every shingle goes to coordinate
j. A coordinate keeps its value of the earliest round that reached it, the least one of that round. So every
coordinate of a set that is not empty gets filled, and the share of equal coordinates concentrates about the
Jaccard similarity (Dahlgaard, Knudsen, Thorup 2017).

Equal sets are one class. Classes that agree on all rows of a band share a bucket. In each bucket, every class is
compared with the bucket's most central class only (a star, not all pairs); an exact check on whole shingle sets
confirms a link. A second, exact pass then covers what the stars left open: classes that share a bucket while in
different components meet again through prefix filtering (rarest shingles first), which loses no pair. So hot
groups of copies or near copies never yield all their pairs.

Defined results: null, empty or blank texts have an empty set, n_shingles 0, and stand alone. Rows with a null
doc_id are linked with nothing: component_id null, kept true. Rows that repeat a doc_id are one document, linked by
its least text; each row has its own n_shingles.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Recent, Scratch, discard, encoded, mix, partitions, small_batches, spread_join, state, written

WORDS, THRESHOLD = 5, 85  # per cent
BANDS, ROWS = 26, 5  # a pair at 0.85 misses all bands with probability (1 - 0.85 ** 5) ** 26 < 4e-7


def _word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z lower-cased, words split at \\x20 and \\x09-\\x0D."""
    tokens = encoded(text).lower().split() if text else []  # bytes: exactly these white spaces, exactly A-Z
    if not tokens:
        return np.zeros(0, np.uint64)
    cache = state().setdefault("word_hashes", Recent(_word_hash, 100_000))
    h = np.fromiter(map(cache.__getitem__, tokens), np.uint64, len(tokens))
    if len(h) < words:
        h = np.concatenate([h, np.full(words - len(h), len(h), np.uint64)])  # the length keeps padded sequences apart
    n = len(h) - words + 1
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def sketch(items: np.ndarray, t: int) -> np.ndarray:
    """The `t` coordinates of a set of uint64 hashes that is not empty. Depends on the set only."""
    out, todo, first = np.zeros(t, np.uint64), np.ones(t, bool), 0
    value = np.uint64((1 << 44) - 1)
    while todo.any():
        count = min(2 * t - first, max(1, int(1.2 * t * np.log(t) / len(items)) + 1), 512)
        rounds = np.arange(first, first + count, dtype=np.uint64)[:, None]
        h = mix(items[None, :] + mix(rounds + np.uint64(77)))
        bins = np.where(rounds < t, ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32), (rounds - np.uint64(t)) & np.uint64(0xFFFF))
        low = mix(h) & value
        key = np.sort(((bins << np.uint64(54)) | ((rounds - np.uint64(first)) << np.uint64(44)) | low).ravel())
        where = (key >> np.uint64(54)).astype(np.int64)
        lead = np.flatnonzero(np.diff(where, prepend=-1))
        new = lead[todo[where[lead]]]
        at = where[new]
        out[at] = ((key[new] >> np.uint64(44) & np.uint64(0x3FF)) + np.uint64(first) << np.uint64(44)) | (key[new] & value)
        todo[at] = False
        first += count
    return out


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, h1 and h2 (digest of the set; null for an empty one), bands (a hash of each band's rows)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = bands * rows
        numbers = np.arange(bands, dtype=np.uint64)
        for pdf in batches:
            got = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                s = shingles(text, words)
                if not len(s):
                    got.append((doc_id, 0, None, None, None))
                    continue
                digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                per, acc = sketch(s, t).reshape(bands, rows), mix(numbers + np.uint64(1))
                for k in range(rows):
                    acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + per[:, k])
                got.append((doc_id, len(s), int(digest[0]), int(digest[1]), acc.view(np.int64)))
            yield pd.DataFrame(got, columns=["doc_id", "n_shingles", "h1", "h2", "bands"]).astype({"doc_id": "Int64", "h1": "Int64", "h2": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>")


def _parts(pdf: pd.DataFrame, sizes: np.ndarray, most: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """The rows in parts of about `most` characters, one row at least: each word of them takes some fifty bytes as a row."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(pdf):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield pdf.iloc[start:end]
        start = end


def verified(pairs: DataFrame, texts: DataFrame, threshold: int = THRESHOLD, words: int = WORDS) -> DataFrame:
    """Those of the pairs (x, y) with 100 * intersection >= threshold * union on their whole sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, np.ndarray] = {}

        def of(text: str) -> np.ndarray:
            if text not in kept:
                if len(kept) >= 32:
                    kept.clear()
                kept[text] = shingles(text, words)
            return kept[text]

        for pdf in batches:
            good = []
            for a, b in zip(pdf["text_x"], pdf["text_y"]):
                p, q = of(a), of(b)
                if len(p) > len(q):
                    p, q = q, p
                if not len(p) or 100 * len(p) < threshold * len(q):
                    good.append(False)
                    continue
                at = np.searchsorted(q, p)
                same = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                good.append(100 * same >= threshold * (len(p) + len(q) - same))
            yield pdf.loc[np.array(good, bool), ["x", "y"]]

    left = texts.select(F.col("doc_id").alias("x"), F.col("text").alias("text_x"))
    right = texts.select(F.col("doc_id").alias("y"), F.col("text").alias("text_y"))
    joined = pairs.select("x", "y").join(left.hint("merge"), "x").join(right.hint("merge"), "y")
    return joined.select("x", "y", "text_x", "text_y").mapInPandas(run, "x long, y long")


def _slim(df: DataFrame) -> DataFrame:
    """A table of a few numbers a row in an eighth of the partitions that texts need: tasks of a like size, and fewer files."""
    return df.coalesce(max(1, partitions(df.sparkSession) // 8))


def components(links: DataFrame) -> DataFrame:
    """id, component (least id reachable) for every id in the links (x, y): least labels of neighbours, then jumps along labels."""
    edges = written(_slim(links.select(F.col("x").alias("u"), F.col("y").alias("v")).union(links.select("y", "x")).distinct()), "edges")
    labels = written(_slim(edges.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("u")).alias("component"))), "labels")
    while True:
        near = edges.join(labels.hint("merge").withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("component").alias("far"))
        new = written(_slim(step.join(jump.hint("merge"), "to", "left").select("id", "was", F.least("to", F.coalesce("far", "to")).alias("component"))), "labels")
        changed = new.where("was <> component").limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            discard(edges)
            return labels.select("id", "component")


def _rare_prefix_pairs(open_docs: DataFrame, scratch: Scratch, texts: DataFrame, threshold: int, words: int) -> DataFrame:
    """Pairs of different components among `open_docs` (id, component) that may reach the threshold: they share one
    of their rarest shingles, as many of them as a linked pair must share at least one of."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _parts(pdf, pdf["text"].str.len().to_numpy()):
                sets = [shingles(t, words) for t in part["text"]]
                sizes = np.array([len(s) for s in sets])
                yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), sizes), "component": np.repeat(part["component"].to_numpy(), sizes), "n": np.repeat(sizes, sizes), "shingle": np.concatenate(sets).view(np.int64)})

    # one text per id: rows that repeat a doc_id were made one before
    whole = open_docs.join(texts.withColumnRenamed("doc_id", "id").hint("merge"), "id")
    rows = scratch.written(whole.select("id", "component", "text").mapInPandas(explode, "id long, component long, n long, shingle long"), "shingles")
    # a shingle that occurs once joins nothing but takes its place in the prefix: only its count is needed
    df = scratch.written(_slim(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")), "frequencies")
    common = spread_join(rows, df, "shingle", "df")
    shared = common.groupBy("id", "component", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("by_df"))
    unique = F.col("n") - F.size("by_df")
    room = F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1 - unique
    prefix = shared.where(room > 0).select("id", "component", "n", unique.alias("unique"), F.posexplode(F.slice("by_df", F.lit(1), room.cast("int"))).alias("k", "s"))
    # behind a pair's first common shingle must lie as many as they have to share
    prefix = prefix.select("id", "component", "n", (F.col("n") - F.col("unique") - F.col("k")).alias("behind"), F.col("s.shingle").alias("shingle"))
    prefix = scratch.written(prefix, "prefixes")
    mixed = prefix.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("rows")).where("lo < hi").select("shingle", "rows")
    # each row meets the rows of its shingle; those of a hot one in as many tasks as it has hundreds of rows
    prefix = spread_join(prefix, scratch.written(_slim(mixed), "shared"), "shingle", "rows", 500)
    salts = F.ceil(F.col("rows") / 200).cast("int")
    a = prefix.select("shingle", F.pmod(F.xxhash64("id"), salts.cast("long")).cast("int").alias("salt"), F.col("id").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("behind").alias("bx"))
    b = prefix.select("shingle", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("id").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"), F.col("behind").alias("by"))
    fits = (100 + threshold) * F.least("bx", "by") >= threshold * (F.col("nx") + F.col("ny"))
    return a.join(b.hint("merge"), ["shingle", "salt"]).where((F.col("cx") < F.col("cy")) & fits).select("x", "y").distinct()


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (doc_id, text)."""
    small_batches(docs.sparkSession)
    scratch = Scratch()
    base = written(sketches(docs, bands, rows, words), "sketches")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    repeats = base.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    if repeats:  # a document of several rows is linked by its least text
        whole = whole.groupBy("doc_id").agg(F.min("text").alias("text"))
    one = written(sketches(whole, bands, rows, words), "sketches") if repeats else base
    sets = one.where("h1 is not null and doc_id is not null")
    classes = written(_slim(sets.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))), "classes")
    reps = sets.join(classes.hint("merge"), ["h1", "h2"]).where("doc_id = rep").select("rep", F.explode("bands").alias("band")).distinct()
    reps = scratch.written(reps, "bands")
    full = reps.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = scratch.written(_slim(reps.join(full.hint("merge"), "band")), "buckets")
    central = shared.groupBy("rep").agg(F.sum("size").alias("weight"))
    leaders = shared.join(central.hint("merge"), "rep").groupBy("band").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("top")).select("band", (-F.col("top.minus")).alias("leader"))
    pairs = shared.join(leaders.hint("merge"), "band").where("rep <> leader").select(F.least("rep", "leader").alias("x"), F.greatest("rep", "leader").alias("y")).distinct()
    pairs = scratch.written(_slim(pairs), "pairs")
    ids = shared.select(F.col("rep").alias("doc_id")).distinct()
    texts = scratch.written(whole.join(ids.hint("merge"), "doc_id", "left_semi").where("text is not null"), "texts")
    links = scratch.written(verified(pairs, texts, threshold, words), "links")
    labels = components(links)
    labelled = shared.select("rep", "band").join(labels.withColumnRenamed("id", "rep").hint("merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    labelled = scratch.written(_slim(labelled), "labelled")
    split = labelled.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    open_docs = labelled.join(split.hint("merge"), "band", "left_semi").select(F.col("rep").alias("id"), "component").distinct()
    more = scratch.written(verified(_rare_prefix_pairs(scratch.written(_slim(open_docs), "open"), scratch, texts, threshold, words), texts, threshold, words), "more")
    labels = components(links.union(more))
    scratch.discard()
    found = classes.join(labels.withColumnRenamed("id", "rep").hint("merge"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    if repeats:
        by_id = sets.select("doc_id", "h1", "h2").join(found.hint("merge"), ["h1", "h2"]).select("doc_id", "component")
        out = base.select("doc_id", "n_shingles").join(by_id.hint("merge"), "doc_id", "left")
    else:
        out = base.select("doc_id", "n_shingles", "h1", "h2").join(found.hint("merge"), ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same by a join of all shingles, for tables of a size that allows it.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM l), e AS (SELECT doc_id, hash(unnest(s)) AS s FROM l),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
b AS (SELECT x, y FROM k UNION ALL SELECT y, x FROM k), r AS (SELECT doc_id, doc_id AS reach FROM n UNION SELECT r.doc_id, b.y FROM r JOIN b ON b.x = r.reach),
m AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m USING (doc_id)"""
