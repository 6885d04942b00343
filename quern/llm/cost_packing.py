"""Cost-balanced packing of documents into token sequences of a fixed capacity.

The cost of a piece of n tokens is linear plus quadratic: n * 6h + n * n, in units of what attention costs for one pair of
tokens, for a model of hidden size h. Documents longer than the capacity are cut evenly. Piece lengths are counted in
Spark; there are at most `capacity` of them, however many documents there are, and the plan is made from those counts: as
many sequences as the tokens fill, and in descending order each piece goes to the sequence of the lowest cost that has
room for it. Sequences that hold the same are one range of numbers and move together. Pieces that fit nowhere as a whole
are cut at the end, each part going to the lowest-cost sequence with room. What remains beyond full sequences goes to sequences
whose sizes are powers of two, so nothing is padded where those need no padding.

Each piece finds its place from its rank among the pieces of its length, which Spark deals over salts: no task holds a hot
length, and no piece goes through the driver. Tokens are written once, as packed integers beside each piece; only those
of pieces that are cut are read again.

Defined results: a null text is an empty one and packs as the end token alone; rows that repeat are packed each; a null
doc_id is kept as null; an empty table gives an empty result. Other columns are ignored, whatever their names. A
text is tokenized as a whole, so memory holds the longest text and its ids. The plan has a row for each step: 20,000 for
67 million tokens, growing with the number of different lengths, not with the documents.
"""

from __future__ import annotations

import heapq
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import ranked, small_batches, state, written
from quern.llm.packing import ChunkIds, tokenizer_path

CAPACITY, END_ID, HIDDEN = 4096, 2, 2048
TOKENIZER = "word_bpe_49k.json"
#: A plain word in UTF-8 with the ASCII signs behind it, across which the tokenizer never merges; an apostrophe belongs to what follows.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
#: Added tokens, which have a case: such texts are encoded whole.
_WHOLE = re.compile(rb"<\|(?:start|end)oftext\|>")


class _WordIds(ChunkIds):
    """Ids of chunks between ASCII white space, with A-Z lower-cased, for a lower-casing tokenizer that drops white space."""

    def one(self, piece: bytes) -> bytes:
        shown = piece.decode() if piece.isascii() else piece.decode().lower().encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.model(shown)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def chunk(self, chunk: bytes) -> bytes:
        plain = _PLAIN.fullmatch(chunk)
        if not plain:
            return self.ids(chunk.decode("utf-8", "replace"))
        word, signs = plain.groups()
        return self[word] + self[signs] if signs else self.one(word)


def encode(text: bytes, path: str) -> bytes:
    """Token ids of a whole UTF-8 text as little-endian uint32: what the tokenizer gives, word by word through a cache."""
    if ("word_ids", path) not in state():
        state()["word_ids", path] = _WordIds(path)
    cache, low = state()["word_ids", path], text.lower()
    if b"oftext|>" in low and _WHOLE.search(low):
        return cache.ids(text.decode("utf-8", "replace"))
    return b"".join(map(cache.__getitem__, low.split()))


def attention_cost(n: int, hidden: int = HIDDEN) -> int:
    """Linear plus quadratic cost of n tokens that attend to each other."""
    return 6 * hidden * n + n * n


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """row, doc_id, start, length, ids_crc32, doc_tokens and ids (packed uint32) of the even pieces of every document."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for row, doc_id, text in zip(pdf["row"], pdf["doc_id"], pdf["text"]):
                ids = encode(text or b"", path) + end
                total = len(ids) // 4
                cuts = -(-total // capacity)
                at = [total * k // cuts for k in range(cuts + 1)]
                for a, b in zip(at, at[1:]):
                    own = ids[4 * a : 4 * b]
                    got.append((row, doc_id, a, b - a, zlib.crc32(own), total, own))
            yield pd.DataFrame(got, columns=["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]).astype({"doc_id": "Int64"})

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return numbered.mapInPandas(run, "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def balanced(counts: dict[int, int], capacity: int = CAPACITY, cost: Callable[[int], int] = attention_cost) -> np.ndarray:
    """The plan from how many pieces there are of each length: rows (length, rank, times, at, part, sequence, offset). Pieces of
    this length and of the `times` ranks from `rank` on put their `part` tokens from `at` into as many sequences from
    `sequence` on, at `offset`."""
    full, rest = divmod(sum(n * c for n, c in counts.items()), capacity)
    sizes = [(full, capacity)] * bool(full) + [(1, 1 << b) for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    heap, first = [], 0  # (cost, first sequence, how many, used, room), all alike in what they hold
    for times, size in sizes:
        heap.append((0, first, times, 0, size))
        first += times
    heapq.heapify(heap)
    small: dict[int, list] = {}  # by room: those that can't hold a piece of the present length
    plan, uncut = [], []

    def put(n: int, rank: int, c: int, at: int, part: int, to: tuple) -> int:
        now, start, times, used, room = to
        k = min(c, times)
        plan.append((n, rank, k, at, part, start, used))
        if room > part:
            heapq.heappush(heap, (now + cost(part), start, k, used + part, room - part))
        if k < times:
            heapq.heappush(heap, (now, start + k, times - k, used, room))
        return k

    above = capacity + 1
    for n in sorted((n for n, c in counts.items() if c > 0), reverse=True):
        for room in [r for r in small if n <= r < above]:
            for x in small.pop(room):
                heapq.heappush(heap, x)
        above, rank, c = n, 0, counts[n]
        while rank < c and heap:
            to = heapq.heappop(heap)
            if to[4] < n:
                small.setdefault(to[4], []).append(to)
            else:
                rank += put(n, rank, c - rank, 0, n, to)
        if rank < c:
            uncut.append((-n, n, rank, c - rank, 0))
    for held in small.values():
        heap += held
    heapq.heapify(heap)
    heapq.heapify(uncut)
    while uncut:
        rest, n, rank, c, at = heapq.heappop(uncut)
        to = heapq.heappop(heap)
        part = min(-rest, to[4])
        k = put(n, rank, c, at, part, to)
        if part < -rest:
            heapq.heappush(uncut, (rest + part, n, rank, k, at + part))
        if k < c:
            heapq.heappush(uncut, (rest, n, rank + k, c - k, at))
    return np.array(plan, np.int64).reshape(-1, 7)


def pack(cut: DataFrame, capacity: int = CAPACITY, cost: Callable[[int], int] = attention_cost) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of pieces as pieces() gives them, written."""
    spark = cut.sparkSession
    light = cut.drop("ids")
    counted = light.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    plan = balanced({r["length"]: r["n"] for r in counted.collect()}, capacity, cost)
    parted = plan[:, 0] != plan[:, 4]
    whole, parts = plan[~parted], plan[parted]
    whole = whole[np.lexsort((whole[:, 1], whole[:, 0]))]
    parts = parts[np.lexsort((parts[:, 1], parts[:, 0]))]
    lengths = [int(n) for n in np.unique(parts[:, 0])]
    held = spark.sparkContext.broadcast((whole, parts, whole[:, 0] * (1 << 48) + whole[:, 1]))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each part of a piece; ids_crc32 is null where a part is not all of its piece."""
        whole, parts, keys = held.value
        for pdf in batches:
            n, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            k = np.searchsorted(keys, n * (1 << 48) + rank, "right") - 1
            step = whole[np.maximum(k, 0)] if len(whole) else np.zeros((len(pdf), 7), np.int64)
            one = (step[:, 0] == n) & (rank >= step[:, 1]) & (rank < step[:, 1] + step[:, 2])
            out = pdf[one].assign(at=0, part=n[one], sequence_id=(step[:, 5] + rank - step[:, 1])[one], offset=step[one, 6])
            rest = []
            for i in np.flatnonzero(~one):
                own = parts[np.searchsorted(parts[:, 0], n[i]) : np.searchsorted(parts[:, 0], n[i], "right")]
                for _, first, _, at, part, sequence, offset in own[(own[:, 1] <= rank[i]) & (rank[i] < own[:, 1] + own[:, 2])].tolist():
                    rest.append((i, at, part, sequence + rank[i] - first, offset))
            if rest:
                more = pd.DataFrame(rest, columns=["i", "at", "part", "sequence_id", "offset"])
                rows = pdf.iloc[more.pop("i").to_numpy()].reset_index(drop=True).assign(ids_crc32=None)
                out = pd.concat([out, pd.concat([rows, more], axis=1)])
            yield out.drop(columns="rank").astype({"doc_id": "Int64", "ids_crc32": "Int64"})

    ordered = ranked(light.join(F.broadcast(counted), "length"), ["length"], ["row", "start"], "n", "rank").select(*light.columns, "rank")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in light.schema)
    placed = ordered.mapInPandas(place, f"{kinds}, at long, part long, sequence_id long, offset long")

    def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(ids_crc32=[zlib.crc32(ids[4 * a : 4 * (a + n)]) for ids, a, n in zip(pdf["ids"], pdf["at"], pdf["part"])]).drop(columns="ids").astype({"doc_id": "Int64"})

    result = [F.col("doc_id"), (F.col("start") + F.col("at")).alias("start"), F.col("part").alias("length"), F.col("ids_crc32"), F.col("doc_tokens"), F.col("sequence_id"), F.col("offset")]
    if not lengths:
        return placed.select(*result)
    placed = written(placed, "placed")
    open_parts = placed.where("ids_crc32 is null")
    tokens = cut.where(F.col("length").isin(lengths)).select("row", F.col("start").alias("start"), "ids")
    again = open_parts.join(tokens.hint("merge"), ["row", "start"]).select(*placed.columns, "ids").mapInPandas(checked, placed.schema)
    return placed.where("ids_crc32 is not null").unionByName(again).select(*result)


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all `docs` with their places; texts are tokenized once, into the shared folder."""
    small_batches(docs.sparkSession)
    return pack(written(pieces(docs, path or tokenizer_path(TOKENIZER), capacity), "tokens"), capacity)


def op13_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
