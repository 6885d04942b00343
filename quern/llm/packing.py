"""Best-two-fit packing of token pieces into sequences of a fixed capacity.

Documents become pieces: only those longer than the capacity are cut, into full pieces after a shorter first one.
Piece lengths are counted in Spark; the counts (at most `capacity` of them, however many documents there are) are
packed on the driver by best-two-fit: a bin is filled greedily, each time with the longest piece that fits, then its
smallest piece is replaced by two unpacked pieces that fit the gap so widened more tightly. Pieces shorter than
capacity / SMALL_SHARE stay out of this, as replacing would use up what fits anywhere: they come last, the longest
first, each into the tightest gap that holds it. As pieces of one length are alike, a
bin's pattern repeats for as long as its lengths last, so there are few patterns. Each piece finds its place from its
rank among the pieces of its length, which Spark deals over salts, so no task holds a hot length.

Defined results: a null text is an empty one and packs as the end token alone; rows that repeat are packed each;
a null doc_id is kept as null; an empty table gives an empty result. Other columns are ignored. A text is tokenized
as a whole, so memory holds the longest text and its ids.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Recent, ranked, small_batches, state, written

CAPACITY, END_ID, SMALL_SHARE = 1024, 2, 6
TOKENIZER = "byte_bpe_50k.json"
#: Pieces that byte-level BPE can't merge across: a plain word before white space or a sign; a run of signs before white
#: space; else all up to the next white space; and white space itself.
_CHUNK = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\s!-/:-@\[-`{-~]|\Z)| ?[!-/:-@\[-`{-~]+(?=\s|\Z)| ?\S+|\s+(?!\S)|\s+")
#: A piece that the tokenizer's pattern leaves whole.
_PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[!-/:-@\[-`{-~]+")
#: Characters on whose class the tokenizer and `re` may differ, and added tokens: such texts are encoded whole.
_WHOLE = re.compile(r"[\x1c-\x1f]|<\|endoftext\|>")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class ChunkIds(Recent):
    """Ids of chunks as bytes. New plain words go straight to the tokenizer's model, byte by byte in its alphabet; others through all of it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__(self.chunk, 300_000)
        self.tokenizer = Tokenizer.from_file(path)
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        shown = {c.encode("utf-8"): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0x800))}
        self.letters = {b: s for text, out in shown.items() for b, s in zip(text, out)}
        self.blank = self.letters[ord(" ")]
        self.model = self.tokenizer.model.tokenize

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def one(self, piece: str) -> bytes:
        # in the model's alphabet, ASCII signs and letters stand for themselves
        shown = piece.replace(" ", self.blank) if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        tokens = self.model(shown)
        ids = array("I", [t.id for t in tokens])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def chunk(self, chunk: str) -> bytes:
        return self.one(chunk) if _PLAIN.fullmatch(chunk) else self.ids(chunk)


def encode(text: str, path: str) -> bytes:
    """Token ids of a whole text as little-endian uint32: what the tokenizer gives, word by word through a cache."""
    if ("chunk_ids", path) not in state():
        state()["chunk_ids", path] = ChunkIds(path)
    cache = state()["chunk_ids", path]
    if _WHOLE.search(text):
        return cache.ids(text)
    return b"".join(map(cache.__getitem__, _CHUNK.findall(text)))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary) of every piece of every document (doc_id, text)."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = encode(text or "", path) + end
                total, at, k = len(ids) // 4, 0, 0
                length = (total - 1) % capacity + 1
                while at < total:
                    own = ids[4 * at : 4 * (at + length)]
                    got.append((doc_id, k, at, length, zlib.crc32(own), *([own] if with_ids else [])))
                    at, k, length = at + length, k + 1, capacity
            yield pd.DataFrame(got, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def patterns(counts: dict[int, int], capacity: int = CAPACITY, swap: bool = True, small_share: int = SMALL_SHARE) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (piece lengths, how many such bins), from how many pieces there are of each length. `swap`: replace by two; else
    plain greedy filling."""
    left = {n: c for n, c in counts.items() if c > 0}
    least = -(-capacity // small_share)
    bins = _filled(left, sorted(n for n in left if n >= least), capacity, swap)
    bins = _topped_up(left, sorted((n for n in left if n < least), reverse=True), bins, capacity)
    bins += _filled(left, sorted(n for n in left if left[n]), capacity, swap)
    return [(tuple(n for n in sorted(own, reverse=True) for _ in range(own[n])), times) for own, times in bins]


def _room(own: dict[int, int], capacity: int) -> int:
    return capacity - sum(n * k for n, k in own.items())


def _filled(left: dict[int, int], lengths: list[int], capacity: int, swap: bool) -> list[tuple[dict[int, int], int]]:
    """Bins of pieces of these lengths, each filled greedily and then improved by one replacement; takes them out of `left`."""
    out = []
    while lengths:
        own: dict[int, int] = {}
        gap, at = capacity, len(lengths)
        while at and gap >= lengths[0]:
            at = bisect_right(lengths, gap, 0, at)
            if not at:
                break
            n = lengths[at - 1]
            k = min(gap // n, left[n] - own.get(n, 0))
            if k:
                own[n] = own.get(n, 0) + k
                gap -= k * n
            at -= 1
        if swap and gap and sum(own.values()) > 1:
            _replace(own, left, lengths, gap)
        times = min(left[n] // k for n, k in own.items())
        out.append((own, times))
        for n, k in own.items():
            left[n] -= k * times
        lengths = [n for n in lengths if left[n]]
    return out


def _replace(own: dict[int, int], left: dict[int, int], lengths: list[int], gap: int) -> None:
    """Replaces the smallest piece of a bin by the two unpacked ones that fill its room and the gap best, if any fill more."""
    free = lambda n: left[n] - own.get(n, 0)
    small = min(own)
    room, best = gap + small, (small, 0, 0)
    lo, hi = 0, bisect_right(lengths, room) - 1
    while lo <= hi:  # sums of a short and a long one, coming nearer to the room from both sides
        a, b = lengths[lo], lengths[hi]
        if free(a) < 1:
            lo += 1
        elif free(b) < 1 or a + b > room or (lo == hi and free(a) < 2):
            hi -= 1
        else:
            if a + b > best[0]:
                best = (a + b, a, b)
            if a + b == room:
                break
            lo += 1
    if best[1]:
        own[small] -= 1
        if not own[small]:
            del own[small]
        for n in best[1:]:
            own[n] = own.get(n, 0) + 1


def _topped_up(left: dict[int, int], lengths: list[int], bins: list[tuple[dict[int, int], int]], capacity: int) -> list[tuple[dict[int, int], int]]:
    """The bins with the short pieces, longest first, each length into the tightest gaps that hold it, as many as a gap holds."""
    by_gap: dict[int, list[tuple[dict[int, int], int]]] = {}
    for own, times in bins:
        by_gap.setdefault(_room(own, capacity), []).append((own, times))
    gaps = sorted(by_gap)

    def put(gap: int, own: dict[int, int], times: int) -> None:
        if gap not in by_gap:
            insort(gaps, gap)
        by_gap.setdefault(gap, []).append((own, times))

    for n in lengths:
        while left[n] and (at := bisect_left(gaps, n)) < len(gaps):
            gap = gaps[at]
            own, times = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap], gaps[at]
            k = min(gap // n, left[n])
            used = min(times, left[n] // k)
            if used < times:
                put(gap, own, times - used)
            put(gap - k * n, own | {n: k}, used)
            left[n] -= k * used
    return [x for held in by_gap.values() for x in held]


def places(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: from which rank on a pattern takes its pieces, how many a bin, its first sequence, offset of its first."""
    got: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for lengths, times in bins:
        offset = 0
        for n in dict.fromkeys(lengths):
            k = lengths.count(n)
            got.setdefault(n, []).append((taken.get(n, 0), k, sequence, offset))
            taken[n] = taken.get(n, 0) + k * times
            offset += k * n
        sequence += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*rows)) for n, rows in got.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    spark = cut.sparkSession
    counted = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    held = spark.sparkContext.broadcast(places(patterns({r["length"]: r["n"] for r in counted.collect()}, capacity)))
    names = [*cut.columns, "sequence_id", "offset"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for n, at in pdf.groupby("length").indices.items():
                starts, per, first, begin = held.value[n]
                rank = pdf["rank"].to_numpy()[at]
                k = np.searchsorted(starts, rank, "right") - 1
                rest = rank - starts[k]
                sequence[at], offset[at] = first[k] + rest // per[k], begin[k] + rest % per[k] * n
            yield pdf.assign(sequence_id=sequence, offset=offset)[names]

    ordered = ranked(cut.join(F.broadcast(counted), "length"), ["length"], ["doc_id", "piece", "start", "ids_crc32"], "n", "rank")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ordered.select(*cut.columns, "rank").mapInPandas(run, f"{kinds}, sequence_id long, offset long")


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all `docs` with their places; pieces are tokenized once, into the shared folder."""
    small_batches(docs.sparkSession)
    return pack(written(pieces(docs, path or tokenizer_path(), capacity), "pieces"), capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
