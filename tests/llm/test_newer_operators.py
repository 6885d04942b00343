"""Resampling, tiered search and cost-balanced packing against brute force; their edge cases; the pipeline's stages by themselves."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import cost_packing, language, mixing, packing, quality, queries, sort_count, tiered
from quern.llm.common import Scratch
from tests.llm.test_operators import documents, folder

EXTRA = "doc_id long, text string, lang string, score double, rank int, row long, term string, tier int, ids binary, place int, _part int, _start long, w long"


def extras(rows):
    return [(r[0], r[1], r[2], 0.5, 1, 2, "t", 3, b"x", 4, 5, 6, 7) for r in rows]


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    bench = [(k, (documents()[k * 3][1] or "")[:200]) for k in range(20)] + [(50, None), (51, ""), (52, "zzzz unknown"), (53, "ONE"), (53, "two"), (None, "the")]
    return folder(spark, tmp_path_factory.mktemp("whole"), documents=(extras(documents()), EXTRA), benchmark=(bench, "item_id long, text string"))


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("bare"), documents=([], "doc_id long, text string"), benchmark=([], "item_id long, text string"))


def bench_rows(spark, d):
    return [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]


# op11


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_runs(text, orders):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    return w, [" ".join(w[i : i + n]) for n in range(orders[0], orders[1] + 1) for i in range(len(w) - n + 1)]


def plain_resampling(docs, bench, orders=(1, 1), buckets=10_000, least=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in plain_runs(t, orders)[1])
    t = Counter(bucket(f) for _, x in bench for f in plain_runs(x, orders)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, text in docs:
        words, own = plain_runs(text, orders)
        weight = sum(gain(bucket(f)) for f in own)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words) >= least])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


def test_resampling_equals_the_rules_words(spark, whole):
    got = Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in queries.op11_resampling(spark, whole).collect())
    docs = [(r[0], r[1]) for r in documents()]
    want = plain_resampling(docs, bench_rows(spark, whole))
    drop = lambda rows: Counter(r[:4] for r in rows.elements())  # noqa: E731  # which of two equal rows is drawn is open
    assert drop(got) == drop(want) and Counter((r[0], r[4]) for r in got if r[4]) == Counter((r[0], r[4]) for r in want if r[4])


def test_resampling_with_pairs_of_words(spark, whole):
    docs, bench = spark.read.parquet(f"{whole}/documents.parquet"), spark.read.parquet(f"{whole}/benchmark.parquet")
    got = Counter((r["doc_id"], r["n_features"], r["weight"]) for r in sort_count.resampled(docs, bench, "item_id", orders=(1, 2), buckets=500).collect())
    want = plain_resampling([(r[0], r[1]) for r in documents()], bench_rows(spark, whole), (1, 2), 500)
    assert got == Counter(r[:3] for r in want.elements())


def test_buckets_must_fit(spark, whole):
    with pytest.raises(ValueError):
        sort_count.streams(spark.read.parquet(f"{whole}/documents.parquet"), 1 << 17)


def test_resampling_of_nothing_and_towards_nothing(spark, bare, whole):
    assert queries.op11_resampling(spark, bare).count() == 0
    docs = spark.read.parquet(f"{whole}/documents.parquet")
    got = sort_count.resampled(docs, spark.read.parquet(f"{bare}/benchmark.parquet"), "item_id")
    assert got.where("n_features = 0 and weight <> 0").count() == 0 and got.count() == docs.count()


# op12


def plain_search(docs, items, k=50):
    terms = lambda t: [low(w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := terms(t))]
    n, size = len(held), sum(c for *_, c in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = []
    for item, own in asked.items():
        scores = []
        for i, c, length in held:
            m = 50 + (50 * length * n) // size
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def test_tiered_search_equals_a_full_one(spark, whole):
    got = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in queries.op12_tiered_search(spark, whole).collect()), key=str)
    assert got == plain_search([(r[0], r[1]) for r in documents()], bench_rows(spark, whole))


@pytest.mark.parametrize(("tiers", "k"), [(((8, 1), (2, 2)), 3), (((1000, 1), (1000, 2)), 2), (((4, 2), (1, 1)), 40)])
def test_items_without_proof_fall_through(spark, whole, monkeypatch, tiers, k):
    monkeypatch.setattr(tiered, "TIERS", tiers)
    docs, items = spark.read.parquet(f"{whole}/documents.parquet"), spark.read.parquet(f"{whole}/benchmark.parquet")
    scratch = Scratch()
    asked = scratch.written(tiered.asked_terms(items), "asked")
    index, terms = tiered.build(docs, asked.select("term").distinct(), scratch)
    found, went_on = tiered.search(index, terms, asked, scratch, k)
    got = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()), key=str)
    assert got == plain_search([(r[0], r[1]) for r in documents()], bench_rows(spark, whole), k)
    assert went_on[-1] == 0 and (went_on[0] > 0 or tiers[1] == (1, 1))
    if tiers[0] == (8, 1):  # bounds are above all that lies below
        rows = index.join(terms, "term")
        assert rows.where("(tier > 1 and impact > r1) or (tier > 2 and impact > r2)").count() == 0


def test_tiered_search_scores_few_of_the_seen_documents_in_full(spark, monkeypatch):
    monkeypatch.setattr(tiered, "TIERS", ((8, 2), (2, 4)))
    sizes, scored = [], tiered._scored

    def counted(index, every, seen, numbers):
        sizes.append(seen.count())
        return scored(index, every, seen, numbers)

    monkeypatch.setattr(tiered, "_scored", counted)
    rows = [(i, "rare " * (i % 7) + "a b c " * (1 + i % 3) + "x " * (i % 11)) for i in range(400)]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "rare a b c"), (2, "b x")], "item_id long, text string")
    got = [tuple(r) for r in tiered.ranked_search(docs, items, 5).orderBy("item_id", "rank").collect()]
    assert sizes[0] == 10 and sizes[1] < 400  # the leaders of both items; of 800 pairs, those that reach their floor
    monkeypatch.setattr(tiered, "BROADCAST", 0)  # without numbers
    assert got == [tuple(r) for r in tiered.ranked_search(docs, items, 5).orderBy("item_id", "rank").collect()]


def test_tiered_search_without_a_dictionary_of_terms(spark, whole, monkeypatch):
    monkeypatch.setattr(tiered, "ASKED_TERMS", 3)
    monkeypatch.setattr(tiered, "BROADCAST", 5)
    got = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in queries.op12_tiered_search(spark, whole).collect()), key=str)
    assert got == plain_search([(r[0], r[1]) for r in documents()], bench_rows(spark, whole))


def test_ties_and_nothing_to_search(spark, bare):
    assert queries.op12_tiered_search(spark, bare).count() == 0
    docs = spark.createDataFrame([(k, "same words here") for k in range(30, 0, -1)] + [(None, "same words here"), (99, "other")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "words"), (2, "none of it")], "item_id long, text string")
    got = [(r["item_id"], r["rank"], r["doc_id"]) for r in tiered.ranked_search(docs, items, 31).orderBy("item_id", "rank").collect()]
    # a word that nearly all have is worth little, but more than nothing
    assert got == [(1, k + 1, d) for k, d in enumerate([*range(1, 31), None])]


# op13


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
@settings(max_examples=150, deadline=None)
def test_the_plan_places_every_token_once(counts):
    plan = cost_packing.balanced(counts, 64, lambda n: cost_packing.attention_cost(n, 4))
    pieces, places, total = defaultdict(list), defaultdict(list), sum(n * c for n, c in counts.items())
    for n, rank, times, at, part, sequence, offset in plan.tolist():
        for k in range(times):
            pieces[n, rank + k].append((at, part))
            places[sequence + k].append((offset, part))
    assert pieces.keys() == {(n, r) for n, c in counts.items() for r in range(c)}
    for (n, _), parts in pieces.items():
        assert [a for a, _ in sorted(parts)] == list(np.cumsum([0, *[p for _, p in sorted(parts)]])[:-1]) and sum(p for _, p in parts) == n
    sizes = Counter()
    for parts in places.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0, *[p for _, p in sorted(parts)]])[:-1])
        sizes[sum(p for _, p in parts)] += 1
    assert sizes[64] == total // 64 and all(s & (s - 1) == 0 for s in sizes) and sum(s * c for s, c in sizes.items()) == total


def test_the_lowest_cost_gets_the_next():
    # two sequences: 50 and 40 open one each; the cheaper one gets 10, and so on
    plan = cost_packing.balanced({50: 1, 40: 1, 10: 2, 9: 2}, 64, lambda n: n * n)
    where = {(n, r): seq for n, r, _, _, _, seq, _ in plan.tolist() if _ == 0 or True}
    assert where[50, 0] != where[40, 0] and where[10, 0] == where[40, 0]


def test_costs_are_balanced():
    rng = random.Random(5)
    counts = Counter(min(4096, int(rng.lognormvariate(5.8, 1.1)) + 2) for _ in range(20_000))
    plan = cost_packing.balanced(counts)
    cost, size = Counter(), Counter()
    for n, rank, times, at, part, sequence, offset in plan.tolist():
        for k in range(times):
            cost[sequence + k] += cost_packing.attention_cost(part)
            size[sequence + k] += part
    full = [cost[s] for s in cost if size[s] == 4096]
    assert max(full) <= 1.4 * np.mean(full) and np.std(full) <= 0.1 * np.mean(full)


def test_cost_packing(spark, whole):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path(cost_packing.TOKENIZER))
    got = queries.op13_cost_packing(spark, whole).collect()
    ids = {}
    for r in documents():
        ids.setdefault(r[0], []).append(np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4"))
    rows, bins = defaultdict(list), defaultdict(list)
    for r in got:
        rows[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert rows.keys() == ids.keys()
    for doc, own in ids.items():
        want = {len(x): x for x in own}  # rows that repeat a doc_id here are equal or of different lengths
        spans = defaultdict(list)
        for start, length, crc, total in rows[doc]:
            assert crc == zlib.crc32(want[total][start : start + length].tobytes())
            spans[total].append((start, length))
        for x in want:
            n = sum(len(o) == x for o in own)
            assert sum(length for _, length in spans[x]) == n * x
            assert Counter(t for s, length in spans[x] for t in range(s, s + length)) == Counter({t: n for t in range(x)})
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(len(x) for own in ids.values() for x in own)
    assert sum(sum(n for _, n in p) == 4096 for p in bins.values()) == total // 4096


def test_cost_packing_of_nothing(spark, bare):
    assert queries.op13_cost_packing(spark, bare).count() == 0


@given(st.text(alphabet=st.sampled_from("abZéÀßµªº01 \t\n\r\x0b\x0c\x85  ́'s't'LL.,!?-|<>Σσ漢😀İ\x1c\x1f"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_word_ids_are_the_tokenizers(text):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path(cost_packing.TOKENIZER)
    tokenizer = Tokenizer.from_file(path)
    for t in (text, text + "<|endoftext|>" + text, "<|EndOfText|>" + text):
        assert cost_packing.encode(t.encode(), path) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


# batches and stages


def test_batches_are_bounded_by_bytes(spark):
    from quern.llm.near_dedup import _parts
    import pandas as pd

    pdf = pd.DataFrame({"text": ["x" * n for n in (10, 2_000_000, 5, 5, 700_000, 700_000)]})
    parts = [len(p) for p in _parts(pdf, pdf["text"].str.len().to_numpy())]
    assert sum(parts) == 6 and max(p["text"].str.len().sum() for p in _parts(pdf, pdf["text"].str.len().to_numpy()) if len(p) > 1) <= 1 << 20
    sort_count.small_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) <= 8 << 20


def test_six_hundred_long_texts_in_one_partition(spark):
    from quern.llm import near_dedup

    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = " ".join(rng.choice(vocabulary) for _ in range(4000))
    docs = spark.createDataFrame([(k, base if k % 3 == 0 else f"{base} tail{k}") for k in range(120)], "doc_id long, text string").coalesce(1)
    assert {r["component_id"] for r in near_dedup.near_duplicates(docs).collect()} == {0}


def test_stages_by_themselves(spark, tmp_path):
    """Each filtering stage keeps what its operator, applied by hand, accepts; the mix holds its targets; packing loses nothing."""
    import corpus_pipeline as c

    rows = [(*r[:5], "clash", "clash", 1, 2, 3) for r in documents()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _found string, row string, _id long, _times long, _copy long"
    labels = [(k, int(k % 7 > 0), 0) for k in range(160)]
    d = folder(spark, tmp_path, documents=(rows, schema), labels=(labels, "doc_id long, quality int, toxic int"))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    key = lambda r: (r["doc_id"], r["text"])
    model = language.fit(docs)
    texts = [r["text"] for r in docs.collect()]
    lang, score = model.predict([t or "" for t in texts])
    letter = [bool(t and re.search(r"[^\W\d_]", t)) for t in texts]
    want = Counter(key(r) for r, s, ok in zip(docs.collect(), score, letter) if ok and s >= c.LEAST_SURE)
    first = c.by_language(spark, docs, d)
    assert Counter(map(key, first.collect())) == want and first.columns == docs.columns
    judged = quality.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    want = Counter(key(r) for r in docs.collect() if judged.score([r["text"] or ""])[0] >= quality.CUT)
    second = c.by_quality(spark, docs, d)
    assert Counter(map(key, second.collect())) == want and second.columns == docs.columns
    mixed = c.mixed(spark, docs, d)
    size = lambda t: len((t or "").encode().split())
    taken, have = Counter(), Counter()
    for r in mixed.collect():
        taken[r["source"]] += size(r["text"])
    for r in rows:
        have[r[3]] += size(r[1])
    by_hand = Counter()
    for r in mixing.mix(docs).collect():
        by_hand[r["source_size"]] += r["taken"]
    assert mixed.columns == docs.columns and {have[s]: n for s, n in taken.items()} == {k: v for k, v in by_hand.items() if v}
    packed = c.packed(spark, mixed, d)
    assert packed.where("piece = 0").count() == mixed.count()


@pytest.mark.parametrize("seed", range(4))
def test_best_two_fit_is_near_the_fewest_bins(seed):
    """Exhaustive search over small cases: at most one bin more than the fewest."""
    rng = random.Random(seed)
    for _ in range(10):
        lengths = sorted((rng.randint(8, 40) for _ in range(9)), reverse=True)

        def fewest(left, gaps, best):
            if len(gaps) >= best:
                return best
            if not left:
                return len(gaps)
            n, seen = left[0], set()
            for k, g in enumerate(gaps):
                if g >= n and g not in seen:
                    seen.add(g)
                    best = min(best, fewest(left[1:], gaps[:k] + (g - n,) + gaps[k + 1 :], best))
            return min(best, fewest(left[1:], (*gaps, 64 - n), best))

        assert sum(t for _, t in packing.patterns(Counter(lengths), 64)) <= fewest(tuple(lengths), (), 10) + 1
