"""Ranked search, packing and clusters against oracles, brute force and awkward rows."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from seasontide.llm import centroids, chunk_ids, common, packing, queries, ranked

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "One two, three. Four FIVE!"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, LONG), (None, "no id, two"),
        (None, "no id, two"), (7, "日本語 é É ﬁ"), (8, "x" * 9000), (9, "ab <|endoftext|> c | d"), (9, "another text of 9"),
    ]
    frame = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, item_id string, ids int")
    return frame.repartition(2)


# ---- chunks


@pytest.mark.parametrize("path,spaced", [(BYTES, True), (WORDS, False)])
def test_chunks_equal_the_library(path, spaced):
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(path), chunk_ids.ChunkEncoder(path, spaced), random.Random(3)
    pool = [" ", "  ", "\n", "\t", " \n", " ", "　", "foo", "Bar", "don't", "'s", "İ", "ß", "é", "́", "日本語", "。"]
    pool += ["...", "!", "|", "<|endoftext|>", "<|startoftext|>", "12", "the ", "\x1c", "\x85", "\x00", "𝕏", "½", "_", "Σ", "a"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(14))) for _ in range(4000)] + ["", None]
    want = [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = []
    for at in range(0, len(texts), 300):
        ids, bounds = own.encode(pa.array(texts[at : at + 300]))
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == want


# ---- 11 ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def test_terms():
    for text in ("One TWO-three_4 é!É 日本 ａ", "", "\x00a\x7fb", "".join(map(chr, range(0x250)))):
        want = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        assert [t.decode() for t in ranked.terms(text.encode())] == want


def brute_ranks(items, documents, k):
    import math

    split = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    found = [(d, collections.Counter(split(t))) for d, t in documents]
    found = [(d, c, sum(c.values())) for d, c in found if c]
    n, total = len(found), sum(x[2] for x in found)
    df = collections.Counter(t for _, c, _ in found for t in c)
    wanted = collections.defaultdict(set)
    for i, t in items:
        wanted[i] |= set(split(t))
    out = set()
    for i, asked in wanted.items():
        scores = []
        for d, c, size in found:
            m = 50 + 50 * size * n // total
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in asked & c.keys()
            )
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out |= {(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize("block", [500_000, 8])
def test_search_awkward(spark, odd, monkeypatch, block):
    """Also in several blocks of items."""
    items = [(1, "one TWO w3x3"), (2, None), (3, "id two two"), (3, "other é"), (None, "text of x"), (4, "never seen"), (5, "w1x1 w2x2 c d ab")]
    frame = spark.createDataFrame(items, "item_id int, text string").withColumn("doc_id", ranked.F.lit("clash"))
    monkeypatch.setattr(ranked, "BLOCK_TERMS", block)
    documents = [(r.doc_id, r.text) for r in odd.collect()]
    found = ranked.search(frame, odd, k=3).collect()
    assert {tuple(r) for r in found} == brute_ranks(items, documents, 3) and len(found) == len({(r.item_id, r["rank"]) for r in found})
    assert ranked.search(frame.where("false"), odd).count() == 0 and ranked.search(frame, odd.where("false")).count() == 0
    assert ranked.search(frame, odd.where("doc_id in (2, 3, 4)")).count() == 0


def test_best_is_safe_for_ties():
    rng = np.random.default_rng(2)
    scores, ids = rng.integers(0, 4, (3, 400)), rng.permutation(400)
    for width in (1, 7, 400):
        best = ranked._Best(3, 20)
        for at in range(0, 400, width):
            best.offer(0, scores[:, at : at + width], ids[at : at + width], np.zeros(len(ids[at : at + width]), bool))
            best.sift()
        item, score, doc, _ = best.sift()
        for i in range(3):
            want = sorted((-s, d) for s, d in zip(scores[i], ids) if s > 0)[:20]
            assert [(-s, d) for s, d in zip(score[item == i], doc[item == i])] == want


# ---- 12 packing


def brute_plan(places, penalties, length, least):
    cost = [0]
    for j in range(1, len(places)):
        options = []
        for i in range(j):
            size = int(places[j] - places[i])
            if size <= length:
                options.append(cost[i] + (0 if size >= least and size & (size - 1) == 0 else length - size))
        cost.append(min(options) + int(penalties[j]))
    return cost


def test_plan_is_the_cheapest(monkeypatch):
    rng = random.Random(1)
    for _ in range(200):
        docs = np.cumsum([rng.randrange(1, 30) for _ in range(rng.randrange(1, 40))])
        sentences = np.array(sorted({rng.randrange(1, int(docs[-1]) + 1) for _ in range(rng.randrange(20))}), np.int64)
        monkeypatch.setattr(packing, "STRIDE", rng.choice([3, 7]))
        monkeypatch.setattr(packing, "LEAST_POWER", rng.choice([2, 8]))
        places, penalties = packing.boundaries(docs, sentences)
        assert packing.plan(places, penalties, 32)[0] == brute_plan(places, penalties, 32, packing.LEAST_POWER)
        for last in (True, False):
            found = packing.cuts(places, penalties, 32, last)
            assert found[0] == 0 and (not last or found[-1] == places[-1]) and all(0 < b - a <= 32 for a, b in zip(found, found[1:]))


def check_pieces(rows, want):
    """Every id in one piece; offsets without gaps; returns the share of padding."""
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) > 0 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        sequences[r["sequence_id"]].append(r)
        pieces[r["doc_id"]].append(r)
    used = padding = 0
    for held in sequences.values():
        size = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == size
            size += r["length"]
        assert size <= 2048
        used, padding = used + size, padding + (0 if size & (size - 1) == 0 else 2048 - size)
    for doc, texts in want.items():
        held = sorted(pieces.pop(doc), key=lambda r: (r["start"], r["doc_tokens"]))
        if len(texts) == 1:
            assert [x for r in held for x in r["ids"]] == texts[0] and {r["doc_tokens"] for r in held} == {len(texts[0])}
            assert [r["start"] for r in held] == np.cumsum([0, *[r["length"] for r in held]])[:-1].tolist()
        else:
            assert sum(r["length"] for r in held) == sum(map(len, texts)) and sum(r["start"] == 0 for r in held) == len(texts)
    assert not pieces
    return padding / max(used, 1)


def wanted_ids(rows):
    from tokenizers import Tokenizer

    library, want = Tokenizer.from_file(WORDS), collections.defaultdict(list)
    for doc, text in rows:
        want[doc].append([*library.encode(text or "", add_special_tokens=False).ids, 1])
    return want


def test_pack(spark, sf, odd):
    for frame, most in ((common.table(spark, sf, "documents"), 0.02), (odd, 0.05)):
        rows = [r.asDict() for r in packing.pack(frame, WORDS).collect()]
        assert check_pieces(rows, wanted_ids([(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()])) < most
    assert packing.pack(odd.where("false"), WORDS).count() == 0
    query = lambda: sorted(map(tuple, queries.op12_pack_sequences(spark, sf).collect()))
    assert query() == query()


def test_pack_in_many_blocks():
    """Blocks end inside documents, which go on in the next block."""
    rng = np.random.default_rng(4)
    stream, rows, want = packing._Stream(2048, 3, pa.int64()), [], {}
    for doc in range(300):
        size = int(rng.choice([1, 5, 300, 700, 9000]))
        ids = rng.integers(0, 49_000, size).astype("<i4")
        want[doc] = [ids.tolist()]
        sentences = np.unique(rng.integers(1, size, size // 15)) if size > 20 else np.zeros(0, np.int64)
        stream.add([doc], ids, np.array([0, size]), sentences)
        if len(stream.ids) > 5000:
            rows += stream.take(last=False).to_pylist()
    rows += stream.take(last=True).to_pylist()
    assert check_pieces(rows, want) < 0.02 and min(r["sequence_id"] for r in rows) == 3 << 33


# ---- 13 clusters


def brute_clusters(rows, count, rounds):
    """Lloyd's rounds in Python's whole numbers."""
    import hashlib
    import math

    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes())
    centres = [v for _, v in sorted(kept, key=key)[:count]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        held = collections.defaultdict(list)
        for _, v in kept:
            held[near(v)[1]].append(v)
        centres = [[sum(c) // len(held[k]) for c in zip(*held[k])] if k in held else c for k, c in enumerate(centres)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=str), centres


@pytest.mark.parametrize("count", [1, 8, 40])
def test_clusters_of_awkward_vectors(spark, count):
    rng = np.random.default_rng(7)
    made = [np.round(rng.normal(size=64) * 0.2 + c, 2).tolist() for c in rng.normal(size=(5, 64)) for _ in range(30)]
    rows = list(enumerate(made)) + [(500 + i, made[0]) for i in range(40)] + [(3, made[3]), (3, made[9]), (None, made[4]), (None, None)]
    rows += [(600, []), (601, made[0][:63]), (602, [None, *made[0][1:]]), (603, [float("nan"), *made[0][1:]]), (604, [float("inf"), *made[0][1:]])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, x string").repartition(3)
    found, centres = centroids.cluster(frame, count=count, rounds=3)
    want, brute = brute_clusters(rows, count, 3)
    assert sorted(map(tuple, found.collect()), key=str) == want and centres.tolist() == brute
    facts = centroids.summarised(frame, count=count, rounds=3).collect()
    assert sum(r.distance for r in facts) == facts[0].inertia and len(facts) == len(want)


def test_clusters_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.summarised(spark.createDataFrame([], schema)).count() == 0
    one = centroids.summarised(spark.createDataFrame([(5, [0.5] * 64)], schema)).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in one] == [(5, 0, 0, 0)]
    with pytest.raises(Exception, match="64 bits"):
        centroids.summarised(spark.createDataFrame([(5, [1e9] * 64)], schema)).collect()


def test_search_of_centroids_skips_and_agrees():
    rng = np.random.default_rng(8)
    centres = (rng.normal(size=(200, 64)) * 50 + rng.normal(size=(200, 1)) * 300).astype(np.int64)
    centres[7] = centres[3]
    x = (rng.normal(size=(3000, 64)) * 50 + rng.normal(size=(3000, 1)) * 300).astype(np.int64)
    x[:200] = centres
    search = centroids.Search(centres)
    label, distance = search.nearest(x)
    full = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (label == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert search.compared < full.size / 3
