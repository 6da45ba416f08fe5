"""Training-data operators against oracles, libraries, brute force, and awkward rows."""

import collections
import hashlib
import math
import re
import zlib

import harness
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from seasontide.llm import chat, common, components, forest, grid_join, language, mixing, pieces, quality, queries, suffixes, token_files, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
TEXTS = [
    (1, "One two three four five six.\nOne two three four five six.", "en", "a"), (2, None, None, None), (3, "", "en", "a"),
    (4, " \n\t ", None, "b"), (5, LONG, "fr", "b"), (6, LONG, "fr", None), (7, LONG + " more", "fr", "a"), (8, "word", "en", "a"),
    (9, "日本語 ▁ mixed \\ é\r\n!!", "en", "a"), (10, "word", "en", "a"), (None, "no id here", "en", "a"),
    (11, "same row twice", "en", "a"), (11, "same row twice", "en", "a"), (12, "x" * 5000, "en", "c"),
    (13, "ab <|endoftext|> c|d <|startoftext|>x", "en", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward documents, with columns whose names could clash with inner ones."""
    rows = [(*r, len(r[1] or ""), 1, "z") for r in TEXTS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, size int, component string"
    ).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def documents(spark, sf):
    return common.table(spark, sf, "documents").select("doc_id", "text").collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, oracle, sf, name):
    assert not harness.compare(spark, oracle, queries.queries()[name], queries.oracle_sql()[name], sf)


def test_base_statistics_oracle(spark, oracle, sf):
    run = lambda s, d: quality.base_statistics(common.table(s, d, "documents")).drop("n_shouts")
    assert not harness.compare(spark, oracle, run, quality.BASE_ORACLE, sf)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 90), (90, 95), (7, 7)] + [(200, 201 + i) for i in range(50)]
    found = dict(components.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert {found[i] for i in range(61)} == {0} and found[100] == found[95] == 90 and found[250] == 200
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1 WARC


def test_warc_awkward(spark):
    big = "é" * 700_000
    rows = [(1, "u", big), (2, "u\r\nX: y", big), (3, None, None), (4, "", ""), (None, "n", ""), (5, "v", "WARC/1.1\r\n\r\n"), (5, "v", "WARC/1.1\r\n\r\n")]
    found = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()
    assert len(found) == 7 and all(r.digest_holds for r in found)
    by = {r.page_id: r for r in found}
    assert by[1].record_type == "revisit" and by[1].refers_to == 2 and by[2].payload_bytes == 1_400_000
    assert by[2].url == "u\r\nX: y" and by[3].refers_to == 4 and by[None].refers_to == 4 and by[4].record_type == "response"
    assert [r.record_type for r in found if r.page_id == 5] == ["response"] * 2
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(empty).count() == 0


def test_warc_chunks(spark):
    pages = spark.createDataFrame([(1, "u", "a" * (3 * warc.CHUNK + 5))], "page_id long, url string, html string")
    folder = common.scratch(spark, "warc")
    chunks = warc.read_chunks(warc.write(warc.record_types(pages), folder), folder).orderBy("chunk").collect()
    assert [len(c.data) for c in chunks] == [warc.CHUNK] * 3 + [5]
    for i, c in enumerate(chunks):
        assert bytes(c.digest_so_far) == hashlib.sha1(b"a" * min((i + 1) * warc.CHUNK, 3 * warc.CHUNK + 5)).digest()


# ---- 2 token files, 5 pieces


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    return [np.array([*x.ids, 2], "<u4") for x in t.encode_batch(texts, add_special_tokens=False)]


def test_token_files(spark, sf, odd, none):
    for frame in (common.table(spark, sf, "documents"), odd):
        rows = sorted(((r.doc_id, r.text or "") for r in frame.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        start, want = 0, []
        for (doc, _), ids in zip(rows, library_ids([t for _, t in rows])):
            want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        found = [tuple(r) for r in token_files.round_trip(frame, BYTES).collect()]
        assert sorted(found, key=lambda r: r[1]) == want
    assert token_files.round_trip(none, BYTES).count() == 0


def test_token_file_pruning(spark, sf):
    path = token_files.write(token_files.encode(common.table(spark, sf, "documents"), BYTES), common.scratch(spark, "tokens"))
    one = token_files.read(spark, path).where("doc_id = 77")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,77)" in plan and one.count() == 1


def test_pieces(spark, sf, odd, none):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for frame in (common.table(spark, sf, "documents"), odd):
        want = []
        for r in frame.collect():
            ids = m.encode(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(m.decode(ids).encode()).hexdigest()))
        assert sorted(map(tuple, pieces.round_trip(frame, PIECES).collect()), key=str) == sorted(want, key=str)
    assert pieces.round_trip(none, PIECES).count() == 0
    texts = {r.doc_id: r.text for r in pieces.decode(pieces.encode(odd, PIECES), PIECES).collect()}
    assert texts[5] == LONG and texts[2] == ""


def test_piece_table_random():
    import random

    import sentencepiece

    m, table, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.load(PIECES), random.Random(5)
    pool = ["aaaa", "  ", "\n", "é", "日本", "▁", "<0x0A>", "</s>", "\t", "𝕏", "the", "ing", "!!!!", "//", ".", ",", "e.g", "ab" * 9]
    for _ in range(3000):
        text = "".join(rng.choice(pool) if rng.random() < 0.6 else chr(rng.randrange(1, 0x400)) for _ in range(rng.randrange(14)))
        assert table.encode(text) == m.encode(text) and table.decode(m.encode(text)) == m.decode(m.encode(text))


# ---- 3 near duplicates


def shingles(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or frozenset([tuple(words)])


def groups(sets, percent):
    """Smallest id reachable, by comparing all documents that share a shingle."""
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    index = collections.defaultdict(list)
    for i, s in sets.items():
        for j in {j for x in s for j in index[x]}:
            shared = len(s & sets[j])
            if 100 * shared >= percent * (len(s) + len(sets[j]) - shared):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            index[x].append(i)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, sf, k, percent):
    sets = {r.doc_id: shingles(r.text, k) for r in documents(spark, sf)}
    want = groups(sets, percent)
    for r in forest.near_duplicates(common.table(spark, sf, "documents"), k, percent).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicates_crowded(spark):
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    texts = {}
    for i in range(400):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 5), replace=False):
            words[at] = f"n{i}_{at}"
        texts[i] = " ".join(words)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = groups({i: shingles(t, 3) for i, t in texts.items()}, 85)
    assert {r.doc_id: r.component_id for r in forest.near_duplicates(frame, 3, 85).collect()} == want


def test_near_duplicates_crowded_threshold(spark):
    """Pairs of exactly 80 % among 1,400 documents of one template, which are alike by 77 % and link with no other."""
    template = " ".join(f"t{i}" for i in range(114))
    rows = [
        (i, f"{template} " + " ".join([f"p{i // 2}x{j}" for j in range(2)] + [f"o{i}x{j}" for j in range(14)])) for i in range(1400)
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = {r.doc_id: r.component_id for r in forest.near_duplicates(frame, 5, 80).collect()}
    assert found == {i: i - i % 2 for i, _ in rows}


def test_near_duplicates_awkward(odd, none):
    found = {r.doc_id: r for r in forest.near_duplicates(odd, 3, 85).collect()}
    assert found[2].n_shingles == found[4].n_shingles == 0 and found[4].component_id == 4
    assert found[7].component_id == found[6].component_id == 5 and found[10].component_id == 8 and found[11].kept
    assert found[None].component_id is None and found[None].kept
    assert forest.near_duplicates(none, 3, 85).count() == 0


# ---- 4 mixing


def test_mix_targets_and_awkward(spark, odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.taken <= 2 * r.size for r in rows)
    source = {(r[0], r[1]): r[3] for r in TEXTS}
    taken, target = collections.Counter(), {}
    for r in odd.select("doc_id", "source").distinct().join(mixing.mix(odd).distinct(), "doc_id").collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    for name in ("b", "c"):
        assert int(target[name]) == taken[name]
    assert sum(target.values()) <= 1.5 * sum(len(WORD.findall(t or "")) for _, t, _, _ in TEXTS) + 1 and source
    assert mixing.mix(none).count() == 0
    assert sorted(map(str, mixing.mix(odd.repartition(5)).collect())) == sorted(map(str, rows))


def test_query_reads_the_range_sorted_order(spark, odd, none, sf, monkeypatch):
    order = mixing.training_order(mixing.mix(odd, seat="seat"), "seat")
    lines = order.select("*", "_metadata.file_path", "_metadata.row_index").collect()
    lines.sort(key=lambda r: (r.file_path, r.row_index))
    positions = [r.position for r in lines if r.position is not None]
    assert len(positions) > 5 and positions == sorted(positions)
    plan = mixing.mix(odd).collect()
    assert len(lines) == sum(max(len(r.positions), 1) for r in plan)
    assert sorted(map(str, mixing.read_back(order, "seat").select(*mixing.mix(odd).columns).collect())) == sorted(map(str, plan))
    assert mixing.read_back(mixing.training_order(mixing.mix(none, seat="seat"), "seat"), "seat").count() == 0
    sorts, plain = [], mixing.in_order
    monkeypatch.setattr(mixing, "in_order", lambda *args: sorts.append(args) or plain(*args))
    assert queries.op4_mix_sources(spark, sf).count() == common.table(spark, sf, "documents").count()
    assert len(sorts) == 1


def test_inverse_demand(spark):
    for points in mixing.SCHEDULES:
        u = np.linspace(0, 1, 100_001)
        w = np.interp(u, *zip(*points))
        total = np.concatenate(([0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(u))))
        shares = spark.range(21).select((F.col("id") / 20).alias("s"))
        for r in shares.select("s", mixing.inverse_demand(F.col("s"), points).alias("u")).collect():
            assert abs(np.interp(r.u, u, total) / total[-1] - r.s) < 1e-6


# ---- 6 chats


def test_chat_escapes(spark):
    texts = ["\\", "\\\\", "#", "##", "#####", "#\\#", "</turn>", "<\\/turn>", "</turn>\n### user:\n", "a\\", "", None, "</turn", "<</turn>>", "\\### x"]
    roles = ["user", "assistant", "a:", ":\n", "x\n", "", None, "#", "assistant"]
    rows = [(1, i, roles[i % len(roles)], t) for i, t in enumerate(texts)] + [(2, None, "user", "x"), (2, None, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    messages = chat.conversation_messages(frame)
    made = chat.format_paths(chat.root_paths(messages), messages)
    turns = {r.tree: r.t for r in made.select("tree", chat.parse(made["formatted"]).alias("t")).collect()}
    assert [tuple(t) for t in turns[1]] == [(roles[i % len(roles)] or "", t or "") for i, t in enumerate(texts)] and len(turns[2]) == 2
    learned = made.where("tree = 1").select(chat.masked_text(made["formatted"], made["loss_mask"])).first()[0]
    assert learned == "".join(t or "" for i, t in enumerate(texts) if roles[i % len(roles)] == "assistant")
    assert chat.read_back(chat.format_paths(chat.root_paths(messages.where("false")), messages)).count() == 0


def test_reply_tree_branches(spark):
    #      1 -> 2 -> 4 (good), 1 -> 3 -> 5 -> 6 (bad); another tree of one message
    rows = [(1, 1, None, 0.0), (1, 2, 1, 3.0), (1, 3, 1, 1.0), (1, 4, 2, 3.0), (1, 5, 3, 1.0), (1, 6, 5, None), (2, 1, 99, 1.0)]
    frame = spark.createDataFrame(rows, "tree long, id int, parent int, score double")
    best = {(r.tree, r.leaf, r.depth_left, r.id) for r in chat.root_paths(frame).collect()}
    assert best == {(1, 4, 0, 4), (1, 4, 1, 2), (1, 4, 2, 1), (2, 1, 0, 1)}
    both = chat.root_paths(frame, branches=0).where("tree = 1 and leaf = 6").orderBy("depth_left").collect()
    assert [r.id for r in both] == [6, 5, 3, 1]


# ---- 7 repeated passages


def repeats(rows, least):
    first, seen, want = {}, {}, {}
    for doc, text in sorted(rows):
        words = WORD.findall(text or "")
        if text in seen and len(words) >= least:
            want[doc] = {(0, len(words))}
            continue
        seen[text], hit = 1, np.zeros(len(words), bool)
        for i in range(len(words) - least + 1):
            origin = first.setdefault(tuple(words[i : i + least]), (doc, i))
            if origin != (doc, i):
                hit[max(i, origin[1] + least) if origin[0] == doc else i : i + least] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(int), [0])))).tolist()
        if edges:
            want[doc] = set(zip(edges[::2], edges[1::2]))
    return want


def test_repeated_passages(spark, sf):
    want = repeats([tuple(r) for r in documents(spark, sf)], 50)
    found = collections.defaultdict(set)
    for r in suffixes.repeated_spans(common.table(spark, sf, "documents")).collect():
        found[r.doc_id].add((r.start_word, r.end_word))
    assert found == want and want


def test_repeated_passages_awkward(spark, odd, none):
    found = {r.doc_id: (r.start_word, r.end_word, r.first_doc_id) for r in suffixes.repeated_spans(odd).collect()}
    assert found == {6: (0, 30_000, 5), 7: (0, 30_000, 5)}
    same = spark.createDataFrame([(1, "a " * 120), (2, "b " * 49)], "doc_id long, text string")
    assert [tuple(r) for r in suffixes.repeated_spans(same).collect()] == [(1, 50, 120, 1)]
    assert suffixes.remove_repeats(same).orderBy("doc_id").first().text.split() == ["a"] * 50
    cleaned = {r.doc_id: r.text for r in suffixes.remove_repeats(odd).collect()}
    assert 6 not in cleaned and cleaned[7] == "more" and cleaned[3] == "" and cleaned[2] is None
    assert suffixes.repeated_spans(none).count() == 0 and suffixes.remove_repeats(none).count() == 0


# ---- 8 embeddings


def test_vector_duplicates(spark, sf):
    rng = np.random.default_rng(4)
    made = [tuple(map(float, np.round(rng.normal(size=6) + c, 2))) for c in rng.normal(size=(8, 6)) * 3 for _ in range(60)]
    rows = [(i, list(v)) for i, v in enumerate(made)] + [(900 + i, list(made[0])) for i in range(5)]
    rows += [(1000, None), (1001, [0.0] * 6), (1002, [1.0, None, 2.0]), (1003, [float("nan")] * 6), (1004, []), (None, list(made[0]))]
    for frame, ids, x in (
        (spark.createDataFrame(rows, "vec_id long, embedding array<double>"), None, None),
        (common.table(spark, sf, "embeddings"), None, None),
    ):
        data = [r for r in frame.select("vec_id", "embedding").collect()]
        good = [r for r in data if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
        x = np.array([r[1] for r in good], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= 0.95
        links = {r[0]: int(near[i].sum()) - 1 for i, r in enumerate(good)}
        low = np.array([r[0] for r in good])
        for _ in range(len(low)):
            new = np.array([low[n].min() for n in near])
            if (new == low).all():
                break
            low = new
        want = {r[0]: int(low[i]) for i, r in enumerate(good)}
        found = grid_join.near_duplicates(frame.withColumn("label", frame.vec_id), 0.95).collect()
        assert len(found) == len(data)
        for r in found:
            assert (r.n_links, r.component_id) == (links.get(r.vec_id, 0), want.get(r.vec_id, r.vec_id))
    assert grid_join.near_duplicates(frame.where("false")).count() == 0


def test_vector_rows_that_repeat_an_id(spark):
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [2.0, 0.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0])]
    found = grid_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == [(5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 0, 7), (7, 0, 7)]


def test_vector_duplicates_many_stretches(spark, monkeypatch):
    rng = np.random.default_rng(5)
    made = [np.round(rng.normal(size=6) + c, 2).tolist() for c in rng.normal(size=(6, 6)) * 3 for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(made)), "vec_id long, embedding array<double>")
    monkeypatch.setattr(grid_join, "BLOCK", 16)
    monkeypatch.setattr(grid_join, "STRETCH_BYTES", 1)
    x = np.array(made)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    low = np.arange(len(x))
    for _ in range(len(x)):
        low = np.array([low[n].min() for n in near])
    for r in grid_join.near_duplicates(frame).collect():
        assert (r.n_links, r.component_id) == (near[r.vec_id].sum() - 1, low[r.vec_id])


def test_repeats_of_ids_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 60), ("b", 900), ("c", 60)))
    rows = [(1, a + " " + b, 7), (1, c, 7), (2, c + " tail", 7), (2, b + " end", 7), (2, b + " end", 7), (3, c, 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, print1 int").selectExpr("*", "1 as spans", "2 as row", "3 as _id", "4 as _print")
    cleaned = suffixes.remove_repeats(frame)
    assert cleaned.columns == frame.columns and {(r.print1, r.spans, r.row) for r in cleaned.collect()} == {(7, 1, 2)}
    assert sorted((r.doc_id, r.text) for r in cleaned.collect()) == sorted(
        [(1, a + " " + b), (1, c), (2, "tail"), (2, "end"), (2, "end")]
    )


# ---- 9 quality, 10 languages


def test_quality_awkward(spark, sf, odd, none):
    rows = {r.doc_id: r for r in quality.rate(odd).collect()}
    assert rows[2].base_failed and rows[3].n_words == 0 and rows[5].n_words == 30_000 and not rows[5].base_failed
    assert rows[1].n_dup_lines == 1 and rows[1].n_repeat_words == 12 and quality.rate(none).count() == 0
    good = [(i, " ".join(f"word{(i * 7 + j * j) % 613}" for j in range(200)), "en", "s", i) for i in range(300)]
    bad = [(1000, " ".join(f"a$$#{j}" for j in range(200)), "en", "s", 0)]
    frame = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string, n_chars int")
    assert [r.doc_id for r in quality.rate(frame).where("not kept").collect()] == [1000]


def clouds(sizes, seed=3):
    """Base statistics of made-up groups: (doc_id, lang, source, counts ...); each group's words differ in length."""
    rng, rows = np.random.default_rng(seed), []
    for g, (lang, source, n) in enumerate(sizes):
        for _ in range(n):
            words = int(rng.lognormal(6 + 0.2 * g, 0.5)) + 50
            chars = int(words * rng.normal(4.5 + 0.5 * g, 0.3))
            counts = [int(rng.binomial(chars, 0.01)), int(rng.poisson(1)), int(rng.binomial(words, 0.05)), int(rng.binomial(chars, 0.03))]
            rows.append((len(rows), lang, source, words, chars, *counts, False))
    return rows


COUNTS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_shouts long, base_failed boolean"


def plain_distances(rows):
    """Concentration steps from both starts, the least determinant, and blends, one matrix at a time."""
    x = {
        r[0]: np.array([math.log(r[3]), math.log((r[4] + 1) / r[3]), math.sqrt(r[5] / (r[4] + 1)), math.log1p(r[6]) / 4,
                        math.sqrt(r[7] / r[3]), math.sqrt(r[8] / (r[4] + 1))])
        for r in rows
    }
    floors = np.diag(np.square(quality.FLOORS))

    def robust(ids):
        own, best = np.array([np.floor(x[i] * 1024 + 0.5) / 1024 for i in ids]), []
        quartiles = np.quantile(own, [0.25, 0.5, 0.75], axis=0)
        starts = [(own.mean(0), np.cov(own.T, bias=True) + floors), (quartiles[1], np.diag(((quartiles[2] - quartiles[0]) / 1.349) ** 2) + floors)]
        for centre, spread in starts:
            for _ in range(quality.STEPS):
                d2 = np.einsum("ni,ij,nj->n", own - centre, np.linalg.inv(spread), own - centre)
                bins = np.floor(np.log2(d2 + 2.0**-10) * quality.BINS)
                core = own[bins <= np.sort(bins)[math.ceil(quality.CORE * len(own)) - 1]]
                centre, spread = core.mean(0), quality.WIDEN * np.cov(core.T, bias=True) + floors
            best.append((np.linalg.slogdet(spread)[1], centre, spread))
        return (len(ids), *min(best, key=lambda b: b[0])[1:])

    def blend(own, parent):
        w, apart = own[0] / (own[0] + quality.PRIOR_ROWS), own[1] - parent[1]
        return own[0], w * own[1] + (1 - w) * parent[1], w * own[2] + (1 - w) * parent[2] + w * (1 - w) * np.outer(apart, apart)

    pools = collections.defaultdict(list)
    for r in rows:
        for key in ((r[1], r[2]), (r[1],), ()):
            pools[key].append(r[0])
    found = {key: robust(ids) for key, ids in pools.items()}
    out = {}
    for r in rows:
        _, centre, spread = blend(found[r[1], r[2]], blend(found[(r[1],)], found[()]))
        out[r[0]] = (x[r[0]] - centre) @ np.linalg.inv(spread) @ (x[r[0]] - centre)
    return out


def test_outliers_equal_plain_steps(spark):
    """Against a plain version, over two layouts; a fifth of a group are planted outliers that the mean is drawn to."""
    rows = clouds([("en", "a", 400), ("en", None, 60), (None, "b", 7), ("fr", "a", 150)])
    spam = [(i, *r[1:5], r[4] // 3, r[6], r[3] // 2, *r[8:]) for i, r in enumerate(rows[:80], start=10_000)]
    frame = spark.createDataFrame(rows + spam, COUNTS)
    want = plain_distances(rows + spam)
    got = [{r.doc_id: r.distance for r in quality.robust_outliers(frame.repartition(n)).collect()} for n in (2, 7)]
    assert got[0] == got[1]
    assert got[0] == {i: pytest.approx(d, rel=1e-6) for i, d in want.items()}
    assert {i for i, d in got[0].items() if d > quality.CUT} >= {r[0] for r in spam}


def test_no_count_switches_the_estimate(spark):
    """One row more in a group moves distances by little, at 199 and 200 rows as elsewhere."""
    rows = clouds([("en", "a", 300), ("en", "b", 201)])
    frames = [spark.createDataFrame(rows[: 300 + n], COUNTS) for n in (199, 200, 201)]
    found = [{r.doc_id: r.distance for r in quality.robust_outliers(f).collect()} for f in frames]
    for a, b in zip(found, found[1:]):
        assert max(abs(b[i] - a[i]) / (1 + a[i]) for i in a) < 0.1


def test_repeats_of_long_texts(spark):
    """Two windows whose hashes agree in all but the last 20 bits, in a text of more than 2**19 words."""
    words = ["q257529", "left", "right", *(f"w{i}" for i in range(600_000)), "q14504582", "left", "right"]
    frame = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words + words[:3]))], "doc_id long, text string")
    assert {r.doc_id: r.n_repeat_words for r in quality.base_statistics(frame).collect()} == {1: 0, 2: 6}


def test_inverse_matrix(spark):
    a = np.random.default_rng(1).normal(size=(6, 6))
    a = a @ a.T + np.eye(6)
    found = spark.range(1).select(quality._inverse(F.array(*[F.lit(float(x)) for x in a.ravel()]), 6)).first()[0]
    assert np.allclose(np.array(found).reshape(6, 6), np.linalg.inv(a))


def test_languages(spark, sf, odd, none):
    frame = common.table(spark, sf, "documents")
    found = language.identify(frame).join(frame.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.95 and all(0 <= r.score <= 1 for r in found)
    rows = {r.doc_id: r for r in language.identify(odd).collect()}
    assert rows[2].lang_pred == rows[4].lang_pred == "und" and rows[5].lang_pred in ("en", "fr") and len(rows) == len({r[0] for r in TEXTS})
    assert language.identify(none).count() == 0
    alone = language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in alone} == {"und"}


def test_mixture_of_two(spark):
    rows = [(i, t * 40, lang) for i, (t, lang) in enumerate([("the quick onward thing ", "en"), ("der schnelle durch zug ", "de")] * 4)]
    names, model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = spark.createDataFrame([(1, rows[0][1] + rows[1][1])], "doc_id long, text string")
    assert {x.lang for x in language.predict(mixed, names, model).first().languages} == {"en", "de"}


# ---- pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs, seen = common.table(spark, sf, "documents"), []
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        seen.append((docs, common.stored(out, "stage")))
        docs = seen[-1][1]
    rated = {r.doc_id for r in quality.rate(seen[0][0]).where("kept").collect()}
    assert {r.doc_id for r in seen[0][1].collect()} == rated
    want = groups({r.doc_id: shingles(r.text, 5) for r in seen[1][0].collect()}, 80)
    assert sorted(r.doc_id for r in seen[1][1].collect()) == sorted(i for i, g in want.items() if i == g)
    assert not repeats([(r.doc_id, r.text) for r in seen[2][1].collect()], 50)
    before = {r.doc_id: r.text for r in seen[2][1].collect()}
    words = collections.Counter()
    for r in seen[3][1].collect():
        assert before[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        words[r.doc_id] += len(WORD.findall(r.text))
    assert words == {r.doc_id: r.taken for r in mixing.mix(seen[3][0]).where("taken > 0").collect()}
    assert p.run(spark, sf).count() == docs.count()


def test_pipeline_awkward(spark, odd, none):
    import corpus_pipeline as p

    clash = {x: x for x in ("size", "words", "taken", "position", "component", "pool", "_key", "_row", "_id", "_spans", "_name")}
    for frame in (odd, none):
        for _, stage in p.STAGES:
            docs = frame.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(x).alias(x) for x in clash])
            out = stage(spark, docs, "")
            assert out.count() <= 2 * len(TEXTS)
            if stage != p.token_ids:
                assert out.columns == docs.columns and all({**r.asDict(), **clash} == r.asDict() for r in out.collect())


def test_pipeline_repeated_ids(spark):
    import corpus_pipeline as p

    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    rows = [(4, a, "en"), (4, b, "en"), (4, b, "fr"), (3, b + " more", "en"), (5, a, "en"), (6, c, "en"), (None, c, "en"), (None, c, "en")]
    docs = spark.createDataFrame([(*r, "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars int")
    one = lambda: sorted((r.doc_id or 0, r.text, r.lang) for r in p.one_of_each(spark, docs.repartition(4), "").collect())
    assert one() == sorted([(4, a, "en"), (3, b + " more", "en"), (6, c, "en"), (0, c, "en"), (0, c, "en")]) == one()
    # two equal rows are read as two documents: taken words stay at the target
    twice = docs.where("doc_id is null")
    assert sum(len(WORD.findall(r.text)) for r in p.training_mix(spark, twice, "").collect()) == 300
