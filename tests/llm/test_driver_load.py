"""Few stages per search for near duplicates: each one costs memory of the driver, whatever the rows."""

from collections import Counter

import pytest

import corpus_pipeline
from seasontide.llm import components, forest


@pytest.fixture
def plans(monkeypatch):
    """(name, plan) of every table that the operators store, as planned before it runs."""
    seen = []

    def watch(module):
        inner = module.stored

        def stored(df, name):
            seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
            return inner(df, name)

        monkeypatch.setattr(module, "stored", stored)

    for module in (components, forest, corpus_pipeline):
        watch(module)
    return seen


def test_stars_take_no_round(spark, plans):
    links = [(1, b) for b in range(2, 9)] + [(20, 21), (21, 20), (30, 30), (None, 4)]
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert dict(found) == {**{i: 1 for i in range(1, 9)}, 20: 20, 21: 20}
    assert len(plans) == 1


def test_two_ends_are_no_star(spark, plans):
    # a smaller end that is a larger one too, and a larger end with two links
    links = [(1, 2), (2, 3), (5, 7), (6, 7)]
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert dict(found) == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5}
    assert len(plans) > 1


def test_regions_of_adaptive_depth(spark, plans):
    part = lambda *hashes: b"".join(h.to_bytes(4, "big") for h in hashes)
    keys = [part(1, 1, 1, i, i, i) for i in range(forest.REGION)]  # not crowded
    keys += [part(2, 2, 2, i % 2, i, i) for i in range(2 * forest.REGION)]  # split at the fourth hash
    keys += [part(3, 3, 3, 3, 3, 3)] * 100 + [part(3, 3, 3, 3, 3, 4)] * 2  # split to the end
    rows = [(t, k, i) for t in (0, 5) for i, k in enumerate(keys)]
    found = forest._regions(spark.createDataFrame(rows, "tree int, key binary, id long")).collect()
    assert len(found) == len(rows) and Counter((r.tree, bytes(r.key), r.id) for r in found) == Counter(rows)
    sizes = {(r.tree, bytes(r.region)): r["size"] for r in found}
    want = {part(1, 1, 1): 64, part(2, 2, 2, 0): 64, part(2, 2, 2, 1): 64, part(3, 3, 3, 3, 3, 3): 100, part(3, 3, 3, 3, 3, 4): 2}
    assert sizes == {(t, k): n for t in (0, 5) for k, n in want.items()}
    for r in found:
        own = [k for k in keys if k.startswith(bytes(r.region))]
        assert bytes(r.key) in own and bytes(r.modal) == max(Counter(own).items(), key=lambda x: (x[1], x[0]))[0]
    # one exchange for the counts; two for the sums, one for the rows that meet them
    assert [(n, p.count("Exchange")) for n, p in plans if n == "crowded"] == [("crowded", 1)]
    assert [p.count("Exchange hashpartitioning") for n, p in plans if n == "regions"][0] <= 4


def test_no_text_is_moved_to_name_documents(spark, sf, plans):
    corpus_pipeline.one_of_each(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    sketches = [p for n, p in plans if n == "sketches"]
    assert len(sketches) == 1 and "Exchange hashpartitioning" not in sketches[0] and "BroadcastExchange" in sketches[0]
