"""Out-of-bag intervals and the exact monotone audit against brute force."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasontide.operators import intervals as I
from seasontide.operators import models as M
from seasontide.plans import adapters as A
from seasontide.plans import catalog  # noqa: F401
from seasontide.plans.registry import QUERIES


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    made = []
    for i in range(400):
        a, b = float(rng.uniform(0, 10)), float(rng.normal())
        made.append((i, int(i % 3), a if i % 50 else None, b, math.sin(a) * 4 + b + float(rng.normal() * 0.1)))
    made.append((999, 0, 1.0, 1.0, None))
    return spark.createDataFrame(made, "id int, stage_id int, a double, b double, y double").repartition(4).orderBy("id")


def brute_bag(key, tree):
    share = int(hashlib.md5(f"{key}|{tree}".encode()).hexdigest()[:8], 16) / 2**32
    total, term, k = 0.0, math.exp(-1), 0
    while share >= total + term and k < 20:
        total += term
        k += 1
        term /= k
    return k


def test_bag_counts(rows):
    for tree in (0, 7):
        for r in rows.select("id", I.bag_count(["id"], tree).alias("n")).collect():
            assert r.n == brute_bag(r.id, tree)
    mean = rows.select([I.bag_count(["id"], t).alias(f"n{t}") for t in range(20)]).agg(*[F.avg(f"n{t}") for t in range(20)]).first()
    assert abs(np.mean(mean) - 1) < 0.05


def test_out_of_bag_rows_never_calibrate_themselves(rows):
    model = I.fit_bagged(rows, ["a", "b"], "y", ["id"], trees=6, params={"maxDepth": 4})
    single = [I.BaggedTrees((t,), model.features, model.keys) for t in model.trees]
    votes = [{r.id: r.pred for r in one.predict(rows).collect()} for one in single]
    for r in model.out_of_bag(rows).collect():
        free = [t for t in range(6) if brute_bag(r.id, t) == 0]
        assert r.oob_trees == len(free)
        if not free or r.a is None:
            assert r.oob is None
        else:
            assert r.oob == pytest.approx(np.mean([votes[t][r.id] for t in free]))
    errors = [abs(r.oob - r.y) for r in model.out_of_bag(rows).collect() if r.oob is not None and r.y is not None]
    out = I.bagged_interval(model, rows, rows, "y", 0.2).where("pred is not null").first()
    assert (out.pred_upper - out.pred_lower) / 2 == pytest.approx(np.quantile(errors, 0.8))


def test_width_by_group(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", -3.0), ("a", None), ("b", 0.5)], "g string, error double")
    assert {r.g: (r.width, r.n_errors) for r in I.interval_width(frame, 0.5, ["g"]).collect()} == {"a": (2.0, 2), "b": (0.5, 1)}
    assert I.interval_width(frame.where("false"), 0.5).first().width is None


def walk(text, x):
    """Prediction of one tree's printed form."""
    lines = [(len(s) - len(s.lstrip()), s.strip()) for s in text.splitlines() if s.strip()]
    at = 0
    while at < len(lines):
        depth, line = lines[at]
        if line.startswith("Predict"):
            return float(line.split(":")[1])
        feature, value = re.search(r"feature (\d+) <= ([-+.\dE]+)", line).groups()
        if x[int(feature)] <= float(value):
            at += 1
        else:
            at = next(i for i in range(at + 1, len(lines)) if lines[i][0] == depth and lines[i][1].startswith("Else")) + 1


def test_audit_sees_every_step(rows):
    known = rows.where("a is not null and y is not null and id < 40")
    model = M.fit_gbt(known, ["a", "b"], "y", {"maxIter": 3, "maxDepth": 3, "minInstancesPerNode": 1})
    stage = model.stages[-1]
    values = I.thresholds(model, 0)
    assert len(values) > 3
    trees = [t.toDebugString.split("\n", 1)[1] for t in stage.trees]
    predict = lambda x: sum(w * walk(t, x) for w, t in zip(stage.treeWeights, trees))
    fine = sorted({*np.linspace(-1, 11, 50).tolist(), *values})
    want = {}
    for r in known.collect():
        line = [predict((v, r.b)) for v in fine]
        rises = sum(q > p + 1e-9 for p, q in zip(line, line[1:]))
        n, total, hit = want.get(r.stage_id, (0, 0, 0))
        want[r.stage_id] = (n + 1, total + rises, hit + (rises > 0))
    found = {r.stage_id: (r.n_rows, r.n_violations, r.n_rows_violating) for r in M.monotone_audit(model, known, "a", ["a", "b"]).collect()}
    assert found == want and sum(v[1] for v in want.values()) > 0
    flat = M.monotone_audit(model, known, "a", ["a", "b"], grid=[1.0]).collect()
    assert all(r.n_violations == 0 and r.n_values == 1 for r in flat)


def test_every_season_is_predicted_from_all_others(spark, sf):
    rng = np.random.default_rng(8)
    made = [(int(i % 4), float(i), None if i % 9 == 0 else float(rng.normal() * (1 + i % 4))) for i in range(200)]
    rows = spark.createDataFrame([*made, (None, 1.0, 99.0)], "season long, pred double, error double").repartition(3)
    got = {(r.season, r.pred): r for r in M.cross_conformal_interval(rows, "season", 0.2).collect()}
    assert len(got) == 201 and got[(None, 1.0)].pred_lower is None
    for season in range(4):
        width = np.quantile([abs(e) for s, _, e in made if s != season and e is not None], 0.8)
        for r in (r for (s, _), r in got.items() if s == season):
            assert (r.pred_lower, r.pred_upper) == (pytest.approx(r.pred - width), pytest.approx(r.pred + width))
    one = M.cross_conformal_interval(rows.where("season = 1"), "season", 0.2).first()
    assert one.pred is not None and one.pred_lower is None
    assert QUERIES["conformal_interval"].run(spark, sf).count() == A.trajectory(spark, sf).count()
