import math
import random

import numpy as np
from pyspark.sql import functions as F

from clauselake.operators import calibrate


def plain_sigmoid(x, hit):
    """The same targets fitted by many plain Newton steps in one process."""
    n, m = hit.sum(), (~hit).sum()
    t = np.where(hit, (n + 1) / (n + 2), 1 / (m + 2))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w, e = p * (1 - p), p - t
        move = np.linalg.solve([[np.sum(w * x * x), np.sum(w * x)], [np.sum(w * x), np.sum(w)]], [np.sum(e * x), np.sum(e)])
        a, b = a - move[0], b - move[1]
    return a, b


def test_sigmoids_against_plain(spark):
    r = np.random.default_rng(7)
    rows, want = [], {}
    for k, (slope, offset) in enumerate([(0.5, 0.3), (2.0, -1.0), (1.0, 0.0)]):
        x = r.normal(0, 2, 300)
        hit = r.random(300) < 1 / (1 + np.exp(-(slope * x + offset)))
        rows += [(k, float(v), bool(h)) for v, h in zip(x, hit)]
        want[k] = plain_sigmoid(x, hit)
    got = calibrate.fit_sigmoids(spark.createDataFrame(rows, "class int, x double, hit boolean"))
    for k in want:
        assert np.allclose(got[k], want[k], atol=1e-6), (k, got[k], want[k])
    assert calibrate.fit_sigmoids(spark.createDataFrame([], "class int, x double, hit boolean")) == {}
    alike = calibrate.fit_sigmoids(spark.createDataFrame([(0, 1.0, True), (0, 1.0, False)], "class int, x double, hit boolean"))
    assert math.isfinite(sum(alike[0]))


def test_macro_f1(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, said int")
    want = (2 / 3 + 2 * 1 / (2 + 2) + 0.0) / 3
    assert abs(calibrate.macro_f1(df).first()[0] - want) < 1e-12


def test_calibration_lowers_the_error(spark):
    """Classes that overlap, and weights that make a weak penalty too sure of itself."""
    r = random.Random(3)
    rows = []
    for i in range(240):
        y = r.randrange(3)
        rows.append((i, y if r.random() > 0.25 else r.randrange(3), [r.gauss(1.0 * (y == d), 0.8) for d in range(3)] + [r.gauss(0, 1) for _ in range(12)]))
    df = spark.createDataFrame([*rows, (900, None, rows[0][2]), (901, 1, None)], "id long, y int, embedding array<double>")
    found = calibrate.cross_validated(df, "id", "y", strengths=(0.01, 100.0), folds=3, jobs=2)
    assert found.held.count() == 240 and found.scores.count() == 2
    out = {x["stage"]: x for x in calibrate.report(found).collect()}
    assert out["after"]["ece"] < out["before"]["ece"]
    sums = found.held.select(F.aggregate(calibrate.calibrated(F.col("probability"), found.sigmoids), F.lit(0.0), lambda a, x: a + x)).collect()
    assert all(abs(s[0] - 1) < 1e-9 for s in sums)
    # the same choice from the same scores, plainly
    held = [(x["fold"], x["label"], x["said"]) for x in found.held.collect()]
    per = []
    for f in {h[0] for h in held}:
        own = [h[1:] for h in held if h[0] == f]
        kinds = {k for h in own for k in h}
        per.append(np.mean([2 * sum(a == b == k for a, b in own) / (sum(a == k for a, _ in own) + sum(b == k for _, b in own)) for k in kinds]))
    assert abs(np.mean(per) - out["after"]["macro_f1"]) < 1e-9
