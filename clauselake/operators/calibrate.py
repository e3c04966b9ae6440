"""Choice of a classifier by cross-validation, and calibration of its probabilities (M4).

Scores of rows that a model has not seen are kept for every fold, so that the choice and the calibration rest on the same
out-of-fold scores. The sigmoids of all classes are fitted together by Newton steps, each of which is one aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.operators import evaluate
from clauselake.session import materialize

#: Probabilities are kept this far from 0 and 1 where their log-odds are taken.
EDGE = 1e-9
#: Newton steps at most, and the change below which they end.
STEPS, ENOUGH = 60, 1e-10


@dataclass
class Calibrated:
    """model: fitted on all rows with the chosen strength; scores: a row for each strength with its macro-F1; held: the
    out-of-fold rows of the chosen one; sigmoids: slope and offset by class."""

    model: object
    strength: float
    scores: DataFrame
    held: DataFrame
    sigmoids: dict[int, tuple[float, float]]


def folded(rows: DataFrame, key: str, folds: int, seed: int = 42) -> DataFrame:
    """`rows` with `fold`, by a hash of the key: rows of a key stay together and every run agrees."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int"))


def macro_f1(predicted: DataFrame, *by: str) -> DataFrame:
    """The mean over classes of F1, for each group of `by`; classes that are neither there nor predicted do not count.
    predicted: label, said."""
    classes = predicted.select(*by, "label", "said", F.explode(F.array_distinct(F.array("label", "said"))).alias("class"))
    hit = lambda is_so, said_so: F.count_if(((F.col("label") == F.col("class")) == is_so) & ((F.col("said") == F.col("class")) == said_so))
    counts = classes.groupBy(*by, "class").agg(hit(True, True).alias("tp"), hit(False, True).alias("fp"), hit(True, False).alias("fn"))
    return counts.groupBy(*by).agg(F.avg(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("macro_f1"))


def log_odds(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.ln(q / (1 - q))


def fit_sigmoids(scored: DataFrame) -> dict[int, tuple[float, float]]:
    """Slope a and offset b of 1 / (1 + exp(-(a x + b))) for each class, which maximise the likelihood of the smoothed
    targets (n + 1) / (n + 2) of hits and 1 / (m + 2) of others. scored: class, x, hit.

    Each Newton step is one pre-aggregated pass for all classes: six sums a class come to the driver. A step that would
    lower the likelihood is halved, for which it is tried anew. A class whose scores are all alike gets an offset only.
    """
    n = scored.groupBy("class").agg(F.count_if("hit").alias("n"), F.count_if(~F.col("hit")).alias("m"))
    data = materialize(scored.join(n, "class").select("class", "x", F.when(F.col("hit"), (F.col("n") + 1) / (F.col("n") + 2)).otherwise(1 / (F.col("m") + 2)).alias("t")), "sigmoid-scores")
    theta: dict[int, np.ndarray] = {r["class"]: np.array([1.0, 0.0]) for r in n.collect()}
    if not theta:
        return {}

    def sums(at: dict[int, np.ndarray]) -> dict[int, dict]:
        of = lambda i: F.create_map(*[F.lit(v) for k, th in at.items() for v in (k, float(th[i]))])[F.col("class")]
        z = F.col("a") * F.col("x") + F.col("b")
        p = 1 / (1 + F.exp(-z))
        loss = F.greatest(z, F.lit(0.0)) - z * F.col("t") + F.log1p(F.exp(-F.abs(z)))
        x, w, e = F.col("x"), p * (1 - p), p - F.col("t")
        terms = {"loss": loss, "gb": e, "ga": e * x, "bb": w, "ab": w * x, "aa": w * x * x}
        out = data.withColumns({"a": of(0), "b": of(1)}).groupBy("class").agg(*[F.sum(v).alias(k) for k, v in terms.items()])
        return {r["class"]: r.asDict() for r in out.collect()}

    now, open_, step = sums(theta), set(theta), dict.fromkeys(theta, 1.0)
    for _ in range(STEPS):
        tried = {}
        for k in open_:
            s = now[k]
            hessian = np.array([[s["aa"], s["ab"]], [s["ab"], s["bb"]]]) + np.eye(2) * 1e-12
            move = np.linalg.lstsq(hessian, np.array([s["ga"], s["gb"]]), rcond=1e-12)[0]
            tried[k] = theta[k] - step[k] * move
        then = sums(theta | tried)
        for k in list(open_):
            if then[k]["loss"] <= now[k]["loss"] + 1e-12:
                if np.abs(tried[k] - theta[k]).max() < ENOUGH:
                    open_.discard(k)
                theta[k], now[k], step[k] = tried[k], then[k], 1.0
            else:
                step[k] /= 2
                if step[k] < 1e-6:
                    open_.discard(k)
        if not open_:
            break
    return {k: (float(v[0]), float(v[1])) for k, v in theta.items()}


def calibrated(probability: Column, sigmoids: dict[int, tuple[float, float]]) -> Column:
    """An array of probabilities by class, each through its sigmoid, to the sum of 1."""
    slopes, offsets = (F.array(*[F.lit(sigmoids.get(k, (1.0, 0.0))[i]) for k in range(max(sigmoids, default=0) + 1)]) for i in (0, 1))
    raw = F.transform(probability, lambda p, i: 1 / (1 + F.exp(-(F.coalesce(F.get(slopes, i), F.lit(1.0)) * log_odds(p) + F.coalesce(F.get(offsets, i), F.lit(0.0))))))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / total)


def cross_validated(rows: DataFrame, key: str, label: str, strengths: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0, 100.0), folds: int = 5, seed: int = 42, jobs: int = 4) -> Calibrated:
    """M4: a logistic model on `embedding`, classes weighing alike. Of `strengths`, inverse weights of the penalty, the one
    with the best macro-F1 of the held-out folds is taken, the mean over folds counting, of equal ones the first.

    Rows without a label or embedding are left out. Labels are whole numbers from 0. A class that a training fold lacks is
    not predicted there. Fits run `jobs` at a time, each distributed; rows of a key stay in one fold.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = rows.where(F.col(label).isNotNull() & F.col("embedding").isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), "embedding")
    data = materialize(folded(data, "key", folds, seed), "calibrate-rows")
    total, kinds = data.agg(F.count(F.lit(1)), F.count_distinct("label")).first()
    if not total:
        raise ValueError("no labelled rows")

    def fit(train: DataFrame, strength: float):
        n = train.groupBy("label").agg(F.count(F.lit(1)).alias("k"))
        weighed = train.join(F.broadcast(n), "label").withColumn("weight", F.lit(float(total)) / (F.col("k") * kinds))  # a row for each class
        ready = weighed.select(array_to_vector("embedding").alias("features"), F.col("label").cast("double").alias("label"), "weight")
        return LogisticRegression(weightCol="weight", maxIter=50, regParam=1.0 / (strength * total), family="multinomial").fit(ready)

    def held_out(task: tuple[float, int]) -> DataFrame:
        strength, fold = task
        model = fit(data.where(F.col("fold") != fold), strength)
        out = model.transform(data.where(F.col("fold") == fold).withColumn("features", array_to_vector("embedding")))
        return out.select("key", "label", "fold", F.lit(strength).alias("strength"), vector_to_array("probability").alias("probability"), F.col("prediction").cast("int").alias("said"))

    with ThreadPool(jobs) as pool:
        parts = pool.map(held_out, [(c, f) for c in strengths for f in range(folds)])
    held = parts[0]
    for p in parts[1:]:
        held = held.unionByName(p)
    held = materialize(held, "calibrate-held")
    scores = materialize(macro_f1(held, "strength", "fold").groupBy("strength").agg(F.avg("macro_f1").alias("macro_f1")), "calibrate-scores")
    mean = {r["strength"]: r["macro_f1"] for r in scores.collect()}  # a row for each strength
    best = max(strengths, key=lambda c: (round(mean.get(c, 0.0), 9), -strengths.index(c)))
    chosen = held.where(F.col("strength") == best)
    by_class = chosen.select("label", F.posexplode("probability").alias("class", "p")).select("class", log_odds(F.col("p")).alias("x"), (F.col("label") == F.col("class")).alias("hit"))
    return Calibrated(fit(data, best), best, scores, chosen, fit_sigmoids(by_class))


def reliability(held: DataFrame, probability: Column) -> DataFrame:
    """A26's bins of out-of-fold rows by the given probabilities."""
    p = held.select("label", probability.alias("p"))
    top = F.array_max("p")
    return evaluate.ece(p.select(top.alias("confidence"), (F.array_position("p", top) - 1 == F.col("label")).alias("correct")))


def report(found: Calibrated) -> DataFrame:
    """stage, ece, strength, macro_f1: the expected calibration error before and after, of the chosen strength."""
    out = None
    score = found.scores.where(F.col("strength") == found.strength).select("strength", "macro_f1")
    for stage, p in (("before", F.col("probability")), ("after", calibrated(F.col("probability"), found.sigmoids))):
        e = reliability(found.held, p).agg(F.round(F.sum("gap"), 6).alias("ece")).select(F.lit(stage).alias("stage"), "ece")
        part = e.join(F.broadcast(score), F.lit(True))  # one row each
        out = part if out is None else out.unionByName(part)
    return out
