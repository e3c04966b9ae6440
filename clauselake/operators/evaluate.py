"""Evaluation of extractions, retrieval, calibration and detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_predictions(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Each truth row with its last prediction (by ord), as columns p_*; p_found tells whether one succeeded. A
    prediction without an id goes by its chunk_id, where there is that column."""
    if "chunk_id" in predicted.columns:
        predicted = predicted.withColumn("id", F.coalesce("id", "chunk_id")).drop("chunk_id")
    last = predicted.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("ord")))).where("__n = 1")
    cols = [c for c in predicted.columns if c not in ("id", "ord", "failed")]
    p = last.select("id", (~F.col("failed")).alias("p_found"), *[F.col(c).alias(f"p_{c}") for c in cols])
    return truth.join(p, "id", "left").withColumn("p_found", F.coalesce("p_found", F.lit(False)))


def confusion(joined: DataFrame, bools: list[str], categories: list[str]) -> DataFrame:
    """A15-A17, long form: field, tp, fp, fn, tn, total. A null prediction counts as false; a missing one as a miss
    where the truth is true (for categories: where there is one), else as a true negative. Of categories, rows
    without truth are skipped where there is a prediction, and a wrong value is both a false hit and a miss."""
    parts = []
    for f in bools + categories:
        t, p = F.col(f), F.col(f"p_{f}")
        if f in bools:
            t, p = F.coalesce(t, F.lit(False)), F.coalesce(p, F.lit(False))
            hit, fp, fn, tn = t & p, ~t & p, t & ~p, ~t & ~p
            counted, truthy = F.lit(True), t
        else:
            same = t.eqNullSafe(p)
            hit, fp, fn, tn = same, ~same, ~same, F.lit(False)
            counted, truthy = t.isNotNull(), t.isNotNull() & (t != "")
        got = F.col("p_found")
        one = lambda c, m: F.sum(F.when(got & counted & c, 1).when(~got & m, 1).otherwise(0))
        no = F.lit(False)
        parts.append(joined.agg(F.lit(f).alias("field"), one(hit, no).alias("tp"), one(fp, no).alias("fp"), one(fn, truthy).alias("fn"), one(tn, ~truthy).alias("tn"), F.sum(F.when(~got | counted, 1).otherwise(0)).alias("total")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def ratio(a: Column, b: Column, digits: int = 3) -> Column:
    return F.coalesce(F.bround(F.try_divide(a.cast("double"), b), digits), F.lit(0.0))


def field_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy, 0 on empty denominators."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, F.col("total"))})


def in_order(metrics: DataFrame, name: str = "field") -> DataFrame:
    """Metrics with `place`, by the name of what they are for. They are a row for each field or category, which are few,
    so that one task orders them."""
    return metrics.withColumn("place", F.row_number().over(Window.orderBy(name)))


def macro_f1(metrics: DataFrame) -> DataFrame:
    """The mean F1 of fields that were counted, and whether it reaches 0.75."""
    m = metrics.where("total > 0").agg(F.bround(F.coalesce(F.avg("f1"), F.lit(0.0)), 3).alias("macro_f1"), F.count(F.lit(1)).alias("n_fields"))
    return m.withColumn("passed", F.col("macro_f1") >= 0.75)


def grounding(quote: Column, clause: Column) -> Column:
    """1 for no quote or one that the clause has (any case), 0.8 if it has the quote's first 50 characters."""
    q, c = F.lower(F.trim(quote)), F.lower(clause)
    return F.when(quote.isNull(), 1.0).when(F.contains(c, q), 1.0).when((F.length(q) > 50) & F.contains(c, F.left(q, F.lit(50))), 0.8).otherwise(0.0)


def relevance(hits: DataFrame) -> DataFrame:
    """1.0 of the wanted type and extracted, 0.7 if only of the type, 0.3 if only extracted, else 0."""
    same, got = F.col("clause_type") == F.col("wanted"), F.coalesce("extracted", F.lit(False))
    return hits.withColumn("rel", F.when(same & got, 1.0).when(same, 0.7).when(got, 0.3).otherwise(0.0))


def ranking(hits: DataFrame) -> DataFrame:
    """A23-A25, W2, per query: reciprocal of the first rank with relevance from 0.7, DCG over the ideal order of what
    was retrieved, type matches at 1 and at 5."""
    ideal = Window.partitionBy("query_id").orderBy(F.desc("rel"), "rank")
    r = hits.where("rank <= 5").withColumn("best", F.row_number().over(ideal))
    same = F.col("clause_type") == F.col("wanted")
    out = r.groupBy("query_id").agg(
        F.coalesce(F.try_divide(F.lit(1.0), F.min(F.when(F.col("rel") >= 0.7, F.col("rank")))), F.lit(0.0)).alias("rr"),
        F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.sum(F.col("rel") / F.log2(F.col("best") + 1)).alias("idcg"),
        F.max(F.when(F.col("rank") == 1, same).otherwise(False)).alias("match_at_1"),
        F.bool_or(same).alias("match_at_5"),
        F.max("latency").alias("latency"),
    )
    return out.select("query_id", F.round("rr", 6).alias("rr"), F.round(F.coalesce(F.try_divide("dcg", "idcg"), F.lit(0.0)), 6).alias("ndcg"), "match_at_1", "match_at_5", "latency")


def ece(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Per bin (lo, hi] of confidence: n, mean confidence, accuracy, weighted gap; empty bins have zeros. A
    confidence of 0 falls into no bin. scored: confidence, correct."""
    spark = scored.sparkSession
    edges = spark.range(bins).select(F.col("id").alias("bin"), (F.col("id") / bins).alias("lo"), ((F.col("id") + 1) / bins).alias("hi"))
    b = F.ceil(F.round(F.col("confidence") * bins, 9)) - 1
    got = scored.where("confidence > 0").groupBy(b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("conf"), F.avg(F.col("correct").cast("double")).alias("acc"))
    total = scored.agg(F.count(F.lit(1)).alias("total"))
    j = edges.join(got, "bin", "left").join(F.broadcast(total), F.lit(True))
    n = F.coalesce("n", F.lit(0))
    return j.select("bin", "lo", "hi", n.alias("n"), F.round(F.coalesce("conf", F.lit(0.0)), 6).alias("conf"), F.round(F.coalesce("acc", F.lit(0.0)), 6).alias("acc"), F.round(F.coalesce(F.abs(F.col("acc") - F.col("conf")) * n / F.col("total"), F.lit(0.0)), 6).alias("gap"))


def detection_recall(found: DataFrame, expected: DataFrame) -> DataFrame:
    """A27, A28 by config: distinct expected (clause, category) pairs that were found, and High, Medium and Low counts."""
    f = found.select("config", "clause", "category").distinct()
    hit = f.join(expected.distinct(), ["clause", "category"], "left_semi").groupBy("config").agg(F.count(F.lit(1)).alias("hit"))
    n = expected.distinct().agg(F.count(F.lit(1)).alias("n_expected"))
    sev = found.groupBy("config").agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in ("High", "Medium", "Low")], F.count(F.lit(1)).alias("n_risks"))
    j = sev.join(hit, "config", "left").join(F.broadcast(n), F.lit(True))
    return j.select("config", "n_risks", "n_high", "n_medium", "n_low", F.coalesce(F.round(F.col("hit") / F.col("n_expected"), 6), F.lit(0.0)).alias("recall"))


def marginal(summary: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """What the second config of each pair adds to the first: risks, percent (infinite where the first has none),
    recall in percentage points. A config that found nothing is in no summary and counts as zero."""
    spark = summary.sparkSession
    p = spark.createDataFrame(pairs, "base string, enhanced string")
    a, b = (summary.select(F.col("config").alias(k), F.col("n_risks").alias(f"{k}_n"), F.col("recall").alias(f"{k}_r")) for k in ("base", "enhanced"))
    j = p.join(a, "base", "left").join(b, "enhanced", "left").na.fill(0)
    delta = F.col("enhanced_n") - F.col("base_n")
    pct = F.when(F.col("base_n") > 0, F.bround(F.try_divide(100.0 * delta, "base_n"), 1)).when(delta > 0, float("inf")).otherwise(0.0)
    return j.select("base", "enhanced", delta.alias("delta"), pct.alias("delta_pct"), F.bround(100 * (F.col("enhanced_r") - F.col("base_r")), 1).alias("recall_pp"))


def best_config(summary: DataFrame, order: list[str]) -> DataFrame:
    """The config of highest recall, the first of `order` where several have it."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col("config"))
    return summary.where(at > 0).orderBy(F.desc("recall"), at).limit(1).select("config", "recall")


def category_breakdown(found: DataFrame, categories: tuple[str, ...], severities: tuple[str, ...] = ("High", "Medium", "Low")) -> DataFrame:
    """A28 by config: how many finds each severity and category has, zero where it has none, in long form."""
    kinds = F.array(*[F.struct(F.lit("severity").alias("kind"), F.lit(s).alias("value")) for s in severities], *[F.struct(F.lit("category").alias("kind"), F.lit(c).alias("value")) for c in categories])
    every = found.select("config").distinct().withColumn("k", F.explode(kinds)).select("config", "k.kind", "k.value")
    long = found.select("config", F.explode(F.array(F.struct(F.lit("severity").alias("kind"), F.col("severity").alias("value")), F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")))).alias("k"))
    n = long.select("config", "k.kind", "k.value").groupBy("config", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, ["config", "kind", "value"], "left").na.fill(0, ["n"])


def eval_summary(joined: DataFrame, metrics: DataFrame, core: list[str], grounding_col: str | None = None) -> DataFrame:
    """Macro F1 over the counted core fields and over all, the share of examples with a prediction, the average
    grounding, and whether the core reaches 0.75."""
    counted = metrics.where("total > 0")
    mean = lambda c: F.bround(F.coalesce(F.avg(F.when(c, F.col("f1"))), F.lit(0.0)), 3)
    f1 = counted.agg(mean(F.col("field").isin(*core)).alias("macro_f1_core"), mean(F.lit(True)).alias("macro_f1_all"))
    g = F.avg(grounding_col) if grounding_col else F.lit(None).cast("double")
    rate = joined.agg(F.bround(F.avg(F.col("p_found").cast("double")), 3).alias("success_rate"), F.bround(g, 3).alias("avg_grounding"))
    return f1.join(F.broadcast(rate), F.lit(True)).withColumn("passed", F.col("macro_f1_core") >= 0.75)


def path_compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per clause how many categories both sides have, only the left, only the right."""
    a = left.select("clause", "category").distinct().withColumn("l", F.lit(1))
    b = right.select("clause", "category").distinct().withColumn("r", F.lit(1))
    j = a.join(b, ["clause", "category"], "full_outer")
    return j.groupBy("clause").agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"))


def example_f1(long: DataFrame, *keys: str) -> DataFrame:
    """Precision, recall and F1 over the flattened booleans of each example; a missing prediction of a false
    field counts nothing. long: keys, id, field, truth, pred."""
    t, p = F.coalesce("truth", F.lit(False)), F.col("pred")
    tp, fp, fn = F.count_if(t & F.coalesce(p, F.lit(False))), F.count_if(~t & F.coalesce(p, F.lit(False))), F.count_if(t & ~F.coalesce(p, F.lit(False)))
    g = long.groupBy(*keys, "id").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return g.select(*keys, "id", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def model_comparison(long: DataFrame, keys: tuple[str, ...] = ("backend", "clause_type")) -> DataFrame:
    """M9: how many examples each back end has of each type, and its mean precision, recall and F1 over them."""
    each = example_f1(long, *keys)
    return each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")])


def classifier_decision(probs: DataFrame, gate: float = 0.55) -> DataFrame:
    """M3, F7 given probabilities (p_high, p_low, p_medium, p_none): detected when 1 - p_none reaches the gate; the
    severity is the likeliest of the others, the first of equals in the order High, Low, Medium."""
    risk = F.round(1 - F.col("p_none"), 6)
    most = F.greatest("p_high", "p_low", "p_medium")
    return probs.select("id", F.bround(risk, 3).alias("risk_probability"), (risk >= gate).alias("detected"), F.when(risk >= gate, F.when(F.col("p_high") == most, "High").when(F.col("p_low") == most, "Low").otherwise("Medium")).alias("severity"), F.when(risk >= gate, F.bround(most, 3)).alias("confidence"))
