"""Encoders, training data and classifiers."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauselake.functions.batches import sliced
from clauselake.operators import calibrate
from clauselake.session import materialize, ship, sized


def hashing_encoder(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Signed hashed words, scaled to length 1: an encoder that needs no model. Its numbers are its own."""

    def encode(texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), dims), np.float32)
        for row, t in zip(out, texts, strict=True):
            for w in (t or "").lower().split():
                h = xxhash.xxh3_64_intdigest(w)
                row[h % dims] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def _vectors(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    x = np.ascontiguousarray(x, np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def embed(rows: DataFrame, encoder: Callable[[list[str]], np.ndarray], text_col: str = "text") -> DataFrame:
    """M2, ST7: `rows` with `embedding`; the encoder sees batches of texts in the workers. A null text is empty.
    Texts leave Arrow in slices of a batch."""
    ship(rows.sparkSession)

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            parts = [_vectors(encoder([t or "" for t in b.slice(begin, end - begin).to_pylist()])) for begin, end in sliced(b)]
            yield pa.concat_arrays(parts or [pa.array([], pa.list_(pa.float32()))])

    return rows.withColumn("embedding", run(text_col))


def backfill(table: DataFrame, encoder: Callable[[list[str]], np.ndarray], text_col: str = "text") -> DataFrame:
    """ST7: embeddings where there are none yet."""
    old = table.where(F.col("embedding").isNotNull())
    return old.unionByName(embed(table.where(F.col("embedding").isNull()).drop("embedding"), encoder, text_col).select(table.columns))


def split_by_hash(rows: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """`rows` with `held_out`, true for about `share` of the keys. The split is by a hash of the key, so that rows
    of a key stay together and every run agrees."""
    h = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) / 1e6
    return rows.withColumn("held_out", h < share)


def stratified_split(rows: DataFrame, key: str, label: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """The same, within each label by rank, so that every label gives its share."""
    w = Window.partitionBy(label).orderBy(F.xxhash64(key, F.lit(seed)), key)
    return rows.withColumn("held_out", F.percent_rank().over(w) >= 1 - share)


def generated_examples(spark, templates: list[tuple[str, str, str]], slots: dict[str, list[str]], copies: int = 3, seed: int = 42, negatives: list[str] = (), swaps: int = 0, both: list[tuple[list[tuple[str, str]], str]] = ()) -> DataFrame:
    """M6: labelled texts (category, severity, text, source) from templates (category, severity, text with {slot}s), each in
    `copies` versions whose slot values are chosen by hash; texts without a category, `swaps` of them once more with
    the names of the first slot exchanged; and texts with several labels, a row for each label and variant."""
    rows = [(i, c, s, t, "template" if c else "negative") for i, (c, s, t) in enumerate(templates)]
    rows += [(1_000_000 + i, None, None, t, "negative") for i, t in enumerate(negatives)]
    t = spark.createDataFrame(rows, "template long, category string, severity string, text string, source string")
    out = t.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("template") < 1_000_000, copies - 1).otherwise(0))))
    for i, (labels, body) in enumerate(both):
        extra = spark.createDataFrame([(2_000_000 + i, c, s, body, "multi") for c, s in labels], t.schema)
        out = out.unionByName(extra.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))))
    if swaps and slots:
        name = sorted(slots)[0]
        again = [(3_000_000 + k, None, None, negatives[k % len(negatives)].replace("{" + name + "}", "{__swap}"), "swapped") for k in range(swaps if negatives else 0)]
        out = out.unionByName(spark.createDataFrame(again, t.schema).withColumn("copy", F.lit(0)))
        slots = slots | {"__swap": slots[name][::-1]}
    for name, values in sorted(slots.items()):
        pick = F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("template", "copy", F.lit(name), F.lit(seed)), F.lit(len(values))) + 1).cast("int"))
        out = out.withColumn("text", F.replace("text", F.lit("{" + name + "}"), pick))
    return out


def dataset_stats(examples: DataFrame) -> DataFrame:
    """Examples by category and severity, and by source where they have one; those without a category are negatives."""
    return examples.groupBy(*(["source"] if "source" in examples.columns else []), F.coalesce("category", F.lit("none")).alias("category"), F.coalesce("severity", F.lit("none")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def load_bundle(path: str) -> dict | None:
    """A classifier's coefficients from a JSON file; None where there is none to read, so that rules take its place."""
    import json

    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) and found else None


def classify_clauses(rows: DataFrame, bundle: dict | None, keys: tuple[str, ...] = ("doc_id", "clause_idx"), gate: float = 0.55) -> DataFrame | None:
    """M3: what a softmax for each category says of `rows` (keys, embedding): keys, risk_type, severity, confidence and
    risk_probability where the latter, 1 less that of "None", reaches the gate. The severity is the likeliest of the
    others, the first of the category's classes where several are. Without a bundle there is no classifier: None.

    bundle: by category {"classes": names, "coef": a row of weights for each, "intercept": a number for each}.
    """
    if bundle is None:
        return None
    ship(rows.sparkSession)
    models = [(c, b["classes"], np.array(b["coef"], float), np.array(b["intercept"], float)) for c, b in bundle.items()]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out: list[list[dict]] = [[] for _ in range(len(b))]
            known = [i for i, v in enumerate(b) if v is not None]
            x = np.array([b.iloc[i] for i in known], float).reshape(len(known), -1)
            for name, classes, coef, intercept in models if known else []:
                z = x @ coef.T + intercept
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                none = classes.index("None")
                others = [k for k in range(len(classes)) if k != none]
                for i, row in zip(known, p, strict=True):
                    if round(1 - row[none], 6) >= gate:
                        best = max(others, key=lambda k: row[k])
                        out[i].append({"risk_type": name, "severity": classes[best], "confidence": round(float(row[best]), 3), "risk_probability": round(float(1 - row[none]), 3)})
            yield pd.Series(out)

    said = F.pandas_udf(run, "array<struct<risk_type:string,severity:string,confidence:double,risk_probability:double>>")
    return rows.select(*keys, F.explode(said("embedding")).alias("f")).select(*keys, "f.*")


def top_keywords(docs: DataFrame, stop: tuple[str, ...], most: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, rank, word, n of each document's commonest words of three letters a-z or more but for `stop`, those met
    first where they tie. A null text has none.

    Words are counted where the text is, so that no shuffle carries them. Only the words of ids that repeat, of which all
    rows count as one document, are brought together.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("low"))
    again = sized(rows.groupBy(F.col("id").alias("again")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("again"), "keyword-ids")
    repeat = None if again.isEmpty() else F.col("id").eqNullSafe(F.col("again"))
    once = rows if repeat is None else rows.join(again, repeat, "left_anti")
    kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))

    @F.arrow_udf("array<struct<word:string,n:bigint>>")
    def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find, left_out = re.compile("[a-z]{3,}").findall, set(stop)
        for b in batches:
            parts = [pa.array([], kind)]
            for begin, end in sliced(b):
                counts = (Counter(w for w in find(t or "") if w not in left_out) for t in b.slice(begin, end - begin).to_pylist())
                parts.append(pa.array([[{"word": w, "n": n} for w, n in c.most_common(most)] for c in counts], kind))
            yield pa.concat_arrays(parts)

    out = once.select("id", F.posexplode(best("low")).alias("place", "w")).select(F.col("id").alias(id_col), (F.col("place") + 1).alias("rank"), "w.word", "w.n")
    if repeat is None:
        return out
    w = rows.join(again, repeat, "left_semi").select("id", F.posexplode(F.regexp_extract_all("low", F.lit("[a-z]{3,}"), F.lit(0))).alias("pos", "word")).where(~F.col("word").isin(*stop))
    g = w.groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    ranked = g.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "first"))).where(F.col("rank") <= most)
    return out.union(ranked.select(F.col("id").alias(id_col), "rank", "word", "n"))


def tuning_pairs(clauses: DataFrame, instruction: str) -> DataFrame:
    """M7, M8: instruction, input and output of each clause that has a text and a record, and the same as one chat text."""
    rows = clauses.where(F.col("data").isNotNull() & F.col("clause").isNotNull()).select("clause_type", F.lit(instruction).alias("instruction"), F.col("clause").alias("input"), F.col("data").alias("output"))
    return rows.withColumn("chat", F.format_string("<|user|>\n%s\n\n%s\n<|assistant|>\n%s", "instruction", "input", "output"))


def train_classifier(rows: DataFrame, label: str, strengths: tuple[float, ...] = (0.1, 1.0, 10.0), folds: int = 3, seed: int = 42, key: str | None = None, jobs: int = 2):
    """M4: a logistic model on `embedding`, classes weighing alike. Of `strengths`, inverse weights of the penalty, the one
    with the best macro-F1 of the held-out folds is taken, the mean over folds counting, of equal ones the first.

    Rows without a label or embedding are left out. Folds are by a hash of `key`, of whole rows where there is none; rows
    are written once, and fits run `jobs` at a time. Returns a cross-validator's model: avgMetrics has a mean for each
    strength (NaN where one fold has all rows), bestModel is fitted on all rows; transform() gives probabilities.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.tuning import CrossValidatorModel

    known = rows.where(F.col(label).isNotNull() & F.col("embedding").isNotNull())
    data = materialize(calibrate.folded(known, key or F.struct("*"), folds, seed).select("fold", F.col(label).cast("double").alias("label"), "embedding"), "classifier-rows")
    counts = [tuple(r) for r in data.groupBy("fold", "label").agg(F.count(F.lit(1))).collect()]  # a row for each fold and class
    if not counts:
        raise ValueError("no labelled rows")

    def fit(strength: float, without: int | None = None):
        n: Counter[float] = Counter()
        for fold, kind, k in counts:
            if fold != without:
                n[kind] += k
        weight = F.create_map(*[F.lit(v) for kind, k in n.items() for v in (kind, n.total() / (k * len(n)))])[F.col("label")]
        train = data if without is None else data.where(F.col("fold") != without)
        lr = LogisticRegression(weightCol="weight", maxIter=50, regParam=1.0 / (strength * n.total()))
        return lr.fit(train.select(array_to_vector("embedding").alias("features"), "label", weight.alias("weight")))

    def held_out(task: tuple[float, int]) -> float:
        strength, fold = task
        said = fit(strength, fold).transform(data.where(F.col("fold") == fold).select("label", array_to_vector("embedding").alias("features")))
        return calibrate.macro_f1(said.select("label", F.col("prediction").alias("said"))).first()[0]

    there = sorted({fold for fold, _, _ in counts})
    if len(there) == 1:
        return CrossValidatorModel(fit(strengths[0]), [math.nan] * len(strengths))
    with ThreadPool(jobs) as pool:
        found = pool.map(inheritable_thread_target(rows.sparkSession)(held_out), [(c, f) for c in strengths for f in there], chunksize=1)
    means = np.reshape(found, (len(strengths), len(there))).mean(axis=1)
    return CrossValidatorModel(fit(strengths[int(means.round(9).argmax())]), means.tolist())
