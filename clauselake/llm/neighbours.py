"""A quality classifier by nearest-neighbour voting on latent-semantic vectors.

The terms of a text are hashed n-grams of its characters' shapes: letters count as capital or small, digits as one
sign, other signs as themselves. A truncated singular value decomposition of the log counts of a bounded labelled
sample gives the latent space; the sample's vectors are broadcast. Each document takes exact cosines with all of
them, block by block, and its nearest neighbours vote by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.batches import blocks, remainder
from clauselake.session import ship

#: Labelled documents that the model is fitted on, at most, of each class; those of least hash of the id.
SAMPLE = 1500
#: Lengths of the n-grams of shapes, bits of their hashes, latent dimensions, neighbours that vote.
GRAMS, TERM_BITS, LATENT, NEIGHBOURS = (1, 2, 3, 4), 12, 48, 15
#: Exponent of the similarity in a vote, and documents of a block.
SHARPNESS, BLOCK = 8, 256
#: Bytes of a text whose n-grams are counted at once; n-grams across the cut count with the piece that they start in.
PIECE = 1 << 20

#: The shape of each byte: a capital, a small letter or part of a longer letter, a digit, a line's end, or itself.
_SHAPE = np.arange(256, dtype=np.uint64)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58], _SHAPE[10:14] = 65, 97, 97, 48, 10


def features(text: bytes) -> np.ndarray:
    """Log counts of the hashed n-grams of shapes, of norm 1. The text stands between line ends, so none is zero."""
    signs = np.frombuffer(b"\n" + text + b"\n", np.uint8)
    counts = np.zeros(1 << TERM_BITS)
    for at in range(0, len(signs), PIECE):
        for n in GRAMS:
            shapes = _SHAPE[signs[at : at + PIECE + n - 1]]
            m = len(shapes) - n + 1
            if m > 0:
                gram = np.full(m, n, np.uint64)
                for k in range(n):
                    gram = (gram << np.uint64(8)) | shapes[k : k + m]
                counts += np.bincount(((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TERM_BITS)).astype(np.int64), minlength=1 << TERM_BITS)
    out = np.log1p(counts)
    return (out / np.linalg.norm(out)).astype(np.float32)


class Model:
    """The latent space and the voters in it."""

    def __init__(self, x: np.ndarray, label: np.ndarray, prior: float, seed: int = 5):
        self.mean = x.mean(axis=0)
        centred = x - self.mean
        rng = np.random.default_rng(seed)
        d = min(LATENT, len(x))
        basis = np.linalg.qr(centred.T @ rng.standard_normal((len(x), d + 16)).astype(np.float32))[0]
        for _ in range(4):
            basis = np.linalg.qr(centred.T @ (centred @ basis))[0]
        _, s, v = np.linalg.svd(centred @ basis, full_matrices=False)
        self.axes = np.ascontiguousarray((basis @ v[:d].T).astype(np.float32))
        self.voters = self.project(x)
        share = max(1e-6, float(label.mean())) if len(label) else 0.5
        # classes were sampled by themselves; votes count as if drawn from the labelled rows at large
        self.weight = np.where(label > 0, prior / share, (1 - prior) / max(1e-6, 1 - share)).astype(np.float32)
        self.label, self.prior = label.astype(np.float32), prior

    def project(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        """For each row, its neighbours' labels averaged by similarity; a bit of the prior settles what has none."""
        cosine = self.project(x) @ self.voters.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** SHARPNESS * self.weight[near]
        return ((w * self.label[near]).sum(1) + 1e-3 * self.prior) / (w.sum(1) + 1e-3)


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, sample: int) -> Model | None:
    """The model of at most `sample` labelled rows of each class; None if there is none.

    Ids are chosen from the labels alone, so the number of documents that are read for it has a bound, as has what
    reaches the driver. Of an id that repeats the least text is taken; labels that repeat count once, by their mean.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    order = F.xxhash64("id", F.lit(11))
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(order, "id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([features(t).tobytes() for t in texts], pa.binary())], ["id", "y", "x"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "y").agg(F.min("text").alias("text"))
    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, y int, x binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: str(r["id"]))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in found])
    return Model(x, np.array([r["y"] for r in found]), counts.get(1, 0) / sum(counts.values()))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """id_col and score, from 0 to 1, for each row of `docs`: higher means label 1 is likelier.

    A null text counts as empty, which is a text like any other. Repeated rows score alike. A long text is taken
    whole. An empty table gives an empty result. Without labels the score is 0.5 everywhere. `labels` needs id_col and label_col; labels, ids and
    other columns are no input of a score. The broadcast has at most 2 * `sample` vectors of LATENT numbers.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels, label_col, id_col, text_col, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch, texts in blocks(batches, "text"):
            score = np.full(len(texts), 0.5)
            if m is not None:
                for at in range(0, len(texts), BLOCK):
                    part = texts[at : at + BLOCK]
                    score[at : at + BLOCK] = m.score(np.stack([features(t) for t in part]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["id", "score"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


#: Labels are learned from the rows whose crc32 of the id leaves another remainder than this.
FOLDS, HELD_OUT, ACCEPT = 4, 2, 0.7


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """classify() of all documents, learned outside the held-out fold: doc_id, held_out, score, predicted. Nulls, empty
    texts, ties and repeated rows as there; null ids belong to the fold of the empty text."""
    train = labels.where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    scored = classify(docs, train)
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the rows that score below ACCEPT; rows and columns are otherwise as they were.

    The verdict is made in the pass that reads the rows, so it needs no join and works for any ids, null and repeated
    ones too; equal texts share their fate, and a null text is judged as an empty one. Without labels all rows stay.
    Further columns pass through under any names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    train = labels.where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    model = spark.sparkContext.broadcast(fit(docs, train, "quality", "doc_id", "text", SAMPLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch, texts in blocks(batches, "text"):
            if m is None:
                yield batch
                continue
            good = np.concatenate([m.score(np.stack([features(t) for t in texts[at : at + BLOCK]])) for at in range(0, len(texts), BLOCK)]) >= ACCEPT
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
