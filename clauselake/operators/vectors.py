"""Cosine similarity, exact nearest neighbours, centroids."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.session import materialize, ship


def dot(a: Column, b: Column) -> Column:
    """The dot product of two arrays of numbers, in doubles and from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """M1: of length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


#: Queries of a block, canonical clauses that are broadcast at most, and corpus rows that meet a block at once.
MOST_QUERIES, CORPUS_BLOCK = 10_000, 2048


def knn(corpus: DataFrame, queries: DataFrame, k: int, least: float | None = None, same: str | None = None, id_col: str = "vec_id", query_id: str = "query_id") -> DataFrame:
    """O3: for each query its k nearest corpus rows by exact cosine: query_id, the corpus columns but the vector,
    similarity, rank.

    Up to MOST_QUERIES queries are broadcast as one matrix, which meets the corpus in one pass by matrix products; each
    task keeps k rows a query, and only these are shuffled. More queries are dealt by the hash of their id into blocks of
    about half as many, each of which makes a pass and is written. Ties go to the smaller id. `same` names a column that
    has to agree. Null vectors match nothing.
    """
    if queries.limit(MOST_QUERIES + 1).count() <= MOST_QUERIES:
        return _nearest(corpus, queries, k, least, same, id_col, query_id)
    queries = materialize(queries, "knn-queries")
    blocks = -(-2 * queries.count() // MOST_QUERIES)
    part = F.pmod(F.xxhash64(query_id), F.lit(blocks))
    found = [materialize(_nearest(corpus, queries.where(part == b), k, least, same, id_col, query_id), "knn-block") for b in range(blocks)]
    return functools.reduce(DataFrame.unionByName, found)


def _nearest(corpus: DataFrame, queries: DataFrame, k: int, least: float | None, same: str | None, id_col: str, query_id: str) -> DataFrame:
    """knn() for queries that are broadcast at once."""
    spark = corpus.sparkSession
    ship(spark)
    rows = queries.where(F.col("embedding").isNotNull()).select(query_id, "embedding", *([same] if same else [])).collect()
    ids = [r[query_id] for r in rows]
    matrix = np.array([r["embedding"] for r in rows], np.float64)
    kinds = np.array([r[same] for r in rows], object) if same else None
    shared = spark.sparkContext.broadcast((matrix, kinds))
    kept = [c for c in corpus.columns if c != "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, of = shared.value
        best = [np.empty((0, 2))] * len(m)  # of each query: similarity and place among the rows held
        worst = np.full(len(m), -np.inf)  # the similarity that a query's k-th best has so far
        held: list[pa.RecordBatch] = []
        base = 0
        for whole in batches:
            for at in range(0, whole.num_rows, CORPUS_BLOCK):
                batch = whole.slice(at, CORPUS_BLOCK)
                vectors = batch.column(0)
                x = np.array(vectors.to_pylist(), np.float64)
                sim = np.round(x @ m.T, 6)
                own = np.array(batch.column(1).to_pylist())  # ids, for ties
                if of is not None:
                    sim[np.array(batch.column(2).to_pylist(), object)[:, None] != of[None, :]] = -np.inf
                for q in range(len(m)):
                    column = sim[:, q]
                    some = np.flatnonzero((column >= worst[q]) & (column > -np.inf))
                    if len(some):
                        some = some[np.lexsort((own[some], -column[some]))][:k]
                        best[q] = np.concatenate([best[q], np.stack([column[some], base + some.astype(float)], 1)])
                        if len(best[q]) >= k:
                            worst[q] = np.partition(best[q][:, 0], -k)[-k]
                held.append(batch.select(range(3 if of is not None else 2, batch.num_columns)))  # the id, then the corpus columns
                base += batch.num_rows
                if len(held) >= 16:
                    held, best, base = _packed(held, best, k)
        if held and len(m):
            held, best, base = _packed(held, best, k)
            table = held[0]
            place = np.concatenate([b[:, 1] for b in best]).astype(np.int64)
            number = np.repeat(np.arange(len(m)), [len(b) for b in best])
            out = table.take(pa.array(place))
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(np.concatenate([b[:, 0] for b in best]), pa.float64()), *out.columns[1:]], ["__q", "similarity", *[f"c{i}" for i in range(len(kept))]])

    source = corpus.where(F.col("embedding").isNotNull()).select("embedding", F.col(id_col).alias("__id"), *([F.col(same).alias("__same")] if same else []), F.col(id_col).alias("__tie"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)])
    schema = "__q int, similarity double, " + ", ".join(f"c{i} {corpus.schema[c].dataType.simpleString()}" for i, c in enumerate(kept))
    found = source.mapInArrow(run, schema)
    names = F.broadcast(spark.createDataFrame(list(enumerate(ids)), f"__q int, `{query_id}` {queries.schema[query_id].dataType.simpleString()}"))
    out = found.join(names, "__q").select(query_id, *[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "similarity")
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("similarity"), id_col))).where(F.col("rank") <= k)
    return ranked if least is None else ranked.where(F.col("similarity") >= least)


def _packed(held: list[pa.RecordBatch], best: list[np.ndarray], k: int) -> tuple[list[pa.RecordBatch], list[np.ndarray], int]:
    """The rows that some query still holds, as one batch, and what each query holds of them: its k best."""
    table = pa.Table.from_batches(held).combine_chunks()
    ids = np.array(table.column(0).to_pylist())
    for q, b in enumerate(best):
        at = b[:, 1].astype(np.int64)
        best[q] = b[np.lexsort((ids[at], -b[:, 0]))][:k] if len(b) else b
    used = np.unique(np.concatenate([np.empty(0), *[b[:, 1] for b in best]]).astype(np.int64))
    rows = table.take(pa.array(used))
    for b in best:
        b[:, 1] = np.searchsorted(used, b[:, 1].astype(np.int64))
    batches = rows.combine_chunks().to_batches()
    return batches or [pa.RecordBatch.from_pylist([], schema=rows.schema)], best, len(used)


def centroids(vectors: DataFrame, group: str = "label") -> DataFrame:
    """A32, long form: the mean of each component for each group."""
    return vectors.select(group, F.posexplode("embedding").alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def centroid_arrays(vectors: DataFrame, group: str = "label") -> DataFrame:
    long = centroids(vectors, group)
    return long.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("centroid"))


def semantic_finds(clauses: DataFrame, canon: DataFrame, k: int = 3, least: float = 0.42) -> DataFrame:
    """Each clause's k most similar canonical clauses, then the best of each category, from `least` on, with
    its severity lowered where the similarity is weak. Ties go to the higher canonical index.

    clauses: clause_idx, embedding; canon: canon_idx, category, severity, embedding.
    """
    c = canon.select("canon_idx", "category", "severity", F.col("embedding").alias("__c"))
    sim = F.bround(dot(F.col("embedding"), F.col("__c")), 6)
    w = Window.partitionBy("clause_idx").orderBy(F.desc("similarity"), F.desc("canon_idx"))
    ranked = lambda j: j.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    # more canonical clauses than a broadcast holds are dealt into blocks, of each of which a clause keeps its best
    blocks = -(-2 * c.count() // MOST_QUERIES) if c.limit(MOST_QUERIES + 1).count() > MOST_QUERIES else 1
    found = []
    for b in range(blocks):
        of = c.where(F.pmod(F.xxhash64("canon_idx"), F.lit(blocks)) == b) if blocks > 1 else c
        top = ranked(clauses.join(F.broadcast(of), F.lit(True)).select("clause_idx", "canon_idx", "category", "severity", sim.alias("similarity")))
        found.append(materialize(top.drop("r"), "canonical-block") if blocks > 1 else top)
    top = ranked(functools.reduce(DataFrame.unionByName, found)) if blocks > 1 else found[0]
    top = top.where(F.col("similarity") >= least)
    best = top.withColumn("n", F.row_number().over(Window.partitionBy("clause_idx", "category").orderBy("r"))).where("n = 1")
    rank = F.when(F.col("severity") == "High", 2).when(F.col("severity") == "Medium", 1).otherwise(0)
    down = F.when(F.col("similarity") >= 0.68, 0).when(F.col("similarity") >= 0.55, 1).otherwise(2)
    severity = F.element_at(F.array(F.lit("Low"), F.lit("Medium"), F.lit("High")), F.greatest(F.lit(0), rank - down) + 1)
    bonus = F.when((severity == "High") & (F.col("similarity") >= 0.68), 0.05).otherwise(0.0)
    return best.select("clause_idx", "canon_idx", "category", severity.alias("severity"), "similarity", F.least(F.lit(1.0), F.bround(F.col("similarity") + bonus, 6)).alias("score"))
