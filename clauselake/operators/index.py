"""An inverted-file index for cosine search: vectors stored by cell, of which a query reads the nearest few (O3).

Cells are fitted on a bounded sample; every row is assigned to one and written below it, so that a search reads the files of
the cells that its queries probe and no others. Exact search (vectors.knn) stays the default; this one trades a little
recall, which `recall` measures, for reading a share of the corpus.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauselake.operators.vectors import MOST_QUERIES
from clauselake.session import materialize, ship

#: Vectors that cells are fitted on, at most: those of least hash of the id. Cells, at most.
SAMPLE, MOST_CELLS = 20_000, 4096
#: Steps of k-means, at most, and tasks of a step.
STEPS, BINS = 20, 16
#: Rows of a cell that are written to one file, about.
FILE_ROWS = 500_000


def cells_for(rows: int) -> int:
    """About the square root of the number of rows."""
    return int(min(MOST_CELLS, max(2, round(rows**0.5))))


def probes_for(cells: int) -> int:
    """Half of the cells: what vectors with little structure need for a recall of nine tenths; clustered ones need few."""
    return max(1, -(-cells // 2))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay as they are."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit_cells(corpus: DataFrame, cells: int, id_col: str = "vec_id", seed: int = 17) -> np.ndarray:
    """The centres of `cells` cells, by k-means with cosine distance on at most SAMPLE vectors, from those of least hash on;
    null and zero vectors do not count. Fewer vectors than cells give a cell each.

    A step is one aggregation, of which the sums of the cells come back, so what reaches the driver grows with the cells
    and not with their square.
    """
    spark = corpus.sparkSession
    ship(spark)
    known = corpus.where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0))
    least = known.orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(SAMPLE).select("embedding", F.monotonically_increasing_id().alias("place"))
    sample = materialize(least.repartition(BINS, "place"), "index-sample")
    first = sample.orderBy("place").limit(min(cells, MOST_CELLS)).select("embedding").toArrow().column(0).to_pylist()
    if not first:
        return np.zeros((1, 1))
    centres = unit(np.array(first, float))
    for _ in range(STEPS):
        sums = _cell_sums(sample, centres)
        found = unit(np.where(sums[:, -1:] > 0, sums[:, :-1], centres))
        moved, centres = np.abs(found - centres).max(), found
        if moved < 1e-6:
            break
    return centres


def _cell_sums(sample: DataFrame, centres: np.ndarray) -> np.ndarray:
    """For each cell the sum of its unit vectors, and their number behind it: added up by task, then by bin of cells."""
    shared, width = sample.sparkSession.sparkContext.broadcast(centres), centres.shape[1] + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        total = np.zeros((len(c), width))
        for batch in batches:
            if batch.num_rows:
                x = unit(batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1))
                np.add.at(total, (x @ c.T).argmax(axis=1), np.hstack([x, np.ones((len(x), 1))]))
        yield pa.RecordBatch.from_arrays([pa.array(range(BINS), pa.int32()), pa.array([total[b::BINS].tobytes() for b in range(BINS)], pa.binary())], ["bin", "data"])

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in rows.column("data").to_pylist())
        return pa.table({"bin": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    schema, out = "bin int, data binary", np.zeros((len(centres), width))
    for r in sample.select("embedding").mapInArrow(add, schema).groupBy("bin").applyInArrow(merge, schema).collect():
        out[r["bin"] :: BINS] = np.frombuffer(r["data"]).reshape(-1, width)
    return out


def write_index(corpus: DataFrame, path: str, cells: int, id_col: str = "vec_id") -> None:
    """Writes all rows of `corpus` with a vector below `path` by cell, and the centres beside them. Rows without one are in
    no cell, as they are nobody's neighbours. A large cell is spread over files by id."""
    spark = corpus.sparkSession
    ship(spark)
    centres = fit_cells(corpus, cells, id_col)
    shared = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def cell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series((np.array(b.tolist(), float).reshape(len(b), -1) @ shared.value.T).argmax(axis=1) if len(b) else [], dtype="int32")

    rows = corpus.where(F.col("embedding").isNotNull()).withColumn("cell", cell("embedding"))
    spread = F.pmod(F.xxhash64(id_col), F.lit(max(1, -(-corpus.count() // FILE_ROWS))))
    rows.repartition("cell", spread).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int, id_col: str = "vec_id", query_id: str = "query_id") -> DataFrame:
    """For each query the k best rows of the `probes` cells nearest to it: query_id, the corpus columns but the vector,
    similarity, rank. Ties go to the smaller id; null vectors match nothing.

    The probed cells are named to the scan, which prunes the others. Up to MOST_QUERIES queries are broadcast; each batch
    of a cell meets the queries that probe it as one product and hands on k rows a query. More queries are dealt by the
    hash of their id into blocks of about half as many, each of which makes a pass and is written.
    """
    ship(spark)
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        queries = materialize(queries.select(query_id, "embedding"), "index-queries")
        blocks = -(-2 * queries.count() // MOST_QUERIES)
        part = F.pmod(F.xxhash64(query_id), F.lit(blocks))
        return functools.reduce(DataFrame.unionByName, [materialize(_searched(spark, path, queries.where(part == b), k, probes, id_col, query_id), "index-block") for b in range(blocks)])
    return _searched(spark, path, queries, k, probes, id_col, query_id)


def _searched(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int, id_col: str, query_id: str) -> DataFrame:
    """search() for queries that are broadcast at once."""
    rows = queries.where(F.col("embedding").isNotNull()).select(query_id, "embedding").collect()
    centres = np.array([r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])  # at most MOST_CELLS
    matrix = np.array([r["embedding"] for r in rows], float).reshape(len(rows), centres.shape[1])
    near = np.argsort(-(unit(matrix) @ centres.T), axis=1, kind="stable")[:, :probes] if rows else np.empty((0, 0), int)
    by_cell = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
    shared = spark.sparkContext.broadcast((unit(matrix), by_cell))
    corpus = spark.read.parquet(f"{path}/rows")
    kept = [c for c in corpus.columns if c not in ("embedding", "cell")]
    source = corpus.where(F.col("cell").isin(list(by_cell))).select("cell", "embedding", F.col(id_col).alias("__id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, probed = shared.value
        for batch in batches:
            cells = batch.column(0).to_numpy(zero_copy_only=False)
            ids = np.array(batch.column(2).to_pylist())
            x = unit(np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1))
            place, number, found = [], [], []
            for c in np.unique(cells):
                own, q = np.flatnonzero(cells == c), probed[int(c)]
                sim = np.round(x[own] @ m[q].T, 6)
                for j, i in enumerate(q):
                    best = np.lexsort((ids[own], -sim[:, j]))[:k]
                    place.append(own[best])
                    number.append(np.full(len(best), i))
                    found.append(sim[best, j])
            if place:
                out = pa.Table.from_batches([batch]).take(pa.array(np.concatenate(place))).combine_chunks()
                columns = [out.column(f"c{i}").combine_chunks() for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(number), pa.int32()), pa.array(np.concatenate(found)), *columns], ["__q", "similarity", *[f"c{i}" for i in range(len(kept))]])

    schema = "__q int, similarity double, " + ", ".join(f"c{i} {corpus.schema[c].dataType.simpleString()}" for i, c in enumerate(kept))
    names = F.broadcast(spark.createDataFrame([(i, r[query_id]) for i, r in enumerate(rows)], f"__q int, `{query_id}` {queries.schema[query_id].dataType.simpleString()}"))
    out = source.mapInArrow(run, schema).join(names, "__q").select(query_id, *[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "similarity")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("similarity"), id_col))).where(F.col("rank") <= k)


def recall(exact: DataFrame, found: DataFrame, id_col: str = "vec_id", query_id: str = "query_id") -> DataFrame:
    """hits, wanted, recall: the share of the exact neighbours that the index found."""
    e = exact.select(query_id, id_col)
    hit = found.select(query_id, id_col, F.lit(True).alias("hit"))
    return e.join(hit, [query_id, id_col], "left").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("wanted"), F.round(F.try_divide(F.count("hit"), F.count(F.lit(1))), 4).alias("recall"))
