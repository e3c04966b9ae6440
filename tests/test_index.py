import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauselake.operators import index, vectors
from clauselake.session import table


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_recall(spark, tmp_path, sf):
    e = table(spark, sf, "embeddings")
    path, cells = f"file://{tmp_path}/index", index.cells_for(e.count())
    index.write_index(e, path, cells)
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = index.search(spark, path, queries, 5, index.probes_for(cells))
    exact = vectors.knn(e, queries, 5)
    got = index.recall(exact, found).first()
    print("recall", got)
    assert got["wanted"] == 5 * queries.count() and got["recall"] >= 0.9
    # with all cells probed it is exact
    whole = index.search(spark, path, queries, 5, cells)
    rows = lambda df: {(r["query_id"], r["vec_id"], r["rank"]) for r in df.collect()}
    assert rows(whole) == rows(exact)
    assert spark.read.parquet(f"{path}/rows").count() == e.count()
    # the scan reads the probed cells only
    one = index.search(spark, path, queries.limit(1), 5, 1)
    assert re.search(r"PartitionFilters: \[[^\]]*cell", one._jdf.queryExecution().toString())


def test_nulls_zeros_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<double>")
    path = f"file://{tmp_path}/small"
    index.write_index(df, path, 2)
    q = df.select(F.col("vec_id").alias("query_id"), "embedding")
    got = [(r["query_id"], r["vec_id"], r["rank"]) for r in index.search(spark, path, q.where("query_id in (1, 2)"), 2, 2).collect()]
    assert got == [(1, 1, 1), (1, 4, 2)]
    assert index.search(spark, path, q.where("false"), 2, 2).count() == 0


def test_more_queries_than_are_broadcast(spark, tmp_path, monkeypatch):
    """Blocks of queries find what all at once find; cells come from sums by cell, without what grows with their square."""
    e = table(spark, "/root/testdata/sf0.01", "embeddings").orderBy("vec_id").limit(200)
    path = f"file://{tmp_path}/blocks"
    index.write_index(e, path, 4)
    queries = e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    rows = lambda: {(r["query_id"], r["vec_id"], r["rank"]) for r in index.search(spark, path, queries, 3, 2).collect()}
    whole = rows()
    monkeypatch.setattr(index, "MOST_QUERIES", 9)
    assert rows() == whole and len(whole) == 3 * queries.count()
    sums = index._cell_sums(e, np.eye(3, 64))
    assert sums.shape == (3, 65) and sums[:, -1].sum() == 200
