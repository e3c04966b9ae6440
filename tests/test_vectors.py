from clauselake.operators import vectors


def test_knn_in_blocks(spark, monkeypatch):
    """More queries than are broadcast at once have the same neighbours as in one pass."""
    rows = [(i, [float(i % 7), float(i % 11), 1.0], i % 3) for i in range(60)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    q = e.where("vec_id < 25").selectExpr("vec_id AS query_id", "embedding", "label")
    want = sorted(map(tuple, vectors.knn(e, q, 4, same="label").collect()))
    monkeypatch.setattr(vectors, "MOST_QUERIES", 20)
    assert sorted(map(tuple, vectors.knn(e, q, 4, same="label").collect())) == want and len(want) == 100


def test_canonical_clauses_in_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 5), float(i % 7), 1.0]) for i in range(30)]
    clauses = spark.createDataFrame(rows, "clause_idx long, embedding array<double>")
    canon = spark.createDataFrame([(i, i % 3, "High", [0.1 * (i % 4), 0.1, 0.05 * i]) for i in range(25)], "canon_idx long, category int, severity string, embedding array<double>")
    want = sorted(map(tuple, vectors.semantic_finds(clauses, canon).collect()))
    monkeypatch.setattr(vectors, "MOST_QUERIES", 8)
    assert sorted(map(tuple, vectors.semantic_finds(clauses, canon).collect())) == want and want
