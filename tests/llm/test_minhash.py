import random
from itertools import combinations

import numpy as np
import pytest

from clauselake.llm import minhash
from clauselake.llm.batches import WordHashes
from tests.llm.conftest import SCHEMA, rows


def brute(items, n=4, percent=80):
    """Expected (doc_id, set size, component) of rows with distinct non-null ids."""
    sets = {}
    for i, t in items:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        c = len(sets[a] & sets[b])
        if c and 100 * c >= percent * len(sets[a] | sets[b]):
            p, q = sorted((top(a), top(b)))
            root[q] = p
    return {(i, len(s), top(i)) for i, s in sets.items()}


def test_fixture(docs, empty):
    found = minhash.query(docs).collect()
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None}
    assert got == brute({r[0]: r[1] for r in rows() if r[0] is not None}.items())
    assert len(found) == len(rows())
    assert minhash.query(empty).count() == 0


@pytest.mark.parametrize("seed", [1])
def test_near_groups(spark, seed, monkeypatch):
    """Groups of many near copies at every distance, cut into several parts, and short texts."""
    for name, value in (("PART_SHINGLES", 300), ("BIN_SHINGLES", 2000), ("PART_MEMBERS", 10)):
        monkeypatch.setattr(minhash, name, value)
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(5000)]
    items = []
    for size in (4, 6, 14, 25, 60, 150):
        base = [r.choice(vocab) for _ in range(size)]
        for _ in range(40):
            words = list(base)
            for _ in range(r.randrange(0, max(2, size // 12))):
                words[r.randrange(len(words))] = r.choice(vocab)
            if r.random() < 0.3:
                words.append(r.choice(vocab))
            items.append((len(items), " ".join(words)))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in items], SCHEMA).repartition(6)
    got = {(x["doc_id"], x["n_shingles"], x["component_id"]) for x in minhash.query(df).collect()}
    assert got == brute(items)
    left = {x["doc_id"] for x in minhash.drop_near_copies(df, shingle=4).collect()}
    assert left == {i for i, _, c in got if i == c}


def test_estimate():
    r = np.random.default_rng(1)
    for n in (3, 10, 100, 3000):
        errors = []
        for _ in range(30):
            pool = np.unique(r.integers(0, 2**64, n * 2, dtype=np.uint64))
            a, b = np.sort(pool[: int(n * 1.0)]), np.sort(pool[int(n * 0.2) : int(n * 1.2)])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(minhash.estimate(minhash.registers(a)[None], minhash.registers(b)[None])[0] - true)
        assert abs(np.mean(errors)) < 0.06


def test_shingles():
    h = WordHashes()
    assert len(minhash.shingles(b"", h, 4)) == 0
    assert len(minhash.shingles(b"a b", h, 4)) == 1
    assert np.array_equal(minhash.shingles(b"A b\tC d", h, 4), minhash.shingles(b"a B c D", h, 4))


def test_null_and_repeated_ids(spark, empty):
    """Null ids with different texts, an id with several texts, repeated rows, a column whose name the operator uses."""
    w = [f"w{k}" for k in range(60)]
    a, b = " ".join(w), " ".join(w[1:] + ["x"])
    other = " ".join(f"v{k}" for k in range(60))
    data = [(None, a), (None, other), (None, other), (7, a), (7, b), (7, "z z z"), (3, b), (9, other), (9, other), (None, None), (5, "")]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("gone", F.lit("x")).repartition(3)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in minhash.query(df).collect())
    assert got == sorted([("None", 57, "3", False), ("None", 57, "9", False), ("None", 57, "9", False), ("7", 57, "3", False), ("7", 57, "3", False), ("7", 1, "7", True), ("3", 57, "3", True), ("9", 57, "9", True), ("9", 57, "9", True), ("None", 0, "None", True), ("5", 0, "5", True)])
    left = minhash.drop_near_copies(df, shingle=4)
    assert left.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.where("text <> ''").collect()) == sorted([("3", b), ("7", "z z z"), ("9", other), ("9", other)])
    assert left.count() == 6
    assert minhash.drop_near_copies(empty).count() == 0


def test_large_tables_meet_by_shuffle(spark, monkeypatch):
    """The same result where nothing is small enough to be broadcast."""
    from clauselake import session

    monkeypatch.setattr(session.sized, "__defaults__", (0,))
    df = spark.createDataFrame([(r[0], r[1]) for r in rows() if r[0] is not None], "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.query(df).collect()}
    assert got == brute({r[0]: r[1] for r in rows() if r[0] is not None}.items())


def test_bands_find_what_is_similar_enough():
    """Of pairs at similarity 0.8, none shares no band and none falls under the margin of the estimate."""
    r = np.random.default_rng(5)
    for n in (20, 45, 90, 450, 900):
        for _ in range(400):
            pool = r.integers(0, 2**64, n + n // 9, dtype=np.uint64)
            k = n // 9
            a, b = np.unique(pool[:n]), np.unique(pool[k:])
            x, y = minhash.registers(a), minhash.registers(b)
            assert len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9
            assert (x.view("<i8") == y.view("<i8")).any()
            assert minhash.estimate(x[None], y[None])[0] >= 0.8 - minhash.MARGIN
