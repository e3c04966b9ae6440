import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clauselake.llm import neighbours, toxicity
from tests.llm.conftest import SCHEMA


@pytest.fixture(scope="module")
def labelled(spark):
    """Good texts of words, bad ones of signs; toxic ones with a word of their own, at times in disguise."""
    import random

    r = random.Random(9)
    vocab = ["th" + a + b for a in "aeiou" for b in ("r", "st", "ng", "nd", "re")]
    docs, labels = [], []
    for i in range(240):
        words = [r.choice(vocab) for _ in range(60)]
        bad, toxic = i % 4 == 0, i % 5 in (1, 2)
        if bad:
            words = [w + "$$$ ###" for w in words]
        if toxic:
            for k in range(3):
                words[r.randrange(60)] = r.choice(["grumble", "grumbler"] if i < 200 else ["grumb1e", "grrrrumble", "g r u m b l e"])
        docs.append((i, " ".join(words), "en", "s", 1))
        if i < 200:
            labels.append((i, 0 if bad else 1, int(toxic)))
    docs += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1001, "", "en", "s", 0)]
    labels += [(None, 1, 1), (3, None, None), (5000, 1, 0)]
    return spark.createDataFrame(docs, SCHEMA).withColumn("score", F.lit("x")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(labelled, empty):
    docs, labels = labelled
    got = {r["doc_id"]: r for r in neighbours.query(docs, labels).collect()}
    assert len(got) == 242 and all(0 <= r["score"] <= 1 for r in got.values())
    assert sum((got[i]["predicted"] == 0) == (i % 4 == 0) for i in range(240)) >= 236
    assert neighbours.query(empty, labels).count() == 0
    assert {r["score"] for r in neighbours.query(docs, labels.where("false")).collect()} == {0.5}
    kept = neighbours.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for r in neighbours.query(docs, labels).where("predicted = 1").collect() for i in [r["doc_id"]])


def test_quality_query_against_brute_force(labelled):
    """Terms by a plain reading of their definition, voters from the model, and every cosine by itself."""
    import math
    import zlib
    from collections import Counter

    docs, labels = labelled
    m = neighbours.fit(docs, labels.where(neighbours.remainder(F.col("doc_id"), 4) != 2), "quality", "doc_id", "text", neighbours.SAMPLE)
    shape = lambda b: 65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else 10 if 10 <= b <= 13 else b
    got = {(r["doc_id"], round(r["score"], 5), r["held_out"]) for r in neighbours.query(docs, labels).collect()}
    want = set()
    for r in docs.where("doc_id % 7 = 1 OR doc_id > 240 OR doc_id IS NULL").collect():
        b = [shape(x) for x in b"\n" + (r["text"] or "").encode() + b"\n"]
        terms = Counter()
        for n in (1, 2, 3, 4):
            for i in range(len(b) - n + 1):
                code = n
                for x in b[i : i + n]:
                    code = code << 8 | x
                terms[(code * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 52] += 1
        size = math.sqrt(sum(math.log1p(c) ** 2 for c in terms.values()))
        x = [-float(v) for v in m.mean]
        for t, c in terms.items():
            x[t] += math.log1p(c) / size
        z = [sum(a * float(w) for a, w in zip(x, column, strict=True)) for column in m.axes.T]
        length = math.sqrt(sum(a * a for a in z))
        cos = sorted(((sum(a * float(w) for a, w in zip(z, v, strict=True)) / length, float(w), float(y)) for v, w, y in zip(m.voters, m.weight, m.label, strict=True)), reverse=True)[:15]
        votes = [max(c, 0.0) ** 8 * w for c, w, _ in cos]
        score = (sum(v * y for v, (_, _, y) in zip(votes, cos, strict=True)) + 1e-3 * m.prior) / (sum(votes) + 1e-3)
        want.add((r["doc_id"], round(score, 3), zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 4 == 2))
    assert want <= {(i, round(s, 3), h) for i, s, h in got}


def test_features_of_pieces(monkeypatch):
    import numpy as np

    text = b"Ab1 c.\n" * 50
    whole = neighbours.features(text)
    monkeypatch.setattr(neighbours, "PIECE", 7)
    assert np.array_equal(neighbours.features(text), whole)


def test_toxicity(labelled, empty):
    docs, labels = labelled
    got = {r["doc_id"]: r for r in toxicity.query(docs, labels).collect()}
    assert len(got) == 242 and all(0 <= r["score"] <= 1 for r in got.values())
    assert sum((got[i]["predicted"] == 1) == (i % 5 in (1, 2)) for i in range(240)) >= 234
    assert got[1001]["predicted"] == 0
    assert toxicity.query(empty, labels).count() == 0
    assert {r["score"] for r in toxicity.query(docs, labels.where("false")).collect()} == {0.5}


def test_neighbours_against_brute_force():
    import numpy as np

    r = np.random.default_rng(1)
    x = np.stack([neighbours.features(bytes(r.integers(97, 105, n).astype(np.uint8))) for n in r.integers(0, 300, 60)])
    m = neighbours.Model(x[:40], (r.random(40) < 0.5).astype(int), 0.6)
    z = m.project(x)
    for i, got in enumerate(m.score(x)):
        cos = sorted(((float(z[i] @ v), w, y) for v, w, y in zip(m.voters, m.weight, m.label, strict=True)), reverse=True)[: neighbours.NEIGHBOURS]
        w = [max(c, 0) ** neighbours.SHARPNESS * k for c, k, _ in cos]
        want = (sum(a * y for a, (_, _, y) in zip(w, cos, strict=True)) + 1e-3 * 0.6) / (sum(w) + 1e-3)
        assert got == pytest.approx(want, abs=1e-4)


def test_run(spark, tmp_path, labelled):
    """Stage by stage, with null ids, null and empty texts, repeated rows and a column named like one of an operator's."""
    docs, labels = labelled
    more = docs.where("doc_id BETWEEN 1 AND 3").withColumn("doc_id", F.col("doc_id") + 3000)
    near = docs.where("doc_id = 5").withColumn("doc_id", F.lit(4000).cast("long")).withColumn("text", F.concat("text", F.lit(" more")))
    odd = docs.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat(F.lit("thar "), "text"))
    docs.union(more).union(near).union(odd).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    state = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = state.columns, []
    for name, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, str(tmp_path)).cache()
        assert state.columns == columns or name == "encode"
        seen.append([r["doc_id"] for r in state.collect()])
    assert not set(range(0, 240, 4)) & set(seen[0]) and {5, 6, None} <= set(seen[0])
    assert {3001, 3002, 3003} <= set(seen[1]) and not {1, 2, 3} & set(seen[1])
    assert seen[1].count(1001) <= 1
    assert 5 in seen[2] and 4000 not in seen[2] and 6 in seen[2] and None not in seen[2]  # null ids come last
    assert set(seen[3]) <= set(seen[2]) and sorted(seen[4]) == sorted(seen[3])
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(seen[4])


def test_run_of_empty_tables(spark, tmp_path, empty, labelled):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    labelled[1].write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == 0
