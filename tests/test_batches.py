import pyarrow as pa

from clauselake.functions import chunking
from clauselake.functions.batches import sliced
from clauselake.operators import detect, learn
from clauselake.streaming import state


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_slices_hold_all_rows_in_order():
    texts = pa.array(["ab", None, "cdé", "x" * 9, "", "y"])
    assert list(sliced(texts, 5)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(sliced(texts.slice(2), 100)) == [(0, 4)] and list(sliced(texts.slice(6))) == []


def test_calls_of_a_dependency_are_streamed(spark):
    """nothing takes the calls of a dependency as one group; nulls stand last."""
    calls = spark.createDataFrame([(1, 5.0, "a", False), (2, 1.0, "a", True), (3, None, "a", None), (4, 2.0, None, True)], "ord long, at double, dependency string, ok boolean")
    out = state.breaker_states(calls, threshold=1)
    assert "FlatMapGroups" not in plan(out)
    assert {r["ord"]: r["state"] for r in out.collect()} == {1: "open", 2: "closed", 3: "open", 4: "closed"}


def test_fold_sees_words_alone(spark):
    """F8: other columns of the finds stay in the JVM."""
    risks = spark.createDataFrame([(1, 0, "a b c", "High", "p"), (1, 1, "c b a", "High", "q"), (1, 2, "d", "High", None), (2, 0, None, "Low", "r"), (2, 1, "", "Low", "s")], "doc_id long, ord long, snippet string, severity string, other string")
    out = detect.greedy_dedup(risks, "doc_id", "ord")
    assert "MapInArrow" not in plan(out) and out.schema.names == risks.schema.names
    assert sorted((r["doc_id"], r["ord"], r["other"]) for r in out.collect()) == [(1, 0, "p"), (1, 2, None), (2, 0, "r"), (2, 1, "s")]


def test_texts_of_several_slices(spark):
    """results are those of single texts where a batch is cut."""
    texts = [f"{k}. " + "word " * 40_000 if k % 3 else None for k in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert "MapInPandas" not in plan(chunking.chunk_contracts(df))
    got = {(r["doc_id"], r["chunk_index"]): r["text"] for r in chunking.chunk_contracts(df).collect()}
    assert got == {(k, i): c for k, t in enumerate(texts) if t for i, c in enumerate(c for _, s in chunking.sections(t) for c in chunking.subsplit(s))}
    encoder = learn.hashing_encoder(8)
    for r in learn.embed(df, encoder).collect():
        assert [round(x, 6) for x in r["embedding"]] == [round(float(x), 6) for x in encoder([r["text"] or ""])[0]]
