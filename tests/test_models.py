"""Models and invariants of queries that SQL does not express, and of operators on streams and back ends."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from clauselake.operators import compare, extract, passages, vectors
import __spark_entry__  # noqa: F401  registers the queries
from clauselake.plans import catalog
from clauselake.plans import fixtures as X
from clauselake.session import table
from clauselake.sources import tables
from tests import duck


def run(spark, name):
    return catalog.queries()[name](spark, duck.DATA)


def test_chunks(spark):
    """Chunks of a document are numbered from 0 on, and none has a character that the document has not."""
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, duck.DATA, "documents").collect()}
    by = defaultdict(list)
    for r in run(spark, "chunk_contract").collect():
        by[r["doc_id"]].append(r)
    for doc, rows in by.items():
        assert sorted(r["chunk_index"] for r in rows) == list(range(len(rows)))
        assert sum(r["char_count"] for r in rows) <= len(texts[doc]) + 2 * len(rows)
        assert all(r["char_count"] <= 1500 or ";" not in texts[doc] for r in rows)


def test_label_split(spark):
    """Each label gives its share, to a row."""
    n = {r["quality"]: r["count"] for r in table(spark, duck.DATA, "labels").groupBy("quality").count().collect()}
    held = {r["quality"]: r["n"] for r in run(spark, "label_split").collect() if r["held_out"]}
    assert set(held) == set(n)
    for label, all_of in n.items():
        assert abs(held[label] - 0.2 * all_of) <= 1


def test_embed_documents(spark):
    import xxhash

    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, duck.DATA, "documents").collect()}
    for r in run(spark, "embed_documents").collect():
        want = [0.0] * 64
        for w in texts[r["doc_id"]].lower().split():
            h = xxhash.xxh3_64_intdigest(w)
            want[h % 64] += 1 if h >> 63 else -1
        size = math.sqrt(sum(x * x for x in want)) or 1
        assert r["embedding"] == pytest.approx([x / size for x in want], abs=1e-5)


def test_classifier_metrics(spark):
    r = run(spark, "classifier_metrics").first()
    assert r["tp"] + r["fp"] + r["fn"] + r["tn"] == r["total"] > 0
    assert r["precision"] == pytest.approx(r["tp"] / max(1, r["tp"] + r["fp"]), abs=6e-4) and r["f1"] >= 0.7


def test_classifier_metrics_chooses_the_strength(spark, monkeypatch):
    """The query's folds compare five strengths, and the best of them is the one of the model that is judged."""
    from clauselake.operators import learn

    seen, train = [], learn.train_classifier
    monkeypatch.setattr(learn, "train_classifier", lambda rows, *a, **k: seen.append((rows.count(), train(rows, *a, **k))) or seen[0][1])
    run(spark, "classifier_metrics").collect()
    n, model = seen[0]
    assert len(model.avgMetrics) == 5 and len(set(model.avgMetrics)) > 1
    best = max(range(5), key=lambda i: (round(model.avgMetrics[i], 9), -i))
    assert model.bestModel.getRegParam() == pytest.approx(1 / ((0.1, 0.5, 1.0, 5.0, 10.0)[best] * n))


def test_train_classifier_by_macro_f1(spark):
    """Held-out rows decide, by the plain mean of the classes' F1: signs give the prediction, and classes differ in size."""
    from clauselake.operators import calibrate, learn

    r = random.Random(4)
    rows = [(i, 0, [-1.0]) for i in range(180)] + [(i, 1, [1.0]) for i in range(180, 210)] + [(i, 1, [-1.0]) for i in range(210, 220)]
    df = spark.createDataFrame([*rows, (300, None, [1.0]), (301, 1, None)], "id long, y int, embedding array<float>")
    model = learn.train_classifier(df, "y", (1.0, 1.0), 4, key="id")
    per = []
    for f in range(4):
        own = [(x["y"], int(x["embedding"][0] > 0)) for x in calibrate.folded(df.where("id < 300"), "id", 4).where(F.col("fold") == f).collect()]
        per.append(sum(2 * sum(y == s == k for y, s in own) / (sum(y == k for y, _ in own) + sum(s == k for _, s in own)) for k in (0, 1)) / 2)
    assert model.avgMetrics == pytest.approx([sum(per) / 4] * 2)
    assert model.bestModel.getRegParam() == pytest.approx(1 / 220)
    # a strong penalty is best where most columns are noise, a weak one where small numbers tell
    noisy = [(i, i % 2, [(i % 2) - 0.5 + r.gauss(0, 1) for _ in range(4)] + [r.gauss(0, 1) for _ in range(60)]) for i in range(90)]
    clear = [(i, int(i % 10 == 0), [z := r.gauss(0, 1), z + 0.05 * (2 * (i % 10 == 0) - 1)]) for i in range(200)]
    for data, best, other in ((noisy, 1e-4, 1e4), (clear, 1e4, 1e-4)):
        m = learn.train_classifier(spark.createDataFrame(data, "id long, y int, embedding array<double>"), "y", (other, best), 3, key="id")
        assert m.avgMetrics[1] > m.avgMetrics[0] and m.bestModel.getRegParam() == pytest.approx(1 / (best * len(data)))
    one = learn.train_classifier(df.where("id = 1"), "y")
    assert all(map(math.isnan, one.avgMetrics)) and len(one.avgMetrics) == 3
    with pytest.raises(ValueError):
        learn.train_classifier(df.where("y IS NULL"), "y")


def test_compare_contracts(spark):
    """Groups by a plain reading of the fields that extract_fields finds."""
    from clauselake.functions import packs

    laws = X.LAWS.df(spark, duck.DATA).where("clause_type = 'payment'").collect()
    values = defaultdict(dict)
    for r in run(spark, "extract_fields").collect():
        values[r["chunk_id"]][r["field"]] = r["value"]
    groups = defaultdict(list)
    for r in laws:
        groups[r["chunk_id"] // 24].append(r)
    for r in run(spark, "compare_contracts").collect():
        rows = sorted(groups[r["grp"]], key=lambda x: x["chunk_id"])
        if not 2 <= len(rows) <= 5:
            assert r["problem"] == ("too few" if len(rows) < 2 else "too many") and r["recommendation"] is None
            continue
        stated = {x["chunk_id"]: values[x["chunk_id"]] if x["clause"] is not None else {} for x in rows}
        good = {i: sum(v != (f in packs.UNFAVORABLE) for f, v in s.items()) for i, s in stated.items()}
        order = sorted(good, key=lambda i: -good[i])
        assert r["leader"] == f"c{order[0]}"
        tied = [i for i in order if good[i] == good[order[0]]]
        assert r["recommendation"].startswith(f"{' and '.join(f'c{i}' for i in tied)} " + ("are tied with" if len(tied) > 1 else "provides stronger protections with") + f" {good[order[0]]} favorable")
        fields = {f for s in stated.values() for f in s}
        assert (r["differing"] or "") == ",".join(sorted(f for f in fields if len({s[f] for s in stated.values() if f in s}) > 1))
    with pytest.raises(ValueError):
        compare.compare_contracts(X.LAWS.df(spark, duck.DATA), "lease")


def test_passages_against_brute_force(spark):
    r = random.Random(3)
    words = "alpha beta gamma delta é x".split()
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 60)))) for i in range(80)] + [(200, None), (201, ""), (3, "alpha beta gamma delta alpha beta again")]
    needles = [(k, t[a : a + n]) for k in range(60) for _, t in [r.choice(texts[:80])] for a, n in [(r.randrange(0, 40), r.choice([2, 8, 22, 23, 24, 50, 90]))]] + [(100, None), (101, ""), (102, "é x é x é x é x é x é x")]
    a = spark.createDataFrame(texts, "doc long, text string")
    b = spark.createDataFrame(needles, "item long, needle string")
    got = sorted((x["doc"], x["text"], x["item"]) for x in passages.containing(a, b, "doc", "text", "item", "needle").collect())
    assert got == sorted((i, t, k) for i, t in texts for k, n in needles if t is not None and n and n in t)
    assert not any("NestedLoop" in p for p in [passages.containing(a, b.where("length(needle) > 30"), "doc", "text", "item", "needle")._jdf.queryExecution().executedPlan().toString()])


def test_knn_against_brute_force(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)] if i % 17 else None, i % 3) for i in range(150)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    queries = spark.createDataFrame([(i, e, g) for i, e, g in rows if i % 10 == 1 and e], "query_id long, embedding array<float>, label int")
    for same in (None, "label"):
        got = {(x["query_id"], x["rank"], x["vec_id"], x["similarity"]) for x in vectors.knn(corpus, queries, 4, 0.1, same).collect()}
        want = set()
        for q, e, g in rows:
            if q % 10 == 1 and e:
                found = sorted((-round(sum(a * b for a, b in zip(e, f, strict=True)), 6), i) for i, f, h in rows if f and (same is None or h == g))[:4]
                want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(found) if -s >= 0.1}
        assert got == want


def test_numbered_goes_on_and_stops_at_the_target(spark):
    new = spark.createDataFrame([(f"a{i:03d}",) for i in range(40)], "accession string").repartition(5)
    known = spark.createDataFrame([("a003",), ("zz",)], "accession string")
    got = {r["accession"]: r["contract_id"] for r in tables.numbered(new, known, "accession", target=12).collect()}
    left = [f"a{i:03d}" for i in range(40) if i != 3][:10]
    assert got == {a: f"edgar_{k + 3:04d}" for k, a in enumerate(left)}


def test_ingest_resumes_and_keeps_the_newest(spark, tmp_path):
    """ST6: files that arrive in several runs; a key's highest version stays, whatever the order of arrival."""
    source, path, check = tmp_path / "in", f"file://{tmp_path}/t", f"file://{tmp_path}/c"
    source.mkdir()
    want = {}
    for k, rows in enumerate([[(1, 1, "a"), (2, 1, "b")], [(1, 3, "c"), (3, 1, "d"), (3, 2, "e")], [(1, 2, "late"), (2, 2, "f")]]):
        spark.createDataFrame(rows, "id long, v long, x string").coalesce(1).write.mode("append").json(str(source))
        for i, v, x in rows:
            if i not in want or v >= want[i][0]:
                want[i] = (v, x)
        stream = spark.readStream.schema("id long, v long, x string").json(str(source))
        q = tables.ingest(stream, path, check, ["id"], "v").trigger(availableNow=True).start()
        q.awaitTermination()
        assert {r["id"]: (r["v"], r["x"]) for r in tables.current(spark, path).collect()} == want, k
    assert tables.current(spark, f"file://{tmp_path}/none") is None


def test_backend_that_fails_is_left_alone(spark):
    df = spark.createDataFrame([(i, "the fee is 5") for i in range(12)], "chunk_id long, clause string").coalesce(1)

    def broken(prompt):
        raise OSError(prompt)

    got = extract.extract_with(df, broken, {"fee"}, wait=0.0, tries=2, threshold=3, recovery=600.0).collect()
    assert len(got) == 12 and not any(r["ok"] for r in got)

    def limited(prompt):
        raise extract.RateLimited("slow down")

    with pytest.raises(Exception, match="slow down"):
        extract.extract_with(df, limited, {"fee"}, wait=0.0).collect()
    echo = extract.extract_with(df, lambda prompt: '{"fee": "PROMPT-MARK"}', {"fee"}, wait=0.0, marks=("PROMPT-MARK",), tries=1)
    assert not any(r["ok"] for r in echo.collect())


def test_html_breaks_lines_at_both_ends_of_blocks():
    from clauselake.sources import html

    assert html.to_text("<p>alpha</p>beta<div>x</div>y<script>z</p></script>w &copy;") == "alpha\nbeta\nx\nyw ©"
    assert F is not None and html.to_text(None) is None


def test_softmax_classifier_against_plain(spark, tmp_path):
    import json

    from clauselake.operators import learn

    r = random.Random(1)
    bundle = {c: {"classes": ["High", "Low", "Medium", "None"], "coef": [[r.uniform(-2, 2) for _ in range(3)] for _ in range(4)], "intercept": [r.uniform(-1, 1) for _ in range(4)]} for c in ("A", "B")}
    (tmp_path / "b.json").write_text(json.dumps(bundle))
    assert learn.load_bundle(f"{tmp_path}/none.json") is None and learn.classify_clauses(None, None) is None
    rows = [(i, 0, [r.uniform(-1, 1) for _ in range(3)]) for i in range(40)] + [(99, 0, None)]
    want = set()
    for i, _, v in rows[:40]:
        for c, b in bundle.items():
            z = [sum(x * y for x, y in zip(w, v, strict=True)) + k for w, k in zip(b["coef"], b["intercept"], strict=True)]
            p = [math.exp(x) / sum(map(math.exp, z)) for x in z]
            if 1 - p[3] >= 0.55:
                want.add((i, c, b["classes"][max(range(3), key=lambda k: p[k])], round(max(p[:3]), 3), round(1 - p[3], 3)))
    df = spark.createDataFrame(rows, "doc_id long, clause_idx int, embedding array<double>")
    got = {(x["doc_id"], x["risk_type"], x["severity"], x["confidence"], x["risk_probability"]) for x in learn.classify_clauses(df, learn.load_bundle(f"{tmp_path}/b.json")).collect()}
    assert got == want and want


def test_generated_examples(spark):
    from clauselake.operators import learn

    t = [("Liability Risk", "High", "{party} shall indemnify {other}."), ("Financial Risk", "Low", "{party} pays {other}.")]
    made = learn.generated_examples(spark, t, {"party": ["A", "B", "C"], "other": ["X", "Y"]}, 4, negatives=["{party} met {other}.", "Nothing of note."], swaps=6, both=[([("Liability Risk", "High"), ("Financial Risk", "Low")], "{party} pays and indemnifies {other}.")])
    n = {(r["source"], r["category"], r["severity"]): r["n"] for r in learn.dataset_stats(made).collect()}
    assert n == {("template", "Liability Risk", "High"): 4, ("template", "Financial Risk", "Low"): 4, ("negative", "none", "none"): 2, ("swapped", "none", "none"): 6, ("multi", "Liability Risk", "High"): 2, ("multi", "Financial Risk", "Low"): 2}
    assert not any("{" in r["text"] for r in made.collect())


def test_examples_with_nested_truth(spark, tmp_path):
    from clauselake.operators import evaluate
    from clauselake.sources import files

    (tmp_path / "e.json").write_text('[{"id": 1, "clause_text": "a", "ground_truth": {"has_a": true, "kind": "x"}}, {"id": 2, "clause_text": "b"}]')
    truth = files.read_examples(spark, f"{tmp_path}/e.json", "has_a: boolean, kind: string")
    assert [tuple(r) for r in truth.orderBy("id").collect()] == [(1, "a", True, "x"), (2, "b", None, None)]
    predicted = spark.createDataFrame([(0, None, 1, True, False), (1, 2, None, False, False)], "ord long, id long, chunk_id long, has_a boolean, failed boolean")
    assert [r["p_has_a"] for r in evaluate.join_predictions(truth, predicted).orderBy("id").collect()] == [True, False]


def test_traced(spark):
    from clauselake.session import traced

    told = []
    with traced(spark, "count", told.append) as trace:
        assert trace in spark.sparkContext.getJobTags()
        spark.range(3).count()
    assert trace not in spark.sparkContext.getJobTags() and told[0]["ok"] and told[0]["name"] == "count"
    with pytest.raises(ZeroDivisionError), traced(spark, "fail", told.append):
        1 / 0  # noqa: B018
    assert not told[1]["ok"]
