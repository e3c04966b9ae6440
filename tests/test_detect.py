import random

import pytest

from clauselake.functions import packs
from clauselake.operators import detect


def plain_dedup(risks, threshold):
    order = {"High": 3, "Medium": 2, "Low": 1}
    kept = []
    for r in sorted(risks, key=lambda r: -order[r[2]]):
        w = set((r[3] or "").lower().split())
        if not any(len(w | o) and len(w & o) / len(w | o) >= threshold for o in kept):
            kept.append(w)
            yield r[1]


@pytest.mark.parametrize("threshold", [0.7, 0.5])
def test_greedy_dedup_against_plain(spark, threshold):
    r = random.Random(5)
    vocab = [f"w{k}" for k in range(40)]
    rows = []
    for doc in range(60):
        texts = []
        for i in range(r.randrange(0, 25)):
            if texts and r.random() < 0.3:
                w = r.choice(texts).split()
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
            else:
                w = [r.choice(vocab) for _ in range(r.randrange(0, 15))]
            texts.append(" ".join(w))
            rows.append((doc, i, r.choice(packs.SEVERITIES), texts[-1] if texts[-1] or r.random() < 0.5 else None))
    df = spark.createDataFrame(rows, "doc_id long, ord long, severity string, snippet string")
    got = {(x["doc_id"], x["ord"]) for x in detect.greedy_dedup(df, "doc_id", "ord", threshold=threshold).collect()}
    want = {(doc, o) for doc in range(60) for o in plain_dedup([x for x in rows if x[0] == doc], threshold)}
    assert got == want


@pytest.mark.parametrize(("risk_type", "severity", "score", "want"), [("Liability Risk", "Low", 0.45, 27), ("Liability Risk", "High", 0.85, 78), ("Liability Risk", "High", 1.0, 80), ("Financial Risk", "Medium", 0.65, 51), ("Compliance Risk", "High", 1.0, 84), ("Privacy/Data Risk", "High", 0.85, 71), ("Contractual Ambiguity", "Medium", 0.8, 49)])
def test_known_scores(spark, risk_type, severity, score, want):
    df = spark.createDataFrame([(risk_type, severity, score, "regex", None, False)], "risk_type string, severity string, score double, source string, similarity double, escalated boolean")
    assert detect.finalize(df).first()["score100"] == want


def test_analyze(spark):
    docs = spark.createDataFrame([(1, "The Company shall indemnify and hold harmless the Client."), (2, ""), (3, None)], "doc_id long, text string")
    got = detect.analyze(docs).collect()
    assert [(r["doc_id"], r["risk_type"], r["score100"], r["band"], r["rank"]) for r in got] == [(1, "Liability Risk", 80, "High", 1)]
    assert "indemnif" in got[0]["explanation"] and "Evidence: indemnify" in got[0]["explanation"]
    with pytest.raises(ValueError):
        detect.analyze(docs, layers=("regex", "other"))
    assert detect.analyze(docs, layers=()).count() == 0
    overall = {r["doc_id"]: r["overall_level"] for r in detect.overall_risk(docs, detect.analyze(docs)).collect()}
    assert overall == {1: "High", 2: "Low", 3: "Low"}


def test_layers(spark):
    """Each named layer runs by itself; by default a classifier takes the place of the rules; only a merge joins and
    escalates."""
    clauses = spark.createDataFrame([(1, 0, "The Company shall indemnify the Client and pay an escrow deposit."), (2, 0, "Nothing of note is said here.")], "doc_id long, clause_idx int, clause string")
    ml = spark.createDataFrame([(1, 0, "Liability Risk", "Medium", 0.8), (2, 0, "Financial Risk", "Low", 0.6)], "doc_id long, clause_idx int, risk_type string, severity string, confidence double")
    sem = spark.createDataFrame([(1, 0, "Liability Risk", "Medium", 0.7, 0.7, "indemnify", "s"), (2, 0, "Compliance Risk", "Low", 0.5, 0.5, "law", "t")], "doc_id long, clause_idx int, risk_type string, severity string, score double, similarity double, keyword string, snippet string")

    def run(layers, threshold=None):
        return sorted((r["doc_id"], r["risk_type"], r["source"], r["severity"], r["score"], r["escalated"]) for r in detect.analyze_clauses(clauses, layers, ml, sem, threshold=threshold).collect())

    strong, weak = (1, "Liability Risk", "ml_strong", "Medium", 0.725, False), (2, "Financial Risk", "ml_weak", "Low", 0.525, False)
    assert run(("ml",)) == [strong, weak]
    rules = run(("regex",))
    assert [(r[1], r[2]) for r in rules] == [("Financial Risk", "regex"), ("Liability Risk", "regex")]
    assert run(("semantic",)) == [(1, "Liability Risk", "semantic", "Medium", 0.7, False), (2, "Compliance Risk", "semantic", "Low", 0.5, False)]
    assert run(("regex", "ml", "semantic")) == sorted(rules + run(("ml",)) + run(("semantic",)))
    merged = run(None)  # the classifier instead of the rules
    assert merged == [(1, "Liability Risk", "both", "High", round(0.55 * 0.725 + 0.45 * 0.7 + 0.08, 3), False), (2, "Compliance Risk", "semantic", "Low", 0.5, False), weak]
    both = run(("regex", "semantic", "merge"))
    assert [(r[0], r[1], r[2]) for r in both] == [(1, "Financial Risk", "regex"), (1, "Liability Risk", "both"), (2, "Compliance Risk", "semantic")]


def plain_scores(rows):
    """Escalation and scores of one document's finds (clause, risk_type, severity, score, order), by their definition."""
    from collections import defaultdict

    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = []
    for clause, risk_type, severity, score, o in rows:
        group = by[clause]
        up = severity == "Medium" and any(r[2] == "High" for r in group) and len({r[1] for r in group}) > 1
        if up:
            severity, score = "High", round(min(1.0, score + 0.05), 3)
        primary = min(100, max(0, packs.INTENSITY[severity] + round(max(0.0, score - 0.6) * 10) + (8 if up else 0)))
        w = packs.WEIGHTS[risk_type]
        total = round(round(sum(round(primary * (0.6 + 0.4 * x)) * x for x in w.values()), 6))
        out.append((clause, risk_type, min(100, max(0, total)), o))
    return out


def test_analyze_query_against_plain(spark):
    from clauselake.functions import text
    from clauselake.plans import catalog
    from clauselake.plans import fixtures as X
    from pyspark.sql import functions as F
    from tests import duck

    docs = X.CLAUSES.df(spark, duck.DATA)
    clauses = docs.select("doc_id", F.posexplode(text.clauses(F.col("clause"))).alias("clause_idx", "clause"))
    hits = {}
    for r in detect.rule_scan(clauses).collect():
        hits.setdefault(r["doc_id"], []).append((r["clause_idx"], r["rule_ord"], r["match_ord"], r["risk_type"], r["severity"], r["score"], r["snippet"]))
    want = set()
    for doc, rows in hits.items():
        rows.sort()
        kept = set(plain_dedup([(doc, i, r[4], r[6]) for i, r in enumerate(rows)], 0.7))
        scored = plain_scores([(r[0], r[3], r[4], r[5], i) for i, r in enumerate(rows) if i in kept])
        for k, (clause, risk_type, score, _) in enumerate(sorted(scored, key=lambda s: (-s[2], s[3]))):
            want.add((doc, clause, risk_type, score, k + 1))
    got = {(r["doc_id"], r["clause_idx"], r["risk_type"], r["score100"], r["rank"]) for r in catalog.queries()["analyze_regex"](spark, duck.DATA).collect()}
    assert got == want and len(got) > 100


def test_analyze_document_against_sections(spark):
    """A document of sections equals its sections analyzed one by one, numbered on, without what repeats."""
    head = ["ARTICLE I. PAYMENT", "ARTICLE II. LIABILITY", "ARTICLE III. PAYMENT AGAIN"]
    filler = " ".join(f"word{k}" for k in range(45)) + "."
    body = ["The penalty is large for late parties here. Money is held in escrow by a third person.", "The Company shall indemnify and hold harmless the Client.", "The penalty is large for late parties here. A new currency risk is taken by the Client."]
    doc = "\n".join(f"{h}\n{filler} {b}" for h, b in zip(head, body, strict=True))
    found = detect.analyze_document(spark.createDataFrame([(1, doc), (2, None)], "doc_id long, text string")).orderBy("rank").collect()
    assert {"Liability Risk", "Financial Risk"} <= {r["risk_type"] for r in found} and {r["doc_id"] for r in found} == {1}
    assert [r["rank"] for r in found] == list(range(1, len(found) + 1))
    assert [r["score100"] for r in found] == sorted((r["score100"] for r in found), reverse=True)
    assert sum("penalty" in r["snippet"] for r in found) == 1  # boilerplate that repeats is told once
    at = {r["snippet"]: r["clause_idx"] for r in found}
    assert at[next(s for s in at if "escrow" in s)] < at[next(s for s in at if "indemnify" in s)] < at[next(s for s in at if "currency" in s)]


def test_needed_strings():
    """Every match of a rule has one of the strings that the rule is run for."""
    import re

    assert all(detect.needed(r[2]) for r in packs.rule_rows())
    assert detect.needed(r"\b(?:a|b)\b") == [] and detect.needed(r"\bab?c+d\b") == ["a"]
    texts = ["the GDPR", "PCI-DSS", "anti-bribery and anticorruption", "SANCTIONS", "as is", "no warranties", "auto-renew", "net 30", "penalties", "interest charges of 1.5 %", "right of offset", "at its sole discretion", "as we deem fit", "standard practice", "PII", "opt-out"]
    for _, _, pattern, *_ in packs.rule_rows():
        for t in texts:
            for m in re.finditer(pattern, t, re.IGNORECASE):
                assert any(s in m[0].lower() for s in detect.needed(pattern))


def test_greedy_dedup_query_takes_whole_documents(spark, tmp_path):
    """Clauses far into a long document are compared and returned."""
    from __spark_entry__ import queries

    r = random.Random(7)
    clauses = [f"Clause {' '.join(f'w{r.randrange(400)}' for _ in range(12))}." for _ in range(700)]
    clauses[650] = clauses[3].replace("Clause", "Section")
    clauses[690] = clauses[640]
    spark.createDataFrame([(1, " ".join(clauses)), (2, " ".join(clauses[:5]))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(x["doc_id"], x["ord"]) for x in queries()["greedy_dedup"](spark, str(tmp_path)).collect()}
    rows = [(1, i, "High", c) for i, c in enumerate(clauses)]
    want = set(plain_dedup(rows, 0.7))
    assert {650, 690}.isdisjoint(want) and {649, 651, 699} <= want
    assert got == {(1, i) for i in want} | {(2, i) for i in range(5)}
