"""Queries on summaries, comparisons of back ends, upserts with defaults and whole benchmarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauselake.functions import packs
from clauselake.operators import evaluate, learn, market
from clauselake.plans import fixtures as X
from clauselake.plans import queries_eval as E
from clauselake.plans import queries_market as M
from clauselake.plans.catalog import query
from clauselake.sources import tables
from clauselake.session import table
from clauselake.streaming import quotas

_LONG = X.Derived("events", backend=X.pick(X.part("event_id", 24), "own", "small", "large"), clause_type=X.pick(X.part("event_id", 6), *packs.CLAUSE_TYPES), id=X.part("event_id", 6), field="concat('f', CAST(event_id % 6 AS STRING))", truth="CASE WHEN user_id % 4 < 3 THEN user_id % 4 < 2 END", pred="CASE WHEN event_id % 7 < 6 THEN (event_id + user_id) % 5 < 3 END")


@query("model_comparison", f"""
WITH c AS (SELECT backend, clause_type, id, count(*) FILTER (coalesce(truth, FALSE) AND coalesce(pred, FALSE)) AS tp, count(*) FILTER (NOT coalesce(truth, FALSE) AND coalesce(pred, FALSE)) AS fp, count(*) FILTER (coalesce(truth, FALSE) AND NOT coalesce(pred, FALSE)) AS fn FROM {_LONG.sql()} GROUP BY ALL),
m AS (SELECT backend, clause_type, {E._RATIO.format(a='tp', b='(tp + fp)')} AS precision, {E._RATIO.format(a='tp', b='(tp + fn)')} AS recall, {E._RATIO.format(a='(2 * tp)', b='(2 * tp + fp + fn)')} AS f1 FROM c)
SELECT backend, clause_type, count(*) AS n, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM m GROUP BY ALL
""")
def model_comparison(spark, d):
    """M9."""
    return evaluate.model_comparison(_LONG.df(spark, d))


_KINDS = " UNION ALL ".join([f"SELECT 'severity' AS kind, '{s}' AS value" for s in ("High", "Medium", "Low")] + [f"SELECT 'category', '{c}'" for c in packs.RULES])


@query("category_breakdown", f"""
WITH f AS {X.CONFIGS.sql()}, l AS (SELECT config, 'severity' AS kind, severity AS value FROM f UNION ALL SELECT config, 'category', category FROM f),
n AS (SELECT config, kind, value, count(*) AS n FROM l GROUP BY ALL)
SELECT c.config, k.kind, k.value, coalesce(n, 0) AS n FROM (SELECT DISTINCT config FROM f) c, ({_KINDS}) k LEFT JOIN n ON n.config = c.config AND n.kind = k.kind AND n.value = k.value
""")
def category_breakdown(spark, d):
    """A28 with zeros."""
    return evaluate.category_breakdown(X.CONFIGS.df(spark, d), tuple(packs.RULES))


_SUMMARY = f"(WITH x AS (SELECT DISTINCT * FROM {X.EXPECTED.sql()}), f AS (SELECT * FROM {X.CONFIGS.sql()}), h AS (SELECT config, count(*) AS hit FROM (SELECT DISTINCT config, clause, category FROM f) JOIN x USING (clause, category) GROUP BY 1) SELECT config, count(*) AS n, round(coalesce(max(hit), 0)::DOUBLE / (SELECT count(*) FROM x), 6) AS r FROM f LEFT JOIN h USING (config) GROUP BY 1)"


@query("best_config", f"SELECT config, r AS recall FROM {_SUMMARY} ORDER BY r DESC, list_position(['ml', 'all', 'regex'], config) LIMIT 1")
def best_config(spark, d):
    """The best subset of layers."""
    return evaluate.best_config(E.detection_recall(spark, d), ["ml", "all", "regex"])


@query("marginal_from_nothing", f"WITH s AS {_SUMMARY} SELECT 'none' AS base, config AS enhanced, n AS delta, 'inf'::DOUBLE AS delta_pct, round_even(100 * r, 1) AS recall_pp FROM s WHERE config = 'all'")
def marginal_from_nothing(spark, d):
    """A29 over a config that found nothing."""
    return evaluate.marginal(E.detection_recall(spark, d), [("none", "all")])


@query("eval_summary", E._counts_sql() + f", m AS ({E._METRICS}) SELECT round_even(avg(f1) FILTER (field IN ('has_a', 'has_b')), 3) AS macro_f1_core, round_even(avg(f1), 3) AS macro_f1_all, (SELECT round_even(avg(p_found::INT::DOUBLE), 3) FROM j) AS success_rate, (SELECT round_even(avg(CASE WHEN kind = 'x' THEN 1.0 ELSE 0.8 END::DOUBLE), 3) FROM j) AS avg_grounding, round_even(avg(f1) FILTER (field IN ('has_a', 'has_b')), 3) >= 0.75 AS passed FROM m WHERE total > 0")
def eval_summary(spark, d):
    """A19."""
    j = E._joined(spark, d).withColumn("g", F.when(F.col("kind") == "x", 1.0).otherwise(0.8))
    return evaluate.eval_summary(j, E.field_metrics(spark, d), ["has_a", "has_b"], "g")


@query("coverage_report", f"WITH c AS (SELECT clause_type, count(*) AS n_chunks FROM {X.CHUNKS.sql()} WHERE clause_type <> 'ip' GROUP BY 1), e AS (SELECT clause_type, count(*) AS n_extractions FROM {X.EXTRACTIONS.sql()} WHERE clause_type <> 'ip' GROUP BY 1) SELECT t.clause_type, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_extractions, 0) AS n_extractions, coalesce(round_even(100.0 * coalesce(n_extractions, 0) / n_chunks, 1), 0.0) AS coverage_pct, CASE WHEN n_chunks IS NULL THEN 'N/A' ELSE printf('%.1f%%', round_even(100.0 * coalesce(n_extractions, 0) / n_chunks, 1)) END AS coverage FROM {M._TYPES.sql()} t LEFT JOIN c USING (clause_type) LEFT JOIN e USING (clause_type)")
def coverage_report(spark, d):
    """A10: a type without chunks says N/A."""
    return market.coverage_report(market.coverage(X.CHUNKS.df(spark, d).where("clause_type <> 'ip'"), X.EXTRACTIONS.df(spark, d).where("clause_type <> 'ip'"), M._TYPES.df(spark)))


_EXAMPLES = X.Derived("documents", category=X.pick("doc_id", *packs.RULES, None), severity="CASE WHEN doc_id % 6 < 5 THEN " + X.pick(X.part("doc_id", 6), "High", "Medium", "Low") + " END", source="source")


@query("dataset_stats", f"SELECT source, coalesce(category, 'none') AS category, coalesce(severity, 'none') AS severity, count(*) AS n FROM {_EXAMPLES.sql()} GROUP BY ALL")
def dataset_stats(spark, d):
    """A34 by source."""
    return learn.dataset_stats(_EXAMPLES.df(spark, d))


_OLD = X.Derived("orders", chunk="o_orderkey", part="o_orderkey % 3", kind="CASE WHEN o_orderkey % 2 = 0 THEN 'payment' END", header="CASE WHEN o_orderkey % 5 < 3 THEN 'ip' END", n="o_custkey")
_NEW = X.Derived("orders", "o_orderkey % 4 = 1", chunk="CASE WHEN o_orderkey % 8 = 1 THEN o_orderkey ELSE -o_orderkey END", part="o_orderkey % 3", kind="CASE WHEN o_orderkey % 3 = 0 THEN 'liability' END", header="CASE WHEN o_orderkey % 7 < 4 THEN 'ip' END", n="CASE WHEN o_orderkey % 11 > 0 THEN 7 END")


@query("upsert_chunks", f"WITH n AS (SELECT chunk, part, coalesce(kind, header, 'other') AS kind, coalesce(header, '') AS header, coalesce(n, 0) AS n FROM {_NEW.sql()}) SELECT * FROM n UNION ALL SELECT * FROM {_OLD.sql()} o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.chunk = o.chunk AND n.part = o.part)")
def upsert_chunks(spark, d):
    """K1, K2: two columns as key, and what missing values fall back to."""
    new = tables.with_defaults(_NEW.df(spark, d), {"kind": F.coalesce("header", F.lit("other")), "header": "", "n": 0})
    return tables.upsert(_OLD.df(spark, d), new, ["chunk", "part"])


@query("records_of_hits", f"SELECT chunk_id, clause_type FROM {X.EXTRACTIONS.sql()} WHERE (chunk_id, clause_type) IN (SELECT chunk_id, clause_type FROM {X.RETRIEVED.sql()})")
def records_of_hits(spark, d):
    """F2, J3 as a semi-join."""
    return market.for_keys(X.EXTRACTIONS.df(spark, d), X.RETRIEVED.df(spark, d), "chunk_id", "clause_type").select("chunk_id", "clause_type")


_QUERIES = X.Derived("orders", "o_orderkey % 50 = 0", query_id="o_orderkey", clause_type=X._KIND, data=X.EXTRACTIONS.exprs["data"])
_BENCH = X.Derived("orders", "o_orderkey % 50 > 0 AND o_orderkey % 250 < 200", query_id=f"o_orderkey - o_orderkey % 50", chunk_id="o_orderkey", contract_id="concat('c', CAST(o_custkey AS STRING))", clause_type=X._KIND, rank="o_orderkey % 50")
_OWN = " UNION ALL ".join(f"SELECT query_id, '{f}' AS field, try_cast(json_extract_string(data, '{p}') AS BOOLEAN) AS own FROM q WHERE clause_type = '{t}'" for t, fs in packs.BOOL_FIELDS.items() for f, p in fs)
_SEEN = " UNION ALL ".join(f"SELECT query_id, '{f}' AS field, try_cast(json_extract_string(data, '{p}') AS BOOLEAN) AS value FROM r WHERE clause_type = '{t}'" for t, fs in packs.BOOL_FIELDS.items() for f, p in fs)


@query("benchmark_clauses", f"""
WITH q AS {_QUERIES.sql()}, h AS {_BENCH.sql()}, e AS {X.EXTRACTIONS.sql()}, k AS {X.CONTRACTS.sql()},
r AS (SELECT h.*, e.data, coalesce(k.company, '') AS company FROM h LEFT JOIN e ON h.chunk_id = e.chunk_id AND h.clause_type = e.clause_type LEFT JOIN k ON h.contract_id = k.contract_id),
z AS (SELECT query_id, count(data) AS sample_size FROM r GROUP BY 1),
v AS ({_SEEN}), o AS ({_OWN}),
dist AS (SELECT query_id, field, round_even(100.0 * count(*) FILTER (value) / count(value), 1) AS pct FROM v GROUP BY ALL HAVING count(value) > 0),
p AS (SELECT o.query_id, CASE WHEN own THEN pct WHEN NOT own THEN round_even(100 - pct, 1) END AS p FROM o JOIN dist USING (query_id, field)),
c AS (SELECT query_id, coalesce((2 * sum(round(10 * p)::BIGINT) + 10 * count(p)) // nullif(20 * count(p), 0), 50)::BIGINT AS composite FROM p GROUP BY 1),
t AS (SELECT query_id, string_agg(company, '|' ORDER BY rank, chunk_id) AS cited FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS n FROM r WHERE data IS NOT NULL) WHERE n <= 5 GROUP BY 1)
SELECT q.query_id, coalesce(sample_size, 0) AS sample_size, CASE WHEN sample_size > 0 THEN coalesce(composite, 50) END AS composite,
  CASE WHEN sample_size > 0 THEN CASE WHEN coalesce(composite, 50) >= 60 THEN 'favorable' WHEN coalesce(composite, 50) >= 40 THEN 'neutral' ELSE 'unfavorable' END END AS verdict, coalesce(cited, '') AS cited
FROM q LEFT JOIN z USING (query_id) LEFT JOIN c USING (query_id) LEFT JOIN t USING (query_id)
""")
def benchmark_clauses(spark, d):
    """X5 from the hits on, for every fiftieth order as the clause of a user."""
    return market.benchmark(_QUERIES.df(spark, d), _BENCH.df(spark, d), X.EXTRACTIONS.df(spark, d), X.CONTRACTS.df(spark, d))


@query("quota_limits")
def quota_limits(spark, d):
    """ST3: four quotas of each user at once, in the order of events; refused ones use nothing."""
    return quotas.quotas(table(spark, d, "events"))
