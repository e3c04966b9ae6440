"""Queries on vectors, extraction records and market statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauselake.functions import packs
from clauselake.operators import compare, extract, index, market, vectors
from clauselake.plans import fixtures as X
from clauselake.plans.catalog import query
from clauselake.session import scratch_path, table

_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_NEAR = f"""
hits AS (
  SELECT b.vec_id AS query_id, a.vec_id, a.label, round_even({_DOT}, 6) AS similarity
  FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE b.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM hits)
"""


def _hits(spark, d, k, least=None, same="label"):
    e = table(spark, d, "embeddings")
    return vectors.knn(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label"), k, least, same)


@query("market_stats", f"""
WITH {_NEAR},
near AS (SELECT * FROM ranked WHERE rank <= 20 AND query_id <> vec_id AND similarity >= 0),
facts AS (SELECT n.query_id, unnest([{{'field': 'good_quality', 'value': l.quality = 1}}, {{'field': 'toxic', 'value': l.toxic = 1}}], recursive := true)
  FROM near n LEFT JOIN labels l ON n.vec_id = l.doc_id),
dist AS (SELECT query_id, field, count(*) FILTER (value) AS n_true, count(*) FILTER (NOT value) AS n_false, count(value) AS n_total,
  CASE WHEN count(value) = 0 THEN 0.0 ELSE round_even(100.0 * count(*) FILTER (value) / count(value), 1) END AS true_pct FROM facts GROUP BY ALL),
own AS (SELECT doc_id AS query_id, unnest([{{'field': 'good_quality', 'own': quality = 1}}, {{'field': 'toxic', 'own': toxic = 1}}], recursive := true) FROM labels WHERE doc_id % 50 = 0)
SELECT d.*, CASE WHEN own THEN true_pct WHEN NOT own THEN round_even(100 - true_pct, 1) END AS percentile
FROM dist d LEFT JOIN own USING (query_id, field)
""")
def market_stats(spark, d):
    """Similar clauses, their records, the market's distribution and where each query stands in it."""
    labels = table(spark, d, "labels")
    facts = F.array(F.struct(F.lit("good_quality").alias("field"), (F.col("quality") == 1).alias("value")), F.struct(F.lit("toxic").alias("field"), (F.col("toxic") == 1).alias("value")))
    near = _hits(spark, d, 20, 0.0).where("query_id <> vec_id").join(labels, F.col("vec_id") == F.col("doc_id"), "left")
    dist = market.bool_distribution(near.select("query_id", F.explode(facts).alias("f")).select("query_id", "f.*"), "query_id", "field")
    own = labels.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.explode(facts).alias("f")).select("query_id", "f.field", F.col("f.value").alias("own"))
    return dist.join(own, ["query_id", "field"], "left").select(*dist.columns, market.percentile(F.col("own"), F.col("true_pct")).alias("percentile"))


@query("knn_retrieve", f"WITH {_NEAR} SELECT query_id, vec_id, label, similarity, rank FROM ranked WHERE rank <= 5 AND similarity >= 0.1")
def knn_retrieve(spark, d):
    return _hits(spark, d, 5, 0.1)


@query("knn_excluding_self", f"WITH {_NEAR} SELECT query_id, vec_id, label, similarity, rank FROM ranked WHERE rank <= 5 AND query_id <> vec_id")
def knn_excluding_self(spark, d):
    return _hits(spark, d, 5).where("query_id <> vec_id")


@query("knn_for_benchmarking", f"WITH {_NEAR} SELECT query_id, vec_id, round_even(similarity, 4) AS similarity FROM ranked WHERE rank <= 10")
def knn_for_benchmarking(spark, d):
    return _hits(spark, d, 10).select("query_id", "vec_id", F.bround("similarity", 4).alias("similarity"))


@query("knn_index")
def knn_index(spark, d):
    """O3 through the inverted-file index: the ids divisible by 50 against all rows."""
    e = table(spark, d, "embeddings")
    path = scratch_path(spark, "knn-index")
    index.write_index(e, path, index.cells_for(e.count()))
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return index.search(spark, path, queries, 5, index.probes_for(index.cells_for(e.count()))).select("query_id", "vec_id", "label", "similarity", "rank")


@query("cosine_pairs", f"SELECT a.vec_id AS a_id, b.vec_id AS b_id, round_even({_DOT} / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    """M1 on neighbouring ids."""
    e = table(spark, d, "embeddings").select("vec_id", vectors.normalized(F.col("embedding")).alias("v"))
    b = e.select(F.col("vec_id").alias("b_id"), F.col("v").alias("w"))
    return e.join(b, F.col("b_id") == F.col("vec_id") + 1).select(F.col("vec_id").alias("a_id"), "b_id", F.bround(vectors.dot(F.col("v"), F.col("w")), 6).alias("cosine"))


@query("centroids", "SELECT label, pos - 1 AS pos, round_even(avg(x::DOUBLE), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL")
def centroids(spark, d):
    return vectors.centroids(table(spark, d, "embeddings")).select("label", F.col("pos").cast("long").alias("pos"), F.bround("mean", 6).alias("mean"))


@query("canonical_select", """
WITH c AS (SELECT label, pos, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL),
s AS (SELECT e.vec_id, e.label, CASE e.vec_id % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS severity, round_even(sum(e.x::DOUBLE * c.m), 6) AS similarity
  FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) e JOIN c USING (label, pos) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY label, severity ORDER BY similarity DESC, vec_id) AS rank FROM s)
SELECT label, severity, rank, vec_id, similarity FROM r WHERE rank <= CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END
""")
def canonical_select(spark, d):
    """Of each category and severity those nearest to the category's centroid: three, two or one."""
    from pyspark.sql import Window

    e = table(spark, d, "embeddings")
    severity = F.when(F.col("vec_id") % 3 == 0, "High").when(F.col("vec_id") % 3 == 1, "Medium").otherwise("Low")
    j = e.join(vectors.centroid_arrays(e), "label").select("label", severity.alias("severity"), "vec_id", F.bround(vectors.dot(F.col("embedding"), F.col("centroid")), 6).alias("similarity"))
    r = j.withColumn("rank", F.row_number().over(Window.partitionBy("label", "severity").orderBy(F.desc("similarity"), "vec_id")))
    r = r.where("rank <= 3")  # a bound that does not depend on the row, so that each task keeps three of a group
    return r.where(F.col("rank") <= F.when(F.col("severity") == "High", 3).when(F.col("severity") == "Medium", 2).otherwise(1)).select("label", "severity", "rank", "vec_id", "similarity")


@query("semantic_topk", f"""
WITH s AS (SELECT a.vec_id AS clause_idx, b.vec_id AS canon_idx, b.vec_id % 5 AS category, CASE b.vec_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS sev, round_even({_DOT}, 6) AS similarity
  FROM embeddings a, embeddings b WHERE b.vec_id < 30),
t AS (SELECT *, row_number() OVER (PARTITION BY clause_idx ORDER BY similarity DESC, canon_idx DESC) AS r FROM s),
u AS (SELECT *, row_number() OVER (PARTITION BY clause_idx, category ORDER BY r) AS n FROM t WHERE r <= 3 AND similarity >= 0.2)
SELECT clause_idx, canon_idx, category, ['Low', 'Medium', 'High'][greatest(0, sev - CASE WHEN similarity >= 0.68 THEN 0 WHEN similarity >= 0.55 THEN 1 ELSE 2 END) + 1] AS severity, similarity,
  least(1.0, round_even(similarity + CASE WHEN sev = 2 AND similarity >= 0.68 THEN 0.05 ELSE 0 END, 6)) AS score FROM u WHERE n = 1
""")
def semantic_topk(spark, d):
    """W1, R3, J8 with the first 30 vectors as canonical clauses."""
    e = table(spark, d, "embeddings")
    severity = F.when(F.col("vec_id") % 3 == 0, "High").when(F.col("vec_id") % 3 == 1, "Medium").otherwise("Low")
    canon = e.where("vec_id < 30").select(F.col("vec_id").alias("canon_idx"), (F.col("vec_id") % 5).alias("category"), severity.alias("severity"), "embedding")
    return vectors.semantic_finds(e.select(F.col("vec_id").alias("clause_idx"), "embedding"), canon, least=0.2)


def _bool_values(name: str) -> str:
    cases = " UNION ALL ".join(f"SELECT chunk_id, clause_type, '{f}' AS field, try_cast(json_extract_string(data, '{p}') AS BOOLEAN) AS value FROM x WHERE clause_type = '{t}'" for t, fs in packs.BOOL_FIELDS.items() for f, p in fs)
    return f"WITH x AS (SELECT * FROM {name}), v AS ({cases}) "


_VALUES = _bool_values(X.EXTRACTIONS.sql())
_DIST = "count(*) FILTER (value) AS n_true, count(*) FILTER (NOT value) AS n_false, count(value) AS n_total, CASE WHEN count(value) = 0 THEN 0.0 ELSE round_even(100.0 * count(*) FILTER (value) / count(value), 1) END AS true_pct"


@query("bool_distribution", _VALUES + f"SELECT clause_type, field, {_DIST} FROM v GROUP BY ALL")
def bool_distribution(spark, d):
    return market.bool_distribution(market.unpivot_bools(X.EXTRACTIONS.df(spark, d)), "clause_type", "field")


@query("cat_distribution", f"WITH x AS (SELECT * FROM {X.EXTRACTIONS.sql()}), v AS (" + " UNION ALL ".join(f"SELECT clause_type, '{f}' AS field, json_extract_string(data, '{p}') AS value FROM x WHERE clause_type = '{t}'" for t, fs in packs.CATEGORY_FIELDS.items() for f, p in fs) + ") SELECT clause_type, field, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL")
def cat_distribution(spark, d):
    return market.cat_distribution(market.unpivot_categories(X.EXTRACTIONS.df(spark, d)), "clause_type", "field")


@query("user_percentiles", _VALUES + f", dist AS (SELECT clause_type, field, {_DIST} FROM v GROUP BY ALL) SELECT u.clause_type, u.field, true_pct, CASE WHEN u.value THEN true_pct WHEN NOT u.value THEN round_even(100 - true_pct, 1) END AS percentile FROM {X.USER.sql()} u JOIN dist USING (clause_type, field)")
def user_percentiles(spark, d):
    dist = market.bool_distribution(market.unpivot_bools(X.EXTRACTIONS.df(spark, d)), "clause_type", "field")
    return X.USER.df(spark, d).join(dist, ["clause_type", "field"]).select("clause_type", "field", "true_pct", market.percentile(F.col("value"), F.col("true_pct")).alias("percentile"))


@query("composite_percentile", _VALUES + f", dist AS (SELECT clause_type, field, {_DIST} FROM v GROUP BY ALL), p AS (SELECT u.clause_type, CASE WHEN u.value THEN true_pct WHEN NOT u.value THEN 100 - true_pct END AS p FROM {X.USER.sql()} u JOIN dist USING (clause_type, field)), c AS (SELECT clause_type, coalesce(floor(avg(p) + 0.5), 50)::BIGINT AS composite FROM p GROUP BY ALL) SELECT *, CASE WHEN composite >= 60 THEN 'favorable' WHEN composite >= 40 THEN 'neutral' ELSE 'unfavorable' END AS verdict FROM c")
def composite_percentile(spark, d):
    return market.composite(user_percentiles(spark, d), "clause_type")


@query("bench_join_extractions", f"SELECT c.chunk_id, c.clause_type, c.contract_id, e.data, coalesce(k.company, '') AS company, k.filed_date FROM {X.CHUNKS.sql()} c LEFT JOIN {X.EXTRACTIONS.sql()} e ON c.chunk_id = e.chunk_id AND c.clause_type = e.clause_type LEFT JOIN {X.CONTRACTS.sql()} k ON c.contract_id = k.contract_id")
def bench_join_extractions(spark, d):
    return market.benchmark_rows(X.CHUNKS.df(spark, d), X.EXTRACTIONS.df(spark, d), X.CONTRACTS.df(spark, d)).select("chunk_id", "clause_type", "contract_id", "data", "company", "filed_date")


_TYPES = X.Fixture("clause_type string", [(t,) for t in packs.CLAUSE_TYPES])


@query("corpus_coverage", f"WITH c AS (SELECT clause_type, count(*) AS n_chunks FROM {X.CHUNKS.sql()} GROUP BY 1), e AS (SELECT clause_type, count(*) AS n_extractions FROM {X.EXTRACTIONS.sql()} GROUP BY 1) SELECT t.clause_type, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_extractions, 0) AS n_extractions, coalesce(round_even(100.0 * coalesce(n_extractions, 0) / n_chunks, 1), 0.0) AS coverage_pct FROM {_TYPES.sql()} t LEFT JOIN c USING (clause_type) LEFT JOIN e USING (clause_type)")
def corpus_coverage(spark, d):
    return market.coverage(X.CHUNKS.df(spark, d), X.EXTRACTIONS.df(spark, d), _TYPES.df(spark))


@query("label_coverage", "SELECT d.source, count(*) AS n_docs, count(l.doc_id) AS n_labelled, round_even(100.0 * count(l.doc_id) / count(*), 1) AS coverage_pct FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def label_coverage(spark, d):
    """A8, A10 on the large tables: labelled documents by source."""
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("one")), "doc_id", "left")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count("one").alias("n_labelled")).withColumn("coverage_pct", market.percent(F.col("n_labelled"), F.col("n_docs")))


@query("corpus_stats", f"SELECT clause_type, count(*) AS n_chunks, count(*) FILTER (embedded) AS n_embedded, count(DISTINCT contract_id) AS n_contracts FROM {X.CHUNKS.sql()} GROUP BY 1")
def corpus_stats(spark, d):
    return X.CHUNKS.df(spark, d).groupBy("clause_type").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if("embedded").alias("n_embedded"), F.count_distinct("contract_id").alias("n_contracts"))


@query("pending_chunks", f"SELECT * FROM (SELECT * FROM {X.CHUNKS.sql()} WHERE clause_type = 'liability' ORDER BY chunk_id LIMIT 5) c WHERE NOT EXISTS (SELECT 1 FROM {X.EXTRACTIONS.sql()} e WHERE e.chunk_id = c.chunk_id AND e.clause_type = 'liability')")
def pending_chunks(spark, d):
    return market.pending(X.CHUNKS.df(spark, d), X.EXTRACTIONS.df(spark, d), "liability", 5)


@query("market_context", _VALUES + f", dist AS (SELECT clause_type, field, {_DIST} FROM v GROUP BY ALL) SELECT clause_type, string_agg('- ' || field || ': ' || printf('%.1f', true_pct) || '% of ' || n_total, chr(10) ORDER BY field) AS context FROM dist WHERE clause_type = 'liability' GROUP BY 1")
def market_context(spark, d):
    return market.market_context(bool_distribution(spark, d), "liability")


@query("unexpected_keys", f"SELECT chunk_id, list_aggregate(list_sort(list_filter(json_keys(data), lambda k: NOT list_contains(['liability_cap','is_mutual','has_carve_outs','consequential_damages','has_indemnification','has_warranty_disclaimer'], k))), 'string_agg', ',') AS extra FROM {X.EXTRACTIONS.sql()} WHERE clause_type = 'liability'")
def unexpected_keys(spark, d):
    """top-level keys that a record's schema does not have."""
    expected = F.array(*[F.lit(k) for k in ("liability_cap", "is_mutual", "has_carve_outs", "consequential_damages", "has_indemnification", "has_warranty_disclaimer")])
    extra = F.array_sort(F.array_except(F.json_object_keys("data"), expected))
    return X.EXTRACTIONS.df(spark, d).where("clause_type = 'liability'").select("chunk_id", F.nullif(F.array_join(extra, ","), F.lit("")).alias("extra"))


@query("field_comparison", f"SELECT grp, field, max(CASE WHEN name = 'A' THEN value::VARCHAR END) AS A, max(CASE WHEN name = 'B' THEN value::VARCHAR END) AS B, max(CASE WHEN name = 'C' THEN value::VARCHAR END) AS C, count(value) >= 2 AND count(DISTINCT value) > 1 AS differs FROM {X.COMPARED.sql()} GROUP BY grp, field")
def field_comparison(spark, d):
    return compare.field_comparison(X.COMPARED.df(spark, d), ["A", "B", "C"], group=("grp",)).withColumn("differs", F.coalesce("differs", F.lit(False)))


_BAD = ", ".join(f"'{f}'" for f in packs.UNFAVORABLE)


@query("favorable_score", f"SELECT grp, name, count(*) FILTER (value <> (field IN ({_BAD}))) AS favorable, count(value) AS stated FROM {X.COMPARED.sql()} GROUP BY grp, name")
def favorable_score(spark, d):
    return compare.favorable_scores(X.COMPARED.df(spark, d), "grp", "name")


@query("recommendation", f"""
WITH s AS (SELECT grp, ord, name, count(*) FILTER (value <> (field IN ({_BAD}))) AS favorable, count(value) AS stated FROM {X.COMPARED.sql()} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY favorable DESC, ord) AS r, max(favorable) OVER (PARTITION BY grp) AS best FROM s),
g AS (SELECT grp, max(name) FILTER (r = 1) AS leader, max(best) AS best, string_agg(name, ' and ' ORDER BY ord) FILTER (favorable = best) AS tied, max(best) - coalesce(max(favorable) FILTER (r = 2), 0) AS lead, coalesce(max(name) FILTER (r = 2), '') AS second, count(*) FILTER (favorable = best) AS n_best, max(stated) AS "of" FROM r GROUP BY grp)
SELECT *, CASE WHEN "of" = 0 THEN 'Could not determine a recommendation — extraction failed for all contracts.' WHEN n_best > 1 THEN tied || ' are tied with ' || best || ' favorable fields out of ' || "of" || ' evaluated.' ELSE leader || ' provides stronger protections with ' || best || ' favorable fields out of ' || "of" || ' evaluated, leading ' || second || ' by ' || lead || ' field(s).' END AS recommendation FROM g
""")
def recommendation(spark, d):
    """A35, W7 and the sentence of X9."""
    scores = compare.favorable_scores(X.COMPARED.df(spark, d), "grp", "ord", "name")
    return compare.advice(compare.recommendation(scores, "grp"))


@query("comparison_problems", "SELECT o_custkey, count(*) AS n, CASE WHEN count(*) < 2 THEN 'too few' WHEN count(*) > 5 THEN 'too many' WHEN o_custkey % 3 = 0 THEN 'unknown type' END AS problem FROM orders GROUP BY o_custkey")
def comparison_problems(spark, d):
    """orders of a customer as contracts to compare."""
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("o_custkey") % 3 == 0, "lease").otherwise("liability")
    return g.withColumn("problem", compare.comparison_problem(F.col("n"), kind))


@query("user_fields", f"WITH x AS {X.EXTRACTIONS.sql()} " + "SELECT chunk_id, field, value::VARCHAR AS value FROM (" + " UNION ALL ".join(f"SELECT chunk_id, '{f}' AS field, json_extract_string(data, '{p}') AS value FROM x WHERE clause_type = '{t}'" for t, fs in packs.BOOL_FIELDS.items() for f, p in fs) + ")")
def user_fields(spark, d):
    """X7 for every field of every record."""
    x, out = X.EXTRACTIONS.df(spark, d), None
    for t, fields in packs.BOOL_FIELDS.items():
        listed = F.array(*[F.struct(F.lit(f).alias("field"), extract.user_field("data", f, t).alias("value")) for f, _ in fields])
        rows = x.where(F.col("clause_type") == t).select("chunk_id", F.explode(listed).alias("s")).select("chunk_id", "s.*")
        out = rows if out is None else out.unionByName(rows)
    return out


_ANSWERS = X.Derived("events", id="event_id", answer="CASE event_id % 5 WHEN 0 THEN concat('{\"summary\":\"s', CAST(event_id AS STRING), '\",\"suggestions\":[{\"original_text\":\"a\",\"proposed_text\":\"b', CAST(user_id AS STRING), '\",\"priority\":\"high\"},{\"original_text\":\"\",\"proposed_text\":\"\"},{\"original_text\":\"c\"}]}') WHEN 1 THEN 'no json' WHEN 2 THEN '{\"summary\":\"none\",\"suggestions\":[]}' WHEN 3 THEN '{\"suggestions\":[{\"proposed_text\":\"x\",\"market_citation\":\"m\"}]}' END")


@query("redlines", f"""
WITH a AS {_ANSWERS.sql()},
s AS (SELECT id, j, unnest(CASE WHEN json_type(j, '$.suggestions') = 'ARRAY' THEN json_extract(j, '$.suggestions[*]') ELSE [] END) AS s, generate_subscripts(CASE WHEN json_type(j, '$.suggestions') = 'ARRAY' THEN json_extract(j, '$.suggestions[*]') ELSE [] END, 1) AS n FROM (SELECT id, CASE WHEN json_valid(answer) THEN answer END AS j FROM a)),
u AS (SELECT id, n, coalesce(s->>'original_text', '') AS original, coalesce(s->>'proposed_text', '') AS proposed, coalesce(s->>'market_citation', '') AS citation, coalesce(s->>'priority', 'medium') AS priority FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS ord FROM u WHERE original <> '' OR proposed <> '')
SELECT a.id, CASE WHEN answer IS NULL OR NOT json_valid(answer) THEN 'Redline generation failed. Please try again.' ELSE coalesce(answer->>'summary', '') END AS summary, ord, coalesce(original, '') AS original, coalesce(proposed, '') AS proposed, coalesce(citation, '') AS citation, coalesce(priority, 'medium') AS priority FROM a LEFT JOIN k USING (id)
""")
def redlines(spark, d):
    """X8 from the answers of a model."""
    return extract.redlines(_ANSWERS.df(spark, d), ("id",)).select("id", "summary", F.col("ord").cast("long").alias("ord"), "original", "proposed", "citation", "priority")


@query("usable_suggestions", f"SELECT id, ord, coalesce(original, '') AS original, coalesce(proposed, '') AS proposed, coalesce(priority, 'medium') AS priority FROM {X.SUGGESTIONS.sql()} WHERE coalesce(original, '') <> '' OR coalesce(proposed, '') <> ''")
def usable_suggestions(spark, d):
    return compare.usable_suggestions(X.SUGGESTIONS.df(spark, d))
