"""Queries on evaluation, sources, upserts and service state."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauselake.operators import evaluate, passages
from clauselake.plans import fixtures as X
from clauselake.plans.catalog import query
from clauselake.session import table
from clauselake.sources import tables
from clauselake.streaming import state


def _joined(spark, d):
    return evaluate.join_predictions(X.TRUTH.df(spark, d), X.PREDICTED.df(spark, d))


_JOIN = f"(SELECT t.*, p.has_a AS p_has_a, p.has_b AS p_has_b, p.kind AS p_kind, coalesce(NOT p.failed, FALSE) AS p_found FROM {X.TRUTH.sql()} t LEFT JOIN (SELECT * FROM {X.PREDICTED.sql()} QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1) p USING (id))"


@query("eval_join", f"SELECT * FROM {_JOIN}")
def eval_join(spark, d):
    return _joined(spark, d)


def _counts_sql() -> str:
    out = []
    for f in ("has_a", "has_b"):
        t, p = f"coalesce({f}, FALSE)", f"coalesce(p_{f}, FALSE)"
        out.append(f"SELECT '{f}' AS field, count(*) FILTER (p_found AND {t} AND {p}) AS tp, count(*) FILTER (p_found AND NOT {t} AND {p}) AS fp, count(*) FILTER (p_found AND {t} AND NOT {p} OR NOT p_found AND {t}) AS fn, count(*) FILTER (p_found AND NOT {t} AND NOT {p} OR NOT p_found AND NOT {t}) AS tn, count(*) AS total FROM j")
    out.append("SELECT 'kind', count(*) FILTER (p_found AND kind IS NOT NULL AND kind = p_kind), count(*) FILTER (p_found AND kind IS NOT NULL AND kind IS DISTINCT FROM p_kind), count(*) FILTER (p_found AND kind IS NOT NULL AND kind IS DISTINCT FROM p_kind OR NOT p_found AND coalesce(kind, '') <> ''), count(*) FILTER (NOT p_found AND coalesce(kind, '') = ''), count(*) FILTER (NOT p_found OR kind IS NOT NULL) FROM j")
    return f"WITH j AS {_JOIN}, c AS ({' UNION ALL '.join(out)}) "


_RATIO = "CASE WHEN {b} = 0 THEN 0.0 ELSE round_even({a}::DOUBLE / ({b}), 3) END"
_METRICS = f"SELECT *, {_RATIO.format(a='tp', b='(tp + fp)')} AS precision, {_RATIO.format(a='tp', b='(tp + fn)')} AS recall, {_RATIO.format(a='(2 * tp)', b='(2 * tp + fp + fn)')} AS f1, {_RATIO.format(a='(tp + tn)', b='total')} AS accuracy FROM c"


@query("eval_confusion", _counts_sql() + "SELECT * FROM c")
def eval_confusion(spark, d):
    return evaluate.confusion(_joined(spark, d), ["has_a", "has_b"], ["kind"])


@query("metrics_in_order", _counts_sql() + f", m AS ({_METRICS}) SELECT *, row_number() OVER (ORDER BY field) AS place FROM m")
def metrics_in_order(spark, d):
    return evaluate.in_order(field_metrics(spark, d))


@query("field_metrics", _counts_sql() + _METRICS)
def field_metrics(spark, d):
    return evaluate.field_metrics(eval_confusion(spark, d))


@query("macro_f1", _counts_sql() + f", m AS ({_METRICS}) SELECT round_even(avg(f1), 3) AS macro_f1, count(*) AS n_fields, round_even(avg(f1), 3) >= 0.75 AS passed FROM m WHERE total > 0")
def macro_f1(spark, d):
    return evaluate.macro_f1(field_metrics(spark, d))


@query("grounding_scores", """
SELECT b.item_id, d.doc_id, CASE WHEN contains(lower(d.text), lower(trim(b.text))) THEN 1.0 WHEN length(trim(b.text)) > 50 AND contains(lower(d.text), lower(left(trim(b.text), 50))) THEN 0.8 ELSE 0.0 END AS score
FROM benchmark b, documents d WHERE contains(lower(d.text), lower(left(trim(b.text), 50)))
""")
def grounding_scores(spark, d):
    """J15 of passages in documents; pairs that do not even share the passage's start score 0 and are left out."""
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"), F.lower(F.left(F.trim("text"), F.lit(50))).alias("start"))
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("low"))
    j = passages.containing(docs, b, "doc_id", "low", "item_id", "start")
    return j.select("item_id", "doc_id", evaluate.grounding(F.col("quote"), F.col("low")).alias("score"))


_REL = f"(SELECT *, CASE WHEN clause_type = wanted AND coalesce(extracted, FALSE) THEN 1.0 WHEN clause_type = wanted THEN 0.7 WHEN coalesce(extracted, FALSE) THEN 0.3 ELSE 0.0 END::DOUBLE AS rel FROM {X.RETRIEVED.sql()})"


@query("retrieval_ranking", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS best FROM {_REL} WHERE rank <= 5),
g AS (SELECT query_id, coalesce(1.0 / min(rank) FILTER (rel >= 0.7), 0.0)::DOUBLE AS rr, sum(rel / log2(rank + 1)) AS dcg, sum(rel / log2(best + 1)) AS idcg, bool_or(rank = 1 AND clause_type = wanted) AS match_at_1, bool_or(clause_type = wanted) AS match_at_5, max(latency) AS latency FROM r GROUP BY 1)
SELECT query_id, round(rr, 6) AS rr, CASE WHEN idcg = 0 THEN 0.0 ELSE round(dcg / idcg, 6) END AS ndcg, match_at_1, match_at_5, latency FROM g
""")
def retrieval_ranking(spark, d):
    return evaluate.ranking(evaluate.relevance(X.RETRIEVED.df(spark, d)))


_SCORED = "SELECT doc_id, round((doc_id % 101) / 101.0, 6)::DOUBLE AS confidence, quality = 1 AS correct FROM labels"


def _scored(spark, d):
    return table(spark, d, "labels").select("doc_id", F.round((F.col("doc_id") % 101) / 101.0, 6).alias("confidence"), (F.col("quality") == 1).alias("correct"))


@query("ece_bins", f"""
WITH s AS ({_SCORED}), e AS (SELECT i AS bin, i / 10.0::DOUBLE AS lo, (i + 1) / 10.0::DOUBLE AS hi FROM range(10) t(i)),
g AS (SELECT ceil(round(confidence * 10, 9))::BIGINT - 1 AS bin, count(*) AS n, avg(confidence) AS conf, avg(correct::INT::DOUBLE) AS acc FROM s WHERE confidence > 0 GROUP BY 1)
SELECT e.bin, e.lo, e.hi, coalesce(n, 0) AS n, round(coalesce(conf, 0), 6) AS conf, round(coalesce(acc, 0), 6) AS acc, round(coalesce(abs(acc - conf) * n / (SELECT count(*) FROM s), 0), 6) AS gap FROM e LEFT JOIN g USING (bin)
""")
def ece_bins(spark, d):
    return evaluate.ece(_scored(spark, d))


@query("detection_recall", f"WITH x AS (SELECT DISTINCT * FROM {X.EXPECTED.sql()}), f AS (SELECT * FROM {X.CONFIGS.sql()}), h AS (SELECT config, count(*) AS hit FROM (SELECT DISTINCT config, clause, category FROM f) JOIN x USING (clause, category) GROUP BY 1) SELECT config, count(*) AS n_risks, count(*) FILTER (severity = 'High') AS n_high, count(*) FILTER (severity = 'Medium') AS n_medium, count(*) FILTER (severity = 'Low') AS n_low, round(coalesce(max(hit), 0)::DOUBLE / (SELECT count(*) FROM x), 6) AS recall FROM f LEFT JOIN h USING (config) GROUP BY 1")
def detection_recall(spark, d):
    return evaluate.detection_recall(X.CONFIGS.df(spark, d), X.EXPECTED.df(spark, d))


@query("ablation_marginal", f"WITH x AS (SELECT DISTINCT * FROM {X.EXPECTED.sql()}), f AS (SELECT * FROM {X.CONFIGS.sql()}), h AS (SELECT config, count(*) AS hit FROM (SELECT DISTINCT config, clause, category FROM f) JOIN x USING (clause, category) GROUP BY 1), s AS (SELECT config, count(*) AS n, round(coalesce(max(hit), 0)::DOUBLE / (SELECT count(*) FROM x), 6) AS r FROM f LEFT JOIN h USING (config) GROUP BY 1) SELECT a.config AS base, b.config AS enhanced, b.n - a.n AS delta, round_even(100.0 * (b.n - a.n) / a.n, 1) AS delta_pct, round_even(100 * (b.r - a.r), 1) AS recall_pp FROM s a JOIN s b ON (a.config, b.config) IN (('regex', 'all'), ('ml', 'all'), ('regex', 'ml'))")
def ablation_marginal(spark, d):
    return evaluate.marginal(detection_recall(spark, d), [("regex", "all"), ("ml", "all"), ("regex", "ml")])


@query("path_compare", f"WITH f AS (SELECT DISTINCT config, clause, category FROM {X.CONFIGS.sql()}), a AS (SELECT clause, category FROM f WHERE config = 'ml'), b AS (SELECT clause, category FROM f WHERE config = 'regex') SELECT clause, count(*) FILTER (l AND r) AS \"both\", count(*) FILTER (l AND NOT r) AS only_left, count(*) FILTER (r AND NOT l) AS only_right FROM (SELECT clause, category, bool_or(s = 'a') AS l, bool_or(s = 'b') AS r FROM (SELECT 'a' AS s, * FROM a UNION ALL SELECT 'b', * FROM b) GROUP BY ALL) GROUP BY 1")
def path_compare(spark, d):
    c = X.CONFIGS.df(spark, d)
    return evaluate.path_compare(c.where("config = 'ml'"), c.where("config = 'regex'"))


@query("example_f1", f"WITH l AS (SELECT id, unnest([{{'t': has_a, 'p': CASE WHEN p_found THEN p_has_a END}}, {{'t': has_b, 'p': CASE WHEN p_found THEN p_has_b END}}], recursive := true) FROM {_JOIN}), c AS (SELECT id, count(*) FILTER (coalesce(t, FALSE) AND coalesce(p, FALSE)) AS tp, count(*) FILTER (NOT coalesce(t, FALSE) AND coalesce(p, FALSE)) AS fp, count(*) FILTER (coalesce(t, FALSE) AND NOT coalesce(p, FALSE)) AS fn FROM l GROUP BY 1) SELECT id, {_RATIO.format(a='tp', b='(tp + fp)')} AS precision, {_RATIO.format(a='tp', b='(tp + fn)')} AS recall, {_RATIO.format(a='(2 * tp)', b='(2 * tp + fp + fn)')} AS f1 FROM c")
def example_f1(spark, d):
    j = _joined(spark, d)
    long = j.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("truth"), F.when(F.col("p_found"), F.col(f"p_{f}")).alias("pred")) for f in ("has_a", "has_b")])).alias("x")).select("id", "x.*")
    return evaluate.example_f1(long)


_PROBS = "SELECT event_id AS id, (event_id * 7 % 41) / 100.0::DOUBLE AS p_high, (event_id * 3 % 37) / 100.0::DOUBLE AS p_low, (event_id * 5 % 23) / 100.0::DOUBLE AS p_medium, (event_id % 100) / 100.0::DOUBLE AS p_none FROM events"


@query("classifier_decision", f"SELECT id, round_even(round(1 - p_none, 6), 3) AS risk_probability, round(1 - p_none, 6) >= 0.55 AS detected, CASE WHEN round(1 - p_none, 6) >= 0.55 THEN CASE WHEN p_high = greatest(p_high, p_low, p_medium) THEN 'High' WHEN p_low = greatest(p_high, p_low, p_medium) THEN 'Low' ELSE 'Medium' END END AS severity, CASE WHEN round(1 - p_none, 6) >= 0.55 THEN round_even(greatest(p_high, p_low, p_medium), 3) END AS confidence FROM ({_PROBS})")
def classifier_decision(spark, d):
    i = F.col("event_id")
    p = table(spark, d, "events").select(i.alias("id"), (i * 7 % 41 / 100.0).alias("p_high"), (i * 3 % 37 / 100.0).alias("p_low"), (i * 5 % 23 / 100.0).alias("p_medium"), (i % 100 / 100.0).alias("p_none"))
    return evaluate.classifier_decision(p)


@query("exhibit_scan", f"""
WITH f AS (SELECT * FROM {X.HITS.sql()} QUALIFY row_number() OVER (PARTITION BY hit_id ORDER BY query_ord, rank) = 1)
SELECT hit_id, cik, adsh, substr(hit_id, instr(hit_id, ':') + 1) AS filename, trim(regexp_replace(trim(regexp_replace(name, '\\s*\\(CIK\\s+\\d+\\)', '', 'g')), '\\s*\\([A-Z0-9, -]+\\)\\s*$', '')) AS company,
  'https://host/x/' || cik || '/' || replace(adsh, '-', '') || '/' || substr(hit_id, instr(hit_id, ':') + 1) AS url
FROM f WHERE starts_with(file_type, 'EX-10') AND cik IS NOT NULL AND adsh IS NOT NULL ORDER BY query_ord, rank LIMIT 2000
""")
def exhibit_scan(spark, d):
    e = tables.exhibits(X.HITS.df(spark, d))
    return e.withColumn("url", tables.document_url("https://host/x", F.col("cik"), F.col("adsh"), F.col("filename")))


_PAGE_TEXT = r"""
WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?i)</?(br|p|div|tr|li|h[1-4])(\s[^>]*)?/?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM pages),
u AS (SELECT page_id, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') AS t FROM t)
SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM u
"""


@query("html_text", _PAGE_TEXT)
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(tables.html_text(F.col("html")).cast("binary")).alias("text_md5"))


# The entities that the pages use; that of "&" comes last, as what it leaves is no entity.
_ENTITIES = {"copy": "©", "middot": "·", "lt": "<", "gt": ">", "quot": '"', "nbsp": "\u00a0", "amp": "&"}


def _parsed_sql() -> str:
    """The patterns' text with the entities that the pages use, which HTML lets end without a semicolon; a parser decodes
    all there are."""
    head, _, tail = _PAGE_TEXT.partition("u AS (SELECT page_id, ")
    out = "t"
    for name, sign in _ENTITIES.items():
        out = f"regexp_replace({out}, '&{name};?', '{sign}', 'g')"
    return head + f"u AS (SELECT page_id, {out} AS t FROM t)" + tail[tail.index("\nSELECT") :].replace(r"'^\s+|\s+$'", r"'^[\s\x{a0}]+|[\s\x{a0}]+$'")


@query("html_parse", _parsed_sql())
def html_parse(spark, d):
    """S5 with a real HTML parser; on well-formed pages it says what the patterns say, and knows all entities."""
    from clauselake.sources import html

    return html.parsed(table(spark, d, "pages")).select("page_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("accepted_exhibits", "SELECT doc_id, length(left(text, 500000)) AS n FROM documents WHERE length(text) >= 2000 AND regexp_matches(left(text, 5000), '(?i)license|tion of')")
def accepted_exhibits(spark, d):
    """S6 with a pattern that occurs in the generated texts."""
    return tables.accepted_exhibits(table(spark, d, "documents").select("doc_id", "text"), pattern="license|tion of").select("doc_id", F.length("text").cast("long").alias("n"))


@query("upload_validation", f"WITH u AS (SELECT *, lower(regexp_extract(coalesce(filename, ''), '(\\.[A-Za-z0-9]+)$', 1)) AS ext FROM {X.UPLOADS.sql()}) SELECT id, CASE WHEN ext NOT IN ('.pdf', '.txt') THEN 'type' WHEN size > 10485760 THEN 'size' WHEN ext = '.pdf' AND magic <> '%PDF' THEN 'content' END AS problem FROM u")
def upload_validation(spark, d):
    return X.UPLOADS.df(spark, d).select("id", tables.upload_problem(F.col("filename"), F.col("size"), F.col("magic")).alias("problem"))


@query("upsert_orders", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, 'U', o_totalprice + 1 FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT -c_custkey - 1, 'N', c_acctbal FROM customer WHERE c_custkey <= 50")
def upsert_orders(spark, d):
    """K1-K3 on orders: a tenth is updated twice, of which the later version stays, and fifty rows are new."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    tenth = o.where("o_orderkey % 10 = 0")
    new = tenth.select("o_orderkey", F.lit("A").alias("o_orderstatus"), "o_totalprice", F.lit(1).alias("v")).union(tenth.select("o_orderkey", F.lit("U"), F.col("o_totalprice") + 1, F.lit(2)))
    new = new.union(table(spark, d, "customer").where("c_custkey <= 50").select(-F.col("c_custkey") - 1, F.lit("N"), "c_acctbal", F.lit(1)))
    return tables.upsert(o, new, ["o_orderkey"], "v")


@query("patch_embeddings", "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN label + 100 ELSE label END AS label FROM embeddings")
def patch_embeddings(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return tables.patch(e, e.where("vec_id % 5 = 0").select("vec_id", (F.col("label") + 100).alias("label")), "vec_id", "label")


@query("resume_contracts", f"SELECT contract_id, accession, company, format('edgar_{{:04d}}', row_number() OVER (ORDER BY accession) + 2) AS new_id FROM {X.CONTRACTS.sql()} WHERE accession NOT IN ('a-2', 'zz') AND accession IS NOT NULL")
def resume_contracts(spark, d):
    """Contracts that are not known go on with the numbering."""
    known = spark.createDataFrame([("a-2",), ("zz",)], "accession string")
    new = X.CONTRACTS.df(spark, d).withColumnRenamed("contract_id", "old")
    return tables.numbered(new, known, "accession").select(F.col("old").alias("contract_id"), "accession", "company", F.col("contract_id").alias("new_id"))


@query("cascade_delete", "SELECT l.l_orderkey, l.l_linenumber FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'F')")
def cascade_delete(spark, d):
    """Line items whose order stays."""
    left = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return tables.cascade(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), left, "l_orderkey")


@query("ttl_cache_hits", """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts)::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts)::DOUBLE, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, t AS live, FALSE AS hit FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.t - r.live < 36000 THEN r.live ELSE e.t END, e.t - r.live < 36000 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, hit FROM r
""")
def ttl_cache_hits(spark, d):
    """ST1 on events, keyed by user, with entries that live ten hours."""
    e = table(spark, d, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return state.ttl_cache_hits(e, "user_id", "t", "event_id", 36_000)


@query("rate_limit_windows", "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, greatest(0, count(*) - 5) AS over FROM events GROUP BY ALL")
def rate_limit_windows(spark, d):
    """ST2 with windows of an hour, as the generated events are sparse."""
    return state.rate_limit_windows(table(spark, d, "events"), "event_type", "ts", 5, "1 hour")


@query("rolling_token_budget", "SELECT event_id, round(sum(value) OVER w, 6) AS used, round(sum(value) OVER w, 6) > 100 AS over FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)")
def rolling_token_budget(spark, d):
    return state.rolling_budget(table(spark, d, "events"), "user_id", "ts", "value", 86_400, 100.0).select("event_id", "used", "over")


@query("latency_histogram", "WITH b AS (SELECT unnest([0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, NULL])::DOUBLE AS le) SELECT event_type, le, count(value) FILTER (le IS NULL OR value <= le) AS n FROM events, b GROUP BY ALL")
def latency_histogram(spark, d):
    return state.latency_histogram(table(spark, d, "events"), "event_type", "value")


@query("event_rates", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_rates(spark, d):
    r = state.event_rates(table(spark, d, "events"))
    return r.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("breaker_states", """
WITH RECURSIVE e AS (SELECT event_id AS ord, epoch(ts)::DOUBLE AS at, event_type AS dependency, event_id % 3 = 0 AS ok, row_number() OVER (PARTITION BY event_type ORDER BY epoch(ts)::DOUBLE, event_id) AS n FROM events),
r AS (
  SELECT dependency, 0::BIGINT AS n, 0::BIGINT AS ord, TRUE AS allowed, 'closed' AS state, 0::BIGINT AS failures, 0.0::DOUBLE AS since, 0.0::DOUBLE AS retry_after FROM (SELECT DISTINCT dependency FROM e)
  UNION ALL SELECT y.dependency, y.n, y.ord, NOT shut,
    CASE WHEN shut THEN 'open' WHEN ok THEN 'closed' WHEN was = 'half_open' OR y.failures + 1 >= 5 THEN 'open' ELSE was END,
    CASE WHEN shut THEN y.failures WHEN ok THEN 0 ELSE y.failures + 1 END,
    CASE WHEN NOT shut AND NOT ok AND (was = 'half_open' OR y.failures + 1 >= 5) THEN y.at ELSE y.since END,
    CASE WHEN shut THEN 600 - (y.at - y.since) ELSE 0 END
  FROM (SELECT e.*, r.failures, r.since, r.state = 'open' AND e.at - r.since < 600 AS shut, CASE WHEN r.state = 'open' THEN 'half_open' ELSE r.state END AS was FROM r JOIN e ON e.dependency = r.dependency AND e.n = r.n + 1) y)
SELECT ord, dependency, allowed, state, failures, round(retry_after, 6) AS retry_after FROM r WHERE n > 0
""")
def breaker_states(spark, d):
    """ST4 on events: two of three calls fail, and a breaker stays open for ten minutes."""
    e = table(spark, d, "events").select(F.col("event_id").alias("ord"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_type").alias("dependency"), (F.col("event_id") % 3 == 0).alias("ok"))
    return state.breaker_states(e, recovery=600.0).withColumn("retry_after", F.round("retry_after", 6))


@query("token_expiry", "SELECT event_id, ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-15 00:00:00' AS valid FROM events")
def token_expiry(spark, d):
    """ST9: tokens issued with each event, at one point in time."""
    t = table(spark, d, "events").select("event_id", "ts")
    return t.select("event_id", state.token_valid(F.col("ts"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).alias("valid"))

