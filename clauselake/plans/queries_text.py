"""Queries on texts, rules, risks and sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauselake.functions import packs, text
from clauselake.operators import detect, learn, passages
from clauselake.plans import fixtures as X
from clauselake.plans.catalog import query
from clauselake.session import table

_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '\r\n|\r', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace({t}, '\b(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|vs|etc|i\.e|e\.g|Inc|Ltd|Corp|Co|No|Sec|Art)\.', '\1' || chr(1), 'g'), '([.!?])\s+([A-Z0-9"])', '\1' || chr(2) || '\2', 'g'), chr(2)), lambda s: regexp_replace(replace(s, chr(1), '.'), '^\s+|\s+$', '', 'g')), lambda s: s <> '')"""
_WORDS = r"list_filter(string_split_regex({t}, '\s+'), lambda w: w <> '')"


@query("clean_text", f"SELECT doc_id, md5({_CLEAN.format(t='text')}) AS cleaned_md5, length({_CLEAN.format(t='text')}) AS n FROM documents")
def clean_text(spark, d):
    t = text.clean_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(t.cast("binary")).alias("cleaned_md5"), F.length(t).cast("long").alias("n"))


@query("extract_sentences", f"WITH s AS (SELECT doc_id, {SENTENCES.format(t='text')} AS s FROM documents) SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM s")
def extract_sentences(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.sentences(F.col("text")).alias("s"))
    return docs.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|").cast("binary")).alias("sentences_md5"))


@query("segment_clauses", f"""
WITH s AS (SELECT doc_id, {SENTENCES.format(t=_CLEAN.format(t='text'))} AS s FROM documents),
c AS (SELECT doc_id, list_filter(flatten(list_transform(s, lambda x: CASE WHEN length(x) > 400 AND contains(x, ';') THEN list_transform(string_split(x, ';'), lambda y: regexp_replace(y, '^\\s+|\\s+$', '', 'g')) ELSE [x] END)), lambda x: length(x) >= 20) AS c FROM s)
SELECT doc_id, len(c) AS n_clauses, md5(array_to_string(c, '|')) AS clauses_md5 FROM c
""")
def segment_clauses(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.clauses(F.col("text")).alias("c"))
    return docs.select("doc_id", F.size("c").cast("long").alias("n_clauses"), F.md5(F.array_join("c", "|").cast("binary")).alias("clauses_md5"))


@query("section_label", f"""
WITH t AS (SELECT id, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS t FROM {X.LINES.sql()}),
p AS (SELECT *, CASE WHEN regexp_matches(t, '[a-z)]\\.(\\s|$)') THEN length(regexp_extract(t, '^(.*?[a-z)])\\.(?:\\s|$)', 1)) + 1 ELSE 0 END AS n FROM t)
SELECT id, CASE WHEN n > 0 AND n <= 60 THEN left(t, n) WHEN length(t) <= 60 THEN t ELSE regexp_replace(left(t, 60), '\\s+$', '') || '…' END AS label FROM p
""")
def section_label(spark, d):
    return X.LINES.df(spark, d).select("id", text.label(F.col("line")).alias("label"))


@query("word_windows", f"WITH w AS (SELECT doc_id, {_WORDS.format(t='text')} AS w FROM documents) SELECT doc_id, i AS window_no, array_to_string(w[i * 50 + 1 : i * 50 + 50], ' ') AS part FROM (SELECT *, unnest(range(0, CAST(ceil(len(w) / 50.0) AS BIGINT))) AS i FROM w WHERE len(w) > 0)")
def word_windows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(text.windows(F.col("text"), 50)).alias("window_no", "part"))
    return docs.select("doc_id", F.col("window_no").cast("long").alias("window_no"), "part")


_LEVELS = ", ".join(f"CASE WHEN n > {b} THEN 'over' WHEN n > {a} THEN 'warn' ELSE 'ok' END AS {m}_level" for m, (a, b) in packs.BUDGETS.items())


@query("size_limits", f"WITH w AS (SELECT doc_id, len({_WORDS.format(t='text')}) AS n FROM documents) SELECT doc_id, n AS n_words, floor(n * 1.4::DOUBLE)::BIGINT AS tokens, {_LEVELS} FROM w")
def size_limits(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.word_count(t).cast("long").alias("n_words"), text.token_estimate(t).cast("long").alias("tokens"), *[text.size_level(t, m).alias(f"{m}_level") for m in packs.BUDGETS])


@query("snippets", f"SELECT id, CASE WHEN length(text) <= 300 THEN text ELSE left(text, 297) || '...' END AS s300, CASE WHEN length(text) <= 280 THEN text ELSE left(text, 277) || '...' END AS s280 FROM {X.SNIPPETS.sql()}")
def snippets(spark, d):
    return X.SNIPPETS.df(spark, d).select("id", text.snippet(F.col("text")).alias("s300"), text.snippet(F.col("text"), 280).alias("s280"))


def _type_sql(t: str) -> str:
    low = f"lower(' ' || coalesce({t}, ''))"
    n = {k: " + ".join(f"contains({low}, '{w}')::INT" for w in ws) for k, ws in packs.LEXICON.items()}
    most = f"greatest({', '.join(n.values())})"
    return f"CASE WHEN {most} = 0 THEN 'other' " + " ".join(f"WHEN {v} = {most} THEN '{k}'" for k, v in n.items()) + " END"


@query("classify_clauses", f"SELECT doc_id, clause_idx, {_type_sql('clause')} AS clause_type FROM {X.CLAUSES.sql()}")
def classify_clauses(spark, d):
    return X.CLAUSES.df(spark, d).select("doc_id", "clause_idx", text.clause_type(F.col("clause")).alias("clause_type"))


@query("classify_chunk", f"SELECT doc_id, {_type_sql('text')} AS clause_type FROM documents")
def classify_chunk(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clause_type(F.col("text")).alias("clause_type"))


@query("resolved_type", f"SELECT doc_id, clause_idx, requested, CASE WHEN requested <> 'auto' THEN requested ELSE coalesce(nullif({_type_sql('clause')}, 'other'), 'liability') END AS resolved FROM {X.CLAUSES.sql()}, (VALUES ('auto'), ('payment')) r(requested)")
def resolved_type(spark, d):
    c = X.CLAUSES.df(spark, d).withColumn("requested", F.explode(F.array(F.lit("auto"), F.lit("payment"))))
    return c.select("doc_id", "clause_idx", "requested", text.resolved_type(F.col("clause"), F.col("requested")).alias("resolved"))


@query("chunk_histogram", f"WITH t AS (SELECT lang, {_type_sql('text')} AS clause_type FROM documents) SELECT lang, clause_type, count(*) AS n FROM t GROUP BY ALL")
def chunk_histogram(spark, d):
    docs = table(spark, d, "documents").select("lang", text.clause_type(F.col("text")).alias("clause_type"))
    return docs.groupBy("lang", "clause_type").agg(F.count(F.lit(1)).alias("n"))


def _scan_sql(source: str, columns: str, body: str) -> str:
    """Finds of each rule, one SELECT a rule; RE2 has no lookahead, so what it forbids is matched and taken away."""
    parts = []
    for k, t, p, s, f, _ in packs.rule_rows():
        q = p.replace("'", "''")
        if "(?!" in p:
            plain = q[: q.index("(?!")]
            whole = plain + r"\s+(?:from|by|against)"
            found = f"list_filter(list_transform(list_zip(regexp_extract_all({body}, '(?i){plain}(?:\\s+(?:from|by|against))?')), lambda z: z[1]), lambda m: NOT regexp_matches(m, '(?i)^{whole}'))"
        else:
            found = f"regexp_extract_all({body}, '(?i){q}')"
        parts.append(f"SELECT {columns}, {body} AS body, {k} AS rule_ord, '{t}' AS risk_type, '{s}' AS severity, {f}::DOUBLE AS freq, {packs.CONFIDENCE[s]}::DOUBLE AS base, {found} AS found FROM {source}")
    return " UNION ALL ".join(parts)


_BOOST = r"least(1.0, len(regexp_extract_all(lower(body), '\b' || regexp_escape(lower(keyword)) || '\b')) / greatest(len(list_filter(string_split_regex(lower(body), '\s+'), lambda w: w <> '')), 1)::DOUBLE * ln(1.0 / (freq + 1e-9)) * 10)"


@query("rule_scan", f"WITH f AS ({_scan_sql(X.CLAUSES.sql(), 'doc_id, clause_idx', 'clause')}), k AS (SELECT * EXCLUDE (found, m), m AS keyword FROM (SELECT *, unnest(found) AS m FROM f)) SELECT doc_id, clause_idx, rule_ord, risk_type, severity, keyword, round_even(least(1.0, base + {_BOOST} * 0.15), 3) AS score FROM k")
def rule_scan(spark, d):
    return detect.rule_scan(X.CLAUSES.df(spark, d)).select("doc_id", "clause_idx", "rule_ord", "risk_type", "severity", "keyword", "score")


@query("rule_scan_documents", f"WITH f AS ({_scan_sql('documents', 'doc_id', 'text')}) SELECT doc_id, rule_ord, count(*) AS n FROM (SELECT doc_id, rule_ord, unnest(found) AS m FROM f) GROUP BY ALL")
def rule_scan_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return detect.rule_scan(docs, "text").groupBy("doc_id", "rule_ord").agg(F.count(F.lit(1)).alias("n"))


@query("hybrid_merge", f"""
WITH p AS (SELECT clause_idx, risk_type, min_by(snippet, ord) AS ps, max(score) AS pc, max(CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END) AS pr, list(keyword ORDER BY ord) AS pw FROM {X.MERGE_PRIMARY.sql()} GROUP BY ALL),
s AS (SELECT clause_idx, risk_type, snippet AS ss, score AS sc, CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END AS sr, keyword AS sw FROM {X.MERGE_SEMANTIC.sql()}),
j AS (SELECT coalesce(p.clause_idx, s.clause_idx) AS clause_idx, coalesce(p.risk_type, s.risk_type) AS risk_type, * EXCLUDE (clause_idx, risk_type), pc IS NOT NULL AND sc IS NOT NULL AS b FROM p FULL JOIN s ON p.clause_idx = s.clause_idx AND p.risk_type = s.risk_type),
k AS (SELECT *, CASE WHEN sw IS NULL THEN pw WHEN pw IS NULL THEN [sw] ELSE list_concat(pw, [sw]) END AS w FROM j)
SELECT clause_idx, risk_type, coalesce(ps, ss) AS snippet, CASE WHEN b THEN round_even(round(least(1.0, 0.55 * pc + 0.45 * sc + 0.08) * 1000.0::DOUBLE, 6), 0) / 1000.0::DOUBLE ELSE coalesce(pc, sc) END AS score,
  ['Low', 'Medium', 'High'][CASE WHEN b AND pr = 2 AND sc >= 0.65 THEN 3 ELSE coalesce(pr, sr) END] AS severity,
  array_to_string(CASE WHEN b THEN list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i) ELSE w END, '|') AS keywords,
  CASE WHEN b THEN 'regex+semantic' WHEN pc IS NOT NULL THEN 'regex' ELSE 'semantic' END AS source FROM k
""")
def hybrid_merge(spark, d):
    return detect.hybrid_merge(X.MERGE_PRIMARY.df(spark, d), X.MERGE_SEMANTIC.df(spark, d)).drop("similarity", "ord")


_ESC = f"(SELECT *, severity = 'Medium' AND count(*) FILTER (severity = 'High') OVER w >= 1 AND (SELECT count(DISTINCT risk_type) FROM {X.RISKS.sql()} r2 WHERE r2.doc_id = r.doc_id AND r2.clause_idx = r.clause_idx) >= 2 AS escalated FROM {X.RISKS.sql()} r WINDOW w AS (PARTITION BY doc_id, clause_idx))"
_ESC2 = f"(SELECT doc_id, clause_idx, ord, risk_type, source, similarity, escalated, CASE WHEN escalated THEN 'High' ELSE severity END AS severity, CASE WHEN escalated THEN least(1.0, round_even(score + 0.05, 3)) ELSE score END AS score FROM {_ESC})"


@query("escalate", f"SELECT ord, severity, score, escalated FROM {_ESC2}")
def escalate(spark, d):
    return detect.escalate(X.RISKS.df(spark, d)).select("ord", "severity", "score", "escalated")


def _weight(f: str) -> str:
    return "CASE risk_type " + " ".join(f"WHEN '{t}' THEN {w.get(f, 0.0)}" for t, w in packs.WEIGHTS.items()) + f" ELSE {1.0 if f == 'ambiguity' else 0.0} END::DOUBLE"


def _final_sql(source: str) -> str:
    p = f"SELECT *, least(100, greatest(0, CASE severity WHEN 'Low' THEN 32 WHEN 'Medium' THEN 58 WHEN 'High' THEN 90 ELSE 55 END + CASE WHEN source = 'both' THEN 12 WHEN source = 'ml_strong' THEN 6 WHEN source = 'semantic' AND coalesce(similarity, 0) < 0.58 THEN -12 ELSE 0 END + round_even(greatest(0.0, coalesce(score, 0) - 0.6) * 10, 0)::INT + CASE WHEN escalated THEN 8 ELSE 0 END)) AS \"primary\" FROM {source}"
    f = ", ".join(f"CASE WHEN {_weight(x)} > 0 THEN round_even(\"primary\" * (0.6::DOUBLE + 0.4::DOUBLE * {_weight(x)}), 0)::INT ELSE 0 END AS f_{x}" for x in packs.FEATURES)
    total = " + ".join(f"f_{x} * {_weight(x)}" for x in packs.FEATURES)
    return f"WITH p AS ({p}), f AS (SELECT *, {f} FROM p), s AS (SELECT *, least(100, greatest(0, round_even(round_even({total}, 6), 0)::INT)) AS score100 FROM f) "


_FEATURES = ", ".join(f"f_{x}" for x in packs.FEATURES)


@query("finalize_score", _final_sql(_ESC2) + f'SELECT ord, "primary", {_FEATURES}, score100, CASE WHEN score100 >= 70 THEN \'High\' WHEN score100 >= 40 THEN \'Medium\' ELSE \'Low\' END AS band FROM s')
def finalize_score(spark, d):
    return detect.finalize(detect.escalate(X.RISKS.df(spark, d))).select("ord", "primary", *[f"f_{x}" for x in packs.FEATURES], "score100", "band")


_DOC_IDS = X.Derived("customer", doc_id="c_custkey")


@query("overall_risk", _final_sql(_ESC2) + f", t AS (SELECT doc_id, round_even(avg(score100), 0)::INT AS m FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score100 DESC) AS r FROM s) WHERE r <= 3 GROUP BY 1) SELECT doc_id, coalesce(m, 0) AS overall_score, CASE WHEN m IS NULL THEN 'Low' WHEN m >= 70 THEN 'High' WHEN m >= 40 THEN 'Medium' ELSE 'Low' END AS overall_level FROM {_DOC_IDS.sql()} LEFT JOIN t USING (doc_id)")
def overall_risk(spark, d):
    return detect.overall_risk(_DOC_IDS.df(spark, d), detect.finalize(detect.escalate(X.RISKS.df(spark, d))))


@query("risk_summary", _final_sql(_ESC2) + "SELECT doc_id, risk_type, count(*) AS n, count(*) FILTER (score100 >= 70) AS n_high FROM s GROUP BY ALL")
def risk_summary(spark, d):
    r = detect.finalize(detect.escalate(X.RISKS.df(spark, d)))
    return r.groupBy("doc_id", "risk_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score100") >= 70).alias("n_high"))


@query("clause_offsets", f"SELECT doc_id, sec, coalesce(sum(coalesce(max_idx + 1, 0)) OVER (PARTITION BY doc_id ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS clause_offset FROM {X.SECTIONS.sql()}")
def clause_offsets(spark, d):
    return detect.clause_offsets(X.SECTIONS.df(spark, d)).select("doc_id", "sec", F.col("offset").alias("clause_offset"))


@query("merge_sections", f"""
WITH g AS (SELECT *, greatest(1, sum((words >= 40)::INT) OVER (PARTITION BY doc_id ORDER BY sec)) AS g FROM {X.SECTIONS.sql()})
SELECT doc_id, g::BIGINT AS part, sum(words)::BIGINT AS words, min(sec) AS first_sec FROM g GROUP BY ALL
""")
def merge_sections(spark, d):
    """Sections under 40 words join the one before them, the first ones the one after."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("sec")
    g = X.SECTIONS.df(spark, d).withColumn("part", F.greatest(F.lit(1), F.sum((F.col("words") >= 40).cast("long")).over(w)))
    return g.groupBy("doc_id", "part").agg(F.sum("words").alias("words"), F.min("sec").alias("first_sec"))


@query("analyze_regex")
def analyze_regex(spark, d):
    """R8 on all documents: the fold of A20 depends on order, which SQL does not express."""
    return detect.analyze(X.CLAUSES.df(spark, d).withColumnRenamed("clause", "text")).select("doc_id", "clause_idx", "risk_type", "score100", "band", F.col("words").alias("keywords"), "snippet", "explanation", "rank")


@query("analyze_document")
def analyze_document(spark, d):
    """T11 on all documents, section by section."""
    docs = X.CLAUSES.df(spark, d).select("doc_id", F.col("clause").alias("text"))
    return detect.analyze_document(docs, least=20, most=100).select("doc_id", "section", "clause_idx", "risk_type", "score100", "band", "rank")


_HITS = f"(WITH f AS ({_scan_sql(X.CLAUSES.sql(), 'doc_id, clause_idx', 'clause')}), k AS (SELECT * EXCLUDE (found, m), m AS keyword FROM (SELECT *, unnest(found) AS m FROM f)) SELECT doc_id, clause_idx, risk_type, severity, round_even(least(1.0, base + {_BOOST} * 0.15), 3) AS score FROM k)"
_RANK = "CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END"
_ANALYSIS = f"""
WITH k AS {_HITS}, m AS {X.SEMANTIC.sql()},
both_ids AS (SELECT doc_id FROM k INTERSECT SELECT doc_id FROM m),
kp AS (SELECT doc_id, clause_idx, risk_type, max(score) AS pc, max({_RANK}) AS pr FROM k WHERE doc_id IN (FROM both_ids) GROUP BY ALL),
ms AS (SELECT doc_id, clause_idx, risk_type, score AS sc, {_RANK} AS sr, similarity FROM m WHERE doc_id IN (FROM both_ids)),
j AS (SELECT * FROM kp FULL JOIN ms USING (doc_id, clause_idx, risk_type)),
u AS (
  SELECT doc_id, clause_idx, risk_type, CASE WHEN pc IS NOT NULL AND sc IS NOT NULL THEN round_even(round(least(1.0, 0.55 * pc + 0.45 * sc + 0.08) * 1000.0::DOUBLE, 6), 0) / 1000.0::DOUBLE ELSE coalesce(pc, sc) END AS score,
    ['Low', 'Medium', 'High'][CASE WHEN pc IS NOT NULL AND sc >= 0.65 AND pr = 2 THEN 3 ELSE coalesce(pr, sr) END] AS severity,
    CASE WHEN pc IS NOT NULL AND sc IS NOT NULL THEN 'both' WHEN pc IS NOT NULL THEN 'regex' ELSE 'semantic' END AS source, similarity FROM j
  UNION ALL SELECT doc_id, clause_idx, risk_type, score, severity, 'regex', NULL FROM k WHERE doc_id NOT IN (FROM both_ids)
  UNION ALL SELECT doc_id, clause_idx, risk_type, score, severity, 'semantic', similarity FROM m WHERE doc_id NOT IN (FROM both_ids)),
e AS (SELECT *, severity = 'Medium' AND count(*) FILTER (severity = 'High') OVER w >= 1 AND min(risk_type) OVER w <> max(risk_type) OVER w AS escalated FROM u WINDOW w AS (PARTITION BY doc_id, clause_idx)),
x AS (SELECT doc_id, clause_idx, risk_type, source, similarity, escalated, CASE WHEN escalated THEN 'High' ELSE severity END AS severity, CASE WHEN escalated THEN least(1.0, round_even(score + 0.05, 3)) ELSE score END AS score FROM e),
"""


@query("analyze_merge", _ANALYSIS + _final_sql("x").removeprefix("WITH ") + "SELECT doc_id, clause_idx, risk_type, source, escalated, score100, CASE WHEN score100 >= 70 THEN 'High' WHEN score100 >= 40 THEN 'Medium' ELSE 'Low' END AS band FROM s")
def analyze_merge(spark, d):
    """R8 with rules, similar clauses and their merge, without the fold, on all documents."""
    found = detect.analyze_clauses(X.CLAUSES.df(spark, d), ("regex", "semantic", "merge"), semantic=X.SEMANTIC.df(spark, d), threshold=None)
    return found.select("doc_id", "clause_idx", "risk_type", "source", "escalated", "score100", "band")


_ML = f"(SELECT doc_id, clause_idx, risk_type, severity, confidence, round_even(0.5::DOUBLE * CASE severity WHEN 'Low' THEN 0.45 WHEN 'Medium' THEN 0.65 ELSE 0.85 END + 0.5::DOUBLE * confidence, 3) AS score, CASE WHEN confidence >= 0.75 THEN 'ml_strong' ELSE 'ml_weak' END AS source FROM {X.CLASSIFIED.sql()})"


@query("ml_finds", f"SELECT * FROM {_ML}")
def ml_finds(spark, d):
    """R4."""
    return detect.ml_finds(X.CLASSIFIED.df(spark, d))


@query("analyze_ml", "WITH y AS (SELECT *, FALSE AS escalated, NULL::DOUBLE AS similarity FROM " + _ML + "), " + _final_sql("y").removeprefix("WITH ") + 'SELECT doc_id, clause_idx, risk_type, source, score100, row_number() OVER (PARTITION BY doc_id ORDER BY score100 DESC)::INT AS rank FROM s')
def analyze_ml(spark, d):
    """R8 with the classifier alone: its layer, scores and order (O1)."""
    found = detect.analyze_clauses(X.CLAUSES.df(spark, d), ("ml",), classified=X.CLASSIFIED.df(spark, d), threshold=None)
    return found.select("doc_id", "clause_idx", "risk_type", "source", "score100", "rank")


@query("visible_risks", _final_sql(_ESC2) + "SELECT ord, chosen FROM s, (VALUES ('all'), ('High'), ('Low')) c(chosen) WHERE chosen = 'all' OR chosen = CASE WHEN score100 >= 70 THEN 'High' WHEN score100 >= 40 THEN 'Medium' ELSE 'Low' END")
def visible_risks(spark, d):
    """F8 for three choices."""
    risks = detect.finalize(detect.escalate(X.RISKS.df(spark, d)))
    parts = [detect.shown(risks, c).select("ord", F.lit(c).alias("chosen")) for c in ("all", "High", "Low")]
    return parts[0].union(parts[1]).union(parts[2])


@query("risks_by_severity", f"SELECT doc_id, clause_idx, ord, row_number() OVER (PARTITION BY doc_id, clause_idx ORDER BY {_RANK} DESC, ord)::INT AS place FROM {X.RISKS.sql()}")
def risks_by_severity(spark, d):
    """O7."""
    return detect.by_severity(X.RISKS.df(spark, d), ("doc_id", "clause_idx")).select("doc_id", "clause_idx", "ord", "place")


@query("greedy_dedup")
def greedy_dedup(spark, d):
    """A20 over the sentences of each document, as a reader of near-repeated clauses meets them."""
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(text.clauses(F.col("text"))).alias("ord", "snippet"))
    return detect.greedy_dedup(docs.withColumn("severity", F.lit("High")), "doc_id", "ord").select("doc_id", "ord")


_FLAGS = ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{n}' END" for n, p in packs.INJECTIONS)


@query("injection_flags", f"SELECT id, nullif(array_to_string(list_filter([{_FLAGS}], lambda x: x IS NOT NULL), ','), '') AS flags, length(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\x{{200b}}\\x{{200c}}\\x{{200d}}\\x{{2060}}\\x{{feff}}]', '', 'g')) AS n_clean FROM {X.INPUTS.sql()}")
def injection_flags(spark, d):
    i = X.INPUTS.df(spark, d)
    return i.select("id", F.nullif(F.array_join(text.injection_flags(F.col("text")), ","), F.lit("")).alias("flags"), F.length(text.sanitized(F.col("text"))).cast("long").alias("n_clean"))


@query("cache_keys", f"SELECT doc_id, sha256(array_to_string({_WORDS.format(t='text')}, ' ')) AS cache_key FROM documents")
def cache_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", text.cache_key(F.col("text")).alias("cache_key"))


@query("top_keywords", r"""
WITH w AS (SELECT doc_id, unnest(x) AS word, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{3,}') AS x FROM documents)),
g AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM w WHERE word NOT IN ('the', 'and', 'for', 'that', 'with', 'der', 'die', 'das', 'und', 'que', 'les', 'des') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM g)
SELECT doc_id, rank, word, n FROM r WHERE rank <= 5
""")
def top_keywords(spark, d):
    """Each document's commonest words of three letters or more, those met first where they tie."""
    stop = ("the", "and", "for", "that", "with", "der", "die", "das", "und", "que", "les", "des")
    return learn.top_keywords(table(spark, d, "documents"), stop)


@query("risk_paragraph_match", r"""
WITH p AS (SELECT doc_id, unnest(x) AS para, generate_subscripts(x, 1) - 1 AS para_idx FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
n AS (SELECT item_id, lower(left(text, 60)) AS needle, lower(left(text, 30)) AS short FROM benchmark)
SELECT item_id, doc_id, coalesce(min(para_idx) FILTER (contains(lower(para), needle)), min(para_idx) FILTER (length(short) >= 10 AND contains(lower(para), short))) AS para_idx
FROM p JOIN n ON contains(lower(para), short) GROUP BY ALL HAVING coalesce(min(para_idx) FILTER (contains(lower(para), needle)), min(para_idx) FILTER (length(short) >= 10 AND contains(lower(para), short))) IS NOT NULL
""")
def risk_paragraph_match(spark, d):
    """The first paragraph that has a passage's first 60 characters, else its first 30."""
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("low"))
    n = table(spark, d, "benchmark").select("item_id", F.lower(F.left("text", F.lit(60))).alias("needle"), F.lower(F.left("text", F.lit(30))).alias("short"))
    some = passages.containing(docs, n, "doc_id", "low", "item_id", "short")
    p = some.select("item_id", "doc_id", "needle", "short", F.posexplode(F.split("low", "\n")).alias("para_idx", "para")).where(F.contains("para", "short"))
    first = F.coalesce(F.min(F.when(F.contains("para", "needle"), F.col("para_idx"))), F.min(F.when((F.length("short") >= 10), F.col("para_idx"))))
    return p.groupBy("item_id", "doc_id").agg(first.cast("long").alias("para_idx")).where("para_idx IS NOT NULL")
