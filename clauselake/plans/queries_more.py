"""Queries on chunks, sections, extraction, explanations and training data."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauselake.functions import chunking, packs, text
from clauselake.operators import calibrate, evaluate, extract, learn, market, values
from clauselake.plans import fixtures as X
from clauselake.plans.catalog import query
from clauselake.plans.queries_text import SENTENCES
from clauselake.session import table
from clauselake.sources import files
from clauselake.streaming import state


@query("chunk_contract")
def chunk_contract(spark, d):
    """T6 on documents: sequential packing, which SQL does not express."""
    return chunking.chunk_contracts(table(spark, d, "documents")).select("doc_id", "chunk_index", "section_header", "clause_type", "char_count")


_WORDS = r"list_filter(string_split_regex({t}, '\s+'), lambda w: w <> '')"


@query("sections_no_loss", f"SELECT doc_id, len({_WORDS.format(t='text')}) AS n_words, md5(array_to_string({_WORDS.format(t='text')}, ' ')) AS words_md5 FROM documents")
def sections_no_loss(spark, d):
    """The sections of a document, put together, hold its words, each once and in order."""
    s = chunking.section_documents(table(spark, d, "documents"), least=20, most=100)
    g = s.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sec", "text"))), lambda x: x["text"]), "\n").alias("t"))
    w = text.words(F.col("t"))
    return g.select("doc_id", F.size(w).cast("long").alias("n_words"), F.md5(F.array_join(w, " ").cast("binary")).alias("words_md5"))


def _matches_sql(pattern: str, of: str = "coalesce(clause, '')", flags: str = "(?i)") -> str:
    return f"regexp_matches({of}, '{flags}" + pattern.replace("'", "''") + "')"


def _fields_sql(t: str) -> str:
    guards = extract.GUARDS.get(t, {})
    hit = {f: _matches_sql(p) + (f" AND NOT {_matches_sql(guards[f])}" if f in guards else "") for f, p in extract.EVIDENCE[t].items()}
    for f, others in extract.ONLY_WITH.get(t, {}).items():
        hit[f] = f"({hit[f]} AND ({' OR '.join(f'({hit[o]})' for o in others)}))"
    return " UNION ALL ".join(f"SELECT chunk_id, clause_type, '{f}' AS field, {h} AS value FROM {X.LAWS.sql()} WHERE clause_type = '{t}'" for f, h in hit.items())


_FIELDS = " UNION ALL ".join(_fields_sql(t) for t in packs.CLAUSE_TYPES)


@query("extract_fields", f"SELECT chunk_id, field, value FROM ({_FIELDS})")
def extract_fields(spark, d):
    return extract.all_fields(X.LAWS.df(spark, d)).select("chunk_id", "field", "value")


@query("extract_and_benchmark", f"SELECT clause_type, field, count(*) FILTER (value) AS n_true, count(*) FILTER (NOT value) AS n_false, count(value) AS n_total, round_even(100.0 * count(*) FILTER (value) / count(value), 1) AS true_pct FROM ({_FIELDS}) GROUP BY ALL")
def extract_and_benchmark(spark, d):
    """X5 with the default extractor: each field's share over the extracted clauses of its type."""
    return market.bool_distribution(extract.all_fields(X.LAWS.df(spark, d)), "clause_type", "field")


def _values_sql() -> str:
    """The typed fields by sentences: the first one with evidence for a field decides, in it the first rule."""
    known = "map {" + ", ".join(f"'{w}': {n}" for w, n in values.NUMBERS.items()) + "}"

    def rule(r: values.Rule) -> str:
        flags = "" if r.kind == "name" else "(?i)"
        group = lambda k: f"nullif(regexp_extract(s, '{flags}" + r.pattern.replace("'", "''") + f"', {k}), '')"
        value = f"'{r.value}'" if r.value is not None else f"regexp_replace({group(1)}, '[.,]+$', '')" if r.kind == "name" else f"coalesce({group(3)}::INT, {group(1)}::INT, {known}[lower({group(2)})])::VARCHAR"
        hit = _matches_sql(r.pattern, "s", flags) + (f" AND {_matches_sql(r.needs, 's')}" if r.needs else "") + (f" AND NOT {_matches_sql(r.guard, 's')}" if r.guard else "")
        return f"CASE WHEN {hit} THEN {value} END"

    parts = []
    for t, f in dict.fromkeys((r.clause_type, r.field) for r in values.RULES):
        of = ", ".join(rule(r) for r in values.RULES if (r.clause_type, r.field) == (t, f))
        parts.append(f"SELECT chunk_id, '{f}' AS field, list_filter(list_transform(sentences, lambda s: coalesce({of})), lambda v: v IS NOT NULL)[1] AS value FROM c WHERE clause_type = '{t}'")
    return f"WITH c AS MATERIALIZED (SELECT chunk_id, clause_type, {SENTENCES.format(t='clause')} AS sentences FROM {X.TYPED.sql()}) " + " UNION ALL ".join(parts)


@query("extract_values", _values_sql())
def extract_values(spark, d):
    """X2's typed fields: choices, numbers and names."""
    return values.extract_values(X.TYPED.df(spark, d)).select("chunk_id", "field", "value")


_PROMPTS = X.Fixture("clause_type string, system string, template string", [(t, f"Read {t}.", "Clause: {clause_text} End.") for t in packs.CLAUSE_TYPES[:4]])


@query("prompt_format", f"SELECT chunk_id, c.clause_type, clause, system, replace(template, '{{clause_text}}', coalesce(clause, '')) AS prompt FROM {X.LAWS.sql()} c LEFT JOIN {_PROMPTS.sql()} p ON c.clause_type = p.clause_type")
def prompt_format(spark, d):
    return extract.prompts(X.LAWS.df(spark, d), _PROMPTS.df(spark))


_EXPLAIN = X.Derived("documents", id="doc_id", risk_type=X.pick(X.part("doc_id", 2), *extract.KEYS, "Unknown"), severity=X.pick(X.part("doc_id", 3), "High", "Medium", "Low"), source=X.pick("doc_id", "regex", "semantic", "both"), similarity=f"CASE WHEN doc_id % 3 > 0 THEN {X.share('40 + doc_id % 50', 100)} END", snippet="concat(coalesce(text, ''), ' ', " + X.pick(X.part("doc_id", 2), *(" ".join(("We", k, "you")) for ks in extract.KEYS.values() for k in ks)) + ")", words="concat(" + X.pick(X.part("doc_id", 5), "We|YOU|absent", "you", "", "x y z|it") + ", '|you')")


def _explained_sql() -> str:
    body = "CASE " + " ".join(f"WHEN risk_type = '{t}'" + (f" AND contains(lower(snippet), '{k}')" if k else "") + f" THEN '{s.replace(chr(39), chr(39) * 2)}'" for t, k, s in extract.TEMPLATES) + " ELSE 'A risk.' END"
    evidence = "list_filter(string_split(words, '|'), lambda k: k <> '' AND contains(lower(snippet), lower(k)))[1:3]"
    return f"SELECT id, CASE WHEN source = 'semantic' AND coalesce(similarity, 0) < 0.55 THEN 'Possible match: ' ELSE severity || ' risk: ' END || {body} || CASE WHEN len({evidence}) > 0 THEN ' Evidence: ' || array_to_string({evidence}, ', ') || '.' ELSE '' END || CASE source WHEN 'both' THEN ' Found by rule and by similarity.' WHEN 'semantic' THEN ' Found by similarity.' ELSE '' END AS why FROM {_EXPLAIN.sql()}"


@query("explanations", _explained_sql())
def explanations(spark, d):
    return extract.explained(_EXPLAIN.df(spark, d).withColumn("keywords", F.filter(F.split("words", r"\|"), lambda w: w != ""))).select("id", "why")


@query("response_rollup", f"WITH c AS (SELECT doc_id, count(*) AS total_risks, count(*) FILTER (severity = 'High') AS n_high, count(*) FILTER (severity = 'Medium') AS n_medium, count(*) FILTER (severity = 'Low') AS n_low, count(DISTINCT risk_type) AS n_types FROM {X.RISKS.sql()} GROUP BY 1) SELECT *, CASE WHEN n_high >= 2 THEN 'review' WHEN n_high = 1 THEN 'check' ELSE 'fine' END AS advice FROM c")
def response_rollup(spark, d):
    """Counts by severity for each document, and advice by the number of high ones."""
    c = [F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in ("High", "Medium", "Low")]
    g = X.RISKS.df(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_risks"), *c, F.count_distinct("risk_type").alias("n_types"))
    return g.withColumn("advice", F.when(F.col("n_high") >= 2, "review").when(F.col("n_high") == 1, "check").otherwise("fine"))


@query("end_to_end_summary", "SELECT event_type, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most, count(*) FILTER (value < 30) / count(*)::DOUBLE >= 0.9 AS mostly_fast, bool_and(value < 30) AS all_fast FROM events GROUP BY 1")
def end_to_end_summary(spark, d):
    """Latencies by type and whether they keep their limits."""
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(v), 4).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), (F.count_if(v < 30) / F.count(F.lit(1)) >= 0.9).alias("mostly_fast"), F.bool_and(v < 30).alias("all_fast"))


@query("metrics_page", """WITH b AS (SELECT unnest([0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, NULL])::DOUBLE AS le), c AS (SELECT event_type, le, count(value) FILTER (le IS NULL OR value <= le) AS n FROM events, b GROUP BY ALL) SELECT 'seconds_bucket{event_type="' || event_type || '",le="' || coalesce(le::VARCHAR, '+Inf') || '"} ' || n AS line FROM c""")
def metrics_page(spark, d):
    """K7 over ST5."""
    return files.exposition(state.latency_histogram(table(spark, d, "events"), "event_type", "value"), "seconds_bucket", ["event_type", "le"], "n")


@query("tuning_pairs", f"SELECT e.clause_type, 'Extract.' AS instruction, c.clause AS input, e.data AS output, '<|user|>' || chr(10) || 'Extract.' || chr(10) || chr(10) || c.clause || chr(10) || '<|assistant|>' || chr(10) || e.data AS chat FROM {X.EXTRACTIONS.sql()} e JOIN {X.LAWS.sql()} c USING (chunk_id) WHERE e.data IS NOT NULL AND c.clause IS NOT NULL")
def tuning_pairs(spark, d):
    j = X.EXTRACTIONS.df(spark, d).join(X.LAWS.df(spark, d).select("chunk_id", "clause"), "chunk_id")
    return learn.tuning_pairs(j, "Extract.")


@query("label_split")
def label_split(spark, d):
    """O9, O10 on labels: by hash, which SQL engines do not share."""
    s = learn.stratified_split(table(spark, d, "labels"), "doc_id", "quality")
    return s.groupBy("quality", "held_out").agg(F.count(F.lit(1)).alias("n"))


@query("embed_documents")
def embed_documents(spark, d):
    """M2 with the hashing encoder."""
    return learn.embed(table(spark, d, "documents").select("doc_id", "text"), learn.hashing_encoder(64)).select("doc_id", "embedding")


@query("classifier_metrics")
def classifier_metrics(spark, d):
    """M3, M4: a model of document quality on hashed words, its strength by macro-F1 of five folds, judged on held-out rows."""
    docs = learn.embed(table(spark, d, "documents").select("doc_id", "text"), learn.hashing_encoder(64))
    rows = learn.split_by_hash(docs.join(table(spark, d, "labels"), "doc_id"), "doc_id", 0.2)
    model = learn.train_classifier(rows.where("not held_out"), "quality", strengths=(0.1, 0.5, 1.0, 5.0, 10.0), folds=5, key="doc_id")
    from pyspark.ml.functions import array_to_vector

    scored = model.transform(rows.where("held_out").select("quality", array_to_vector("embedding").alias("features")))
    c = scored.select((F.col("quality") == 1).alias("t"), (F.col("prediction") == 1).alias("p")).agg(F.count_if(F.col("t") & F.col("p")).alias("tp"), F.count_if(~F.col("t") & F.col("p")).alias("fp"), F.count_if(F.col("t") & ~F.col("p")).alias("fn"), F.count_if(~F.col("t") & ~F.col("p")).alias("tn"), F.count(F.lit(1)).alias("total"))
    return evaluate.field_metrics(c)


@query("classifier_calibration")
def classifier_calibration(spark, d):
    """M4: strength by macro-F1 of five folds, and the calibration error before and after sigmoids on out-of-fold scores."""
    docs = learn.embed(table(spark, d, "documents").select("doc_id", "text"), learn.hashing_encoder(64))
    rows = docs.join(table(spark, d, "labels"), "doc_id").select("doc_id", "quality", "embedding")
    return calibrate.report(calibrate.cross_validated(rows, "doc_id", "quality"))


@query("compare_contracts")
def compare_contracts(spark, d):
    """X9 with the default extractor: neighbouring clauses of one type as the contracts of a group."""
    from clauselake.operators import compare

    laws = X.LAWS.df(spark, d).where("clause_type = 'payment'").select(F.floor(F.col("chunk_id") / 24).alias("grp"), F.col("chunk_id").alias("ord"), F.concat(F.lit("c"), F.col("chunk_id").cast("string")).alias("name"), "clause")
    return compare.compare_contracts(laws, "payment")
