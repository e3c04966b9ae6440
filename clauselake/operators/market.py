"""Market statistics over extraction records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.functions import packs


def unpivot_bools(records: DataFrame, data: str = "data", kind: str = "clause_type") -> DataFrame:
    """A row (record columns, field, value) for each boolean field that the record's type registers. An unknown
    type has liability's fields; null where the record does not say."""
    fields = lambda t: F.array(*[F.struct(F.lit(f).alias("field"), F.get_json_object(F.col(data), p).alias("v")) for f, p in packs.BOOL_FIELDS[t]])
    listed = F.when(F.lit(False), fields("liability"))
    for t in packs.CLAUSE_TYPES[1:]:
        listed = listed.when(F.col(kind) == t, fields(t))
    return records.withColumn("__f", F.explode(listed.otherwise(fields("liability")))).select(*[c for c in records.columns if c != data], F.col("__f.field").alias("field"), F.col("__f.v").try_cast("boolean").alias("value"))


def unpivot_categories(records: DataFrame, data: str = "data", kind: str = "clause_type") -> DataFrame:
    fields = lambda t: F.array(*[F.struct(F.lit(f).alias("field"), F.get_json_object(F.col(data), p).alias("value")) for f, p in packs.CATEGORY_FIELDS[t]])
    listed = F.when(F.lit(False), fields("liability"))
    for t in packs.CLAUSE_TYPES[1:]:
        if packs.CATEGORY_FIELDS[t]:
            listed = listed.when(F.col(kind) == t, fields(t))
    listed = listed.when(F.col(kind) != "confidentiality", fields("liability"))
    return records.withColumn("__f", F.explode(listed)).select(*[c for c in records.columns if c != data], F.col("__f.field").alias("field"), F.col("__f.value").alias("value"))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 part / whole, rounded half to even; 0 where whole is 0."""
    return F.coalesce(F.bround(F.try_divide(100.0 * part, whole), digits), F.lit(0.0))


def bool_distribution(values: DataFrame, *keys: str) -> DataFrame:
    """A1: true, false and total counts and the share of true, by keys; nulls are not counted."""
    t, n = F.count_if(F.col("value")), F.count("value")
    return values.groupBy(*keys).agg(t.alias("n_true"), F.count_if(~F.col("value")).alias("n_false"), n.alias("n_total"), percent(t, n).alias("true_pct"))


def cat_distribution(values: DataFrame, *keys: str) -> DataFrame:
    """A2, long form: how often each value occurs, by keys; nulls are not counted."""
    return values.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))


def percentile(value: Column, pct: Column) -> Column:
    """A4: how far the market agrees: the share of true for true, the rest for false, null for null."""
    return F.when(value, pct).when(~value, F.bround(100 - pct, 1))


def composite(pcts: DataFrame, *keys: str) -> DataFrame:
    """A5: the mean percentile rounded half up, 50 without any, and its verdict. Percentiles are added up as millionths, so
    that the order of rows does not decide a tie."""
    out = pcts.groupBy(*keys).agg(F.sum(F.round(F.col("percentile") * 1e6).cast("long")).alias("__s"), F.count("percentile").alias("__n"))
    mean = F.expr("(2 * __s + 1000000 * __n) div nullif(2000000 * __n, 0)")
    out = out.select(*keys, F.coalesce(mean, F.lit(50)).cast("long").alias("composite"))
    return out.withColumn("verdict", F.when(F.col("composite") >= 60, "favorable").when(F.col("composite") >= 40, "neutral").otherwise("unfavorable"))


def benchmark_rows(hits: DataFrame, extractions: DataFrame, contracts: DataFrame) -> DataFrame:
    """Hits with the extraction and the contract of each, where there are any; a missing company is ''."""
    j = hits.join(extractions.select("chunk_id", "clause_type", "data"), ["chunk_id", "clause_type"], "left").join(contracts.select("contract_id", "company", "filed_date"), "contract_id", "left")
    return j.withColumn("company", F.coalesce("company", F.lit("")))


def coverage(chunks: DataFrame, extractions: DataFrame, types: DataFrame) -> DataFrame:
    """Of each listed type, chunks, extractions and their share in percent."""
    c = chunks.groupBy("clause_type").agg(F.count(F.lit(1)).alias("n_chunks"))
    e = extractions.groupBy("clause_type").agg(F.count(F.lit(1)).alias("n_extractions"))
    j = types.select("clause_type").join(c, "clause_type", "left").join(e, "clause_type", "left").na.fill(0, ["n_chunks", "n_extractions"])
    return j.withColumn("coverage_pct", percent(F.col("n_extractions"), F.col("n_chunks")))


def pending(chunks: DataFrame, extractions: DataFrame, clause_type: str, limit: int) -> DataFrame:
    """The first `limit` chunks of a type that have no extraction; the limit comes before the test, as a run with
    a limit looks at so many chunks and no more."""
    first = chunks.where(F.col("clause_type") == clause_type).orderBy("chunk_id").limit(limit)
    return first.join(extractions.where(F.col("clause_type") == clause_type).select("chunk_id"), "chunk_id", "left_anti")


def market_context(dist: DataFrame, clause_type: str) -> DataFrame:
    """One text with a line for each field's share, in order of fields."""
    line = F.concat(F.lit("- "), "field", F.lit(": "), F.format_string("%.1f", "true_pct"), F.lit("% of "), F.col("n_total").cast("string"))
    return dist.where(F.col("clause_type") == clause_type).groupBy("clause_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field", line.alias("l")))), lambda x: x["l"]), "\n").alias("context"))


def coverage_report(covered: DataFrame) -> DataFrame:
    """A10: coverage() with its share as text, N/A for a type without chunks."""
    share = F.when(F.col("n_chunks") == 0, "N/A").otherwise(F.format_string("%.1f%%", "coverage_pct"))
    return covered.withColumn("coverage", share)


def citations(rows: DataFrame, most: int = 5) -> DataFrame:
    """By query the companies of its nearest rows that have a record, at most `most`, in the order of ranks."""
    w = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    some = rows.where(F.col("data").isNotNull()).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most)
    return some.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "company"))), lambda x: x["company"]).alias("cited"))


def benchmark(queries: DataFrame, hits: DataFrame, extractions: DataFrame, contracts: DataFrame, most: int = 5) -> DataFrame:
    """X5 from the hits on: query_id, sample_size, composite, verdict and cited for each clause that is benchmarked.

    queries: query_id, clause_type, data (the clause's own record, null where its extraction failed); hits: query_id,
    chunk_id, contract_id, clause_type, rank. A clause without hits has a sample of size 0 and nothing else.
    """
    rows = benchmark_rows(hits, extractions, contracts)
    size = rows.groupBy("query_id").agg(F.count("data").alias("sample_size"))
    market = unpivot_bools(rows.select("query_id", "clause_type", "data").where(F.col("data").isNotNull()))
    dist = bool_distribution(market, "query_id", "field")
    own = unpivot_bools(queries.select("query_id", "clause_type", "data"))
    pcts = own.join(dist.where("n_total > 0"), ["query_id", "field"]).withColumn("percentile", percentile(F.col("value"), F.col("true_pct")))
    verdicts = composite(pcts, "query_id")
    out = queries.select("query_id").join(size, "query_id", "left").join(verdicts, "query_id", "left").join(citations(rows, most), "query_id", "left")
    out = out.withColumn("sample_size", F.coalesce("sample_size", F.lit(0)))
    some = F.col("sample_size") > 0
    neutral = F.when(some, F.coalesce("composite", F.lit(50)))
    return out.select("query_id", "sample_size", neutral.alias("composite"), F.when(some, F.coalesce("verdict", F.lit("neutral"))).alias("verdict"), F.array_join(F.coalesce("cited", F.array().cast("array<string>")), "|").alias("cited"))


def for_keys(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """The rows whose key is in a set of keys."""
    return rows.join(keys.select(*on).distinct(), list(on), "left_semi")
