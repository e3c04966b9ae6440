"""Comparison of contracts field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.functions import packs

#: Contracts that a comparison has, at least and at most.
LEAST, MOST = 2, 5


def comparison_problem(n_contracts: Column, clause_type: Column) -> Column:
    """why a comparison is refused; null if it is not."""
    return F.when(n_contracts < LEAST, "too few").when(n_contracts > MOST, "too many").when(clause_type.isNull() | ~clause_type.isin(*packs.CLAUSE_TYPES), "unknown type")


def field_comparison(values: DataFrame, names: list[str], name_col: str = "name", group: tuple[str, ...] = ()) -> DataFrame:
    """A row for each field, by group, with the value of each contract as text, and whether they differ: two or
    more values are stated and not all are the same. values: group, name, field, value."""
    text = F.col("value").cast("string")
    each = [F.max(F.when(F.col(name_col) == n, text)).alias(n) for n in names]
    return values.groupBy(*group, "field").agg(*each, ((F.count("value") >= 2) & (F.min(text) != F.max(text))).alias("differs"))


def favorable_scores(values: DataFrame, *keys: str) -> DataFrame:
    """How many stated boolean fields favour the reader, by contract; some fields are better false."""
    good = F.col("value") != F.col("field").isin(*packs.UNFAVORABLE)
    return values.groupBy(*keys).agg(F.count_if(good).alias("favorable"), F.count("value").alias("stated"))


def recommendation(scores: DataFrame, group: str, name_col: str = "name", order: str = "ord") -> DataFrame:
    """By group the leading contract, those it ties with, and its lead over the next, in input order on ties."""
    w = Window.partitionBy(group)
    ranked = scores.withColumns({"r": F.row_number().over(w.orderBy(F.desc("favorable"), order)), "best": F.max("favorable").over(w)})
    return ranked.groupBy(group).agg(
        F.min_by(name_col, "r").alias("leader"),
        F.max("best").alias("best"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("favorable") == F.col("best"), F.struct(order, name_col)))), lambda x: x[name_col]), " and ").alias("tied"),
        (F.max("best") - F.coalesce(F.max(F.when(F.col("r") == 2, F.col("favorable"))), F.lit(0))).alias("lead"),
        F.coalesce(F.max(F.when(F.col("r") == 2, F.col(name_col))), F.lit("")).alias("second"),
        F.count_if(F.col("favorable") == F.col("best")).alias("n_best"),
        F.max("stated").alias("of"),
    )


def advice(r: DataFrame) -> DataFrame:
    """`r`, of recommendation(), with `recommendation` as a sentence (fixed formats)."""
    none = F.lit("Could not determine a recommendation — extraction failed for all contracts.")
    tied = F.format_string("%s are tied with %d favorable fields out of %d evaluated.", "tied", "best", "of")
    one = F.format_string("%s provides stronger protections with %d favorable fields out of %d evaluated, leading %s by %d field(s).", "leader", "best", "of", "second", "lead")
    return r.withColumn("recommendation", F.when(F.col("of").isNull() | (F.col("of") == 0), none).when(F.col("n_best") > 1, tied).otherwise(one))


def compare_contracts(contracts: DataFrame, clause_type: str, group: str = "grp", order: str = "ord", name_col: str = "name", text_col: str = "clause") -> DataFrame:
    """By group of contracts: problem, recommendation and the fields that differ, with the default extractor.

    A group of another size than LEAST to MOST has its problem and nothing else. A null text states nothing. Names should
    differ within a group; equal ones count together.
    """
    from clauselake.operators import extract, market

    if clause_type not in packs.CLAUSE_TYPES:
        raise ValueError(f"unknown clause type {clause_type!r}")
    sized = contracts.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    sized = sized.withColumn("problem", comparison_problem(F.col("n"), F.lit(clause_type)))
    some = contracts.join(sized.where("problem IS NULL").select(group), group)
    records = extract.as_record(extract.extract_fields(some.withColumn("clause_type", F.lit(clause_type)), clause_type, text_col), clause_type)
    values = market.unpivot_bools(records.select(group, order, name_col, "clause_type", F.when(F.col(text_col).isNotNull(), F.col("data")).alias("data")))
    scores = favorable_scores(values, group, name_col, order)
    told = advice(recommendation(scores, group, name_col, order)).select(group, "leader", "recommendation")
    text = F.col("value").cast("string")
    differ = values.groupBy(group, "field").agg(((F.count("value") >= 2) & (F.min(text) != F.max(text))).alias("differs"))
    differ = differ.where("differs").groupBy(group).agg(F.array_join(F.array_sort(F.collect_list("field")), ",").alias("differing"))
    return sized.select(group, "problem").join(told, group, "left").join(differ, group, "left")


def usable_suggestions(suggestions: DataFrame) -> DataFrame:
    """those that change or add something; missing texts become '', a missing priority medium."""
    out = suggestions.withColumns({"original": F.coalesce("original", F.lit("")), "proposed": F.coalesce("proposed", F.lit("")), "priority": F.coalesce("priority", F.lit("medium"))})
    return out.where((F.col("original") != "") | (F.col("proposed") != ""))
