"""The registered queries of this subpackage, one thin query for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clauselake.llm import bpe, exact_dedup, lm, minhash, mixing, neighbours, patterns, phrases, pii, repetition, setjoin, toxicity, warc
from clauselake.session import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_backoff_lm": lambda spark, d: lm.query(table(spark, d, "documents")),
        "op2_personal_data": lambda spark, d: pii.query(table(spark, d, "documents")),
        "op3_warc": lambda spark, d: warc.query(table(spark, d, "pages")),
        "op4_source_mixing": lambda spark, d: mixing.query(table(spark, d, "documents")),
        "op5_repetition_rules": lambda spark, d: repetition.query(table(spark, d, "documents")),
        "op6_neighbour_quality": lambda spark, d: neighbours.query(table(spark, d, "documents"), table(spark, d, "labels")),
        "op7_minhash": lambda spark, d: minhash.query(table(spark, d, "documents")),
        "op8_exact_dedup": lambda spark, d: exact_dedup.query(table(spark, d, "documents")),
        "op9_toxicity": lambda spark, d: toxicity.query(table(spark, d, "documents"), table(spark, d, "labels")),
        "op10_byte_bpe": lambda spark, d: bpe.query(table(spark, d, "documents")),
        "op11_jaccard_join": lambda spark, d: setjoin.query(table(spark, d, "documents")),
        "op12_row_pattern": lambda spark, d: patterns.query(table(spark, d, "clicks")),
        "op13_collocations": lambda spark, d: phrases.query(table(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": warc.SQL, "op8_exact_dedup": exact_dedup.SQL, "op12_row_pattern": patterns.SQL, "op13_collocations": phrases.SQL}
