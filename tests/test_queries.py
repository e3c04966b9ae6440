import pytest

from __spark_entry__ import entry
from clauselake.plans import catalog
from tests import duck

#: Queries that SQL does not express, and where a model or an invariant holds them.
MODELS = {
    "analyze_regex": "test_detect.test_analyze_query_against_plain",
    "analyze_document": "test_detect.test_analyze_document_against_sections",
    "greedy_dedup": "test_detect.test_greedy_dedup_query_takes_whole_documents",
    "chunk_contract": "test_models.test_chunks",
    "compare_contracts": "test_models.test_compare_contracts",
    "label_split": "test_models.test_label_split",
    "embed_documents": "test_models.test_embed_documents",
    "classifier_calibration": "test_calibrate.test_calibration_lowers_the_error",
    "quota_limits": "test_quotas.test_table_against_plain",
    "knn_index": "test_index.test_recall",
    "classifier_metrics": "test_models.test_classifier_metrics",
}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, name):
    duck.same(catalog.queries()[name](spark, duck.DATA), catalog.oracle_sql()[name])


def test_every_other_query_has_a_model():
    import importlib

    assert set(catalog.queries()) - set(catalog.oracle_sql()) == set(MODELS)
    for place in MODELS.values():
        module, name = place.split(".")
        assert callable(getattr(importlib.import_module(f"tests.{module}"), name))


def test_entry(spark):
    assert entry(spark).count() > 0
