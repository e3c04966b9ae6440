import hashlib

import pytest

from __spark_entry__ import oracle_sql, queries
from clauselake.operators import market
from tests import duck


def agree(spark, path, monkeypatch, name, **tables):
    """The rows of a query over small tables, which are those of its SQL."""
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{path}/{table}.parquet")
    monkeypatch.setattr(duck, "DATA", str(path))
    found = queries()[name](spark, str(path))
    duck.same(found, oracle_sql()[name])
    return found.collect()


@pytest.mark.parametrize("values", [(77.1, 29.6, 17.8), (62.9, 50.7, 80.3, 44.1), (70.8, 9.5, 52.4, 12.6, 7.2), (70.6, 60.1, 92.7, 65.7, 15.7, 70.2)])
def test_composite_of_a_tie_goes_up(spark, values):
    """Sums that are odd multiples of a half of the number of values, which doubles fall short of."""
    tie = sum(round(10 * v) for v in values)
    assert tie % (10 * len(values)) == 5 * len(values)
    rows = spark.createDataFrame([("k", v) for v in values], "k string, percentile double").coalesce(1)
    assert market.composite(rows, "k").first()["composite"] == tie // (10 * len(values)) + 1


def test_benchmark_tie_against_sql(spark, tmp_path, monkeypatch):
    """The records of this clause's neighbours have a mean of 61.5."""
    orders = spark.createDataFrame([(k, k % 7) for k in range(135_300, 135_350)], "o_orderkey long, o_custkey long")
    customer = spark.createDataFrame([(k, f"C{k}") for k in range(7)], "c_custkey long, c_name string")
    assert [r["composite"] for r in agree(spark, tmp_path, monkeypatch, "benchmark_clauses", orders=orders, customer=customer)] == [62]


def test_values_by_sentences_against_sql(spark, tmp_path, monkeypatch):
    """A sum in one sentence and a limit in the next are no fixed amount; the clause's own sentence stands behind the text."""
    documents = spark.createDataFrame([(35, "It costs $5."), (36, None)], "doc_id long, text string")
    found = {(r["chunk_id"], r["field"]): r["value"] for r in agree(spark, tmp_path, monkeypatch, "extract_values", documents=documents)}
    assert found[35, "cap_type"] == "other"


def test_pages_with_open_entities_against_sql(spark, tmp_path, monkeypatch):
    """An entity may end without a semicolon, as where a title is cut."""
    pages = spark.createDataFrame([(1, "<p>A &amp;&amp</p><p>b &lt;c&gt &copy 1&nbsp;</p>"), (2, "<p>&amp;lt; &quot;x&quot</p>")], "page_id long, html string")
    found = {r["page_id"]: r["text_md5"] for r in agree(spark, tmp_path, monkeypatch, "html_parse", pages=pages)}
    assert found[2] == hashlib.md5(b'&lt; "x"').hexdigest()
