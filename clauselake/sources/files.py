"""Files in and out: manifests, JSON lines, cached embeddings, uploads, paged search."""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def manifest_texts(spark: SparkSession, manifest: str, folder: str) -> DataFrame:
    """Rows of a JSON manifest with the text of each one's file; rows whose file is missing drop out."""
    rows = spark.read.option("multiLine", True).json(manifest)
    texts = spark.read.option("wholetext", True).text(f"{folder}/*").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.col("value").alias("text"))
    return rows.join(texts, "filename")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S16."""
    return spark.read.schema(schema).json(path)


def read_examples(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Evaluation examples from a JSON array: id, clause and the columns of each one's nested ground_truth, whose
    fields are given as a schema."""
    schema = f"id long, clause_text string, ground_truth struct<{fields}>"
    return spark.read.option("multiLine", True).schema(schema).json(path).select("id", F.col("clause_text").alias("clause"), "ground_truth.*")


def write_jsonl(rows: DataFrame, path: str) -> None:
    """S16, K5."""
    rows.write.mode("overwrite").json(path)


def as_json(rows: DataFrame) -> DataFrame:
    """K6: each row as one JSON text."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def exposition(metrics: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """K7: lines of a metrics page: name{label="value",...} number."""
    inner = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.coalesce(F.col(c).cast("string"), F.lit("+Inf")), F.lit('"')) for c in labels])
    return metrics.select(F.concat(F.lit(name + "{"), inner, F.lit("} "), F.col(value).cast("string")).alias("line"))


def embedding_key(model: str, texts: Column) -> Column:
    """The name under which embeddings of a list of texts are kept."""
    return F.left(F.sha2(F.concat_ws("\0", F.lit(model), texts), 256), F.lit(16))


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at `path`; made and written there if it is not there yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.parquet(path)
        return spark.read.parquet(path)


def document_texts(files: DataFrame, extractor: Callable[[bytes], str] | None = None, ocr: Callable[[bytes], str] | None = None, least: int = 50) -> DataFrame:
    """Path, text, method of binary files. Where the extractor finds fewer than `least` characters, the OCR back
    end is asked; if it fails or is absent, what the extractor found stays."""

    def one(content: bytes) -> tuple[str, str]:
        text = ""
        try:
            text = extractor(content) if extractor else ""
        except Exception:  # noqa: BLE001  a broken file has no text
            text = ""
        if len(text.strip()) >= least or ocr is None:
            return text, "text"
        try:
            return ocr(content), "ocr"
        except Exception:  # noqa: BLE001
            return text, "text"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [one(bytes(c)) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "text": [t for t, _ in found], "method": [m for _, m in found]})

    return files.select("path", "content").mapInPandas(run, "path string, text string, method string")


@dataclass
class SearchQuery(InputPartition):
    ord: int
    text: str


def polite(fetch: Callable[[str, int], dict], least_gap: float = 0.1, tries: int = 3, sleep=time.sleep, clock=time.monotonic) -> Callable[[str, int], dict]:
    """`fetch`, not more often than every `least_gap` seconds, tried again after 1, 2, ... seconds."""
    last = [-1e9]

    def get(query: str, start: int) -> dict:
        for k in range(tries):
            wait = last[0] + least_gap - clock()
            if wait > 0:
                sleep(wait)
            last[0] = clock()
            try:
                return fetch(query, start)
            except OSError:
                if k + 1 == tries:
                    raise
                sleep(2.0**k)
        raise AssertionError

    return get


class PagedSearchReader(DataSourceReader):
    """A partition for each query; pages are asked for, not faster than politeness allows, until so many in a row
    are empty."""

    def __init__(self, options: dict):
        self.folder, self.queries = options["path"], json.loads(options["queries"])
        self.gap, self.empty, self.page = float(options.get("leastGap", 0.1)), int(options.get("emptyPages", 1)), int(options.get("pageSize", 100))

    def partitions(self):
        return [SearchQuery(i, q) for i, q in enumerate(self.queries)]

    def read(self, partition):
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(self.folder if "://" in self.folder else "file://" + self.folder)

        def fetch(query: str, start: int) -> dict:
            path = f"{folder}/{partition.ord}-{start}.json"
            if store.get_file_info(path).type != fs.FileType.File:
                return {"hits": []}
            with store.open_input_stream(path) as f:
                return json.loads(f.read())

        get, start, empty = polite(fetch, least_gap=self.gap), 0, 0
        while empty < self.empty:
            hits = get(partition.text, start)["hits"]
            empty = 0 if hits else empty + 1
            for i, h in enumerate(hits):
                yield partition.ord, start + i, h.get("id"), h.get("file_type"), json.dumps(h)
            start += len(hits) or self.page


class PagedSearch(DataSource):
    """format("paged_search"): saved answers of a paged search service. Options: path, queries (a JSON list),
    leastGap (seconds), emptyPages, pageSize."""

    @classmethod
    def name(cls):
        return "paged_search"

    def schema(self):
        return "query_ord int, rank int, hit_id string, file_type string, hit string"

    def reader(self, schema):
        return PagedSearchReader(self.options)
