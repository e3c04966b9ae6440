"""Which texts have which passages, by fingerprints instead of comparing each text with each passage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.functions.batches import sliced
from clauselake.session import materialize, ship, sized

#: Bytes of a window, and windows of a group. A passage of so many bytes that it fills a group has the least of its
#: windows' hashes in common with every text that it is part of.
WINDOW, GROUP = 8, 16
SHORTEST = WINDOW + GROUP - 1


def _hashes(text: bytes) -> np.ndarray:
    """A hash of each window."""
    b = np.frombuffer(text, np.uint8)
    out = np.zeros(len(b) - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        out = (out << np.uint64(8)) | b[k : k + len(out)]
    out = out * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def fingerprints(text: bytes) -> np.ndarray:
    """The least hash of each group of neighbouring windows, each once; none if the text does not fill a group."""
    if len(text) < SHORTEST:
        return np.empty(0, np.uint64)
    least, width = _hashes(text), 1
    while width < GROUP:  # GROUP is a power of two
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    return np.unique(least)


def _marks(rows: DataFrame, key: str, text: str, one: bool) -> DataFrame:
    """key and fp of each fingerprint of the rows' texts; with `one`, of the first group alone."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in sliced(batch.column(1)):
                keys = batch.column(0).slice(begin, end - begin)
                marks = [fingerprints((t or "").encode()[: SHORTEST if one else None]).astype(np.int64) for t in batch.column(1).slice(begin, end - begin).to_pylist()]
                at = np.repeat(np.arange(len(keys)), [len(m) for m in marks])
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(np.concatenate([*marks, np.empty(0, np.int64)]))], ["key", "fp"])

    source = rows.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, fp long").withColumnRenamed("key", key)


def containing(texts: DataFrame, passages: DataFrame, text_key: str, text: str, passage_key: str, passage: str) -> DataFrame:
    """The rows of `texts` joined with those of `passages` whose passage they contain, which is to be told apart in case.

    A passage meets the texts that have its first group's fingerprint, by an equal join, and is looked for in those
    only; there is no limit on passages. Passages that are too short for a fingerprint meet every text, and are
    broadcast behind a check of their size. A null or empty passage is in none; of a text key that repeats, every row
    is looked at, null keys are not.
    """
    held = materialize(passages.where(F.length(passage) > 0), "passages")
    long = held.where(F.octet_length(passage) >= SHORTEST)
    pairs = _marks(texts, text_key, text, False).join(_marks(long, passage_key, passage, True), "fp").select(text_key, passage_key).distinct()
    pairs = sized(pairs, "passage-pairs")
    # keys at first and the long texts last, so that few of them travel
    found = texts.join(pairs, text_key).join(held, passage_key)
    out = found.where(F.contains(text, passage))
    short = held.where(F.octet_length(passage) < SHORTEST)
    if not short.isEmpty():
        out = out.unionByName(texts.join(sized(short, "passages-short"), F.contains(text, passage)))
    return out
