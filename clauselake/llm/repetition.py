"""Quality rules on repetition: how much of a text lies in n-grams and lines that occur more than once in it.

Words of a block of texts become one array of hashes; windows of several lengths are hashed by a rolling
polynomial over the whole array, tied to their text, and sorted, so that equal neighbours are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.batches import WordHashes, blocks, mix, windows
from clauselake.session import ship

#: Lengths of the n-grams, and the share of a text's characters in repeated ones above which it fails.
NGRAM_LIMITS = ((5, 0.30), (7, 0.27), (10, 0.24))
#: The share of the characters that lie in lines equal to an earlier line above which a text fails.
LINE_LIMIT = 0.30
#: The share of words that symbols make up above which a text fails.
SYMBOL_LIMIT = 0.25

_SPACE, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SYMBOL[list(b"#*$%&|<>")] = True


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        s = keys[order]
        same = s[1:] == s[:-1]
        hit = np.zeros(len(keys), bool)
        hit[1:] |= same
        hit[:-1] |= same
        out[order] = hit
    return out


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of `values` between neighbouring bounds."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[bounds])


def measure(texts: list[bytes], hashes: WordHashes, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """For each text: n_words, word_chars, n_symbols, n_dup_lines, dup_line_chars, and repeated_words_n and
    repeated_chars_n for each length n: words, and characters in words, inside windows of n words found twice or more."""
    words: list[bytes] = []
    counts, dup_lines, dup_chars = [], [], []
    for t in texts:
        w = t.split()
        counts.append(len(w))
        words += w
        seen: set[bytes] = set()
        n = c = 0
        if b"\n" in t:
            for line in t.split(b"\n"):
                if line in seen:
                    n += 1
                    c += len(line.decode("utf-8", "replace"))
                elif line and not line.isspace():
                    seen.add(line)
        dup_lines.append(n)
        dup_chars.append(c)
    n_words = np.array(counts, np.int64)
    at = np.concatenate([[0], np.cumsum(n_words)])
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.concatenate([[0], ends])
    space = _SPACE[raw]
    letter = ~space & ((raw & 0xC0) != 0x80)
    out = {"n_words": n_words, "word_chars": _sums(letter, bounds), "n_symbols": _sums(_SYMBOL[raw], bounds), "n_dup_lines": np.array(dup_lines, np.int64), "dup_line_chars": np.array(dup_chars, np.int64)}
    step = np.diff(np.concatenate([[True], space]).astype(np.int8))
    begins = np.flatnonzero(step == -1)
    stops = np.flatnonzero(step == 1)  # every word is followed by a space: the texts were joined by line feeds
    chars = np.concatenate([[0], np.cumsum(letter, dtype=np.int64)])
    sizes = chars[stops] - chars[begins]
    h = hashes.of(words)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), n_words)
    for n in lengths:
        covered = np.zeros(len(h), bool)
        keys = windows(h, n)
        if len(keys):
            whole = doc[: len(keys)] == doc[n - 1 :]
            where = np.flatnonzero(whole)
            hit = where[repeated(mix(keys[where] ^ mix(doc[where] + np.uint64(1))))]
            edge = np.zeros(len(h) + 1, np.int32)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + n, -1)
            covered = np.cumsum(edge[:-1]) > 0
        out[f"repeated_words_{n}"] = _sums(covered, at)
        out[f"repeated_chars_{n}"] = _sums(sizes * covered, at)
    return out


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = (5, 7, 10)) -> DataFrame:
    """The id of each row and what measure() says of its text.

    A null text counts as empty; empty and blank texts have zeros everywhere. Rows are independent: repeated rows
    give repeated results. Texts are worked on in blocks of bounded size, without a shuffle. No other column is read.
    """
    ship(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "dup_line_chars", *(f"repeated_{what}_{n}" for n in lengths for what in ("words", "chars"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch, texts in blocks(batches, "text"):
            found = measure(texts, hashes, lengths)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[k], pa.int64()) for k in names)], ["id", *names])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, " + ", ".join(f"{k} long" for k in names))
    return out.withColumnRenamed("id", id_col)


def judged(measured: DataFrame) -> DataFrame:
    """With base_failed (few words, or many in repeated windows of five) and kept (no rule fails). A text without words
    fails for having few; a share of exactly a limit passes."""
    chars = F.greatest("word_chars", F.lit(1))
    fails = [F.col(f"repeated_chars_{n}") > most * chars for n, most in NGRAM_LIMITS]
    fails.append(F.col("dup_line_chars") > LINE_LIMIT * chars)
    fails.append(F.col("n_symbols") > SYMBOL_LIMIT * F.col("n_words"))
    bad = fails[0]
    for f in fails[1:]:
        bad = bad | f
    failed = (F.col("n_words") < 10) | (100 * F.col("repeated_words_5") > 20 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & ~bad)


def query(docs: DataFrame) -> DataFrame:
    """repetition() and judged() of all documents; nulls, empty and long texts, repeated rows and empty tables as there."""
    found = judged(repetition(docs, lengths=tuple(n for n, _ in NGRAM_LIMITS)))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.col("repeated_words_5").alias("n_repeat_words"), "base_failed", "kept", "repeated_chars_7", "repeated_chars_10")
