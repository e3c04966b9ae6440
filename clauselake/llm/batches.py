"""Arrow batches and word hashes, as the operators on texts use them.

Words are runs of bytes other than space, tab, LF, VT, FF and CR; bytes.split() parts at just these, and
bytes.lower() changes A-Z alone, so both are exact and fast on the UTF-8 bytes of a text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once; a longer single text is worked on alone.
BLOCK_BYTES = 4 << 20


def give_back() -> None:
    """Returns to the system what this process has let go; a Python worker that is used again would keep what the task
    before took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # of glibc
        ctypes.CDLL(None).malloc_trim(0)


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most `most` bytes of text each, and their texts as UTF-8; null counts as empty."""
    give_back()
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            part = column.slice(at, to - at).cast(pa.large_binary())
            yield batch.slice(at, to - at), [x or b"" for x in part.to_pylist()]
            at = to


#: Bytes of a word that is remembered, at most; longer ones are worked out anew each time.
LONGEST_KEPT = 64


class WordHashes(dict):
    """64-bit hashes by word; remembers a bounded number of words of bounded length."""

    def __init__(self, most: int = 200_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.clear()
            self[word] = found
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def hashed(words: list[bytes]) -> np.ndarray:
    """The hashes of WordHashes, worked out anew for each word. That takes less time where words are of very many kinds,
    since a look-up has to hash the word, too, and to find it in memory."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each window of n words, by rolling polynomial; empty if there are fewer words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:count].copy()
    for k in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[k : k + count]
    return mix(out)


#: A-Z and their lower-case forms, for translate(), which leaves all other letters alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key as text, modulo `by`; null keys count as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(by))
