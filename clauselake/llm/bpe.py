"""Byte-level BPE encoding and decoding, merging by a queue of ranks with a hierarchical bitmap.

The symbols of a pre-token form a linked list. Each adjacent pair that has a rank lies in the bucket of that rank,
by position. A bitmap of two levels says which buckets are in use; find-first-set gives the lowest rank. Entries
whose pair has changed since are stale and skipped when they come up. A merge costs constant time, but for one that
makes a pair of its own or a lower rank, after which the rest of its bucket waits anew; trained vocabularies rank a
token behind its parts, so that with them a pre-token of n bytes takes time in proportion to n, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.batches import blocks
from clauselake.session import ship

#: Bits of a rank that the lower level of the bitmap holds.
LOW_BITS = 8
#: Ranks of a vocabulary that is broadcast, at most; the bitmap's levels would serve more.
MOST_RANKS = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _Known(dict):
    """The ids of pre-tokens in decimal, joined by commas: those met of late, and below them those met before, which are
    dropped when the newer half is full."""

    def __init__(self, merge, most: int):
        self.merge, self.most, self.older = merge, most, {}

    def __missing__(self, piece: str) -> str:
        found = self.older.get(piece) or ",".join(map(str, self.merge(piece.encode())))
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


class ByteBpe:
    """Encodes and decodes with a vocabulary of ranks and a pattern that cuts texts into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remember: int = 450_000):
        self.ranks, self.cut = ranks, regex.compile(pattern).findall
        self.tokens = {r: t for t, r in ranks.items()}
        self.named = {str(r): t for t, r in ranks.items()}
        self.known = _Known(self.merge, remember)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token. A bucket is a position, or a list of several."""
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        end = list(range(1, n + 1))  # where the symbol that starts here ends; so also the next symbol's start
        back = list(range(-1, n))  # the start of the symbol before this one
        live = [rank_of(piece[i : i + 2], -1) for i in range(n - 1)]  # the rank under which the pair that starts here is queued; -1: none
        live += (-1, -1)
        buckets: dict[int, int | list[int]] = {}
        top, low = 0, {}
        for i in range(n - 1):
            r = live[i]
            if r >= 0:
                held = buckets.get(r)
                if held is None:
                    buckets[r] = i
                    h = r >> LOW_BITS
                    low[h] = low.get(h, 0) | 1 << (r & 255)
                    top |= 1 << h
                elif held.__class__ is int:
                    buckets[r] = [held, i]
                else:
                    held.append(i)
        while top:
            h = (top & -top).bit_length() - 1
            word = low[h]
            r = (h << LOW_BITS) | ((word & -word).bit_length() - 1)
            bucket = buckets.pop(r)
            word &= word - 1
            if word:
                low[h] = word
            else:
                del low[h]
                top &= top - 1
            if bucket.__class__ is int:
                bucket = (bucket,)
            else:
                bucket.sort()  # leftmost first; entries arrive nearly sorted
            for k, i in enumerate(bucket):
                if live[i] != r:
                    continue  # stale
                least = r + 1
                mid = end[i]
                end[i] = to = end[mid]
                live[mid] = live[i] = -1
                p = back[i]
                pairs = ()
                if to < n:
                    back[to] = i
                    q = rank_of(piece[i : end[to]])
                    if q is not None:
                        live[i] = q
                        pairs = ((q, i),)
                if p >= 0:
                    q = rank_of(piece[p:to], -1)
                    if live[p] != q:
                        live[p] = q
                        if q >= 0:
                            pairs += ((q, p),)
                for q, at in pairs:
                    if q < least:
                        least = q
                    held = buckets.get(q)
                    if held is None:
                        buckets[q] = at
                        h = q >> LOW_BITS
                        low[h] = low.get(h, 0) | 1 << (q & 255)
                        top |= 1 << h
                    elif held.__class__ is int:
                        buckets[q] = [held, at]
                    else:
                        held.append(at)
                if least <= r:  # a new pair goes before what is left of this bucket
                    if rest := list(bucket[k + 1 :]):
                        held = buckets.get(r)
                        if held is None:
                            buckets[r] = rest
                            h = r >> LOW_BITS
                            low[h] = low.get(h, 0) | 1 << (r & 255)
                            top |= 1 << h
                        else:
                            buckets[r] = rest + ([held] if held.__class__ is int else held)
                    break
        out, i, ranks = [], 0, self.ranks
        while i < n:
            to = end[i]
            out.append(ranks[piece[i:to]])
            i = to
        return out

    def said(self, text: str) -> str:
        """The ids of a text in decimal, joined by commas."""
        return ",".join(map(self.known.__getitem__, self.cut(text)))

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.said(text).split(","))) if text else []

    def decode(self, ids: list[int]) -> bytes | None:
        """The bytes of ids; None if the vocabulary lacks one."""
        found = [self.tokens.get(i) for i in ids]
        return None if None in found else b"".join(found)

    def digests(self, text: str) -> tuple[int, str, str, list[str]]:
        """The number of ids, the SHA-256 of the ids in decimal and of the bytes they decode to, and the ids."""
        said = self.said(text)
        ids = said.split(",") if said else []
        return len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(b"".join(map(self.named.__getitem__, ids))).hexdigest(), ids

    def told(self, texts: list[bytes], ids: bool) -> list[tuple]:
        """digests() of UTF-8 texts; without ids, which take many times a text's memory, each text's are let go at once."""
        most = 4 if ids else 3
        return [self.digests(t.decode("utf-8", "replace"))[:most] for t in texts]


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def tokenizer(path: str, pattern: str) -> ByteBpe:
    """The tokenizer of a rank file that this process can read."""
    return loaded(load_ranks(path), path, pattern)


def loaded(ranks: dict[bytes, int], name: str, pattern: str) -> ByteBpe:
    """The tokenizer of `ranks`, made once in each worker; `name` stands for what is in them."""
    if (name, pattern) not in _LOADED:
        _LOADED[name, pattern] = ByteBpe(ranks, pattern)
    return _LOADED[name, pattern]


def _shared(df: DataFrame, path: str):
    """The vocabulary of a file that the driver reads, as a broadcast of bounded size, and a name for its contents."""
    with open(path, "rb") as f:
        name = hashlib.sha256(f.read()).hexdigest()
    ranks = load_ranks(path)
    if len(ranks) > MOST_RANKS:
        raise ValueError(f"more than {MOST_RANKS} ranks")
    return df.sparkSession.sparkContext.broadcast(ranks), name


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 for each row of `docs`; with ids=True also the ids themselves.

    Null and empty texts have no tokens, and the digests of the empty string. Rows are worked on one by one, in
    blocks of bounded size, with no shuffle; a text of any length takes memory in proportion to itself. The driver
    reads the rank file and broadcasts it. Equal texts give equal rows. Other columns of `docs` are not read. An empty
    table gives an empty result.
    """
    ship(docs.sparkSession)
    ranks, name = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ranks.value, name, pattern)
        for batch, texts in blocks(batches, "text"):
            rows = bpe.told(texts, ids)
            out = [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                out.append(pa.array([list(map(int, r[3])) for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else ""))
    return out.withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and the decoded text of each row's ids. Null and empty ids give an empty text, ids with one that the
    vocabulary lacks a null text; malformed UTF-8 is replaced. Other columns are not read."""
    ship(encoded.sparkSession)
    ranks, name = _shared(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ranks.value, name, pattern)
        for batch in batches:
            found = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else t.decode("utf-8", "replace") for t in found], pa.string())], ["id", "text"])

    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def query(docs: DataFrame) -> DataFrame:
    """encode_documents() with the public vocabulary; nulls, empty and very long texts, repeated rows and empty tables as
    there."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
