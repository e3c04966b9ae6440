"""Language-model scores from a weighted backoff automaton of words.

The model interpolates trigrams with bigrams with unigrams. A context that training saw is a state: two words that go
on in some trigram, one word, or the root. An n-gram is an arc of its context's state, weighted with the log10 of its
interpolated probability; a failure arc leads from a state to that of the shorter context, weighted with what the state
leaves to it. One traversal from left to right carries the state, takes arcs, or failure arcs until there is one, and
adds up the weights.

    P(w|uv) = l c(uvw)/k(uv) + (1 - l) P(w|v),  P(w|v) = m c(vw)/c(v) + (1 - m) P(w)

Trigrams count from LEAST_TRIGRAM occurrences on, as is usual for the highest order; k(uv) is the sum of those that do,
so each state's probabilities add up. l and m depend on the binary order of k and c and come from deleted interpolation:
each training token is judged by counts without itself.

Counts are gathered in packed blocks. A block holds the texts of some documents as numbers. It asks for the counts of its
distinct unigrams and bigrams, and at the same time contributes its own; both travel as sorted hashes to the bucket of
the hash, where contributions are added up and answers go back. Then it asks for its trigrams and contexts in the same
way, of which only those are sent that can occur twice, as both their bigrams do. So the part of the automaton that a
block can reach is built where the block is, and no task holds the model.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.batches import WordHashes, blocks, mix, remainder
from clauselake.session import discard, ship, written

#: Bytes of text in a block, and distinct n-grams of all blocks in a bucket, about.
BLOCK_BYTES, BUCKET_KEYS = 8 << 20, 1_000_000
#: Messages that a block sends at a time, at most. Where there are more buckets, messages are added up on the way, see
#: exchange().
MOST_FAN = 256
#: Occurrences from which on a trigram counts.
LEAST_TRIGRAM = 2
#: Tokens that a traversal takes in one lane.
LANE = 512
#: Tokens that are judged at once by what others say.
TOKENS = 1 << 17
#: Hashes of the end of a text and of what stands before its first word.
END, START = np.uint64(0x1234567890ABCDEF), np.uint64(0xFEDCBA0987654321)
#: Bins of log10 of an n-gram's probability over the shorter one's, from LEAST on in steps of STEP; bin 0 is for none.
LEAST, STEP, BINS, ORDERS = -4.0, 0.1, 141, 48


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; the bytes of numbers of 8 bytes are put plane by plane."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        out.append((a.dtype.str, a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()))
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(out))


def unpack(data: bytes) -> list[np.ndarray]:
    out = []
    for kind, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(data)):
        d = np.dtype(kind)
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(d.itemsize, -1).T).view(d).reshape(-1))
    return out


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct codes, and for each code its place among them. Codes and places are sorted as one number
    where they fit."""
    if not len(codes):
        return codes, np.empty(0, np.int32)
    bits = len(codes).bit_length()
    if int(codes.max()).bit_length() + bits > 63:
        found, inverse = np.unique(codes, return_inverse=True)
        return found, inverse.astype(np.int32)
    both = codes << bits
    both |= np.arange(len(codes))
    both.sort()
    codes = both >> bits
    new = np.empty(len(codes), bool)
    new[0] = True
    np.not_equal(codes[1:], codes[:-1], out=new[1:])
    codes = codes[new]
    both &= (1 << bits) - 1
    inverse = np.empty(len(both), np.int32)
    inverse[both] = np.cumsum(new, dtype=np.int32) - 1
    return codes, inverse


class Block:
    """Documents as numbers: the hashes of their distinct words, and each text as a row of places among them."""

    def __init__(self, words: np.ndarray, stream: np.ndarray, sizes: np.ndarray, held: np.ndarray):
        """words: sorted hashes, END among them; stream: places, each text closed by END; sizes: tokens of each text."""
        self.words, self.stream, self.sizes, self.held = words, stream.astype(np.int32), sizes, held.astype(bool)  # places take half of 8 bytes
        n, self.first = len(words), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.before = np.empty(len(stream), np.int32)
        self.before[1:] = self.stream[:-1]
        self.before[self.first] = n  # START
        self.codes, self.pair = distinct(self.before.astype(np.int64) * n + self.stream)
        keys = mix(mix(np.append(words, START)[self.codes // n]) + words[self.codes % n])
        self.order = np.argsort(keys)
        self.keys, self.pairs = keys, keys[self.order]
        self.context = np.empty(len(stream), np.int32)  # the pair before each token; -1 at the first of a text
        self.context[1:] = self.pair[:-1]
        self.context[self.first] = -1
        self.train = np.repeat(~self.held, sizes)

    @classmethod
    def of(cls, texts: list[bytes], held: np.ndarray, hashes: WordHashes) -> Block:
        parts, sizes = [], []
        for t in texts:
            w = t.lower().split()
            sizes.append(len(w) + 1)
            w.append(b"\n")
            parts.append(hashes.of(w))
        unique, stream = np.unique(np.concatenate(parts), return_inverse=True)
        return cls(unique, stream, np.array(sizes, np.int64), held)

    def packed(self) -> bytes:
        return pack(self.words, self.stream, self.sizes, self.held.astype(np.uint8))

    @classmethod
    def unpacked(cls, data: bytes) -> Block:
        words, stream, sizes, held = unpack(data)
        return cls(words, stream, sizes, held)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences in training documents, of words and of pairs, in the order of their keys."""
        one = np.bincount(self.stream[self.train], minlength=len(self.words))
        two = np.bincount(self.pair[self.train], minlength=len(self.order))[self.order]
        return one, two

    def trigrams(self, c2: np.ndarray) -> Trigrams:
        return Trigrams(self, c2)


class Trigrams:
    """The contexts and trigrams of a block that may be states and arcs: those whose pairs training has seen often enough,
    given c2, how often it has seen each pair of the block."""

    def __init__(self, block: Block, c2: np.ndarray):
        b, n = block, len(block.words)
        often = c2 >= LEAST_TRIGRAM
        self.some = (b.context >= 0) & often[b.context]  # tokens whose context may be a state
        self.contexts = np.unique(b.context[self.some])
        self.contexts = self.contexts[np.argsort(b.keys[self.contexts])]
        rank = np.full(len(c2), -1, np.int64)
        rank[self.contexts] = np.arange(len(self.contexts))
        self.rank = rank  # of a pair among the contexts, which are in the order of their keys
        self.both = self.some & often[b.pair]  # tokens whose trigram may be an arc
        codes, self.place = distinct(rank[b.context[self.both]] * n + b.stream[self.both])
        at, word = codes // n, codes % n
        low = (mix(b.words[word]) >> np.uint64(24)) | np.uint64(1)  # never 0, which stands for the context itself
        order = np.argsort((at << 40) | low.astype(np.int64)) if len(self.contexts) < 1 << 23 else np.lexsort((low, at))
        train = np.bincount(self.place[b.train[self.both]], minlength=len(codes))
        self.codes, self.order, self.at, self.word = codes, order, at, word
        # rows of the question: each context, followed by its trigrams
        self.n = np.bincount(at, minlength=len(self.contexts)) + 1
        begins = np.cumsum(self.n) - self.n
        self.of_context = begins
        self.of_trigram = np.empty(len(codes), np.int64)
        self.of_trigram[order] = np.delete(np.arange(int(self.n.sum())), begins)
        self.low, self.count = np.zeros(int(self.n.sum()), np.uint64), np.zeros(int(self.n.sum()), np.uint32)
        self.low[self.of_trigram], self.count[self.of_trigram] = low, train
        self.hi = b.keys[self.contexts]


class Hashes(WordHashes):
    """Hashes of words, and END for a line feed, which no word can be."""

    def __missing__(self, word: bytes) -> int:
        if word != b"\n":
            return super().__missing__(word)
        self[word] = int(END)
        return self[word]


class Sheet:
    """Counts by key. Rows lie in the order of `hi`; each `hi` has `n` rows, told apart by `low`. Where n and low are
    empty, each has one."""

    def __init__(self, hi: np.ndarray, n: np.ndarray, low: np.ndarray, count: np.ndarray):
        self.hi, self.n, self.low, self.count = hi, n, low, count

    def cut(self, at: np.ndarray) -> Iterator[Sheet]:
        """The stretches of keys between neighbouring places."""
        rows = np.concatenate([[0], np.cumsum(self.n)])[at] if len(self.n) else at
        for p, q, x, y in zip(at[:-1], at[1:], rows[:-1], rows[1:], strict=True):
            yield Sheet(self.hi[p:q], self.n[p:q], self.low[x:y], self.count[x:y])

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.diff(self.hi, prepend=np.uint64(0)), self.n.astype(np.uint32), self.low, self.count.astype(np.uint64)

    @classmethod
    def merged(cls, sheets: list[Sheet]) -> tuple[Sheet, list[np.ndarray]]:
        """One sheet of all rows, those of a key added up, and the place of each sheet's rows in it."""
        plain = not any(len(s.n) for s in sheets)
        hi = np.concatenate([s.hi if plain else np.repeat(s.hi, s.n) for s in sheets])
        count = np.concatenate([s.count for s in sheets]).astype(np.float64)
        ends = np.cumsum([len(s.count) for s in sheets])[:-1]
        if plain:
            unique, where = np.unique(hi, return_inverse=True)
            none = np.empty(0, np.uint64)
            out = cls(unique, none, none, np.bincount(where, weights=count, minlength=len(unique)).astype(np.uint64))
        else:
            low = np.concatenate([s.low for s in sheets])
            order = np.lexsort((low, hi))
            h, w = hi[order], low[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
            where = np.empty(len(h), np.int64)
            where[order] = np.cumsum(new) - 1
            total = np.bincount(where, weights=count, minlength=int(new.sum())).astype(np.uint64)
            h, w = h[new], w[new]
            top = np.ones(len(h), bool)
            top[1:] = h[1:] != h[:-1]
            out = cls(h[top], np.diff(np.append(np.flatnonzero(top), len(h))), w, total)
        return out, np.split(where, ends)


def to_message(sheets: list[Sheet]) -> bytes:
    return pack(*(a for s in sheets for a in s.arrays()))


def of_message(data: bytes) -> list[Sheet]:
    a = unpack(data)
    return [Sheet(np.cumsum(a[k], dtype=np.uint64), *a[k + 1 : k + 4]) for k in range(0, len(a), 4)]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of hashes; they grow with the hash, so sorted keys lie together by bucket, and each bucket of a coarser
    division holds as many of a finer one that it divides."""
    if buckets <= 1 << 32:
        return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    raise ValueError("too many buckets")


def messages(sheets: list[Sheet], within: int, buckets: int, fan: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, message) for each of the `fan` buckets from `within` on that the sheets have rows for, of `buckets` in
    all; or for the one only if it is -1: then the buckets are all."""
    first = 0 if within < 0 else within
    edges = np.arange(first, first + fan + 1, dtype=np.uint64)
    cuts = [s.cut(np.searchsorted(bucket_of(s.hi, buckets), edges)) for s in sheets]
    for k, parts in zip(range(first, first + fan), zip(*cuts, strict=True), strict=True):
        if any(len(p.count) for p in parts):
            yield k, to_message(list(parts))


def leaf_counts(sheets: list[list[Sheet]]) -> tuple[list[list[np.ndarray]], tuple[int, int, int]]:
    """For each asker, the sums for its rows, sheet by sheet; and of the first sheets how many tokens, distinct ones and
    ones that occur once there are."""
    out: list[list[np.ndarray]] = [[] for _ in sheets]
    stat = (0, 0, 0)
    for k in range(len(sheets[0])):
        whole, where = Sheet.merged([s[k] for s in sheets])
        if k == 0:
            stat = (int(whole.count.sum()), int((whole.count > 0).sum()), int((whole.count == 1).sum()))
        for o, w in zip(out, where, strict=True):
            o.append(whole.count[w].astype(np.int64))
    return out, stat


def leaf_trigrams(sheets: list[list[Sheet]]) -> tuple[list[list[np.ndarray]], tuple[int, int, int]]:
    """For each asker, the counts of its trigrams that count, and for a context their sum."""
    whole, where = Sheet.merged([s[0] for s in sheets])
    kept = np.where((whole.low != 0) & (whole.count >= LEAST_TRIGRAM), whole.count, 0).astype(np.int64)
    begins = np.cumsum(whole.n) - whole.n
    total = np.add.reduceat(kept, begins) if len(kept) else kept
    own = whole.low == 0
    kept[own] = np.repeat(total, whole.n)[own]
    return [[kept[w]] for w in where], (0, 0, 0)


def exchange(asked: DataFrame, askers: int, levels: int, fan: int, leaf) -> DataFrame:
    """Rows asker, cell, data, n, v, n1: what `leaf` answers to the messages `asked` (asker, cell, data), whose cells are
    the first `fan` buckets; there are fan ** levels buckets at the end.

    With one level the cells are the buckets. With more, up to `fan` askers are added up for each cell to one asker, which
    asks the cell's buckets of the next level, and hands the answers on. So each asker sends `fan` messages at the most
    at each level, and messages are in proportion to the input times the levels, not to blocks times buckets.
    """

    def last(key: tuple, rows: pa.Table) -> pa.Table:
        asks = [of_message(x) for x in rows.column("data").to_pylist()]
        found, stat = leaf(asks)
        one = lambda x: pa.array([x] + [None] * (len(asks) - 1), pa.int64())
        return pa.table({"asker": rows.column("asker"), "cell": rows.column("cell"), "data": pa.array([pack(*f) for f in found], pa.binary()), **{k: one(x) for k, x in zip(("n", "v", "n1"), stat, strict=True)}})

    schema = "asker long, cell long, data binary, n long, v long, n1 long"
    return _settled(asked, askers, 1, levels, fan, lambda df: df.groupBy("cell").applyInArrow(last, schema), schema)


def _settled(asked: DataFrame, askers: int, level: int, levels: int, fan: int, last, schema: str) -> DataFrame:
    if level >= levels:
        return last(asked)
    squads = -(-askers // fan)
    asked = written(asked.withColumn("squad", F.pmod(F.xxhash64("asker"), F.lit(squads))), "lm-asked")[0]

    def gathered(rows: pa.Table) -> tuple[list[Sheet], list[list[np.ndarray]]]:
        """The sheets of the asker that stands for all, and for each sheet the places of each one's rows. Askers are in
        their order, so that both passes see the same."""
        asks = [of_message(x) for x in rows.column("data").to_pylist()]
        both = [Sheet.merged([a[k] for a in asks]) for k in range(len(asks[0]))]
        return [s for s, _ in both], [w for _, w in both]

    def combine(key: tuple, rows: pa.Table) -> pa.Table:
        sheets, _ = gathered(rows.sort_by("asker"))
        found = list(messages(sheets, key[1].as_py() * fan, fan ** (level + 1), fan))
        return pa.table({"asker": pa.array([key[0].as_py()] * len(found), pa.int64()), "cell": pa.array([c for c, _ in found], pa.int64()), "data": pa.array([m for _, m in found], pa.binary())})

    up = asked.groupBy("squad", "cell").applyInArrow(combine, "asker long, cell long, data binary")
    down = _settled(up, squads, level + 1, levels, fan, last, schema)
    down = down.withColumns({"squad": F.col("asker"), "up": F.floor(F.col("cell") / fan)})

    def give(key: tuple, asked: pa.Table, answers: pa.Table) -> pa.Table:
        asked = asked.sort_by("asker")
        sheets, where = gathered(asked)
        parts = [unpack(x) for x in answers.sort_by("cell").column("data").to_pylist()]
        found = [np.concatenate([p[k] for p in parts]) for k in range(len(sheets))]
        data = [pack(*(f[w[i]] for f, w in zip(found, where, strict=True))) for i in range(asked.num_rows)]
        stat = {k: pa.array([sum(x or 0 for x in answers.column(k).to_pylist())] + [None] * (len(data) - 1), pa.int64()) for k in ("n", "v", "n1")}
        return pa.table({"asker": asked.column("asker"), "cell": asked.column("cell"), "data": pa.array(data, pa.binary()), **stat})

    return asked.groupBy("squad", "cell").cogroup(down.groupBy("squad", "up")).applyInArrow(give, schema)


def division(spark, keys: int) -> tuple[int, int]:
    """How many levels of messages there are, and how many messages an asker sends at each: as many buckets as shuffle
    tasks, and more where keys are more than they hold."""
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys // BUCKET_KEYS), 1)
    levels = 1
    while MOST_FAN**levels < buckets:
        levels += 1
    fan = 1
    while fan**levels < buckets:
        fan += 1
    return levels, fan


def encode(docs: DataFrame, id_col: str, text_col: str, folds: int, held_out: int) -> DataFrame:
    """Rows block, keys, ids, data: the documents in packed blocks."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes, n = Hashes(), 0
        for batch, texts in joined(blocks(batches, "text", BLOCK_BYTES), BLOCK_BYTES):
            b = Block.of(texts, batch.column(1).to_numpy(zero_copy_only=False), hashes)
            block = (TaskContext.get().partitionId() << 32) + n
            n += 1
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([len(b.words) + len(b.pairs)], pa.int64()), pa.array([pickle.dumps(batch.column(0).to_pylist())], pa.binary()), pa.array([b.packed()], pa.binary())], ["block", "keys", "ids", "data"])

    held = remainder(F.col(id_col), folds) == held_out
    source = docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "block long, keys long, ids binary, data binary")


def joined(parts: Iterator[tuple[pa.RecordBatch, list[bytes]]], most: int) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """Neighbouring slices put together while they have at most `most` bytes of text."""
    held, texts, size = [], [], 0
    for batch, more in parts:
        own = sum(map(len, more))
        if held and size + own > most:
            yield pa.Table.from_batches(held).combine_chunks(), texts
            held, texts, size = [], [], 0
        held.append(batch.select([0, 1]))
        texts += more
        size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), texts


def _told(rows: Iterator[tuple[int, Iterator[tuple[int, bytes]]]]) -> Iterator[pa.RecordBatch]:
    """Rows asker, cell, data of each asker's messages, some at a time."""
    names = ["asker", "cell", "data"]
    for asker, found in rows:
        held = []
        for m in found:
            held.append(m)
            if len(held) >= 64:
                yield pa.RecordBatch.from_arrays([pa.array([asker] * len(held), pa.int64()), pa.array([c for c, _ in held], pa.int64()), pa.array([x for _, x in held], pa.binary())], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([asker] * len(held), pa.int64()), pa.array([c for c, _ in held], pa.int64()), pa.array([x for _, x in held], pa.binary())], names)


def ask(encoded: DataFrame, fan: int) -> DataFrame:
    """Rows asker, cell, data: the words and pairs of each block, with the block's own counts."""
    none = np.empty(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_blocks():
            for batch in batches:
                for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    b = Block.unpacked(data.as_py())
                    one, two = b.counts()
                    yield block, messages([Sheet(b.words, none, none, one), Sheet(b.pairs, none, none, two)], -1, fan, fan)
                    del b, one, two

        yield from _told(all_blocks())

    return encoded.select("block", "data").mapInArrow(run, "asker long, cell long, data binary")


def ask_trigrams(counted: DataFrame, fan: int) -> DataFrame:
    """Rows asker, cell, data: the contexts and trigrams of each block, with the block's own counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_blocks():
            for batch in batches:
                for block, data, parts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                    b = Block.unpacked(data.as_py())
                    t = b.trigrams(_by_pair(b, _answers(parts)[1]))
                    if len(t.contexts):
                        yield block, messages([Sheet(t.hi, t.n, t.low, t.count)], -1, fan, fan)
                    del b, t

        yield from _told(all_blocks())

    return counted.select("block", "data", "parts").mapInArrow(run, "asker long, cell long, data binary")


def _answers(parts: pa.Scalar) -> list[np.ndarray]:
    """What all cells have answered to a block, sheet by sheet."""
    got = [unpack(p["data"]) for p in sorted(parts.as_py() or [], key=lambda p: p["cell"])]
    return [np.concatenate([g[k] for g in got]) for k in range(len(got[0]))] if got else [np.empty(0, np.int64)]


def _by_pair(b: Block, two: np.ndarray) -> np.ndarray:
    """Counts in the order of the block's pairs, from those in the order of their keys."""
    out = np.empty(len(two), np.int64)
    out[b.order] = two
    return out


class Automaton:
    """The states and arcs that one block can reach. State 0 is the root; then come words as contexts, START, and pairs
    of words as contexts."""

    def __init__(self, block: Block, one: np.ndarray, two: np.ndarray, three: np.ndarray | None, n: int, unseen: float, shares2: np.ndarray | None = None, shares3: np.ndarray | None = None):
        """one, two: counts of the block's words and pairs, in the order of their keys; three: the answers to its
        trigrams; n: training tokens; unseen: the probability of a word that training never saw; shares2, shares3: the
        weight of the longer context's own counts, by the binary order of the context's count."""
        b = self.block = block
        self.one, self.c2, self.n, self.unseen = one, _by_pair(b, two), n, unseen
        end = int(np.searchsorted(b.words, END))
        self.c1 = np.append(one, one[end])  # as contexts: START is followed as often as END stands
        self.c1[end] = 0  # nothing follows an end
        self.p1 = np.where(one > 0, (1 - unseen) * one / max(n, 1), unseen)
        if three is not None:
            self.tri = b.trigrams(self.c2)
            self.c3 = three[self.tri.of_trigram] if len(three) else np.zeros(0, np.int64)
            self.k = np.zeros(len(self.c2), np.int64)
            if len(three):
                self.k[self.tri.contexts] = three[self.tri.of_context]
        if shares2 is not None:
            self.share2 = np.where(self.c1 > 0, shares2[_order(self.c1)], 0.0)
            self.p2 = self._smoothed()
        if shares3 is not None:
            self._build(shares3)

    def _smoothed(self) -> np.ndarray:
        """The probability of each pair's second word behind its first."""
        v, w = np.divmod(self.block.codes, len(self.block.words))
        return self.share2[v] * self.c2 / np.maximum(self.c1[v], 1) + (1 - self.share2[v]) * self.p1[w]

    def _build(self, shares3: np.ndarray) -> None:
        b, n = self.block, len(self.block.words)
        t = self.tri
        # what was needed to ask for counts is let go before the arcs are made
        del b.keys, b.order, b.pairs, t.low, t.count, t.hi, t.n, t.order, t.of_context, t.of_trigram, t.rank, t.some
        states = np.flatnonzero(self.k)  # pairs that are states
        number = np.zeros(len(self.k), np.int64)
        number[states] = n + 2 + np.arange(len(states))
        word_state = np.where(self.c1 > 0, np.arange(n + 1) + 1, 0)
        self.start = int(word_state[n])
        v, w = np.divmod(b.codes, n)
        share3 = shares3[_order(self.k[states])]
        # failure arcs: from a pair to its second word, from a word to the root
        self.fail = np.zeros(n + 2 + len(states), np.int64)
        self.fail[n + 2 :] = word_state[w[states]]
        self.fail_weight = np.zeros(len(self.fail))
        with np.errstate(divide="ignore"):
            self.fail_weight[1 : n + 2] = np.log10(1 - self.share2)
            self.fail_weight[n + 2 :] = np.log10(1 - share3)
        to = np.where(number > 0, number, word_state[w])  # where a pair's arc leads
        self.root_weight, self.root_to = np.log10(self.p1), word_state[:n]
        two = np.flatnonzero(self.c2 > 0)
        pair = t.contexts[t.at]
        three = np.flatnonzero(self.c3 > 0)
        # the pair that a trigram ends with, by its code
        ends = np.searchsorted(b.codes, w[pair[three]] * n + t.word[three])
        own = shares3[_order(self.k[pair[three]])]
        weight3 = np.log10(own * self.c3[three] / self.k[pair[three]] + (1 - own) * self.p2[ends])
        code = np.concatenate([word_state[v[two]] * n + w[two], number[pair[three]] * n + t.word[three]])
        leads = np.concatenate([to[two], to[ends]]).astype(np.int32)
        weight = np.concatenate([np.log10(self.p2[two]), weight3])
        del v, w, to, number, pair, ends, own, weight3, self.p2, self.c2, self.c3, self.k
        order = np.argsort(code).astype(np.int32)
        self.arc, self.arc_weight, self.arc_to = code[order], weight[order], leads[order]
        del code, weight, leads
        # where the arcs are that a token takes from the state of the two words, or the word, before it; -1: there is none
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        found2, found3 = np.full(len(b.codes), -1, np.int32), np.full(len(t.codes), -1, np.int32)
        found2[two], found3[three] = place[: len(two)], place[len(two) :]
        self.from_word, self.from_pair = found2[b.pair], np.full(len(b.stream), -1, np.int32)
        self.from_pair[t.both] = found3[t.place]
        del self.tri, b.codes, b.pair, b.context, b.before, b.train  # the arcs hold what a traversal needs

    def traverse(self) -> np.ndarray:
        """The log10 weight of each text. Texts are taken from left to right in lanes that go side by side; a lane that
        begins inside a text first takes the two words before it, after which its state is the text's."""
        b, n = self.block, len(self.block.words)
        pieces = -(-b.sizes // LANE)
        text = np.repeat(np.arange(len(b.sizes)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = b.first[text] + nth * LANE
        stop = np.minimum(begin + LANE, b.first[text] + b.sizes[text])
        at = begin - np.minimum(2, nth * LANE)
        state = np.where(nth == 0, self.start, 0)
        order = np.argsort(at - stop, kind="stable")  # the longest first, so that lanes under way stay in front
        text, begin, stop, at, state = (x[order] for x in (text, begin, stop, at, state))
        length, total = stop - at, np.zeros(len(text))
        for step in range(int(length.max()) if len(length) else 0):
            m = int(np.searchsorted(-length, -step, "left"))  # lanes longer than `step`
            place = at[:m] + step
            word, now = b.stream[place], state[:m].copy()
            weight, after = np.zeros(m), np.empty(m, np.int64)
            left = np.arange(m)
            while len(left):
                s, w = now[left], word[left]
                root = s == 0
                weight[left[root]] += self.root_weight[w[root]]
                after[left[root]] = self.root_to[w[root]]
                left, s = left[~root], s[~root]
                token = place[left]
                k = np.where(s >= n + 2, self.from_pair[token], self.from_word[token])
                hit = k >= 0
                weight[left[hit]] += self.arc_weight[k[hit]]
                after[left[hit]] = self.arc_to[k[hit]]
                left = left[~hit]
                weight[left] += self.fail_weight[now[left]]
                now[left] = self.fail[now[left]]
            state[:m] = after
            total[:m] += np.where(place >= begin[:m], weight, 0.0)
        return np.bincount(text, weights=total, minlength=len(b.sizes))

    def held_in(self, level: int) -> np.ndarray:
        """How often, in training tokens each left out of its own counts, a context of a binary order of counts gave
        a ratio of each bin between what it says of the token and what the shorter context says."""
        b, total = self.block, np.zeros(ORDERS * BINS, np.int64)
        if level == 3:
            of_token = np.zeros(len(b.stream), np.int64)
            of_token[self.tri.both] = self.c3[self.tri.place] if len(self.c3) else 0
        for at in range(0, len(b.stream), TOKENS):
            part = slice(at, at + TOKENS)
            before, context = b.before[part], b.context[part]
            c2, c1, c0 = self.c2[b.pair[part]] - 1, self.c1[before] - 1, self.one[b.stream[part]] - 1
            p1 = np.where(c0 > 0, (1 - self.unseen) * c0 / max(self.n - 1, 1), self.unseen)
            if level == 2:
                some, hits, seen, lower = b.train[part] & (c1 > 0), c2, c1, p1
            else:
                own = of_token[part]
                k = np.where(context >= 0, self.k[context], 0)
                hits, seen = np.maximum(own - 1, 0), k - (own > 0)
                share = np.where(c1 > 0, self.share2[before], 0.0)
                lower = share * np.maximum(c2, 0) / np.maximum(c1, 1) + (1 - share) * p1
                some = b.train[part] & (seen > 0)
            hits, seen, lower = hits[some], seen[some], lower[some]
            with np.errstate(divide="ignore"):
                ratio = np.log10(hits / seen / lower)
            bins = np.where(hits > 0, np.clip((ratio - LEAST) / STEP, 0, BINS - 2).astype(int) + 1, 0) if len(hits) else np.empty(0, int)
            total += np.bincount(_order(seen) * BINS + bins, minlength=ORDERS * BINS)
        return total


def _order(counts: np.ndarray) -> np.ndarray:
    """The binary order of counts."""
    return np.log2(np.maximum(counts, 1)).astype(int)


def shares_of(counts: np.ndarray) -> np.ndarray:
    """The weight of a context's own counts for each binary order of them, by expectation maximisation over held_in()."""
    ratio = np.concatenate([[0.0], 10 ** (LEAST + STEP * (np.arange(BINS - 1) + 0.5))])
    out, last = np.zeros(64), 0.05
    for k, row in enumerate(counts.reshape(ORDERS, BINS)):
        if row.sum() >= 20:
            x = last
            for _ in range(200):
                x = min(max(float((row * (x * ratio / (x * ratio + 1 - x))).sum() / row.sum()), 1e-6), 0.999)
            last = x
        out[k] = last
    out[ORDERS:] = last
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1) -> DataFrame:
    """For each row of `docs`: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from rows whose crc32 of the id, modulo `folds`, is not `held_out` (a null id counts as empty
    text). A null text counts as empty and has one token, its end. Repeated rows count and score as often as they
    are there. base_score is the sum of log10((c + 0.5) / (N + 0.5 (V + 1))); without training rows it is 0, and
    so is score. Words never seen share one probability, the share of training tokens seen once. Other columns are
    not read. An empty table gives an empty result.

    All counts come from all training rows; only three sums and twice ORDERS x BINS counts reach the driver. An n-gram
    that is everywhere comes from a block once, with its count.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    encoded, blocks_at = written(encode(docs, id_col, text_col, folds, held_out), "lm-blocks")
    found = encoded.agg(F.sum("keys"), F.count(F.lit(1))).first()
    levels, fan = division(spark, found[0] or 0)
    answers, answers_at = written(exchange(ask(encoded, fan), found[1], levels, fan, leaf_counts), "lm-counts")
    s = answers.agg(F.sum("n"), F.sum("v"), F.sum("n1")).first()
    n, v, n1 = (int(x or 0) for x in s)
    unseen = min(0.5, max(n1 / n, 0.5 / (n + 0.5 * (v + 1)))) if n else 1.0
    parts = lambda a, name: a.groupBy(F.col("asker").alias("block")).agg(F.collect_list(F.struct("cell", "data")).alias(name))
    counted, counted_at = written(encoded.join(parts(answers, "parts"), "block"), "lm-counted")
    discard(spark, blocks_at, answers_at)

    def automata(batches: Iterator[pa.RecordBatch], shares2: np.ndarray | None, shares3: np.ndarray | None) -> Iterator[tuple[bytes, Automaton]]:
        """ids and the automaton of each block, from rows ids, data, parts and, if trigrams are known, more."""
        for batch in batches:
            for k in range(batch.num_rows):
                one, two = _answers(batch.column(2)[k])
                three = _answers(batch.column(3)[k])[0] if batch.num_columns > 3 else None
                yield batch.column(0)[k].as_py(), Automaton(Block.unpacked(batch.column(1)[k].as_py()), one, two, three, n, unseen, shares2, shares3)

    def shares(rows: DataFrame, level: int, known: np.ndarray | None) -> np.ndarray:
        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(ORDERS * BINS, np.int64)
            for _, a in automata(batches, known, None):
                total += a.held_in(level)
                del a  # before the next one is built
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["at", "n"])

        counts = np.zeros(ORDERS * BINS)
        for r in rows.mapInArrow(gather, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            counts[r["at"]] = r["n"]
        return shares_of(counts)

    shares2 = shares(counted.select("ids", "data", "parts"), 2, None)
    answers, answers_at = written(exchange(ask_trigrams(counted, fan), found[1], levels, fan, leaf_trigrams), "lm-trigrams")
    whole = written(counted.join(parts(answers, "more"), "block", "left").select("ids", "data", "parts", "more"), "lm-answered")[0]
    discard(spark, counted_at, answers_at)
    shares3 = shares(whole, 3, shares2)
    kind = docs.schema[id_col].dataType
    arrow_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, a in automata(batches, shares2, shares3):
            b = a.block
            c = a.one[b.stream]
            base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
            m = len(b.sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pickle.loads(ids), arrow_kind), pa.array(b.held), pa.array(b.sizes, pa.int64()), pa.array(np.add.reduceat((c > 0).astype(np.int64), b.first), pa.int64()), pa.array(np.full(m, n), pa.int64()), pa.array(np.add.reduceat(base, b.first)), pa.array(a.traverse())],
                ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )
            del a, b, c, base  # before the next one is built

    out = whole.mapInArrow(run, f"id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def query(docs: DataFrame) -> DataFrame:
    """score() of all documents; nulls, empty and long texts, repeated rows and empty tables as there."""
    return score(docs)
