"""Collocations: frequent phrases of two words and more, by positional inverted lists.

The words of a block of texts have positions. The vertical form of the block is a list of positions for each phrase, at
first for each frequent word. A list of phrases of k words is extended by merge-joining its positions, moved on by k,
with the postings of words; what is left are the positions of phrases of k + 1 words, and the length of a phrase's list is
its exact frequency in the block. Lists of a block lie in two arrays, positions and the phrases at them, so that one join
extends them all. Phrases do not run from text to text, so frequencies add up over blocks; a phrase is extended where
the whole corpus has it often enough.

What is often enough comes back to the blocks as a bitmap of hashes. Its size is fixed; where it fills up, more phrases
are extended than need be, and none less: results come from exact counts of the phrases themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.llm.batches import WordHashes, blocks, mix
from clauselake.session import discard, materialize, ship, sized, written

#: Words of a phrase, at most and by default.
LONGEST = 5
#: log2 of the bits of a bitmap of frequent phrases, and of the rows that it comes to the driver in.
FILTER_BITS, SEGMENT_BITS = 26, 10
#: Occurrences whose lists a task adds up before it hands on their lengths; phrases, and bytes, that it spells out at once.
OCCURRENCES, SPELLED, SPELLED_BYTES = 6_000_000, 300_000, 32 << 20
#: Parts of a language that the best phrases are chosen in before they meet.
RANK_PARTS = 64
#: What no text in UTF-8 has: stands for a place where no phrase goes on.
BREAK = b"\xff"
_UPPER, _BREAKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes.maketrans(_UPPER + b"\t" + _BREAKS, _UPPER.lower() + b" " + BREAK * len(_BREAKS))
_NEXT = np.uint64(0x9E3779B97F4A7C15)


def words(texts: list[bytes]) -> list[bytes]:
    """The words of texts in order, with a BREAK wherever a phrase ends."""
    return BREAK.join(texts).translate(_FOLD).replace(BREAK, b" " + BREAK + b" ").split()


class Bitmap:
    """A set of hashes, or somewhat more."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits, np.uint64(65 - (8 * len(bits)).bit_length())

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> self.shift
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    @classmethod
    def of(cls, keys: DataFrame) -> Bitmap:
        """From a column `key`; each segment is set where Spark groups it, and 2**SEGMENT_BITS rows come back."""
        size, shift = 1 << (FILTER_BITS - SEGMENT_BITS), np.uint64(64 - FILTER_BITS)

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            at = rows.column("key").to_numpy().view(np.uint64) >> shift
            flags = np.zeros(size, np.uint8)
            flags[(at & np.uint64(size - 1)).astype(np.int64)] = 1
            return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        parted = keys.select("key", F.shiftrightunsigned("key", 64 - SEGMENT_BITS).alias("part"))
        for r in parted.groupBy("part").applyInArrow(run, "part long, bits binary").collect():
            bits[r["part"] * size // 8 : (r["part"] + 1) * size // 8] = np.frombuffer(r["bits"], np.uint8)
        return cls(bits)


def extended(at: np.ndarray, key: np.ndarray, k: int, post_at: np.ndarray, post_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of phrases of k words, merge-joined with the postings of the words behind them."""
    if not len(post_at):
        return at[:0], key[:0]
    place = np.minimum(np.searchsorted(post_at, at + k), len(post_at) - 1)
    met = post_at[place] == at + k
    return at[met], mix(key[met] * _NEXT + post_key[place[met]])


def lists(hashes: np.ndarray, live: np.ndarray, filters: list[Bitmap]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions and phrases of each length: of those in `filters`, and of all that extend them by a word."""
    at = np.flatnonzero(live)
    key = hashes[at]
    out = [(at, key)]
    for k, f in enumerate(filters, 1):
        often = f.has(key)
        at, key = at[often], key[often]
        out[-1] = at, key
        if k == 1:
            post_at, post_key = at, key
        at, key = extended(at, key, k, post_at, post_key)
        out.append((at, key))
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
    """From rows lang, text: a language, the words of its texts in a block, their hashes, and which are no breaks."""
    hashes, stop = WordHashes(), xxhash.xxh3_64_intdigest(BREAK)
    for batch, texts in blocks(batches, "text"):
        by: dict[str, list[bytes]] = {}
        for lang, t in zip(batch.column(batch.schema.get_field_index("lang")).to_pylist(), texts, strict=True):
            by.setdefault(lang, []).append(t)
        for lang, own in by.items():
            w = words(own)
            h = hashes.of(w)
            yield lang, w, mix(h + np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))), h != np.uint64(stop)


def _frequent(rows: DataFrame, filters: list[Bitmap], least: int) -> Bitmap:
    """The phrases, one word longer than those of the last filter, of `least` occurrences and more.

    A task adds up the lengths of its lists and hands them on sorted by hash, in a row for each bucket of hashes; a
    bucket is a share of what all tasks hand on, several for each shuffle partition.
    """
    spark = rows.sparkSession
    shared, most = spark.sparkContext.broadcast(filters), OCCURRENCES
    bits = max(4, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed(held: list[np.ndarray]) -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            pieces = [(b, x.tobytes(), y.astype("<u4").tobytes()) for b, (x, y) in enumerate(zip(np.split(keys, cuts), np.split(n, cuts), strict=True)) if len(x)]
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pieces], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["bucket", "keys", "n"])

        held, size = [], 0
        for _, _, hashes, live in _parts(batches):
            held.append(lists(hashes, live, shared.value)[-1][1])
            size += len(held[-1])
            if size >= most:
                yield handed(held)
                held, size = [], 0
        if size:
            yield handed(held)

    def often(key: tuple, rows: pa.Table) -> pa.Table:
        keys, place = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in rows.column("keys").to_pylist()]), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate([np.frombuffer(x, "<u4") for x in rows.column("n").to_pylist()]))
        return pa.table({"key": pa.array(keys[n >= least].view(np.int64))})

    counted, path = written(rows.mapInArrow(lengths, "bucket int, keys binary, n binary").groupBy("bucket").applyInArrow(often, "key long"), "phrase-keys")
    found = Bitmap.of(counted)
    discard(spark, path)
    return found


def _spelled(rows: DataFrame, filters: list[Bitmap], lengths: range, rest: bool) -> DataFrame:
    """lang, k, phrase and n, its occurrences in a task, for phrases of `lengths` in the filters. With `rest` also the
    number of all words of a language (k 0), and the stretches of three words and more whose pairs all are in the second
    filter (k -1), in which longer phrases lie."""
    shared, most, most_bytes = rows.sparkSession.sparkContext.broadcast(filters), SPELLED, SPELLED_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))], ["lang", "k", "phrase", "n"])

        def seen() -> list[tuple]:
            return [(lang, k, p.decode(), n) for (lang, k, _), (p, n) in known.items()]

        known: dict[tuple, tuple[bytes, int]] = {}
        held_bytes = 0
        for lang, w, hashes, live in _parts(batches):
            of = lists(hashes, live, shared.value)
            for k in lengths:
                at, key = of[k - 1]
                keys, first, n = np.unique(key, return_index=True, return_counts=True)
                for x, p, c in zip(keys.tolist(), at[first].tolist(), n.tolist(), strict=True):
                    held = known.get((lang, k, x))
                    if held:
                        known[lang, k, x] = held[0], held[1] + c
                    else:
                        known[lang, k, x] = phrase, _ = b" ".join(w[p : p + k]), c
                        held_bytes += len(phrase)
            if rest:
                at = of[1][0]
                ends = np.flatnonzero(np.diff(at) != 1)
                runs = zip(at[np.concatenate([[0], ends + 1])].tolist(), at[np.concatenate([ends, [len(at) - 1]])].tolist(), strict=True) if len(at) else ()
                out = [(lang, -1, b" ".join(w[a : b + 2]).decode(), None) for a, b in runs if b > a]
                yield handed([*out, (lang, 0, None, int(live.sum()))])
            if len(known) >= most or held_bytes >= most_bytes:
                yield handed(seen())
                known.clear()
                held_bytes = 0
        if known:
            yield handed(seen())

    return rows.mapInArrow(run, "lang string, k int, phrase string, n long")


def phrase_counts(docs: DataFrame, least: int = 100, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """lang, k, phrase, f of all phrases of 1 to `longest` words with `least` occurrences and more, and lang, n of all words."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    filters = [_frequent(rows, [], least)]
    filters.append(_frequent(rows, filters, least))
    short = materialize(_spelled(rows, [*filters], range(1, 3), True), "phrase-short")
    runs = short.where("k = -1").select("lang", F.col("phrase").alias("text"))
    while len(filters) < longest:
        filters.append(_frequent(runs, filters, least))
    grams = short.where("k > 0").union(_spelled(runs, filters, range(3, longest + 1), False))
    found = grams.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    total = short.where("k = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return materialize(found, "phrase-counts"), sized(total, "phrase-totals")


def _part(start: Column | int, n: Column) -> Column:
    return F.array_join(F.slice("w", start, n), " ")


def collocations(docs: DataFrame, top: int = 2000, least: int = 100, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are cut at `[.,;:!?\\x0A-\\x0D]` and into words between spaces and tabs; only A-Z are folded. A phrase of 2 to
    `longest` words that occurs a >= `least` times is a candidate; overlapping occurrences count. Cut behind its first k
    words, whose frequency is l, the rest's r, its score is floor(1000 * a * n / (l * r)), n being all words of the
    language; the lowest cut counts, of equal ones the first. Candidates that lie in a longer one of the same frequency
    are dropped. Order is by score and a downward, then by phrase.

    Null texts are empty, a null language is "und"; texts without words add nothing. Repeated rows count each time.
    Other columns are not read. Texts of any length are taken whole. An empty table gives an empty result.

    Texts are read three times, for words, for pairs, and to spell out what is frequent; longer phrases come from the
    stretches in which all pairs are frequent. Shuffles carry lengths of lists, added up by task. The last steps deal
    with frequent phrases alone, at most one for each `least` words; the best are chosen in parts of a language first.
    """
    if longest < 2:
        raise ValueError("phrases have two words at least")
    found, total = phrase_counts(docs, least, lang_col, text_col, longest)
    several = found.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    # within longer ones: all stretches of two words and more, but for the phrase itself
    sizes = F.explode(F.sequence(F.lit(2), F.col("k") - 1))
    inner = several.where("k > 2").select("lang", "a", "w", "k", sizes.alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("start"))
    inner = inner.groupBy("lang", _part(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("a").alias("most"))
    kept = several.join(inner, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") < F.col("a"))).drop("most")
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(1, F.col("cut")).alias("left"), _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    of = lambda side, name: found.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(total, "lang")
    whole = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    cuts = cuts.withColumns({"over": whole("a", 19) * whole("n", 18) * F.lit(1000).cast("decimal(4,0)"), "under": whole("l", 19) * whole("r", 18)})
    cuts = cuts.withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parted = best.withColumn("part", F.pmod(F.hash("phrase"), F.lit(RANK_PARTS)))
    first = parted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(docs: DataFrame) -> DataFrame:
    """collocations() of all documents; nulls, empty and long texts, ties, repeated rows, clashing names and empty tables
    as there."""
    return collocations(docs)


SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM d),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY 1),
g AS (SELECT lang, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
s AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most FROM (SELECT *, unnest(generate_series(1, k - m + 1)) AS i FROM (SELECT *, unnest(generate_series(2, k - 1)) AS m FROM c)) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN s USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a),
x AS (SELECT *, array_to_string(w[1:cut], ' ') AS lp, array_to_string(w[cut + 1:], ' ') AS rp FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM kept)),
y AS (SELECT x.lang, x.phrase, x.a, cut, l.f AS l, r.f AS r, n, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM x JOIN f l ON l.lang = x.lang AND l.phrase = lp JOIN f r ON r.lang = x.lang AND r.phrase = rp JOIN t ON t.lang = x.lang),
b AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b) WHERE rank <= 2000
"""
