"""Jaccard join of n-gram sets, heavy and light: small sets enumerate subsets, large ones scan inverted lists.

Two sets of n and m elements are similar enough if they share t(n, m) of them. A light set, of few elements, enumerates
for each size m of a partner its subsets of t(n, m) elements: two light sets that share as many meet in one, and sets of
different sizes that share less do not. A heavy set posts its rarest elements, as many as any partner has to have one of, and scans the lists of those
elements. What is rarest is told by a table of counts over the whole corpus, of fixed size, in which elements share
cells: any order will do, as long as all sets keep to it. Sets a little below the boundary do both.

What two sets share is no more than what is behind the first element that they have in common, so each place among a set's
rarest elements has a largest partner, and a list is cut by bands of sizes: sets that only share a rare element by
chance, and are not of about the same size, do not meet.

The boundary between light and heavy is the size with the least cost in all: subsets enumerated below it, and
entries of lists scanned above it, as they were counted for these very sets.

What meets is settled as the near-duplicate operator does it: a set is compared with the least one of its lists, what is
linked is one component, and of a list only sets that are still in different components are compared with each other, in
parts. Before full sets are fetched, a leader and a member are ruled out if they have posted too few elements together: of
sets that are linked the first common elements are among those of both. Sets of a list are compared by bitmaps of parities,
a thirtieth to a sixtieth of a set, which tell how many elements two sets have at least that the other one has not. Every link is confirmed on full sets.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.llm.batches import blocks, hashed, mix, windows
from clauselake.llm.minhash import Forest, _checked, _dealt, _groups, _met, _mixed, _rooted, _sets, components, set_hash, text_hash
from clauselake.session import discard, materialize, ship, sized, written

#: log2 of the cells of the table that elements are ordered by, and of the pieces that it is added up in.
CELL_BITS, PIECE_BITS = 22, 6
#: Tables that are added up at once.
TABLES = 64
#: Elements of sets, or words of bitmaps, that are compared at once, 8 bytes each.
PART_POSTS = 250_000
#: Bits that a bitmap of parities has for each element, at least; twice as many at most.
PARITY_BITS = 1
#: Elements of a set that may be light, at most.
MOST_LIGHT = 40


def overlap(n: int, m: int, percent: int) -> int:
    """The elements that sets of n and m elements share at least if 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def partners(n: int, percent: int) -> range:
    """The sizes of sets that may be similar enough to one of n elements."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def shared_sizes(n: int, most: int, percent: int) -> list[tuple[int, int]]:
    """(m, t) for each size m <= most of a partner, and t elements to be shared; equal sets are one set already."""
    found = ((m, overlap(n, m, percent)) for m in partners(n, percent) if 0 < m <= most)
    return [(m, t) for m, t in found if t <= min(n, m) and not t == n == m]


def subsets(elements: np.ndarray, most: int, percent: int, known: dict) -> np.ndarray:
    """A key for each subset that the set may share with one of up to `most` elements: of the sizes of both and of the
    sum of the subset's elements."""
    n, total, out = len(elements), elements.sum(dtype=np.uint64), []
    for m, t in shared_sizes(n, most, percent):
        left_out = known.get((n, t))
        if left_out is None:
            left_out = known[n, t] = np.array(list(combinations(range(n), n - t)), np.int64).reshape(comb(n, t), n - t)
        sums = total - elements[left_out].sum(axis=1, dtype=np.uint64)
        out.append(mix(sums ^ mix(np.full(1, min(n, m) * (MOST_LIGHT + 1) * 8 + max(n, m), np.uint64))))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def boundary(sizes: dict[int, tuple[int, int]], percent: int) -> int:
    """The size up to which sets are light. sizes: sets of each size up to MOST_LIGHT and the entries their lists hold."""
    def cost(most: int) -> int:
        light = sum(sets * sum(comb(n, t) for _, t in shared_sizes(n, most, percent)) for n, (sets, _) in sizes.items() if n <= most)
        return light + sum(entries for n, (_, entries) in sizes.items() if n >= partners(most + 1, percent)[0])

    return min(range(MOST_LIGHT + 1), key=lambda most: (cost(most), most))


def posted(n: int, percent: int) -> int:
    """The elements that a set of n posts: any partner has one of them."""
    return n - partners(n, percent)[0] + 1


def enough_posted(common: np.ndarray, n: int, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m elements may be linked that have posted `common` elements together. Of linked sets all but
    n - t elements of one are in the other, so that the j-th common element has at most the place j + n - t in one and
    j + m - t in the other, and the first ones are posted by both. _likely() applies it."""
    t = -(-percent * (n + m) // (100 + percent))
    least = np.minimum(t - -(-percent * n // 100), t - -(-percent * m // 100)) + 1
    return (t <= np.minimum(n, m)) & (common >= least)


def _levels(docs: DataFrame, text_col: str, shingle: int) -> np.ndarray:
    """For each cell the logarithm of how often its elements occur in all texts, in eighths. Every task adds up a table of
    its own; tables are added by piece, TABLES at once, and 2**PIECE_BITS rows come back."""
    bits, size, pieces = CELL_BITS, 1 << (CELL_BITS - PIECE_BITS), 1 << PIECE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, most = np.zeros(1 << bits, np.int64), [], 0

        def added() -> None:
            nonlocal table
            if held:
                table += np.bincount((np.concatenate(held) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
                held.clear()

        for _, texts in blocks(batches, "text"):
            for t in texts:
                w = windows(hashed(t.lower().split()), shingle)
                held.append(w)
                most += len(w)
            if most >= 4 << bits:
                added()
                most = 0
        added()
        if table.any():
            data = [zlib.compress(np.minimum(p, 0xFFFFFFFF).astype("<u4").tobytes(), 1) for p in np.split(table, pieces)]
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array([part] * pieces, pa.int64()), pa.array(data, pa.binary())], ["piece", "part", "data"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for x in rows.column("data").to_pylist():
            total += np.frombuffer(zlib.decompress(x), "<u4")
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "data": pa.array([zlib.compress(np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes(), 1)], pa.binary())})

    schema = "piece int, part long, data binary"
    tables = materialize(docs.select(F.col(text_col).alias("text")).mapInArrow(count, schema), "join-counts")
    most = tables.agg(F.max("part")).first()[0] or 0
    while most >= TABLES:
        most //= TABLES
        tables = materialize(tables.withColumn("part", F.floor(F.col("part") / TABLES)).groupBy("piece", "part").applyInArrow(add, schema), "join-counts")
    out = np.zeros(1 << bits, np.int64)
    for r in tables.withColumn("part", F.lit(0).cast("long")).groupBy("piece", "part").applyInArrow(add, schema).collect():
        out[r["piece"] * size : (r["piece"] + 1) * size] = np.frombuffer(zlib.decompress(r["data"]), "<u4")
    return np.minimum(8 * np.log2(out + 1), 255).astype(np.uint8)


def _set(text: bytes, shingle: int) -> np.ndarray:
    """What minhash.shingles() gives."""
    h = hashed(text.lower().split())
    s = np.sort(windows(h, min(shingle, len(h))))
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def _rarest(s: np.ndarray, levels: np.ndarray, count: int) -> np.ndarray:
    """The first `count` elements of a sorted set in the order of the corpus: by level, then by hash."""
    level = levels[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
    return s[np.argsort(level, kind="stable")[:count]]


def _described(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """id, th (a hash of the text), n (size of the set), hi and lo (a hash of the set), posts (its rarest elements),
    few (all elements of a set that may be light) and map (its bitmap of parities)."""
    levels, light = docs.sparkSession.sparkContext.broadcast(_levels(docs, text_col, shingle)), MOST_LIGHT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = levels.value
        for batch, texts in blocks(batches, "text"):
            n, hi, lo, posts, few, maps = [], [], [], [], [], []
            for t in texts:
                s = _set(t, shingle)
                n.append(len(s))
                h = set_hash(s) if len(s) else (None, None)
                hi.append(h[0])
                lo.append(h[1])
                posts.append(_rarest(s, held, posted(len(s), percent)).view(np.int64) if len(s) else None)
                few.append(s.view(np.int64) if 0 < len(s) <= light else None)
                maps.append(parity(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), *(pa.array(c, pa.list_(pa.int64())) for c in (posts, few)), pa.array(maps, pa.binary())], ["id", "th", "n", "hi", "lo", "posts", "few", "map"])

    source = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("th"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, th long, n long, hi long, lo long, posts array<long>, few array<long>, map binary")


def reach(n: int, place: int, percent: int) -> int:
    """The largest set that one of n elements has to meet at the one of its elements that is at `place`, from 0, in the
    order of the corpus. If that is the first element that two sets share, they share no more than what is behind it, in
    either, so that t(n, m) <= n - place. _met_at() applies it."""
    return (100 + percent) * (n - place) // percent - n


def _met_at(posts: DataFrame, percent: int) -> DataFrame:
    """cid, size, bucket from rows cid, n, place, element. `size` holds n and reach() in one number. A bucket is of an element
    and a band of sizes, in which a set is by its own size and by those of larger sets up to its reach: two sets that may
    be linked meet in the band of the larger one."""
    h = F.expr(f"{100 + percent} * (n - place) div {percent} - n")
    width = math.log(100 / percent) or 1.0  # from a set to the largest one that may be linked with it
    band = lambda c: F.floor(F.log(c) / width)
    met = posts.withColumn("h", h).where(100 * F.col("h") >= percent * F.col("n"))
    met = met.withColumn("band", F.explode(F.sequence(band("n"), F.greatest(band("n"), band("h")))))
    return met.select("cid", _size(F.col("n"), F.col("h")), F.xxhash64("element", "band").alias("bucket"))


def _size(n: Column, h: Column) -> Column:
    return (F.shiftleft(n, 32) + h).alias("size")


def _n(size: str) -> Column:
    return F.shiftright(size, 32)


def _h(size: str) -> Column:
    return F.col(size).bitwiseAND(0xFFFFFFFF)


def _enumerated(classes: DataFrame, most: int, percent: int) -> DataFrame:
    """cid, size, bucket for each subset of the light sets, which may meet any partner there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for cid, size, few in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                keys = np.unique(subsets(few.values.to_numpy().view(np.uint64), most, percent, known))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(keys), x), pa.int64()) for x in (cid, size)), pa.array(keys.view(np.int64))], ["cid", "size", "bucket"])

    light = classes.where((F.col("n") <= most) & F.col("few").isNotNull())
    return light.select("cid", _size(F.col("n"), F.expr(f"100 * n div {percent}")), "few").mapInArrow(run, "cid long, size long, bucket long")


def _lists(slots: DataFrame) -> DataFrame:
    """bucket, m, a, least: the lists that more than one set is in, with their length, least id and least size. Of the lists
    of two, those whose sets are within reach of each other."""
    lists = slots.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("cid").alias("a"), F.min("size").alias("x"), F.max("size").alias("y"))
    apart = (_n("y") > _h("x")) | (_n("x") > _h("y"))
    return lists.where((F.col("m") > 2) | ((F.col("m") == 2) & ~apart)).select("bucket", "m", "a", _n("x").alias("least"))


def _slots(classes: DataFrame, percent: int) -> DataFrame:
    """cid, size, bucket: what sets meet in. The boundary comes from counts of at most MOST_LIGHT sizes, for which only sets
    that may meet these are looked at."""
    posts = classes.select("cid", "n", F.posexplode("posts").alias("place", "element"))
    small = _met_at(posts.where(F.col("n") <= partners(MOST_LIGHT, percent)[-1]), percent)
    small = small.join(_lists(small).select("bucket", "m"), "bucket", "left").withColumn("n", _n("size")).where(F.col("n") <= MOST_LIGHT)
    by_size = small.groupBy("n").agg(F.count_distinct("cid").alias("sets"), F.sum(F.coalesce("m", F.lit(1))).alias("entries")).collect()
    most = boundary({r["n"]: (r["sets"], r["entries"]) for r in by_size}, percent)
    heavy = _met_at(posts.where(F.col("n") >= partners(most + 1, percent)[0]), percent)
    return heavy.union(_enumerated(classes, most, percent)) if most else heavy


def _linked(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """node, root of the classes that links tie to a smaller one."""
    slots, at = written(_slots(classes, percent), "join-slots")
    lists, lists_at = written(_lists(slots), "join-lists")
    # a set that has to meet smaller ones alone meets none where there are none
    met = slots.join(lists, "bucket").where(_h("size") >= F.col("least")).select("bucket", "cid", "m", "a")
    members, members_at = written(met, "join-members")
    discard(docs.sparkSession, at, lists_at)
    leaders = members.groupBy("cid").agg(F.min("a").alias("a")).where("a <> cid").select("a", F.col("cid").alias("b"))
    edges = materialize(_likely(leaders, classes, percent), "join-edges")
    sets = _fetched(docs, classes, edges, id_col, text_col, shingle)
    weight = sets.agg(F.sum("n")).first()[0] or 0
    links = materialize(_met(edges, sets, weight, percent), "join-links")
    comp = components(links, "join-components")
    mixed = _mixed(members, comp)
    discard(docs.sparkSession, members_at)
    if mixed.isEmpty():
        return comp
    # of lists with the same sets one is enough
    alike = mixed.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.sum(F.shiftright(F.xxhash64("cid", F.lit(1)), 24)).alias("s"))
    one = materialize(alike.groupBy("c", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket"), "join-unlike")
    inside = mixed.join(one, "bucket").select(F.col("bucket").alias("cluster"), "cid", "root")
    maps = classes.join(inside.select("cid").distinct(), "cid", "left_semi").select("cid", "n", F.col("map").alias("set"))
    near = materialize(_alike(inside, materialize(maps, "join-parities"), percent), "join-near")
    if near.isEmpty():
        return comp
    more = _fetched(docs, classes, near, id_col, text_col, shingle, sets)
    return _settled(links, near, materialize(sets.union(more), "join-all-sets"), percent)


def _clustered(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """cluster, cid, root of what `pairs` (a, b) tie together and is in several components still."""
    clusters = components(pairs, "join-clusters")
    nodes = clusters.union(clusters.select(F.col("root").alias("node"), "root").distinct())
    inside = _rooted(nodes.select(F.col("node").alias("cid"), F.col("root").alias("cluster")), comp)
    several = inside.groupBy("cluster").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p <> q").select("cluster")
    return materialize(inside.join(several, "cluster", "left_semi"), "join-inside")


def _settled(links: DataFrame, near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, root with what is linked among classes that `near` ties together: pairs (a, b) that span what bitmaps leave.

    Nearly all of these are links, so they are checked first. Only what is in several components then has all pairs of
    its cluster checked on full sets.
    """
    weight = near.join(sets.select(F.col("cid").alias("b"), "n"), "b").agg(F.sum("n")).first()[0] or 0
    links = materialize(links.union(_met(near, sets, weight, percent)), "join-links")
    comp = components(links, "join-components")
    inside = _clustered(near, comp)
    return comp if inside.isEmpty() else components(links.union(_checked(inside, sets, percent, most=PART_POSTS)), "join-components")


def parity(s: np.ndarray) -> np.ndarray:
    """A bitmap with the parity of the number of elements whose low bits name a bit, of 2**k words of 64 bits. Two such
    bitmaps of one size differ in no more bits than sets differ in elements."""
    bits = max(64, 1 << (PARITY_BITS * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap that the same set has in fewer words."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, words), axis=0)


def may_link(differ: np.ndarray, n: int, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m elements may be linked that differ in `differ` elements at least."""
    t = -(-percent * (n + m) // (100 + percent))
    return (t <= np.minimum(n, m)) & (differ <= n + m - 2 * t)


def _alike(inside: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that span, in each pair of parts of a cluster, the pairs of different roots that bitmaps do not rule
    out."""
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        a, b = [], []
        for g in _groups(rows, ["cluster", "x", "y"]):
            order = np.argsort(np.array(g["n"]), kind="stable").tolist()
            n, part, root = (np.array([g[c][i] for i in order]) for c in ("n", "part", "root"))
            cid, held, top = [g["cid"][i] for i in order], [g["set"][i] for i in order], Forest(len(order))
            words, apart = np.array([len(x) for x in held]), g["x"][0] != g["y"][0]  # both n and words rise
            for size in np.unique(words).tolist():
                begin, end = np.searchsorted(words, size, "left"), np.searchsorted(words, size, "right")
                last = np.searchsorted(n, n[end - 1] * 100 // percent, "right")
                matrix = np.stack([folded(x, size) for x in held[begin:last]])
                for i in range(begin, end):
                    to = int(np.searchsorted(n, n[i] * 100 // percent, "right"))  # a larger set cannot be similar enough
                    rest = np.arange(i + 1, to)
                    rest = rest[(root[rest] != root[i]) & ((part[rest] != part[i]) | (not apart))]
                    if len(rest):
                        differ = np.bitwise_count(matrix[rest - begin] ^ matrix[i - begin]).sum(axis=1, dtype=np.int64)
                        for j in rest[may_link(differ, n[i], n[rest], percent)].tolist():
                            if top.join(i, j):
                                a.append(cid[i])
                                b.append(cid[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _dealt(inside, maps, PART_POSTS).groupBy("bin").applyInArrow(run, "a long, b long")


def _likely(edges: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose sets have posted enough together."""
    of = lambda cid, n, posts: classes.select(F.col("cid").alias(cid), F.col("n").alias(n), F.col("posts").alias(posts))
    up = lambda x, by: F.ceil(percent * x / by).cast("long")
    both = edges.join(of("a", "n", "x"), "a").join(of("b", "m", "y"), "b").withColumn("t", up(F.col("n") + F.col("m"), 100 + percent))
    least = F.col("t") - up(F.greatest("n", "m"), 100) + 1
    return both.where((F.col("t") <= F.least("n", "m")) & (F.size(F.array_intersect("x", "y")) >= least)).select("a", "b")


def _fetched(docs: DataFrame, classes: DataFrame, edges: DataFrame, id_col: str, text_col: str, shingle: int, held: DataFrame | None = None) -> DataFrame:
    """The full sets of the classes in edges (a, b), but for those held."""
    ends = edges.select(F.col("a").alias("cid")).union(edges.select(F.col("b").alias("cid"))).distinct()
    ends = ends if held is None else ends.join(held.select("cid"), "cid", "left_anti")
    wanted = classes.join(ends, "cid").select("cid", F.col("rep.id").alias("rid"), F.col("rep.th").alias("rth"), "hi", "lo")
    return materialize(_sets(docs, sized(wanted, "join-wanted"), id_col, text_col, shingle), "join-sets")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """id_col, n_shingles, component_id for each row of `docs`.

    Documents are linked when 100 * intersection >= percent * union of their sets of shingles; component_id is the least
    id that links lead to. Documents without words, null ones included, have an empty set and are linked with nothing.
    A document with fewer words than a shingle has them all as its one shingle. Rows with equal sets are one class; rows
    that repeat an id belong to the class of their own text. Null ids come last. Other columns, however named, are not
    read. An empty table gives an empty result.

    Texts are read twice for all rows, for the order of elements and for sets, and at most twice more for classes that
    may be linked with another. Shuffles carry the rarest elements and the subsets, not texts, unless more classes meet than a
    broadcast holds; sets travel only between classes that meet. Nothing is capped: all sets of a list end in one
    component or are compared, and a list of any length is cut into parts for that.
    """
    ship(docs.sparkSession)
    rows = materialize(_described(docs, id_col, text_col, shingle, percent), "join-rows")
    rep = F.struct(F.col("id").isNull().alias("none"), "id", "th")  # null ids come last
    classes = rows.where("n > 0").groupBy("hi", "lo").agg(F.min(rep).alias("rep"), F.first("n").alias("n"), F.first("posts").alias("posts"), F.first("few").alias("few"), F.first("map").alias("map"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "join-classes")
    linked = _linked(docs, classes, id_col, text_col, shingle, percent)
    named = materialize(_rooted(classes.select("cid", "hi", "lo", "rep"), linked), "join-named")
    first = materialize(named.groupBy("root").agg(F.min("rep").alias("first")), "join-first")
    named = named.join(first, "root").select(F.col("hi").alias("h"), F.col("lo").alias("l"), F.col("first.id").alias("least"))
    out = rows.join(named, (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l")), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def query(docs: DataFrame) -> DataFrame:
    """jaccard_components() of all documents with shingles of three words and a similarity of 0.9; nulls, empty and short
    texts, ties, repeated rows, clashing names and empty tables as there."""
    return jaccard_components(docs, shingle=3, percent=90)
