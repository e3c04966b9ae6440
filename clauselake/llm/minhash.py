"""Near-duplicate detection with HyperMinHash registers.

A document's set holds its distinct shingles. A register keeps, for the least hash that falls into its bucket, the
number of leading zeros and the first mantissa bits; a bucket that no shingle falls into takes the least of the
shingles' hashes under a salt of its own, so that short documents fill their registers too. Registers are banded
to find candidates, compared with a correction for chance collisions, and what remains is checked on full sets.

Candidates are settled in two steps. At first each document meets one leader, the least that it shares a bucket with, by
the estimate and then on full sets, and what is linked becomes one component. Only pairs that share a bucket and still
are in different components need more, and a second step checks all of those. A group of copies that are near their
leader so costs in proportion to its members; only families whose members stay apart from it cost more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.llm.batches import WordHashes, blocks, mix, windows
from clauselake.session import materialize, ship, sized

#: log2 of the number of registers.
BUCKET_BITS = 7
REGISTERS = 1 << BUCKET_BITS
#: Mantissa bits that a register keeps; with 6 bits for the leading zeros it takes 16.
MANTISSA_BITS = 10
#: Registers of a band. Two sets of similarity 0.8 share no band of 32 with a probability of 5e-8.
BAND = 4
#: Candidates whose estimated similarity is this far below the threshold are not checked on full sets (5 sigma).
MARGIN = 0.18
#: The chance that registers of unrelated sets agree: in the exponent (sum of 4^-k, k >= 1) and in the mantissa.
CHANCE = (1 / 3) / (1 << MANTISSA_BITS)

_BOUNDS = (np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)).astype(np.uint64)
_SALTS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(text: bytes, hashes: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's windows of n words; of all its words if they are fewer."""
    words = text.lower().split()
    h = hashes.of(words)
    if not len(h):
        return h
    return np.unique(windows(h, min(n, len(h))))


def registers(s: np.ndarray) -> np.ndarray:
    """The registers of a sorted, non-empty set of hashes, as 16-bit numbers."""
    first = np.searchsorted(s, _BOUNDS)
    value = s[np.minimum(first, len(s) - 1)]
    filled = (first < len(s)) & ((value >> np.uint64(64 - BUCKET_BITS)) == np.arange(REGISTERS, dtype=np.uint64))
    least = value << np.uint64(BUCKET_BITS)
    bare = np.flatnonzero(~filled)
    for part in np.array_split(bare, max(1, len(bare) * len(s) // 500_000)):
        if len(part):
            least[part] = mix(s[None, :] ^ _SALTS[part][:, None]).min(axis=1)
    mantissa, exponent = np.frexp(least.astype(np.float64) + 1.0)
    zeros = np.clip(64 - exponent, 0, 63)
    return ((zeros << MANTISSA_BITS) | ((mantissa - 0.5) * (2 << MANTISSA_BITS)).astype(np.int64)).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from rows of registers, corrected for registers of different hashes that agree by chance."""
    same = (a == b).mean(axis=1)
    return np.maximum(0.0, (same - CHANCE) / (1 - CHANCE))


def text_hash(text_col: str) -> Column:
    """What tells rows of one id apart that have different texts."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a set, as two signed numbers."""
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """id, th (a hash of the text), n (size of the set), hi and lo (a hash of the set), bands (its registers, BAND to a
    number)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch, texts in blocks(batches, "text"):
            n, hi, lo, bands = [], [], [], []
            for t in texts:
                s = shingles(t, hashes, shingle)
                n.append(len(s))
                h = set_hash(s) if len(s) else (None, None)
                hi.append(h[0])
                lo.append(h[1])
                bands.append(registers(s).view("<i8") if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["id", "th", "n", "hi", "lo", "bands"])

    source = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("th"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, th long, n long, hi long, lo long, bands array<long>")


#: Edges that a file of a written step holds, about; small graphs take few files whatever the shuffle's width.
EDGES_PER_FILE = 500_000


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, root: the least node of each connected component of edges (a, b), by large-star and small-star steps.

    Every step is an aggregation and a join. A node with very many edges is pre-aggregated before the shuffle; what
    is aggregated is written before it is joined back, since adaptive execution splits a hot node only where both
    sides of the join come from a shuffle of their own. Lost executors cost no more than the step at hand.
    """
    pair = lambda a, b: (F.col(a).alias("a"), F.col(b).alias("b"))
    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    while True:
        n, nodes = e.agg(F.count(F.lit(1)), F.count_distinct("a")).first()
        # done when each node has one edge, and that leads to a node without any
        if n == nodes and e.join(e.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        files = max(4, n // EDGES_PER_FILE)
        both = e.union(e.select(*pair("b", "a")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).repartition(files), name)
        e = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        e = materialize(e.repartition(files), name)
        least = materialize(e.groupBy("a").agg(F.min("b").alias("m")).repartition(files), name)
        j = e.join(least, "a")
        e = j.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(least.select(*pair("a", "m"))).where("a <> b").distinct()
        e = materialize(e.repartition(files), name)


#: Shingles of the sets that meet a leader, or each other, at once; shingles and registers that a task's share holds.
PART_SHINGLES, BIN_SHINGLES = 20_000, 500_000
#: Members of a bucket whose registers are compared with each other at once.
PART_MEMBERS = 1000


def _binned(rows: DataFrame, keys: list[str], weight: int) -> DataFrame:
    """`rows`, of `weight` shingles in all, with `bin`, which packs groups of `keys` into shares of about BIN_SHINGLES,
    several for each shuffle task."""
    bins = max(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-weight // BIN_SHINGLES))
    return rows.withColumn("bin", F.pmod(F.xxhash64(*keys), F.lit(bins)))


def _groups(rows: pa.Table, keys: list[str]) -> Iterator[dict[str, list]]:
    """The rows of each value of `keys` in a bin, as lists by column; binary columns are arrays of numbers."""
    rows = rows.sort_by([(k, "ascending") for k in keys])
    if not rows.num_rows:
        return
    key = np.stack([rows.column(k).to_numpy() for k in keys])
    cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
    for at, to in zip([0, *cuts], [*cuts, rows.num_rows], strict=True):
        part = rows.slice(at, to - at)
        yield {c: [np.frombuffer(x, np.uint64) for x in part.column(c).to_pylist()] if pa.types.is_binary(part.schema.field(c).type) else part.column(c).to_pylist() for c in part.column_names}


#: 64-bit numbers that describe a set where sets are compared before they are fetched.
WIDTH = REGISTERS // 4


def _alike(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m shingles with registers a and b, in rows of WIDTH numbers, may be similar enough."""
    of_size = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    return of_size & (estimate(a.view("<u2"), b.view("<u2")) >= percent / 100 - MARGIN)


def _near(edges: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose sets may be similar enough by what describes them."""
    of = lambda cid, n, bands: classes.select(F.col("cid").alias(cid), F.col("n").alias(n), F.col("bands").alias(bands))
    both = edges.join(of("a", "n", "x"), "a").join(of("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(k).to_numpy() for k in (2, 3))
                x, y = (batch.column(k).flatten().to_numpy().reshape(batch.num_rows, WIDTH) for k in (4, 5))
                yield batch.select(["a", "b"]).filter(pa.array(_alike(x, n, y, m, percent)))

    return both.mapInArrow(run, "a long, b long")


def _met(edges: DataFrame, sets: DataFrame, weight: int, percent: int) -> DataFrame:
    """The edges (a, b), each b once, that full sets confirm. The sets of a leader's members are cut into parts, each of
    which gets the leader's set once."""
    members = edges.join(sets.withColumnRenamed("cid", "b"), "b")
    parts = members.groupBy("a").agg(F.ceil(F.sum("n") / PART_SHINGLES).alias("parts"))
    parts = materialize(parts, "near-leaders")
    members = members.join(parts, "a").select("a", F.pmod(F.hash("b"), F.col("parts")).cast("long").alias("part"), "b", "n", "set")
    leaders = parts.join(sets.withColumnRenamed("cid", "a"), "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(-1).cast("long").alias("b"), "n", "set")
    rows = members.union(leaders)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        a, b = [], []
        for g in _groups(rows, ["a", "part"]):
            lead = g["set"][g["b"].index(-1)]
            for cid, s in zip(g["b"], g["set"], strict=True):
                if cid >= 0:
                    few, many = (s, lead) if len(s) < len(lead) else (lead, s)
                    common = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
                    if 100 * common >= percent * (len(s) + len(lead) - common):
                        a.append(g["a"][0])
                        b.append(cid)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _binned(rows, ["a", "part"], 2 * weight).groupBy("bin").applyInArrow(run, "a long, b long")


def _unsettled(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Edges that tie together what shares a bucket (bucket, cid, root, m), is in different components and near by its
    registers: of each part of a bucket a spanning forest of these pairs.

    Members of a bucket's largest component are never compared with each other: parts of the others meet each other and
    those of the largest, so that a bucket of m members that are in one component but for a few costs in proportion to m.
    """
    by_root = members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    major = by_root.groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("x"), F.sum("c").alias("m"))
    size = lambda c: F.ceil(c / PART_MEMBERS).cast("long")
    parts = materialize(major.select("bucket", F.col("x.root").alias("major"), size(F.col("m") - F.col("x.c")).alias("minors"), size(F.col("x.c")).alias("majors")), "near-bucket-parts")
    placed = members.join(parts, "bucket").withColumn("is_major", F.col("root") == F.col("major"))
    part = F.when(F.col("is_major"), F.col("minors") + F.pmod(F.hash("cid"), F.col("majors"))).otherwise(F.pmod(F.hash("cid"), F.col("minors"))).cast("long")
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("is_major"), F.col("minors")).otherwise(F.col("minors") + F.col("majors")) - 1)
    met = placed.withColumn("part", part).withColumn("other", F.explode(others))
    met = met.select("bucket", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "cid", "root")
    rows = met.join(classes.select("cid", "n", "bands"), "cid")
    copies = F.col("minors") + F.when(F.col("is_major"), 0).otherwise(F.col("majors"))
    weight = (placed.agg(F.sum(copies)).first()[0] or 0) * REGISTERS

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        a, b = [], []
        rows = rows.append_column("place", pa.array(np.arange(rows.num_rows)))
        bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, WIDTH)
        for g in _groups(rows.drop_columns(["bands"]), ["bucket", "x", "y"]):
            part, cid, top = np.array(g["part"]), g["cid"], Forest(len(g["cid"]))
            root, n, place = np.array(g["root"]), np.array(g["n"]), np.array(g["place"])
            one, apart = np.flatnonzero(part == g["x"][0]), g["x"][0] != g["y"][0]
            two = np.flatnonzero(part == g["y"][0])
            for k, i in enumerate(one.tolist()):  # never a part of the largest component
                rest = two if apart else two[k + 1 :]
                rest = rest[root[rest] != root[i]]
                if len(rest):
                    for j in rest[_alike(bands[place[rest]], n[rest], bands[place[i]][None], n[i], percent)].tolist():
                        if top.join(i, j):
                            a.append(cid[i])
                            b.append(cid[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _binned(rows, ["bucket", "x", "y"], weight).groupBy("bin").applyInArrow(run, "a long, b long")


class Forest:
    """Disjoint sets of 0 to n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether they were apart."""
        i, j = self.top(i), self.top(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def similar(common: np.ndarray, n: int, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m elements that share so many are linked."""
    return 100 * common >= percent * (n + m - common)


def _dealt(inside: DataFrame, sets: DataFrame, most: int) -> DataFrame:
    """What is to be compared inside of clusters, from rows cluster, cid, root: rows of a bin, with the `set` of each, in
    parts x and y of `most` 64-bit numbers, of which all pairs meet. The members of a cluster's largest component are
    never to be compared with each other, so its parts only meet those of the others."""
    weight = (F.length("set") / 8).cast("long")  # a set is what is held of it, 8 bytes an element
    inside = materialize(inside.join(sets.select("cid", weight.alias("n")), "cid"), "near-inside")
    by_root = inside.groupBy("cluster", "root").agg(F.sum("n").alias("w"))
    major = by_root.groupBy("cluster").agg(F.max(F.struct("w", "root"))["root"].alias("major"))
    placed = inside.join(major, "cluster").withColumn("is_major", F.col("root") == F.col("major"))
    size = lambda c: F.coalesce(F.ceil(F.sum(F.when(c, F.col("n"))) / most), F.lit(0)).cast("long")
    parts = materialize(placed.groupBy("cluster", "major").agg(size(~F.col("is_major")).alias("minors"), size(F.col("is_major")).alias("majors")), "near-parts")
    placed = inside.join(parts, "cluster").withColumn("is_major", F.col("root") == F.col("major"))
    part = F.when(F.col("is_major"), F.col("minors") + F.pmod(F.hash("cid"), F.col("majors"))).otherwise(F.pmod(F.hash("cid"), F.col("minors"))).cast("long")
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("is_major"), F.col("minors")).otherwise(F.col("minors") + F.col("majors")) - 1)
    met = placed.withColumn("part", part).withColumn("other", F.explode(others))
    met = met.select("cluster", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "cid", "root")
    rows = met.join(sets, "cid")
    copies = F.col("minors") + F.when(F.col("is_major"), 0).otherwise(F.col("majors"))
    weight = placed.agg(F.sum(F.col("n") * copies)).first()[0] or 0
    return _binned(rows, ["cluster", "x", "y"], weight)


def _checked(inside: DataFrame, sets: DataFrame, percent: int, enough=similar, most: int | None = None) -> DataFrame:
    """Edges that span what sets link inside of clusters, from rows cluster, cid, root: all pairs of a cluster whose
    roots differ are checked, by `enough`, which tells by what the `set`s of two share and by their sizes n, in parts of
    `most` elements; see _dealt()."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        a, b = [], []
        for g in _groups(rows, ["cluster", "x", "y"]):
            order = sorted(range(len(g["cid"])), key=lambda i: g["n"][i])
            n, part, root = (np.array([g[c][i] for i in order]) for c in ("n", "part", "root"))
            cid, apart, top = [g["cid"][i] for i in order], g["x"][0] != g["y"][0], Forest(len(order))
            at = np.concatenate([[0], np.cumsum([len(g["set"][i]) for i in order])])
            ids = np.unique(np.concatenate([g["set"][i] for i in order]), return_inverse=True)[1]
            mark = np.zeros(int(ids.max()) + 1, np.int32)
            for i in range(len(order) - 1):
                to = int(np.searchsorted(n, n[i] * 100 // percent, "right"))  # a larger set cannot be similar enough
                differ = root[i + 1 : to] != root[i]
                if apart:
                    differ &= part[i + 1 : to] != part[i]
                if not differ.any():
                    continue
                own = ids[at[i] : at[i + 1]]
                mark[own] = 1
                common = np.add.reduceat(mark[ids[at[i + 1] : at[to]]], at[i + 1 : to] - at[i + 1])
                mark[own] = 0
                near = differ & enough(common, n[i], n[i + 1 : to], percent)
                for j in np.flatnonzero(near) + i + 1:
                    if top.join(i, int(j)):
                        a.append(cid[i])
                        b.append(cid[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _dealt(inside, sets, most or PART_SHINGLES).groupBy("bin").applyInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """cid, n and the set of each class in `wanted` (cid, rid, rth, hi, lo), from the texts of the rows that stand for
    them; rows that repeat one are taken once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch, texts in blocks(batches, "text"):
            cid, n, out = [], [], []
            for c, hi, lo, t in zip(*(batch.column(k).to_pylist() for k in range(3)), texts, strict=True):
                s = shingles(t, hashes, shingle)
                if set_hash(s) == (hi, lo):
                    cid.append(c)
                    n.append(len(s))
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["cid", "n", "set"])

    texts = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("th"), F.col(text_col).alias("text"))
    found = texts.join(wanted, F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth"))).select("cid", "hi", "lo", "text")
    return found.mapInArrow(run, "cid long, n long, set binary").dropDuplicates(["cid"])


def _linked(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """node, root of the classes that links tie to a smaller one."""
    slots = classes.select("cid", F.posexplode("bands").alias("at", "band")).select("cid", F.xxhash64("at", "band").alias("bucket"))
    shared = slots.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("cid").alias("a")).where("m > 1")
    members = materialize(slots.join(materialize(shared, "near-buckets"), "bucket"), "near-members")
    leaders = materialize(members.groupBy("cid").agg(F.min("a").alias("a")), "near-leaders")
    wanted = classes.join(leaders, "cid").select("cid", F.col("rep.id").alias("rid"), F.col("rep.th").alias("rth"), "hi", "lo")
    wanted = sized(wanted, "near-wanted")
    sets = materialize(_sets(docs, wanted, id_col, text_col, shingle), "near-sets")
    weight = sets.agg(F.sum("n")).first()[0]
    if not weight:
        return classes.where("false").select(F.col("cid").alias("node"), F.col("cid").alias("root"))
    near = materialize(_near(leaders.where("a <> cid").select("a", F.col("cid").alias("b")), classes, percent), "near-edges")
    links = materialize(_met(near, sets, weight, percent), "near-links")
    comp = components(links, "near-components")
    mixed = _mixed(members, comp)
    if mixed.isEmpty():
        return comp
    clusters = components(_unsettled(mixed, classes, percent), "near-clusters")
    nodes = clusters.union(clusters.select(F.col("root").alias("node"), "root").distinct())
    inside = _rooted(nodes.select(F.col("node").alias("cid"), F.col("root").alias("cluster")), comp)
    return components(links.union(_checked(inside, sets, percent)), "near-components")


def _rooted(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """`rows` with the root of each cid."""
    return rows.join(comp.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))


def _mixed(members: DataFrame, comp: DataFrame) -> DataFrame:
    """bucket, cid, root, m of the buckets that hold more than one component, with their members."""
    rooted = _rooted(members.select("bucket", "cid", "m"), comp)
    several = rooted.groupBy("bucket").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p <> q").select("bucket")
    return materialize(rooted.join(materialize(several, "near-several"), "bucket", "left_semi"), "near-mixed")


def _components(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """id, th, n of each row, and first: the id and text hash of the row of least id in its component."""
    ship(docs.sparkSession)
    rows = materialize(sketches(docs, id_col, text_col, shingle), "near-sketches")
    rep = F.struct(F.col("id").isNull().alias("none"), "id", "th")  # null ids come last
    classes = rows.where("n > 0").groupBy("hi", "lo").agg(F.min(rep).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "near-classes")
    linked = _linked(docs, classes, id_col, text_col, shingle, percent)
    named = classes.select("cid", "hi", "lo", "rep").join(linked, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    named = materialize(named.select("hi", "lo", "root", "rep"), "near-named")
    first = materialize(named.groupBy("root").agg(F.min("rep").alias("first")), "near-first")
    named = named.join(first, "root").select(F.col("hi").alias("h"), F.col("lo").alias("l"), "first")
    return rows.join(named, (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l")), "left").select("id", "th", "n", "first")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """id_col, n_shingles, component_id, kept for each row of `docs`.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets; component_id is the
    least id that links lead to, and kept tells whether that is the row's own. Documents without words, null ones
    included, have an empty set and are linked with nothing. A document with fewer words than a shingle has them
    all as its one shingle. Rows with equal sets are one class, however many they are; rows that repeat an id
    belong to the class of their own text. Null ids come last and are kept only where all of a component are null.
    Other columns are not read. An empty table gives an empty result.

    No step gathers what grows without bound: classes come from a pre-aggregation; each class meets one leader, whose
    members are dealt to parts; what is unsettled then is cut into parts that meet in separate groups.
    Nothing is capped or skipped: two classes that share a bucket end in one component or are checked. Texts of
    classes in shared buckets are read a second time, by a row's id and text hash; sets travel from there on.
    """
    out = _components(docs, id_col, text_col, shingle, percent)
    component = F.when(F.col("n") > 0, F.col("first.id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one text of each component, that of least id (null ids last; of an id that repeats, that of least
    hash); columns are as they were, under any names.

    Rows go by id and text, so rows that repeat both stay or go together: near_duplicates() is for documents without
    exact copies. Rows without words stay. An empty table gives an empty result.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    doc_id, text = (f"c{names.index(c)}" for c in (id_col, text_col))
    found = _components(plain, doc_id, text, shingle, percent)
    gone = found.where((F.col("n") > 0) & ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))))
    gone = sized(gone.select(F.col("id").alias("gone"), F.col("th").alias("gone_th")).distinct(), "near-gone")
    return plain.join(gone, F.col(doc_id).eqNullSafe(F.col("gone")) & (text_hash(text) == F.col("gone_th")), "left_anti").toDF(*names)


def query(docs: DataFrame) -> DataFrame:
    """near_duplicates() of all documents with shingles of four words; nulls, empty and short texts, ties, repeated rows,
    clashing names and empty tables as there."""
    return near_duplicates(docs, shingle=4)
