"""Mixing sources to target weights by systematic sampling.

A source of target t and size s expects t/s copies of each of its documents. Expected copies are summed up along
the documents of a source, a random offset is added, and a document is emitted once for each integer that its
stretch crosses. Documents go along in order of size, so that words taken come as near to the target as documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.session import materialize, sized

#: Weights that the sources, in order of code points and null last, take in turn.
WEIGHTS = (5, 2, 1)
#: Most copies of a document, and so the most that a source's target is of its size.
MOST_COPIES = 3
_IN_PARTITION = (1 << 33) - 1
_WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long")


def placed(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`df` dealt out by ranges of `order` and sorted, with __pid and __idx, the partition and the place in it.

    It is written, so that later steps see the same places although ranges come from a sample.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    return materialize(dealt.select("*", F.shiftright(at, 33).alias("__pid"), at.bitwiseAND(F.lit(_IN_PARTITION)).alias("__idx")), name)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """__source, __source_size, __target from __source, __source_size.

    Ranks of the sources come from a distributed sort, and each round of sharing is one sum over the table, so the
    number of sources is not bounded. A round raises the share of a unit of weight to
    (total - sum of the stopped targets) / (weight of the others); it ends when nothing more is stopped.
    """
    at = placed(sizes, [F.col("__source").isNull().alias("__null"), F.col("__source")], "mix-sources")
    counts = at.groupBy("__pid").agg((F.max("__idx") + 1).alias("__n"))  # one row a partition
    starts = sized(counts.select("__pid", F.coalesce(F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start")), "mix-starts")
    w = F.array(*[F.lit(float(x)) for x in weights])
    turn = (F.pmod(F.col("__start") + F.col("__idx"), F.lit(len(weights))) + 1).cast("int")
    ranked = materialize(at.join(starts, "__pid").select("__source", "__source_size", F.element_at(w, turn).alias("__w"), (F.col("__source_size") * F.lit(float(most))).alias("__cap")), "mix-ranked")
    share, stopped = 0.0, -1
    while True:
        over = F.col("__cap") < F.col("__w") * F.lit(share)
        r = ranked.agg(F.sum("__source_size").alias("all"), F.sum(F.when(over, F.col("__cap"))).alias("held"), F.count_if(over).alias("n"), F.sum(F.when(~over, F.col("__w"))).alias("free")).first()
        if r["n"] == stopped or not r["free"]:
            break
        stopped, share = r["n"], ((r["all"] or 0) - (r["held"] or 0.0)) / r["free"]
    return ranked.select("__source", "__source_size", F.least("__cap", F.col("__w") * F.lit(share)).alias("__target"))


def copies(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES, seed: int = 7) -> DataFrame:
    """`rows`, which have __source, __size and __h, a hash to order ties by, with __source_size, __target and __copies."""
    order = [F.col("__source").isNull(), F.col("__source"), F.col("__size"), F.col("__h")]
    rows = placed(rows, order, "mix-rows")
    parts = materialize(rows.groupBy("__source", "__pid").agg(F.count(F.lit(1)).alias("__n"), F.min("__idx").alias("__first"), F.sum("__size").alias("__words")), "mix-parts")
    sizes = parts.groupBy("__source").agg(F.sum("__words").alias("__source_size"))
    goal = targets(sizes, weights, most)
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__source").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = F.pmod(F.xxhash64("__source", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    # the first rank and the first boundary of each stretch of a source in a partition
    parts = parts.select("__source", "__pid", (before - F.col("__first")).alias("__shift"), offset.alias("__u"))
    parts = parts.alias("p").join(goal.alias("g"), F.col("p.__source").eqNullSafe(F.col("g.__source"))).select(F.col("p.__source").alias("__s"), F.col("__pid").alias("__p"), "__shift", "__u", "__source_size", "__target")
    # written and counted, so that the rows meet it without a shuffle of their own
    parts = sized(parts, "mix-stretches")
    joined = rows.join(parts, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__pid") == F.col("__p")))
    expected = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    rank = F.col("__idx") + F.col("__shift")
    crossed = F.floor(F.col("__u") + (rank + 1) * expected) - F.floor(F.col("__u") + rank * expected)
    return joined.withColumn("__copies", F.least(crossed, F.ceil(expected)).cast("long")).drop("__s", "__p", "__pid", "__idx", "__shift", "__u")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES, seed: int = 7) -> DataFrame:
    """id, size, source_size, target (its source's) and copies, 0 or more, of every row of `docs`, under these names.

    A null text has size 0, a null source is a source of its own. Of rows that tie in size, a hash of the id sets the
    order, of rows with one id the order does not matter here: equal rows are exchangeable. A document's copies are
    the expected number rounded down or up, so `most` at the most. An empty table or one without words takes nothing.
    Other columns are left behind, so no name can clash. The text is reduced to its size in the scan and is not shuffled.

    Nothing is gathered by source: rows are dealt out by ranges of (source, size, hash), so a hot source spreads
    over as many partitions as its rows fill, and only (partition, source) counts are added up across them.
    """
    narrow = docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), word_count(F.col(text_col)).alias("__size"))
    rows = materialize(narrow.withColumn("__h", F.xxhash64("__id", F.lit(seed))), "mix-sizes")  # words are counted once
    mixed = copies(rows, weights, most, seed)
    return mixed.select(F.col("__id").alias("id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__copies").alias("copies"))


def emit(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES, seed: int = 7) -> DataFrame:
    """The mix itself: each row of `docs` as many times as it is taken, with its columns as they are, under any names.

    Nulls, empty texts, ties and empty tables as in mix_sources(), but that rows of one id and size are ordered by a
    hash of all their columns, so that reruns take the same ones. Whole rows are dealt out once, by the ranges that
    place them, and written; no later step shuffles them.
    """
    names = docs.columns
    own = [f"c{k}" for k in range(len(names))]
    plain = docs.toDF(*own)
    doc_id, source, text = (F.col(f"c{names.index(c)}") for c in (id_col, source_col, text_col))
    h = F.xxhash64(F.xxhash64(doc_id, F.lit(seed)), F.xxhash64(*own))
    mixed = copies(plain.withColumns({"__source": source, "__size": word_count(text), "__h": h}), weights, most, seed)
    taken = mixed.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return taken.select(*own).toDF(*names)


def query(docs: DataFrame) -> DataFrame:
    """What the mix takes of each document: mix_sources() with the words taken. Nulls and ties as there; reruns agree."""
    mixed = mix_sources(docs)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
