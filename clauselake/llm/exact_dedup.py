"""Exact de-duplication by progressive refinement, in DataFrame functions only.

Texts are equal when identical after lower-casing A-Z, which leaves lengths as they are. Rows are grouped by length;
lengths that occur once are done. The rest is grouped by a hash of the first characters, and what still shares a group
is read whole and grouped by a digest of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.llm.batches import ascii_lower
from clauselake.session import materialize, sized

#: Characters of a text that the second grouping looks at.
PREFIX = 64


def _shared(df: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """The keys that more than one row has. Counts are made before the shuffle, so a hot key costs a row a task."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(mark)).where(F.col(mark) > 1).select(*keys, F.lit(True).alias(mark))


def _lower(text_col: str):
    return ascii_lower(F.coalesce(F.col(text_col), F.lit("")))


def _keys(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """__id, __len, __prefix and `more` of each row; the hash takes no more than PREFIX characters."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("__id"), F.octet_length(text).alias("__len"), F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX))).alias("__prefix"), *more)


def _shared_prefixes(rows: DataFrame) -> DataFrame:
    """The (__len, __prefix) of more than one of `rows`, marked by __by_prefix: by length first, and by prefix hash only
    where lengths are shared."""
    lengths = sized(_shared(rows, ["__len"], "__by_len"), "exact-lengths")
    some = rows.join(lengths, "__len").select("__len", "__prefix")
    return sized(_shared(some, ["__len", "__prefix"], "__by_prefix"), "exact-prefixes")


def equal_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row for each row of `docs`: id_col, keep_id, group_size, kept, text_sha256, whatever else `docs` has.

    A null text counts as empty; empty texts equal each other. Of equal texts the row with the largest id stays (the
    smallest with keep="min"); null ids come last. Rows repeated with the id that stays are all kept, as nothing
    tells them apart. Further columns of `docs` are left behind, so their names cannot clash. An empty table gives
    an empty result.

    Every row's digest is part of the result, so this reads and digests every text, once, in the scan that reduces each
    row to its id, length, prefix hash and digest; these are written, and no shuffle carries text. What the refinement
    saves here is grouping: only rows that share length and prefix hash with another are grouped by digest.
    drop_copies(), which owes nobody a digest, reads whole texts of such rows alone. Each grouping joins its keys back,
    which adaptive execution splits where a group of copies is hot.
    """
    rows = materialize(_keys(docs, id_col, text_col, F.unhex(F.sha2(_lower(text_col), 256)).alias("__sha")), "exact-rows")
    rows = rows.join(_shared_prefixes(rows), ["__len", "__prefix"], "left")
    pick = F.max if keep == "max" else F.min
    full = rows.where("__by_prefix").groupBy("__sha").agg(pick("__id").alias("__keep"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    full = sized(full, "exact-digests")
    keep_id = F.when(F.col("__n").isNotNull(), F.col("__keep")).otherwise(F.col("__id"))
    return rows.join(full, "__sha", "left").select(
        F.col("__id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        F.col("__id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of equal texts, the one of largest id; columns are as they were.

    A null text equals an empty one; null ids rank below all others. Of rows that repeat both id and text one stays,
    the one whose columns hash least; rows equal in all columns are the same to tell. Names that begin with two
    underscores may be taken by other columns. An empty table gives an empty result.

    The first scan takes lengths and hashes of PREFIX characters; whole texts are digested only of rows that share both
    with another, and those that go once more, where an id may stand for several texts.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])  # so that no name of ours is taken
    doc_id, text = (f"c{names.index(c)}" for c in (id_col, text_col))
    rows = materialize(_keys(plain, doc_id, text), "exact-rows")
    wide, digest = _keys(plain, doc_id, text, *plain.columns), F.unhex(F.sha2(_lower(text), 256))
    shared = _shared_prefixes(rows)
    read = materialize(_keys(plain, doc_id, text, F.col(text).alias("__text")).join(shared, ["__len", "__prefix"], "left_semi").select("__id", "__len", "__prefix", F.unhex(F.sha2(ascii_lower(F.coalesce("__text", F.lit(""))), 256)).alias("__sha")), "exact-read")
    groups = sized(read.groupBy("__sha").agg(F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__sha", "__keep"), "exact-digests")
    one = read.groupBy("__id", "__len", "__prefix", "__sha").agg(F.count(F.lit(1)).alias("__times")).join(groups, "__sha")
    one = materialize(one.withColumn("__stays", F.col("__id").eqNullSafe(F.col("__keep"))), "exact-ids")
    gone = one.where("NOT __stays OR __times > 1").select(*[F.col(f"__{k}").alias(f"g_{k}") for k in ("id", "len", "prefix", "sha")])
    gone = sized(gone, "exact-gone")
    same = F.col("__id").eqNullSafe(F.col("g_id")) & (F.col("__len") == F.col("g_len")) & (F.col("__prefix") == F.col("g_prefix"))
    # no equality, which would make the digest a join key: as it is, it is worked out behind the join on narrow keys, for
    # rows that these agree on, and no shuffle carries it
    same = same & F.startswith(digest, F.col("g_sha"))
    left = wide.join(gone, same, "left_anti").select(*plain.columns)
    again = one.where("__stays AND __times > 1").select(*[F.col(f"__{k}").alias(f"g_{k}") for k in ("id", "len", "prefix", "sha")])
    if not again.isEmpty():
        row = F.struct(*plain.columns)
        first = wide.join(sized(again, "exact-again"), same).groupBy("__id", F.col("g_sha").alias("__sha")).agg(F.min_by(row, F.xxhash64(*plain.columns)).alias("r"))
        left = left.union(first.select("r.*"))
    return left.toDF(*names)


def query(docs: DataFrame) -> DataFrame:
    """equal_groups() of all documents; nulls, empty texts, ties, repeated rows, clashing names and empty tables there."""
    return equal_groups(docs)


SQL = r"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT doc_id, sha256(norm) AS text_sha256, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

