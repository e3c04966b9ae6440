"""Row pattern matching in ordered rows of keys of any size: A, then falls and rises in turn, then perhaps a goal.

A row is a fall (D) or a rise (U) against the row before it; a goal (P) is a row that reaches what A had. Falls and rises
are known before any start is, so rows part into chains, which end where a row is neither. A chain is scanned once from
its end. A row behind a rise may be a goal; those met so far are kept in two ways: as records of the maximum of all
behind, in which a binary search finds the last one that reaches a value, as a greedy P wants it, and as a monotonic
stack, from which smaller ones are taken when a nearer one reaches as far, in which a binary search finds the next one,
as a reluctant P wants it. So each start is answered in logarithmic time.

Rows are dealt by ranges of (key, order), so that a key of any size is spread over many tasks. A task settles the chains
that lie within its range. Of the others it hands on the rows up to its first break and those from its last one on;
what a range needs of those behind it is joined to it, one row for each range, over as many ranges as a chain runs.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauselake.session import materialize, ship

#: Patterns by how P is taken: `A (D+ U+)+ P?`, `A (D+ U+)+ P` and `A (D+ U+?)+? P`.
OPTIONAL, GREEDY, RELUCTANT = "optional", "greedy", "reluctant"
#: Rows of a key that one task adds up at once, where totals run over ranges.
FAN = 256
#: Bits of a row's flags: its value counts, it may fall or rise, it may be a goal, its id is null.
VALID, MOVES, GOAL, NO_ID = 1, 2, 4, 8
#: Values beyond this make no whole number of cents.
MOST_VALUE = 9e16

_FIELDS = ("key", "ts", "id", "cents", "flags")
_D, _U = ord("D"), ord("U")


class Rows:
    """Consecutive rows as arrays, in order."""

    def __init__(self, *columns: np.ndarray):
        self.columns = columns
        self.key, self.ts, self.id, self.cents, self.flags = columns

    def __len__(self) -> int:
        return len(self.key)

    def __getitem__(self, part: slice) -> Rows:
        return Rows(*(c[part] for c in self.columns))

    @classmethod
    def joined(cls, parts: list[Rows]) -> Rows:
        return parts[0] if len(parts) == 1 else cls(*(np.concatenate(c) for c in zip(*(p.columns for p in parts), strict=True)))

    def bytes(self) -> bytes:
        return np.stack([c.astype("<i8") for c in self.columns], axis=1).tobytes()

    @classmethod
    def of(cls, data: bytes) -> Rows:
        return cls(*np.frombuffer(data, "<i8").reshape(-1, len(_FIELDS)).T)

    def labels(self, gap: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row D, U or 0 (a break), and whether it may be a goal; the first row is a break, as what is before it
        is not known."""
        n = len(self)
        label, goal = np.zeros(n, np.uint8), np.zeros(n, bool)
        if n > 1:
            valid = (self.flags & VALID) > 0
            near = valid[1:] & valid[:-1] & (self.key[1:] == self.key[:-1]) & (self.ts[1:] - self.ts[:-1] <= gap)
            moves = near & ((self.flags[1:] & MOVES) > 0)
            label[1:][moves & (self.cents[1:] < self.cents[:-1])] = _D
            label[1:][moves & (self.cents[1:] > self.cents[:-1])] = _U
            goal[1:] = near & ((self.flags[1:] & GOAL) > 0)
        return label, goal


def scan(label: list[int], goal: list[bool], cents: list[int], a: int, e: int, how: str) -> list[tuple[int, int, bool]]:
    """The matches (start, last row, whether that is P) of the chain whose first row is `a` and whose last fall or rise
    is `e`, by starts downward; row e + 1, if there is one, may still be a goal."""
    out: list[tuple[int, int, bool]] = []
    end = e
    while end > a and label[end] != _U:
        end -= 1
    if end <= a:
        return out
    records, places = [], []  # the largest of the goals behind, by value upward; where they are
    stack, nearest = [], []  # goals that no nearer one reaches, by place downward, so by value downward; values negated
    for s in range(min(end, len(label) - 2), a - 1, -1):
        if label[s + 1] == _D and s + 1 < end:
            x = cents[s]
            if how == RELUCTANT:
                k = bisect_right(stack, -x) - 1
                if k >= 0:
                    out.append((s, nearest[k], True))
            else:
                k = bisect_left(records, x)
                last = places[k] if k < len(places) else -1
                if how == GREEDY:
                    if last >= 0:
                        out.append((s, last, True))
                else:  # falls and rises take all they can, so that only the row behind them is left for P
                    out.append((s, end + 1, True) if last == end + 1 else (s, end, False))
        if goal[s + 1] and label[s] == _U and s > a:
            c = cents[s + 1]
            if not records or c > records[-1]:
                records.append(c)
                places.append(s + 1)
            while stack and -stack[-1] <= c:
                stack.pop()
                nearest.pop()
            stack.append(-c)
            nearest.append(s + 1)
    return out


def matches(rows: Rows, starts: int, gap: int, how: str) -> list[tuple]:
    """(key, first id, last id, rows, cents in all, digest of the letters) of each match that starts before row `starts`,
    in order."""
    label, goal = rows.labels(gap)
    bounds = np.flatnonzero(label == 0)
    goals, cents, said = goal.tolist(), rows.cents.tolist(), label.tobytes()
    total = np.concatenate([[0], np.cumsum(np.where(rows.flags & VALID, rows.cents, 0))]).tolist()
    ids = [None if f & NO_ID else i for i, f in zip(rows.id.tolist(), rows.flags.tolist(), strict=True)]
    keys, out, sha = rows.key.tolist(), [], hashlib.sha256
    for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(rows)], strict=True):
        if a >= starts:
            break
        if b - a < 3:
            continue  # a fall and a rise at least
        for s, last, p in reversed(scan(said, goals, cents, a, b - 1, how)):
            if s < starts:
                letters = b"A" + said[s + 1 : last + 1 - p] + b"P" * p
                out.append((keys[s], ids[s], ids[last], last - s + 1, total[last + 1] - total[s], sha(letters).hexdigest()))
    return out


def _found(part: int, first: int, before: dict[int, int], found: list[tuple], edge: tuple | None) -> pa.RecordBatch:
    """Matches numbered within their key and range, and perhaps the row of the range's edges."""
    numbers = []
    for m in found:
        before[m[0]] = no = before.get(m[0], 0) + 1
        numbers.append(no)
    for k in [k for k in before if found and k != found[-1][0]]:  # keys come in order
        del before[k]
    cols = [pa.array([m[c] for m in found] + [None] * bool(edge), t) for c, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.int64()), (5, pa.string()))]
    n = len(found) + bool(edge)
    lead = [m[0] == first for m in found] + [None] * bool(edge)
    ends = [pa.array([None] * len(found) + ([edge[k]] if edge else []), t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()))]
    return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(numbers + [None] * bool(edge), pa.int64()), pa.array(lead, pa.bool_()), *cols, *ends], _NAMES)


_NAMES = ["part", "no", "lead", "key", "first_id", "last_id", "n_rows", "sum_cents", "labels_sha256", "first_key", "last_key", "last_before", "through", "head", "tail"]
_SCHEMA = "part int, no long, lead boolean, key long, first_id long, last_id long, n_rows long, sum_cents long, labels_sha256 string, first_key long, last_key long, last_before long, through boolean, head binary, tail binary"


def _ranges(batches: Iterator[pa.RecordBatch], gap: int, how: str) -> Iterator[pa.RecordBatch]:
    """The matches of a range whose chains end in it, and its edges: the rows up to the first break, whether there is none,
    and the rows from the last break on."""
    part, held, head, first, before = TaskContext.get().partitionId(), [], None, None, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        new = Rows(*(batch.column(k).cast(pa.int64()).to_numpy(zero_copy_only=False) for k in range(len(_FIELDS))))
        first = int(new.key[0]) if first is None else first
        label = Rows.joined([held[-1][-1:], new]).labels(gap)[0][1:] if held else new.labels(gap)[0]
        breaks = np.flatnonzero(label == 0)
        if not held:
            breaks = breaks[1:]  # the first row of the range begins its first chain
        held.append(new)
        if not len(breaks):
            continue
        at = sum(map(len, held)) - len(new)
        rows = Rows.joined(held)
        if head is None:
            head = rows[: at + int(breaks[0]) + 1].bytes()
        cut = at + int(breaks[-1])
        yield _found(part, first, before, matches(rows[: cut + 1], cut, gap, how), None)
        held = [rows[cut:]]
    if held:
        rows = Rows.joined(held)
        tail, last = rows.bytes(), int(rows.key[-1])
        yield _found(part, first, before, [], (first, last, before.get(last, 0), head is None, head if head is not None else tail, tail))


def running(rows: DataFrame, key: str, order: str, value: str, most: int) -> DataFrame:
    """`rows` with `before`: the sum of `value` over the rows of the same `key` whose `order`, a number from 0 to `most`, is
    less. Sums go up and down by levels, so that no task gets more than FAN rows of a key, or sums of them."""
    w = Window.partitionBy(key, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("block", F.floor(F.col(order) / FAN))
    inner = inner.withColumn("before", F.coalesce(F.sum(value).over(w), F.lit(0)))
    if most < FAN:
        return inner.drop("block")
    k, b = f"key_{most}", f"block_{most}"  # each level's own
    totals = rows.groupBy(F.col(key).alias(k), F.floor(F.col(order) / FAN).alias(b)).agg(F.sum(value).alias("total"))
    above = running(totals, k, b, "total", most // FAN).select(k, b, F.col("before").alias("above"))
    out = inner.join(above.hint("merge"), (F.col(key) == F.col(k)) & (F.col("block") == F.col(b)))
    return out.withColumn("before", F.col("before") + F.col("above")).drop(k, b, "block", "above")


def _behind(edges: DataFrame) -> DataFrame:
    """k, behind: what follows on each range, up to the first break. Ranges without a break are passed over by doubling:
    each round joins what is known from there on."""
    after = edges.select((F.col("k") - 1).alias("k"), F.col("head").alias("behind"), F.col("through").alias("open"), F.col("k").alias("to"))
    known = materialize(after, "pattern-behind")
    while not known.where("open").isEmpty():
        more = known.select(F.col("k").alias("to"), F.col("behind").alias("more"), F.col("open").alias("still"), F.col("to").alias("next"))
        j = known.join(more.hint("merge"), "to", "left")
        go = F.col("open") & F.col("next").isNotNull()
        known = j.select("k", F.when(go, F.concat("behind", "more")).otherwise(F.col("behind")).alias("behind"), F.when(go, F.col("still")).otherwise(False).alias("open"), F.when(go, F.col("next")).otherwise(F.col("to")).alias("to"))
        known = materialize(known, "pattern-behind")
    return known.select("k", "behind")


def _digest(rows: DataFrame, names: list[str]):
    """What tells rows apart by columns that are not looked at otherwise."""
    parts = []
    for c in names:
        plain = rows.schema[c].dataType.typeName() not in ("array", "map", "struct", "variant")
        said = F.col(c).cast("string") if plain else F.to_json(F.struct(c))
        parts.append(F.coalesce(F.concat(F.length(said).cast("string"), F.lit(":"), said), F.lit("-")))
    return F.unhex(F.md5(F.concat(*parts))) if parts else F.lit(None).cast("binary")


def match_rows(rows: DataFrame, key_col: str = "client_id", order_col: str = "ts", id_col: str = "click_id", value_col: str = "value", kind_col: str = "kind", how: str = OPTIONAL, minutes: float = 30, goal: str = "click", barred: str = "error") -> DataFrame:
    """The matches of a pattern in the distinct rows of each key, ordered by order_col and id_col: key_col, match_no (from 1
    for each key), first_id, last_id, n_rows, sum_cents, labels_sha256.

    `how` is OPTIONAL for `A (D+ U+)+ P?`, GREEDY for `A (D+ U+)+ P` or RELUCTANT for `A (D+ U+?)+? P`; each start is
    tried, as matches may overlap, and gives the match that backtracking would give first. A is a row with a value;
    D and U have a kind other than `barred` and cents below and above those of the row before; P has kind `goal` and cents
    at least A's; D, U and P come at most `minutes` after the row before. Cents are floor(100 * value + 0.5).

    Rows whose key or time is null are left out; null, NaN and infinite values and those beyond MOST_VALUE fit no letter,
    null kinds only A. Rows that are equal in all columns count once; of rows with equal keys, times and ids those
    with lesser kinds and values come first, nulls before all; null ids are given back. Keys and ids are whole
    numbers, times timestamps. Other columns, however named, only tell rows apart. An empty table gives an empty result.

    Two shuffles of narrow rows: one to drop repeated rows, pre-aggregated, and one by ranges, of which a key takes as
    many as it fills. What goes from range to range is a row for each, joined by number; nothing is sent to the driver
    but Spark's own sample of the order, and nothing is broadcast. A chain's letters are kept as long as the chain
    runs, one byte a row, since each match owes a digest of all of its own.
    """
    if how not in (OPTIONAL, GREEDY, RELUCTANT):
        raise ValueError(f"unknown pattern: {how}")
    spark = rows.sparkSession
    ship(spark)
    used = [key_col, order_col, id_col, kind_col, value_col]
    rest = [c for c in rows.columns if c not in used]
    value = F.col(value_col).cast("double")
    sound = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < MOST_VALUE)
    cents = F.when(sound, F.floor(value * 100 + 0.5)).cast("long")
    slim = rows.where(F.col(key_col).isNotNull() & F.col(order_col).isNotNull()).select(F.col(key_col).cast("long").alias("key"), F.col(order_col).alias("ts"), F.col(id_col).cast("long").alias("id"), F.col(kind_col).alias("kind"), value.alias("value"), cents.alias("cents"), _digest(rows, rest).alias("rest"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    flags = F.when(F.col("cents").isNotNull(), VALID).otherwise(0) + F.when(F.col("kind") != barred, MOVES).otherwise(0) + F.when(F.col("kind") == goal, GOAL).otherwise(0) + F.when(F.col("id").isNull(), NO_ID).otherwise(0)
    order = ["key", "ts", F.col("id").asc_nulls_first(), F.col("kind").asc_nulls_first(), F.col("value").asc_nulls_first()]
    dealt = slim.distinct().drop("rest").repartitionByRange(ranges, "key", "ts", F.col("id").asc_nulls_first()).sortWithinPartitions(*order)
    dealt = dealt.select("key", "ts", F.coalesce("id", F.lit(0)).alias("id"), F.coalesce("cents", F.lit(0)).alias("cents"), flags.cast("long").alias("flags"))
    gap = int(minutes * 60_000_000)
    found = materialize(dealt.mapInArrow(lambda b: _ranges(b, gap, how), _SCHEMA), "pattern-ranges")
    closed = found.where(F.col("key").isNotNull())

    edges = found.where(F.col("key").isNull()).select("part", "first_key", "last_key", "last_before", "through", "head", "tail", F.lit(0).alias("all"), F.lit(1).alias("one"))
    edges = materialize(running(edges, "all", "part", "one", ranges).withColumnRenamed("before", "k"), "pattern-edges")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                tail = Rows.of(r["tail"])
                whole = Rows.joined([tail, Rows.of(r["behind"])]) if r["behind"] else tail
                yield _found(r["part"], r["first_key"], {r["last_key"]: r["last_before"]}, matches(whole, len(tail), gap, how), None)

    open_ends = edges.join(_behind(edges).hint("merge"), "k", "left").select("part", "first_key", "last_key", "last_before", "tail", "behind")
    settled = materialize(open_ends.mapInArrow(settle, _SCHEMA), "pattern-settled")
    counts = settled.groupBy("part").agg(F.count(F.lit(1)).alias("more"))
    ends = edges.join(counts.hint("merge"), "part", "left").select("part", "k", "first_key", "last_key", (F.col("last_before") + F.coalesce("more", F.lit(0))).alias("n"))
    # the matches of a range's last key count for the ranges behind it, asked for by the first key of each
    asked = ends.select(F.col("first_key").alias("key"), (F.col("k") * 2).alias("place"), "part", F.lit(0).cast("long").alias("n"))
    given = ends.select(F.col("last_key").alias("key"), (F.col("k") * 2 + 1).alias("place"), F.lit(None).cast("int").alias("part"), "n")
    offsets = running(asked.union(given), "key", "place", "n", 2 * ranges + 1).where(F.col("part").isNotNull()).select("part", F.col("before").alias("offset"))
    columns = ["key", "no", "first_id", "last_id", "n_rows", "sum_cents", "labels_sha256"]
    both = closed.select("part", "lead", *columns).union(settled.select("part", "lead", *columns))
    led = both.where("lead").join(offsets.hint("merge"), "part").withColumn("no", F.col("no") + F.col("offset"))
    out = both.where("NOT lead").select(*columns).union(led.select(*columns))
    return out.withColumnsRenamed({"key": key_col, "no": "match_no"})


def query(clicks: DataFrame) -> DataFrame:
    """match_rows() of all clicks with `A (D+ U+)+ P?`; nulls, broken values, ties, repeated rows, clashing names and empty
    tables as there."""
    return match_rows(clicks)


SQL = """
WITH r AS (SELECT client_id, ts, click_id, kind, value, CASE WHEN isfinite(value) AND abs(value) < 9e16 THEN floor(100 * value + 0.5)::BIGINT END AS c FROM (SELECT DISTINCT * FROM clicks) WHERE client_id IS NOT NULL AND ts IS NOT NULL),
n AS (SELECT *, row_number() OVER w AS i, lag(c) OVER w AS pc, ts <= lag(ts) OVER w + INTERVAL 30 MINUTE AS near FROM r WINDOW w AS (PARTITION BY client_id ORDER BY ts, click_id NULLS FIRST, kind NULLS FIRST, value NULLS FIRST)),
l AS (SELECT *, CASE WHEN near AND kind <> 'error' AND c < pc THEN 'D' WHEN near AND kind <> 'error' AND c > pc THEN 'U' ELSE '.' END AS lab, coalesce(near AND kind = 'click' AND c IS NOT NULL AND pc IS NOT NULL, false) AS goal FROM n),
k AS (SELECT *, sum(CASE WHEN lab = '.' THEN 1 ELSE 0 END) OVER w AS g, sum(coalesce(c, 0)) OVER w AS s, lead(lab) OVER w AS next FROM l WINDOW w AS (PARTITION BY client_id ORDER BY i)),
chains AS (SELECT client_id, g, min(i) AS a, max(i) FILTER (lab = 'U') AS u, string_agg(lab, '' ORDER BY i) AS labs FROM k GROUP BY ALL),
m AS (SELECT k.*, a, u, labs FROM k JOIN chains USING (client_id, g) WHERE next = 'D' AND u > i),
e AS (SELECT m.*, x.click_id AS u_id, x.s AS u_s, p.click_id AS p_id, p.s AS p_s, coalesce(p.goal AND p.c >= m.c, false) AS hit FROM m JOIN k x ON x.client_id = m.client_id AND x.i = m.u LEFT JOIN k p ON p.client_id = m.client_id AND p.i = m.u + 1)
SELECT client_id, row_number() OVER (PARTITION BY client_id ORDER BY i) AS match_no, click_id AS first_id, CASE WHEN hit THEN p_id ELSE u_id END AS last_id,
  (u - i + 1 + hit::INT)::BIGINT AS n_rows, ((CASE WHEN hit THEN p_s ELSE u_s END) - s + c)::BIGINT AS sum_cents,
  sha256('A' || substr(labs, (i - a + 2)::BIGINT, (u - i)::BIGINT) || CASE WHEN hit THEN 'P' ELSE '' END) AS labels_sha256 FROM e
"""
