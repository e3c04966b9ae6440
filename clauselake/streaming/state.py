"""Service state over events: cache hits, rate limits, budgets, histograms and a circuit breaker (ST1-ST5).

Each has a form for a table of events; the breaker and the windows run on streams as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.streaming.quotas import fold_in_order

#: Upper bounds of the latency histogram's buckets, in seconds.
BUCKETS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def ttl_cache_hits(requests: DataFrame, key: str, at: str, order: str, ttl: float = 3600.0) -> DataFrame:
    """ST1 without the size limit: whether each request finds a live entry. A miss inserts; a hit does not prolong.

    Entries follow each other in time, so a key's requests fold into (time of the live insert, hits so far): one
    sorted array a key and one expression.
    """
    item = F.struct(F.col(at).alias("t"), F.col(order).alias("o"))
    g = requests.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("x"))
    start = F.struct(F.lit(None).cast("double").alias("live"), F.array().cast("array<struct<o:bigint,hit:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        hit = F.coalesce(x["t"] - acc["live"] < ttl, F.lit(False))
        return F.struct(F.when(hit, acc["live"]).otherwise(x["t"]).cast("double").alias("live"), F.concat(acc["out"], F.array(F.struct(x["o"].cast("bigint").alias("o"), hit.alias("hit")))).alias("out"))

    folded = g.select(key, F.aggregate("x", start, step)["out"].alias("out"))
    return folded.select(key, F.explode("out").alias("e")).select(key, F.col("e.o").alias(order), F.col("e.hit").alias("hit"))


def rate_limit_windows(events: DataFrame, client: str, ts: str, limit: int, width: str = "1 minute") -> DataFrame:
    """ST2: requests by client and window, and how many are over the limit. Streams need a watermark on `ts`."""
    g = events.groupBy(client, F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(client, F.col("w.start").alias("start"), "n", F.greatest(F.lit(0), F.col("n") - limit).alias("over"))


def rolling_budget(events: DataFrame, client: str, ts: str, tokens: str, seconds: int, budget: float) -> DataFrame:
    """ST3: the tokens that each client used in the seconds up to each event, and whether that is over the budget."""
    w = Window.partitionBy(client).orderBy(F.col("__s")).rangeBetween(-seconds * 1_000_000, 0)
    out = events.withColumn("__s", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("used", F.round(F.sum(tokens).over(w), 6))
    return out.withColumn("over", F.col("used") > budget).drop("__s")


def token_valid(issued: Column, now: Column, lives: str = "1 hour") -> Column:
    """ST9: whether a token is still valid."""
    return issued + F.expr(f"INTERVAL {lives}") > now


def latency_histogram(events: DataFrame, key: str, value: str, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """ST5, long form: by key, how many values are at or below each bound; a null bound counts all."""
    counts = events.groupBy(key).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("all"))
    parts = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(None).cast("double").alias("le"), F.col("all").alias("n")))
    return counts.select(key, F.explode(parts).alias("p")).select(key, "p.le", "p.n")


class Breaker:
    """ST4: closed until `threshold` failures in a row, open for `recovery` seconds, then half open: the next success
    closes it, the next failure opens it again."""

    def __init__(self, threshold: int = 5, recovery: float = 30.0, state: str = "closed", failures: int = 0, since: float = 0.0):
        self.threshold, self.recovery, self.state, self.failures, self.since = threshold, recovery, state, failures, since

    def call(self, at: float, ok: bool) -> tuple[bool, float]:
        """Whether the call is let through, and after how many seconds to come back if not."""
        if self.state == "open":
            if at - self.since < self.recovery:
                return False, self.recovery - (at - self.since)
            self.state = "half_open"
        if ok:
            self.state, self.failures = "closed", 0
        else:
            self.failures += 1
            if self.state == "half_open" or self.failures >= self.threshold:
                self.state, self.since = "open", at
        return True, 0.0


BREAKER_SCHEMA = "ord long, dependency string, allowed boolean, state string, failures long, retry_after double"


def _answer(b: Breaker, r) -> tuple:
    allowed, wait = b.call(r.at, bool(r.ok))
    return r.ord, r.dependency, allowed, b.state, b.failures, wait


CALL = ["ord", "at", "dependency", "ok"]
_COLUMNS = ["ord", "dependency", "allowed", "state", "failures", "retry_after"]


def breaker_states(calls: DataFrame, threshold: int = 5, recovery: float = 30.0) -> DataFrame:
    """The breaker's answer and state after each call (ord, at, dependency, ok), by dependency. A dependency's calls are
    streamed in order, and its breaker alone is kept."""
    order = [F.asc_nulls_last("at"), F.asc_nulls_last("ord")]
    return fold_in_order(calls.select(*CALL), "dependency", order, lambda: Breaker(threshold, recovery), _answer, BREAKER_SCHEMA)


def breaker_stream(calls: DataFrame, threshold: int = 5, recovery: float = 30.0) -> DataFrame:
    """The same on a stream: state is kept by dependency between batches."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        b = Breaker(threshold, recovery, *(state.get if state.exists else ("closed", 0, 0.0)))
        rows = pd.concat(list(batches))
        out = pd.DataFrame([_answer(b, r) for r in rows.sort_values(["at", "ord"]).itertuples()], columns=_COLUMNS)
        state.update((b.state, b.failures, float(b.since)))
        yield out

    return calls.groupBy("dependency").applyInPandasWithState(run, BREAKER_SCHEMA, "state string, failures long, since double", "append", "NoTimeout")


def event_rates(events: DataFrame, ts: str = "ts", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events and values by type in tumbling windows, for streams and tables; late events are let in up to `late`."""
    e = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    g = e.groupBy(F.window("__ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")
