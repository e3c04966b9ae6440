"""Quotas that hold together (ST3): requests and tokens a minute and a day, of each client, on tables and on streams.

A request is let through if it fits into all quotas at once; one that is refused uses nothing, so that what a client may do
next depends on all that was decided before. A client's requests are therefore folded in order. What the fold keeps is
bounded: the requests let through in the last day, of which there are no more than the quota of a day.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.session import ship

# What is counted, in how many seconds, and how much of it is let through.
QUOTAS = (("requests", 60, 30), ("requests", 86_400, 1_000), ("tokens", 60, 8_000), ("tokens", 86_400, 200_000))
_MICROS = 1_000_000
_LONGEST = max(seconds for _, seconds, _ in QUOTAS)

SCHEMA = "client string, ord long, allowed boolean, refused_by string, retry_after double"
STATE = "times array<long>, tokens array<double>"


class Ledger:
    """The requests of a client that were let through, by time in microseconds; those older than the longest quota go."""

    def __init__(self, times: list[int] = (), tokens: list[float] = (), quotas: tuple = QUOTAS):
        self.times, self.tokens, self.quotas = list(times), list(tokens), quotas

    def request(self, at: int, tokens: float) -> tuple[bool, str | None, float]:
        """Whether a request is let through; the first quota that refuses it, and the seconds after which that one has room
        again, or infinity if it never has. A request that comes late is judged at the time of the last one let through."""
        at = max(at, self.times[-1]) if self.times else at
        gone = bisect_right(self.times, at - _LONGEST * _MICROS)
        del self.times[:gone], self.tokens[:gone]
        for what, seconds, most in self.quotas:
            first = bisect_right(self.times, at - seconds * _MICROS)
            asks = 1 if what == "requests" else tokens
            used = len(self.times) - first if what == "requests" else sum(self.tokens[first:])
            if used + asks > most:
                wait = float("inf")
                if asks <= most:
                    while used + asks > most:
                        used -= 1 if what == "requests" else self.tokens[first]
                        first += 1
                    wait = (self.times[first - 1] + seconds * _MICROS - at) / _MICROS
                return False, f"{what}/{seconds}s", wait
        self.times.append(at)
        self.tokens.append(tokens)
        return True, None, 0.0


def fold_in_order(rows: DataFrame, key: str, order: list, fresh: Callable[[], object], step: Callable, schema: str) -> DataFrame:
    """Rows of each key through `step(state, row)` in order; each gives a row of `schema`. A key goes through one task, as
    each step needs the one before, but is never held there: rows are streamed in sorted batches and one state is kept."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                own = getattr(r, key)
                if own != last:
                    last, state = own, fresh()
                out.append(step(state, r))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def _requests(events: DataFrame, client: str, ts: str, tokens: str, ord_col: str) -> DataFrame:
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    known = F.col(client).isNotNull() & F.col(ts).isNotNull()
    return events.where(known).select(F.col(client).cast("string").alias("client"), at.alias("at"), F.col(ord_col).cast("long").alias("ord"), F.coalesce(F.greatest(F.col(tokens).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("tokens"))


def _answer(ledger: Ledger, r) -> tuple:
    return r.client, r.ord, *ledger.request(int(r.at), float(r.tokens))


def quotas(events: DataFrame, client: str = "user_id", ts: str = "ts", tokens: str = "value", ord_col: str = "event_id") -> DataFrame:
    """client, ord, allowed, refused_by, retry_after of each request of a table, by time and then `ord_col`. Requests
    without a client or a time are left out; null and negative tokens are none."""
    return fold_in_order(_requests(events, client, ts, tokens, ord_col), "client", ["at", "ord"], Ledger, _answer, SCHEMA)


def quota_stream(events: DataFrame, client: str = "user_id", ts: str = "ts", tokens: str = "value", ord_col: str = "event_id", idle_hours: int = 25) -> DataFrame:
    """The same on a stream: the ledger of a client is kept in the state store between batches, so that a query that is
    started again on its checkpoint goes on where it was. Ledgers of clients that stay away are dropped."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ledger = Ledger(*(state.get if state.exists else ((), ())))
        rows = pd.concat(list(batches)).sort_values(["at", "ord"])
        out = [_answer(ledger, r) for r in rows.itertuples(index=False)]
        state.update((ledger.times, ledger.tokens))
        state.setTimeoutDuration(idle_hours * 3_600_000)
        yield pd.DataFrame(out, columns=["client", "ord", "allowed", "refused_by", "retry_after"])

    return _requests(events, client, ts, tokens, ord_col).groupBy("client").applyInPandasWithState(run, SCHEMA, STATE, "append", "ProcessingTimeTimeout")
