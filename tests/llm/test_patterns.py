import datetime as dt
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from clauselake.llm import patterns

SCHEMA = "client_id long, ts timestamp_ntz, click_id long, kind string, value double, props string"
START = dt.datetime(2024, 3, 31, 1, 0)  # an hour that some zones leave out follows


def clicks(seed, n=700, clients=4, quiet=0.02):
    """One client with most rows and long chains, ties, nulls, broken values, repeated rows and wide gaps."""
    r = random.Random(seed)
    out, at = [], {}
    for i in range(n):
        c = r.choice([0] * 6 + list(range(clients)))
        at[c] = at.get(c, START) + dt.timedelta(minutes=r.choice([0, 0.5, 3, 30, 29.99]) if r.random() > quiet else r.choice([31, 600]))
        kind = r.choice(["click", "click", "view", "purchase"]) if r.random() > 2 * quiet else r.choice(["error", None])
        value = r.choice([float(r.randrange(1, 9)), r.random() * 8, 2.345]) if r.random() > quiet else r.choice([None, math.nan, math.inf, -3.0, 1e300])
        row = (c if r.random() > quiet / 4 else None, at[c] if r.random() > quiet / 4 else None, i if r.random() > quiet / 4 else None, kind, value, None if r.random() < 0.1 else "{}")
        out += [row] * (2 if r.random() < 0.05 else 1)
    r.shuffle(out)
    return out


def first_match(rows, s, how):
    """The letters of the match at s by plain backtracking: the first in the order in which a regular expression tries."""
    n, cents = len(rows), [None if v is None or math.isnan(v) or abs(v) >= 9e16 else math.floor(v * 100 + 0.5) for *_, v in rows]

    def fits(letter, i):
        if i >= n or cents[i] is None:
            return False
        if letter == "A":
            return True
        if cents[i - 1] is None and letter in "DU" or rows[i][0] - rows[i - 1][0] > dt.timedelta(minutes=30):
            return False
        kind = rows[i][2]
        if letter == "P":
            return kind == "click" and cents[i] >= cents[s]
        return kind not in (None, "error") and (cents[i] < cents[i - 1] if letter == "D" else cents[i] > cents[i - 1])

    def spans(letter, i):
        k = i
        while fits(letter, k):
            k += 1
        return k

    def blocks(i, done):
        """Ends of (D+ U+)+ from i on, by preference."""
        falls = spans("D", i)
        for d in range(falls, i, -1):
            rises = spans("U", d)
            for u in range(d + 1, rises + 1) if how == patterns.RELUCTANT else range(rises, d, -1):
                letters = done + "D" * (d - i) + "U" * (u - d)
                if how == patterns.RELUCTANT:
                    yield u, letters
                    yield from blocks(u, letters)
                else:
                    yield from blocks(u, letters)
                    yield u, letters

    if not fits("A", s):
        return None
    for u, letters in blocks(s + 1, "A"):
        if fits("P", u):
            return letters + "P"
        if how == patterns.OPTIONAL:
            return letters
    return None


def plain(items, how):
    out, none = set(), lambda x: (x is not None, x if x is not None else 0)
    real = {(c, t, i, k, "nan" if v is not None and math.isnan(v) else v, p) for c, t, i, k, v, p in items if c is not None and t is not None}
    for c in {x[0] for x in real}:
        rows = [x[1:5] for x in real if x[0] == c]
        rows = [(t, i, k, math.nan if v == "nan" else v) for t, i, k, v in rows]
        rows.sort(key=lambda x: (x[0], none(x[1]), (x[2] is not None, x[2] or ""), (x[3] is not None, math.inf if x[3] is None or math.isnan(x[3]) else x[3])))
        no = 0
        for s in range(len(rows)):
            letters = first_match(rows, s, how)
            if letters:
                no += 1
                part = rows[s : s + len(letters)]
                out.add((c, no, part[0][1], part[-1][1], len(letters), sum(math.floor(x[3] * 100 + 0.5) for x in part), hashlib.sha256(letters.encode()).hexdigest()))
    return out


@pytest.fixture
def narrow(spark):
    """Many small ranges and batches, so that chains run over several of both."""
    names = {"spark.sql.shuffle.partitions": "11", "spark.sql.execution.arrow.maxRecordsPerBatch": "5"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("how", [patterns.OPTIONAL, patterns.GREEDY, patterns.RELUCTANT])
@pytest.mark.parametrize("quiet", [0.04, 0.001])
def test_against_backtracking(spark, narrow, monkeypatch, how, quiet):
    monkeypatch.setattr(patterns, "FAN", 3)
    items = clicks(11, 500, quiet=quiet)
    got = patterns.match_rows(spark.createDataFrame(items, SCHEMA), how=how).collect()
    assert {tuple(r) for r in got} == plain(items, how) and len(got) == len({tuple(r) for r in got}) > 20


def test_one_chain_over_all_ranges(spark, narrow, monkeypatch):
    """A client whose rows never break: each start's match goes on to the last rise."""
    monkeypatch.setattr(patterns, "FAN", 4)
    items = [(5, START + dt.timedelta(seconds=k), k, "click", float(k % 2 + k % 3), None) for k in range(400)]
    items = [x for x in items if x[4] != 1.0 or x[2] % 6]
    df = spark.createDataFrame(items, SCHEMA)
    for how in (patterns.OPTIONAL, patterns.RELUCTANT):
        assert {tuple(r) for r in patterns.match_rows(df, how=how).collect()} == plain(items, how)


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert patterns.query(df).count() == 0
    nulls = spark.createDataFrame([(None, START, 1, "click", 1.0, None), (1, None, 2, "click", 1.0, None), (1, START, 3, None, None, None)], SCHEMA)
    assert patterns.query(nulls).count() == 0
    items = clicks(2, 150)
    df = spark.createDataFrame(items, SCHEMA).withColumns({k: F.lit(1) for k in ("key", "no", "part", "k", "flags", "rest", "cents", "lead", "before")})
    assert {tuple(r) for r in patterns.query(df).collect()} == plain(items, patterns.OPTIONAL)


def test_scan_answers():
    """The last goal that reaches a value, and the next one, by records and stack."""
    #         A    D    U    D    U    D    U    .
    label = [0, 68, 85, 68, 85, 68, 85, 0]
    cents = [50, 10, 60, 20, 90, 30, 55, 40]
    goal = [False, True, True, True, True, True, True, True]
    ends = lambda how: dict((s, (e, p)) for s, e, p in patterns.scan(label, goal, cents, 0, 6, how))
    assert ends(patterns.OPTIONAL) == {0: (6, False), 2: (6, False), 4: (6, False)}
    assert ends(patterns.GREEDY) == {}
    cents[7] = 60
    assert ends(patterns.OPTIONAL) == {0: (7, True), 2: (7, True), 4: (6, False)}
    assert ends(patterns.GREEDY) == {0: (7, True), 2: (7, True)}
    cents[3] = 55
    assert ends(patterns.RELUCTANT) == {0: (3, True), 2: (7, True)}


def test_query_against_sql(spark):
    from tests import duck

    duck.same(patterns.query(spark.read.parquet(f"{duck.DATA}/clicks.parquet")), patterns.SQL)
