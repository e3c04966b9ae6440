import datetime as dt
import random

from clauselake.streaming import quotas

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "user_id string, ts timestamp, event_id long, value double"


def events(seed=3, n=1500):
    """A busy client, quiet ones, ties, huge requests, nulls."""
    r, out, at = random.Random(seed), [], START
    for i in range(n):
        burst = i % 300 < 120  # many small requests, then fewer large ones
        at += dt.timedelta(seconds=r.choice([0, 0.5, 1]) if burst else r.choice([2, 20, 60]))
        out.append((r.choice(["a", "a", "a", "b", "c", None]), at if r.random() > 0.01 else None, i, r.choice([1.0, 10.0, None, -5.0] if burst else [300.0, 4000.0, 7000.0, 9000.0])))
    return out


def plain(items):
    """All accepted requests are looked through for every request."""
    held, out = {}, []
    for user, at, i, tokens in sorted((x for x in items if x[0] is not None and x[1] is not None), key=lambda x: (x[1], x[2])):
        tokens = max(tokens or 0.0, 0.0)
        own = held.setdefault(user, [])
        refused = None
        for what, seconds, most in quotas.QUOTAS:
            inside = [t for a, t in own if at - a < dt.timedelta(seconds=seconds)]
            used = len(inside) + 1 if what == "requests" else sum(inside) + tokens
            if used > most:
                refused = f"{what}/{seconds}s"
                break
        if refused is None:
            own.append((at, tokens))
        out.append((user, i, refused is None, refused))
    return sorted(out)


def answers(df):
    return sorted((r["client"], r["ord"], r["allowed"], r["refused_by"]) for r in df.collect())


def test_table_against_plain(spark):
    got = quotas.quotas(spark.createDataFrame(events(), SCHEMA))
    want = plain(events())
    assert answers(got) == want
    assert {w[3] for w in want} >= {None, "requests/60s", "tokens/60s", "tokens/86400s"}
    assert quotas.quotas(spark.createDataFrame([], SCHEMA)).count() == 0


def test_refusals_use_nothing_and_say_when_to_come_back():
    led = quotas.Ledger(quotas=(("tokens", 60, 100),))
    assert led.request(0, 90.0)[0]
    assert led.request(1_000_000, 20.0) == (False, "tokens/60s", 59.0)
    assert led.request(2_000_000, 10.0)[0]  # the refused one has used nothing
    assert led.request(3_000_000, 101.0)[2] == float("inf")
    assert led.request(60_000_000, 90.0)[0]


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    items = sorted((x for x in events(n=240) if x[1] is not None), key=lambda x: (x[1], x[2]))
    # ledgers that time out would have a query without new rows run on
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    source, checkpoint, sink = (str(tmp_path / k) for k in ("in", "checkpoint", "out"))
    for at in (0, 80, 160):  # one start for each part, on one checkpoint
        spark.createDataFrame(items[at : at + 80], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        q = quotas.quota_stream(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        assert q.exception() is None
    assert answers(spark.read.parquet(sink)) == plain(items)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
