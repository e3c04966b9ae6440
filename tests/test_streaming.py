import pandas as pd

from clauselake.plans import fixtures
from clauselake.streaming import state


def test_breaker_sequence():
    b = state.Breaker()
    for t in range(5):
        assert b.call(t, False)[0]
    assert b.state == "open"
    assert b.call(14, True) == (False, 20.0)
    assert b.call(34, True) == (True, 0.0) and b.state == "closed" and b.failures == 0


def test_breaker_on_a_stream(spark, tmp_path):
    calls = fixtures.CALLS.df(spark)
    want = sorted(map(tuple, state.breaker_states(calls).collect()))
    for k, (a, b) in enumerate(((0, 7), (7, 12), (12, 99))):
        pd.DataFrame([r for r in fixtures.CALLS.rows if a <= r[0] < b], columns=["ord", "at", "dependency", "ok"]).to_json(tmp_path / f"{k}.json", orient="records", lines=True)
    stream = spark.readStream.schema(fixtures.CALLS.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    q = state.breaker_stream(stream).writeStream.format("memory").queryName("breaker").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM breaker").collect())) == want


def test_event_rates_on_a_stream(spark):
    path = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{path}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(path)
    q = state.event_rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = state.event_rates(spark.read.parquet(f"{path}/events.parquet"))
    assert spark.sql("SELECT sum(n) FROM rates").first()[0] == batch.agg({"n": "sum"}).first()[0]
    assert spark.table("rates").count() == batch.count()
