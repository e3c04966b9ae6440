import gzip
import hashlib
import io
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from clauselake.llm import warc

PAGES = [(1, "http://a/1", "x" * 1200), (2, "http://a/2", "x" * 1200), (2, "http://a/2", "x" * 1200), (3, None, None), (4, "http://a\r\nb", ""), (5, "u", "é" * 600), (6, "u", "é" * 600), (7, "u", "y" * 999), (8, "u", "y" * 999), (None, "n", "x" * 1200), (9, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40), (10, "u", "z" * 3_000_000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("record_type", F.lit("x")).repartition(3)


def test_query(spark, pages):
    top = defaultdict(lambda: -1)
    for i, _, h in PAGES:
        if i is not None:
            top[h or ""] = max(top[h or ""], i)
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        again = len(b) >= 1000 and i != top[h or ""]
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top[h or ""] if again else None))
    assert sorted(map(tuple, warc.query(pages).collect()), key=str) == sorted(want, key=str)
    assert warc.query(pages.where("false")).count() == 0


@pytest.mark.parametrize("packed", ["true", "false"])
def test_source(spark, pages, tmp_path, packed):
    warc.register(spark)
    path = f"file://{tmp_path}/w"
    warc.page_records(pages).write.format("warc").option("compress", packed).option("fileBytes", 5000).mode("append").save(path)
    read = spark.read.format("warc").option("partitionBytes", 6000).load(path)
    assert read.rdd.getNumPartitions() > 1
    got = read.where("record_type = 'revisit' AND refers_to IS NOT NULL")
    assert "PushedFilters" in (plan := got._jdf.queryExecution().explainString(got._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))) or "record_type" in plan
    assert got.count() == 3
    assert read.where("record_type <> 'revisit'").count() == len(PAGES) - 3
    assert read.where("record_id IN ('<urn:page:5>', '<urn:page:7>')").count() == 2
    assert read.where("target_uri LIKE 'http://a/%'").count() == 3
    bare = spark.read.format("warc").option("payload", "false").load(path)
    assert bare.where("payload IS NOT NULL").count() == 0 and bare.count() == len(PAGES)
    total = sum(len((h or "").encode()) for _, _, h in PAGES)
    assert bare.agg(F.sum("payload_bytes")).first()[0] == total
    warc.page_records(pages).write.format("warc").mode("overwrite").save(path)
    assert spark.read.format("warc").load(path).count() == len(PAGES)


class Counting(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.n, self.bytes = len(data), 0

    def size(self):
        return self.n

    def read(self, n=-1):
        out = super().read(n)
        self.bytes += len(out)
        return out


def test_unwanted_payloads_are_not_read():
    data = b"".join(warc.gzip_member(warc.record({"WARC-Type": k, "WARC-Record-ID": f"<{i}>"}, random.Random(i).randbytes(200_000))) for i, k in enumerate(["response", "request", "response"]))
    assert len(gzip.decompress(data)) > 600_000  # members are ordinary gzip
    f = Counting(data)
    found = list(warc.records(f, lambda h: h["warc-type"] == "request", True))
    assert len(found) == 1 and len(found[0][1]) == 200_000
    assert f.bytes < 0.6 * len(data)
    plain = b"".join(gzip.compress(warc.record({"WARC-Type": "response"}, b"a" * n)) for n in (0, 5, 70_000))
    assert [len(b) for _, b in warc.records(Counting(plain), lambda h: True, True)] == [0, 5, 70_000]
    raw = b"".join(warc.record({"WARC-Type": "response"}, b"a" * n) for n in (0, 5, 70_000))
    assert [len(b) for _, b in warc.records(Counting(raw), lambda h: True, True)] == [0, 5, 70_000]


def test_long_payloads_take_linear_time():
    import time

    body = random.Random(1).randbytes(1 << 20) * 100
    for packed in (warc.gzip_member, gzip.compress):
        data = packed(warc.record({"WARC-Type": "response"}, body))
        began = time.time()
        ((_, got),) = warc.records(Counting(data), lambda h: True, True)
        assert got == body and time.time() - began < 10


def test_lengths_beyond_32_bits(monkeypatch):
    """A record too long for the extra field goes without it, and is passed over by inflating it."""
    monkeypatch.setattr(warc, "_LONGEST", 50_000)
    data = b"".join(warc.gzip_member(warc.record({"WARC-Type": k}, random.Random(n).randbytes(n))) for k, n in (("a", 10), ("b", 90_000), ("c", 20)))
    assert [(h["warc-type"], len(b)) for h, b in warc.records(Counting(data), lambda h: h["warc-type"] != "b", True)] == [("a", 10), ("c", 20)]
    assert len(next(b for h, b in warc.records(Counting(data), lambda h: h["warc-type"] == "b", True))) == 90_000


@pytest.mark.parametrize("kind", ["sized", "gzip", "plain"])
def test_parts_of_a_file(kind):
    """However a file is cut, each record is read once, in the part that it begins in."""
    r = random.Random(3)
    pack = {"sized": warc.gzip_member, "gzip": gzip.compress, "plain": bytes}[kind]
    data = b"".join(pack(warc.record({"WARC-Type": "response", "WARC-Record-ID": str(i)}, r.randbytes(r.randrange(0, 3000)))) for i in range(60))
    for step in (1, 37, 1000, 5000, len(data) + 1) if kind != "gzip" else (611, 5000):
        if step == 1:
            cuts = list(range(0, 400)) + [400]
        else:
            cuts = list(range(0, len(data), step))
        ends = [*cuts[1:], None]
        got = [int(h["warc-record-id"]) for a, b in zip(cuts, ends, strict=True) for h, _ in warc.records(Counting(data), lambda h: True, False, a, b)]
        assert got == list(range(60)), (kind, step)


def test_split_option(spark, pages, tmp_path):
    warc.register(spark)
    path = f"file://{tmp_path}/w"
    warc.page_records(pages).coalesce(1).write.format("warc").mode("append").save(path)
    read = spark.read.format("warc").option("partitionBytes", 2000).option("splitBytes", 2000).load(path)
    assert read.rdd.getNumPartitions() > 1
    assert sorted(r["record_id"] for r in read.collect()) == sorted(r["record_id"] for r in spark.read.format("warc").load(path).collect())
