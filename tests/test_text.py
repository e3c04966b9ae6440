import json
import random

import pytest
from pyspark.sql import functions as F

from clauselake.functions import chunking, text
from clauselake.operators import extract, learn
from clauselake.sources import files, html, tables


def headed(*parts):
    return "\n".join(parts)


def test_sections():
    assert chunking.sections("no header here") == [("", "no header here")]
    t = "short\nARTICLE I Terms of it\nbody one\nSECTION 2 more\nbody two\n"
    got = chunking.sections(t)
    assert [h for h, _ in got] == ["ARTICLE I", "SECTION 2"] and got[0][1].startswith("Terms")
    assert chunking.sections("p" * 60 + "\n1. First thing\n")[0][0] == "PREAMBLE"


def test_subsplit():
    assert chunking.subsplit(" x ") == [" x "]
    two = "a" * 900 + "\n\n" + "b" * 900
    assert chunking.subsplit(two) == ["a" * 900, "b" * 900]
    long = "; ".join("word " * 30 for _ in range(20))
    got = chunking.subsplit(long)
    assert len(got) > 3 and all(50 <= len(x) <= 800 + 160 for x in got)
    assert chunking.subsplit("c" * 2000) == ["c" * 2000]
    assert chunking.subsplit("d" * 1600 + "\n\nshort") == ["d" * 1600]


def test_document_sections_keep_every_word():
    r = random.Random(3)
    for _ in range(200):
        parts = []
        for _ in range(r.randrange(1, 9)):
            parts.append(r.choice(["ARTICLE IV\n", "1.2 Payment terms here\n", "LIMITATION OF LIABILITY.\n", ""]) + " ".join(f"w{r.randrange(99)}" for _ in range(r.randrange(0, 120))) + r.choice(["", "\n\n"]))
        body = "\n".join(parts)
        got = chunking.document_sections(body, 40, 50)
        assert " ".join(t for _, t in got).split() == body.split()
    assert chunking.document_sections("plain words") == [("", "plain words")]
    big = chunking.document_sections("ARTICLE I\n" + "w " * 179, 40, 50)
    assert len(big) == 4 and big[0][0].endswith("(part 1)")
    first = chunking.document_sections("few words\nARTICLE I\n" + "w " * 60, 40, 1000)
    assert len(first) == 1 and first[0][0].startswith("ARTICLE I") and first[0][1].startswith("few words")


def test_chunk_operator(spark):
    df = spark.createDataFrame([(1, "ARTICLE I\nThe liability of the company is limited to damages paid."), (2, None), (3, "")], "doc_id long, text string")
    got = chunking.chunk_contracts(df).collect()
    assert {(r["doc_id"], r["clause_type"]) for r in got} == {(1, "liability"), (3, "other")}


def test_labels_match_expression(spark):
    lines = ["3.1 Payment Terms", "Article I. The parties agree. " + "x" * 60, "y" * 80, "  ", "See (a). " + "z " * 40]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [r[0] for r in df.select(text.label(F.col("line"))).collect()] == [chunking.label(x) for x in lines]


def test_context_and_types(spark):
    df = spark.createDataFrame([("a" * 10 + "KEY" + "b" * 10,)], "t string")
    assert df.select(text.context(F.col("t"), F.lit(10), F.lit(13), 4)).first()[0] == "...aaaaKEYbbbb..."
    assert df.select(text.context(F.col("t"), F.lit(10), F.lit(13), 40)).first()[0] == "a" * 10 + "KEY" + "b" * 10


def test_json_of():
    assert extract.json_of('{"a": 1}') == {"a": 1}
    assert extract.json_of('Sure:\n```json\n{"a": {"b": 2}}\n```') == {"a": {"b": 2}}
    assert extract.json_of('x {"a": {"b": 2}} y }') == {"a": {"b": 2}}
    assert extract.json_of("no") is None and extract.json_of(None) is None and extract.json_of("[1]") is None


def test_extract_with_backend(spark):
    df = spark.createDataFrame([(1, "the fee is 5"), (2, "boom"), (3, None)], "chunk_id long, clause string")

    def backend(clause):
        if clause == "boom":
            raise RuntimeError
        return json.dumps({"fee": 5, "fee_source_text": "the fee is 5", "other": 1})

    got = {r["chunk_id"]: r for r in extract.extract_with(df, backend, {"fee", "fee_source_text"}).collect()}
    assert json.loads(got[1]["data"]) == {"fee": 5, "fee_source_text": "the fee is 5"}
    assert not got[2]["ok"] and json.loads(got[3]["data"])["fee_source_text"] is None


def test_rule_extraction_quotes(spark):
    df = spark.createDataFrame([("First. This is governed by the laws of Ohio. Last.",), (None,)], "clause string")
    a, b = extract.extract_fields(df, "governing_law").collect()
    assert a["has_governing_law"] and a["has_governing_law_source_text"] == "This is governed by the laws of Ohio."
    assert not b["has_governing_law"] and b["has_governing_law_source_text"] is None


def test_html():
    assert html.to_text("<p>a&amp;b</p><script>x<y</script><div>c  d</div>\n\n\n<br>e") == "a&b\n\nc d\n\ne"
    assert html.to_text("a<br/>b<br>c") == "a\nb\nc"
    assert html.to_text("<ul><li/>x</ul>y<p/>z") == "xy\n\nz"
    assert html.to_text(None) is None and html.to_text("") == ""


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("text a")
    (tmp_path / "m.json").write_text(json.dumps([{"filename": "a.txt", "contract_id": "1"}, {"filename": "gone.txt", "contract_id": "2"}]))
    assert [(r["contract_id"], r["text"]) for r in files.manifest_texts(spark, f"file://{tmp_path}/m.json", f"file://{tmp_path}/t").collect()] == [("1", "text a")]
    rows = spark.createDataFrame([(1, "x"), (2, None)], "a long, b string")
    files.write_jsonl(rows, f"file://{tmp_path}/j")
    assert sorted(map(tuple, files.read_jsonl(spark, f"file://{tmp_path}/j", "a long, b string").collect())) == [(1, "x"), (2, None)]
    assert [json.loads(r[0])["a"] for r in files.as_json(rows).collect()] == [1, 2]
    made = []
    for _ in range(2):
        files.cached(spark, f"file://{tmp_path}/c", lambda: made.append(1) or rows)
    assert made == [1]
    b = spark.createDataFrame([("p", bytearray(b"scan")), ("q", bytearray(b"t" * 60))], "path string, content binary")
    got = {r["path"]: r for r in files.document_texts(b, lambda c: c.decode() if len(c) > 50 else "", lambda c: "read by ocr").collect()}
    assert got["p"]["method"] == "ocr" and got["q"]["method"] == "text"
    u = spark.createDataFrame([(bytearray("é".encode()),), (bytearray("é".encode("latin-1")),)], "c binary")
    assert [r[0] for r in u.select(tables.decoded(F.col("c"))).collect()] == ["é", "é"]


def test_paged_search(spark, tmp_path):
    for name, hits in (("0-0", [{"id": "a:1", "file_type": "EX-10"}, {"id": "b:2"}]), ("0-2", [{"id": "c:3"}]), ("0-3", []), ("1-0", [])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"hits": hits}))
    spark.dataSource.register(files.PagedSearch)
    got = spark.read.format("paged_search").option("queries", json.dumps(["q0", "q1"])).load(str(tmp_path))
    assert sorted((r["query_ord"], r["rank"], r["hit_id"]) for r in got.collect()) == [(0, 0, "a:1"), (0, 1, "b:2"), (0, 2, "c:3")]


def test_polite():
    waits, calls = [], []

    def fetch(q, s):
        calls.append(q)
        if len(calls) < 3:
            raise OSError
        return {"hits": []}

    assert files.polite(fetch, 0.5, 3, waits.append, lambda: 0.0)("q", 0) == {"hits": []}
    assert waits == [1.0, 0.5, 2.0, 0.5]
    with pytest.raises(OSError):
        files.polite(lambda q, s: (_ for _ in ()).throw(OSError()), 0.0, 2, waits.append)("q", 0)


def test_upsert_and_patch(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string")
    new = spark.createDataFrame([(2, "B", 1), (2, "C", 2), (3, "d", 1), (None, "N", 1)], "k long, v string, ver long")
    assert sorted(map(str, map(tuple, tables.upsert(old, new, ["k"], "ver").collect()))) == sorted(map(str, [(1, "a"), (2, "C"), (3, "d"), (None, "N")]))
    empty = old.where("false")
    assert tables.upsert(empty, empty, ["k"]).count() == 0


def test_learning(spark):
    rows = spark.createDataFrame([(i, "good words here" if i % 2 else "bad things there", i % 2) for i in range(60)], "id long, text string, y int")
    e = learn.embed(rows, learn.hashing_encoder(16))
    model = learn.train_classifier(e, "y", (1.0,), 2)
    assert model.avgMetrics[0] > 0.95
    half = e.withColumn("embedding", F.when(F.col("id") % 3 == 0, F.col("embedding")))
    assert learn.backfill(half, learn.hashing_encoder(16)).where("embedding IS NULL").count() == 0
    s = learn.stratified_split(rows, "id", "y", 0.2)
    assert {(r["y"], r["n"]) for r in s.where("held_out").groupBy("y").agg(F.count("*").alias("n")).collect()} == {(0, 6), (1, 6)}


def test_top_keywords_of_ids_that_repeat_and_without_words_in_shuffles(spark):
    """All rows of an id are one document, null ids too; where no id repeats, no shuffle carries words."""
    from clauselake.operators import learn

    rows = [(1, "Tree stone tree, the the the water"), (2, None), (3, "stone"), (3, "tree tree"), (None, "owl"), (None, "owl cat cat cat")]
    found = learn.top_keywords(spark.createDataFrame(rows, "doc_id long, text string"), ("the",), 2).collect()
    got = sorted(((r["doc_id"] or 0, r["rank"], r["word"], r["n"]) for r in found))
    assert got == [(0, 1, "cat", 3), (0, 2, "owl", 2), (1, 1, "tree", 2), (1, 2, "stone", 1), (3, 1, "tree", 2), (3, 2, "stone", 1)]
    plan = learn.top_keywords(spark.createDataFrame(rows[:3], "doc_id long, text string"), ("the",), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_cleaning_and_cuts_at_odd_white_space(spark):
    """A single space is no match of the cleaning pattern; runs, and cuts behind an end, are those of the plain patterns."""
    import random
    import re

    from pyspark.sql import functions as F

    from clauselake.functions import text

    draw = random.Random(3)
    texts = ["".join(draw.choice([" ", " ", "\t", "\n", "\r", ".", "!", "A", "b", "Mr", "xMr", "No", "i.e", "\u00a0", "9", '"']) for _ in range(40)) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.clean_text(F.col("t")).alias("c"), text.sentences(F.col("t")).alias("s")).collect()
    short = r"\b(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|vs|etc|i\.e|e\.g|Inc|Ltd|Corp|Co|No|Sec|Art)\."
    for r in got:
        clean = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", re.sub(r"\r\n|\r", "\n", r["t"]))).strip()
        cut = [x.replace("\x01", ".").strip() for x in re.split(r'(?<=[.!?])\s+(?=[A-Z0-9"])', re.sub(short, "\\1\x01", r["t"]))]
        assert r["c"] == clean and r["s"] == [x for x in cut if x], r["t"]
    assert not re.search(text._SPACES, "a b c") and re.search(text._SPACES, "a  b") and re.search(text._SPACES, "a\tb")
