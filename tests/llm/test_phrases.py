import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauselake.llm import phrases
from tests.llm.conftest import SCHEMA, rows


def plain(items, least, top=2000, longest=5):
    """Rows (lang, text) to the expected result, by counting all windows."""
    f, n = Counter(), Counter()
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in items:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(fold)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {p: c for p, c in f.items() if c >= least}
    within = set()
    for (lang, p), c in often.items():
        for k in range(2, len(p)):
            within |= {(lang, p[i : i + k]) for i in range(len(p) - k + 1) if often[lang, p[i : i + k]] <= c}
    out = {}
    for (lang, p), a in often.items():
        if len(p) > 1 and (lang, p) not in within:
            score, cut = min((1000 * a * n[lang] // (often[lang, p[:k]] * often[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), often[lang, p[:cut]], often[lang, p[cut:]]))
    return {(lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)}


def corpus(seed=4, n=300):
    r = random.Random(seed)
    vocab = [a + b for a in ("a", "B", "ß", "É", "x\x1cy", " ") for b in ("", "1", "z")]
    fixed = ["the quick brown fox jumps over", "new york city", "A B A B A B A", "né à paris"]
    out = [(None, "new york city hall"), ("en", None), ("en", ""), ("", "new  york\tcity"), ("fr", " .,;:!?\n\x0b\x0c\r ")]
    for _ in range(n):
        parts = [r.choice(fixed) if r.random() < 0.4 else r.choice(vocab) for _ in range(r.randrange(1, 25))]
        out.append((r.choice(["en", "en", "en", "de", None]), "".join(p + r.choice([" ", " ", " ", "\t", ", ", "\n", ". "]) for p in parts)))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_against_plain(spark, monkeypatch, small):
    """Also where the bitmaps are so full that they let much through, and tasks hand on after each block."""
    if small:
        for name, value in (("FILTER_BITS", 8), ("SEGMENT_BITS", 3), ("OCCURRENCES", 10), ("SPELLED", 5), ("RANK_PARTS", 3)):
            monkeypatch.setattr(phrases, name, value)
    items = corpus()
    df = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(items)], "doc_id long, text string, lang string").repartition(5)
    df = df.withColumns({k: F.lit(1) for k in ("k", "n", "phrase", "key", "bucket")})
    got = [tuple(r) for r in phrases.collocations(df, least=7, top=40).collect()]
    want = plain(items, 7, 40)
    assert set(got) == want and len(got) == len(want) > 60


def test_fixture(docs, empty):
    got = {tuple(r) for r in phrases.collocations(docs, least=4).collect()}
    assert got == plain([(r[2], r[1]) for r in rows()], 4) and got
    assert phrases.query(empty).count() == 0


def test_words_and_lists():
    assert phrases.words([b"A,b c", b"", b"d\te"]) == [b"a", b"\xff", b"b", b"c", b"\xff", b"\xff", b"d", b"e"]
    at, key = np.array([0, 1, 4]), np.array([1, 2, 3], np.uint64)
    found, _ = phrases.extended(at, key, 1, at, key)
    assert found.tolist() == [0]
    assert not len(phrases.extended(at, key, 1, at[:0], key[:0])[0])


def test_products_beyond_64_bits(spark):
    """The score's arithmetic, with counts as a large corpus has them."""
    a, n, f = 3_000_000_000_000, 40_000_000_000_000, 3_100_000_000_000
    df = spark.createDataFrame([(a, n, f, f + 1)], "a long, n long, l long, r long")
    whole = lambda c, d: F.col(c).cast(f"decimal({d},0)")
    df = df.withColumns({"over": whole("a", 19) * whole("n", 18) * F.lit(1000).cast("decimal(4,0)"), "under": whole("l", 19) * whole("r", 18)})
    assert df.select(F.expr("over div under")).first()[0] == 1000 * a * n // (f * (f + 1))
