import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from clauselake.llm import lm
from tests.llm.conftest import rows


def tokens(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


class Plain:
    """The model by its definition, on lists of tokens."""

    def __init__(self, train):
        self.one, self.two, self.tri = Counter(), Counter(), Counter()
        self.c1, self.k = Counter(), Counter()
        for x in train:
            self.one.update(x)
            self.two.update(zip(["<s>", *x], x, strict=False))
            self.c1.update(["<s>", *x[:-1]])
            self.tri.update(zip(["<s>", *x], x, x[1:], strict=False))
        self.tri = Counter({g: c for g, c in self.tri.items() if c >= lm.LEAST_TRIGRAM})
        for (u, v, _), c in self.tri.items():
            self.k[u, v] += c
        self.n, self.v = sum(self.one.values()), len(self.one)
        n1 = sum(c == 1 for c in self.one.values())
        self.unseen = min(0.5, max(n1 / self.n, 0.5 / (self.n + 0.5 * (self.v + 1))))
        order = lambda c: int(math.log2(c))
        bins = lambda r: 0 if r == 0 else int(min(max((math.log10(r) - lm.LEAST) / lm.STEP, 0), lm.BINS - 2)) + 1
        for level in (2, 3):
            counts = np.zeros((lm.ORDERS, lm.BINS))
            for x in train:
                for i, w in enumerate(x):
                    v = x[i - 1] if i else "<s>"
                    c0, c1, c2 = self.one[w] - 1, self.c1[v] - 1, self.two[v, w] - 1
                    p1 = (1 - self.unseen) * c0 / (self.n - 1) if c0 > 0 else self.unseen
                    if level == 2:
                        hits, seen, lower = c2, c1, p1
                    elif i:
                        u = x[i - 2] if i > 1 else "<s>"
                        own = self.tri[u, v, w]
                        hits, seen = max(own - 1, 0), self.k[u, v] - (own > 0)
                        s = self.m[order(self.c1[v])]
                        lower = s * c2 / max(c1, 1) + (1 - s) * p1
                    else:
                        continue
                    if seen > 0:
                        counts[order(seen), bins(hits / seen / lower)] += 1
            if level == 2:
                self.m = lm.shares_of(counts.ravel())
            else:
                self.l = lm.shares_of(counts.ravel())

    def log10(self, u, v, w):
        order = lambda c: int(math.log2(c))
        p = (1 - self.unseen) * self.one[w] / self.n if self.one[w] else self.unseen
        if self.c1[v]:
            s = self.m[order(self.c1[v])]
            p = s * self.two[v, w] / self.c1[v] + (1 - s) * p
        if self.k[u, v]:
            s = self.l[order(self.k[u, v])]
            p = s * self.tri[u, v, w] / self.k[u, v] + (1 - s) * p
        return math.log10(p)

    def score(self, x):
        y = [None, "<s>", *x]
        return sum(self.log10(y[i - 2] if i > 2 else 0, y[i - 1], y[i]) for i in range(2, len(y)))


def check(found, items):
    plain = Plain([tokens(t) for i, t in items if not held(i)])
    got = defaultdict(list)
    for r in found:
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(items)
    better = []
    for i, t in items:
        x = tokens(t)
        r = got[i][0]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(x), sum(w in plain.one for w in x), plain.n)
        assert r["base_score"] == pytest.approx(sum(math.log10((plain.one[w] + 0.5) / (plain.n + 0.5 * (plain.v + 1))) for w in x), abs=1e-6)
        assert any(s["score"] == pytest.approx(plain.score(x), abs=1e-6) for s in got[i]), i
        better.append(r["score"] >= r["base_score"])
    assert np.mean(better) > 0.8


def test_scores_against_a_plain_model(docs, empty):
    check(lm.query(docs).collect(), [(i, t) for i, t, *_ in rows()])
    assert lm.query(empty).count() == 0


def test_messages_by_levels(docs, monkeypatch):
    """The same scores where messages are added up twice on their way to the buckets; no asker sends more than it may."""
    monkeypatch.setattr(lm, "MOST_FAN", 3)
    monkeypatch.setattr(lm, "BUCKET_KEYS", 200)
    assert lm.division(docs.sparkSession, 5000) == (3, 3)
    check(lm.query(docs.repartition(7)).collect(), [(i, t) for i, t, *_ in rows()])
    encoded = lm.encode(docs, "doc_id", "text", 5, 1)
    assert lm.ask(encoded, 3).groupBy("asker").count().agg({"count": "max"}).first()[0] <= 3


def automaton(texts, shares2=0.4, shares3=0.6):
    hashes = lm.Hashes()
    b = lm.Block.of(texts, np.zeros(len(texts), bool), hashes)
    one, two = b.counts()
    a = lm.Automaton(b, one, two, None, int(one.sum()), 0.1)
    t = b.trigrams(a.c2)
    found, _ = lm.leaf_trigrams([[lm.Sheet(t.hi, t.n, t.low, t.count)]])
    return lm.Automaton(b, one, two, found[0][0], int(one.sum()), 0.1, np.full(64, shares2), np.full(64, shares3))


def test_arcs_and_failure_arcs():
    """Every state's arcs and what its failure arc leads to together have probability 1."""
    a = automaton([b"a b a c a b", b"b a b b a b a c", b"c c a b a", b""])
    n = len(a.block.words)
    assert len(a.fail) > n + 2  # pairs are states

    def probability(state, word):
        out = 0.0
        while True:
            if state == 0:
                return 10 ** (out + a.root_weight[word])
            k = np.searchsorted(a.arc, state * n + word)
            if k < len(a.arc) and a.arc[k] == state * n + word:
                return 10 ** (out + a.arc_weight[k])
            out, state = out + a.fail_weight[state], a.fail[state]

    reached = {0, a.start, *a.arc_to.tolist(), *a.root_to.tolist()}
    for state in reached:
        unseen, s = 0.1, state
        while s:
            unseen, s = unseen * 10 ** a.fail_weight[s], a.fail[s]
        assert sum(probability(state, w) for w in range(n)) + unseen == pytest.approx(1), state


def test_lanes(monkeypatch):
    """However texts are cut into lanes, their weights are the same."""
    import random

    r = random.Random(3)
    texts = [" ".join(r.choice("abcd") for _ in range(k)).encode() for k in (0, 1, 2, 3, 50, 400)]
    a = automaton(texts)
    whole = a.traverse()
    for lane in (2, 3, 7, 100):
        monkeypatch.setattr(lm, "LANE", lane)
        assert np.allclose(a.traverse(), whole)


def test_pack():
    x = [np.arange(5, dtype=np.uint64), np.array([], np.int32), np.array([1.5, -2.0])]
    assert all(np.array_equal(a, b) for a, b in zip(lm.unpack(lm.pack(*x)), x, strict=True))
    b = lm.Block.of([b"x y z x y", b"q"], np.array([False, True]), lm.Hashes())
    c = lm.Block.unpacked(b.packed())
    assert np.array_equal(b.pairs, c.pairs) and np.array_equal(b.stream, c.stream)


def test_distinct():
    r = np.random.default_rng(2)
    for high in (5, 1 << 30, 1 << 62):
        x = r.integers(0, high, 1000)
        got, want = lm.distinct(x), np.unique(x, return_inverse=True)
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def test_memory_of_a_block():
    """A block's automaton takes no more than a bounded number of bytes a token at its peak, and keeps none of what only
    its making needs."""
    import random
    import tracemalloc

    r = random.Random(3)
    words = [b"w%d" % i for i in range(3000)]
    texts = [b" ".join(r.choices(words, weights=range(len(words), 0, -1), k=400)) for _ in range(250)]
    b = lm.Block.of(texts, np.zeros(len(texts), bool), lm.Hashes())
    one, two = b.counts()
    t = b.trigrams(lm._by_pair(b, two))
    three = lm.leaf_trigrams([[lm.Sheet(t.hi, t.n, t.low, t.count)]])[0][0][0]
    data, tokens = b.packed(), len(b.stream)
    del b, t
    tracemalloc.start()
    try:
        a = lm.Automaton(lm.Block.unpacked(data), one, two, three, int(one.sum()), 0.1, np.full(64, 0.4), np.full(64, 0.6))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 160 * tokens
    assert not hasattr(a.block, "codes") and not hasattr(a, "tri")
