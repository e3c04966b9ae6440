import random
from itertools import combinations
from math import comb

import numpy as np
import pytest

from clauselake.llm import setjoin
from clauselake.llm.batches import WordHashes, hashed
from clauselake.llm.minhash import shingles
from tests.llm.conftest import SCHEMA, rows
from tests.llm.test_minhash import brute


def test_fixture(docs, empty):
    found = setjoin.query(docs).collect()
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None}
    assert got == brute({r[0]: r[1] for r in rows() if r[0] is not None}.items(), 3, 90)
    assert len(found) == len(rows())
    assert setjoin.query(empty).count() == 0


def items(seed=2):
    """Groups of near copies of all sizes, small sets of few words, and a passage that many texts share."""
    r = random.Random(seed)
    vocab, few = [f"w{k}" for k in range(4000)], list("abcde")
    passage = " ".join(r.choice(vocab) for _ in range(30))
    out = []
    for size in (5, 9, 12, 13, 21, 24, 33, 60, 150):
        base = [r.choice(vocab) for _ in range(size)]
        for _ in range(20):
            words = list(base)
            for _ in range(r.randrange(0, max(2, size // 40 + 1))):
                words[r.randrange(len(words))] = r.choice(vocab)
            out.append(" ".join(words + [r.choice(vocab)] * (r.random() < 0.3)))
    out += [" ".join(r.choice(few) for _ in range(r.randrange(1, 15))) for _ in range(150)]
    out += [passage + " " + " ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 40]))) for _ in range(40)]
    return list(enumerate(out))


@pytest.mark.parametrize("most", [None, 0, 25])
def test_against_all_pairs(spark, monkeypatch, most):
    """With the boundary by cost, without light sets, and with many."""
    if most is not None:
        monkeypatch.setattr(setjoin, "boundary", lambda sizes, percent: most)
    monkeypatch.setattr(setjoin, "TABLES", 2)
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in items()], SCHEMA).repartition(5)
    got = {(x["doc_id"], x["n_shingles"], x["component_id"]) for x in setjoin.query(df).collect()}
    assert got == brute(items(), 3, 90)


@pytest.mark.parametrize("part", [None, 40])
def test_families_around_the_threshold(spark, monkeypatch, part):
    """A large family of near copies, of which about as many pairs are linked as not, in one part and in many."""
    if part:
        monkeypatch.setattr(setjoin, "PART_POSTS", part)
    r = random.Random(8)
    base, out = [f"v{k}" for k in range(260)], []
    for k in range(120):
        words = list(base)
        for _ in range(r.choice([2, 4, 5, 6, 9])):
            words[r.randrange(len(words))] = f"x{k}y{r.randrange(10**6)}"
        out.append(" ".join(words[: r.randrange(235, 261)]))
    texts = list(enumerate(out))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], SCHEMA).repartition(5)
    got = {(x["doc_id"], x["n_shingles"], x["component_id"]) for x in setjoin.query(df).collect()}
    want = brute(texts, 3, 90)
    assert got == want
    assert 1 < len({c for _, _, c in want}) < 120


def test_parities_bound_the_difference():
    r, close = np.random.default_rng(6), 0
    for _ in range(2000):
        n, m = int(r.integers(1, 400)), int(r.integers(0, 60))
        pool = np.unique(r.integers(0, 2**63, n + 2 * m)).astype(np.uint64)
        r.shuffle(pool)
        a, b = np.sort(pool[: n + m]), np.sort(np.concatenate([pool[:n], pool[n + m :]]))
        x, y = setjoin.parity(a), setjoin.parity(b)
        size = min(len(x), len(y))
        differ = int(np.bitwise_count(setjoin.folded(x, size) ^ setjoin.folded(y, size)).sum())
        common = len(np.intersect1d(a, b))
        assert differ <= len(a) + len(b) - 2 * common
        may = bool(setjoin.may_link(np.array([differ]), len(a), np.array([len(b)]), 90)[0])
        linked = 100 * common >= 90 * (len(a) + len(b) - common)
        assert may or not linked
        close += may == linked
    assert close > 1900


def test_subsets_meet_if_enough_is_shared():
    r, known = np.random.default_rng(4), {}
    for _ in range(400):
        pool = r.integers(0, 2**63, 26).astype(np.uint64)
        a = np.unique(pool[: r.integers(1, 25)])
        b = np.unique(np.concatenate([a[r.random(len(a)) > 0.05], pool[25 : 25 + r.integers(0, 2)]]))
        if not len(b) or np.array_equal(a, b):
            continue
        common = len(np.intersect1d(a, b))
        near = 100 * common >= 90 * (len(a) + len(b) - common)
        meet = bool(len(np.intersect1d(setjoin.subsets(a, 25, 90, known), setjoin.subsets(b, 25, 90, known))))
        assert meet == near if len(a) != len(b) else meet or not near


def test_linked_sets_have_posted_enough():
    r, ruled_out = np.random.default_rng(5), 0
    for _ in range(3000):
        n = int(r.integers(1, 120))
        pool = np.unique(r.integers(0, 2**63, 2 * n + 8)).astype(np.uint64)
        r.shuffle(pool)
        a, b = pool[:n], np.concatenate([pool[: n - int(r.integers(0, n // 8 + 1))], pool[n : n + int(r.integers(0, n // 16 + 2))]])
        if not len(b):
            continue
        order = lambda x: x[np.argsort(x)][: setjoin.posted(len(x), 90)]  # noqa: E731  any order that all keep to
        common, of_posts = len(np.intersect1d(a, b)), len(np.intersect1d(order(a), order(b)))
        may = bool(setjoin.enough_posted(np.array([of_posts]), len(a), np.array([len(b)]), 90)[0])
        assert may or 100 * common < 90 * (len(a) + len(b) - common)
        ruled_out += not may
    assert ruled_out > 100


def test_linked_sets_are_within_reach_of_their_first_common_element():
    r, ruled_out = np.random.default_rng(7), 0
    for _ in range(3000):
        n, percent = int(r.integers(1, 120)), int(r.choice([80, 90]))
        pool = np.unique(r.integers(0, 2**63, 2 * n + 8)).astype(np.uint64)
        r.shuffle(pool)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[: n - int(r.integers(0, n // 8 + 1))], pool[n : n + int(r.integers(0, n // 16 + 2))]]))
        common = np.intersect1d(a, b)
        if not len(common):
            continue
        i, j = (int(np.searchsorted(x, common[0])) for x in (a, b))
        may = len(b) <= setjoin.reach(n, i, percent) and n <= setjoin.reach(len(b), j, percent)
        assert may or 100 * len(common) < percent * (len(a) + len(b) - len(common))
        ruled_out += not may
    assert ruled_out > 100


@pytest.mark.parametrize("percent", [60, 80, 90, 100])
def test_sets_meet_in_lists_if_they_are_within_reach(spark, percent):
    """All pairs of sizes and places, against the rule for numbers."""
    entries = [(k, n, place, 5) for k, (n, place) in enumerate((n, place) for n in (1, 2, 9, 10, 11, 40, 44, 45, 1000, 1111, 1112) for place in range(0, min(n, 120), 1 + n // 12))]
    met = setjoin._met_at(spark.createDataFrame(entries, "cid long, n long, place int, element long"), percent).collect()
    at, size = {}, {}
    for r in met:
        at.setdefault(r["cid"], set()).add(r["bucket"])
        size[r["cid"]] = (r["size"] >> 32, r["size"] & 0xFFFFFFFF)
    for k, n, place, _ in entries:
        assert k not in size or size[k] == (n, setjoin.reach(n, place, percent))
    for (k, n, i, _), (o, m, j, _) in combinations(entries, 2):
        if m <= setjoin.reach(n, i, percent) and n <= setjoin.reach(m, j, percent):
            assert at[k] & at[o]


def test_sets_of_other_sizes_share_no_list(spark, monkeypatch):
    """Texts that share their rarest element with one that is a quarter longer are not dealt out to be compared."""
    r, members, mixed = random.Random(4), [], setjoin._mixed
    monkeypatch.setattr(setjoin, "_mixed", lambda m, comp: members.append(m.count()) or mixed(m, comp))
    texts = []
    for k in range(12):
        body = " ".join(f"w{r.randrange(10**6)}" for _ in range(int(60 * 1.25**k)))
        texts.append((k, " ".join([body] * 3 + [f"rare{k} p{k} q{k} rare{k + 1} p{k + 1} q{k + 1}"])))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], SCHEMA).repartition(3)
    got = {(x["doc_id"], x["n_shingles"], x["component_id"]) for x in setjoin.query(df).collect()}
    assert got == brute(texts, 3, 90)
    assert members == [0]


def test_hashes_and_sets_are_those_of_the_other_operator():
    words = b"One  two\tone \xc3\xa9 two one two ".split()
    assert hashed(words).tolist() == WordHashes().of(words).tolist()
    for text in (b"", b" ", b"One", b"one TWO", b"a b c d a b c", b"a b c d e a b c d e"):
        assert setjoin._set(text, 3).tolist() == shingles(text, WordHashes(), 3).tolist()


def test_bounds():
    for p in (80, 90):
        for n in range(1, 60):
            for m in range(1, 60):
                fits = [c for c in range(1, min(n, m) + 1) if 100 * c >= p * (n + m - c)]
                assert bool(fits) == (m in setjoin.partners(n, p) and setjoin.overlap(n, m, p) <= min(n, m))
                assert not fits or fits[0] == setjoin.overlap(n, m, p)


def test_boundary_is_the_cheapest():
    long_lists = {n: (1000, 10**9) for n in range(1, 31)}
    assert setjoin.boundary(long_lists, 90) >= 30
    assert setjoin.boundary({n: (1000, 1000) for n in range(1, 31)}, 90) <= 12
    assert setjoin.boundary({}, 90) == 0
    assert len(list(combinations(range(6), 2))) == comb(6, 2)
