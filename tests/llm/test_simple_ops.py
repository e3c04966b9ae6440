import hashlib
import re
from collections import Counter, defaultdict

import pytest

from clauselake.llm import bpe, exact_dedup, mixing, repetition
from tests.llm.conftest import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for r in rows():
        groups[lower(r[1])].append(r[0])
    top = lambda ids: max((i for i in ids if i is not None), default=None)
    want = Counter((r[0], top(groups[lower(r[1])]) if len(groups[lower(r[1])]) > 1 else r[0], len(groups[lower(r[1])]), hashlib.sha256(lower(r[1]).encode()).hexdigest()) for r in rows())
    got = exact_dedup.query(docs).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    assert exact_dedup.query(empty).count() == 0


def test_drop_copies(docs, empty):
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    groups = defaultdict(list)
    for r in rows():
        groups[lower(r[1])].append(r)
    want = sorted(str(max(g, key=lambda r: -1 if r[0] is None else r[0])[0]) for g in groups.values())
    got = left.collect()
    assert sorted(str(r["doc_id"]) for r in got) == want
    assert len({lower(r["text"]) for r in got}) == len(got)
    assert exact_dedup.drop_copies(empty).count() == 0


def test_drop_copies_of_repeated_rows(spark):
    """Rows that repeat an id: with one text and other columns apart, equal in all, and with other texts of one length
    and beginning; names that the operator uses itself."""
    same = "x" * 80
    data = [(1, same + "a", "p"), (1, same + "a", "q"), (1, same + "b", "p"), (2, same + "b", "p"), (3, "t", "p"), (3, "t", "p"), (3, "T", "p"), (None, "u", "p"), (None, "u", "p"), (None, same + "b", "p"), (4, None, "p"), (5, "", "p")]
    df = spark.createDataFrame(data, "doc_id long, text string, __sha string").repartition(3)
    got = sorted(map(str, exact_dedup.drop_copies(df).collect()))
    again = sorted(map(str, exact_dedup.drop_copies(df.repartition(2)).collect()))
    assert got == again
    assert Counter((str(r["doc_id"]), lower(r["text"])) for r in exact_dedup.drop_copies(df).collect()) == Counter([("1", same + "a"), ("2", same + "b"), ("3", "t"), ("None", "u"), ("5", "")])


def test_drop_copies_digests_survivors_only(spark):
    """The digest is above the join with shared lengths and prefixes, not in the scan."""
    df = spark.createDataFrame([(i, "w" * i) for i in range(20)] + [(30, "w" * 5)], "doc_id long, text string")
    read = exact_dedup._keys(df, "doc_id", "text")
    assert "sha2" not in read._jdf.queryExecution().optimizedPlan().toString()
    left = exact_dedup.drop_copies(df)
    assert sorted(r["doc_id"] for r in left.collect()) == [*range(5), *range(6, 20), 30]
    keys = [x for x in left._jdf.queryExecution().sparkPlan().toString().split("\n") if "Join" in x]
    assert keys and all("sha2" not in k.split("LeftAnti")[0] for k in keys)


def test_repetition(docs, empty):
    got = defaultdict(list)
    for r in repetition.query(docs).collect():
        got[r["doc_id"]].append(r)
    for doc_id, text, *_ in rows():
        t = text or ""
        words = WORD.findall(t)
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)
        r = got[doc_id][0]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want, doc_id
        assert not (r["base_failed"] and r["kept"])
        grams = Counter(tuple(words[i : i + 7]) for i in range(len(words) - 6))
        assert r["repeated_chars_7"] == sum(len(words[j]) for j in {j for i in range(len(words) - 6) if grams[tuple(words[i : i + 7])] > 1 for j in range(i, i + 7)})
    assert repetition.query(empty).count() == 0


def test_targets_and_mix(docs, empty):
    size = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for r in rows():
        sizes[r[3]] += size(r[1])
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in held]
        share = (total - sum(held.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * share > 3 * sizes[s]]
        if not over:
            break
        held |= {s: 3.0 * sizes[s] for s in over}
    want = {s: held.get(s, weight[s] * share) for s in order}
    got = mixing.query(docs).collect()
    assert len(got) == len(rows())
    source = {r[0]: r[3] for r in rows()}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] % max(r["size"], 1) == 0 and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in order:
        largest = max(size(r[1]) for r in rows() if r[3] == s)
        assert abs(taken[s] - want[s]) <= 3 * largest
    assert sorted(map(str, got)) == sorted(map(str, mixing.query(docs.repartition(3)).collect()))
    assert mixing.query(empty).count() == 0
    mixed = mixing.emit(docs)
    assert mixed.columns == docs.columns
    assert sum(size(r["text"]) for r in mixed.collect()) == sum(taken.values())
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.emit(docs.repartition(3)).collect()))
    assert mixing.emit(empty).count() == 0


def test_mix_against_plain_systematic_sampling(spark):
    """Copies of each row equal a plain walk along each source in the order of sizes and hashes."""
    import math

    data = [(i, " ".join(["w"] * (i * 7 % 23)), [None, "a", "b", "é", "B"][i % 5 if i % 3 else 1]) for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(7)
    from pyspark.sql import functions as F

    hashed = {r["doc_id"]: (r["h"], r["u"]) for r in df.select("doc_id", F.xxhash64("doc_id", F.lit(7)).alias("h"), (F.pmod(F.xxhash64("source", F.lit(7)), F.lit(1 << 52)) / float(1 << 52)).alias("u")).collect()}
    got = {r["doc_id"]: r for r in mixing.query(df).collect()}
    by = defaultdict(list)
    for i, t, s in data:
        by[s].append((len(t.split()), hashed[i][0], i))
    for s, of in by.items():
        total = sum(n for n, _, _ in of)
        e = got[of[0][2]]["target"] / total
        u = hashed[of[0][2]][1]
        for rank, (n, _, i) in enumerate(sorted(of)):
            assert got[i]["taken"] == n * (math.floor(u + (rank + 1) * e) - math.floor(u + rank * e)), (s, rank)


def test_coverage_rule_alone():
    """A text that passes the base rules and fails by the characters in repeated words alone."""
    from clauselake.llm.batches import WordHashes

    long = [f"{'w' * 40}{k}" for k in range(8)]
    words = long + [f"a{k}" for k in range(70)] + long
    m = repetition.measure([" ".join(words).encode()], WordHashes(), (5, 7, 10))
    assert 100 * m["repeated_words_5"][0] <= 20 * m["n_words"][0]
    assert m["repeated_chars_5"][0] > 0.30 * m["word_chars"][0]


def test_kept_against_a_plain_reading_of_the_rules(spark):
    long = [f"{'w' * 40}{k}" for k in range(8)]
    texts = [" ".join(long + [f"a{k}" for k in range(70)] + long), " ".join(f"b{k}" for k in range(40)), "\n".join(["same line here"] * 2 + [f"c{k} d{k} e{k}" for k in range(20)]), "# $ % " + " ".join(f"f{k}" for k in range(9)), "\n".join([" ".join(f"{'long' * 9}{k}" for k in range(4))] * 6 + [f"g{k} h{k} i{k} j{k} k{k}" for k in range(30)]), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in repetition.query(df).collect()}
    for i, t in enumerate(texts):
        words = (t or "").split()
        chars, seen, dup = sum(map(len, words)), set(), 0
        for line in (t or "").split("\n"):
            dup += len(line) if line in seen and line.strip() else 0
            seen.add(line)
        fine = len(words) >= 10 and dup <= 0.30 * chars and sum(c in "#*$%&|<>" for c in t or "") <= 0.25 * len(words)
        for n, most in repetition.NGRAM_LIMITS:
            grams = Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
            at = {j for k in range(len(words) - n + 1) if grams[tuple(words[k : k + n])] > 1 for j in range(k, k + n)}
            fine = fine and sum(len(words[j]) for j in at) <= most * chars and not (n == 5 and 100 * len(at) > 20 * len(words))
        assert got[i] == fine, i
    assert not got[0] and got[1]


def test_bpe(docs, empty):
    import base64

    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    real = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    texts = {r[0]: r[1] or "" for r in rows()}
    for r in bpe.query(docs).collect():
        ids = real.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(texts[r["doc_id"]].encode()))
    assert bpe.query(empty).count() == 0
    full = bpe.encode_documents(docs, path, P.PATTERN, ids=True)
    back = bpe.decode_documents(full, path, P.PATTERN)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == texts
    odd = docs.sparkSession.createDataFrame([(1, [99_999_999]), (2, None), (3, []), (4, [ranks[b"\xff"]])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode_documents(odd, path, P.PATTERN).collect()} == {1: None, 2: "", 3: "", 4: "\ufffd"}


def test_bpe_order_of_merges():
    """Vocabularies in which a merge makes a pair of lower or equal rank, which has to go first."""
    import random

    import tiktoken

    r = random.Random(1)
    for seed in range(60):
        grams = list({bytes(r.choice(b"ab") for _ in range(r.randrange(2, 6))) for _ in range(20)})
        r.shuffle(grams)
        ranks = {bytes([b]): i for i, b in enumerate(b"ab")}
        ranks |= {g: i + 2 for i, g in enumerate(grams)}
        own, real = bpe.ByteBpe(ranks, r"\S+"), tiktoken.Encoding("t", pat_str=r"\S+", mergeable_ranks=ranks | {bytes([b]): 300 + b for b in range(256) if b not in b"ab"}, special_tokens={})
        for _ in range(20):
            text = "".join(r.choice("ab") for _ in range(r.randrange(1, 60)))
            assert own.encode(text) == real.encode_ordinary(text), (ranks, text)


def test_bpe_long_pre_token():
    import public_tokenizers as P

    tok = bpe.tokenizer(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    text = "abcab" * 30000
    assert tok.decode(tok.encode(text)).decode() == text


def test_ids_of_texts_are_let_go():
    import tracemalloc

    bpe_ = bpe.ByteBpe({bytes([b]): b for b in range(256)}, r"\S+|\s+")
    texts = [bytes(97 + (i * k) % 26 for k in range(20_000)) for i in range(1, 41)]
    tracemalloc.start()
    try:
        rows = bpe_.told(texts, ids=False)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == [bpe_.digests(t.decode())[:3] for t in texts] and [r[3] for r in bpe_.told(texts, ids=True)] == [bpe_.digests(t.decode())[3] for t in texts]
    assert peak < 12e6  # the ids of all texts, as they were held, take some 50 MB
