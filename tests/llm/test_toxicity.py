import itertools
import math
import pickle
import random
from collections import Counter

import numpy as np

from clauselake.llm import toxicity


def model_of(text, times=50):
    cells, total = Counter(), 0
    for w in text.split():
        p = f"  {w} "
        for i in range(len(p) - 2):
            total += times
            for k in toxicity.gram_cells(p[i : i + 3]):
                cells[k] += times
    return toxicity.CharModel(cells, total)


def restorer():
    return toxicity.Restorer(model_of("you are an idiot and the good people will see that you can say what they think of it"))


def test_disguises_of_any_length():
    r = restorer()
    assert {"you", "idiot"} <= r.words("y o u i d i o t")
    assert "idiot" in r.words(" ".join("thegoodpeoplewillseethatyoucansaywhattheythinkofyouidiot"))
    assert "it" in r.words("will see 1 t")
    assert "idiot" in r.words("i" * 60 + "diot") and "idiot" in r.words("iidiot")
    assert {"good", "see"} <= r.words("good see")


def test_disguises_in_pieces_and_without_letters():
    r = restorer()
    assert "idiot" in r.words("what an i d io t") and "idiot" in r.words("an id i ot")
    assert "idiot" in r.words("you 1d10t$$") and "$$" not in r.words("good $$")
    assert r.words("1 2 3 1999 45") == set() and "all" in toxicity.Restorer(model_of("all as it is")).words("@||")


def test_long_tokens():
    assert toxicity.decode("ab" * 20_000, restorer().model) == "ab" * 20_000


def paths(signs):
    """Every (letters with spaces, cost) of a lattice."""
    ways = []
    for i, c in enumerate(signs):
        if c == " ":
            ways.append([(" ", 0.0), ("", -toxicity.SPACE_COST)])
            continue
        options = list(toxicity.letters_of(c))
        if i and signs[i - 1] != " " and toxicity.alike(c, signs[i - 1]):
            options.append(("", -toxicity.DROP_COST))
        ways.append(options)
    for path in itertools.product(*ways):
        yield "".join(x for x, _ in path), sum(c for _, c in path)


def weight(words, model):
    out = 0.0
    for w in words.split(" "):
        p = f"  {w} "
        out += sum(model.log10(p[i : i + 3]) for i in range(len(p) - 2)) if w else 0.0
    return out


def test_viterbi_against_all_paths():
    m = restorer().model
    r = random.Random(4)
    for _ in range(250):
        signs = "".join(r.choice("idot1 0eo|$y u") for _ in range(r.randrange(1, 8))).strip()
        signs = " ".join(signs.split())
        if not signs:
            continue
        best = max((weight(w, m) + c, w) for w, c in paths(signs) if not any(not x for x in w.split(" ")))
        got = toxicity.decode(signs, m)
        costs = [c for w, c in paths(signs) if w == got]
        assert costs and math.isclose(weight(got, m) + max(costs), best[0], abs_tol=1e-9), (signs, got, best)


def test_spaced_insult_of_300_letters_is_toxic(spark):
    """Learned from plain insults, found where all letters stand apart."""
    r = random.Random(2)
    vocab = "you are the good people will see that can say what they think of it and an house tree water stone light".split()
    bad = ["grumbler", "snorkface", "blubberhead"]
    docs, labels = [], []
    for i in range(400):
        words = [r.choice(vocab) for _ in range(60)]
        if i % 2:
            for k in range(0, 60, 12):
                words[k] = r.choice(bad)
        docs.append((i, " ".join(words)))
        labels.append((i, i % 2))
    long = "".join(r.choice(vocab) if k % 4 else r.choice(bad) for k in range(75))
    docs += [(1000, " ".join(long[:320])), (1001, " ".join("".join(r.choice(vocab) for _ in range(75))[:320]))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    found = {x["doc_id"]: x["score"] for x in toxicity.classify(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert found[1000] >= 0.5 > found[1001]


def test_remembered_words_are_bounded():
    """A corpus of long tokens leaves nothing behind in a worker; short ones stay within their number."""
    from clauselake.llm.batches import LONGEST_KEPT, WordHashes

    hashes, restorer = WordHashes(most=100), toxicity.Restorer(toxicity.CharModel({}, 0), most=100)
    model = toxicity.Model(toxicity.CharModel({}, 0), {}, np.zeros(7), most=100)
    for k in range(300):
        long = f"{k}x" + "ab" * 500
        assert hashes[long.encode()] == WordHashes()[long.encode()]
        restorer.known[long]
        model.known[long]
        hashes[str(k).encode()], restorer.known[f"w{k}"], model.known[f"w{k}"]
    for held in (hashes, restorer.known, model.known):
        assert 0 < len(held) <= 100 and max(map(len, held)) <= LONGEST_KEPT


def test_all_labelled_rows_are_learned_from(spark):
    """However many of a class there are; of an id that repeats the least text."""
    docs = [(i, "tree" if i % 40 else "grumbler") for i in range(3500)] + [(7, "stone"), (7, "tree")]
    labels = [(i, int(i % 40 == 0)) for i in range(3500)]
    rows, again = toxicity._labelled(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), "toxic", "doc_id", "text")
    model = toxicity.fit(rows, again)
    # a word of n letters has n + 1 trigrams; one row "stone" is learned from for the id 7
    assert model.restorer.model.total - 1 == 88 * 9 + 3411 * 5 + 6
    d = spark.createDataFrame(docs, "doc_id long, text string")
    found = toxicity.classify(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(found) == 3502 and all((r["score"] >= 0.5) == (r["doc_id"] % 40 == 0) for r in found)


def test_counted_cells_are_those_of_parts():
    counted = toxicity.Counted(model_of("all as it is"))
    for w in ("a", "ab", "abc", "abcdefghij", "ß", "éa", "élan", "élanvital", "ab-c"):
        assert counted.cells[w].tolist() == [toxicity.cell("e", p, toxicity.EVIDENCE_BITS) for p in toxicity.parts(w)]
    evidence = {int(c): 1.0 + i for i, c in enumerate(counted.cells["élanvital"])}
    model = toxicity.Model(counted.restorer.model, evidence, None)
    assert model.known["élanvital"] == max(evidence.values()) and model.known["élan"] == max(evidence[c] for c in counted.cells["élan"].tolist() if c in evidence)
    again = pickle.loads(pickle.dumps(counted))
    assert again.cells.most == counted.cells.most and again.restorer.known.most == counted.restorer.known.most and not again.cells
