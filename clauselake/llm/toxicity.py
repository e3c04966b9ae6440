"""Toxicity of texts, after undoing disguises by a noisy-channel model.

A disguised token is a lattice: a sign may stand for itself or a letter it looks like, a run of a letter may be
shorter, and a space may end a word or be none. Viterbi decoding under a character trigram model picks the likeliest
words; it is linear in the length, which has no bound. Words of restored texts carry evidence, learned from labelled
documents by stems and whole words; a logistic model turns a document's evidence into a score.

Counts of letters and of evidence are kept in tables of a fixed number of cells, which hashes point into, so that the
models have one size whatever the texts hold and nothing is left out of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.batches import LONGEST_KEPT, blocks, remainder
from clauselake.session import BROADCAST_ROWS, materialize, ship

#: Bits of the hashes that point into the tables of letter counts and of evidence.
GRAM_BITS, EVIDENCE_BITS = 20, 22
#: What a word or stem needs to carry evidence: occurrences in toxic documents, and deviations from what is expected.
LEAST_SEEN, LEAST_Z = 4, 4
#: Letters that signs may stand for (fixed values).
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
#: Log10 costs of a lookalike, of each letter dropped from a run, and of each space taken for none.
SIGN_COST, DROP_COST, SPACE_COST = 0.3, 0.15, 0.05
#: Letters of a token that may be part of a word in pieces; one of a run of such tokens has to be a single sign.
PIECE = 2
_EDGE = " .,;:?\"'#*%&<>[]{}~^_-=/\\)"
_PLAIN = re.compile(r"(?:(?!\d|_)\w)+(?:['’-](?:(?!\d|_)\w)+)*\Z")
_RUN = re.compile(r"(.)\1\1")
_TWICE = re.compile(r"(.)\1")
_SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
_PIECES = re.compile("[12]{2,}")
_APART = re.compile(r"\w(?:[.\-_*·]\w){2,}\Z")


def cell(kind: str, what: str, bits: int) -> int:
    """The cell of a table that a string points to."""
    return xxhash.xxh3_64_intdigest(f"{kind}{what}".encode("utf-8", "replace")) >> (64 - bits)


def gram_cells(gram: str) -> tuple[int, int, int, int, int]:
    """The cells that count a trigram, its first two letters as a context, its last two, the second as a context, and
    the last."""
    return tuple(cell(k, x, GRAM_BITS) for k, x in (("t", gram), ("c", gram[:2]), ("b", gram[1:]), ("d", gram[1]), ("u", gram[2])))


class Remembered(dict):
    """What a function gave for strings of bounded length, as many as `most`. When it is full, what it holds becomes the
    older half, from which strings that are met again come back."""

    def __init__(self, function, most: int):
        self.function, self.most, self.older = function, most, {}

    def __missing__(self, key: str):
        found = self.older.get(key)
        if found is None:
            found = self.function(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found

    def __reduce__(self):
        return Remembered, (self.function, self.most)


class CharModel:
    """Interpolated trigrams of the letters of words, in log10; words have two spaces in front and one behind."""

    def __init__(self, counts: dict[int, int], total: int):
        """counts: by cell, see gram_cells(); total: of trigrams."""
        at = np.array(sorted(counts), np.int64)
        self.counts, self.total = np.zeros(1 << GRAM_BITS, np.int64), total + 1
        self.counts[at] = [counts[k] for k in at.tolist()]
        self.known = Remembered(self.log10, 1_000_000)

    def log10(self, gram: str) -> float:
        c = self.counts
        tri, ctx3, bi, ctx2, uni = (int(c[k]) for k in gram_cells(gram))
        p1 = (uni + 0.01) / (self.total + 10)
        p2 = (bi + 5 * p1) / (ctx2 + 5)
        return math.log10(min(1.0, (tri + 5 * p2) / (ctx3 + 5)))


def letters_of(sign: str) -> list[tuple[str, float]]:
    """What a sign may stand for, with its cost."""
    return [(sign, 0.0)] if sign.isalpha() else [(x, -SIGN_COST) for x in LOOKALIKES.get(sign, "")] or [(sign, -2.0)]


def alike(sign: str, before: str) -> bool:
    """Whether a sign may repeat the one before it."""
    return sign == before or sign in LOOKALIKES.get(before, "") or before in LOOKALIKES.get(sign, "")


def decode(signs: str, model: CharModel) -> str:
    """The likeliest words behind lower-case signs: the best path through their lattice. A sign is one of the letters that
    it may stand for, or is dropped if it repeats the one before; a space ends the word or is none."""
    log10 = model.known.__getitem__
    # states: the last two letters: log-probability and a chain of the letters so far; a single one is held by itself
    last, p, word, states, before = "  ", 0.0, None, None, " "
    for c in signs:
        plain = c.isalpha()
        if plain and c != before and not (before in LOOKALIKES and alike(c, before)):  # one way on from each state
            if states is None:
                p, word, last, before = p + log10(last + c), (word, c), last[1] + c, c
                continue
            after = {}
            for last, (p, word) in states.items():
                key, q = last[1] + c, p + log10(last + c)
                if key not in after or after[key][0] < q:
                    after[key] = (q, (word, c))
        elif c == " ":
            states = states or {last: (p, word)}
            begun = [(p + log10(last + " "), (word, " ")) for last, (p, word) in states.items() if last != "  "]
            after = {last: (p - SPACE_COST if last != "  " else p, word) for last, (p, word) in states.items()}
            if begun and (most := max(begun, key=lambda s: s[0]))[0] >= after.get("  ", (-math.inf,))[0]:
                after["  "] = most
        else:
            states, options, after = states or {last: (p, word)}, letters_of(c), {}
            again = before != " " and alike(c, before)
            for last, (p, word) in states.items():
                moves = [(last[1] + x, p + cost + log10(last + x), (word, x)) for x, cost in options]
                if again:
                    moves.append((last, p - DROP_COST, word))
                for key, q, w in moves:
                    if key not in after or after[key][0] < q:
                        after[key] = (q, w)
        states, before = after, c
        if len(after) == 1:
            ((last, (p, word)),) = after.items()
            states = None
    states = states or {last: (p, word)}
    chain = max(((p + (log10(last + " ") if last != "  " else 0.0), word) for last, (p, word) in states.items()), key=lambda s: s[0])[1]
    letters = []
    while chain is not None:
        chain, x = chain
        letters.append(x)
    return "".join(reversed(letters))


def _length(token: str) -> str:
    """1 or 2 for a token that may be a piece of a word, by its letters, else 0."""
    bare = token if len(token) == 1 else token.strip(_EDGE)
    return str(len(bare)) if 0 < len(bare) <= PIECE else "0"


class Restorer:
    """Restored words of texts; remembers a bounded number of tokens of bounded length."""

    def __init__(self, model: CharModel, most: int = 350_000):
        self.model = model
        self.known, self.runs = Remembered(self.token, most), Remembered(self.spaced, most)

    def __reduce__(self):
        return Restorer, (self.model, self.known.most)

    def token(self, token: str) -> tuple[str, tuple[str, ...]]:
        """_length() and word() of a token; at once for plain words, which most are."""
        bare = token.strip(_EDGE)
        if len(bare) > PIECE and bare.isalpha() and not _TWICE.search(bare):
            return "0", (bare,)
        return _length(token), self.word(token)

    def word(self, token: str) -> tuple[str, ...]:
        """A token without what surrounds it, decoded if it may be a disguise; nothing if no word is in it. A plain word
        with a letter twice may be one or not, and gives both, as does a token that ends in signs like letters."""
        bare = token.strip(_EDGE).rstrip("!")
        if bare.isalpha():
            twice = _TWICE.search(bare)
            if not twice:
                return (bare,)
            if not _TWICE.search(bare, twice.start() + 1):  # one lattice of two paths, which differ in three trigrams
                x, i, log10 = bare[twice.start()], twice.start(), self.model.known.__getitem__
                a, y = bare[i - 1] if i else " ", bare[i + 2] if i + 2 < len(bare) else " "
                keep = log10(a + x + x) + log10(x + x + y) >= log10(a + x + y) - DROP_COST
                return (bare,) if keep else (bare, bare[:i] + bare[i + 1 :])
        bare = bare.lstrip("!") if bare.startswith("!!") else bare
        forms = {bare, bare.rstrip("$")} if bare.endswith("$$") else {bare}
        found = {}
        for form in sorted(forms):
            form = form[::2] if _APART.match(form) else form
            # a number is a number; signs that only look like letters are a word if there is one beside digits
            if not _PLAIN.match(form) or _RUN.search(form):
                if any(c.isalpha() for c in form) or len(form) >= 3 and not form.isdigit() and all(c in LOOKALIKES for c in form):
                    found[decode(form, self.model)] = None
            else:
                found[form] = None
                if _TWICE.search(form):
                    found[decode(form, self.model)] = None
        return tuple(w for w in found if w)

    def spaced(self, signs: str) -> tuple[str, ...]:
        """The words that pieces with spaces between them spell."""
        found = decode(signs, self.model).split() if any(c.isalpha() for c in signs) else []
        return tuple(w for w in dict.fromkeys(x.strip(_EDGE) for x in found) if w)

    def words(self, text: str) -> set[str]:
        """The distinct restored words of a text; pieces of words standing apart give the words that they spell as well."""
        tokens = _SPLIT.findall(text.lower())
        if not tokens:
            return set()
        distinct = list(set(tokens))
        of_each, words = zip(*map(self.known.__getitem__, distinct), strict=True)
        out = set().union(*words)
        if "1" not in of_each:
            return out
        lengths = "".join(map(dict(zip(distinct, of_each, strict=True)).__getitem__, tokens))
        for m in _PIECES.finditer(lengths):
            if "1" not in m[0]:
                continue
            run = [t if len(t) == 1 else t.strip(_EDGE) for t in tokens[m.start() : m.end()]]
            out.update(self.runs[" ".join(run)])
            if len(run) >= 4 and "2" not in m[0]:  # as one word; an article or a sign may have joined in
                apart = "".join(run)
                for joined in (apart, apart[1:], apart[:-1]):
                    out.update(self.known[joined][1])
        return out


def parts(word: str) -> list[str]:
    """What carries a word's evidence: its stems of 3 to 7 letters and itself."""
    return [*("^" + word[:k] for k in range(3, min(8, len(word) + 1))), word + "$"]


def part_cells(word: str) -> np.ndarray:
    """The cells of a word's parts()."""
    if not word.isascii():
        return np.array([cell("e", p, EVIDENCE_BITS) for p in parts(word)], np.int32)
    stem, shift, at = b"e^" + word.encode(), 64 - EVIDENCE_BITS, xxhash.xxh3_64_intdigest  # without a string for each part
    return np.array([*(at(stem[:k]) >> shift for k in range(5, min(10, len(stem) + 1))), at(b"e" + stem[2:] + b"$") >> shift], np.int32)


class Counted:
    """Restored words of texts and their cells; what is remembered lasts from task to task where a worker does."""

    def __init__(self, chars: CharModel, most: int = 200_000, tokens: int = 350_000):
        self.restorer, self.cells = Restorer(chars, tokens), Remembered(part_cells, most)

    def __reduce__(self):
        return Counted, (self.restorer.model, self.cells.most, self.restorer.known.most)


class Model:
    """Evidence by the cell of a stem or word, and the logistic model over a document's evidence."""

    def __init__(self, chars: CharModel, evidence: dict[int, float], theta: np.ndarray, most: int = 350_000):
        self.evidence, self.theta = evidence, theta
        self.restorer, self.known, self.stems = Restorer(chars, most), Remembered(self.of_word, most), Remembered(self.of_stem, most)

    def of_word(self, word: str) -> float:
        found = self.evidence.get
        if not word.isascii():
            return max(self.stems[word[:5]], *(found(cell("e", p, EVIDENCE_BITS), 0.0) for p in (word + "$", *("^" + word[:k] for k in range(6, min(8, len(word) + 1))))))
        stem, shift = b"e^" + word.encode(), 64 - EVIDENCE_BITS  # the same cells, without a string for each part
        stems = [found(xxhash.xxh3_64_intdigest(stem[:k]) >> shift, 0.0) for k in range(8, min(10, len(stem) + 1))]
        return max(self.stems[word[:5]], found(xxhash.xxh3_64_intdigest(b"e" + stem[2:] + b"$") >> shift, 0.0), *stems)

    def of_stem(self, word: str) -> float:
        """The most that stems of three to five letters carry."""
        return max(0.0, *(self.evidence.get(cell("e", "^" + word[:k], EVIDENCE_BITS), 0.0) for k in range(3, len(word) + 1)), 0.0)

    def shape(self, text: str) -> np.ndarray:
        return shape(list(map(self.known.__getitem__, self.restorer.words(text))))

    def score(self, text: str) -> float:
        z = float(self.shape(text) @ self.theta)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def shape(evidence: list[float]) -> np.ndarray:
    """A document's evidence as the numbers that the logistic model takes."""
    v = sorted((x for x in evidence if x > 0), reverse=True)
    total, n = sum(v), max(1, len(evidence))
    return np.array([math.log1p(total), math.log1p(100 * total / n), v[0] if v else 0.0, sum(v[:3]), math.log1p(n), 20 * len(v) / n, 1.0])


def _labelled(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """id, y and text of all rows of `docs`, where y is null for what is not learned from; and id, y and text of the ids
    that repeat, of which the least text is learned from, or None if there are none.

    Labels meet the texts by a broadcast while they are few; beyond that all texts are shuffled once and written.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    ids = docs.groupBy(F.col(id_col).alias("id")).agg((F.count(F.lit(1)) > 1).alias("again"))
    known = materialize(known.join(ids, "id"), "toxic-labels")
    few = known.count() <= BROADCAST_ROWS
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known) if few else known, "id", "left")
    rows = rows if few else materialize(rows, "toxic-rows")
    again = None if known.where("again").isEmpty() else materialize(rows.where("again").groupBy("id", "y").agg(F.min("text").alias("text")), "toxic-again")
    return rows.select("id", F.when(~F.col("again"), F.col("y")).alias("y"), "text"), again


def _tabled(key: str, tables: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The cells of tables that are not all 0, some at a time."""
    at = np.flatnonzero(np.any(list(tables.values()), axis=0))
    for part in np.array_split(at, -(-len(at) // 100_000)) if len(at) else []:
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *(pa.array(t[part], pa.int64()) for t in tables.values())], [key, *tables])


def fit(rows: DataFrame, again: DataFrame | None) -> Model | None:
    """The models, but for the weights of the logistic one, from all rows that have a label; None if there is none. Two
    passes over these, each added up by task in tables of fixed size. rows, again: as _labelled() gives them."""
    spark = rows.sparkSession
    learned = rows.where("y is not null").select("y", "text")
    learned = learned if again is None else learned.union(again.select("y", "text"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cells, around = np.zeros((1 << GRAM_BITS) + 1, np.int64), Remembered(gram_cells, 200_000), _EDGE + "!$"
        for _, texts in blocks(batches, "text"):
            seen: Counter = Counter()
            tokens: Counter = Counter()
            for t in texts:
                tokens.update(_SPLIT.findall(t.decode("utf-8", "replace").lower()))
            once = []  # most tokens of a block
            for token, n in tokens.items():
                w = token.strip(around)
                if w.isalpha() or _PLAIN.match(w):
                    w = f"  {w} "
                    if n == 1:
                        once.append(w)
                        continue
                    for i in range(len(w) - 2):
                        seen[w[i : i + 3]] += n
            seen.update([w[i : i + 3] for w in once for i in range(len(w) - 2)])
            for g, n in seen.items():
                for k in cells[g]:
                    table[k] += n
                table[-1] += n
        yield from _tabled("g", {"n": table})

    found = learned.mapInArrow(grams, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()  # a row for a cell
    counts = dict(zip(found.column("g").to_pylist(), found.column("n").to_pylist(), strict=True))
    chars = CharModel(counts, counts.pop(1 << GRAM_BITS, 0))
    shared = spark.sparkContext.broadcast(Counted(chars))

    def document_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, of_word, size = shared.value.restorer, shared.value.cells, 1 << EVIDENCE_BITS
        tables = {"b": np.zeros(size + 1, np.int32), "a": np.zeros(size + 1, np.int32)}  # the last cell counts words
        for batch, texts in blocks(batches, "text"):
            for y, t in zip(batch.column(0).to_pylist(), texts, strict=True):
                table, words = tables["a" if y else "b"], restorer.words(t.decode("utf-8", "replace"))
                if words:
                    at, n = np.unique(np.concatenate(list(map(of_word.__getitem__, words))), return_counts=True)
                    table[at] += np.minimum(n, 3).astype(np.int32)
                    table[-1] += len(words)
        yield from _tabled("p", tables)

    counted = materialize(learned.mapInArrow(document_parts, "p long, b long, a long").groupBy("p").agg(F.sum("b").alias("b"), F.sum("a").alias("a")), "toxic-parts")
    total = counted.where(F.col("p") == 1 << EVIDENCE_BITS).first()
    if total is None:
        return None
    ta, tb = max(1, total["a"]), max(1, total["b"])
    expected = (F.col("a") + F.col("b")) * (ta / (ta + tb))
    z = (F.col("a") - expected) / F.sqrt(expected + 0.5)
    strong = counted.where((F.col("p") < 1 << EVIDENCE_BITS) & (F.col("a") >= LEAST_SEEN) & (z > LEAST_Z)).collect()  # a row for a cell
    evidence = {r["p"]: math.log(((r["a"] + 0.3) / ta) / ((r["b"] + 0.3) / tb)) for r in strong}
    return Model(chars, evidence, np.zeros(7))


def _summed(rows: DataFrame, size: int, of) -> np.ndarray:
    """The sum over `rows` (y, x) of what `of` makes of a batch's x and y: `size` numbers. A row a number for each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total += of(x, batch.column(0).to_numpy(zero_copy_only=False).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], ["k", "v"])

    out = np.zeros(size)
    for r in rows.select("y", "x").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r["k"]] = r["v"]
    return out


def _logistic(rows: DataFrame, ridge: float = 0.5) -> np.ndarray:
    """Weights of a logistic model of `rows` (y, x) by Newton's method, of which a step is one aggregation; the last column
    is the constant and is not penalised."""
    sums = _summed(rows, 15, lambda x, y: np.concatenate([x.sum(axis=0), (x * x).sum(axis=0), [len(x)]]))
    mean = sums[:7] / max(sums[14], 1)
    scale = np.sqrt(np.maximum(sums[7:14] / max(sums[14], 1) - mean**2, 1e-18))
    scale[-1] = 1.0
    theta, penalty = np.zeros(7), np.full(7, ridge)
    penalty[-1] = 1e-3
    for _ in range(60):
        def step_of(x: np.ndarray, y: np.ndarray, theta: np.ndarray = theta) -> np.ndarray:
            x = x / scale
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            return np.concatenate([((x * (p * (1 - p))[:, None]).T @ x).reshape(-1), x.T @ (p - y)])

        sums = _summed(rows, 56, step_of)
        step = np.linalg.solve(sums[:49].reshape(7, 7) + np.diag(penalty), sums[49:] + penalty * theta)
        theta = theta - step
        if np.abs(step).max() < 1e-8:
            break
    return theta / scale


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score, from 0 to 1, for each row of `docs`: higher means label 1 is likelier.

    All labelled rows are learned from; of an id that repeats the least text is. A null text counts as empty; a text
    without words has no evidence and scores low. Repeated rows score alike. Without labels the score is 0.5 everywhere.
    Labels, ids and other columns are no input of a score. An empty table gives an empty result. Two passes over what
    has a label make the models; a third over all rows writes the evidence of each as 7 numbers, from which the logistic
    model is fitted and scores are worked out. The broadcast model has 2**GRAM_BITS counts, and weights for those of
    2**EVIDENCE_BITS cells that stand out.

    Left out are words cut by spaces into pieces of more than PIECE letters.
    """
    spark = docs.sparkSession
    ship(spark)
    rows, again = _labelled(docs, labels, label_col, id_col, text_col)
    fitted = fit(rows, again)
    if fitted is None:
        return docs.select(F.col(id_col), F.lit(0.5).alias("score"))
    model = spark.sparkContext.broadcast(fitted)

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch, texts in blocks(batches, "text"):
            x = [m.shape(t.decode("utf-8", "replace")).tolist() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["id", "y", "x"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, y int, x array<double>"
    shaped = materialize(rows.mapInArrow(shapes, schema), "toxic-shapes")
    learned = shaped.where("y is not null")
    theta = _logistic(learned if again is None else learned.union(materialize(again.select("id", "y", "text").mapInArrow(shapes, schema), "toxic-shapes")))
    z = sum((F.get("x", F.lit(k)) * F.lit(float(w)) for k, w in enumerate(theta)), F.lit(0.0))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))
    return shaped.select(F.col("id").alias(id_col), score.alias("score"))


#: Labels are learned from the rows whose crc32 of the id leaves another remainder than this.
FOLDS, HELD_OUT = 5, 0


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """classify() of all documents, learned outside the held-out fold: doc_id, held_out, score, predicted. Nulls, empty
    and long texts, ties and repeated rows as there; null ids belong to the fold of the empty text."""
    train = labels.where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    scored = classify(docs, train)
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
