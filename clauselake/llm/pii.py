"""Personal data by weak supervision.

Patterns of fixed kinds are found exactly. Beyond them, wider patterns propose candidates, on which labelers vote:
a strict form, a gazetteer, the context, the value's own make-up and its isolation. Expectation maximisation over
the vote patterns of all candidates estimates how reliable each labeler is and how likely each pattern is a hit;
these probabilities train the span classifier that decides, which also sees what the labelers do not vote on: the
value's shape and length, and the words and signs around it.

Every pattern is linear in the length of the text: what could be tried from each place of a long run starts at the
run's start only, and does not give back what it has taken.
"""

from __future__ import annotations

import hashlib
import ipaddress
import itertools
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.batches import blocks
from clauselake.session import materialize, ship

#: Kinds in the order of results: four with an exact pattern, then those that the method alone finds.
KINDS = ("email", "ip", "card", "phone", "iban", "secret", "ssn", "ipv6")
#: Labelers, each voting 0 (abstains), 1 (no) or 2 (yes).
LABELERS = ("form", "gazetteer", "context", "content", "isolation")
#: Most characters before a candidate that count as its context.
CONTEXT = 48
#: Bits of the hashed features of a span, how many it has, and spans that the classifier is fitted on, at most.
FEATURE_BITS, FEATURES, TRAIN_SPANS = 10, 6, 20_000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

# Patterns of candidates, words and lists of the gazetteers.
CANDIDATES = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[._%+-]*+([A-Za-z0-9][A-Za-z0-9._%+-]*+(?: ?[\[({] ?(?:at|AT|@) ?[\])}] ?| at | AT )[A-Za-z0-9-]++(?:(?: ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?| dot | DOT |\.)[A-Za-z0-9-]++)++)"),
    "phone": re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])|(?<![\w+.-])00[1-9][0-9]{0,2}[ .-][0-9][0-9 .-]{5,13}[0-9](?![\w-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9])(?:(?i:token|password|passwd|pwd|secret|api[_-]?key)[\"']?\s?[=:]\s?[\"']?[^\s\"',;]{8,}|AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{20,}|(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})(?![A-Za-z0-9]))"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "ipv6": re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])"),
}
_STRICT = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+ ?[\[({] ?(?:at|AT|@) ?[\])}] ?[A-Za-z0-9-]+(?: ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?[A-Za-z0-9-]+)+|\S+ (?:at|AT) \S+(?: (?:dot|DOT) \S+)+"),
    "phone": re.compile(r"\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}[ .-][0-9]{4}|00.*"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,36}"),
    "secret": re.compile(r"AKIA.*|gh[pousr]_.*|(?i:token|password|passwd|pwd|secret|api[_-]?key).*"),
    "ssn": re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"),
    "ipv6": re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f:]*::[0-9A-Fa-f:]*"),
}
ENDINGS = frozenset("com org net edu gov info io co de fr es it uk eu nl pl pt at ch be us ca example test".split())
IBAN_COUNTRIES = frozenset("AD AT BE CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM".split())
HINTS = {
    "email": re.compile(r"(?i)e-?mail|courriel|correo|contact|kontakt|write to|adress"),
    "phone": re.compile(r"(?i)phone|call|tel[.:é ]|fon|mobile|fax|llam|appel|anruf"),
    "iban": re.compile(r"(?i)iban|account|konto|compte|cuenta|bank|bic"),
    "secret": re.compile(r"(?i)token|passw|secret|key|credential|login"),
    "ssn": re.compile(r"(?i)ssn|social|security"),
    "ipv6": re.compile(r"(?i)\bip|addr|host|server|node|gateway|dns"),
}
AGAINST = re.compile(r"(?i)isbn|issn|version|order|invoice|chapter|page|section|part no|serial|commit|sha-?1|md5|checksum")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the exact patterns, by kind and start: leftmost matches of each kind, without overlap;
    those that fail the kind's test are dropped, with no other try inside them."""
    out = []
    at, after = text.find("@"), 0
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((0, start, m.end()))
            after = m.end()
        at = text.find("@", max(at + 1, after))
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                d = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(d) <= 19 and luhn(d):
                    out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def votes(kind: str, text: str, start: int, end: int) -> int:
    """The votes on a candidate, as digits of base 3."""
    value = text[start:end]
    before = text[max(0, start - CONTEXT) : start]
    form = 2 if _STRICT[kind].fullmatch(value) else 1
    body = re.split(r"[=:]\s?[\"']?", value, maxsplit=1)[-1] if kind == "secret" else value
    flat = re.sub(r"[^A-Za-z0-9]", "", body)
    gazetteer, content = 0, 0
    if kind == "email":
        gazetteer = 2 if re.split(r"[^A-Za-z0-9-]+", value.rstrip("])} "))[-1].lower() in ENDINGS else 1
        content = 2 if len(value) <= 80 and not re.search(r"[.-]{2}", value) else 1
    elif kind == "phone":
        gazetteer = 2 if flat[:1] in "23456789" or flat.startswith("00") else 1
        content = 1 if len(set(flat)) < 3 else 2
    elif kind == "iban":
        gazetteer = 2 if value[:2] in IBAN_COUNTRIES else 1
        number = "".join(str(int(c, 36)) for c in flat[4:] + flat[:4])
        content = 2 if int(number) % 97 == 1 else 1
    elif kind == "secret":
        gazetteer = 2 if re.match(r"AKIA|gh[pousr]_|sk[-_]|xox", body) else 0
        content = 2 if len(set(flat)) >= 6 and re.search("[0-9]", flat) and re.search("[A-Za-z]", flat) else 1
    elif kind == "ipv6":
        gazetteer = 2 if re.match(r"(?i)20|2[4-9a-f]|f[cde]|::1", value) else 1
        try:
            content = 2 if ipaddress.IPv6Address(value) else 1
        except ValueError:
            content = 1
    else:
        content = 1 if len(set(flat)) < 3 else 2
    hinted = HINTS[kind].search(before) or kind == "secret" and body != value
    context = 1 if AGAINST.search(before) else 2 if hinted else 0
    alone = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    code = 0
    for v in (form, gazetteer, context, content, 2 if alone else 1):
        code = code * 3 + v
    return code


_LETTER = re.compile(r"[^\W\d_]+")
_SMALL, _CAPITAL, _NUMBER = re.compile("[a-z]+"), re.compile("[A-Z]+"), re.compile("[0-9]+")


def features(kind: str, text: str, start: int, end: int) -> list[int]:
    """FEATURES numbers below 2**FEATURE_BITS: hashes of the value's shape, its length and how varied it is, of the last
    word before it, and of the signs on both sides."""
    value = text[start : min(end, start + 2 * CONTEXT)]
    shape = _NUMBER.sub("9", _CAPITAL.sub("A", _SMALL.sub("a", value)))
    word = _LETTER.findall(text[max(0, start - CONTEXT) : start])
    said = (shape[:12], f"l{(end - start).bit_length()}", f"v{len(set(value)) // 4}", f"w{word[-1].lower()[:12] if word else ''}", f"b{text[start - 1 : start]}", f"e{text[end : end + 1]}")
    return [zlib.crc32(f"{kind}|{k}|{x}".encode("utf-8", "replace")) >> 32 - FEATURE_BITS for k, x in enumerate(said)]


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, ...]]:
    """(kind, start, end, votes, *features) of what the wider patterns find outside of `taken`; the leftmost comes first
    and what overlaps it is left out, the kind listed first where two start together."""
    digit = _DIGIT.search(text) is not None
    found = []
    for kind, pattern in CANDIDATES.items():
        if kind in ("phone", "ssn", "iban") and not digit or kind == "ipv6" and ":" not in text:
            continue
        if kind == "email" and not (" dot " in text or " DOT " in text or "[" in text or "(" in text or "{" in text or " at " in text or " AT " in text):
            continue
        group = pattern.groups  # where there is one, it is the candidate
        found += [(m.start(group), KINDS.index(kind), m.end(group)) for m in pattern.finditer(text)]
    if not found:
        return []
    out, end = [], 0
    spans = sorted((s, e) for _, s, e in taken)
    begins, furthest = [s for s, _ in spans], list(itertools.accumulate((e for _, e in spans), max))
    for start, kind, stop in sorted(found):
        before = bisect_left(begins, stop)  # spans from there on begin behind the candidate
        if start >= end and not (before and furthest[before - 1] > start):
            out.append((kind, start, stop, votes(KINDS[kind], text, start, stop), *features(KINDS[kind], text, start, stop)))
            end = stop
    return out


def digits(code: int) -> list[int]:
    return [code // 3**k % 3 for k in range(len(LABELERS) - 1, -1, -1)]


def posteriors(counts: dict[tuple[int, int], int], rounds: int = 100) -> dict[tuple[int, int], float]:
    """How likely each (kind, votes) is a hit, from how often each was seen.

    Expectation maximisation knows for each kind how common hits are, and for each labeler what it votes on hits and
    on others; pseudo-counts start labelers as right in four votes of five and keep rare kinds near that.
    """
    if not counts:
        return {}
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    kind = np.array([k for k, _ in keys])
    vote = np.array([digits(c) for _, c in keys])
    prior_rate, prior_vote = 4.0, 8.0
    start = np.array([[0.30, 0.55, 0.15], [0.25, 0.15, 0.60]])  # votes 0, 1, 2 on others and on hits
    theta = np.repeat(start[None], len(LABELERS), 0)
    rate = np.full(len(KINDS), 0.5)
    p = np.full(len(keys), 0.5)
    for _ in range(rounds):
        log = np.stack([np.log(1 - rate[kind]), np.log(rate[kind])], 1)
        for k in range(len(LABELERS)):
            log += np.log(theta[k][:, vote[:, k]].T)
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        for k in range(len(LABELERS)):
            for y, w in ((0, n * (1 - p)), (1, n * p)):
                hits = np.bincount(vote[:, k], weights=w, minlength=3) + prior_vote * start[y]
                theta[k, y] = hits / hits.sum()
        for j in range(len(KINDS)):
            m = kind == j
            rate[j] = (float((n * p)[m].sum()) + prior_rate * 0.5) / (float(n[m].sum()) + prior_rate)
    return {k: float(v) for k, v in zip(keys, p, strict=True)}


def columns(kind: np.ndarray, code: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """The features of spans that are 1: their kind, each labeler's vote, and their hashed features."""
    vote = np.stack([code // 3**k % 3 + 3 * k for k in range(len(LABELERS))], 1)
    base = len(KINDS)
    return np.concatenate([kind[:, None], base + vote, base + 3 * len(LABELERS) + hashed], 1)


def train(spans: list[list[int]], target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Weights of the span classifier: a logistic model of (kind, votes, *features) for the probabilities in `target`,
    by gradient steps that each weight scales by what it has moved; the hashed features are held nearer to zero."""
    own = len(KINDS) + 3 * len(LABELERS)
    w = np.zeros(own + (1 << FEATURE_BITS))
    if not spans:
        return w
    s = np.array(spans, np.int64)
    at = columns(s[:, 0], s[:, 1], s[:, 2:])
    ridge = np.where(np.arange(len(w)) < own, 0.1, 2.0)
    moved = np.full(len(w), 1e-6)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(w[at].sum(1), -30, 30)))
        grad = np.bincount(at.ravel(), weights=np.repeat(q - target, at.shape[1]), minlength=len(w)) + ridge * w
        moved += grad * grad
        w -= 0.5 * grad / np.sqrt(moved)
    return w


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """For each row of `docs`: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts and base_sha256 are of the exact patterns; spans are these and the candidates that the classifier accepts,
    as kind:start:end in code points, end exclusive, by kind and start. A null text counts as empty; a text without
    finds has zeros, the digest of the empty string and empty spans. Rows are independent but for the classifier:
    the reliabilities of labelers come from the vote patterns of all rows, of which at most 8 x 243 counts reach the
    driver; the classifier is fitted on the TRAIN_SPANS candidates of least hash of their place. Other columns are not
    read. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    names = ["n_email", "n_ip", "n_card", "n_phone"]
    wide = 4 + FEATURES

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text"):
            base, more = [], []
            for t in texts:
                text = t.decode("utf-8", "replace")
                found = base_spans(text)
                base.append([x for span in found for x in span])
                more.append([x for c in candidates(text, found) for x in c])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(pa.int32())), pa.array(more, pa.list_(pa.int32()))], ["id", "base", "more"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    found = materialize(source.mapInArrow(scan, f"id {kind}, base array<int>, more array<int>"), "pii-spans")
    at = F.explode(F.sequence(F.lit(0), F.size("more") - wide, F.lit(wide)))
    each = found.where(F.size("more") > 0).select("id", "more", at.alias("at")).select("id", F.element_at("more", F.col("at") + 1).alias("k"), F.element_at("more", F.col("at") + 4).alias("v"), F.slice("more", F.col("at") + 1, F.lit(wide)).alias("span"))
    likely = posteriors({(r["k"], r["v"]): r["n"] for r in each.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).collect()})
    sample = [r["span"] for r in each.orderBy(F.xxhash64("id", F.element_at("span", 2), "k"), "span").limit(TRAIN_SPANS).select("span").collect()]
    weights = train([[x[0], *x[3:]] for x in sample], np.array([likely[x[0], x[3]] for x in sample]))
    logit = float(np.log(threshold / (1 - threshold)))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, spans, added = [[], [], [], []], [], [], []
            listed = batch.column(2).to_pylist()
            flat = np.array([x for more in listed for x in more], np.int64).reshape(-1, wide)
            hit = weights[columns(flat[:, 0], flat[:, 3], flat[:, 4:])].sum(1) >= logit
            place = 0
            for base, more in zip(batch.column(1).to_pylist(), listed, strict=True):
                own = list(zip(base[::3], base[1::3], base[2::3], strict=True))
                m = len(more) // wide
                extra = [tuple(int(x) for x in flat[place + j, :3]) for j in range(m) if hit[place + j]]
                place += m
                for k in range(4):
                    n[k].append(sum(x[0] == k for x in own))
                sha.append(hashlib.sha256(said(own).encode()).hexdigest())
                spans.append(said(own + extra))
                added.append(len(extra))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], ["id", *names, "base_sha256", "spans", "n_added"])

    out = found.mapInArrow(decide, f"id {kind}, " + ", ".join(f"{x} long" for x in names) + ", base_sha256 string, spans string, n_added long")
    return out.withColumnRenamed("id", id_col)


def query(docs: DataFrame) -> DataFrame:
    """find() on all documents. Null, empty, blank and very long texts, repeated rows, null ids, empty tables and
    further columns as there; equal texts have equal spans."""
    return find(docs)
