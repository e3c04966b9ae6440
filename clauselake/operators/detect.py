"""Rule detection, merging, de-duplication and scoring of risks."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.functions import packs, text
from clauselake.session import materialize, ship


def severity_rank(c: Column) -> Column:
    """1 for Low, 2 for Medium, 3 for High, else 0."""
    return F.when(c == "High", 3).when(c == "Medium", 2).when(c == "Low", 1).otherwise(0)


def quoted(c: Column) -> Column:
    """A pattern that matches the text literally."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def tfidf_boost(keyword: Column, body: Column, freq: Column) -> Column:
    """R2: whole-word frequency of the keyword times its log inverse corpus frequency, times 10, at most 1."""
    hits = F.regexp_count(F.lower(body), F.concat(F.lit(r"\b"), quoted(F.lower(keyword)), F.lit(r"\b")))
    n = F.greatest(text.word_count(F.lower(body)), F.lit(1))
    return F.least(F.lit(1.0), hits / n * F.ln(F.lit(1.0) / (freq + F.lit(1e-9))) * 10)


def needed(pattern: str) -> list[str]:
    """Lower-case strings of which every match of the pattern has one; none if the pattern promises nothing.

    Of each alternative it is the longest run of plain letters outside of groups. Looking for plain strings is far
    cheaper than running an expression, so a rule is run only where one of its strings occurs.
    """
    if m := re.fullmatch(r"\\b\((?!\?)([^()]*)\)\\b", pattern):
        pattern = m[1]
    while (flat := re.sub(r"\([^()]*\)\??", "\0", pattern)) != pattern:
        pattern = flat
    out = []
    for part in pattern.split("|"):
        plain = re.sub(r"\[[^\]]*\][?*+]?|\\b|\\[a-z][?*+]?|\\?.[?*]|[^A-Za-z ]", "\0", part)
        longest = max((r.strip() for r in plain.split("\0")), key=len)
        if not longest:
            return []
        out.append(longest.lower())
    return out


def _matches(clause: Column, low: Column, k: int, risk_type: str, pattern: str, severity: str, freq: float, why: str) -> Column:
    """The matches of one rule as an array of structs."""

    def found(m: Column, i: Column) -> Column:
        of_rule = (("risk_type", risk_type), ("severity", severity), ("freq", freq), ("base", packs.CONFIDENCE[severity]), ("explanation", why))
        return F.struct(F.lit(k).alias("rule_ord"), i.alias("match_ord"), *[F.lit(v).alias(n) for n, v in of_rule], m.alias("keyword"))

    stems = needed(pattern)
    some = F.lit(not stems)
    for stem in stems:
        some = some | F.contains(low, F.lit(stem))
    none = F.array().cast("array<string>")
    return F.transform(F.when(some, F.regexp_extract_all(clause, F.lit("(?iu)" + pattern), F.lit(0))).otherwise(none), found)


def rule_scan(clauses: DataFrame, clause: str = "clause", rules: list[tuple] | None = None) -> DataFrame:
    """One row for each match of each rule in each clause, with keyword, snippet and confidence.

    Rules become one array expression with literal patterns, so each is compiled once and no cross join is made; a
    clause without matches makes no row. rule_ord and match_ord keep the order of finds. A null clause has none.
    """
    rules = rules if rules is not None else packs.rule_rows()
    # letters that fold to s and i without being their capitals
    low = F.translate(F.lower(F.col(clause)), "ſıİ", "sii")
    found = [_matches(F.col(clause), F.col("__low"), *rule) for rule in rules]
    hits = clauses.withColumn("__low", low).withColumn("__hit", F.explode(F.flatten(F.array(*found)))).select(*clauses.columns, "__hit.*")
    boost = tfidf_boost(F.col("keyword"), F.col(clause), F.col("freq"))
    score = F.bround(F.least(F.lit(1.0), F.col("base") + boost * 0.15), 3)
    return hits.withColumns({"snippet": text.snippet(F.col(clause)), "score": score, "source": F.lit("regex")}).drop("freq", "base")


def to_places(x: Column, digits: int) -> Column:
    """`x` rounded half to even by its decimal value: what floating point leaves within a millionth of the last place is
    no part of it, so 0.7495 is a tie however it came about, and goes to 0.75."""
    scale = 10**digits
    return F.bround(F.round(x * F.lit(float(scale)), 6), 0) / F.lit(float(scale))


def _fused(finds: DataFrame, keys: list) -> DataFrame:
    """Finds with the same `keys` as one. `first` tells the primary ones from the semantic ones, which are at most one for
    a key; of the former the first one's snippet, the highest score and severity and all keywords in order count."""
    of = lambda x, first=True: F.when(F.col("first") == first, x)
    rank = severity_rank(F.col("severity"))
    j = finds.groupBy(*keys).agg(
        F.min_by("snippet", of(F.col("ord"))).alias("p_snippet"), F.max(of(F.col("score"))).alias("p_score"), F.max(of(rank)).alias("p_rank"), F.min_by("source", of(F.col("ord"))).alias("p_source"), F.min(of(F.col("ord"))).alias("p_ord"),
        F.transform(F.array_sort(F.collect_list(of(F.struct("ord", "keyword")))), lambda x: x["keyword"]).alias("p_words"),
        F.max(of(F.col("snippet"), False)).alias("s_snippet"), F.max(of(F.col("score"), False)).alias("s_score"), F.max(of(rank, False)).alias("s_rank"), F.max(of(F.col("keyword"), False)).alias("s_word"), F.min(of(F.col("ord"), False)).alias("s_ord"),
        F.max("similarity").alias("similarity"),
    )
    names = [k for k in j.columns if k[:2] not in ("p_", "s_") and k != "similarity"]
    both = F.col("p_score").isNotNull() & F.col("s_score").isNotNull()
    score = F.when(both, to_places(F.least(F.lit(1.0), 0.55 * F.col("p_score") + 0.45 * F.col("s_score") + 0.08), 3)).otherwise(F.coalesce("p_score", "s_score"))
    best = F.when(both & (F.col("p_rank") == 2) & (F.col("s_score") >= 0.65), 3).otherwise(F.coalesce("p_rank", "s_rank"))
    listed = F.array_compact(F.concat("p_words", F.array("s_word")))
    unique = F.filter(F.transform(listed, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_position(F.transform(listed, F.lower), F.lower(x["w"])) == x["i"] + 1)
    return j.select(
        *names, F.coalesce("p_snippet", "s_snippet").alias("snippet"), score.alias("score"), F.element_at(F.array(*map(F.lit, packs.SEVERITIES)), best.cast("int")).alias("severity"),
        F.when(both, F.transform(unique, lambda x: x["w"])).otherwise(listed).alias("words"),
        F.when(both, "both").when(F.col("p_score").isNotNull(), F.col("p_source")).otherwise("semantic").alias("source"), "similarity", F.coalesce("p_ord", "s_ord").alias("ord"),
    )


def hybrid_merge(primary: DataFrame, semantic: DataFrame, keys: tuple[str, ...] = ("clause_idx", "risk_type")) -> DataFrame:
    """Primary and semantic finds merged on clause and category.

    Several primary finds of a key become one: the first one's snippet, the highest score and severity, all keywords
    in order. Where both sides have the key, the score is min(1, .55 p + .45 s + .08) to three places, see to_places();
    keywords are joined without case-insensitive repeats, and Medium becomes High from a similarity of 0.65 on. Both
    sides meet in one aggregation, so each is read once.
    """
    columns = [*keys, "snippet", "score", "severity", "keyword", "source", "similarity", "ord", "first"]
    p = primary.withColumns({"source": F.lit("regex"), "similarity": F.lit(None).cast("double"), "first": F.lit(True)}).select(*columns)
    s = semantic.withColumns({"source": F.lit("semantic"), "ord": F.lit(None).cast("long"), "first": F.lit(False)}).select(*columns)
    out = _fused(p.unionByName(s), list(keys))
    return out.withColumns({"keywords": F.concat_ws("|", "words"), "source": F.when(F.col("source") == "both", "regex+semantic").otherwise(F.col("source"))}).drop("words")


def unlike(sets: list[list[str]], threshold: float) -> list[int]:
    """Positions of the sets that are not similar to one kept before: Jaccard similarity below the threshold.

    A similar set shares at least threshold * n of a set's n words, so that it has one of the first
    n - threshold * n + 1 in any order common to all sets. Sets are looked for by these words only, the rarest first.
    """
    seen = Counter(w for s in sets for w in s)
    rank = {w: i for i, w in enumerate(sorted(seen, key=lambda w: (seen[w], w)))}
    held: dict[int, set[int]] = {}
    having: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        own = {rank[w] for w in s}
        n = len(own)
        first = sorted(own)[: n + 1 - max(1, min(n, math.ceil(threshold * n - 1e-6)))]
        near = held if threshold <= 0 else dict.fromkeys(j for w in first for j in having.get(w, ()))
        for j in near:
            m = len(held[j])
            if n + m > 0 and min(n, m) >= threshold * max(n, m):
                both = len(own & held[j])
                if both / (n + m - both) >= threshold:
                    break
        else:
            held[i] = own
            for w in first:
                having.setdefault(w, []).append(i)
    return list(held)


def greedy_dedup(risks: DataFrame, group: str | tuple[str, ...], order: str, severity: str = "severity", body: str = "snippet", threshold: float = 0.7) -> DataFrame:
    """Of each group's risks, by severity downward and then `order`, those whose words are not similar to those of
    one kept before: Jaccard similarity of lower-case word sets below the threshold. Empty sets are never duplicates.

    One shuffle brings a group's risks together; the fold takes the words of all of them in one row. A group is a
    document's findings.
    """
    ship(risks.sparkSession)
    keys = (group,) if isinstance(group, str) else group
    listed = risks.groupBy(F.struct(*keys).alias("__g")).agg(F.collect_list(F.struct(*risks.columns)).alias("risks"))
    # words have no white space in them, and one string a set is read faster than an array
    words = lambda x: F.array_join(F.array_distinct(text.words(F.lower(F.coalesce(x[body], F.lit(""))))), " ")
    item = lambda x, i: F.struct((-severity_rank(x[severity])).alias("s"), x[order].alias("o"), words(x).alias("w"), i.alias("i"))
    listed = listed.select("risks", F.array_sort(F.transform("risks", item)).alias("items"))
    listed = listed.select("risks", F.col("items.w").alias("w"), F.col("items.i").alias("i"))

    @F.arrow_udf("array<int>")
    def fold(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, places in batches:
            kept = ([at[k] for k in unlike([t.split(" ") if t else [] for t in w.as_py()], threshold)] for w, at in ((w, p.as_py()) for w, p in zip(texts, places, strict=True)))
            yield pa.array(kept, pa.list_(pa.int32()))

    # the worker sees the words alone and says which places stay
    kept = F.transform(F.col("kept"), lambda k: F.get("risks", k))
    return listed.select("risks", fold("w", "i").alias("kept")).select(F.inline(kept))


def escalate(risks: DataFrame, group: tuple[str, ...] = ("doc_id", "clause_idx")) -> DataFrame:
    """In clauses with a High risk and two categories, Medium becomes High and gains 0.05; marked by `escalated`."""
    w = Window.partitionBy(*group)
    cross = (F.count_if(F.col("severity") == "High").over(w) >= 1) & (F.min("risk_type").over(w) != F.max("risk_type").over(w))
    hit = cross & (F.col("severity") == "Medium")
    return risks.withColumns({"escalated": hit, "severity": F.when(hit, "High").otherwise(F.col("severity")), "score": F.when(hit, F.least(F.lit(1.0), F.bround(F.col("score") + 0.05, 3))).otherwise(F.col("score"))})


def finalize(risks: DataFrame) -> DataFrame:
    """The score from 0 to 100 with its band and features, from severity, sources, similarity and confidence.

    `source` is regex, semantic, both, ml_strong (confidence from 0.75) or ml_weak; unknown categories weigh as pure
    ambiguity. Rounding is half to even throughout.
    """
    severity, source = F.col("severity"), F.col("source")
    base = F.when(severity == "Low", packs.INTENSITY["Low"]).when(severity == "Medium", packs.INTENSITY["Medium"]).when(severity == "High", packs.INTENSITY["High"]).otherwise(55)
    evidence = F.when(source == "both", 12).when(source == "ml_strong", 6).when((source == "semantic") & (F.coalesce("similarity", F.lit(0.0)) < 0.58), -12).otherwise(0)
    echo = F.bround(F.greatest(F.lit(0.0), F.coalesce("score", F.lit(0.0)) - 0.6) * 10, 0).cast("int")
    primary = F.least(F.lit(100), F.greatest(F.lit(0), base + evidence + echo + F.when(F.col("escalated"), 8).otherwise(0)))
    out = risks.withColumn("primary", primary)
    weights = {f: F.lit(0.0) for f in packs.FEATURES}
    known = F.col("risk_type").isin(*packs.WEIGHTS)
    for f in packs.FEATURES:
        w = F.when(~known, 1.0 if f == "ambiguity" else 0.0)
        for t, of in packs.WEIGHTS.items():
            w = w.when(F.col("risk_type") == t, of.get(f, 0.0))
        weights[f] = w
    features = {f: F.when(w > 0, F.bround(F.col("primary") * (F.lit(0.6) + 0.4 * w), 0).cast("int")).otherwise(0) for f, w in weights.items()}
    out = out.withColumns({f"f_{f}": c for f, c in features.items()})
    total = sum((F.col(f"f_{f}") * weights[f] for f in packs.FEATURES), F.lit(0.0))
    out = out.withColumn("score100", F.least(F.lit(100), F.greatest(F.lit(0), F.bround(F.bround(total, 6), 0).cast("int"))))
    return out.withColumn("band", band(F.col("score100")))


def band(score: Column) -> Column:
    return F.when(score >= 70, "High").when(score >= 40, "Medium").otherwise("Low")


def overall_risk(docs: DataFrame, risks: DataFrame, score: str = "score100", id_col: str = "doc_id") -> DataFrame:
    """The band of the mean of a document's three highest scores; Low without risks."""
    top = risks.withColumn("__r", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(score)))).where("__r <= 3")
    mean = top.groupBy(id_col).agg(F.bround(F.avg(score), 0).cast("int").alias("overall_score"))
    return docs.select(id_col).distinct().join(mean, id_col, "left").select(id_col, F.coalesce("overall_score", F.lit(0)).alias("overall_score"), F.when(F.col("overall_score").isNull(), "Low").otherwise(band(F.col("overall_score"))).alias("overall_level"))


def clause_offsets(sections: DataFrame) -> DataFrame:
    """Where each section's clauses start in the document: the sum of (largest clause with a risk + 1) before it."""
    w = Window.partitionBy("doc_id").orderBy("sec").rowsBetween(Window.unboundedPreceding, -1)
    return sections.withColumn("offset", F.coalesce(F.sum(F.coalesce(F.col("max_idx") + 1, F.lit(0))).over(w), F.lit(0)))


LAYERS = ("regex", "ml", "semantic", "merge")


def ml_finds(classified: DataFrame) -> DataFrame:
    """What a classifier says of clauses (doc_id, clause_idx, risk_type, severity, confidence) as finds: the score is the
    mean of the severity's confidence and the classifier's."""
    base = F.lit(0.55)
    for severity, c in packs.CONFIDENCE.items():
        base = F.when(F.col("severity") == severity, c).otherwise(base)
    source = F.when(F.col("confidence") >= 0.75, "ml_strong").otherwise("ml_weak")
    return classified.withColumns({"score": F.bround(0.5 * base + 0.5 * F.col("confidence"), 3), "source": source})


def _concatenated(primary: DataFrame, semantic: DataFrame | None) -> DataFrame:
    """Finds in order: the primary ones and then the semantic ones."""
    if semantic is None:
        return primary
    return primary.unionByName(semantic)


def _merged(primary: DataFrame, semantic: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The finds of documents that have both kinds, merged by clause and category; the finds of others are as they were.

    One shuffle by document: a window tells which have both kinds, and finds of the others are groups of their own.
    """
    rows = primary.withColumn("first", F.lit(True)).unionByName(semantic.withColumn("first", F.lit(False)))
    kinds = Window.partitionBy(*keys)
    both = F.bool_or("first").over(kinds) & F.bool_or(~F.col("first")).over(kinds)
    out = _fused(rows.withColumn("alone", F.when(~both, F.col("ord"))), [*keys, "clause_idx", "risk_type", "alone"])
    return out.select(*keys, "clause_idx", "risk_type", "severity", "score", "similarity", "source", "snippet", "words", "ord")


def analyze_clauses(clauses: DataFrame, layers: tuple[str, ...] | None = None, classified: DataFrame | None = None, semantic: DataFrame | None = None, keys: tuple[str, ...] = ("doc_id",), threshold: float | None = 0.7) -> DataFrame:
    """R8 from clauses (keys, clause_idx, clause) on: a row for each risk that is left, with its rank by score in `rank`.

    Without `layers` all of them are on: the classifier's finds are the primary ones where there are any to give, else
    the rules'. Named layers run each by itself; an unknown one is an error, none at all leave nothing. `classified`
    holds what a classifier says (keys, clause_idx, risk_type, severity, confidence), `semantic` similar clauses (keys,
    clause_idx, risk_type, severity, score, similarity, keyword, snippet), one a clause and category. A layer whose finds
    are not given finds nothing. "merge" joins both kinds where a document has both, and escalates. `threshold` is that of
    greedy_dedup(); with None nothing is taken for a copy.
    """
    if layers is not None and (unknown := set(layers) - set(LAYERS)):
        raise ValueError(f"unknown layers: {sorted(unknown)}")
    active = set(LAYERS if layers is None else layers)
    if layers is None:
        active -= {"regex"} if classified is not None else {"ml"}
    named = [*keys, "clause_idx", "risk_type", "severity", "score", "similarity", "source", "snippet", "keyword", "ord"]
    none = F.lit(None).cast("double")
    place = F.shiftleft(F.col("clause_idx").cast("long"), 35)  # below it 13 bits for rules and 22 for their matches
    rules = rule_scan(clauses.where(F.lit("regex" in active)))
    primary = rules.withColumns({"similarity": none, "ord": F.lit(1 << 60) + place + F.shiftleft(F.col("rule_ord").cast("long"), 22) + F.col("match_ord")}).select(*named)
    if "ml" in active and classified is not None:
        body = clauses.select(*keys, "clause_idx", text.snippet(F.col("clause")).alias("snippet"))
        found = ml_finds(classified).join(body, [*keys, "clause_idx"])
        # the classifier's finds stand before the rules', in the order of categories
        of = F.array_position(F.array(*map(F.lit, packs.RULES)), F.col("risk_type"))
        primary = primary.unionByName(found.withColumns({"similarity": none, "keyword": F.lit(None).cast("string"), "ord": place + of}).select(*named))
    similar = None
    if "semantic" in active and semantic is not None:
        of = F.array_position(F.array(*map(F.lit, packs.RULES)), F.col("risk_type"))
        similar = semantic.withColumns({"source": F.lit("semantic"), "ord": F.lit(1 << 61) + place + of}).select(*named)
    if "merge" in active and similar is not None:
        found = _merged(primary, similar, keys)
    else:
        found = _concatenated(primary, similar).withColumn("words", F.array_compact(F.array("keyword"))).drop("keyword")
    if threshold is not None:
        found = greedy_dedup(found, keys, "ord", threshold=threshold)
    found = escalate(found, (*keys, "clause_idx")) if "merge" in active else found.withColumn("escalated", F.lit(False))
    from clauselake.operators import extract

    out = extract.explained(finalize(found), "words").withColumnRenamed("why", "explanation")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score100"), "ord")))


def analyze(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", layers: tuple[str, ...] | None = None, classifier=None, semantic=None) -> DataFrame:
    """Clauses, finds, merge, de-duplication, escalation, scores and explanations of each document.

    `classifier` and `semantic` are functions that take the clauses (doc_id, clause_idx, clause) and give the tables that
    analyze_clauses() takes, or such tables. A null or empty text has no clauses.
    """
    clauses = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(text.clauses(F.col(text_col))).alias("clause_idx", "clause"))
    given = [f(clauses) if callable(f) else f for f in (classifier, semantic)]
    return analyze_clauses(clauses, layers, *given)


def analyze_document(docs: DataFrame, layers: tuple[str, ...] | None = None, threshold: float = 0.7, **sections: int) -> DataFrame:
    """Each section of a document (doc_id, text) is analyzed by itself; clause numbers go on from section to section;
    a last de-duplication takes the whole document, and `rank` its scores. `section` is the header, null without one."""
    from clauselake.functions import chunking

    cut = materialize(chunking.section_documents(docs, **sections), "sections")
    clauses = cut.select("doc_id", "sec", F.posexplode(text.clauses(F.col("text"))).alias("clause_idx", "clause"))
    # read three times below
    found = materialize(analyze_clauses(clauses, layers, keys=("doc_id", "sec"), threshold=threshold), "section-finds")
    top = found.groupBy("doc_id", "sec").agg(F.max("clause_idx").alias("max_idx"))
    starts = clause_offsets(cut.select("doc_id", "sec").join(top, ["doc_id", "sec"], "left")).select("doc_id", "sec", "offset")
    heads = cut.select("doc_id", "sec", F.nullif(F.col("header"), F.lit("")).alias("section"))
    j = found.join(starts, ["doc_id", "sec"]).join(heads, ["doc_id", "sec"])
    j = j.withColumns({"clause_idx": F.col("clause_idx") + F.col("offset"), "place": F.col("sec") * 1_000_000 + F.col("rank")}).drop("offset", "rank")
    left = greedy_dedup(j.withColumn("level", F.col("severity")).withColumn("severity", F.col("band")), "doc_id", "place", threshold=threshold)
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score100"), "place"))).drop("place", "level")


def shown(risks: DataFrame, chosen: str = "all") -> DataFrame:
    """F8: the risks of a chosen band; all of them for "all"."""
    return risks if chosen == "all" else risks.where(F.col("band") == chosen)


def by_severity(risks: DataFrame, keys: tuple[str, ...], order: str = "ord") -> DataFrame:
    """The risks of each paragraph with `place`, by severity downward and then in their order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(severity_rank(F.col("severity"))), order)
    return risks.withColumn("place", F.row_number().over(w))
