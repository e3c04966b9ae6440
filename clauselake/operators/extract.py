"""Structured extraction: prompts, back ends, JSON from answers, and a rule-based default."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions import packs, text
from clauselake.session import ship

# Evidence for each boolean field, as patterns over a sentence; written from the meaning of the fields.
EVIDENCE: dict[str, dict[str, str]] = {
    "liability": {"has_cap": r"liability.{0,120}(not exceed|limited to|maximum)|(not exceed|maximum).{0,80}liabilit", "is_mutual": r"either party|neither party|each party's|both parties", "has_carve_outs": r"shall not apply to|except for|excluding", "consequential_excluded": r"(not|no).{0,40}liable.{0,80}(indirect|consequential|incidental|special)", "has_indemnification": r"indemnif|hold harmless", "has_warranty_disclaimer": r"as is\b|(no|without) warrant|disclaim.{0,60}warrant"},
    "termination": {"has_termination_for_cause": r"terminat.{0,120}(breach|default|insolven)", "has_termination_for_convenience": r"terminat.{0,120}(for convenience|without cause|at any time)", "has_cure_period": r"\b(cure|remedy)\b.{0,60}days|days.{0,60}\b(cure|remedy)\b", "has_notice_period": r"\d+\)? days.{0,20}notice|notice.{0,40}\d+\)? days", "has_auto_renewal": r"automatically renew|successive", "has_survival_clause": r"shall survive|survive.{0,20}terminat", "has_post_termination_obligations": r"(upon|following) (the )?(termination|expiration)", "has_termination_fee": r"(early termination|cancellation) (fee|charge|penalty)"},
    "payment": {"has_payment_terms": r"net \d+|within .{0,20}days|due upon receipt", "has_late_fee": r"(late|overdue|past due).{0,80}(interest|fee|charge)", "has_price_escalation": r"(may|shall) (increase|adjust).{0,40}(price|fee|rate)|(price|fee|rate)s?.{0,40}(may|shall) (be )?(increase|adjust)", "has_non_refundable": r"non.?refundable", "has_minimum_commitment": r"minimum (purchase|commitment|order|spend|fee)", "has_dispute_process": r"disput.{0,60}invoice|invoice.{0,60}disput", "has_right_of_setoff": r"set.?off|offset"},
    "confidentiality": {"has_broad_definition": r"any and all information|all (non-public )?information", "has_standard_exclusions": r"public domain|independently developed|publicly (known|available)", "has_duration": r"\d+\)? years|perpetual|indefinite", "has_permitted_disclosures": r"disclose.{0,80}(employees|affiliates|advis|contractors|representatives)", "has_return_or_destroy": r"return or destroy|return.{0,40}destr", "has_residuals_clause": r"residual", "has_injunctive_relief": r"irreparable|injunctive", "is_mutual": r"each party|both parties|either party"},
    "ip": {"has_customer_owns_deliverables": r"(customer|client) (shall )?(owns?|retains?)", "has_provider_owns_deliverables": r"(provider|vendor|company|licensor) (shall )?(owns?|retains?)", "has_pre_existing_ip_carveout": r"pre-existing|background (ip|intellectual)", "has_work_for_hire": r"work.(made.)?for.hire", "has_ip_assignment": r"hereby assigns?", "has_license_grant": r"grants?.{0,60}licen[sc]e", "has_feedback_clause": r"feedback", "has_source_code_escrow": r"escrow", "has_non_compete": r"non.?compet"},
    "governing_law": {"has_governing_law": r"governed by.{0,60}laws?|laws of .{0,60}govern|construed .{0,60}laws of", "has_venue_selection": r"courts? (located )?(in|of)|jurisdiction of|venue", "has_arbitration": r"arbitrat", "has_jury_waiver": r"waive.{0,120}jury|jury.{0,60}waive", "has_class_action_waiver": r"waive.{0,120}class|class action waiver|individual basis only", "has_prevailing_party_fees": r"(prevailing|successful) party.{0,160}(fees|costs)|(fees|costs).{0,80}prevailing party"},
}
#: Fields that only count where another one does, by clause type.
ONLY_WITH = {"liability": {"is_mutual": ("has_cap", "consequential_excluded"), "has_carve_outs": ("has_cap", "consequential_excluded")}}


#: What must not stand in the sentence that speaks for a field.
GUARDS = {"liability": {"has_cap": "insur"}, "termination": {"has_termination_fee": "accrued"}, "payment": {"has_dispute_process": "arbitrat"}}


def found(sentences: Column, pattern: str, guard: str = "") -> Column:
    """The first sentence with the pattern and without the guard, word for word."""
    hit = lambda s: F.rlike(s, F.lit("(?iu)" + pattern)) & ~F.rlike(s, F.lit("(?iu)" + guard)) if guard else F.rlike(s, F.lit("(?iu)" + pattern))
    return F.try_element_at(F.filter(sentences, hit), F.lit(1))


def _fields(sentences: Column, clause_type: str) -> dict[str, tuple[Column, Column]]:
    """Each boolean field of the type: whether it holds, and the sentence that speaks for it."""
    quotes = {f: found(sentences, p, GUARDS.get(clause_type, {}).get(f, "")) for f, p in EVIDENCE[clause_type].items()}
    for f, others in ONLY_WITH.get(clause_type, {}).items():
        some = F.lit(False)
        for o in others:
            some = some | quotes[o].isNotNull()
        quotes[f] = F.when(some, quotes[f])
    return {f: (q.isNotNull(), q) for f, q in quotes.items()}


def extract_fields(clauses: DataFrame, clause_type: str, body: str = "clause") -> DataFrame:
    """X2's default: a column for each boolean field of the type and f_source_text, the sentence that speaks for it.

    Everything is a column expression; quotes are verbatim. A null or empty text has false fields and no quotes.
    """
    s = clauses.withColumn("__s", F.coalesce(text.sentences(F.col(body)), F.array().cast("array<string>")))
    out = s.withColumns({f"{f}_source_text": q for f, (_, q) in _fields(F.col("__s"), clause_type).items()})
    return out.withColumns({f: F.col(f"{f}_source_text").isNotNull() for f in EVIDENCE[clause_type]}).drop("__s")


def all_fields(clauses: DataFrame, body: str = "clause", type_col: str = "clause_type") -> DataFrame:
    """X2's default for clauses of all types in one scan: a row for each boolean field of a clause's type with field, value
    and source_text. Clauses of unknown or null types have none; null and empty texts have false fields."""
    keep, by_type = clauses.columns, F.lit(None)
    s = clauses.withColumn("__s", F.coalesce(text.sentences(F.col(body)), F.array().cast("array<string>")))
    for t in EVIDENCE:
        rows = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value"), q.alias("source_text")) for f, (v, q) in _fields(F.col("__s"), t).items()])
        by_type = F.when(F.col(type_col) == t, rows).otherwise(by_type)
    return s.withColumn("__f", F.explode(by_type)).select(*keep, "__f.*")


def as_record(extracted: DataFrame, clause_type: str) -> DataFrame:
    """The fields as a JSON record of the type's shape, in the column `data`."""
    tree: dict = {}
    for f, path in packs.BOOL_FIELDS[clause_type]:
        keys = path[2:].split(".")
        node = tree
        for k in keys[:-1]:
            node = node.setdefault(k, {})
        node[keys[-1]] = F.col(f)

    def build(node: dict) -> Column:
        return F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()])

    return extracted.withColumn("data", F.to_json(build(tree)))


def prompts(clauses: DataFrame, templates: DataFrame, body: str = "clause") -> DataFrame:
    """Each clause with its type's system prompt and template filled in. templates: clause_type, system, template."""
    j = clauses.join(templates, "clause_type", "left")
    return j.withColumn("prompt", F.replace("template", F.lit("{clause_text}"), F.coalesce(F.col(body), F.lit("")))).drop("template")


def json_of(answer: str | None) -> dict | None:
    """The JSON object in a model's answer: all of it, a fenced block, or the first balanced braces."""
    if not answer:
        return None
    fenced = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", answer, re.DOTALL)
    tries = [answer] + ([fenced[1]] if fenced else [])
    at = answer.find("{")
    if at >= 0:
        depth = 0
        for i in range(at, len(answer)):
            depth += (answer[i] == "{") - (answer[i] == "}")
            if depth == 0:
                tries.append(answer[at : i + 1])
                break
    for t in tries:
        try:
            out = json.loads(t)
        except ValueError:
            continue
        if isinstance(out, dict):
            return out
    return None


def validated(record: dict | None, clause: str, expected: set[str], marks: tuple[str, ...] = ()) -> dict | None:
    """Without keys that are not expected; quotes that the clause does not have become null, as does a record that
    repeats a mark of the prompt."""
    if record is None or any(m in json.dumps(record) for m in marks):
        return None

    def checked(x):
        if isinstance(x, dict):
            return {k: (None if k.endswith("source_text") and isinstance(v, str) and v not in clause else checked(v)) for k, v in x.items()}
        return x

    return {k: v for k, v in checked(record).items() if k in expected}


class RateLimited(Exception):
    """A back end's refusal that no further try mends; it ends the job."""


def extract_with(clauses: DataFrame, backend: Callable[[str], str], expected: set[str], id_col: str = "chunk_id", body: str = "clause", tries: int = 3, wait: float = 1.0, marks: tuple[str, ...] = (), threshold: int = 5, recovery: float = 30.0) -> DataFrame:
    """id_col, data, ok, by a back end that answers a prompt with text. It runs in the workers and may fail; it is
    tried again after `wait`, 2 * `wait`, ... seconds, and after `tries` failures data is null. A worker that has seen
    `threshold` failures in a row leaves the back end alone for `recovery` seconds, in which data is null. RateLimited
    is raised on. Control characters are taken out of the clause first; answers that repeat one of `marks` are void."""
    import time

    from clauselake.streaming.state import Breaker

    ship(clauses.sparkSession)

    def one(clause: str | None, breaker: Breaker) -> str | None:
        for k in range(tries):
            if breaker.state == "open" and time.monotonic() - breaker.since < recovery:
                return None
            record = None
            try:
                record = validated(json_of(backend(clause or "")), clause or "", expected, marks)
            except RateLimited:
                raise
            except Exception:  # noqa: BLE001, S110  a back end may raise anything
                pass
            breaker.call(time.monotonic(), record is not None)
            if record is not None:
                return json.dumps(record, sort_keys=True)
            if k + 1 < tries:
                time.sleep(wait * 2**k)
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        breaker = Breaker(threshold, recovery)
        for b in batches:
            data = [one(c, breaker) for c in b["clause"]]
            yield pd.DataFrame({"id": b["id"], "data": data, "ok": [x is not None for x in data]})

    source = clauses.select(F.col(id_col).alias("id"), text.sanitized(F.col(body)).alias("clause"))
    return source.mapInPandas(run, f"id {source.schema['id'].dataType.simpleString()}, data string, ok boolean").withColumnRenamed("id", id_col)


# Strings that choose an explanation, by category, in the order in which they are looked for.
KEYS = {
    "Liability Risk": ("indemnif", "hold harmless", "make whole", "unlimited", "as-is", "as is", "liquidated damages", "force majeure", "consequential", "warranty", "waive", "aggregate liability"),
    "Compliance Risk": ("gdpr", "hipaa", "ccpa", "sox", "pci", "anti-bribery", "fcpa", "sanction", "export control", "must comply", "applicable law", "regulatory", "license", "industry standard"),
    "Privacy/Data Risk": ("personal data", "pii", "sell", "monetize", "share", "third part", "data breach", "breach", "biometric", "track", "cookie", "collect", "retain", "transfer", "encrypt", "opt-out"),
    "Financial Risk": ("automatic renew", "auto-renew", "non-refundable", "early termination", "penalty", "interest", "unilateral", "change", "minimum", "cancellation fee", "setoff", "escrow", "currency"),
    "Contractual Ambiguity": ("sole discretion", "absolute discretion", "discretion", "at any time", "deem", "reasonable", "including but not limited to", "without limitation", "material", "from time to time", "good faith", "continued use", "customary", "generally accepted"),
}
#: What a category's findings are about, in this package's own words.
_ABOUT = {
    "Liability Risk": "who pays for harm, and how much",
    "Compliance Risk": "rules from outside that the parties have to keep",
    "Privacy/Data Risk": "what happens to personal data",
    "Financial Risk": "money that is owed or may become due",
    "Contractual Ambiguity": "a term that one side may read its own way",
}
#: Category, key and text of each explanation; an empty key is the default.
TEMPLATES: list[tuple[str, str, str]] = [(t, k, f"With '{k}' it settles {_ABOUT[t]}." if k else f"It touches on {_ABOUT[t]}.") for t, ks in KEYS.items() for k in (*ks, "")]


def explained(risks: DataFrame, keywords: str = "keywords") -> DataFrame:
    """`why`: the severity, the text of the category's first key that the snippet has, up to three keywords that
    it has as evidence, and where the finding comes from; weak semantic finds say so in front."""
    low = F.lower("snippet")
    body = F.lit(None).cast("string")
    for t in KEYS:
        held = F.lit(None).cast("string")
        for _, key, said in reversed([x for x in TEMPLATES if x[0] == t]):
            held = F.when(F.contains(low, F.lit(key)), said).otherwise(held) if key else F.lit(said)
        body = F.when(F.col("risk_type") == t, held).otherwise(body)
    evidence = F.slice(F.filter(keywords, lambda k: F.contains(low, F.lower(k))), 1, 3)
    weak = (F.col("source") == "semantic") & (F.coalesce("similarity", F.lit(0.0)) < 0.55)
    front = F.when(weak, "Possible match: ").otherwise(F.concat("severity", F.lit(" risk: ")))
    shown = F.when(F.size(evidence) > 0, F.concat(F.lit(" Evidence: "), F.array_join(evidence, ", "), F.lit("."))).otherwise("")
    behind = F.when(F.col("source") == "both", " Found by rule and by similarity.").when(F.col("source") == "semantic", " Found by similarity.").otherwise("")
    return risks.withColumn("why", F.concat(front, F.coalesce(body, F.lit("A risk.")), shown, behind))


def user_field(record: str, field: str, clause_type: str):
    """A field of a user's record, by the path that its type registers, else by its name."""
    path = dict([*packs.BOOL_FIELDS.get(clause_type, []), *packs.CATEGORY_FIELDS.get(clause_type, [])]).get(field, f"$.{field}")
    return F.get_json_object(F.col(record), path)


REDLINES = "struct<suggestions:array<struct<original_text:string,proposed_text:string,justification:string,market_citation:string,risk_addressed:string,priority:string>>,summary:string>"


def redlines(answers: DataFrame, keys: tuple[str, ...], answer: str = "answer") -> DataFrame:
    """A row for each usable suggestion in a model's JSON answers, in their order; a clause whose answer has none
    keeps one row with its summary, and one whose answer is no JSON says that it failed."""
    read = answers.withColumn("__r", F.from_json(F.col(answer), REDLINES))
    usable = F.filter(F.coalesce("__r.suggestions", F.array().cast("array<struct<original_text:string,proposed_text:string,justification:string,market_citation:string,risk_addressed:string,priority:string>>")), lambda s: s.isNotNull() & ((F.coalesce(s["original_text"], F.lit("")) != "") | (F.coalesce(s["proposed_text"], F.lit("")) != "")))
    failed = F.col("__r").isNull() | (F.col("__r.suggestions").isNull() & F.col("__r.summary").isNull())
    summary = F.when(failed, "Redline generation failed. Please try again.").otherwise(F.coalesce("__r.summary", F.lit("")))
    out = read.select(*keys, summary.alias("summary"), F.posexplode_outer(usable).alias("ord", "s"))
    said = lambda c, d="": F.coalesce(F.nullif(F.col(f"s.{c}"), F.lit("")), F.lit(d))
    return out.select(*keys, "summary", "ord", said("original_text").alias("original"), said("proposed_text").alias("proposed"), said("justification").alias("justification"), said("market_citation").alias("citation"), said("risk_addressed").alias("risk"), said("priority", "medium").alias("priority"))
