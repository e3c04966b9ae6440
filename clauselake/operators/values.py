"""Typed values in clauses: choices, numbers and names with the places that they stand at.

A value is a row of RULES: the field of a clause type, what it is worth, a pattern of evidence, what has to stand in the
same sentence, and what must not. The first sentence with evidence for a field decides, in it the first rule. Rules become
column expressions over the sentences of a clause, so that all fields of all types come from one scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions import text

# Number words.
_UNITS = "one two three four five six seven eight nine".split()
_TEENS = "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
#: Numbers by their words, up to 99.
NUMBERS = {w: i for i, w in enumerate([*_UNITS, *_TEENS], 1)} | {t: 20 + 10 * i for i, t in enumerate(_TENS)} | {f"{t}-{u}": 20 + 10 * i + k for i, t in enumerate(_TENS) for k, u in enumerate(_UNITS, 1)}
#: A number in digits or words, perhaps with the digits behind in brackets; its three groups are the only ones of a pattern.
NUMBER = rf"(?:\b([0-9]{{1,4}})|\b((?:{'|'.join(_TENS)})(?:-(?:{'|'.join(_UNITS)}))?|{'|'.join([*_TEENS, *_UNITS])}))(?:\s*\(\s*([0-9]{{1,4}})\s*\))?"
_DAYS = NUMBER + r"\s*(?:business |calendar |consecutive )?days?['’]?"
_PARTY = {"provider": "provider|contractor|consultant|vendor|developer|supplier|licensor|employee", "customer": "customer|client|licensee|buyer|purchaser|subscriber"}


@dataclass(frozen=True)
class Rule:
    """value: what the evidence says; None takes the number in it, or the name in its one group. Evidence is looked for
    without case, names with it, as they begin with a capital."""

    clause_type: str
    field: str
    value: str | None
    pattern: str
    needs: str = ""
    guard: str = ""
    kind: str = "choice"


_CAP = r"(?:not|never) exceed|limited to|maximum (?:aggregate )?liability|capped at"
_PLACE = r"(?:[A-Z][\w'’.-]*)(?:(?: and| of|,)? [A-Z][\w'’.-]*)*"


def _rules() -> list[Rule]:
    cap = dict(needs=_CAP, guard="insur|coverage limit|policy limit")
    out = [
        Rule("liability", "cap_type", "multiple_of_fees", r"(?:two|three|four|five|ten|[0-9]+)(?: \([0-9]+\))? ?(?:times|x) [^.]{0,60}(?:fees|amounts?)", **cap),
        Rule("liability", "cap_type", "fees_paid_period", r"(?:fees|amounts?|sums?)[^.]{0,40}(?:paid|payable|received)[^.]{0,80}(?:months?|year|period|term|preceding)", **cap),
        Rule("liability", "cap_type", "per_incident", r"per (?:incident|occurrence|claim|event)", **cap),
        Rule("liability", "cap_type", "fixed_amount", r"(?:\$|€|£|usd|eur) ?[0-9]", **cap),
        Rule("liability", "cap_type", "other", _CAP, needs="liabil", guard=cap["guard"]),
        Rule("termination", "convenience_termination_who", "either_party", r"(?:either|any|each) party[^.]{0,60}terminat", needs="for convenience|without cause|at any time|for any reason"),
        Rule("termination", "convenience_termination_who", "customer_only", rf"(?:{_PARTY['customer']})[^.]{{0,40}} may\b[^.]{{0,60}}terminat", needs="for convenience|without cause|at any time|for any reason"),
        Rule("termination", "convenience_termination_who", "provider_only", rf"(?:{_PARTY['provider']})[^.]{{0,40}} may\b[^.]{{0,60}}terminat", needs="for convenience|without cause|at any time|for any reason"),
        Rule("termination", "cure_days", None, r"(?:cure|remed)[^.]{0,60}?" + _DAYS, kind="number"),
        Rule("termination", "cure_days", None, _DAYS + r"[^.]{0,80}(?:to|and|not) (?:be(?:en)? )?(?:cured?|remed)", kind="number"),
        Rule("termination", "notice_days", None, _DAYS + r"\s*(?:prior |advance |written |of )*notice", kind="number"),
        Rule("termination", "notice_days", None, r"notice (?:of |period of )?(?:at least |not less than |no less than |no fewer than )?" + _DAYS, kind="number", guard="cure|remed"),
        Rule("payment", "payment_days", "0", r"due (?:and payable )?(?:up)?on receipt", kind="number"),
        Rule("payment", "payment_days", None, r"\bnet[ -]" + NUMBER, kind="number"),
        Rule("payment", "payment_days", None, r"within " + _DAYS + r"[^.]{0,40}(?:invoice|receipt)", kind="number", guard="dispute"),
        *(Rule("payment", "invoice_frequency", v, rf"(?:invoic|bill|payable|paid|fees)[^.]{{0,60}}\b(?:{p})|\b(?:{p})[^.]{{0,40}}(?:invoic|bill)") for v, p in (("monthly", "monthly|each month|per month in arrears"), ("quarterly", "quarterly|each quarter"), ("annually", "annually|yearly|each year"), ("upfront", "up-?front|in advance"), ("upon_delivery", "(?:up)?on delivery"))),
        Rule("payment", "late_fee_type", "interest_rate", r"interest|per annum|% per month|percent per month", needs="late|overdue|past due|unpaid"),
        Rule("payment", "late_fee_type", "percentage", r"[0-9] ?%|percent", needs="(?:late|overdue|past due)[^.]{0,60}(?:fee|charge)|(?:fee|charge)[^.]{0,60}(?:late|overdue|past due)"),
        Rule("payment", "late_fee_type", "flat_fee", r"(?:\$|€|£|usd|eur) ?[0-9]", needs="(?:late|overdue|past due)[^.]{0,60}(?:fee|charge)|(?:fee|charge)[^.]{0,60}(?:late|overdue|past due)"),
        Rule("payment", "late_fee_type", "other", r"late (?:payment )?(?:fee|charge)s?"),
        Rule("confidentiality", "duration_years", None, NUMBER + r"\s*years?", needs="confiden|obligation|disclos|surviv", guard="perpetual|indefinite", kind="number"),
        Rule("ip", "assignment_direction", "mutual", r"(?:each|either) party (?:hereby )?(?:irrevocably )?(?:shall )?assign"),
        Rule("ip", "assignment_direction", "provider_to_customer", rf"(?:{_PARTY['provider']})[^.]{{0,30}}(?:hereby|shall|does|irrevocably)[^.]{{0,30}}assign", guard="may not assign|not assign|assign this agreement"),
        Rule("ip", "assignment_direction", "customer_to_provider", rf"(?:{_PARTY['customer']})[^.]{{0,30}}(?:hereby|shall|does|irrevocably)[^.]{{0,30}}assign", guard="may not assign|not assign|assign this agreement"),
        Rule("ip", "license_scope", "non_exclusive", r"non-?exclusive", needs="licen[sc]e"),
        Rule("ip", "license_scope", "exclusive", r"\b(?:exclusive|sole)\b", needs="grants?[^.]{0,80}licen[sc]e|licen[sc]e[^.]{0,40}grant"),
        Rule("governing_law", "governing_law_jurisdiction", None, rf"(?:laws?|Laws?|LAWS?) (?:in force in|in effect in|of|OF) (?:the |THE )?(?:(?:State|Commonwealth|Province|Republic|STATE) (?:of|OF) )?({_PLACE})", kind="name"),
        *(Rule("governing_law", "arbitration_body", v, p, needs="arbitrat") for v, p in (("AAA", r"american arbitration association|\baaa\b"), ("JAMS", r"\bjams\b"), ("ICC", r"international chamber of commerce|\bicc\b"), ("LCIA", r"london court of international arbitration|\blcia\b"), ("SIAC", r"singapore international arbitration|\bsiac\b"))),
        Rule("governing_law", "venue_exclusivity", "non_exclusive", r"non-?exclusive", needs="jurisdiction|venue|courts?"),
        Rule("governing_law", "venue_exclusivity", "exclusive", r"\bexclusive(?:ly)?\b|\bsole(?:ly)?\b", needs="jurisdiction|venue|courts?"),
    ]
    return out


RULES = _rules()


def number(s: Column, pattern: str) -> Column:
    """The number in a match: its digits in brackets, its digits, or what its word stands for."""
    group = lambda k: F.nullif(F.regexp_extract(s, pattern, k), F.lit(""))
    known = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])
    return F.coalesce(group(3).cast("int"), group(1).cast("int"), F.try_element_at(known, F.lower(group(2))))


def _evidence(s: Column, rule: Rule) -> Column:
    """What a rule finds in a sentence, or null: value, and where the evidence begins and ends in the sentence."""
    pattern = rule.pattern if rule.kind == "name" else "(?iu)" + rule.pattern
    hit = F.rlike(s, F.lit(pattern))
    if rule.needs:
        hit &= F.rlike(s, F.lit("(?iu)" + rule.needs))
    if rule.guard:
        hit &= ~F.rlike(s, F.lit("(?iu)" + rule.guard))
    value = F.lit(rule.value) if rule.value is not None else F.regexp_replace(F.regexp_extract(s, pattern, 1), r"[.,]+$", "") if rule.kind == "name" else number(s, pattern).cast("string")
    at = F.regexp_instr(s, F.lit(pattern))
    return F.when(hit, F.struct(value.alias("value"), (at - 1).alias("start"), (at - 1 + F.length(F.regexp_substr(s, F.lit(pattern)))).alias("end"), s.alias("quote")))


def _first(sentences: Column, rules: list[Rule]) -> Column:
    """The evidence of the first sentence that has any for one of the rules."""
    found = F.transform(sentences, lambda x: F.coalesce(*[_evidence(x, r) for r in rules]))
    return F.try_element_at(F.filter(found, lambda e: e["value"].isNotNull()), F.lit(1))


def extract_values(clauses: DataFrame, body: str = "clause", type_col: str = "clause_type", rules: list[Rule] | None = None) -> DataFrame:
    """A row for each typed field of a clause's type with its value (a choice, a number as text or a name), the sentence
    that speaks for it as `quote`, and where its evidence stands in the clause: `start` and `end`, in characters.

    Fields without evidence have nulls, as have those of null and empty clauses; a duration without end is null too.
    Clauses of unknown or null types have no rows. Quotes are verbatim, so that a quote's place is that of its first
    occurrence. All types and fields come from one scan without a shuffle; names of other columns do not matter.
    """
    rules = RULES if rules is None else rules
    keep = clauses.columns
    s = F.coalesce(text.sentences(F.col("__body")), F.array().cast("array<string>"))
    by_type = F.lit(None)
    for t in dict.fromkeys(r.clause_type for r in rules):
        fields = []
        for f in dict.fromkeys(r.field for r in rules if r.clause_type == t):
            own = [r for r in rules if (r.clause_type, r.field) == (t, f)]
            fields.append(F.struct(F.lit(f).alias("field"), _first(F.col("__sentences"), own).alias("e")))
        by_type = F.when(F.col(type_col) == t, F.array(*fields)).otherwise(by_type)
    found = clauses.withColumn("__body", F.col(body)).withColumn("__sentences", s).withColumn("__f", F.explode(by_type))
    place = F.instr(F.col("__body"), F.col("__f.e.quote")) - 1
    return found.select(*keep, "__f.field", "__f.e.value", "__f.e.quote", (place + F.col("__f.e.start")).alias("start"), (place + F.col("__f.e.end")).alias("end"))
