"""Text functions as Column expressions: cleaning, sentences, clauses, labels, sizes and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauselake.functions.packs import BUDGETS, INJECTIONS, LEXICON, TOKENS_PER_WORD

_SPACES = r"\t[ \t]*| [ \t]+"  # a single space stays as it is
_STRIP = r"(?U)^\s+|\s+$"
# a look at the first letter spares most places the search for a word's edge
_ABBREVIATIONS = r"(?U)(?=[MDPSJveiICNA])\b(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|vs|etc|i\.e|e\.g|Inc|Ltd|Corp|Co|No|Sec|Art)\."


def strip(text: Column) -> Column:
    """Without white space of any kind at either end, which trim() leaves but for spaces."""
    return F.regexp_replace(text, _STRIP, "")


def words(text: Column) -> Column:
    """The words of a text, parted by any white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def clean_text(text: Column) -> Column:
    """Line ends to LF, runs of spaces and tabs to a space, three and more LF to two, stripped."""
    t = F.regexp_replace(text, r"\r\n|\r", "\n")
    t = F.regexp_replace(t, _SPACES, " ")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def sentences(text: Column) -> Column:
    """Cut after . ! ? before a capital, digit or quote, but not after common abbreviations; empty ones dropped."""
    held = F.regexp_replace(text, _ABBREVIATIONS, "$1\u0001")
    cut = F.split(held, r'(?U)\s(?<=[.!?]\s)\s*(?=[A-Z0-9"])')
    return F.filter(F.transform(cut, lambda s: strip(F.replace(s, F.lit("\u0001"), F.lit(".")))), lambda s: s != "")


def clauses(text: Column) -> Column:
    """Sentences of the cleaned text, long ones with semicolons cut there, those under 20 characters dropped."""
    parts = F.flatten(F.transform(sentences(clean_text(text)), lambda s: F.when((F.length(s) > 400) & F.contains(s, F.lit(";")), F.transform(F.split(s, ";"), strip)).otherwise(F.array(s))))
    return F.filter(parts, lambda s: F.length(s) >= 20)


def snippet(text: Column, most: int = 300) -> Column:
    """as it is, or cut to `most` characters with an ellipsis."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most - 3)), F.lit("...")))


def label(line: Column) -> Column:
    """A header line, cut at its first sentence end within 60 characters, else at 60 with an ellipsis."""
    t = strip(line)
    at = F.regexp_instr(t, F.lit(r"[a-z)]\.(?:\s|$)"))
    cut = F.concat(F.regexp_replace(F.left(t, F.lit(60)), r"(?U)\s+$", ""), F.lit("…"))
    return F.when((at > 0) & (at + 1 <= 60), F.left(t, at + 1)).when(F.length(t) <= 60, t).otherwise(cut)


def windows(text: Column, n: int) -> Column:
    """The text's words in groups of n. The array of one binds the words, so that they are cut once."""
    none = F.array().cast("array<string>")
    groups = lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.size(w), F.lit(n)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))).otherwise(none)
    return F.element_at(F.transform(F.array(words(text)), groups), 1)


def context(text: Column, start: Column, end: Column, window: int = 150) -> Column:
    """What stands around [start, end), with ellipses where it is cut."""
    a, b = F.greatest(F.lit(0), start - window), F.least(F.length(text), end + window)
    body = strip(F.substring(text, a + 1, b - a))
    return F.concat(F.when(a > 0, "...").otherwise(""), body, F.when(b < F.length(text), "...").otherwise(""))


def size_level(text: Column, mode: str) -> Column:
    """ok, warn or over, by the mode's word limits."""
    warn, most = BUDGETS[mode]
    n = word_count(text)
    return F.when(n > most, "over").when(n > warn, "warn").otherwise("ok")


def token_estimate(text: Column) -> Column:
    """R9."""
    return (word_count(text) * F.lit(TOKENS_PER_WORD)).cast("int")


def _typed(text: Column, header: Column | None, then) -> Column:
    """then(counts), where counts holds for each type how many of its lexicon's entries the text has. Arrays of one
    bind the lower-case text and the counts to names, so that neither is worked out twice."""
    low = F.lower(F.concat(F.coalesce(header, F.lit("")) if header is not None else F.lit(""), F.lit(" "), F.coalesce(text, F.lit(""))))
    listed = F.array(*[F.array(*map(F.lit, ks)) for ks in LEXICON.values()])
    counts = lambda t: F.transform(listed, lambda ks: F.size(F.filter(ks, lambda k: F.contains(t, k))))
    return F.element_at(F.transform(F.array(low), lambda t: F.element_at(F.transform(F.array(counts(t)), then), 1)), 1)


def clause_type(text: Column, header: Column | None = None) -> Column:
    """The type whose lexicon has most entries in the text; the first of equals; other if none has any."""
    names = F.array(*map(F.lit, LEXICON))
    return _typed(text, header, lambda c: F.when(F.array_max(c) == 0, "other").otherwise(F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))))


def resolved_type(text: Column, requested: Column) -> Column:
    """The type asked for; for "auto" the one detected, liability if there is none."""
    names = F.array(*map(F.lit, LEXICON))
    found = _typed(text, None, lambda c: F.when(F.array_max(c) == 0, "liability").otherwise(F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))))
    return F.when(requested != "auto", requested).otherwise(found)


def sanitized(text: Column) -> Column:
    """Without control and zero-width characters; tab, LF and CR stay."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\u200b\\u200c\\u200d\\u2060\\ufeff]", "")


def injection_flags(text: Column) -> Column:
    """Names of the patterns that a text matches, in their order."""
    return F.filter(F.array(*[F.when(F.rlike(text, F.lit("(?iu)" + p)), F.lit(n)) for n, p in INJECTIONS]), lambda x: x.isNotNull())


def cache_key(text: Column) -> Column:
    """SHA-256 of the text with its white space normalised."""
    return F.sha2(F.array_join(words(text), " "), 256)
