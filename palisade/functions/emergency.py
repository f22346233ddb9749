"""Emergency detection as one column expression.

All phrases sit in one literal array: a row keeps the phrases it contains, and
only those are looked at for word edges and negation, so the plan is small and a
text without any phrase costs a few substring searches.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions import fixed
from palisade.functions.patterns import SPACE_CLASS, jvm, let, matches

RESULT = "struct<is_emergency:boolean,severity:string,category:string,message:string,emergency_contacts:array<string>>"


#: Letters of a word that are looked at from its end: one more than the longest word that negates.
_SHOWN = max(map(len, fixed.NEGATIONS)) + 1
#: A reversed text's last two words, each cut to as many letters, and a character if the text ends outside a word.
_TAIL = rf"(?s)^([^a-z']?)[^a-z']*([a-z']{{0,{_SHOWN}}})[a-z']*[^a-z']*([a-z']{{0,{_SHOWN}}}).*$"

Lexicon = Iterable[tuple[str, str, str]]


def fixed_lexicon() -> list[tuple[str, str, str]]:
    """Rows (category, tier, phrase) of the fixed phrases."""
    return [(c, t, p) for c, tiers in fixed.SIGNALS.items() for t, ps in tiers.items() for p in ps]


def _literal(lexicon: Lexicon) -> Column:
    names = ("category", "tier", "phrase", "pattern")
    rows = [(c, t, p, jvm(rf"\b{re.escape(p)}\b", True)) for c, t, p in lexicon]
    return F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r))) for r in rows))


def _tail(prefix: Column) -> Column:
    """What of a text can still matter to a negation after it: the ends of its last two words, and whether it ends within the last."""
    return F.reverse(F.regexp_replace(F.reverse(prefix), _TAIL, "$1$2 $3"))


def _negated(tail: Column) -> Column:
    """Whether one of the last two words before a match negates it."""
    return F.exists(F.regexp_extract_all(tail, F.lit("([a-z']+)"), F.lit(1)), lambda w: w.isin(fixed.NEGATIONS) | w.endswith("n't"))


def signals(text: Column, lexicon: Lexicon | None = None) -> Column:
    """``array<struct<category, tier, phrase, n>>``: phrases with n occurrences that are not negated.

    ``lexicon`` may be another table of phrases (lower case), as rows (category,
    tier, phrase); it becomes a literal. A phrase's occurrences are one pass over the
    pieces between them, which carries the ends of the last two words: time grows
    with the length of the text, however often a phrase is in it.
    """
    low = F.lower(text)
    rows = fixed_lexicon() if lexicon is None else list(lexicon)

    def count(p: Column) -> Column:
        def step(a: Column, piece: Column) -> Column:
            # the phrase itself stands between a piece and the one before
            tail = _tail(F.concat(a["tail"], F.when(a["first"], F.lit("")).otherwise(p["phrase"]), piece))
            return let(tail, lambda t: F.struct(t.alias("tail"), F.lit(False).alias("first"), (a["n"] + F.when(_negated(t), 0).otherwise(1)).alias("n")))

        start = F.struct(F.lit("").alias("tail"), F.lit(True).alias("first"), F.lit(0).alias("n"))
        before = lambda pieces: F.slice(pieces, F.lit(1), F.size(pieces) - 1)
        return let(F.split(low, p["pattern"], -1), lambda pieces: F.aggregate(before(pieces), start, step, lambda a: a["n"]))

    if not rows:
        return F.when(text.isNotNull(), F.array().cast("array<struct<category:string,tier:string,phrase:string,n:int>>"))
    present = F.filter(_literal(rows), lambda p: F.contains(low, p["phrase"]))
    counted = F.transform(present, lambda p: F.struct(p["category"].alias("category"), p["tier"].alias("tier"), p["phrase"].alias("phrase"), count(p).alias("n")))
    return F.when(text.isNotNull(), F.filter(counted, lambda s: s["n"] > 0))


def _total(found: Column, keep) -> Column:
    return F.aggregate(F.filter(found, keep), F.lit(0), lambda a, s: a + s["n"])


def severity_of(found: Column, urgent: Column) -> Column:
    """Any critical or high signal decides; low ones need two points (a phrase of several words has two) or urgency."""
    low = F.filter(found, lambda s: s["tier"] == "low")
    points = F.aggregate(low, F.lit(0), lambda a, s: a + s["n"] * F.when(s["phrase"].contains(" "), 2).otherwise(1))
    return (
        F.when(F.exists(found, lambda s: s["tier"] == "critical"), "critical")
        .when(F.exists(found, lambda s: s["tier"] == "high"), "high")
        .when((points >= 2) | ((F.size(low) > 0) & urgent), "low")
        .otherwise("none")
    )


def category_of(found: Column, severity: Column) -> Column:
    """Most signals of the deciding tier; ties go to the first category in order of priority."""
    def of(c: str) -> Column:
        return _total(found, lambda s: (s["tier"] == severity) & (s["category"] == c))

    counts = {c: of(c) for c in fixed.CATEGORY_PRIORITY}
    best = F.greatest(*counts.values())
    out = F.when(severity == "none", "none")
    for c, n in counts.items():
        out = out.when(n == best, c)
    return out


def _clean() -> Column:
    return F.struct(
        F.lit(False).alias("is_emergency"), F.lit("none").alias("severity"), F.lit("none").alias("category"), F.lit("").alias("message"), F.array().cast("array<string>").alias("emergency_contacts")
    )


def _verdict(severity: Column, category: Column) -> Column:
    message, contacts = F.lit(""), F.array().cast("array<string>")
    for c, tiers in fixed.EMERGENCY_MESSAGES.items():
        for t, m in tiers.items():
            message = F.when((category == c) & (severity == t), F.lit(m)).otherwise(message)
    for c, numbers in fixed.CONTACTS.items():
        contacts = F.when(category == c, F.array(*map(F.lit, numbers))).otherwise(contacts)
    found = F.struct(F.lit(True).alias("is_emergency"), severity.alias("severity"), category.alias("category"), message.alias("message"), contacts.alias("emergency_contacts"))
    return F.when(severity == "none", _clean()).otherwise(found)


def detect(text: Column, enabled: Column | bool = True) -> Column:
    """The emergency verdict of a text: a struct of type ``RESULT``; null for a null text."""
    on = F.lit(enabled) if isinstance(enabled, bool) else enabled
    urgent = matches(F.lower(text), fixed.URGENCY)

    def judged(found: Column) -> Column:
        def named(severity: Column) -> Column:
            return let(category_of(found, severity), lambda category: _verdict(severity, category))

        return F.when(F.size(found) == 0, _clean()).otherwise(let(severity_of(found, urgent), named))

    idle = ~on | ~text.rlike(f"[^{SPACE_CLASS}]")
    return F.when(text.isNotNull(), F.when(idle, _clean()).otherwise(let(signals(text), judged)))
