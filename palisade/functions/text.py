"""Text primitives as columns: content tokens, personal data, clean-up. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions import fixed
from palisade.functions.patterns import SPACE_CLASS, find_all, jvm

_LONG_STOPWORDS = [w for w in fixed.STOPWORDS if len(w) > 2]


def content_tokens(text: Column) -> Column:
    """Lower-case words of letters a-z and digits, longer than two, without stop words; order and repeats kept."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{3,})"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(_LONG_STOPWORDS))


def token_set(text: Column) -> Column:
    """Different content tokens."""
    return F.array_distinct(content_tokens(text))


def pii(text: Column) -> Column:
    """Map of kind to what was found, each kind on the text as it is; kinds without a find are left out."""
    found = F.create_map(*(x for k, p in fixed.PII_PATTERNS.items() for x in (F.lit(k), find_all(text, p))))
    return F.when(text.isNotNull(), F.map_filter(found, lambda k, v: F.size(v) > 0))


def pii_kinds(text: Column) -> Column:
    """Kinds of personal data in the text, in the order of redaction."""
    flags = F.array(*(F.when(text.rlike(jvm(p)), F.lit(k)) for k, p in fixed.PII_PATTERNS.items()))
    return F.when(text.isNotNull(), F.array_compact(flags))


def redact(text: Column) -> Column:
    """The text with personal data replaced, kind after kind."""
    for kind, pattern in fixed.PII_PATTERNS.items():
        text = F.regexp_replace(text, jvm(pattern), fixed.PII_PLACEHOLDERS[kind])
    return text


def strip(text: Column) -> Column:
    """Without white space (as Python counts it) at either end."""
    return F.regexp_replace(text, rf"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+\z", "")


def strip_end(text: Column) -> Column:
    return F.regexp_replace(text, rf"[{SPACE_CLASS}]+\z", "")


def sanitize(text: Column) -> Column:
    """Without control characters and personal data, runs of blanks as one space, stripped."""
    clean = F.regexp_replace(text, fixed.CONTROL_CHARACTERS, "")
    return strip(F.regexp_replace(redact(clean), fixed.SPACE_RUN, " "))


def round_half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)
