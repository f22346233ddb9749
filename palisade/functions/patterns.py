"""Python regular expressions as the JVM's, with Python's notion of letters, digits and spaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Contents of the character classes that the two engines disagree on.
WORD_CLASS = r"\p{L}\p{N}_"
DIGIT_CLASS = r"\p{Nd}"
SPACE_CLASS = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_CLASSES = {"w": WORD_CLASS, "d": DIGIT_CLASS, "s": SPACE_CLASS}
_W = f"[{WORD_CLASS}]"
_EDGE = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def jvm(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """The same expression for the JVM: word edges, classes and flags spelt out."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            n = pattern[i + 1]
            if n == "b" and not inside:
                out.append(_EDGE)
            elif n in _CLASSES:
                out.append(_CLASSES[n] if inside else f"[{_CLASSES[n]}]")
            else:
                out.append(c + n)
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        elif c == "[" and inside:
            out.append("\\")
        out.append(c)
        i += 1
    flags = ("iu" if ignore_case else "") + ("md" if multiline else "")
    return (f"(?{flags})" if flags else "") + "".join(out)


def matches(text: Column, pattern: str, ignore_case: bool = True, multiline: bool = False) -> Column:
    """Whether the expression is found anywhere."""
    return text.rlike(jvm(pattern, ignore_case, multiline))


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    out = matches(text, patterns[0])
    for p in patterns[1:]:
        out = out | matches(text, p)
    return out


def find_all(text: Column, pattern: str) -> Column:
    """All matches, in order."""
    return F.regexp_extract_all(text, F.lit(f"({jvm(pattern)})"), F.lit(1))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)
