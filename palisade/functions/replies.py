"""The output guard's outcome for one reply, where a task must know it before the next turn.

Plans over tables use the columns of ``guards``; these give the same for a text
in Python, whose expressions the columns are made from.
"""

from __future__ import annotations

import re

from palisade.functions import fixed

_TOXIC = [re.compile(p, re.IGNORECASE) for p in fixed.TOXICITY_PATTERNS]
_PII = {k: re.compile(p) for k, p in fixed.PII_PATTERNS.items()}
_DOMAINS = {d: re.compile(p, re.IGNORECASE) for d, p in fixed.DOMAIN_PATTERNS.items()}
_MARKER = re.compile(fixed.DISCLAIMER_MARKER, re.IGNORECASE)


def toxic(draft: str) -> bool:
    return any(p.search(draft) for p in _TOXIC)


def answer(draft: str | None, query: str | None, enabled: bool = True) -> tuple[str, bool]:
    """What a draft is answered with, and whether it was blocked: ``guards.output_guard`` with the refusal in a blocked one's place."""
    if draft is None:
        return fixed.OUTPUT_REFUSAL, False
    if not enabled:
        return draft, False
    if toxic(draft):
        return fixed.OUTPUT_REFUSAL, True
    clean = draft
    for kind, p in _PII.items():
        clean = p.sub(fixed.PII_PLACEHOLDERS[kind], clean)
    both = clean if query is None else f"{query}\n{clean}"
    wanted = [fixed.DISCLAIMERS[d] for d, p in _DOMAINS.items() if p.search(both)]
    if not wanted or _MARKER.search(clean):
        return clean, False
    return "\n\n".join([clean.rstrip(), *wanted]), False
