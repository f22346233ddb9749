"""The guards, claims and retrieval as SQL functions of a session, for queries that are written in SQL alone.

``install(spark)`` creates temporary functions whose bodies are SQL, so a query
that calls them is one plan of the JVM's own functions:

* ``content_tokens(text)``, ``claims(text)``, ``redact_pii(text)``, ``sanitize_text(text)``
* ``injection_reason(text)``, ``harmful_reason(text)``
* ``emergency(text)``: ``struct<severity, category>``
* ``input_guard(text)``: ``struct<is_safe, blocked_reason, severity, category, sanitized_text>``

``install_topk(spark, index)`` adds the table function ``overlap_topk(question, k)`` over an index.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from palisade.functions import emergency, fixed
from palisade.functions.patterns import SPACE_CLASS, jvm
from palisade.operators.inverted import Index, postings_of
from palisade.sources.scratch import staged


def literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(values: list[str]) -> str:
    return f"array({', '.join(map(literal, values))})"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _tokens(t: str) -> str:
    return f"filter(regexp_extract_all(lower({t}), '([a-z0-9]{{3,}})', 1), w -> NOT array_contains({_array([w for w in fixed.STOPWORDS if len(w) > 2])}, w))"


def _stripped(t: str) -> str:
    return f"regexp_replace({t}, {literal(rf'^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+\z')}, '')"


def _redacted(t: str) -> str:
    for kind, pattern in fixed.PII_PATTERNS.items():
        t = f"regexp_replace({t}, {literal(jvm(pattern))}, {literal(fixed.PII_PLACEHOLDERS[kind])})"
    return t


def _sanitized(t: str) -> str:
    clean = _redacted(f"regexp_replace({t}, {literal(fixed.CONTROL_CHARACTERS)}, '')")
    return _stripped(f"regexp_replace({clean}, {literal(fixed.SPACE_RUN)}, ' ')")


def _found(t: str, pattern: str, multiline: bool = False) -> str:
    return f"{t} RLIKE {literal(jvm(pattern, True, multiline))}"


def _injection(t: str) -> str:
    return "CASE " + " ".join(f"WHEN {_found(t, p, p.endswith(r'^\s*system\s*:)'))} THEN {literal(r)}" for p, r in fixed.INJECTION_RULES) + " END"


def _harmful(t: str) -> str:
    return f"CASE WHEN {' OR '.join(_found(t, p) for p in fixed.HARMFUL_PATTERNS)} THEN {literal(fixed.HARMFUL_REASON)} END"


def _signals(low: str) -> str:
    rows = ", ".join(
        f"named_struct('category', {literal(c)}, 'tier', {literal(t)}, 'phrase', {literal(p)}, 'pattern', {literal(jvm(rf'\b{re.escape(p)}\b', True))})" for c, t, p in emergency.fixed_lexicon()
    )
    prefix = "concat(a.tail, CASE WHEN a.first THEN '' ELSE p.phrase END, piece)"
    tail = f"reverse(regexp_replace(reverse({prefix}), {literal(emergency._TAIL)}, '$1$2 $3'))"
    negated = f"exists(regexp_extract_all(t, '([a-z\\']+)', 1), w -> array_contains({_array(fixed.NEGATIONS)}, w) OR endswith(w, 'n\\'t'))"
    step = _let(tail, "t", f"named_struct('tail', t, 'first', false, 'n', a.n + CASE WHEN {negated} THEN 0 ELSE 1 END)")
    count = _let(f"split({low}, p.pattern, -1)", "s", f"aggregate(slice(s, 1, size(s) - 1), named_struct('tail', '', 'first', true, 'n', 0), (a, piece) -> {step}, a -> a.n)")
    counted = f"transform(filter(array({rows}), p -> contains({low}, p.phrase)), p -> named_struct('category', p.category, 'tier', p.tier, 'phrase', p.phrase, 'n', {count}))"
    return f"filter({counted}, x -> x.n > 0)"


def _emergency(t: str) -> str:
    low = f"lower({t})"
    points = "aggregate(filter(f, x -> x.tier = 'low'), 0, (a, x) -> a + x.n * CASE WHEN contains(x.phrase, ' ') THEN 2 ELSE 1 END)"
    severity = (
        "CASE WHEN exists(f, x -> x.tier = 'critical') THEN 'critical' WHEN exists(f, x -> x.tier = 'high') THEN 'high' "
        f"WHEN {points} >= 2 OR (exists(f, x -> x.tier = 'low') AND {_found(low, fixed.URGENCY)}) THEN 'low' ELSE 'none' END"
    )
    total = lambda c: f"aggregate(filter(f, x -> x.tier = v AND x.category = {literal(c)}), 0, (a, x) -> a + x.n)"
    most = f"greatest({', '.join(map(total, fixed.CATEGORY_PRIORITY))})"
    category = "CASE WHEN v = 'none' THEN 'none' " + " ".join(f"WHEN {total(c)} = {most} THEN {literal(c)}" for c in fixed.CATEGORY_PRIORITY) + " END"
    none = "named_struct('severity', 'none', 'category', 'none')"
    judged = _let(_signals(low), "f", f"CASE WHEN size(f) = 0 THEN {none} ELSE {_let(severity, 'v', f"named_struct('severity', v, 'category', {category})")} END")
    return f"CASE WHEN {t} IS NULL THEN NULL WHEN NOT {t} RLIKE {literal(f'[^{SPACE_CLASS}]')} THEN {none} ELSE {judged} END"


def _guard(t: str) -> str:
    reason = f"CASE WHEN e.severity = 'critical' THEN {literal(fixed.CRITICAL_REASON)} ELSE coalesce({_injection(t)}, {_harmful(t)}) END"
    out = _let(reason, "r", f"named_struct('is_safe', r IS NULL, 'blocked_reason', r, 'severity', nullif(e.severity, 'none'), 'category', nullif(e.category, 'none'), 'sanitized_text', {_sanitized(t)})")
    return f"CASE WHEN {t} IS NOT NULL THEN {_let(_emergency(t), 'e', out)} END"


def bodies() -> dict[str, tuple[str, str]]:
    """Result type and body of each function of ``text``."""
    claims = f"filter(transform(split(text, {literal(fixed.CLAIM_SEPARATORS)}, -1), s -> {_stripped('s')}), c -> size({_tokens('c')}) > 0)"
    return {
        "content_tokens": ("ARRAY<STRING>", _tokens("text")),
        "claims": ("ARRAY<STRING>", claims),
        "redact_pii": ("STRING", _redacted("text")),
        "sanitize_text": ("STRING", _sanitized("text")),
        "injection_reason": ("STRING", _injection("text")),
        "harmful_reason": ("STRING", _harmful("text")),
        "emergency": ("STRUCT<severity: STRING, category: STRING>", _emergency("text")),
        "input_guard": ("STRUCT<is_safe: BOOLEAN, blocked_reason: STRING, severity: STRING, category: STRING, sanitized_text: STRING>", _guard("text")),
    }


def install(spark: SparkSession) -> None:
    """Create the session's functions, or replace them. Null text gives null from each."""
    for name, (kind, body) in bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS {kind} RETURN {body}")


def install_topk(spark: SparkSession, index: Index, name: str = "overlap_topk") -> None:
    """Create the table function ``name(question, k)``: ``(rank, ordinal, hits, n_terms, score)`` of the first k passages of an index.

    For one question a call; tables of questions are for ``inverted.search``. It
    reads the posting lists of the question's tokens.
    """
    rows = staged(postings_of(index.passages), f"{name.replace('_', '-')}-postings")
    keys = index.passages.select("part", "row", "ordinal", "key")
    rows.join(keys, ["part", "row"]).createOrReplaceTempView(f"{name}_postings")
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION {name}(question STRING, k INT) RETURNS TABLE (rank INT, ordinal BIGINT, hits BIGINT, n_terms BIGINT, score DOUBLE) RETURN
WITH terms AS (SELECT array_distinct({_tokens(f'{name}.question')}) AS terms),
asked AS (SELECT size(terms) AS n, explode(terms) AS token FROM terms),
met AS (SELECT ordinal, key, part, row, n, count(*) AS hits FROM {name}_postings JOIN asked USING (token) GROUP BY ALL),
scored AS (SELECT *, bround(hits / n, 4) AS score FROM met),
placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, ordinal, key, part, row) AS place FROM scored)
SELECT place, ordinal, hits, CAST(n AS BIGINT), score FROM placed WHERE place <= {name}.k""")
