"""DuckDB SQL for the registered queries, from common table expressions that build on each other."""

from __future__ import annotations

import re

from palisade.functions import fixed
from palisade.queries import TEMPLATES, WINDOW


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(map(_q, items)) + "]"


def _chars(s: str) -> str:
    """A literal; characters that are hard to read are spelt by number."""
    return " || ".join(_q(p) if p.isprintable() else f"chr({ord(p)})" for p in re.split(r"([^ -~])", s) if p) or "''"


# --- text -------------------------------------------------------------------

WORD = r"[\p{L}\p{N}_]"
PHONE = fixed.PII_PATTERNS["phone"].replace(r"(?<!\w)", "").replace(r"(?!\w)", "")
EMAIL = fixed.PII_PATTERNS["email"]
PII_SQL = {
    "email": lambda t: f"regexp_extract_all({t}, {_q(EMAIL)})",
    "phone": lambda t: f"regexp_extract_all({t}, {_q(f'(?:^|[^0-9A-Za-z_])({PHONE})(?:$|[^0-9A-Za-z_])')}, 1)",
    "national_id": lambda t: f"list_filter(regexp_extract_all({t}, '[0-9]+'), lambda x: length(x) BETWEEN 7 AND 8)",
}


def _tokens(t: str) -> str:
    return f"list_filter(regexp_extract_all(lower({t}), '[a-z0-9]{{3,}}'), lambda x: NOT list_contains({_list(w for w in fixed.STOPWORDS if len(w) > 2)}, x))"


def _redacted(t: str) -> str:
    t = f"regexp_replace({t}, {_q(EMAIL)}, '[EMAIL]', 'g')"
    t = f"regexp_replace({t}, {_q(f'(^|[^0-9A-Za-z_])(?:{PHONE})($|[^0-9A-Za-z_])')}, '\\1[PHONE]\\2', 'g')"
    return f"regexp_replace({t}, '(^|[^0-9])[0-9]{{7,8}}($|[^0-9])', '\\1[ID]\\2', 'g')"


_SPACE = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _stripped(t: str) -> str:
    return f"regexp_replace({t}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _sanitized(t: str) -> str:
    clean = f"regexp_replace({t}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]', '', 'g')"
    return _stripped(f"regexp_replace({_redacted(clean)}, '[ \\t]{{2,}}', ' ', 'g')")


def _found(t: str, pattern: str) -> str:
    return f"regexp_matches({t}, {_q(pattern)}, 'i')"


def _any(t: str, patterns) -> str:
    return "(" + " OR ".join(_found(t, p) for p in patterns) + ")"


def _injection(t: str) -> str:
    rules = [(_found(t, ("(?m)" if "^" in p.replace("[^", "") else "") + p), r) for p, r in fixed.INJECTION_RULES]
    return "CASE " + " ".join(f"WHEN {c} THEN {_q(r)}" for c, r in rules) + " END"


def _kinds(t: str, sep: str) -> str:
    return f"concat_ws('{sep}', " + ", ".join(f"CASE WHEN len({PII_SQL[k](t)}) > 0 THEN '{k}' END" for k in PII_SQL) + ")"


def _filled(number: str) -> str:
    t = f"([{', '.join(_chars(t) for t in TEMPLATES)}])[({number}) % {len(TEMPLATES)} + 1]"
    for mark, value in {"{u}": "user_id::VARCHAR", "{p}": "'07' || lpad(user_id::VARCHAR, 8, '1')", "{d}": "lpad(event_id::VARCHAR, 7, '3')", "{e}": "'u' || user_id || '.x@mail.example.org'"}.items():
        t = f"replace({t}, '{mark}', {value})"
    return t


PROMPTS = f"prompts AS (SELECT event_id AS prompt_id, {_filled('event_id')} AS text, {_filled('event_id * 7 + 3')} AS draft FROM events)"

# --- emergencies --------------------------------------------------------------

_lexicon = ", ".join(f"({_q(c)}, {_q(t)}, {_q(p)})" for c, tiers in fixed.SIGNALS.items() for t, ps in tiers.items() for p in ps)
SIGNALS = f"""
lexicon(category, tier, phrase) AS (VALUES {_lexicon}),
split_up AS (
  SELECT prompt_id, category, tier, phrase, regexp_split_to_array(lower(text), '\\b' || replace(phrase, '-', '\\-') || '\\b') AS pieces
  FROM prompts JOIN lexicon ON contains(lower(text), phrase)),
occurrences AS (
  SELECT * EXCLUDE pieces, regexp_extract_all(list_reduce(pieces[1:i], lambda a, b: a || phrase || b), '[a-z'']+')[-2:] AS before
  FROM (SELECT *, unnest(range(1, len(pieces))) AS i FROM split_up)),
signals AS (
  SELECT prompt_id, category, tier, phrase, count(*) AS n FROM occurrences
  WHERE len(list_filter(before, lambda w: list_contains({_list(fixed.NEGATIONS)}, w) OR w LIKE '%n''t')) = 0 GROUP BY ALL)"""

def _contacts(sep: str) -> str:
    return "CASE category " + " ".join(f"WHEN '{c}' THEN {_q(sep.join(v))}" for c, v in fixed.CONTACTS.items()) + " ELSE '' END"


_messages = " ".join(f"WHEN category = '{c}' AND severity = '{t}' THEN {_q(m)}" for c, tiers in fixed.EMERGENCY_MESSAGES.items() for t, m in tiers.items())
_order = "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(fixed.CATEGORY_PRIORITY)) + " END"
EMERGENCY = f"""{SIGNALS},
tiers AS (
  SELECT prompt_id, CASE WHEN bool_or(tier = 'critical') THEN 'critical' WHEN bool_or(tier = 'high') THEN 'high'
    WHEN sum(n * CASE WHEN phrase LIKE '% %' THEN 2 ELSE 1 END) >= 2 OR bool_or({_found('lower(text)', fixed.URGENCY)}) THEN 'low' ELSE 'none' END AS severity
  FROM signals JOIN prompts USING (prompt_id) GROUP BY prompt_id),
verdicts AS (
  SELECT prompt_id, severity, category FROM (
    SELECT prompt_id, severity, category, sum(n) AS n FROM signals JOIN tiers USING (prompt_id) WHERE tier = severity GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY n DESC, {_order}) = 1),
emergencies AS (
  SELECT prompt_id, coalesce(severity, 'none') AS severity, coalesce(category, 'none') AS category FROM prompts LEFT JOIN verdicts USING (prompt_id))"""

_HARM = f"CASE WHEN {_any('text', fixed.HARMFUL_PATTERNS)} THEN {_q(fixed.HARMFUL_REASON)} END"
_CRISIS = f"CASE WHEN {_contacts('')} = '' THEN message ELSE message || chr(10) || chr(10) || 'Emergency contacts: ' || {_contacts(', ')} END"
GUARDED = f"""
guarded AS (
  SELECT *, CASE WHEN severity = 'critical' THEN {_q(fixed.CRITICAL_REASON)} ELSE coalesce({_injection('text')}, {_HARM}) END AS reason, CASE {_messages} ELSE '' END AS message
  FROM emergencies JOIN prompts USING (prompt_id)),
refused AS (SELECT *, CASE WHEN severity = 'critical' THEN {_CRISIS} ELSE {_chars(fixed.REFUSAL)} END AS answer FROM guarded WHERE reason IS NOT NULL)"""

# --- retrieval ------------------------------------------------------------------

TURNS = """
turns AS (
  SELECT conv_id * 4294967296 + turn AS query_id, conv_id, turn, text, recorded FROM (
    SELECT *, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS recorded FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user')"""
def _scores(turns: str, corpus: str) -> str:
    return f"""{turns},
asked AS (SELECT query_id, text AS q FROM turns),
terms AS (SELECT query_id, len(ts) AS n_terms, unnest(ts) AS token FROM (SELECT query_id, list_distinct({_tokens('q')}) AS ts FROM asked)),
bags AS (SELECT ordinal, source, text AS content, {_tokens('text')} AS bag FROM ({corpus})),
idx AS (SELECT ordinal, unnest(list_distinct(bag)) AS token FROM bags),
scores AS (
  SELECT query_id, ordinal, count(*) AS hits, n_terms, round_even(count(*) / n_terms, 4) AS score FROM terms JOIN idx USING (token) GROUP BY query_id, ordinal, n_terms),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) AS rank FROM scores)"""


SCORES = _scores(TURNS, "SELECT doc_id AS ordinal, source, text FROM documents")
LEXICAL = f"""{SCORES},
words AS (SELECT query_id, rank AS old_rank, ordinal, len(bag) AS n, unnest(bag) AS token FROM placed JOIN bags USING (ordinal) WHERE rank <= 10),
tf AS (SELECT query_id, old_rank, ordinal, token, count(*) AS tf, any_value(n) AS n FROM words JOIN terms USING (query_id, token) GROUP BY query_id, old_rank, ordinal, token),
parts AS (SELECT *, tf / n * ln(1 + 1.0::DOUBLE / count(*) OVER (PARTITION BY query_id, token)) AS part FROM tf),
lexical AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old_rank) AS rank
  FROM (SELECT query_id, old_rank, ordinal, round(sum(part), 6) AS score FROM parts GROUP BY ALL))"""

# --- grounding --------------------------------------------------------------------

JUDGED = f"""
contexts AS (SELECT query_id, list_distinct(flatten(list(bag))) AS known, count(*) AS n FROM placed JOIN bags USING (ordinal) WHERE rank <= @K@ GROUP BY query_id),
drafts AS (
  SELECT t.*, coalesce(known, []) AS known, coalesce(n, 0) AS n FROM turns t LEFT JOIN contexts USING (query_id) WHERE recorded IS NOT NULL),
claims AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS n, claim, list_distinct(tokens) AS tokens FROM (
    SELECT query_id, i, claim, {_tokens('claim')} AS tokens FROM (
      SELECT query_id, generate_subscripts(cs, 1) AS i, {_stripped('unnest(cs)')} AS claim FROM (
        SELECT query_id, regexp_split_to_array(recorded, '[.!?;\\n]+') AS cs FROM drafts)))
  WHERE len(tokens) > 0),
judged AS (
  SELECT c.*, d.n > 0 AND len(list_intersect(tokens, known)) * 2 >= len(tokens) AS good FROM claims c JOIN drafts d USING (query_id)),
hallucinations AS (
  SELECT query_id, count(claim) AS n_claims, count(claim) FILTER (NOT good) AS n_ungrounded,
    CASE WHEN count(claim) = 0 THEN 0.0::DOUBLE ELSE round_even(count(claim) FILTER (NOT good) / count(claim), 4) END AS score,
    coalesce(string_agg(claim, '|' ORDER BY j.n) FILTER (good), '') AS grounded, coalesce(string_agg(claim, '|' ORDER BY j.n) FILTER (NOT good), '') AS ungrounded
  FROM drafts LEFT JOIN judged j USING (query_id) GROUP BY query_id),
confidences AS (
  SELECT query_id, CASE WHEN n = 0 OR len(own) = 0 THEN 1.0::DOUBLE ELSE round_even(len(list_intersect(own, known)) / len(own), 4) END AS confidence
  FROM (SELECT *, list_distinct({_tokens('recorded')}) AS own FROM drafts))"""
DRAFTS = f"{SCORES},{JUDGED}"
_VERDICT = "CASE WHEN score < 0.35 THEN 'grounded' WHEN score < 0.7 THEN 'partial' ELSE 'hallucinated' END"


def _disclaimed(t: str, query: str) -> str:
    domains = ", ".join(f"CASE WHEN {_found(f'({query} || chr(10) || {t})', p)} THEN {_q(fixed.DISCLAIMERS[d])} END" for d, p in fixed.DOMAIN_PATTERNS.items())
    added = f"concat_ws(chr(10) || chr(10), regexp_replace({t}, '{_SPACE}+$', ''), {domains})"
    return f"CASE WHEN {_found(t, fixed.DISCLAIMER_MARKER)} OR NOT {_any(f'({query} || chr(10) || {t})', fixed.DOMAIN_PATTERNS.values())} THEN {t} ELSE {added} END"


def _warnings(t: str, score: str, has_context: str) -> str:
    low = f"CASE WHEN {has_context} AND {score} < 0.7 THEN 'Low grounding: the response may not be fully supported by the retrieved context (score ' || printf('%.2f', {score}) || ' < threshold 0.70).' END"
    kinds = _kinds(t, ", ")
    return f"concat_ws('|', {low}, CASE WHEN {kinds} <> '' THEN 'Redacted potential PII leaked into the output: ' || {kinds} || '.' END)"


_TOXIC = _any("text", fixed.TOXICITY_PATTERNS)
_SAFE = f"turns AS (SELECT prompt_id AS query_id, {_sanitized('text')} AS text, draft AS recorded FROM guarded WHERE reason IS NULL)"
_CONTEXT = "the treatment of flu needs rest a contract with the user"
OUTPUTS = f"""
scored AS (
  SELECT prompt_id, text, prompt_id % 3 <> 0 AS known, CASE WHEN prompt_id % 3 = 0 OR len(own) = 0 THEN 1.0::DOUBLE ELSE round_even(len(list_intersect(own, {_tokens(_q(_CONTEXT))})) / len(own), 4) END AS score
  FROM (SELECT *, list_distinct({_tokens('text')}) AS own FROM prompts))"""

# --- memory -------------------------------------------------------------------------

MEMORY = f"""
exchanges AS (
  SELECT conv_id, turn, text AS u, reply AS a FROM (
    SELECT *, lead(role) OVER w AS next, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next = 'assistant'),
remembered AS (
  SELECT conv_id, turn, u, coalesce(list({{'u': u, 'a': a}}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING), []) AS memory FROM exchanges)"""

_SOURCES = """
top3 AS (
  SELECT query_id, string_agg('[' || rank || '] (source: ' || source || ')' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS blocks, count(*) AS n_sources
  FROM placed JOIN bags USING (ordinal) WHERE rank <= 3 GROUP BY query_id)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


ORACLES = {
    "content_tokens_stats": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
    "pii_detect": _with(PROMPTS) + f"SELECT prompt_id AS id, {_kinds('text', '|')} AS kinds, " + ", ".join(f"array_to_string({f('text')}, '|') AS {k}" for k, f in PII_SQL.items()) + " FROM prompts",
    "pii_detect_documents": f"SELECT doc_id AS id, {_kinds('text', '|')} AS kinds, array_to_string({PII_SQL['national_id']('text')}, '|') AS national_id FROM documents",
    "pii_redact": _with(PROMPTS) + f"SELECT prompt_id, {_redacted('text')} AS redacted FROM prompts",
    "input_sanitize": _with(PROMPTS) + f"SELECT prompt_id, {_sanitized('text')} AS sanitized FROM prompts",
    "injection_rules": _with(PROMPTS) + f"SELECT prompt_id, {_injection('text')} AS reason FROM prompts",
    "harmful_rules": _with(PROMPTS) + f"SELECT prompt_id, CASE WHEN {_any('text', fixed.HARMFUL_PATTERNS)} THEN {_q(fixed.HARMFUL_REASON)} END AS reason FROM prompts",
    "emergency_signals": _with(PROMPTS, SIGNALS) + "SELECT * FROM signals",
    "emergency_verdict": _with(PROMPTS, EMERGENCY)
    + f"SELECT prompt_id, severity <> 'none' AS is_emergency, severity, category, CASE {_messages} ELSE '' END AS message, {_contacts('|')} AS contacts FROM emergencies",
    "input_guard": _with(PROMPTS, EMERGENCY)
    + f"""SELECT prompt_id, blocked_reason IS NULL AS is_safe, blocked_reason, sanitized_text, severity, category FROM (
  SELECT prompt_id, CASE WHEN severity = 'critical' THEN {_q(fixed.CRITICAL_REASON)} ELSE coalesce({_injection('text')}, CASE WHEN {_any('text', fixed.HARMFUL_PATTERNS)} THEN {_q(fixed.HARMFUL_REASON)} END) END AS blocked_reason,
    {_sanitized('text')} AS sanitized_text, nullif(severity, 'none') AS severity, nullif(category, 'none') AS category FROM emergencies JOIN prompts USING (prompt_id))""",
    "overlap_retrieve_topk": _with(SCORES) + "SELECT query_id, rank, ordinal, hits, n_terms, score FROM placed WHERE rank <= 5",
    "lexical_rerank_topk": _with(LEXICAL) + "SELECT query_id, rank, ordinal, score FROM lexical WHERE rank <= 3",
    "rrf_fusion": _with(LEXICAL)
    + """SELECT query_id, rank, md5(content) AS content_md5, source, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank FROM (
    SELECT query_id, content, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, arg_min(source, list_no * 1000 + rank) AS source, min(list_no * 1000 + rank) AS seen FROM (
      SELECT query_id, list_no, rank, ordinal FROM placed, (VALUES (0), (2)) l(list_no) WHERE rank <= 10
      UNION ALL SELECT query_id, 1, rank, ordinal FROM lexical WHERE rank <= 10) JOIN bags USING (ordinal) GROUP BY query_id, content)) WHERE rank <= 3""",
    "vector_topk": """SELECT query_id, rank, ordinal, score FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS ordinal, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY score DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE rank <= 5""",
    "tf_hash_embedding": f"""SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM (
  SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 256 AS bucket, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest({_tokens('text')}) AS t FROM documents) GROUP BY ALL)""",
    "claims_extract": _with(DRAFTS.replace("@K@", "5")) + "SELECT query_id, n, claim FROM claims",
    "hallucination_verdict": _with(DRAFTS.replace("@K@", "5")) + f"SELECT query_id, score, {_VERDICT} AS verdict, n_ungrounded, n_claims, grounded, ungrounded FROM hallucinations",
    "grounding_confidence": _with(DRAFTS.replace("@K@", "5")) + "SELECT query_id, confidence FROM confidences",
    "toxicity_screen": _with(PROMPTS) + f"SELECT prompt_id, CASE WHEN {_TOXIC} THEN {_q(fixed.TOXICITY_REASON)} END AS reason FROM prompts",
    "disclaimer_inject": _with(PROMPTS) + f"SELECT prompt_id, {_disclaimed('text', _q('what now'))} AS output FROM prompts",
    "output_guard": _with(PROMPTS, OUTPUTS)
    + f"""SELECT prompt_id, NOT {_TOXIC} AS is_safe, CASE WHEN {_TOXIC} THEN {_q(fixed.TOXICITY_REASON)} END AS blocked_reason,
  CASE WHEN {_TOXIC} THEN '' ELSE {_disclaimed('clean', _q('what about my illness'))} END AS sanitized_output, CASE WHEN {_TOXIC} THEN 0.0::DOUBLE ELSE score END AS confidence_score,
  CASE WHEN {_TOXIC} THEN '' ELSE {_warnings('text', 'score', 'known')} END AS warnings FROM (SELECT *, {_redacted('text')} AS clean FROM scored)""",
    "memory_window": _with(MEMORY) + "SELECT conv_id, turn, len(memory) AS n, array_to_string(list_transform(memory, lambda m: m.u || '>' || m.a), '|') AS memory FROM remembered",
    "memory_messages": _with(MEMORY)
    + "SELECT conv_id, turn, n, CASE n % 2 WHEN 0 THEN 'user' ELSE 'assistant' END AS role, CASE n % 2 WHEN 0 THEN memory[n // 2 + 1].u ELSE memory[n // 2 + 1].a END AS content FROM (SELECT *, unnest(range(2 * len(memory))) AS n FROM remembered)",
    "memory_stored": _with(MEMORY)
    + f"SELECT conv_id, count(*) AS length, string_agg(u, '|' ORDER BY turn) AS users FROM (SELECT * FROM exchanges QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {WINDOW}) GROUP BY conv_id",
    "prompt_assembly": _with(SCORES, _SOURCES)
    + f"""SELECT query_id, 2 + 2 * least(10, before) AS n_messages, 'system' || repeat('|user|assistant', least(10, before)::INTEGER) || '|user' AS roles,
  md5('Context:' || chr(10) || coalesce(blocks, {_q(fixed.NO_CONTEXT)}) || chr(10) || chr(10) || 'Question: ' || {_sanitized('text')}) AS user_turn_md5
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS before FROM turns WHERE recorded IS NOT NULL) LEFT JOIN top3 USING (query_id)""",
    "pipeline_replay": _with(DRAFTS.replace("@K@", "3"), _SOURCES)
    + f"""SELECT query_id, false AS was_blocked, NULL::VARCHAR AS block_reason, md5({_disclaimed(_redacted('recorded'), _sanitized('text'))}) AS answer_md5, coalesce(n_sources, 0) AS n_sources,
  score AS hallucination_score, {_VERDICT} AS verdict, confidence, {_warnings('recorded', 'confidence', 'n > 0')} AS warnings
FROM drafts JOIN hallucinations USING (query_id) JOIN confidences USING (query_id) LEFT JOIN top3 USING (query_id)""",
    "stream_pieces": _with(PROMPTS)
    + f"""SELECT prompt_id AS query_id, unnest(range(len(ps))) AS piece_no, unnest(ps) AS piece, NOT toxic AS kept FROM (
  SELECT prompt_id, toxic, CASE WHEN toxic THEN list_append(ws, {_chars(fixed.STREAM_NOTICE)}) ELSE ws END AS ps FROM (
    SELECT prompt_id, {_TOXIC} AS toxic, CASE WHEN text = '' THEN [''] ELSE list_concat(list_transform(regexp_split_to_array(text, ' ')[:-2], lambda w: w || ' '), regexp_split_to_array(text, ' ')[-1:]) END AS ws FROM prompts))""",
    "guarded_answers": _with(PROMPTS, EMERGENCY, GUARDED, _scores(_SAFE, "SELECT item_id AS ordinal, 'benchmark' AS source, text FROM benchmark"), JUDGED.replace("@K@", "3"), _SOURCES)
    + f"""SELECT query_id, toxic AS was_blocked, CASE WHEN toxic THEN {_q(fixed.TOXICITY_REASON)} END AS block_reason,
  md5(CASE WHEN toxic THEN {_chars(fixed.OUTPUT_REFUSAL)} ELSE {_disclaimed(_redacted('recorded'), 'text')} END) AS answer_md5, coalesce(n_sources, 0) AS n_sources, score AS hallucination_score,
  {_VERDICT} AS verdict, CASE WHEN toxic THEN 0.0::DOUBLE ELSE confidence END AS confidence, CASE WHEN toxic THEN '' ELSE {_warnings('recorded', 'confidence', 'n > 0')} END AS warnings
FROM (SELECT *, {_any('recorded', fixed.TOXICITY_PATTERNS)} AS toxic FROM drafts) JOIN hallucinations USING (query_id) JOIN confidences USING (query_id) LEFT JOIN top3 USING (query_id)
UNION ALL SELECT prompt_id, true, reason, md5(answer), 0, 0.0::DOUBLE, 'grounded', 1.0::DOUBLE, '' FROM refused""",
    "blocked_stream": _with(PROMPTS, EMERGENCY, GUARDED) + "SELECT prompt_id AS query_id, 0::BIGINT AS piece_no, answer AS piece, false AS kept FROM refused",
    "guards_switched": _with(PROMPTS, EMERGENCY)
    + f"""SELECT prompt_id, in_reason IS NULL AS in_safe, in_reason, CASE WHEN checked THEN {_sanitized('text')} ELSE text END AS in_text, CASE WHEN checked THEN nullif(found, 'none') END AS in_severity,
  found AS severity, NOT toxic AS out_safe, CASE WHEN toxic THEN '' WHEN shown THEN {_disclaimed('clean', _q('what about my illness'))} ELSE text END AS out_text,
  CASE WHEN toxic THEN 0.0::DOUBLE WHEN shown THEN score ELSE 1.0::DOUBLE END AS confidence, CASE WHEN toxic OR NOT shown THEN '' ELSE {_warnings('text', 'score', 'true')} END AS warnings
FROM (
  SELECT *, CASE WHEN NOT checked THEN NULL WHEN found = 'critical' THEN {_q(fixed.CRITICAL_REASON)} ELSE coalesce({_injection('text')}, {_HARM}) END AS in_reason, shown AND {_TOXIC} AS toxic,
    {_redacted('text')} AS clean, CASE WHEN len(own) = 0 THEN 1.0::DOUBLE ELSE round_even(len(list_intersect(own, {_tokens(_q(_CONTEXT))})) / len(own), 4) END AS score
  FROM (
    SELECT prompt_id, text, prompt_id % 2 = 0 AS checked, prompt_id % 5 <> 0 AS shown, CASE WHEN prompt_id % 3 = 0 THEN severity ELSE 'none' END AS found, list_distinct({_tokens('text')}) AS own
    FROM emergencies JOIN prompts USING (prompt_id)))""",
    "message_renderings": _with(MEMORY)
    + f"""SELECT conv_id, turn, md5(sys) AS system_md5, repeat('user|assistant|', len(memory)::INTEGER) || 'user' AS chat_roles,
  md5('system: ' || sys || chr(10) || chr(10) || array_to_string(list_transform(memory, lambda m: 'user: ' || m.u || chr(10) || chr(10) || 'assistant: ' || m.a || chr(10) || chr(10)), '')
    || 'user: Context:' || chr(10) || {_chars(fixed.NO_CONTEXT)} || chr(10) || chr(10) || 'Question: ' || u) AS flat_md5,
  'system|' || repeat('human|ai|', len(memory)::INTEGER) || 'human' AS chain_roles FROM (SELECT *, {_chars(fixed.SYSTEM_PROMPT)} AS sys FROM remembered)""",
    "payload_passages": """SELECT doc_id AS id, md5(CASE WHEN doc_id % 3 = 0 THEN 'c' || doc_id ELSE coalesce(text, '') END) AS content_md5,
  CASE WHEN doc_id % 5 = 0 OR coalesce(source, '') = '' THEN doc_id::VARCHAR ELSE source END AS source, doc_id / 4 AS score,
  md5('lang=' || coalesce(lang, '') || CASE WHEN doc_id % 3 = 0 THEN '|text=' || coalesce(text, '') ELSE '|title=c' || doc_id END) AS metadata_md5 FROM documents""",
    "memory_cleared": _with(MEMORY)
    + f"""SELECT conv_id, turn, len(users) AS n, array_to_string(users, '|') AS users FROM (
  SELECT conv_id, turn, coalesce(list(u) OVER (PARTITION BY conv_id, part ORDER BY turn ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING), []) AS users FROM (
    SELECT *, count(*) FILTER (turn % 8 = 0) OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM exchanges))""",
}
ORACLES["indexed_retrieve_topk"] = ORACLES["overlap_retrieve_topk"]
ORACLES["content_flattening"] = """
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
flat AS (SELECT doc_id, CASE WHEN p IS NOT NULL THEN array_to_string([p[i] FOR i IN range(1, len(p) + 1) IF (i - 1) % 3 < 2], '') END AS t FROM parts)
SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS flat_md5 FROM flat"""
ORACLES["input_guard_in_sql"] = ORACLES["input_guard"]
ORACLES["claims_in_sql"] = ORACLES["claims_extract"]
