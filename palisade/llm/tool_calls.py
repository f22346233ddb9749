"""Tool-call linking for chat data.

Calls and results meet in one hash join on their identifier after each side was
reduced to one row an identifier, so a repeated identifier cannot multiply. A
conversation's calls are ordered so that each comes after the calls it refers
to: where the positions already do that, they are the order, and only
conversations with a reference to a later call go through rounds of Kahn's
algorithm. Numbers within a conversation are made from counts of short stretches,
so a conversation with a third of all calls is spread over many tasks.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.llm.common import sliced
from palisade.sources.scratch import staged

#: Positions of one stretch of a conversation.
STRETCH = 256
KINDS = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "integer": lambda v: not isinstance(v, bool) and (isinstance(v, int) or isinstance(v, float) and v.is_integer()),
    "number": lambda v: not isinstance(v, bool) and isinstance(v, (int, float)),
}


def _escaped(text: str) -> str:
    """``text`` with lone surrogates, which UTF-8 cannot hold, as escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def _text(value: str) -> str:
    return _escaped(json.dumps(value, ensure_ascii=False))


def _number(value: float) -> str:
    """The shortest digits that read back as the number, with exponents as ECMAScript writes them."""
    if value == 0:
        return "0"
    digits, _, exponent = f"{Decimal(repr(value)):e}".partition("e")
    sign, digits = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
    digits, at = digits.replace(".", "").rstrip("0"), int(exponent) + 1  # the point comes after ``at`` digits
    if len(digits) <= at <= 21:
        return sign + digits + "0" * (at - len(digits))
    if 0 < at <= 21:
        return f"{sign}{digits[:at]}.{digits[at:]}"
    if -6 < at <= 0:
        return f"{sign}0.{'0' * -at}{digits}"
    return f"{sign}{digits[0]}{'.' + digits[1:] if digits[1:] else ''}e{at - 1:+d}"


def canonical(value: Any) -> str:
    """JSON with keys in UTF-16 order, no white space, shortest numbers and no needless escapes; integers keep all digits."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{_text(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, str):
        return _text(value)
    return _number(value) if isinstance(value, float) else json.dumps(value)


class TooDeep(ValueError):
    """JSON that is nested too deeply to be read."""


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _finite(digits: str) -> float:
    if not math.isfinite(value := float(digits)):
        raise ValueError(digits)
    return value


def parse(text: str | None) -> Any:
    """The value of a JSON text; NaN, Infinity, numbers beyond a double's range, and broken text raise ValueError."""
    if text is None:
        raise ValueError("null")
    try:
        return json.loads(text, parse_constant=_no_constant, parse_float=_finite)
    except RecursionError as e:
        raise TooDeep from e


def _same(a: Any, b: Any) -> bool:
    """Equal as JSON values: a boolean is no number."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return a == b


def violations(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What of a JSON schema's type, enum, required, properties, additionalProperties, items, length, bound and pattern rules is broken."""
    out: list[str] = []
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if not any(KINDS[k](value) for k in kinds):
            return [f"{at}: not {'/'.join(kinds)}"]
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        out.append(f"{at}: not in enum")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: unknown" for k in sorted(value) if k not in own]
        for k in sorted(own):
            if k in value:
                out += violations(value[k], own[k], f"{at}.{k}")
    elif isinstance(value, list):
        if "items" in schema:
            for i, v in enumerate(value):
                out += violations(v, schema["items"], f"{at}[{i}]")
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            out.append(f"{at}: number of items")
    elif isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            out.append(f"{at}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: pattern")
    elif KINDS["number"](value) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        out.append(f"{at}: out of range")
    return out


def check(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Adds ``valid``, ``errors`` and ``canonical`` to calls with ``call_id, name, arguments``.

    ``canonical`` is the call as canonical JSON; null if the arguments are no
    JSON, or are nested too deeply to be read. A lone surrogate stays escaped.
    """
    rows = calls.drop("valid", "errors", "canonical")
    i, n, a = (rows.columns.index(c) for c in ("call_id", "name", "arguments"))
    schema = rows.withColumns({"valid": F.lit(True), "errors": F.array(F.lit("")), "canonical": F.lit("")}).schema
    for f in schema.fields[-3:]:
        f.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            valid, errors, texts = [], [], []
            for call_id, name, text in zip(*(b.column(k).to_pylist() for k in (i, n, a))):
                try:
                    value = parse(text)
                    found = violations(value, schemas[name]) if name in schemas else ["unknown tool"]
                    whole = canonical({"arguments": value, "id": call_id, "name": name})
                except (TooDeep, RecursionError):
                    found, whole = ["$: nested too deeply"], None
                except ValueError:
                    found, whole = ["$: no JSON"], None
                valid.append(not found)
                errors.append(list(map(_escaped, found)))
                texts.append(whole)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(valid, pa.bool_()), pa.array(errors, pa.list_(pa.string())), pa.array(texts, pa.string())], [*b.schema.names, "valid", "errors", "canonical"])

    return rows.mapInArrow(run, schema)


def _levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(conv_id, call_id, level)`` by Kahn's rounds; calls on or after a cycle are left out.

    nodes(conv_id, call_id), edges(conv_id, call_id, needs), all ends being nodes.
    """
    keys = ["conv_id", "call_id"]
    done = nodes.join(edges.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit(0).alias("level"))
    done, left = staged(done, "levels"), staged(edges, "open-edges")
    while True:
        known = done.select("conv_id", F.col("call_id").alias("needs"), "level")
        ready = (
            left.join(known, ["conv_id", "needs"], "left")
            .groupBy(*keys)
            .agg(F.count_if(F.col("level").isNull()).alias("open"), (F.max("level") + 1).alias("level"))
            .where("open = 0")
            .select(*keys, F.col("level").cast("int").alias("level"))
        )
        ready = staged(ready, "ready")
        if ready.isEmpty():
            return done
        left = staged(left.join(ready.select(*keys), keys, "left_anti"), "open-edges")
        done = staged(done.unionByName(ready), "levels")


def ordered(calls: DataFrame) -> DataFrame:
    """Adds ``level`` and ``place`` to calls with ``conv_id, call_id, position, needs`` (one row an identifier).

    ``needs`` are identifiers of the same conversation; unknown ones do not
    bind. ``place`` counts from 1 within the conversation, each call after all
    it needs; among calls that are free to swap, smaller positions first.
    ``level`` is 0 wherever the positions are already such an order, and null
    for calls on or after a cycle, which come last.
    """
    calls = staged(calls, "calls")
    edges = calls.select("conv_id", "call_id", F.col("position").alias("own"), F.explode("needs").alias("needs")).distinct()
    ends = calls.select("conv_id", F.col("call_id").alias("needs"), F.col("position").alias("other"))
    edges = staged(edges.join(ends, ["conv_id", "needs"]), "call-edges")
    wrong = edges.where("other > own or (other = own and needs >= call_id)").select("conv_id").distinct()
    if wrong.isEmpty():
        placed = calls.withColumn("level", F.lit(0))
    else:
        nodes = calls.join(wrong, "conv_id", "left_semi").select("conv_id", "call_id")
        levels = _levels(nodes, edges.join(wrong, "conv_id", "left_semi").select("conv_id", "call_id", "needs"))
        levels = levels.withColumnRenamed("level", "found")
        marked = wrong.withColumn("wrong", F.lit(True))
        placed = calls.join(levels, ["conv_id", "call_id"], "left").join(marked, "conv_id", "left")
        placed = placed.withColumn("level", F.when(F.col("wrong").isNull(), F.lit(0)).otherwise(F.col("found"))).drop("found", "wrong")
    late = F.coalesce("level", F.lit(2**31 - 1))
    placed = placed.withColumn("_level", late).withColumn("_stretch", F.floor(F.col("position") / STRETCH))
    conv = ["conv_id", "_level", "_stretch"]
    counts = placed.groupBy(*conv).agg(F.count("*").alias("_n"))
    before = W.partitionBy("conv_id").orderBy(F.col("_level"), F.col("_stretch").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    counts = counts.withColumnsRenamed({c: f"{c}_" for c in conv})
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in conv]
    inner = F.row_number().over(W.partitionBy(*conv).orderBy("position", "call_id"))
    placed = placed.withColumn("_inner", inner).join(counts, same)
    return placed.withColumn("place", (F.col("_before") + F.col("_inner")).cast("long")).drop("_before", "_inner", "_level", "_stretch", *(f"{c}_" for c in conv))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Link ``calls(conv_id, call_id, position, name, arguments, needs)`` with ``results(conv_id, call_id, position, content)``.

    Returns one row for each identifier of a conversation that either side has:
    ``conv_id, call_id, status`` (linked, unanswered, orphan: a result without
    its call, early: a result before its call) ``, position, result_position,
    name, arguments, content, n_calls, n_results, level, place, valid, errors,
    canonical``.

    Of calls (results) that share an identifier the earliest counts, ties by
    content, and ``n_calls`` (``n_results``) tells how many there were. Rows
    with a null conv_id or call_id cannot be linked and are left out; a null
    position comes first. Orphans have no place, validity or JSON. Extra columns
    are not looked at; empty tables give no rows.
    """
    keys = ["conv_id", "call_id"]
    first = F.struct("position", "name", "arguments", "needs")
    one = calls.where("conv_id is not null and call_id is not null").withColumn("needs", F.coalesce("needs", F.array().cast("array<string>")))
    one = one.groupBy(*keys).agg(F.min(first).alias("c"), F.count("*").alias("n_calls")).select(*keys, "c.*", "n_calls")
    one = check(ordered(one), schemas)
    two = results.where("conv_id is not null and call_id is not null").groupBy(*keys)
    two = two.agg(F.min(F.struct("position", "content")).alias("r"), F.count("*").alias("n_results"))
    two = two.select(*keys, F.col("r.position").alias("result_position"), "r.content", "n_results")
    status = (
        F.when(F.col("n_calls").isNull(), "orphan")
        .when(F.col("n_results").isNull(), "unanswered")
        .when(F.col("result_position") < F.col("position"), "early")
        .otherwise("linked")
    )
    both = one.join(two, keys, "full_outer").withColumn("status", status)
    return both.select(
        *keys, "status", "position", "result_position", "name", "arguments", "content",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), "level", "place", "valid", "errors", "canonical",
    )


#: Schemas of the calls that ``from_conversations`` makes.
CHAT_SCHEMAS = {
    "configure": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "minLength": 1}, "words": {"type": "integer"}}, "additionalProperties": False},
    "ask": {
        "type": "object",
        "required": ["text", "words"],
        "properties": {"text": {"type": "string", "minLength": 20, "maxLength": 1000}, "words": {"type": "integer", "minimum": 3, "maximum": 150}},
        "additionalProperties": False,
    },
}


#: Turns of a conversation whose calls may need each other in ``from_conversations``.
BLOCK = 8


def from_conversations(chats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of ``conversations(conv_id, turn, role, text)``.

    A user turn is a call of ``ask`` and a system turn one of ``configure``,
    with the text and its number of words as arguments. Of an odd number of words
    it needs the call two turns later, of an even number the one two turns
    before, if that lies in the same ``BLOCK`` turns; so calls wait for later
    ones, and two neighbours may wait for each other. Without a text it needs
    none. An assistant turn is the result of the call one turn before.

    Faults of real logs come with the numbers of words, so that every rule of
    ``link`` has rows: JSON that breaks off (remainder 5 by 11), words as a string
    (3 by 13), a call under the identifier of two turns before that needs none
    (6 by 17), a result for a call that nobody made (2 by 7), and one for the
    turn after it (4 by 7).
    """
    of = lambda back: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    name = F.when(F.col("role") == "user", "ask").when(F.col("role") == "system", "configure")
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    shown = lambda w: F.to_json(F.struct(w.alias("words"), F.col("text")))
    arguments = F.when(words % 13 == 3, shown(words.cast("string"))).otherwise(shown(words))
    arguments = F.when(words % 11 == 5, F.left(arguments, F.length(arguments) - 1)).otherwise(arguments)
    again = (words % 17 == 6) & (F.col("turn") >= 2)
    back = F.when(words % 2 == 1, -2).otherwise(2)
    same = F.floor(F.col("turn") / BLOCK) == F.floor((F.col("turn") - back) / BLOCK)
    needs = F.when(words.isNotNull() & same & ~again, F.array(of(back))).otherwise(F.array().cast("array<string>"))
    answered = F.when(words % 7 == 2, F.concat(of(1), F.lit("x"))).when(words % 7 == 4, of(-1)).otherwise(of(1))
    calls = chats.where(name.isNotNull()).select(
        "conv_id", F.when(F.col("turn").isNotNull(), F.when(again, of(2)).otherwise(of(0))).alias("call_id"), F.col("turn").cast("long").alias("position"), name.alias("name"), arguments.alias("arguments"), needs.alias("needs")
    )
    results = chats.where("role = 'assistant'").select(
        "conv_id", F.when(F.col("turn").isNotNull(), answered).alias("call_id"), F.col("turn").cast("long").alias("position"), F.col("text").alias("content")
    )
    return calls, results
