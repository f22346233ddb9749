"""The whole guarded question-answering flow as one plan, a row for each query.

Blocked queries are filtered out before retrieval and generation, so neither
ever sees them, and come back with canned answers at the end.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from palisade.functions import fixed, guards, replies
from palisade.operators import memory as mem
from palisade.operators.retrieval import KEY, Found, known_terms, overlap_found, overlap_topk
from palisade.settings import Settings
from palisade.sources import providers
from palisade.sources.scratch import staged

#: Turns whose replies a task holds before it passes them on.
TURNS_HELD = 64
#: Rows that a passage's text is brought to at once, about, and those that a task gives their texts before it passes them on.
GROUP, ROWS_HELD = 1024, 16
REFERENCES = "array<struct<rank:int,ordinal:bigint,key:bigint,score:double>>"
SOURCES = "array<struct<rank:int,ordinal:bigint,content:string,source:string,score:double>>"


def crisis_text(emergency: Column) -> Column:
    """An emergency's message, with its contacts if it has any."""
    contacts = F.concat(F.lit("\n\nEmergency contacts: "), F.array_join(emergency["emergency_contacts"], ", "))
    return F.when(F.size(emergency["emergency_contacts"]) > 0, F.concat(emergency["message"], contacts)).otherwise(emergency["message"])


def user_turn(query: Column, sources: Column) -> Column:
    """The passages as numbered blocks, then the question."""
    blocks = F.transform(
        sources, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] (source: "), F.coalesce(s["source"], F.lit("")), F.lit(")\n"), F.coalesce(s["content"], F.lit("")))
    )
    context = F.when(F.size(sources) > 0, F.array_join(blocks, "\n\n")).otherwise(F.lit(fixed.NO_CONTEXT))
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), query)


def prompt(query: Column, sources: Column, memory: Column | None = None) -> Column:
    """System prompt, remembered messages and the user turn, as an array of messages."""
    message = lambda role, content: F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))
    history = [mem.messages(memory)] if memory is not None else []
    return F.concat(message("system", F.lit(fixed.SYSTEM_PROMPT)), *history, message("user", user_turn(query, sources))).cast(providers.MESSAGES)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` over all cores: guards take far longer than the size of their texts tells, so few bytes must not mean few tasks."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *keys)


def gathered(ranked: DataFrame) -> DataFrame:
    """``(query_id, sources)`` of a ranked list: at most top-k passages a query, in order."""
    ranked = spread(ranked, "query_id")
    entry = F.struct(F.col("rank").cast("int").alias("rank"), F.col("ordinal").cast("bigint").alias("ordinal"), "content", "source", "score")
    return ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).cast(SOURCES).alias("sources"))


def grounded(rows: DataFrame, draft: Column, found: Found) -> DataFrame:
    """``rows(query_id, ...)`` with ``sources``, references to their lists' passages, and ``known``, the draft's tokens that these have."""
    entry = F.struct("rank", "ordinal", "key", "score")
    lists = spread(found.lists, "query_id").groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).cast(REFERENCES).alias("sources"))
    known = known_terms(rows.select("query_id", draft.alias("text")), found)
    out = rows.join(lists.hint("merge"), "query_id", "left").join(known.hint("merge"), "query_id", "left")
    return out.withColumns({"sources": F.coalesce("sources", F.array().cast(REFERENCES)), "known": F.coalesce("known", F.array().cast("array<string>"))})


def with_texts(rows: DataFrame, found: Found) -> DataFrame:
    """``rows(query_id, sources, ...)`` whose references, as ``grounded`` gives them, become passages with content and source.

    Rows are dealt into groups of about ``GROUP``, those with the same first passages together, and
    each group gets the text of a passage once. A task keeps the texts of one group and
    writes them into its rows, few at a time; nothing with a text is shuffled after that.
    """
    spark = rows.sparkSession
    rows = staged(rows, "answered")
    n = rows.count()
    groups = max(1, -(-n // GROUP), min(3 * spark.sparkContext.defaultParallelism, n // 64))
    first = [F.get(F.col("sources.ordinal"), F.lit(k)) for k in range(3)]
    dealt = rows.repartitionByRange(groups, *first, F.xxhash64("query_id")).withColumn("_group", F.spark_partition_id())
    dealt = staged(dealt, "dealt")
    wanted = dealt.select("_group", F.explode("sources").alias("s")).select("_group", "s.ordinal", "s.key").distinct()
    texts = wanted.hint("merge").join(found.passages.select(*KEY, "content", "source"), [*KEY])
    row = F.struct(*rows.columns)
    sent = texts.select("_group", *KEY, "content", "source").withColumn("_row", F.lit(None).cast(dealt.select(row.alias("r")).schema["r"].dataType))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("ordinal", "long"), ("key", "long"), ("content", "string"), ("source", "string"))]
    sent = sent.unionByName(dealt.select("_group", *none, row.alias("_row")))
    # a group's texts come before its rows
    sent = sent.repartition(2 * groups, "_group").sortWithinPartitions("_group", F.col("_row").isNotNull())
    schema = rows.drop("sources").withColumn("sources", F.lit(None).cast(SOURCES)).select(rows.columns).schema
    at, kind = rows.columns.index("sources"), to_arrow_type(schema["sources"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS_HELD):
                b = whole.slice(a, ROWS_HELD)
                own, full = b.column("_row"), b.column("_row").is_valid().to_pylist()
                kept, sources = [], []
                for i, (group, ordinal, key, content, source) in enumerate(zip(*(c.to_pylist() for c in b.columns[:5]))):
                    if group != now:
                        now, known = group, {}
                    if not full[i]:
                        known[ordinal, key] = content, source
                        continue
                    kept.append(i)
                    found = []
                    for s in own[i]["sources"].as_py():
                        content, source = known[s["ordinal"], s["key"]]
                        found.append({"rank": s["rank"], "ordinal": s["ordinal"], "content": content, "source": source, "score": s["score"]})
                    sources.append(found)
                if kept:
                    columns = own.take(pa.array(kept)).flatten()
                    columns[at] = pa.array(sources, kind)
                    yield pa.RecordBatch.from_arrays(columns, schema.names)

    return sent.mapInArrow(run, schema)


def guarded(queries: DataFrame, settings: Settings) -> DataFrame:
    """``queries(query_id, text, ...)`` with the input guard's verdict as ``input``."""
    return queries.withColumn("input", guards.input_guard(F.col("text"), settings.input_guard_enabled, settings.emergency_detection_enabled))


def retrieved(checked: DataFrame, corpus: DataFrame, top_k: int, retriever: Callable[..., DataFrame] = overlap_topk) -> DataFrame:
    """The safe rows of ``checked``, with ``safe_query`` and ``sources``."""
    safe = checked.where("input.is_safe").withColumn("safe_query", F.col("input.sanitized_text"))
    found = gathered(retriever(safe.select("query_id", F.col("safe_query").alias("query")), corpus, top_k))
    # gathered passages are far more than the planner knows: never a broadcast
    return spread(safe, "query_id").join(found.hint("merge"), "query_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast(SOURCES)))


def judged(drafted: DataFrame, settings: Settings, known: Column | None = None) -> DataFrame:
    """Rows with ``draft, safe_query, sources``: adds ``hallucination``, ``output``, ``answer`` and ``was_blocked``.

    ``known``, if given, has the draft's tokens that the sources have; then sources may be references.
    """
    context = F.transform("sources", lambda s: s["content"]) if known is None else F.col("sources")
    rows = drafted.withColumn("_context", context)
    rows = rows.withColumn("hallucination", guards.hallucination(F.col("draft"), F.col("_context"), settings.hallucination_threshold, known))
    rows = rows.withColumn("output", guards.output_guard(F.col("draft"), F.col("safe_query"), F.col("_context"), settings.hallucination_threshold, settings.output_guard_enabled, known))
    answer = F.when(F.col("output.is_safe"), F.col("output.sanitized_output")).otherwise(F.lit(fixed.OUTPUT_REFUSAL))
    return rows.withColumns({"answer": answer, "was_blocked": ~F.col("output.is_safe"), "block_reason": F.col("output.blocked_reason")}).drop("_context")


def blocked(checked: DataFrame, like: DataFrame) -> DataFrame:
    """The unsafe rows of ``checked`` as answers with neutral verdicts, in the shape of ``like``."""
    critical = F.coalesce(F.col("input.emergency.severity") == "critical", F.lit(False))
    answer = F.when(critical, crisis_text(F.col("input.emergency"))).otherwise(F.lit(fixed.REFUSAL))
    types = {f.name: f.dataType.simpleString() for f in like.schema.fields}  # all parts nullable
    none = F.array().cast("array<string>")
    neutral = {
        "answer": answer,
        "was_blocked": F.lit(True),
        "block_reason": F.col("input.blocked_reason"),
        "sources": F.array().cast(types.get("sources", SOURCES)),
        "hallucination": F.struct(F.lit(0.0).alias("score"), none.alias("grounded_claims"), none.alias("ungrounded_claims"), F.lit("grounded").alias("verdict"), F.lit(0).cast("long").alias("n_ungrounded"), F.lit(0).cast("long").alias("n_claims")),
        "output": F.struct(F.lit(True).alias("is_safe"), F.lit(None).cast("string").alias("blocked_reason"), answer.alias("sanitized_output"), F.lit(1.0).alias("confidence_score"), none.alias("warnings")),
    }
    rows = checked.where("not input.is_safe")
    return rows.select(*(neutral.get(c, F.col(c) if c in rows.columns else F.lit(None)).cast(types[c]).alias(c) for c in like.columns))


def answer(
    queries: DataFrame,
    corpus: DataFrame,
    settings: Settings | None = None,
    top_k: int = 5,
    provider: providers.Provider | None = None,
    recorded: str | None = None,
    memory: str | None = None,
    retriever: Callable[..., DataFrame] = overlap_topk,
) -> DataFrame:
    """Answer each row of ``queries(query_id, text, ...)`` from ``corpus``.

    The draft is the column ``recorded`` if one is named, else the provider's
    reply, else the best passage. ``memory`` names a column of earlier turns.
    Adds ``input, safe_query, sources, messages, draft, hallucination, output,
    answer, was_blocked, block_reason``; query ids must differ. Rows with a null
    text are left out.
    """
    settings = settings or Settings()
    # the guard's verdicts are used three times and made once
    checked = staged(guarded(spread(queries.where("text is not null")), settings), "checked")
    rows = retrieved(checked, corpus, top_k, retriever)
    rows = rows.withColumn("messages", prompt(F.col("safe_query"), F.col("sources"), F.col(memory) if memory else None))
    if recorded:
        rows = rows.withColumn("draft", providers.replayed(F.col(recorded)))
    elif provider is not None:
        rows = providers.completed(rows, provider, "_reply").withColumn("draft", F.col("_reply.content")).drop("_reply")
    else:
        rows = rows.withColumn("draft", providers.extracted(F.col("sources")))
    done = judged(rows, settings)
    return done.unionByName(blocked(checked, done))


def replay(turns: DataFrame, corpus: DataFrame, settings: Settings | None = None, top_k: int = 5, columns: Sequence[str] = ()) -> DataFrame:
    """Answer recorded ``turns(query_id, conv_id, turn, text, recorded)``, each with its conversation's memory.

    Recorded drafts do not depend on the memory, so all turns are answered at
    once, and the memory is a window over the finished ones: sanitised queries
    with final answers of the turns that were not blocked. Verdicts need the drafts' tokens
    only, so the passages' texts come last, to sources and messages. ``columns`` are those
    that are wanted (all, by default; ``n_sources`` is one more): without these two, no text is fetched.
    """
    settings = settings or Settings()
    checked = staged(guarded(spread(turns.where("text is not null")), settings), "checked")
    safe = checked.where("input.is_safe").withColumn("safe_query", F.col("input.sanitized_text"))
    found = overlap_found(safe.select("query_id", F.col("safe_query").alias("query")), corpus, top_k)
    rows = grounded(spread(safe.withColumn("draft", providers.replayed(F.col("recorded"))), "query_id"), F.col("draft"), found)
    done = judged(rows, settings, F.col("known")).drop("known")
    done = done.unionByName(blocked(checked, done)).withColumnsRenamed({"text": "query_text"})
    rows = done.withColumn("user", F.col("safe_query")).withColumn("assistant", F.col("answer"))
    rows = mem.remembered(rows, settings.memory_window, ~F.col("was_blocked")).drop("user", "assistant").withColumnRenamed("query_text", "text")
    if columns and not {"sources", "messages"} & set(columns):
        return rows.withColumn("n_sources", F.size("sources")).select(*columns)
    needed = [c for c in rows.columns if not columns or c in {*columns, "query_id", "safe_query", "memory", "sources"}]
    rows = with_texts(rows.select(*needed), found)
    full = prompt(F.col("safe_query"), F.col("sources"), F.col("memory"))
    rows = rows.withColumn("messages", F.when(F.col("safe_query").isNotNull(), full)).withColumn("n_sources", F.size("sources"))
    return rows.select(*columns) if columns else rows.drop("n_sources")


def converse(
    turns: DataFrame,
    corpus: DataFrame,
    provider: providers.Provider,
    settings: Settings | None = None,
    top_k: int = 5,
    retriever: Callable[..., DataFrame] = overlap_topk,
    **options: Any,
) -> DataFrame:
    """Answer ``turns(query_id, conv_id, turn, text)`` with a live provider, whose prompts hold earlier answers.

    Input guard and retrieval are one plan over all turns. Then each conversation is a
    sorted stream in one task, which calls the provider turn after turn and keeps the
    last ``memory_window`` turns that were answered; so a long conversation is one job
    and is never held whole. Turns of one number follow each other by their
    texts, then ids; a null conv_id is one conversation. A task that is lost and
    run again calls the provider again. Rows with a null text are left out.
    """
    settings = settings or Settings()
    checked = guarded(turns.where("text is not null"), settings)
    safe = retrieved(checked, corpus, top_k, retriever)
    rows = safe.unionByName(checked.where("not input.is_safe"), allowMissingColumns=True)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    rows = rows.withColumn("_own", F.when(F.col("safe_query").isNotNull(), message("user", user_turn(F.col("safe_query"), F.col("sources")))))
    schema = rows.drop("_own", "memory", "messages", "draft").withColumns({"memory": F.lit(None).cast(mem.TURNS), "messages": F.lit(None).cast(providers.MESSAGES), "draft": F.lit(None).cast("string")}).schema
    names = [f.name for f in schema.fields[:-3]]
    kinds = [to_arrow_type(f.dataType) for f in schema.fields[-3:]]

    def talk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = {"role": "system", "content": fixed.SYSTEM_PROMPT}
        now, kept = object(), deque(maxlen=settings.memory_window)
        for whole in batches:
            # a few turns at a time: their replies go on while the provider is asked for more
            for at in range(0, whole.num_rows, TURNS_HELD):
                b = whole.slice(at, TURNS_HELD)
                out = []
                for conv, query, own in zip(*(b.column(c).to_pylist() for c in ("conv_id", "safe_query", "_own"))):
                    if conv != now:
                        now, kept = conv, deque(maxlen=settings.memory_window)
                    memory, messages, draft = list(kept), None, None
                    if own is not None:
                        past = [{"role": r, "content": t[r]} for t in memory for r in ("user", "assistant")]
                        messages = [system, *past, own]
                        draft = provider.complete(messages, **options).content
                        answer, was_blocked = replies.answer(draft, query, settings.output_guard_enabled)
                        if not was_blocked:
                            kept.append({"user": query, "assistant": answer})
                    out.append((memory, messages, draft))
                new = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *new], schema.names)

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "text", "query_id")
    talked = staged(ordered.drop("memory", "messages", "draft").mapInArrow(talk, schema), "conversations")
    done = judged(talked.where("input.is_safe"), settings)
    return done.unionByName(blocked(talked.where("not input.is_safe"), done))


def pieces(drafts: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The streamed form of ``drafts(query_id, draft, safe_query, sources, pieces)`` as rows ``(query_id, piece_no, piece, kept)``.

    Pieces pass on as they came, before any check. A draft that fails the output
    guard afterwards gets a notice as its last piece, and is not ``kept`` in
    memory.
    """
    checked = judged(drafts, settings or Settings())
    shown = F.when(F.col("was_blocked"), F.concat("pieces", F.array(F.lit(fixed.STREAM_NOTICE)))).otherwise(F.col("pieces"))
    return checked.select("query_id", F.posexplode(shown).alias("piece_no", "piece"), (~F.col("was_blocked")).alias("kept"))


def blocked_pieces(queries: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The one piece that a query blocked by the input guard is answered with."""
    rows = guarded(queries.where("text is not null"), settings or Settings()).where("not input.is_safe")
    critical = F.coalesce(F.col("input.emergency.severity") == "critical", F.lit(False))
    piece = F.when(critical, crisis_text(F.col("input.emergency"))).otherwise(F.lit(fixed.REFUSAL))
    return rows.select("query_id", F.lit(0).alias("piece_no"), piece.alias("piece"), F.lit(False).alias("kept"))
