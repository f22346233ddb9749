"""From raw documents to a training mix, one operator a stage.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept. What a stage returns is written as Parquet and read again, so a lost
executor costs at most one stage, and every stage starts from a plain scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import decontamination, langid, lines, mixing, simhash
from palisade.sources.scratch import discard, release, staged, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Language scores below this are noise that no learnt language explains.
LEAST_SCORE = 0.2


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are written in a known language.

    A text without letters, a null text, and one that scores under
    ``LEAST_SCORE`` go. The predicted language is the new ``lang``. Rows with a
    null doc_id or source, and repeated ones, are judged like others; an empty
    table gives no rows.
    """
    rows = docs.select(*COLUMNS)
    model = langid.fit(rows.where(~langid.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    judged = langid.predicted(rows, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return judged.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the smallest doc_id (null last).

    Null and wordless texts are copies of each other, repeated rows become one;
    an empty table gives no rows.
    """
    return simhash.keep_one(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines, and the passages of over 50 words within lines, that come earlier: in an earlier document, or in the same.

    A null text stays null; a text of which only blanks are left goes. Rows that
    share doc_id and text are one occurrence; an empty table gives no rows.
    """
    return _counted(lines.cut(docs.select(*COLUMNS)))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks.

    Null texts and items have no leak; repeated rows are judged alike; an empty
    table on either side gives no leak.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.search(docs.select(*COLUMNS), benchmark, "_hits").where(F.size("_hits") == 0).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents with how often, and how many words of them, it takes.

    The null source is one of its own; null and wordless texts are taken 0 times
    and go; rows of one id stay rows of their own; an empty table gives no rows.
    """
    mixed = mixing.mix(docs.select(*COLUMNS), carry=("text", "lang")).where("taken > 0")
    return mixed.withColumn("repetitions", F.col("taken") / F.col("size"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
]

#: Language ID, the near-duplicate fingerprints and latent retrieval are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what a stage has staged goes once its result is written, and that once the next one is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = written()
        kept = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(written() - before - {kept._scratch_path})
        discard(docs)
        docs = kept
    return docs
