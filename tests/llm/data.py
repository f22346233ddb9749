"""Small tables that hold the awkward cases."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(6000))


def documents(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """``rows`` of (doc_id, text, lang, source), with columns whose names operators also use inside."""
    rows = awkward() if rows is None else rows
    full = [(*r, len(r[1]) if r[1] is not None else None, 1, "c", 2.0) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, fp long, rank string, score double")


def awkward() -> list[tuple]:
    rng = random.Random(3)
    base = [" ".join(rng.choice("alpha beta gamma delta über nous sommes the of and 42 x".split()) for _ in range(n)) for n in (0, 1, 2, 3, 40, 90, 300)]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [
        (20, None, "en", None), (21, "", None, "s1"), (22, "  \n\n ", "de", "s1"), (None, base[5], "en", "s2"), (23, base[5], None, None), (24, base[6] + " extra", "en", "s0"),
        (24, base[4], "de", "s0"), (25, base[4], "de", "s0"), (25, base[4], "de", "s0"), (26, LONG, "en", "s1"), (27, LONG + " tail", "en", "s1"), (28, "12345 !!! 678", "en", "s2"),
        (29, "line one\nLine  ONE\nline two\n\nline one", "en", "s2"), (30, "é" * 500, "fr", "s2"), (31, "é" * 500 + "x" * 3, "fr", "s2"),
    ]
    return rows
