"""Queries written in SQL alone give what the columns give."""

import pytest
from pyspark.sql import functions as F

from palisade import queries, sql
from palisade.functions import emergency, guards, text
from palisade.operators import inverted, retrieval

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def installed(spark):
    sql.install(spark)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n"), (-4, "no sick'sick isn't sick"), (-5, "a@b.org. Call 0712345678!  One? the of.")], "prompt_id long, text string")
    queries.prompts(spark, SF).unionByName(odd).createOrReplaceTempView("prompts")
    return spark


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(("name", "column"), [("content_tokens", text.content_tokens), ("claims", guards.claims), ("redact_pii", text.redact), ("sanitize_text", text.sanitize), ("injection_reason", guards.injection_reason), ("harmful_reason", guards.harmful_reason)])
def test_texts(installed, name, column):
    assert rows(installed.sql(f"SELECT prompt_id, {name}(text) AS x FROM prompts")) == rows(installed.table("prompts").select("prompt_id", column(F.col("text")).alias("x")))


def test_guard(installed):
    e = emergency.detect(F.col("text"))
    assert rows(installed.sql("SELECT prompt_id, e.severity, e.category FROM (SELECT prompt_id, emergency(text) AS e FROM prompts)")) == rows(installed.table("prompts").select("prompt_id", e["severity"], e["category"]))
    got = installed.sql("SELECT prompt_id, g.* FROM (SELECT prompt_id, input_guard(text) AS g FROM prompts)")
    want = installed.table("prompts").withColumn("g", guards.input_guard(F.col("text"))).select("prompt_id", "g.is_safe", "g.blocked_reason", "g.emergency.severity", "g.emergency.category", "g.sanitized_text")
    assert rows(got) == rows(want)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_topk(installed):
    index = inverted.build(queries.documents(installed, SF))
    sql.install_topk(installed, index)
    question = queries.turns(installed, SF).orderBy("query_id").first().text
    got = installed.sql("SELECT rank, ordinal, hits, n_terms, score FROM overlap_topk(:q, 4)", args={"q": question})
    asked = installed.createDataFrame([(1, question)], "query_id long, query string")
    assert rows(got) == rows(retrieval.overlap_best(asked, queries.documents(installed, SF), 4).select("rank", "ordinal", "hits", "n_terms", "score")) and got.count() == 4
