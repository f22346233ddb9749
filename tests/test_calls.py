"""Requests from tasks: bounded, in order, again after failures that pass."""

import email.message
import threading
import time
import urllib.error

import pytest
from pyspark.sql import functions as F

from palisade.operators.retrieval import RetrieverError
from palisade.settings import Settings
from palisade.sources import calls, providers, vector_store
from palisade.sources.calls import Calls


def failure(code, **headers):
    h = email.message.Message()
    for k, v in headers.items():
        h[k.replace("_", "-")] = v
    return urllib.error.HTTPError("http://x", code, "no", h, None)


def test_in_order_and_bounded():
    now, most, lock = 0, 0, threading.Lock()

    def call(n):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(0.01 * (5 - n % 5))
        with lock:
            now -= 1
        return n * n

    read = []
    out = calls.called((read.append(n) or n for n in range(30)), call, Calls(4))
    assert next(out) == 0 and len(read) <= 5
    assert list(out) == [n * n for n in range(1, 30)] and 1 < most <= 4
    assert list(calls.called(range(3), call, Calls(1))) == [0, 1, 4]


def test_failures_that_pass():
    slept, seen = [], []

    def call(item):
        seen.append(item)
        if len(seen) < 3:
            raise providers.ProviderError("busy") from failure(429, Retry_After="7")
        return "ok"

    assert calls.tried(call, "a", Calls(), slept.append) == "ok" and len(seen) == 3 and slept == [7.0, 7.0]
    for e, n in ((failure(401), 1), (failure(503), 4), (ConnectionResetError(), 4), (ValueError(), 1)):
        seen.clear()

        def broken(item, e=e):
            seen.append(item)
            raise e

        with pytest.raises(type(e)):
            calls.tried(broken, "a", Calls(pause=0.1), slept.append)
        assert len(seen) == n
    with pytest.raises(ValueError):
        list(calls.called([1, 0, 2], lambda n: (_ for _ in ()).throw(ValueError()) if n == 0 else n, Calls(2)))


class Flaky:
    """Fails with a passing error on the first request of each question in a process."""

    seen: set = set()

    def complete(self, messages, **options):
        asked = messages[-1]["content"]
        if asked not in self.seen:
            self.seen.add(asked)
            raise providers.ProviderError("down") from failure(503)
        return providers.ProviderResponse(f"re: {asked}", "m")


def test_replies_by_a_service_that_fails_at_first(spark):
    rows = spark.range(50).select("id", F.array(F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))).alias("messages")).repartition(3)
    got = {r.id: r.reply.content for r in providers.completed(rows, Flaky(), calls=Calls(4, pause=0.001)).collect()}
    assert got == {n: f"re: {n}" for n in range(50)}
    with pytest.raises(Exception, match="down"):
        providers.completed(rows.where("id = 99").unionByName(rows.limit(1).withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.lit("new").alias("content"))))), Flaky(), calls=Calls(tries=1)).collect()


def test_searches_by_a_store_that_fails_at_first(spark):
    asked = spark.createDataFrame([(n, f"alpha beta{n}") for n in range(12)], "query_id long, query string")
    tried = []

    def transport(url, headers, body):
        key = str(body["vector"])
        if key not in tried:
            tried.append(key)
            raise failure(500)
        return iter([{"result": [{"id": 9, "score": 0.5, "payload": {"text": "t"}}]}])

    settings = Settings(qdrant_url="http://store")
    out = vector_store.search(asked, settings=settings, transport=transport, calls=Calls(3, pause=0.001)).collect()
    assert sorted(r.query_id for r in out) == list(range(12))
    with pytest.raises(Exception, match="failed"):
        vector_store.search(asked, settings=settings, transport=lambda *a: (_ for _ in ()).throw(failure(404)), calls=Calls(3)).collect()
    with pytest.raises(RetrieverError):
        vector_store.search(asked, settings=Settings())
