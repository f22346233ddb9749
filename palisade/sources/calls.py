"""Requests to a service from within a task: a bounded number at once, again after failures that pass, results in order."""

from __future__ import annotations

import random
import time
import urllib.error
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any, NamedTuple


class Calls(NamedTuple):
    """How a task talks to a service: requests at once, tries of each, and seconds before the second try, doubled for each further one up to ``longest``."""

    at_once: int = 8
    tries: int = 4
    pause: float = 0.5
    longest: float = 30.0


def transient(e: BaseException | None) -> bool:
    """Whether a failure may pass: a connection that broke or timed out, too many requests, or a service that is down."""
    while e is not None:
        if isinstance(e, urllib.error.HTTPError):
            return e.code in (408, 425, 429) or e.code >= 500
        if isinstance(e, OSError):
            return True
        e = e.__cause__
    return False


def asked_to_wait(e: BaseException | None) -> float:
    """Seconds that a service asks for in its answer; 0 if it does not."""
    while e is not None:
        if isinstance(e, urllib.error.HTTPError):
            value = (e.headers or {}).get("Retry-After", "")
            return float(value) if value and value.isdigit() else 0.0
        e = e.__cause__
    return 0.0


def tried(call: Callable[[Any], Any], item: Any, calls: Calls, sleep: Callable[[float], None] = time.sleep) -> Any:
    """``call(item)``, again after a failure that may pass; the last failure is raised."""
    for n in range(1, max(calls.tries, 1) + 1):
        try:
            return call(item)
        except Exception as e:
            if n >= calls.tries or not transient(e):
                raise
            # spread, so that tasks that failed together do not come back together
            wait = min(calls.longest, calls.pause * 2 ** (n - 1)) * random.uniform(0.5, 1.0)
            sleep(max(wait, min(asked_to_wait(e), calls.longest)))
    raise AssertionError


def called(items: Iterable[Any], call: Callable[[Any], Any], calls: Calls = Calls()) -> Iterator[Any]:
    """Results of ``call`` for each item, in order; at most ``at_once`` items are read ahead and asked for at a time.

    The first failure that does not pass is raised, and what has not begun is not asked for.
    """
    if calls.at_once <= 1:
        for item in items:
            yield tried(call, item, calls)
        return
    with ThreadPoolExecutor(calls.at_once) as pool:
        waiting: deque[Future] = deque()
        try:
            for item in items:
                waiting.append(pool.submit(tried, call, item, calls))
                if len(waiting) >= calls.at_once:
                    yield waiting.popleft().result()
            while waiting:
                yield waiting.popleft().result()
        finally:
            for f in waiting:
                f.cancel()
