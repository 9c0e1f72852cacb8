"""Calls to a remote model from within a task: several in flight, answers in order, a bounded rate.

A call waits for its answer, so a task that made one at a time would leave its
core idle and tie the number of calls in flight to the number of partitions.
"""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor


class Bucket:
    """Lets `per_second` calls through, `burst` at once at most; takers wait their turn.

    A bucket counts for its task: a service's limit is to be divided by the number of tasks that run at once.
    """

    def __init__(self, per_second: float, burst: int = 1, *, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if per_second <= 0 or burst < 1:
            raise ValueError("a rate over 0 and a burst of 1 at least")
        self._gap, self._ahead, self._now, self._sleep = 1 / per_second, (burst - 1) / per_second, now, sleep
        self._free, self._lock = float("-inf"), threading.Lock()

    def take(self) -> None:
        with self._lock:
            now = self._now()
            turn = max(self._free, now - self._ahead)
            self._free = turn + self._gap
        if turn > now:
            self._sleep(turn - now)


def pooled(items: Iterable, call: Callable, *, at_once: int = 8, ahead: int | None = None, bucket: Bucket | None = None) -> Iterator:
    """call(item) of each item, in order, with up to `at_once` calls in flight.

    A slow call, one that is retried say, holds back the answers behind it but not their calls, until `ahead` items (16 for each
    call in flight unless given) wait: that many answers are held at most. An error is raised at its item's turn, and
    calls that haven't begun then are not made. The items are taken as they are needed.
    """

    def one(item):
        if bucket is not None:
            bucket.take()
        return call(item)

    most = max(at_once, ahead or 16 * at_once)
    waiting: deque = deque()
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        try:
            for item in items:
                waiting.append(pool.submit(one, item))
                if len(waiting) >= most:
                    yield waiting.popleft().result()
                while waiting and waiting[0].done():
                    yield waiting.popleft().result()
            while waiting:
                yield waiting.popleft().result()
        finally:
            for future in waiting:
                future.cancel()
