"""Label providers: one protocol, a deterministic offline default, fallback and retry around any of them.

A provider takes a batch as (alias, text) rows and answers with JSON text, as a
remote model would, so parsing, guard and split run for real. HashProvider is a
test double: its labels follow from a hash of the text and carry no meaning.
"""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from ..schemas import INTENTS, SENTIMENTS


class Failure(Enum):
    """How an error class is met (retry the same model, fall back to another)."""

    AUTH = (False, False)
    BAD_REQUEST = (False, False)
    PERMISSION = (False, False)
    UNPROCESSABLE = (False, False)
    NOT_FOUND = (False, True)
    RATE_LIMIT = (False, True)
    SERVER = (True, True)
    TIMEOUT = (True, True)
    CONNECTION = (True, True)

    @property
    def retry(self) -> bool:
        return self.value[0]

    @property
    def fall_back(self) -> bool:
        return self.value[1]


#: Statuses of an HTTP answer that may pass, and those that no other model would cure.
PASSING = (429, 500, 502, 503, 504)
REFUSED = (401, 403)


def embedding_failure(status: int) -> Failure | None:
    """How an answer of the embedding service is met: None if it is fine."""
    if 200 <= status < 300:
        return None
    if status in REFUSED:
        return Failure.AUTH if status == 401 else Failure.PERMISSION
    return Failure.SERVER if status in PASSING else Failure.NOT_FOUND


class ModelError(Exception):
    def __init__(self, failure: Failure, message: str = ""):
        super().__init__(f"{failure.name}: {message}")
        self.failure = failure


def stub_number(text: str) -> int:
    return int(hashlib.sha256(text.encode()).hexdigest()[:4], 16)


@dataclass
class HashProvider:
    kind: str  # sentiment, intent

    def label(self, batch: list[tuple[str, str]]) -> str:
        out = []
        for alias, text in batch:
            h = stub_number(text)
            if self.kind == "sentiment":
                out.append({"comment_id": alias, "sentiment": SENTIMENTS[h % 5], "confidence": (h % 101) / 100})
            else:
                out.append({"comment_id": alias, "intent": INTENTS[h % 5], "is_request": h % 7 == 0, "is_confusion": h % 11 == 0})
        return json.dumps({"results": out})


@dataclass
class HashEmbedder:
    """Vectors of `width` numbers from a hash of the text, answered in reverse order as a remote model may."""

    width: int = 8

    def embed(self, texts: list[str]) -> str:
        digest = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
        data = [{"index": i, "embedding": [int(h[4 * k : 4 * k + 4], 16) / 65536 for k in range(self.width)]} for i, h in enumerate(digest)]
        return json.dumps({"data": data[::-1]})


@dataclass
class Chain:
    """Tries providers in order, each with its own retries of passing failures."""

    providers: list
    attempts: int = 4
    pause: float = 0.5
    longest: float = 8.0
    sleep: Callable[[float], None] = time.sleep

    def label(self, batch: list[tuple[str, str]]) -> str:
        last = None
        for provider in self.providers:
            try:
                return self._with_retry(provider, batch)
            except ModelError as e:
                if not e.failure.fall_back:
                    raise
                last = e
        raise last

    def _with_retry(self, provider, batch):
        for attempt in range(self.attempts):
            try:
                return provider.label(batch)
            except ModelError as e:
                if not e.failure.retry or attempt + 1 == self.attempts:
                    raise
                self.sleep(random.uniform(0, min(self.longest, self.pause * 2**attempt)))


def offline_synthesis(kind: str, texts: list[str]) -> str:
    """A draft that quotes its first texts, as JSON."""
    first = sorted(t for t in texts if t)[:2]
    if kind == "request":
        return json.dumps({"theme": first[0][:60] if first else "", "quotes": first, "suggested_title": None})
    if kind == "confusion":
        return json.dumps({"sticking_point": first[0][:60] if first else "", "quotes": first, "timestamp_hint": None})
    return json.dumps({"top_negative_driver": first[0][:60] if first else "", "quotes": first})
