"""Small corpora for the corpus operators: planted cases, edge rows, brute-force helpers."""

from __future__ import annotations

import random
import re

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Clashing names: whatever an operator adds must not collide with what a table brings.
CLASHING = DOC + ", score double, spans string, base string, key bigint, sid binary, tid bigint, n int, k0 string, class_id bigint, length bigint, words array<string>"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary):03d}x" for _ in range(n)]


def rows(texts, **columns):
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def edge_texts() -> list:
    rng = random.Random(5)
    long = " ".join(words(rng, 30_000, 5000))
    base = " ".join(words(rng, 200))
    return [None, "", " \n\t ", "one", "a b c d", "mail a.b@c.example.org now", base, base, base, long, "no space" * 4000, "ß ﬁ İ ς 日本   🙂 x", "the " * 300]


def edge_frames(spark):
    """(name, frame): edge rows (nulls in every column, repeats, ties), an empty table, and clashing columns."""
    texts = edge_texts()
    plain = [(i, t, "en", None, None) for i, t in enumerate(texts)] + [(6, texts[6], "en", "s", 1), (None, "null id text of some words here", None, None, None), (None, None, None, None, None)]
    wide = [(*r, 0.5, "x", "y", 1, b"z", 2, 3, "k", 4, 5, ["q"]) for r in plain]
    return [("edge", spark.createDataFrame(plain, DOC)), ("empty", spark.createDataFrame([], DOC)), ("clashing", spark.createDataFrame(wide, CLASHING))]


def shingle_set(text: str, width: int = 5) -> frozenset:
    w = re.findall(r"[^\W_]+", text.lower())
    return frozenset(zip(*(w[k:] for k in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else [])
