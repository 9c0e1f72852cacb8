"""Words of many texts at once, as 64-bit hashes, by whole-array NumPy steps.

A word is a run of letters or digits (bytes of letters beyond ASCII count as
letters) of the lower-cased text; with ``lower=False`` and ``by_space=True`` it
is a run between white space. A word's hash is a polynomial in its bytes modulo
2 ** 64, mixed, so it depends on the word alone. Long texts are scanned in parts;
a run without white space that is longer than a part is put together again from
its parts' polynomials, so it has the hash of the whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Characters worked on at once; what the arrays of a scan take follows from it.
CHUNK = 1 << 17
_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xBF58476D1CE4E5B9)
_SPACE = np.zeros(256, bool)
_SPACE[[0, 9, 10, 11, 12, 13, 32]] = True
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_LETTER = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; scans are of a bounded number of bytes, so these are too."""
    if not _powers or len(_powers["up"]) < n:
        size = 1 << max(18, (n - 1).bit_length())
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for name, base in (("up", _P), ("down", inverse)):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * _M
        return h ^ (h >> np.uint64(29))


def split_long(text: str) -> list[tuple[str, bool]]:
    """The text in parts of CHUNK characters at most, cut before white space; True where there was none and a run is cut."""
    parts, at = [], 0
    while len(text) - at > CHUNK:
        cut = max(text.rfind(" ", at + 1, at + CHUNK), text.rfind("\n", at + 1, at + CHUNK))
        parts.append((text[at : cut if cut > 0 else at + CHUNK], cut < 0))
        at = cut if cut > 0 else at + CHUNK
    return [*parts, (text[at:], False)]


def bounded(texts: list[str], *, lower: bool = True) -> Iterator[tuple[list[int], list[str], list[bool]]]:
    """Parts of the texts about CHUNK characters at a time: each one's text, the part, and whether a run goes on in the next."""
    owner, parts, cut, total = [], [], [], 0
    for k, text in enumerate(texts):
        for part, goes_on in split_long(text.lower() if lower else text):
            if parts and total + len(part) > CHUNK:
                yield owner, parts, cut
                owner, parts, cut, total = [], [], [], 0
            owner.append(k)
            parts.append(part)
            cut.append(goes_on)
            total += len(part)
    if parts:
        yield owner, parts, cut


def whole_words(texts: list[str], *, lower: bool = True) -> Iterator[tuple[list[int], list[str]]]:
    """As bounded(), but no cut goes through a word: its beginning waits for the rest. A word longer than CHUNK comes as a part of its own."""
    owner, parts, total = [], [], 0
    for k, text in enumerate(texts):
        text, at = text.lower() if lower else text, 0
        while at < len(text):
            end = at + CHUNK
            if end < len(text) and _LETTER.match(text, end - 1) and _LETTER.match(text, end):  # in a word
                end -= _LETTER.match(text[at:end][::-1]).end()
                end = end if end > at else _LETTER.match(text, at).end()
            part = text[at:end]
            if parts and total + len(part) > CHUNK:
                yield owner, parts
                owner, parts, total = [], [], 0
            owner.append(k)
            parts.append(part)
            total += len(part)
            at = end
    if parts:
        yield owner, parts


def long_word(word: str) -> np.uint64:
    """The polynomial of one word of any length, from pieces of CHUNK characters."""
    total, size = np.uint64(0), 0
    for at in range(0, len(word), CHUNK):
        data = np.frombuffer(word[at : at + CHUNK].encode("utf-8", "replace"), np.uint8)
        with np.errstate(over="ignore"):
            total += sums_of(data, np.zeros(1, np.int64), np.array([len(data)]))[0] * np.uint64(pow(int(_P), size, 1 << 64))
        size += len(data)
    return total


def scan(texts: list[str] | list[bytes], *, by_space: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts joined by zero bytes, and of each word: first byte, end, and the text's number."""
    encoded = [t if isinstance(t, bytes) else t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\0".join(encoded) + b"\0", np.uint8)
    inside = ~_SPACE[data] if by_space else _WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1
    return data, starts, ends, np.searchsorted(np.cumsum(lengths), starts, side="right")


def sums_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The polynomial of each span of bytes, from running sums."""
    up, down = _power_tables(len(data))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64) * up[: len(data)], dtype=np.uint64)])
        return (sums[ends] - sums[starts]) * down[starts]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hashes of spans of bytes: equal bytes, equal hash, wherever they stand."""
    with np.errstate(over="ignore"):
        return mix(sums_of(data, starts, ends) + np.uint64(salt) * _M)


def hash_words(texts: list[str], *, lower: bool = True, by_space: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, text after text, and where each text's words begin (one more entry than texts)."""
    found, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    begun: tuple[np.uint64, int, int] | None = None  # a run that was cut: its polynomial so far, its bytes, its text
    for owner, parts, cut in bounded(texts, lower=lower):
        data, starts, ends, of = scan(parts, by_space=by_space)
        poly = sums_of(data, starts, ends)
        of_text = np.asarray(owner, np.int64)[of]
        keep = np.ones(len(poly), bool)
        if begun or any(cut):
            edges = np.cumsum([0] + [len(p.encode("utf-8", "replace")) + 1 for p in parts]).tolist()
            extra = []
            for k, goes_on in enumerate(cut):
                lo, hi = np.searchsorted(starts, (edges[k], edges[k + 1]))
                first = lo
                if begun:
                    if lo < hi and starts[lo] == edges[k]:
                        with np.errstate(over="ignore"):
                            joined = begun[0] + poly[lo] * np.uint64(pow(int(_P), begun[1], 1 << 64))
                        begun = (joined, begun[1] + int(ends[lo] - starts[lo]), begun[2])
                        if goes_on and ends[lo] == edges[k + 1] - 1:
                            keep[lo] = False
                            continue
                        poly[lo], first = joined, lo + 1
                    else:
                        extra.append((int(lo), begun))
                    begun = None
                if goes_on and first < hi and ends[hi - 1] == edges[k + 1] - 1:
                    keep[hi - 1] = False
                    begun = (poly[hi - 1], int(ends[hi - 1] - starts[hi - 1]), owner[k])
            for at, (value, _, text) in reversed(extra):
                poly, of_text, keep = np.insert(poly, at, value), np.insert(of_text, at, text), np.insert(keep, at, True)
        found.append(mix(poly[keep]))
        counts += np.bincount(of_text[keep], minlength=len(texts))
    return np.concatenate(found), np.concatenate([[0], np.cumsum(counts)])


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `width` words that lie in one text, and their bounds; a text of fewer words gives none."""
    n = len(hashes) - width + 1
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    if n <= 0:
        return np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h = h * _P + hashes[k : k + n]
    inside = np.ones(n, bool)
    for back in range(1, width):  # a run that starts fewer than `width` words before a text's end leaves it
        last = bounds[1:-1] - back
        inside[last[(last >= 0) & (last < n)]] = False
    # texts shorter than the width: every start within them is out as well
    if (short := np.flatnonzero(np.diff(bounds) < width)).size:
        for k in short:
            inside[bounds[k] : min(bounds[k + 1], n)] = False
    return mix(h[inside]), np.concatenate([[0], np.cumsum(counts)])


def groups(texts: list[str], most: int = 1 << 18):
    """(first, end) of runs of texts that hold about `most` characters: what is worked on at once."""
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= most):
            total += len(texts[end])
            end += 1
        yield at, end
        at = end
