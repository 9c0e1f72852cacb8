import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from earshot.llm import packing, tokens

from .fixtures import SF, edge_frames, edge_texts


def test_ids_are_the_tokenizers():
    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    texts = [x for x in edge_texts() if x] + ["<|endoftext|> it's  1234\n\n x", "'ll 've \t\tend "]
    assert [e.ids for e in t.encode_batch(texts, add_special_tokens=False)] == [tokens.load(tokens.default_path()).encode_ordinary(x) for x in texts]


def best_fit_decreasing(lengths, size):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(size - n)
    return len(gaps)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=12), st.lists(st.integers(0, 9), max_size=12))
def test_missed_pieces_go_to_the_nearest_tasks_before(missed, places):
    runs = packing.pair_tasks(dict(enumerate(missed)), dict(enumerate(places)))
    expected, stack = [], []
    for part in range(max(len(missed), len(places))):
        for k in range(missed[part] if part < len(missed) else 0):
            if stack:
                expected.append((part, k, *stack.pop()))
        if part < len(places):
            stack += [(part, n) for n in reversed(range(places[part]))]
    assert [(part, first + k, other, at + k) for part, first, end, other, at in runs for k in range(end - first)] == expected


def lengths_of(kind, size):
    draw = random.Random(kind)
    if kind == "uniform":
        return [draw.randint(1, size) for _ in range(1500)]
    if kind == "short":
        return [draw.choice((1, 1, 2, 3, 5)) for _ in range(1500)] + [size] * 3
    if kind == "hot":
        return [size * 2 // 5] * 500 + [draw.randint(1, size // 3) for _ in range(900)]
    if kind == "big gaps first":
        return [size // 2 + 1] * 200 + [draw.randint(1, 9) for _ in range(900)]
    return []


@pytest.mark.parametrize("rows_per_task", [150, 10**6])
@pytest.mark.parametrize("kind", ["uniform", "short", "hot", "big gaps first", "none"])
def test_supersteps_against_best_fit_decreasing(spark, kind, rows_per_task):
    size = 256
    lengths = lengths_of(kind, size)
    df = spark.createDataFrame([(k, 0, n) for k, n in enumerate(lengths)], "doc_id long, piece int, length long")
    out = packing.pack(df, seq_len=size, rows_per_task=rows_per_task).collect()
    assert sorted((r.doc_id, r.length) for r in out) == list(enumerate(lengths))
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    best = best_fit_decreasing(lengths, size)
    print(kind, rows_per_task, len(sequences), best, sum(lengths) / size)
    assert len(sequences) == best if rows_per_task > 150 else len(sequences) <= best * 1.03 + 1


def check(df, out, seq_len=2048):
    encode = tokens.load(tokens.default_path()).encode_ordinary
    expected = []
    for doc, text in df.select("doc_id", "text").collect():
        ids = [*encode(text or ""), 0]
        first = len(ids) % seq_len or seq_len
        edges = [0, *range(first, len(ids) + 1, seq_len)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            expected.append((repr(doc), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = [(repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out]
    assert sorted(got) == sorted(expected)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= seq_len
    return len(sequences)


def test_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    out = packing.pack_documents(df).collect()
    n = check(df, out)
    assert n <= -(-sum(r.length for r in out) // 2048) * 1.02 + 1


def test_edges(spark):
    for name, df in edge_frames(spark):
        check(df, packing.pack_documents(df).collect()), name


def test_assembled_sequences(spark):
    df = spark.createDataFrame([(i, "word " * random.Random(i).randrange(1, 60)) for i in range(40)], "doc_id bigint, text string")
    packed = packing.pack_documents(df, seq_len=64, with_ids=True)
    for r in packing.assemble(packed).collect():
        assert len(r.ids) <= 64 and r.starts[0] == 0
