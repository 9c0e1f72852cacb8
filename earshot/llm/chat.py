r"""Chat formatting at the level of tokens.

Every segment (role, text) is encoded on its own and the marks of a turn are
spliced in as reserved ids beyond the tokenizer's vocabulary, so no text can
produce a mark and no merge crosses one:

    START role SEP text END

The loss mask of a turn is the running sum of +1 where a trained text begins
and -1 where it ends. Strings that a chat template or tokenizer may take for
control (``CONTROL``) are broken inside texts by a backslash behind their first
character; backslashes are doubled. ``unescape`` undoes it exactly.

The output has one row for each turn, in the order of its conversation, with
its place there (``turn_no``, ``token_start``, ``char_start``): a conversation
of any length streams through and none is held in memory. ``conversations()``
gathers whole ones where they are known to be bounded.

Defined results: null texts and roles are empty ones; rows order by turn
(nulls first), then role, then a hash of the text; repeated rows are turns of their own;
rows without a conv_id make up one conversation; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import lean, shuffle_width, small_batches

START, SEP, END = "<|turn|>", "<|says|>", "<|over|>"
#: Strings of these and other common chat templates.
CONTROL = [START, SEP, END, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_BEGINS = re.compile(r"(?=(?:%s))(.)" % "|".join(map(re.escape, CONTROL)), re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
SLICE = 1024


def escape(text: str) -> str:
    return _BEGINS.sub(r"\1\\", text.replace("\\", "\\\\")) if "\\" in text or "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def reserved(tokenizer: str) -> dict[int, str]:
    base = tokens.size(tokenizer)
    return {base: START, base + 1: SEP, base + 2: END}


def format_turns(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokenizer: str | None = None, trained_roles: tuple[str, ...] = ("assistant",), train_on_end: bool = True) -> DataFrame:
    """One row for each turn: conv_id, turn_no, token_start, char_start, ids, loss_mask, chars."""
    path = tokenizer or tokens.default_path()
    conv_type = rows.schema[conv_col].dataType
    source = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    source = source.withColumn("tie", F.xxhash64("text"))  # so texts needn't be shuffled beside their ids
    encoded_schema = T.StructType([T.StructField("conv_id", conv_type), source.schema["turn"], T.StructField("role", T.StringType()), T.StructField("tie", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType()), T.StructField("chars", T.LongType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.load(path).encode_to_numpy
        base = tokens.size(path)
        roles: dict[str, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                ids, begins, stops, chars = [], [], [], []
                for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                    name, body = escape(role), escape(text)
                    head = roles.get(name)
                    if head is None:
                        head = np.concatenate([[base], encoder(name).astype(np.int32), [base + 1]]).astype(np.int32)
                        if len(roles) < 64:
                            roles[name] = head
                    own = encoder(body).astype(np.int32)
                    turn = np.concatenate([head, own, np.array([base + 2], np.int32)])
                    ids.append(turn)
                    begins.append(len(head) if role in trained_roles else 0)
                    stops.append(len(head) + len(own) + train_on_end if role in trained_roles else 0)
                    chars.append(len(name) + len(body) + len(START) + len(SEP) + len(END))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("conv_id", "turn", "role", "tie")), pa.array(ids, pa.list_(pa.int32())), pa.array(begins, pa.int32()), pa.array(stops, pa.int32()), pa.array(chars, pa.int64())], names=encoded_schema.names)

    order = ["conv_id", F.asc_nulls_first("turn"), "role", "tie"]
    dealt = source.mapInArrow(lean(encode, tokens.load), encoded_schema).repartition(shuffle_width(rows.sparkSession), "conv_id").sortWithinPartitions(*order).drop("turn", "role", "tie")
    schema = T.StructType([T.StructField("conv_id", conv_type), T.StructField("turn_no", T.LongType()), T.StructField("token_start", T.LongType()), T.StructField("char_start", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("loss_mask", T.ArrayType(T.ByteType())), T.StructField("chars", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, turn, token, char = (), 0, 0, 0
        for batch in batches:
            sizes = batch.column("ids").value_lengths().to_pylist()
            out: list[tuple[int, int, int]] = []
            for conv, size, chars in zip(batch.column("conv_id").to_pylist(), sizes, batch.column("chars").to_pylist()):
                if at != (conv,):
                    at, turn, token, char = (conv,), 0, 0, 0
                out.append((turn, token, char))
                turn, token, char = turn + 1, token + size, char + chars
            ends = np.cumsum(sizes)
            step = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int32)
            starts = ends - np.array(sizes)
            np.add.at(step, starts + batch.column("from").to_numpy(), 1)
            np.add.at(step, starts + batch.column("to").to_numpy(), -1)
            mask = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.cumsum(step)[:-1].astype(np.int8)))
            places = [pa.array([o[k] for o in out], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *places, batch.column("ids"), mask, batch.column("chars")], names=schema.names)

    return dealt.mapInArrow(lean(number), schema)


def conversations(turns: DataFrame) -> DataFrame:
    """Whole conversations as rows of conv_id, ids, loss_mask: for conversations that fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("turn_no", "ids", "loss_mask")))
    return turns.groupBy("conv_id").agg(parts.alias("parts")).select("conv_id", F.flatten("parts.ids").alias("ids"), F.flatten("parts.loss_mask").alias("loss_mask"))


def read_back(turns: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """Digests of what the formatted ids say, by conversation: decoded, split at the marks, unescaped.

    Streams over the rows as format_turns() leaves them (a conversation is in
    one partition, in order).
    """
    path = tokenizer or tokens.default_path()
    schema = T.StructType([turns.schema["conv_id"], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = tokens.load(path).decode_bytes
        names = reserved(path)
        base = tokens.size(path)
        done: list[tuple] = []
        key, state = None, None

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=schema.names)

        def close() -> None:
            if state is not None:
                done.append((key[0], state["turns"], state["all"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]))

        types = None
        for batch in batches:
            types = types or [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            ids, masks = batch.column("ids"), batch.column("loss_mask")
            for row, conv in enumerate(batch.column("conv_id").to_pylist()):
                if key != (conv,):
                    close()
                    key, state = (conv,), {"turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                own = ids[row].values.to_numpy()
                mask = masks[row].values.to_numpy().astype(bool)
                marks = np.flatnonzero(own >= base)
                assert [int(own[m]) - base for m in marks] == [0, 1, 2], "a turn has its three marks once, in order"
                said = [decode(own[a + 1 : b].tolist()).decode() for a, b in zip(marks[:-1], marks[1:])]
                trained = unescape(decode(own[mask & (own < base)].tolist()).decode())
                role, text = map(unescape, said)
                state["turns"] += 1
                state["all"].update(f"{role}\n{text}\n".encode())
                state["loss"].update(trained.encode())
                state["loss_chars"] += len(trained)
                state["chars"] += sum(map(len, said)) + sum(len(names[int(own[m])]) for m in marks)
            if len(done) >= 1000:
                yield flush(done)
                done = []
        close()
        if done:
            yield flush(done)

    return turns.select("conv_id", "ids", "loss_mask").mapInArrow(lean(digest, tokens.load), schema)
