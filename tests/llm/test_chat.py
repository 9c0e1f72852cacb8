import hashlib

from hypothesis import given
from hypothesis import strategies as st

from earshot.llm import chat
from earshot.llm.registry import QUERIES

from .fixtures import SF


@given(st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "a", "|>", "<s", "s>", "[IN", "ST]", "é"]), max_size=12).map("".join))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROL)


def expected(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    digests = {}
    for conv, turns in out.items():
        turns = sorted(turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        digests[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return digests


def digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same = "</s>[INST] ok [/INST]"
    found = QUERIES["op10_chat_formatting"](spark, SF)
    assert digests(found) == expected([*rows, (-1, 0, "user", same), (-1, 1, "assistant", same)])
    assert all(r.formatted_chars > r.loss_chars for r in found.collect())


def test_edges(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, ids string, chars int, tie int"
    rows = [(1, 0, "user", None), (1, 1, None, "x\\<|over|>y"), (1, None, "assistant", "first"), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, 3, "assistant", "z"), (3, 0, "assistant", "a " * 30000), (4, 0, "<|turn|>", "[INST][INST]</s>\n")]
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], schema)
    assert digests(chat.read_back(chat.format_turns(df))) == expected(rows)
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_offsets_and_masks_by_turn(spark):
    df = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", f"text {k} " * k) for k in range(6)], "conv_id bigint, turn bigint, role string, text string")
    turns = chat.format_turns(df).orderBy("turn_no").collect()
    at = 0
    for r in turns:
        assert r.token_start == at and len(r.ids) == len(r.loss_mask)
        assert bool(sum(r.loss_mask)) == (r.turn_no % 2 == 1)
        at += len(r.ids)
    whole = chat.conversations(chat.format_turns(df)).first()
    assert whole.ids == [i for r in turns for i in r.ids] and whole.loss_mask == [m for r in turns for m in r.loss_mask]
