import hashlib

from hypothesis import given
from hypothesis import strategies as st

from shiftloom.llm import chat_events as chat

pieces = st.lists(st.sampled_from(["<", "[", "\\", "<|im_end|>", "<|im_start|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "/s>", "INST]", "a", "\n", "|im_end|>", "é"]), max_size=12).map("".join)


@given(pieces)
def test_escape_is_undone_and_leaves_no_control_string(text):
    safe = chat.escaped(text)
    assert chat.unescaped(safe) == text
    assert not any(c in safe for c in ("<|im_end|>", "<|im_start|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>"))
    assert chat.unescaped_role(chat.escaped_role(text)) == text and "\n" not in chat.escaped_role(text)


@given(st.lists(st.tuples(pieces, pieces), max_size=5))
def test_a_rendered_conversation_reads_back(turns):
    rendered = "".join(f"{chat.START}{chat.escaped_role(r)}\n{chat.escaped(t)}{chat.END}\n" for r, t in turns)
    assert chat.read_back(rendered) == turns


def test_events_fold_to_final_messages(spark):
    log = [
        (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", None), (1, 2, 3, "delta", None, "wro"), (1, 2, 4, "delta", None, "ng"), (1, 2, 5, "regenerate", None, "ignored"),
        (1, 2, 6, "delta", None, "rig"), (1, 2, 9, "delta", None, "ht"), (1, 1, 7, "edit", None, "hello"), (1, 3, 8, "message", "user", "gone"), (1, 3, 10, "delete", None, None), (None, 1, 1, "message", None, None),
    ]
    df = spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string").repartition(3)
    out = {r.conv_id: r for r in chat.format_events(df).collect()}
    assert chat.read_back(out[1].formatted) == [("user", "hello"), ("assistant", "right")] and chat.read_back(out[None].formatted) == [("", "")]
    assert [out[1].formatted[x.start : x.end] for x in out[1].loss] == ["right"]
    assert chat.format_events(df.where("false")).count() == 0


def test_query_over_ties_nulls_and_a_long_conversation(spark, tmp_path):
    rows = [(7, t, ("user", "assistant")[t % 2], f"turn {t} </s>") for t in range(3000)] + [(8, 0, "user", None), (8, 0, "assistant", "b"), (8, 0, "assistant", "b"), (8, 0, "assistant", "a"), (9, 5, None, "x\ny"), (None, 0, "assistant", "z")]
    spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, message int").repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op8_chat_events(spark, str(tmp_path)).collect()}
    said = "</s>[INST] ok [/INST]"
    want = {7: [r[2:] for r in rows[:3000]], 8: [("assistant", "a"), ("assistant", "b"), ("assistant", "b"), ("user", "")], 9: [("", "x\ny")], None: [("assistant", "z")], -1: [("user", said), ("assistant", said)]}
    assert set(got) == set(want)
    for conv, turns in want.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
