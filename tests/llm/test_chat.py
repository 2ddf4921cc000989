import hashlib

import pytest
from pyspark.sql import functions as F

from roadlens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, piece string, `a.b` long"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def digests(rows):
    """What op11 returns for (role, text) turns, without any rendering."""
    turns = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


HARD = [
    (1, 0, "system", "be kind"), (1, 1, "user", "probe"), (1, 2, "assistant", "assistant"), (1, 3, "user", "probe probe0"), (1, 4, "assistant", "probe"),
    (2, 0, "user", chat.HOSTILE), (2, 1, "assistant", chat.HOSTILE), (2, 2, "assistant", "<\\|<|<\\\\| tail <"), (2, 3, "assistant", "|im_end|>"),
    (3, 0, "user", None), (3, 1, "assistant", None), (3, 2, "assistant", ""), (3, 3, None, "no role"), (3, 4, "odd\nrole \\n <|im_end|>", "x\n\n"),
    (4, 5, "user", "tie b"), (4, 5, "user", "tie a"), (4, None, "user", "null first"), (4, 6, "assistant", "same"), (4, 6, "assistant", "same"),
    (None, 0, "user", "null key"), (None, 1, "assistant", "日本語 😀 ünï"), (5, 0, "assistant", "long " * 300_000), (6, 0, "user", "only"),
]


def by_conversation(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role, text))
    return out


def test_round_trip_of_hard_turns(spark):
    df = conversations(spark, HARD)
    for size in ("10000", "2"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = {r[0]: tuple(r)[1:] for r in chat.read_back(chat.format_chats(df), ordered=True).collect()}
        again = {r[0]: tuple(r)[1:] for r in chat.read_back(chat.format_chats(df)).collect()}
        assert got == again
        assert {c: r[:4] for c, r in got.items()} == {c: digests(t) for c, t in by_conversation(HARD).items()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pieces = chat.format_chats(df).where("conv_id = 2").orderBy("turn_no").collect()
    text = "".join(r["piece"] for r in pieces)
    assert len(text) == got[2][4] and text.count(chat.START) == text.count(chat.END) == 4
    assert [text[r["start"] :][r["loss_from"] : r["loss_to"]] for r in pieces[1:]] == [chat.escape(t) for c, _, _, t in HARD if c == 2][1:]
    assert not chat.read_back(chat.format_chats(df.limit(0))).collect()


def test_escapes_are_reversible():
    for text in ("", "<|", "<\\|", "<\\\\|", "<<||>", "<|im_end|>", "a<|b<\\|c", "\\", "\\n", "\n", "<\\", "|"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def thinking(messages):
    """Rewrites history: thoughts of all but the last turn go, and a conversation ends with a mark."""
    out = "<s>"
    for k, m in enumerate(messages):
        text = m["content"]
        if k + 1 < len(messages) and "</think>" in text:
            text = text.split("</think>", 1)[1]
        out += f"[{m['role']}]{text.strip()}"
    return out + "</s>"


def fold(pieces):
    text = ""
    for r in pieces:
        assert r["start"] == len(text) - r["replaced"]
        text = text[: r["start"]] + r["piece"]
    return text


def test_templates_that_rewrite_history(spark):
    turns = [("user", "ask"), ("assistant", "<think>hm</think> yes "), ("user", "and?"), ("assistant", "no"), ("user", "ok")]
    df = conversations(spark, [(1, k, *t) for k, t in enumerate(turns)])
    rows = chat.format_chats(df, thinking, context=None).orderBy("turn_no").collect()
    for n in range(1, len(turns) + 1):
        assert fold(rows[:n]) == thinking([{"role": r, "content": t} for r, t in turns[:n]])
    # the end mark alone is replaced at each turn, more where a thought goes
    assert [r["replaced"] for r in rows] == [0, 4, len("<think>hm</think> yes</s>"), 4, 4]
    assert [r["piece"][r["loss_from"] : r["loss_to"]] for r in rows if r["loss_from"] is not None] == ["<think>hm</think> yes", "no"]
    assert all(r["replaced"] == 0 for r in chat.format_chats(df).collect())


def test_windows_give_the_spans_of_whole_prefixes(spark):
    df = spark.range(500).select(
        F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), F.col("id") % 7).alias("text")
    )
    whole, windows = (sorted(map(tuple, chat.format_chats(df, context=c).collect())) for c in (None, 3))
    assert whole == windows and len(whole) == 500
    assert fold(chat.format_chats(df, context=3).orderBy("turn_no").collect()) == chat.chatml([{"role": r["role"], "content": r["text"]} for r in df.orderBy("turn").collect()])


def test_reader_refuses_damaged_pieces():
    with pytest.raises(ValueError):
        chat.Reader().add("<|im_start|>user\nno end", 0, None, None)
    with pytest.raises(ValueError):
        chat.Reader().add("<|im_start|>user\nx<|im_end|>\n", 5, None, None)
