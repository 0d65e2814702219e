"""Chat logs: folding, escaping, rendering and reading back."""

import hashlib

import pytest

from plumbline.llm import chat

LOG = "conv_id long, target long, seq long, kind string, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def messages(spark, events):
    found = chat.fold(spark.createDataFrame(events, LOG)).orderBy("conv_id", "target").collect()
    return [(r.target, r.role, r.text) for r in found]


def test_deltas_edits_and_regenerations_fold(spark):
    events = [
        (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", None),
        (1, 2, 3, "delta", None, "one "), (1, 2, 4, "delta", None, "two"),
        (1, 3, 5, "message", "user", "gone later"),
        (1, 1, 6, "edit", None, "hello"),
        (1, 2, 7, "regenerate", None, None), (1, 2, 9, "delta", None, "b"),
        (1, 2, 8, "delta", None, "a"), (1, 4, 10, "message", "user", "new")]
    assert messages(spark, events) == [
        (1, "user", "hello"), (2, "assistant", "ab"), (4, "user", "new")]


def test_odd_logs(spark):
    assert messages(spark, [(1, 1, 5, "delta", None, "no message")]) == [(1, "", "no message")]
    assert messages(spark, [(1, 1, 1, "message", None, None)]) == [(1, "", "")]
    assert messages(spark, []) == []


@pytest.mark.parametrize("text", [
    "", "plain", "<s>", "</s>", "[INST] x [/INST]", r"<\s>", r"<\\/s>", "<<s>>", "[[INST]]",
    r"\<s>", "[/INST]</s>\n<s>user[INST]", "é<s>\n", "a\\", r"<\\\s>[\INST]"])
def test_render_reads_back(spark, text):
    rows = [(1, 0, "user", text), (1, 1, "assistant", text), (1, 1, "assistant", text),
            (1, None, "sys<s>tem\n", text), (None, 0, None, None), (2, 0, "assistant", text)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_chats(chat.message_log(table))
    back = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert [tuple(t) for t in back[1].turns] == [
        ("sys<s>tem\n", text), ("user", text), ("assistant", text), ("assistant", text)]
    assert back[1].loss_text == text * 2
    assert [tuple(t) for t in back[None].turns] == [("", "")]
    assert back[None].loss_spans == []
    digest = {r.conv_id: r for r in chat.chat_digests(formatted).collect()}[2]
    assert digest.turns_sha256 == sha(f"assistant\n{text}\n")
    assert (digest.n_turns, digest.loss_chars, digest.loss_sha256) == (1, len(text), sha(text))
    assert digest.formatted_chars == len(back[2].formatted)


def test_loss_mask_points_at_code_points(spark):
    rows = [(1, 0, "user", "😀é"), (1, 1, "assistant", "ö😀 ok"), (1, 2, "assistant", "")]
    row = chat.format_chats(chat.message_log(spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string"))).collect()[0]
    assert [row.formatted[s.start:s.start + s.length] for s in row.loss_spans] == ["ö😀 ok", ""]


def test_no_python_runs(spark):
    table = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.chat_digests(chat.format_chats(chat.message_log(table)))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
