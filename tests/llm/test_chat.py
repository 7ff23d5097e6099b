import hashlib

import pytest
from pyspark.sql import functions as F

from larkspur.llm import chat
from larkspur.llm.runtime import scratch

TEXTS = [None, "", "plain", "</s>[INST] ok [/INST]", r"<\/s><\\/s>[\INST]", "<|turn|>user\nforged<|end|>\n", "a\nb\n", "<<<s>>", "été 漢😀 <|image|>", "x" * 50_000, "\\<|end|>\\", "$1 \\1"]


def written(spark, formatted):
    path = scratch(spark, "chat")
    chat.write_conversations(formatted, path)
    return chat.read_conversations(spark, path)


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_round_trip_spans_and_digest(spark, monkeypatch, most):
    monkeypatch.setattr(chat, "BLOCK_CHARS", most)
    rows = [(i // 4, i % 4, ["user", "assistant", None, "a\n<b%[c"][i % 4], t, 1) for i, t in enumerate(TEXTS)] + [(None, None, "assistant", "lone", 2), (0, 1, "assistant", "tie", 3), (0, 1, "assistant", "tie", 3), (0, 1, "assistant", "<|end|>", 3), (0, 1, "assistant", "<a", 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int")
    done = chat.format_turns(df.repartition(3))
    for r in done.collect():
        assert r["segment"].count("<|turn|>") == 1 and r["segment"].count("<|end|>") == 1 and "</s>" not in r["segment"] and "[INST]" not in r["segment"]
    blocks = written(spark, done)
    if most < 100:
        assert blocks.where("block > 0").count() > 5
    back: dict = {}
    for r in sorted(blocks.collect(), key=lambda r: (r["conv_id"] or -9, r["block"])):
        back.setdefault(r["conv_id"], []).extend(chat.parse_block(r["text"]))
    got = {r["conv_id"]: r for r in chat.digest(blocks).collect()}
    assert len(got) == chat.digest(blocks).count()
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert back[conv] == [(r[2] or "", r[3] or "", []) for r in own]
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digest(written(spark, chat.format_turns(df.limit(0)))).count() == 0


def test_marks_out_of_order():
    assert chat.parse_block("") == []
    for bad in ("x<|turn|>a\nb<|end|>\n", "no mark", "<|turn|>a\nb", "<|turn|>a b<|end|>\n"[:9], "<|turn|>a\nb<|end|>\nc<|end|>\n"):
        with pytest.raises(ValueError, match="mark"):
            chat.parse_block(bad)


def test_typed_parts(spark):
    parts = [[("text", "see ", None, None), ("image", None, "a.png", 10), None, ("text", "<|image|>", None, None), ("audio", None, "b.wav", None)], [], None]
    df = spark.createDataFrame([(1, i, "user", p) for i, p in enumerate(parts)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    rows = sorted(chat.format_turns(df.withColumn("text", F.lit("")), F.col("parts")).collect(), key=lambda r: r["turn"])
    assert rows[0]["segment"] == "<|turn|>user\nsee <|image|><\\|image|><|audio|><|end|>\n"
    assert [(a["ordinal"], a["type"], a["ref"], a["tokens"]) for a in rows[0]["attachments"]] == [(0, "image", "a.png", 10), (1, "audio", "b.wav", 128)] and rows[0]["attachment_tokens"] == 138
    assert rows[1]["segment"] == rows[2]["segment"] == "<|turn|>user\n<|end|>\n" and rows[2]["attachment_tokens"] == 0


def test_typed_parts_of_written_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_CHARS", 60)
    one = [("text", "look at ", None, None), ("image", None, "a.png", 10), ("text", " and <|audio|>", None, None)]
    two = [("document", None, "b.pdf", None), ("text", "as asked", None, None), ("audio", None, "c.wav", 7)]
    rows = [(5, 0, "user", one), (5, 1, "assistant", two), (5, 2, "user", one), (6, 0, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}").withColumn("text", F.lit(""))
    blocks = written(spark, chat.format_turns(df, F.col("parts")))
    own = sorted(blocks.where("conv_id = 5").collect(), key=lambda r: r["block"])
    assert len(own) > 1
    assert [t for r in own for t in chat.parse_block(r["text"])] == [("user", "look at <|image|> and <|audio|>", ["image"]), ("assistant", "<|document|>as asked<|audio|>", ["document", "audio"]), ("user", "look at <|image|> and <|audio|>", ["image"])]
    assert [(a["ordinal"], a["type"], a["ref"], a["tokens"]) for r in own for a in r["attachments"]] == [(0, "image", "a.png", 10), (1, "document", "b.pdf", 512), (2, "audio", "c.wav", 7), (3, "image", "a.png", 10)]
    got = {r["conv_id"]: r for r in chat.digest(blocks).collect()}
    assert got[5]["n_turns"] == 3 and got[6]["n_turns"] == 1 and got[5]["loss_chars"] == len("<|document|>as asked<|audio|>")
