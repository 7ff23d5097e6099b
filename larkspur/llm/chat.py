r"""Chat formatting with typed content parts.

A message is a list of parts (text, image, audio, document). A visitor flattens it into one string in which every
attachment is an ordered placeholder; its reference and the number of tokens it expands to are recorded beside it.
Each turn becomes a segment ``<|turn|>role\ntext<|end|>\n``; a conversation is its segments in order, written as blocks of
whole turns (one block but for very long conversations) with the spans of the loss mask and the attachments beside the
text. A reader has only these: it finds the turns by their marks.

Control strings inside a text get a backslash after their first character, and one more if some are there already
(``</s>`` -> ``<\/s>`` -> ``<\\/s>``), so that formatting can be undone exactly. The loss mask covers the
assistant's (escaped) texts, as code-point spans of the block.

Cases: a null text or null part list is empty, a null role is an empty role. Rows of a conversation are ordered by
turn (nulls first), ties by role and text; repeated rows stay. Rows with a null conv_id form one conversation. Texts
of any length are formatted whole. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.runtime import map_batches

#: Strings that mean something to this template or to a common other one.
CONTROL = ["<|turn|>", "<|end|>", "<|image|>", "<|audio|>", "<|document|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]

PARTS = "array<struct<type:string,text:string,ref:string,tokens:int>>"

#: Tokens that an attachment expands to where its part does not say.
DEFAULT_TOKENS = {"image": 256, "audio": 128, "document": 512}


def _java_quote(s: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in s)


_HEAD = "([<\\[])"
_TAIL = "(" + "|".join(_java_quote(c[1:]) for c in CONTROL) + ")"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _HEAD + r"(\\*)" + _TAIL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _HEAD + r"(\\*)\\" + _TAIL, "$1$2$3")


class PartVisitor:
    """Column expressions for each kind of part; override a method to render that kind in another way."""

    def text(self, part: Column) -> Column:
        return escape(F.coalesce(part["text"], F.lit("")))

    def image(self, part: Column) -> Column:
        return F.lit("<|image|>")

    def audio(self, part: Column) -> Column:
        return F.lit("<|audio|>")

    def document(self, part: Column) -> Column:
        return F.lit("<|document|>")

    def render(self, part: Column) -> Column:
        out = self.text(part)
        for kind in DEFAULT_TOKENS:
            out = F.when(part["type"] == kind, getattr(self, kind)(part)).otherwise(out)
        return out

    def tokens(self, part: Column) -> Column:
        default = F.lit(0)
        for kind, n in DEFAULT_TOKENS.items():
            default = F.when(part["type"] == kind, F.lit(n)).otherwise(default)
        return F.coalesce(part["tokens"], default)

    def flatten(self, parts: Column) -> tuple[Column, Column, Column]:
        """Text with placeholders, attachments in order, and their expanded tokens."""
        parts = F.filter(F.coalesce(parts, F.from_json(F.lit("[]"), PARTS)), lambda p: p.isNotNull())
        files = F.filter(parts, lambda p: F.coalesce(p["type"], F.lit("text")).isin(*DEFAULT_TOKENS))
        attachments = F.transform(files, lambda p, i: F.struct(i.alias("ordinal"), p["type"].alias("type"), p["ref"].alias("ref"), self.tokens(p).alias("tokens")))
        return F.array_join(F.transform(parts, self.render), ""), attachments, F.aggregate(attachments, F.lit(0), lambda n, a: n + a["tokens"])


def text_parts(text: Column) -> Column:
    """A plain text as a part list."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))


_ROLE_CODES = [("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B")]


def _role_out(role: Column) -> Column:
    for a, b in _ROLE_CODES:
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def _role_in(role: Column) -> Column:
    for a, b in reversed(_ROLE_CODES):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def format_turns(turns: DataFrame, parts: Column | None = None, visitor: PartVisitor | None = None, trained_role: str = "assistant") -> DataFrame:
    """conv_id, turn, segment, loss_start, loss_end (code points in the segment; equal where nothing is trained on), attachments, attachment_tokens: one row per turn, without a shuffle."""
    body, attachments, tokens = (visitor or PartVisitor()).flatten(text_parts(F.col("text")) if parts is None else parts)
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit("<|turn|>"), _role_out(role), F.lit("\n"))
    base = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), head.alias("head"), body.alias("body"), attachments.alias("attachments"), tokens.alias("attachment_tokens"))
    start = F.length("head")
    end = start + F.when(F.col("role") == trained_role, F.length("body")).otherwise(0)
    return base.select("conv_id", "turn", F.concat("head", "body", F.lit("<|end|>\n")).alias("segment"), start.alias("loss_start"), end.alias("loss_end"), "attachments", "attachment_tokens")


#: Characters of a block, about; a longer turn makes a longer block.
BLOCK_CHARS = 1 << 20

BLOCKS = "conv_id long, block int, last boolean, text string, loss array<struct<start:int,end:int>>, attachments array<struct<ordinal:int,type:string,ref:string,tokens:int>>"


def _order() -> list[Column]:
    """How turns are ordered; ties by what the segment holds, undone."""
    inner = F.expr("substring(segment, 9, length(segment) - 16)")
    cut = F.instr(inner, "\n")
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), _role_in(F.substr(inner, F.lit(1), cut - 1)), unescape(F.substr(inner, cut + 1, F.length(inner)))]


def write_conversations(formatted: DataFrame, path: str) -> None:
    """Join turns (as format_turns gives them) to conversations, in BLOCKS, and write them.

    The turns of a conversation stream through one task in order; only the block at hand is held.
    """

    def run(batches):
        import pyarrow as pa

        now, n, size, at = None, 0, 0, 0
        text, loss, files, out = [], [], [], []

        def close(last):
            nonlocal text, loss, files, size
            out.append((now[0], n, last, "".join(text), loss, files))
            text, loss, files, size = [], [], [], 0

        def flush():
            cols = list(zip(*out))
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.struct([("ordinal", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["conv_id", "block", "last", "text", "loss", "attachments"])

        held = 0
        for b in batches:
            for conv, segment, start, end, own in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or now[0] != conv:
                    if now is not None:
                        close(True)
                    now, n, at = (conv,), 0, 0
                elif size + len(segment) > BLOCK_CHARS:
                    close(False)
                    n += 1
                if end > start:
                    loss.append({"start": size + start, "end": size + end})
                for a in own or ():
                    files.append(a | {"ordinal": at})
                    at += 1
                text.append(segment)
                size += len(segment)
                held += len(segment)
                if held > BLOCK_CHARS and out:
                    yield flush()
                    out.clear()
                    held = 0
        if now is not None:
            close(True)
        if out:
            yield flush()

    rows = formatted.select("conv_id", "turn", "segment", "loss_start", "loss_end", "attachments")
    rows = rows.repartition(F.col("conv_id")).sortWithinPartitions(*_order()).select("conv_id", "segment", "loss_start", "loss_end", "attachments")
    map_batches(rows, run, BLOCKS).write.parquet(path)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(path)


_ESCAPED = re.compile(r"([<\[])(\\*)\\(" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")")
_PLACEHOLDER = re.compile("|".join(re.escape(f"<|{kind}|>") for kind in DEFAULT_TOKENS))


def undo(text: str) -> str:
    """An escaped text as it was."""
    return _ESCAPED.sub(r"\1\2\3", text) if "\\" in text else text


def parse_block(text: str) -> list[tuple[str, str, list[str]]]:
    """(role, text, kinds of its attachments in order) of each turn of a block, found by the marks alone.

    A text keeps the placeholders where attachments stand. Raises ValueError where the marks are not in order.
    """
    if not text:
        return []
    out = []
    first, *turns = text.split("<|turn|>")
    for t in turns:
        role, cut, body = t.partition("\n")
        if first or not cut or not body.endswith("<|end|>\n") or body.count("<|end|>") > 1:
            raise ValueError("the marks of a conversation are not in order")
        for a, b in reversed(_ROLE_CODES):
            role = role.replace(b, a)
        body = body[:-8]
        out.append((role, undo(body), [m[0][2:-2] for m in _PLACEHOLDER.finditer(body)]))
    if not turns:
        raise ValueError("a conversation has no turn mark")
    return out


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(blocks: DataFrame) -> DataFrame:
    """What a reader of the written conversations gets, one row per conversation.

    A conversation of one block is read where it lies; only blocks of longer ones move, to be read in order. Running
    digests are all that is held of a conversation.
    """

    def run(batches):
        import hashlib

        import pyarrow as pa

        from larkspur.llm.chat import parse_block, undo

        now, state, out = None, None, []

        def close():
            n, turns, chars, loss, total, _ = state
            out.append((now[0], n, turns.hexdigest(), chars, loss.hexdigest(), total))

        def flush():
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            for conv, block, text, loss, files in zip(*(c.to_pylist() for c in b.columns)):
                if block == 0:
                    if now is not None:
                        close()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, own, kinds in parse_block(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{own}\n".encode())
                    if kinds != [a["type"] for a in files[: len(kinds)]]:
                        raise ValueError(f"attachments of conversation {conv} do not fit its placeholders")
                    files = files[len(kinds) :]
                for x in loss:
                    own = undo(text[x["start"] : x["end"]])
                    state[2] += len(own)
                    state[3].update(own.encode())
                state[4] += len(text)
            if len(out) >= 10_000:
                yield flush()
                out.clear()
        if now is not None:
            close()
        if out:
            yield flush()

    cols = ["conv_id", "block", "text", "loss", "attachments"]
    whole = F.col("last") & (F.col("block") == 0)
    long = blocks.where(~whole).repartition(F.col("conv_id")).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "block").select(cols)
    return map_batches(blocks.where(whole).select(cols), run, DIGEST).union(map_batches(long, run, DIGEST))
