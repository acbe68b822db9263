"""Chat formatting by prefix-target expansion.

Each assistant turn of a conversation becomes an example of its own: all turns before it as context, then the reply, which alone is trainable. A last
example without a target carries the turns after the last reply, so that nothing of a conversation is lost.

Template: `### ROLE: TEXT</turn>` and a line feed for each turn. In texts, each of `\\`, `#` and `<` is preceded by `\\`, in roles `:` as well, so
no control string can come from a text, and taking the backslashes out again gives the text back.

Rows are dealt by conversation and sorted by turn. A task holds one conversation's prefix at a time, as long as its
longest example."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, MIDDLE, END = "### ", ": ", "</turn>\n"
ASSISTANT = "assistant"
#: The conversation that tests the escapes: (conv_id, turn, role, text).
EXTRA = [(-7, i, role, "\\### Assistant: </turn> ok") for i, role in enumerate(("user", ASSISTANT))]
EXAMPLES = "conv_id long, target long, n_turns long, text string, loss_start long, loss_end long"
#: Characters of examples in one batch of output.
BATCH = 4_000_000
_TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<]|\\.)*)</turn>\n", re.DOTALL)
_NAMES = ["conv_id", "target", "n_turns", "text", "loss_start", "loss_end"]


def escape(text: str, signs: str = r"\\#<") -> str:
    return re.sub(f"[{signs}]", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as formatted, and where its escaped text starts and ends in it."""
    head = HEAD + escape(role, r"\\#<:") + MIDDLE
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn; raises ValueError if the template doesn't hold throughout."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a formatted conversation at character {at}")
    return turns


def _rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns))


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    out: list[tuple] = []
    chars = 0

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out) if out else [[]] * 6, types)], _NAMES)
        out.clear()
        return batch

    now: object = flush  # stands for no conversation: it equals no conv_id
    prefix, n, open_turns = "", 0, False
    for conv, role, text in _rows(batches, ["conv_id", "role", "text"]):
        if conv != now:
            if open_turns:
                out.append((now, None, n, prefix, None, None))
                chars += len(prefix)
            now, prefix, n, open_turns = conv, "", 0, False
        turn, start, end = format_turn(role, text)
        at, n = len(prefix), n + 1
        prefix, open_turns = prefix + turn, True
        if role == ASSISTANT:
            out.append((now, n - 1, n, prefix, at + start, at + end))
            open_turns, chars = False, chars + len(prefix)
        if chars > BATCH:
            yield flush()
            chars = 0
    if open_turns:
        out.append((now, None, n, prefix, None, None))
    yield flush()


def expand_prefixes(turns: DataFrame) -> DataFrame:
    """Examples (conv_id, target, n_turns, text, loss_start, loss_end) of turns (conv_id, turn, role, text).

    target: place of the trained turn in the conversation from 0, null in the example of trailing turns. The loss mask is a range of
    code points of text. Null texts and roles are empty; only the role `assistant` is trained. Rows of a null conv_id form
    one conversation. Rows that share a turn stand in order of role and text, null turns last. Other columns are ignored; an empty
    table gives no example."""
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    dealt = own.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("turn"), "role", "text")
    return dealt.mapInArrow(_expand, EXAMPLES)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    out: list[tuple] = []
    now: object = out  # stands for no conversation
    longest, loss, loss_chars, chars = "", hashlib.sha256(), 0, 0

    def close() -> None:
        turns = parse(longest)
        whole = hashlib.sha256()
        for role, text in turns:
            whole.update(f"{role}\n{text}\n".encode())
        out.append((now, len(turns), whole.hexdigest(), loss_chars, loss.hexdigest(), chars))

    for conv, text, start, end in _rows(batches, ["conv_id", "text", "loss_start", "loss_end"]):
        if conv != now:
            if now is not out:
                close()
            now, loss, loss_chars, chars = conv, hashlib.sha256(), 0, 0
        longest, chars = text, chars + len(text)
        if start is not None:
            reply = unescape(text[start:end])
            loss.update(reply.encode())
            loss_chars += len(reply)
    if now is not out:
        close()
    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out) if out else [[]] * 6, kinds)], names)


def digest(examples: DataFrame) -> DataFrame:
    """What can be read back from the examples of each conversation: its turns from the longest, its replies from each. Examples may stand in any order and partition; they are
    dealt by conversation here. Rows of a null conv_id are one conversation; other columns are ignored; an empty table gives no rows."""
    dealt = examples.select(*_NAMES).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("target"))
    return dealt.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat_formatting(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    return digest(expand_prefixes(turns.unionByName(extra)))
