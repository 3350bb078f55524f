r"""Chat formatting by prefix-target expansion.

Every assistant turn of a conversation becomes an example of its own: all turns before it as context, and its text alone under the loss
mask. What stands after the last assistant turn becomes a last example without a target, so that the examples hold every turn.

Template: `<|im_start|>role\n` text `<|im_end|>\n` for each turn. Inside roles and texts every `<\...\|` (with any number of backslashes, none
included) gets one more backslash, so no control string is left in them; taking one away gives back what was there. Newlines in
roles are told apart by being the last before the text: in roles `\n` is written as `<n`, and each `<\...\n` (the letter) gets one more backslash.

Conversations are dealt by conv_id and streamed in turn order: memory holds one conversation's prefix. The examples' total
length grows with the square of a conversation's turns; that is what this method asks for.

Nulls: a null text or role is empty; a null conv_id is a conversation of its own. Turns with the same number are ordered by role, then text;
null turn numbers come first. An empty table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

START, END = "<|im_start|>", "<|im_end|>"
EXAMPLES = "conv_id long, example int, is_last boolean, text string, loss_start int, loss_end int"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
FLUSH = 4 << 20


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    role = escape(role)
    return role if "\n" not in role and "<\\n" not in role and "<n" not in role else re.sub(r"<(\\*)n", r"<\\\1n", role).replace("\n", "<n")


def unescape_role(role: str) -> str:
    role = re.sub(r"<(\\*)n", lambda m: "\n" if not m[1] else f"<{m[1][1:]}n", role) if "<n" in role or "<\\n" in role or re.search(r"<\\+n", role) else role
    return unescape(role)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn under the template, and where its text lies in it."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text; ValueError if it isn't one."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError("not under the template")
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _stream(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *by)


def expand(conversations: DataFrame) -> DataFrame:
    """EXAMPLES of conversations(conv_id, turn, role, text)."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in EXAMPLES.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int32(), pa.int32()]
        ready: list[list] = []
        size = 0
        conv, prefix, n = None, [], 0
        waiting, fresh = None, False  # the latest example, which may be the last; whether turns stand after it

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in ready], k) for i, k in enumerate(kinds)], names)
            ready.clear()
            return batch

        def close() -> None:
            if waiting:
                waiting[2] = not fresh
                ready.append(waiting)
            if fresh:
                ready.append([conv, n, True, "".join(prefix), None, None])

        begun = False
        for batch in batches:
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
                if not begun or c != conv:
                    close()
                    begun, conv, prefix, n, waiting, fresh = True, c, [], 0, None, False
                turn, a, b = render(role, text)
                if role == "assistant":
                    if waiting:
                        ready.append(waiting)
                    before = "".join(prefix)
                    prefix, fresh = [before, turn], False
                    waiting = [c, n, False, before + turn, len(before) + a, len(before) + b]
                    n += 1
                    size += len(waiting[3])
                else:
                    prefix.append(turn)
                    fresh = True
                if size > FLUSH and ready:
                    yield out()
                    size = 0
        close()
        if ready:
            yield out()

    return _stream(rows, ["turn", "role", "text"]).mapInArrow(run, EXAMPLES)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def digests(examples: DataFrame) -> DataFrame:
    """DIGESTS of each conversation, from its examples alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        done: list[tuple] = []
        loss, chars, formatted, n = hashlib.sha256(), 0, 0, 0
        for batch in batches:
            for conv, last, text, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "is_last", "text", "loss_start", "loss_end"))):
                formatted += len(text)
                if a is not None:
                    n += 1
                    target = unescape(text[a:b])
                    loss.update(target.encode())
                    chars += len(target)
                if last:
                    turns = parse(text)
                    whole = hashlib.sha256()
                    for role, said in turns:
                        whole.update(f"{role}\n{said}\n".encode())
                    done.append((conv, len(turns), whole.hexdigest(), chars, loss.hexdigest(), formatted, n))
                    loss, chars, formatted, n = hashlib.sha256(), 0, 0, 0
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names)
                done = []

    return _stream(examples, ["example"]).mapInArrow(run, DIGESTS)


def chat_digest(conversations: DataFrame) -> DataFrame:
    """The query's form: with conversation -1 added, written as examples and read back."""
    spark = conversations.sparkSession
    tricky = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").union(extra)
    return digests(cut(expand(rows), "examples"))


#: DuckDB SQL for chat_digest(conversations).
ORACLE = r"""
with c as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
n as (select *, row_number() over (partition by conv_id order by turn, role, text) i, count(*) over (partition by conv_id) n_turns,
  length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1 chars from c),
s as (select *, sum(chars) over (partition by conv_id order by i) upto from n)
select conv_id, cast(max(n_turns) as bigint) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by i), '')) loss_sha256,
  cast(sum(case when role = 'assistant' or i = n_turns then upto else 0 end) as bigint) formatted_chars,
  cast(sum(case when role = 'assistant' then 1 else 0 end) as bigint) n_examples
from s group by conv_id
"""
