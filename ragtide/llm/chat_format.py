"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own, with all turns before
it as context and only that reply trainable.

A turn is written as `### Role: text </turn>` and a newline. Inside texts and roles a backslash is put before every
backslash and every control string, and a role's newlines and colons are written as escapes, so both read back exactly.

The formatted conversation is a string; an example is its prefix up to the end of a reply, with the range of the reply's
text as loss mask. examples() gives the offsets alone, in space proportional to the conversation; prefixes() writes the
examples out, and report() reads all it says back from written examples. Examples are made one by one as turns stream by,
BATCH_CHARS of them at a time and not on disk; a task holds the longest prefix. Their text, and so the time of writing and
reading them, grows with the square of a conversation's turns, as the method has it.

A null text or role counts as empty; rows with a null conv_id are one conversation; turns are ordered by turn (nulls
first), then role, then text, so ties and repeated rows have a fixed order; further columns are not touched.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROLE, STOP = "### ", "</turn>"
#: Characters of written examples that are given on at once; a longer example goes alone.
BATCH_CHARS = 1 << 22
_PIECE = re.compile(r"\A### ((?:[^:\\]|\\.)*): (.*) </turn>\n\Z", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)
_NAMED = {"n": "\n", "c": ":"}


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for word in (ROLE, STOP):
        out = F.replace(out, F.lit(word), F.lit("\\" + word))
    return out


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and piece: the formatted turn, with reply_at and reply_chars: where the text stands in it."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    role = F.replace(F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit(":"), F.lit("\\c"))
    body = escaped(F.col("text"))
    head = F.concat(F.lit(ROLE), role, F.lit(": "))
    return t.withColumn("piece", F.concat(head, body, F.lit(" " + STOP + "\n"))).withColumn("reply_at", F.char_length(head)).withColumn("reply_chars", F.char_length(body))


def read_piece(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    m = _PIECE.match(piece)
    if not m:
        raise ValueError("not a formatted turn")
    role = _ESCAPE.sub(lambda x: _NAMED.get(x[1], x[1]), m[1])
    return role, unescape(m[2])


def _ordered(turns: DataFrame) -> DataFrame:
    """Conversations dealt out whole, turns in order; a partition is read as a stream."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _expanded(turns: DataFrame) -> DataFrame:
    """Formatted turns in order, with example, context_chars, loss_start, loss_end and prefix_chars where the turn is an
    assistant's and null elsewhere."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    ours = F.col("role") == "assistant"
    none = F.lit(0).cast("long")
    f = _ordered(format_turns(turns)).select(
        "*",
        F.coalesce(F.sum(F.char_length("piece").cast("long")).over(w), none).alias("context_chars"),
        F.coalesce(F.sum(F.when(ours, 1).otherwise(0)).over(w), none).alias("example"),
    )
    start = F.col("context_chars") + F.col("reply_at")
    made = {"example": F.col("example"), "context_chars": F.col("context_chars"), "loss_start": start, "loss_end": start + F.col("reply_chars"), "prefix_chars": F.col("context_chars") + F.char_length("piece")}
    return f.select("conv_id", "role", "piece", *[F.when(ours, c).alias(name) for name, c in made.items()])


def examples(turns: DataFrame) -> DataFrame:
    """A row for each assistant turn: conv_id, example (from 0), context_chars, loss_start, loss_end (places in the
    formatted conversation) and prefix_chars. The trainable part is the formatted reply and nothing else."""
    return _expanded(turns).where("role = 'assistant'").drop("role", "piece")


_WRITTEN = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("text", pa.string())])


def _write(batches):
    """Expanded turns (conv_id, piece, context_chars, loss_start, loss_end) in order to written examples: conv_id, example,
    loss_start, loss_end and text, the conversation up to the end of the reply. Behind a conversation's examples comes a
    row of no example, with the turns behind the last reply as text."""
    conv, said, at, k, first = None, "", 0, 0, True
    out, size = [], 0

    def batch():
        nonlocal out, size
        made = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out) if out else ([],) * len(_WRITTEN), _WRITTEN)], schema=_WRITTEN)
        out, size = [], 0
        return made

    for rows in batches:
        for conv_id, piece, context, start, end in zip(*(c.to_pylist() for c in rows.columns)):
            if first or conv_id != conv:
                if not first:
                    out.append((conv, None, None, None, said[at:]))
                    size += len(said) - at
                conv, said, at, k, first = conv_id, "", 0, 0, False
            if start is not None and context != len(said):
                raise ValueError("an example's context is not what stands before it")
            said += piece
            if start is not None:
                out.append((conv, k, start, end, said))
                k, at, size = k + 1, len(said), size + len(said)
            if size >= BATCH_CHARS:
                yield batch()
    if not first:
        out.append((conv, None, None, None, said[at:]))
    yield batch()


def _in_order(turns: DataFrame) -> DataFrame:
    return _expanded(turns).select(F.col("conv_id").cast("long"), "piece", "context_chars", "loss_start", "loss_end")


def prefixes(turns: DataFrame) -> DataFrame:
    """The examples written out: conv_id, example, prompt (all turns before, and the reply's head), target (the reply
    and its end mark). The space grows with the square of a conversation's turns, as the examples themselves do."""
    made = _in_order(turns).mapInArrow(_write, "conv_id long, example long, loss_start long, loss_end long, text string")
    return made.where("example IS NOT NULL").selectExpr("conv_id", "example", "substring(text, 1, CAST(loss_start AS INT)) AS prompt", "substring(text, CAST(loss_start AS INT) + 1) AS target")


def _digest(batches):
    """Reads written examples in order; a row for each conversation. Each example has to go on from the one before; turns
    are what it adds, and the loss is what its mask covers."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    n, turns, chars, loss, k, before = 0, hashlib.sha256(), 0, hashlib.sha256(), 0, ""
    end_mark = f" {STOP}\n"
    for batch in batches:
        out = []
        for conv_id, example, start, end, text in zip(*(c.to_pylist() for c in batch.columns)):
            added = text
            if example is not None:
                if example != k or not text.startswith(before):
                    raise ValueError("an example does not go on from the one before")
                added = text[len(before) :]
                reply = unescape(text[start:end])
                chars += len(reply)
                loss.update(reply.encode())
                k, before = k + 1, text
            *pieces, rest = added.split(end_mark)  # no text or role holds an end mark that is not escaped
            if rest:
                raise ValueError("not formatted turns")
            for piece in pieces:
                role, said = read_piece(piece + end_mark)
                n += 1
                turns.update(f"{role}\n{said}\n".encode())
            if example is None:
                out.append((conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), len(before) + len(added), k))
                n, turns, chars, loss, k, before = 0, hashlib.sha256(), 0, hashlib.sha256(), 0, ""
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names)


def _read_back(batches):
    return _digest(_write(batches))


def report(turns: DataFrame) -> DataFrame:
    """A row for each conversation, read back from its written examples and, for the turns behind the last reply, the
    formatted rest: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples."""
    return _in_order(turns).mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")
