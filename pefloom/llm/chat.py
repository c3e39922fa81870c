"""Chat formatting: conversations rendered by a compiled template (``template.py``) and read back.

Rows are dealt by conversation and sorted by turn (Spark spills the sort); each task then streams its conversations, turn by
turn, so that no conversation is held whole, however long. A conversation comes out as parts of about ``PART_CHARS``
characters, cut between turns, each with its text and the spans under the loss mask.

Null texts and roles are empty. A null conv_id is a conversation of its own; null turns come first. Rows that tie on the turn
go by role, then text; repeated rows are turns of their own. Empty texts give empty turns. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pefloom.llm.template import Template, collect, unescape

PART_CHARS = 1 << 20
CONTROLS = ("###", "</turn>")
TEMPLATE = (
    "{% for m in messages %}### {{ m.role | escape(':') }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
FORMATTED = "conv_id long, part long, formatted string, loss array<long>"


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """(conv_id, part, formatted, loss) with loss the spans start, end, start, end ... of part ``part`` under the loss mask.

    The parts of a conversation lie in one partition, in order.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        compiled = Template(template, controls)
        turns = (t for b in batches for t in zip(*(b.column(k).to_pylist() for k in (0, 2, 3)), strict=True))
        for conv, own in groupby(turns, key=lambda t: t[0]):
            part, pieces, size = 0, [], 0
            for piece in compiled.stream({"role": r, "text": x} for _, r, x in own):
                pieces.append(piece)
                size += len(piece[0])
                if piece[1] is None and size >= PART_CHARS:
                    yield conv, part, *collect(pieces)
                    part, pieces, size = part + 1, [], 0
            if pieces or not part:
                yield conv, part, *collect(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for conv, part, text, spans in parts(batches):
            held.append({"conv_id": conv, "part": part, "formatted": text, "loss": [x for s in spans for x in s]})
            size += len(text)
            if size >= 4 * PART_CHARS or len(held) >= 5000:
                yield pa.RecordBatch.from_pylist(held, FORMATTED_ARROW)
                held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, FORMATTED_ARROW)

    return rows.mapInArrow(run, FORMATTED)


FORMATTED_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.int64()))])
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a part that ``TEMPLATE`` made; an error where something else stands between them."""
    here = 0
    for m in TURN.finditer(formatted):
        if m.start() != here:
            break
        yield unescape(m[1]), unescape(m[2])
        here = m.end()
    if here != len(formatted):
        raise ValueError(f"not a turn at {here}")


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted parts say when read back: a row a conversation. Takes ``format_conversations``' rows as they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in (0, 2, 3)), strict=True))
        out = []
        for conv, parts in groupby(rows, key=lambda r: r[0]):
            turns, loss, n, n_loss, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, text, spans in parts:
                for role, said in read_turns(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for a, z in zip(spans[::2], spans[1::2], strict=True):
                    said = unescape(text[a:z])
                    loss.update(said.encode())
                    n_loss += len(said)
                chars += len(text)
            out.append((conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), chars))
            if len(out) >= 5000:
                yield _batch(out)
                out = []
        yield _batch(out)

    return formatted.mapInArrow(run, DIGEST)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in DIGEST.split(", ")]
    kinds = [pa.string() if "sha256" in n else pa.int64() for n in names]
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def op1_chat(conversations: DataFrame) -> DataFrame:
    """The digest of all conversations and of conversation -7, whose two turns hold control strings."""
    text = "\\### Assistant: </turn> ok"
    more = conversations.sparkSession.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return digest(format_conversations(conversations.select("conv_id", "turn", "role", "text").unionByName(more)))
