"""Chat formatting: conversations rendered by a compiled template, with loss spans.

The rows of a conversation are gathered in turn order and rendered by the
closures of ``chat_template``; each task compiles the template once.  The result
is one text per conversation and the spans of it that a model is to learn (the
assistant texts).  Control strings inside roles and texts are escaped reversibly,
so ``read_back`` recovers every turn and the text under the loss mask from the
formatted text alone.

A conversation is one output row, so its turns have to meet in one task; many
conversations of equal text stay spread, because they are grouped by id only.

Edge cases: null role or text is empty; null turns come first; rows of one turn
are ordered by role and text; rows with a null conversation id form one
conversation; repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabula.llm.chat_template import compile_template, unescape

START, END = "<|im_start|>", "<|im_end|>"
TEMPLATE = (
    "{% for m in messages %}{{ '" + START + "' }}{{ m.role | escape_line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}{{ '" + END + "' }}\n{% endfor %}"
)
_FORMATTED = "conv_id {0}, formatted string, loss_spans array<struct<start:int,end:int>>"
_READ = "conv_id {0}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _schema(text: str, df: DataFrame) -> str:
    return text.format(df.schema["conv_id"].dataType.simpleString())


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted, loss_spans (code points): one row per conversation."""
    part = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("messages"))

    def render_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for batch in batches:
            done = [render(messages=m) for m in batch.column("messages").to_pylist()]
            spans = pa.array([[{"start": a, "end": z} for a, z in s] for _, s in done],
                             pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array([t for t, _ in done], pa.string()), spans],
                                             ["conv_id", "formatted", "loss_spans"])

    return convs.mapInArrow(render_batches, _schema(_FORMATTED, rows))


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        out.append((unescape(formatted[at + len(START):line]), unescape(formatted[line + 1:end])))
        at = end + len(END) + 1
    return out


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[], [], [], [], []]
        for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
            turns = read_turns(text)
            whole = "".join(f"{role}\n{body}\n" for role, body in turns)
            loss = "".join(unescape(text[s["start"]:s["end"]]) for s in spans)
            row = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))
            for col, value in zip(cols, row):
                col.append(value)
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *[pa.array(c, t) for c, t in zip(cols, types)]],
                                         ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, read from the formatted texts."""
    return formatted.mapInArrow(_read_batches, _schema(_READ, formatted))


def report(rows: DataFrame) -> DataFrame:
    return read_back(format_conversations(rows.select("conv_id", "turn", "role", "text")))
