r"""Chat formatting by columnar byte assembly.

Per Arrow batch, the segments of all turns are laid out at once: numpy computes segment lengths, cumulative offsets
and scatter indices, and headers and contents are copied into one preallocated Arrow buffer. A conversation is its
turns in order; no turn needs its neighbours, so a long conversation is never held as a whole.

Template, by role: user `[INST] text [/INST]`, assistant ` text </s>`, any other role `<<SYS>>role<</SYS>> text <</END>>`
(the role escaped too). Inside texts, a backslash becomes `\0` and each control string `\1` to `\7`, so none occurs in
a formatted text but where the template put it, and unescaping gives every text back (fixed codes, in order below).

Defined cases: null and empty texts are empty segments; a null role counts as the empty role (an "other" role); null
turns sort first, then turns in order, equal turns by role and text; repeated rows each give a segment; a null
conversation id is a conversation of its own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasloom.llm import common

#: What is escaped, by code (fixed values).
CONTROL = ("\\", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<</END>>", "<s>")
#: Before and after the text, by kind of role: user, assistant, other (after its escaped name).
BEFORE = (b"[INST] ", b" ", b"<</SYS>> ")
AFTER = (b" [/INST]", b" </s>", b" <</END>>")
#: One formatted turn; the groups are user text, other role, its text, assistant text.
SEGMENT = re.compile(r"\[INST\] (.*?) \[/INST\]|<<SYS>>(.*?)<</SYS>> (.*?) <</END>>| (.*?) </s>", re.S)
#: Bytes from which a segment is copied as a slice.
SLICE_BYTES = 4096
CODE = re.compile(r"\\([0-7])")
FIELDS = "formatted binary, loss_start bigint, loss_length bigint"


def escape(texts: pa.Array) -> pa.Array:
    for code, control in enumerate(CONTROL):
        texts = pc.replace_substring(texts, control, f"\\{code}")
    return texts


def unescape(text: str) -> str:
    return CODE.sub(lambda m: CONTROL[int(m[1])], text) if "\\" in text else text


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, offsets


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """out[at[k] : at[k] + length[k]] = data[start[k] : start[k] + length[k]], long segments slice by slice, all others at once by index.

    An index takes eight bytes for each byte that moves, so only segments of some kilobytes have one.
    """
    for k in np.flatnonzero(length > SLICE_BYTES).tolist():
        out[at[k] : at[k] + length[k]] = data[start[k] : start[k] + length[k]]
    short = length <= SLICE_BYTES
    at, start, length = at[short], start[short], length[short]
    total = int(length.sum())
    if total:
        run = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(at, length) + run] = data[np.repeat(start, length) + run]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted segments of a batch, with the place and length in bytes of the part under the loss mask (assistant texts, escaped)."""
    roles, texts = escape(pc.fill_null(roles.cast(pa.large_string()), "")), escape(pc.fill_null(texts.cast(pa.large_string()), ""))
    kind = np.where(pc.equal(roles, "user").to_numpy(zero_copy_only=False), 0, np.where(pc.equal(roles, "assistant").to_numpy(zero_copy_only=False), 1, 2)) if len(roles) else np.empty(0, int)
    names, name_at = _bytes(roles)
    body, body_at = _bytes(texts)
    n_name, n_body = np.where(kind == 2, np.diff(name_at), 0), np.diff(body_at)
    lead = np.where(kind == 2, len(b"<<SYS>>"), 0)
    before, after = (np.array([len(x) for x in part])[kind] for part in (BEFORE, AFTER))
    length = lead + n_name + before + n_body + after
    offsets = np.concatenate([[0], np.cumsum(length)])
    out = np.empty(int(offsets[-1]), np.uint8)
    at = offsets[:-1]

    def fixed(parts, where, chosen) -> None:
        data = np.frombuffer(b"".join(parts), np.uint8)
        starts = np.cumsum([0, *map(len, parts)])[:-1]
        _scatter(out, where, data, starts[chosen], np.array(list(map(len, parts)))[chosen])

    fixed((b"", b"", b"<<SYS>>"), at, kind)
    _scatter(out, at + lead, names, name_at[:-1], n_name)
    fixed(BEFORE, at + lead + n_name, kind)
    text_at = at + lead + n_name + before
    _scatter(out, text_at, body, body_at[:-1], n_body)
    fixed(AFTER, text_at + n_body, kind)
    segments = pa.Array.from_buffers(pa.large_binary(), len(kind), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])
    return segments, lead + n_name + before, np.where(kind == 1, n_body, 0)


def formatted(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: (conv_id, turn, role, text order keys kept, formatted, loss_start, loss_length).

    `formatted` is the turn's segment; a conversation's string is its segments in (turn, role, formatted) order.
    """
    common.ship(turns.sparkSession)

    def run(batches):
        for batch in batches:
            segments, start, length = assemble(batch.column(2), batch.column(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), segments.cast(pa.binary()), pa.array(np.where(length > 0, start, 0), pa.int64()), pa.array(length, pa.int64()), batch.column(2)], names=["conv", "turn", "formatted", "loss_start", "loss_length", "role"])

    rows = turns.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"conv {kinds['conv']}, turn {kinds['turn']}, {FIELDS}, role string").withColumnsRenamed({"conv": conversation, "turn": turn})


def parsed(segment: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted string; raises where the string is not of the template."""
    out, at = [], 0
    for m in SEGMENT.finditer(segment):
        if m.start() != at:
            break
        at = m.end()
        role, found = ("user", m[1]) if m[1] is not None else (unescape(m[2]), m[3]) if m[2] is not None else ("assistant", m[4])
        out.append((role, unescape(found)))
    if at != len(segment):
        raise ValueError(f"no turn at {at}")
    return out


def read_back(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Per conversation, from the formatted bytes: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    Segments are sorted by conversation and turn and streamed; the digests go on from batch to batch, so a
    conversation of any length needs no more memory than a batch.
    """
    common.ship(rows.sparkSession)

    def run(batches):
        last, state = None, None

        def new():
            return [0, hashlib.sha256(), 0, hashlib.sha256(), 0]

        def done(found):
            key, out = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(key, kind), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1].hexdigest() for o in out], pa.string()), pa.array([o[2] for o in out], pa.int64()), pa.array([o[3].hexdigest() for o in out], pa.string()), pa.array([o[4] for o in out], pa.int64())], names=[conversation, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        kind = None
        for batch in batches:
            kind, ended = batch.schema.field(0).type, []
            for conv, data, start, length in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                if state is None or conv != last:
                    if state is not None:
                        ended.append((last, state))
                    last, state = conv, new()
                text = data.decode()
                for r, t in parsed(text):
                    state[1].update(f"{r}\n{t}\n".encode())
                    state[0] += 1
                loss = unescape(data[start : start + length].decode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(text)
            yield done(ended)
        if state is not None:
            yield done([(last, state)])

    order = [F.col(conversation).asc_nulls_first(), F.col(turn).asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("formatted").asc()]
    kind = rows.schema[conversation].dataType.simpleString()
    rows = rows.repartition(common.partitions(rows.sparkSession), conversation).sortWithinPartitions(*order).select(conversation, "formatted", "loss_start", "loss_length")
    return rows.mapInArrow(run, f"`{conversation}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
