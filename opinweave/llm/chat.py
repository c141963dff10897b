"""Chat formatting by columnar byte assembly.

A turn is written as ``<|im_start|>`` role, line feed, text, ``<|im_end|>``, line feed. Inside
texts and roles a backslash is doubled and ``<|`` becomes ``<\\|`` (in roles a line feed becomes
backslash-n), so no text can hold a control string and `read_chat` gets every turn back.

A batch of turns is assembled in numpy: segment lengths, their cumulative offsets, and the
positions to which the bytes of markers, roles and texts are scattered in one preallocated
buffer, which becomes the data buffer of the Arrow output. Conversations are runs of turns, so
their offsets are some of the turns' offsets. A conversation's string has to be in one place in
the end; until then its turns are rows, and a task holds one batch and the conversation at hand.

Cases: a null text or role is empty; turns are ordered by turn (null first), then role and text;
repeated rows are repeated turns; rows with a null id form one conversation; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, text_bytes

START, END, BREAK = b"<|im_start|>", b"<|im_end|>", b"\n"
SCHEMA = (
    "conv_id BIGINT, formatted STRING, n_turns BIGINT,"
    " loss_starts ARRAY<BIGINT>, loss_ends ARRAY<BIGINT>"
)
_UNESCAPE = re.compile(r"\\(.)", re.S)


def _escaped(raw: np.ndarray, offsets: np.ndarray, breaks: bool) -> tuple[np.ndarray, np.ndarray]:
    """The escaped bytes of all rows one after another, and their offsets."""
    starts = np.zeros(len(raw) + 1, bool)
    starts[offsets[:-1]] = True
    bar = np.zeros(len(raw), bool)
    if len(raw) > 1:
        bar[1:] = (raw[1:] == ord("|")) & (raw[:-1] == ord("<")) & ~starts[1:-1]
    site = bar | (raw == ord("\\"))
    if breaks:
        feed = raw == ord("\n")
        site |= feed
        raw = np.where(feed, np.uint8(ord("n")), raw)
    shift = np.cumsum(site)
    out = np.empty(len(raw) + (int(shift[-1]) if len(raw) else 0), np.uint8)
    at = np.arange(len(raw)) + shift
    out[at] = raw
    out[at[site] - 1] = ord("\\")
    return out, offsets + np.concatenate([[0], shift])[offsets]


def _place(out: np.ndarray, data: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> None:
    """Scatters row i of ``data`` to position ``at[i]`` of ``out``."""
    lengths = np.diff(offsets)
    out[np.arange(len(data)) + np.repeat(at - offsets[:-1], lengths)] = data


def assemble(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all turns, the turns' offsets, and where their texts start and end."""
    role, role_at = _escaped(*text_bytes(batch.column("role")), breaks=True)
    text, text_at = _escaped(*text_bytes(batch.column("text")), breaks=False)
    n = batch.num_rows
    parts = [
        np.full(n, len(START)), np.diff(role_at), np.full(n, 1), np.diff(text_at), np.full(n, len(END) + 1)
    ]
    inside = np.cumsum([np.zeros(n, np.int64), *parts], axis=0)
    offsets = np.concatenate([[0], np.cumsum(inside[-1])])
    at = offsets[:-1] + inside
    out = np.empty(int(offsets[-1]), np.uint8)
    for marker, where in ((START, at[0]), (BREAK, at[2]), (END + BREAK, at[4])):
        data = np.frombuffer(marker, np.uint8)
        out[(where[:, None] + np.arange(len(data))).ravel()] = np.tile(data, n)
    _place(out, role, role_at, at[1])
    _place(out, text, text_at, at[3])
    return out, offsets, at[3], at[4]


def _format(batches: Iterator[pa.RecordBatch], loss_role: str) -> Iterator[pa.RecordBatch]:
    held: list[bytes] = []  # bytes of a conversation that later batches go on with
    held_spans: list[tuple[np.ndarray, np.ndarray]] = []
    held_turns, held_id = 0, None

    def result(ids, data, offsets, turns, starts, ends, marks) -> pa.RecordBatch:
        text = pa.Array.from_buffers(
            pa.large_string(), len(ids), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
        )
        marks = pa.array(marks, pa.int32())
        columns = [
            pa.array(ids, pa.int64()), text.cast(pa.string()), pa.array(turns, pa.int64()),
            pa.ListArray.from_arrays(marks, pa.array(starts)), pa.ListArray.from_arrays(marks, pa.array(ends)),
        ]
        names = ["conv_id", "formatted", "n_turns", "loss_starts", "loss_ends"]
        return pa.RecordBatch.from_arrays(columns, names)

    def release() -> pa.RecordBatch:
        data = np.frombuffer(b"".join(held), np.uint8)
        starts, ends = (np.concatenate(x) for x in zip(*held_spans, strict=True))
        one = np.array([0, len(data)])
        return result([held_id], data, one, [held_turns], starts, ends, [0, len(starts)])

    for batch in small_batches(batches, "text"):
        out, offsets, starts, ends = assemble(batch)
        ids = batch.column("conv_id")
        number = ids.fill_null(0).to_numpy(zero_copy_only=False)
        absent = ids.is_null().to_numpy(zero_copy_only=False)
        loss = np.array([r == loss_role for r in batch.column("role").to_pylist()])
        change = np.flatnonzero((number[1:] != number[:-1]) | (absent[1:] != absent[:-1])) + 1
        edges = np.concatenate([[0], change, [batch.num_rows]])
        first_id = ids[0].as_py()
        if held and first_id != held_id:
            yield release()
            held, held_spans, held_turns = [], [], 0
        base = 0
        if held:  # the batch goes on with the conversation at hand
            base = 1
            shift = sum(map(len, held))
            k = loss[: edges[1]]
            held.append(out[: offsets[edges[1]]].tobytes())
            held_spans.append((starts[: edges[1]][k] + shift, ends[: edges[1]][k] + shift))
            held_turns += int(edges[1])
            if len(edges) == 2:
                continue
            yield release()
            held, held_spans, held_turns = [], [], 0
        last = len(edges) - 2  # the last conversation may go on
        if last > base:
            lo, hi = edges[base], edges[last]
            row = np.repeat(offsets[edges[base:last]], np.diff(edges[base : last + 1]))
            k = loss[lo:hi]
            marks = np.concatenate([[0], np.cumsum(k)])[edges[base : last + 1] - lo]
            data = out[offsets[lo] : offsets[hi]]
            yield result(
                [ids[int(i)].as_py() for i in edges[base:last]], data,
                offsets[edges[base : last + 1]] - offsets[lo], np.diff(edges[base : last + 1]),
                (starts[lo:hi] - row)[k], (ends[lo:hi] - row)[k], marks,
            )
        lo = edges[last]
        k = loss[lo:]
        held = [out[offsets[lo] :].tobytes()]
        held_spans = [(starts[lo:][k] - offsets[lo], ends[lo:][k] - offsets[lo])]
        held_turns, held_id = batch.num_rows - int(lo), ids[int(lo)].as_py()
    if held:
        yield release()


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, n_turns, loss_starts, loss_ends``, one row per conversation.

    ``turns`` has ``conv_id, turn, role, text``. The loss spans are byte ranges of the UTF-8 form
    of ``formatted``: the escaped texts of ``loss_role``, in order.
    """
    rows = turns.select(
        F.col("conv_id").cast("long"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(lambda batches: _format(batches, loss_role), SCHEMA)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


def read_chat(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn."""
    start, end = START.decode(), END.decode() + "\n"
    turns = []
    for part in formatted.split(start)[1:]:
        if not part.endswith(end):
            raise ValueError("a turn has no end")
        role, _, text = part[: -len(end)].partition("\n")
        role = _UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], role)
        turns.append((role, unescape(text)))
    return turns


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            raw = r["formatted"].encode()
            turns = read_chat(r["formatted"])
            whole, loss, n_loss = hashlib.sha256(), hashlib.sha256(), 0
            for role, text in turns:
                whole.update(f"{role}\n{text}\n".encode())
            for lo, hi in zip(r["loss_starts"], r["loss_ends"], strict=True):
                text = unescape(raw[lo:hi].decode())
                n_loss += len(text)
                loss.update(text.encode())
            rows.append((r["conv_id"], len(turns), whole.hexdigest(), n_loss, loss.hexdigest(), len(r["formatted"])))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, names)


def chat_report(turns: DataFrame) -> DataFrame:
    """Digests of the turns and of the loss texts, read back from the formatted strings."""
    return format_chats(turns).mapInArrow(
        _digest,
        "conv_id BIGINT, n_turns BIGINT, turns_sha256 STRING, loss_chars BIGINT,"
        " loss_sha256 STRING, formatted_chars BIGINT",
    )
