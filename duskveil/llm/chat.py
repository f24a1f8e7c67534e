"""Chat formatting by columnar byte assembly.

Every turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside roles and texts are escaped reversibly:
a ``<`` that a run of backslashes and a ``|`` follow gets one more backslash in between, so no control string occurs in an
escaped text; in roles backslashes and line ends are escaped first. A batch of turns is laid out as one matrix of segment
lengths; cumulative offsets say where each segment starts and scatter indices copy headers and contents into one
preallocated Arrow buffer. The loss mask covers the text of every ``assistant`` turn.

Turns are ordered by (turn, role, text), nulls first, so ties and repeated rows have a defined order. Null role and text
are empty. A null conv_id is a conversation of its own. Texts stream through a partition sorted by conversation: of a
conversation only running digests are kept, so one of any length takes constant memory. Its digest is sequential by
definition, so one conversation is hashed by one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

START, END = b"<|im_start|>", b"<|im_end|>\n"
LOSS_ROLE = b"assistant"
_TURN = re.compile(rb"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ESCAPED = re.compile(rb"<\\(\\*)\|")


def escape(texts: pa.Array) -> pa.Array:
    """One more backslash in every ``<`` + backslashes + ``|``."""
    return pc.replace_substring_regex(texts.cast(pa.large_string()), r"<(\\*)\|", r"<\\\1|")


def escape_role(roles: pa.Array) -> pa.Array:
    """A role without line ends or control strings."""
    made = pc.replace_substring(roles.cast(pa.large_string()), "\\", "\\\\")
    return escape(pc.replace_substring(made, "\n", "\\n"))


def unescape(text: bytes) -> bytes:
    """The inverse of escape."""
    return _ESCAPED.sub(rb"<\1|", text)


def unescape_role(role: bytes) -> bytes:
    """The inverse of escape_role."""
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], unescape(role), flags=re.DOTALL)


def _flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array without nulls."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(formatted turns, start and end byte of each turn's text within its formatted turn)."""
    n = len(roles)
    role, text = escape_role(roles.fill_null("")), escape(texts.fill_null(""))
    (role_raw, role_at), (text_raw, text_at) = _flat(role), _flat(text)
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = len(START), 1, len(END)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    at = np.concatenate([[0], np.cumsum(lengths.ravel())])
    starts = at[:-1].reshape(n, 5)
    out = np.empty(int(at[-1]), np.uint8)
    for k, const in ((0, START), (2, b"\n"), (4, END)):
        out[starts[:, k][:, None] + np.arange(len(const))] = np.frombuffer(const, np.uint8)
    for k, raw, src in ((1, role_raw, role_at), (3, text_raw, text_at)):
        out[np.repeat(starts[:, k] - src[:-1], lengths[:, k]) + np.arange(len(raw))] = raw
    offsets = np.append(starts[:, 0], at[-1]).astype(np.int64)
    made = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    start = starts[:, 3] - starts[:, 0]
    return made, start, start + lengths[:, 3]


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_start, loss_end): one row per turn, in order within a partition that holds whole
    conversations; the loss mask as a span of bytes of the formatted turn, empty for roles without loss."""
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            made, start, end = assemble(b.column(1), b.column(2))
            loss = pc.equal(b.column(1).fill_null(""), LOSS_ROLE.decode()).to_numpy(zero_copy_only=False)
            yield common.batch(schema, b.column(0), made.cast(pa.string()), start, np.where(loss, end, start))

    common.prepare(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"), F.col("turn").cast("long"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(work, "conv_id long, formatted string, loss_start long, loss_end long")


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(made: DataFrame) -> DataFrame:
    """One row per conversation, all of it read back from formatted turns (as ``formatted`` leaves them)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None  # conv_id, turns, digest of turns, loss characters, digest of loss, characters

        def row() -> tuple:
            return state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]

        for b in batches:
            rows = []
            for conv, raw, start, end in zip(b.column(0).to_pylist(), common.text_bytes(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if state is None or state[0] != conv:
                    rows += [row()] if state is not None else []
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for m in _TURN.finditer(raw):
                    state[1] += 1
                    state[2].update(b"\n".join((unescape_role(m[1]), unescape(m[2]), b"")))
                loss = unescape(raw[start:end])
                state[3] += len(loss.decode())
                state[4].update(loss)
                state[5] += len(raw.decode())
            yield common.batch(_DIGEST, *([r[i] for r in rows] for i in range(6)))
        if state is not None:
            yield common.batch(_DIGEST, *([x] for x in row()))

    return made.mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
