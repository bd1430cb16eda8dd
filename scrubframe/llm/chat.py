"""Chat formatting by columnar byte assembly, and the reader of what it writes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, TRAINED = "<|im_start|>", "<|im_end|>", "assistant"
PIECES = "conv_id bigint, turn bigint, piece binary, loss_start bigint, loss_end bigint"
READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escape(texts: pa.Array) -> pa.Array:
    """Put one more backslash between every ``<``, its backslashes and ``|``; no control string is left."""
    return pc.replace_substring_regex(texts, pattern=r"<(\\*)\|", replacement=r"<\\\1|")


def escape_role(roles: pa.Array) -> pa.Array:
    """As for texts; a line break, which ends the role, becomes ``<\\n`` and a ``<`` before backslashes and n gets one more."""
    roles = pc.replace_substring_regex(escape(roles), pattern=r"<(\\*)n", replacement=r"<\\\1n")
    return pc.replace_substring(roles, pattern="\n", replacement="<n")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"<\\(\\*)n", r"<\1n", re.sub(r"<n", "\n", role)))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and data of a string array that starts at 0."""
    column = pa.concat_arrays([column.cast(pa.large_string())])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def assemble(columns: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join the segments of each row: one preallocated buffer, filled by scatter indices.

    ``columns`` are (offsets, data) per segment of the template. Returns the buffer, the offsets of its rows and, per row
    and segment, where the segment starts in the buffer.
    """
    lengths = np.stack([np.diff(offsets) for offsets, _ in columns], axis=1)
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if len(ends) else 0, np.uint8)
    for k, (offsets, data) in enumerate(columns):
        size = lengths[:, k]
        shift = np.repeat(starts[:, k] - offsets[:-1], size)
        source = np.arange(offsets[0], offsets[-1]) if len(offsets) > 1 else np.empty(0, np.int64)
        out[source + shift] = data[offsets[0]:offsets[-1]] if len(offsets) > 1 else data[:0]
    return out, np.concatenate([[0], ends[:, -1]]) if len(ends) else np.zeros(1, np.int64), starts


def _constant(value: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(value.encode(), np.uint8)
    return np.arange(n + 1) * len(raw), np.tile(raw, n)


def format_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    roles = pc.fill_null(batch.column("role"), "")
    texts = escape(pc.fill_null(batch.column("text"), ""))
    n = batch.num_rows
    segments = [_constant(START, n), _bytes_of(escape_role(roles)), _constant("\n", n), _bytes_of(texts), _constant(END + "\n", n)]
    out, rows, starts = assemble(segments)
    trained = pc.equal(roles, TRAINED).to_numpy(zero_copy_only=False)
    first = starts[:, 3] - rows[:-1]
    last = starts[:, 4] - rows[:-1]
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(rows.astype(np.int64)), pa.py_buffer(out)])
    return pa.RecordBatch.from_arrays(
        [batch.column("conv_id"), batch.column("turn"), pieces.cast(pa.binary()),
         pa.array(np.where(trained, first, 0)), pa.array(np.where(trained, last, 0))],
        ["conv_id", "turn", "piece", "loss_start", "loss_end"])


def chat_format(turns: DataFrame) -> DataFrame:
    """One formatted piece per turn; a conversation is its pieces in order of turn.

    Columns: conv_id, turn, piece (bytes), loss_start and loss_end (byte range of the piece under the loss mask; empty
    unless the role is assistant). A turn is ``<|im_start|>role\\ntext<|im_end|>\\n`` with control strings in role and text
    escaped reversibly. Pieces instead of one long value per conversation let a conversation hold any share of the rows.
    Null text and null role are empty, null conv_id and turn are kept; equal rows give equal pieces; extra columns are
    ignored; no rows give none. Nothing is shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield format_batch(batch)

    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, PIECES)


def read_piece(piece: bytes) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    text = piece.decode()
    role, _, rest = text[len(START):].partition("\n")
    return unescape_role(role), unescape(rest[:-len(END) - 1])


class _Conversation:
    """Running digests of one conversation."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, piece: bytes, first: int, last: int) -> None:
        role, text = read_piece(piece)
        self.turns.update(f"{role}\n{text}\n".encode())
        trained = unescape(piece[first:last].decode())
        self.loss.update(trained.encode())
        self.n += 1
        self.loss_chars += len(trained)
        self.chars += len(piece.decode())

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(pieces: DataFrame) -> DataFrame:
    """Read formatted conversations: number of turns, digests of all turns and of the text under the loss mask, lengths.

    Pieces are sorted by Spark, which spills, and streamed: a conversation of any length needs the memory of one batch.
    A digest over a whole conversation is sequential, so one conversation is read by one task. Pieces of equal turn are
    taken in order of their bytes; a null conv_id is a conversation of its own.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                            ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        now, done = None, []
        for batch in batches:
            for conv_id, piece, first, last in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end")), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(conv_id)
                now.add(piece, first, last)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(now.row(), schema.types, strict=True)], schema=schema)

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece")
    return ordered.select("conv_id", "piece", "loss_start", "loss_end").mapInArrow(run, READ)
