"""Chat formatting by columnar byte assembly.

A turn becomes ``### role: text</turn>`` and a line feed. Control strings
inside roles and texts are escaped by a backslash, and so are backslashes (in
roles colons too), so that the formatted text can be taken apart again. The
loss mask names the runs of code points that hold an assistant's text.

A batch of turns is never formatted turn by turn: the length of every segment
(header, role, separator, text, end) gives cumulative offsets, those give the
place of every byte, and headers and contents are copied by index into one
buffer, which becomes the string column as it is. The reader works in the same
way on whole buffers: it marks escapes, finds control strings, and leaves out
or replaces bytes.

Turns are sorted by (conv_id, turn, role, MD5 of the text), nulls first, over
all tasks, so a conversation of any size is dealt out; rows that are equal in
these are interchangeable. A written row is a part: the whole of a conversation
(``whole`` is true), but for very long ones, which go on in another part once a
task holds over ``PART_BYTES`` of their turns, and for those on a border of two
tasks. Their parts follow each other by ``part``; the reader's digests stream
over them.

Null texts and null roles count as empty. Rows without conv_id are one
conversation. Repeated rows are turns of their own. An empty table gives an
empty one; columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import bounded_batches
from shelfmark.session import materialize

#: The template (fixed values of the format).
HEADER, SEPARATOR, END = b"### ", b": ", b"</turn>\n"
#: What is escaped inside roles and texts; the line feed after the end mark needs no escape.
CONTROL = (HEADER, END[:-1])
ESCAPE, COLON = ord("\\"), ord(":")
LOSS_ROLE = b"assistant"
#: Bytes of turns from which on a conversation goes on in another part.
PART_BYTES = 4 << 20

PARTS_SCHEMA = "conv_id long, part long, whole boolean, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>"
DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """All places of runs, run after run."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


def _find(raw: np.ndarray, what: bytes) -> np.ndarray:
    """Places where ``what`` begins."""
    if len(raw) < len(what):
        return np.empty(0, np.int64)
    n = len(raw) - len(what) + 1
    at = np.flatnonzero(raw[:n] == what[0])
    for k, b in enumerate(what[1:], 1):
        at = at[raw[at + k] == b]
    return at


def _inside(at: np.ndarray, size: int, ends: np.ndarray) -> np.ndarray:
    """Of matches of ``size`` bytes those that don't reach over the end of their value."""
    return at[at + size <= ends[np.searchsorted(ends, at, side="right")]] if len(at) else at


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, length) of a string column; nulls have no bytes."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets[:-1] - offsets[0], np.diff(offsets)


def _escaped(column: pa.Array, colons: bool) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, length of each value) of a string column after escaping."""
    raw, starts, lens = _buffers(column)
    if not len(raw):
        return raw, lens
    ends = starts + lens
    flags = raw == ESCAPE
    if colons:
        flags |= raw == COLON
    for mark in CONTROL:
        flags[_inside(_find(raw, mark), len(mark), ends)] = True
    if not flags.any():
        return raw, lens
    upto = np.concatenate(([0], np.cumsum(flags)))
    out = np.full(len(raw) + int(upto[-1]), ESCAPE, np.uint8)
    out[np.arange(len(raw)) + upto[1:]] = raw
    return out, lens + upto[ends] - upto[starts]


def _chars_before(raw: np.ndarray) -> np.ndarray:
    """Code points before every byte place, and in all."""
    return np.concatenate(([0], np.cumsum(raw & 0xC0 != 0x80)))


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all formatted turns, end of each turn, [start, end] in bytes of each turn's text)."""
    role, role_len = _escaped(roles, True)
    text, text_len = _escaped(texts, False)
    n = len(role_len)
    fixed = np.frombuffer(HEADER + SEPARATOR + END, np.uint8)
    # the five segments of every turn, in order: lengths, then cumulative offsets
    sizes = np.empty((n, 5), np.int64)
    sizes[:, 0], sizes[:, 2], sizes[:, 4] = len(HEADER), len(SEPARATOR), len(END)
    sizes[:, 1], sizes[:, 3] = role_len, text_len
    ends = np.cumsum(sizes.ravel()).reshape(n, 5)
    starts = ends - sizes
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    at = 0
    for k, piece in ((0, HEADER), (2, SEPARATOR), (4, END)):
        out[(starts[:, k, None] + np.arange(len(piece))).ravel()] = np.tile(fixed[at : at + len(piece)], n)
        at += len(piece)
    out[_ranges(starts[:, 1], role_len)] = role
    out[_ranges(starts[:, 3], text_len)] = text
    return out, ends[:, 4], np.stack([starts[:, 3], ends[:, 3]], axis=1)


def _string_column(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(raw)).cast(pa.string())


def _list_column(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values.astype(np.int64)))


def _parts(batch: pa.Table, first: int, whole: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
    """One row per part; ``cuts``: the first turn of each part, and the end."""
    roles, texts = (batch[c].combine_chunks() for c in ("role", "text"))
    raw, turn_ends, spans = assemble(roles, texts)
    n = len(cuts) - 1
    part_ends = turn_ends[cuts[1:] - 1]
    part_starts = np.concatenate(([0], part_ends[:-1]))
    chars = _chars_before(raw)
    loss = np.asarray(roles.cast(pa.binary()).fill_null(b"").to_numpy(zero_copy_only=False) == LOSS_ROLE)
    turns = np.diff(cuts)
    owner = np.repeat(np.arange(n), turns)
    spans = chars[spans] - chars[part_starts[owner]][:, None]
    counts = np.bincount(owner[loss], minlength=n)
    return pa.RecordBatch.from_arrays(
        [
            batch["conv_id"].combine_chunks().take(pa.array(cuts[:-1])),
            pa.array(first + np.arange(n)),
            pa.array(whole),
            pa.array(turns),
            _string_column(raw, part_ends),
            _list_column(spans[loss, 0], counts),
            _list_column(spans[loss, 1], counts),
        ],
        ["conv_id", "part", "whole", "n_turns", "formatted", "loss_starts", "loss_ends"],
    )


def format_conversations(turns: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The parts (``PARTS_SCHEMA``) of all conversations.

    ``loss_starts`` and ``loss_ends`` are code points of ``formatted``, a run
    for each assistant text, empty texts included.
    """
    spark = turns.sparkSession
    # equal keys are told apart by the row's place in its scan, so that no key is too hot to be split
    keyed = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text",
        F.md5(F.coalesce("text", F.lit(""))).alias("digest"), F.monotonically_increasing_id().alias("place"),
    )
    order = ["conv_id", "turn", "role", "digest", "place"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        held, held_bytes = [], 0  # the last conversation of what has come, still open
        continued = True  # the first one may have begun in the task before

        def close(table: pa.Table, more: bool) -> Iterator[pa.RecordBatch]:
            """more: the last conversation may go on."""
            nonlocal number, continued
            conv = table["conv_id"].combine_chunks()
            ids, null = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
            new = np.flatnonzero((ids[1:] != ids[:-1]) | (null[1:] != null[:-1])) + 1
            cuts = np.concatenate(([0], new, [len(ids)]))
            whole = np.ones(len(cuts) - 1, bool)
            whole[0] &= not continued
            whole[-1] &= not more
            yield _parts(table, number, whole, cuts)
            number += len(whole)
            continued = more

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            conv = table["conv_id"].combine_chunks()
            same = pc.fill_null(pc.equal(conv, conv[-1]), False) if conv[-1].is_valid else conv.is_null()
            begin = len(conv) - int(pc.sum(same).as_py())  # of the last conversation
            last = table.slice(begin)
            held_bytes = last.nbytes
            if held_bytes > part_bytes:
                yield from close(table, True)
                held, held_bytes = [], 0
                continue
            if begin:
                yield from close(table.slice(0, begin), False)
            held = last.combine_chunks().to_batches()
        if held:
            yield from close(pa.Table.from_batches(held), True)

    return ranged.mapInArrow(run, PARTS_SCHEMA)


class _Read:
    """The bytes of formatted parts, taken apart by marks."""

    def __init__(self, formatted: pa.Array):
        raw, starts, lens = _buffers(formatted)
        self.raw, self.starts, self.ends = raw, starts, starts + lens
        # in a run of backslashes those at even places are escapes; runs don't reach over an end of a turn
        slash = np.flatnonzero(raw == ESCAPE)
        run = np.flatnonzero(np.diff(slash, prepend=-2) > 1)
        place = np.arange(len(slash)) - np.repeat(run, np.diff(run, append=len(slash)))
        self.escape = slash[place % 2 == 0]
        self.literal = np.zeros(len(raw) + 1, bool)
        self.literal[self.escape + 1] = True

    def _controls(self, what: bytes) -> np.ndarray:
        at = _find(self.raw, what)
        return at[~self.literal[at]]

    def turns(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, end of each part in them) of role, line feed, text, line feed per turn."""
        keep = np.ones(len(self.raw), bool)
        keep[self.escape] = False
        heads, ends = self._controls(HEADER), self._controls(END)
        keep[(heads[:, None] + np.arange(len(HEADER))).ravel()] = False
        colons = np.flatnonzero((self.raw == COLON) & ~self.literal[:-1])
        colons = colons[np.searchsorted(colons, heads)] if len(heads) else heads
        keep[colons + 1] = False
        keep[(ends[:, None] + np.arange(len(END) - 1)).ravel()] = False
        raw = self.raw.copy()
        raw[colons] = ord("\n")
        upto = np.concatenate(([0], np.cumsum(keep)))
        return raw[keep], upto[self.ends]

    def under(self, starts: pa.Array, stops: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, end of each part in them) of what lies under the mask, unescaped."""
        firsts = np.flatnonzero(self.raw & 0xC0 != 0x80)  # byte of every code point
        base = np.searchsorted(firsts, self.starts)
        firsts = np.append(firsts, len(self.raw))
        offsets = np.asarray(starts.offsets)
        shift = np.repeat(base, np.diff(offsets))
        lo = np.asarray(starts.values)[offsets[0] : offsets[-1]] + shift
        hi = np.asarray(stops.values)[offsets[0] : offsets[-1]] + shift
        edge = np.zeros(len(self.raw) + 1, np.int64)
        np.add.at(edge, firsts[lo], 1)
        np.add.at(edge, firsts[hi], -1)
        keep = np.cumsum(edge)[:-1] > 0
        keep[self.escape] = False
        upto = np.concatenate(([0], np.cumsum(keep)))
        return self.raw[keep], upto[self.ends]


def conversation_digests(parts: DataFrame) -> DataFrame:
    """``DIGEST_SCHEMA`` of every conversation of written parts.

    Whole conversations are digested where they are read. The parts of the
    others stream through one task per conversation, in their order; nothing
    but the running digests is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_row: list | None = None

        def out(rows: list[list]) -> pa.RecordBatch:
            ids, n, turns, n_loss, loss, n_chars = map(list, zip(*rows, strict=True))
            digests = [[h.hexdigest() for h in col] for col in (turns, loss)]
            columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), digests[0], pa.array(n_loss, pa.int64()), digests[1], pa.array(n_chars, pa.int64())]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.string()) for c in columns], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            if not batch.num_rows:
                continue
            read = _Read(batch["formatted"])
            turns, turn_ends = read.turns()
            loss, loss_ends = read.under(batch["loss_starts"], batch["loss_ends"])
            chars = _chars_before(read.raw)
            n_chars = (chars[read.ends] - chars[read.starts]).tolist()
            loss_chars = _chars_before(loss)[np.concatenate(([0], loss_ends))]
            n_loss = np.diff(loss_chars).tolist()
            turns, loss = memoryview(turns), memoryview(loss)
            a = b = 0
            closed = []
            for k, (conv, whole, n) in enumerate(zip(batch["conv_id"].to_pylist(), batch["whole"].to_pylist(), batch["n_turns"].to_pylist(), strict=True)):
                if open_row is not None and (whole or open_row[0] != conv):
                    closed.append(open_row)
                    open_row = None
                if open_row is None:
                    open_row = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                open_row[1] += n
                open_row[2].update(turns[a : turn_ends[k]])
                open_row[3] += n_loss[k]
                open_row[4].update(loss[b : loss_ends[k]])
                open_row[5] += n_chars[k]
                a, b = turn_ends[k], loss_ends[k]
                if whole:
                    closed.append(open_row)
                    open_row = None
            if closed:
                yield out(closed)
        if open_row is not None:
            yield out([open_row])

    columns = ["conv_id", "whole", "n_turns", "formatted", "loss_starts", "loss_ends"]
    whole = parts.filter("whole").select(*columns).mapInArrow(run, DIGEST_SCHEMA)
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = parts.filter("not whole").repartition(n, "conv_id").sortWithinPartitions("conv_id", "part")
    return whole.unionByName(rest.select(*columns).mapInArrow(run, DIGEST_SCHEMA))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    parts = materialize(format_conversations(turns.unionByName(own)), "formatted")
    return conversation_digests(parts)


OP13_SQL = """
with t as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, n, r, '\\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(n, r)),
e as (
    select *, length(text) + length(text) - length(replace(text, '\\', ''))
        + (length(text) - length(replace(text, '### ', ''))) // 4 + (length(text) - length(replace(text, '</turn>', ''))) // 7 as text_out,
        length(role) + length(role) - length(replace(role, '\\', '')) + length(role) - length(replace(role, ':', ''))
        + (length(role) - length(replace(role, '### ', ''))) // 4 + (length(role) - length(replace(role, '</turn>', ''))) // 7 as role_out
    from t)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, md5(text))) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn nulls first, role, md5(text)) filter (role = 'assistant'), '')) as loss_sha256,
    sum(14 + text_out + role_out)::bigint as formatted_chars
from e group by conv_id
"""
