"""Packing of token sequences: best fit by segment tree within a task, and hierarchical residual packing across tasks."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import as_bytes, map_arrow, stored
from strandlake.llm.tokens import load_ranks, word_ids

LENGTH = 4096
#: Items that one packing task takes, and how many tasks of a round meet in one of the next.
TASK_ITEMS, FAN = 50_000, 8
#: Bins at least so full are finished before the last round.
NEARLY_FULL = 0.995
#: Tokens that a task of ``packed_matrices`` holds at once.
HELD_TOKENS = 8_000_000


class CapacityTree:
    """Segment tree over room 0..size: how many bins have that room; finds the least room that suffices."""

    def __init__(self, size: int):
        self.width = 1 << (size + 1).bit_length()
        self.count = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, name: int) -> None:
        self.bins[room].append(name)
        k = room + self.width
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) with the least room >= need."""
        count, k = self.count, need + self.width
        while not count[k]:  # up, to the first subtree at the right that holds a bin
            while k & 1:
                k >>= 1
            if not k:
                return None
            k += 1
        while k < self.width:  # down, to its leftmost leaf
            k = 2 * k if count[2 * k] else 2 * k + 1
        room = k - self.width
        name = self.bins[room].pop()
        while k:
            count[k] -= 1
            k >>= 1
        return room, name


def best_fit_decreasing(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of item indexes; every length lies in 1..size. Ties go by index."""
    tree, bins = CapacityTree(size), []
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        if got := tree.take(need):
            room, name = got
            bins[name].append(k)
        else:
            room, name = size, len(bins)
            bins.append([k])
        if room > need:
            tree.add(room - need, name)
    return bins


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces of at most ``length``: doc_id, piece, start, length, ids_crc32 (and ids, little-endian unsigned 32-bit bytes). Null text is empty."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def make():
        words, end = word_ids(path), np.array([end_id], dtype="<u4").tobytes()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            for name, ids in zip(batch.column("doc_id").to_pylist(), words.of(as_bytes(batch.column("text"))), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    found.append((name, k, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else ())))
            columns = list(zip(*found, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

        return one

    return map_arrow(rows, make, PIECES + (", ids binary" if with_ids else ""))


UNITS = "unit bigint, length bigint, full boolean, items array<bigint>, offsets array<bigint>"


def packed_units(units: DataFrame, length: int, parts: int, last: bool) -> DataFrame:
    """One round: each of ``parts`` tasks fits its units (bins of earlier rounds, or single items) by best fit decreasing. A bin is named by its smallest item."""
    least = math.ceil(NEARLY_FULL * length)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True).sort_values("unit", ignore_index=True)
        sizes, items, offsets = rows["length"].to_numpy(), rows["items"].tolist(), rows["offsets"].tolist()
        out = []
        for members in best_fit_decreasing(sizes, length):
            at = np.concatenate(([0], np.cumsum(sizes[members])))
            inside = np.concatenate([items[k] for k in members])
            total = int(at[-1])
            out.append((int(inside.min()), total, bool(last or total >= least), inside, np.concatenate([offsets[k] + a for k, a in zip(members, at, strict=False)])))
        yield pd.DataFrame(out, columns=["unit", "length", "full", "items", "offsets"])

    return units.repartition(parts, F.xxhash64("unit")).mapInPandas(run, UNITS)


def packing(pieces: DataFrame, *, item: str = "item", length: int = LENGTH, task_items: int = TASK_ITEMS, fan: int = FAN) -> DataFrame:
    """(item, sequence_id, offset) for pieces with a unique ``item`` and a ``length`` of 1 to ``length``.

    Tasks pack their share locally and finish nearly full bins; the others go on
    as items to a round with ``fan`` times fewer tasks, which best-fits them
    again, up to one task, or as few as keep a task under ``task_items``. A
    sequence is named by its smallest item. An empty table gives no rows.
    """
    units = pieces.select(F.col(item).alias("unit"), F.col("length").cast("bigint").alias("length"), F.lit(False).alias("full"), F.array(F.col(item)).alias("items"), F.array(F.lit(0).cast("bigint")).alias("offsets"))
    done = units.where(F.col("length") >= length)
    units = units.where(F.col("length") < length)
    parts = max(1, math.ceil(units.count() / task_items))
    while True:
        last = parts == 1
        got = stored(packed_units(units, length, parts, last), "packed")
        done = done.union(got.where("full"))
        if last:
            break
        units = got.where("not full")
        fewer = max(math.ceil(parts / fan), math.ceil(units.count() / task_items))
        if fewer >= parts:  # what is left doesn't combine any more
            done = done.union(units)
            break
        parts = fewer
    return done.select(F.col("unit").alias("sequence_id"), F.explode(F.arrays_zip("items", "offsets")).alias("x")).select(F.col("x.items").alias(item), "sequence_id", F.col("x.offsets").alias("offset"))


def packed_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: hierarchical residual packing of all documents.

    Null and empty texts give the end id alone; overlong ones are cut into full
    pieces and a rest. Rows are packed one by one, so ids may be null or repeat;
    an empty table gives no rows; other columns are not read.
    """
    pieces = stored(token_pieces(docs, path, id_col=id_col, text_col=text_col, length=length, end_id=end_id).withColumn("item", F.monotonically_increasing_id()), "pieces")
    return pieces.join(packing(pieces, length=length), "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


MATRIX = "sequence_id string, ids binary, n_tokens int, cu_seqlens array<int>, resets array<int>, doc_ids array<bigint>, pieces array<int>, starts array<bigint>"


def packed_matrices(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = 50256, held_tokens: int = HELD_TOKENS) -> DataFrame:
    """Rows of an id matrix of ``length`` columns, one row a sequence.

    ids: little-endian unsigned 16-bit ids, filled up with ``end_id``; n_tokens:
    ids before the fill; cu_seqlens: 0 and the end of each segment; resets: where
    position ids begin at 0 again; doc_ids, pieces, starts: which part of which
    document a segment is. A document is its ids and ``end_id``, cut without loss
    where it is longer than ``length``. Each task packs up to ``held_tokens``
    tokens at once by best fit decreasing, so nothing is shuffled and a task's
    memory is bounded. Null and empty texts give ``end_id`` alone; rows are taken
    one by one, so ids may be null or repeat; an empty table gives no rows; other
    columns are not read. A sequence is named by task and number in it.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    kinds = [pa.string(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    names = ["sequence_id", "ids", "n_tokens", "cu_seqlens", "resets", "doc_ids", "pieces", "starts"]

    def run(batches):
        from pyspark import TaskContext

        task, coder, made = TaskContext.get().partitionId(), load_ranks(path), 0
        if end_id >= 1 << 16:
            raise ValueError("ids need more than 16 bits")
        parts: list[tuple] = []

        def flush():
            nonlocal made
            out = []
            for members in best_fit_decreasing(np.array([len(p[3]) for p in parts], dtype=np.int64), length):
                ids = np.concatenate([parts[k][3] for k in members])
                ends = np.cumsum([len(parts[k][3]) for k in members]).tolist()
                out.append((f"{task}-{made}", np.pad(ids, (0, length - len(ids)), constant_values=end_id).tobytes(), len(ids), [0, *ends], [0, *ends[:-1]], *([parts[k][c] for k in members] for c in range(3))))
                made += 1
            parts.clear()
            for k in range(0, len(out), 512):
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out[k : k + 512], strict=True), kinds, strict=True)], names=names)

        held = 0
        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(coder.encode_to_numpy(text or "", disallowed_special=()), end_id)
                if ids.max() >= 1 << 16:
                    raise ValueError("ids need more than 16 bits")
                ids = ids.astype("<u2")
                parts.extend((name, k, at, ids[at : at + length]) for k, at in enumerate(range(0, len(ids), length)))
                held += len(ids)
                if held >= held_tokens:
                    yield from flush()
                    held = 0
        if parts:
            yield from flush()

    return rows.mapInArrow(run, MATRIX)


def token_table(matrices: DataFrame) -> DataFrame:
    """doc_id, piece, start, ids (binary) of each segment: what ``packed_matrices`` took in."""
    segments = F.arrays_zip("doc_ids", "pieces", "starts", F.slice("cu_seqlens", F.lit(1), F.size("doc_ids")).alias("a"), F.slice("cu_seqlens", F.lit(2), F.size("doc_ids")).alias("b"))
    return matrices.select("ids", F.explode(segments).alias("s")).select(F.col("s.doc_ids").alias("doc_id"), F.col("s.pieces").alias("piece"), F.col("s.starts").alias("start"), F.expr("substring(ids, 2 * s.a + 1, 2 * (s.b - s.a))").alias("ids"))
