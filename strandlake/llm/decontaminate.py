"""Benchmark decontamination: one Aho-Corasick automaton over the items' word windows."""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import as_bytes, map_arrow

#: Bytes of item text that one automaton holds; a larger benchmark is scanned in blocks.
BLOCK_BYTES = 32_000_000
#: Lower-cases A-Z, keeps a-z, 0-9 and all bytes from 0x80, blanks the rest; lengths stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
HITS = "id bigint, n_words bigint, words array<int>, items array<string>, spans array<struct<start: bigint, end: bigint>>"


def normal_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text."""
    return text.translate(_TABLE).split() if text else []


def windows(words: list[bytes], width: int) -> list[bytes]:
    """Each run of ``width`` words, framed by blanks; fewer, but not none, are one run."""
    return [b" " + b" ".join(words[k : k + width]) + b" " for k in range(max(1, len(words) - width + 1))] if words else []


def automaton(items: list[tuple[str, bytes | None]], width: int) -> ahocorasick.Automaton:
    """Automaton whose value for a window is (its words, the items that have it)."""
    found: dict[bytes, set[str]] = {}
    for name, text in items:
        for w in windows(normal_words(text), width):
            found.setdefault(w, set()).add(name)
    out = ahocorasick.Automaton()
    for w, names in found.items():
        out.add_word(w.decode(), (w.count(b" ") - 1, tuple(sorted(names))))
    if found:
        out.make_automaton()
    return out


def scan(machine: ahocorasick.Automaton, text: bytes | None) -> tuple[int, list[int], list[str], list[tuple[int, int]]]:
    """(words, hit word indexes, items found, byte spans of the original text that are hit)."""
    words = normal_words(text)
    if not words or not len(machine):
        return len(words), [], [], []
    hits = list(machine.iter((b" " + b" ".join(words) + b" ").decode()))
    if not hits:
        return len(words), [], [], []
    ends = np.cumsum([len(w.decode()) + 1 for w in words])  # index of the blank behind each word
    last = np.searchsorted(ends, [end for end, _ in hits])
    change = np.zeros(len(words) + 1, dtype=np.int64)
    items: set[str] = set()
    for k, (_, (width, names)) in zip(last.tolist(), hits, strict=True):
        change[k - width + 1] += 1
        change[k + 1] -= 1
        items.update(names)
    hit = np.flatnonzero(np.cumsum(change)[:-1] > 0)
    # offsets: blanked text has the original's length, so word starts and ends carry over
    solid = np.concatenate(([0], (np.frombuffer(text.translate(_TABLE), dtype=np.uint8) > 32).view(np.int8), [0]))
    at, to = np.flatnonzero(np.diff(solid) == 1), np.flatnonzero(np.diff(solid) == -1)
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
    return len(words), hit.tolist(), sorted(items), [(int(at[r[0]]), int(to[r[-1]])) for r in runs]


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Where windows of benchmark items occur in documents.

    Returns id, n_words, words (hit word indexes), items (ids as strings, sorted),
    spans (byte offsets in the original UTF-8 text; those of different blocks may
    overlap), one row for each row of ``docs``. Null and empty texts have no words and no hits; items without a
    word have no window; repeated rows are answered row by row; an empty benchmark
    hits nothing. Only the id and text columns are read, so other columns may have
    any name. Items of up to ``block_bytes`` go into one automaton sent to the
    tasks; a larger benchmark is cut into blocks, each scanned against all rows.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    if blocks > 1:
        source = source.withColumn("row", F.monotonically_increasing_id())

    def block(k: int) -> DataFrame:
        rows = (items.where(F.pmod(F.hash("item"), F.lit(blocks)) == k) if blocks > 1 else items).collect()
        held = docs.sparkSession.sparkContext.broadcast([(r["item"], r["text"].encode()) for r in rows])

        def make():
            machine = automaton(held.value, width)

            def one(batch: pa.RecordBatch) -> pa.RecordBatch:
                got = [scan(machine, t) for t in as_bytes(batch.column("text"))]
                out = {"id": batch.column("id"), "n_words": pa.array([g[0] for g in got], pa.int64()), "words": pa.array([g[1] for g in got], pa.list_(pa.int32())), "items": pa.array([g[2] for g in got], pa.list_(pa.string())), "spans": pa.array([[{"start": a, "end": b} for a, b in g[3]] for g in got], SPANS)}
                if blocks > 1:
                    out["row"] = batch.column("row")
                return pa.RecordBatch.from_pydict(out)

            return one

        return map_arrow(source, make, HITS + (", row bigint" if blocks > 1 else ""))

    if blocks == 1:
        return block(0)
    parts = block(0)
    for k in range(1, blocks):
        parts = parts.union(block(k))
    merged = parts.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("words", "items", "spans")))
    return merged.drop("row")


def digest(hits: DataFrame, id_name: str = "doc_id") -> DataFrame:
    """The contract's columns from ``contamination``."""
    return hits.select(F.col("id").alias(id_name), "n_words", F.size("words").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("words") > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows in which a window of an item occurs; all columns stay. Rows with null or empty text stay; an empty benchmark removes nothing."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for k in range(blocks):
        rows = (items.where(F.pmod(F.hash("item"), F.lit(blocks)) == k) if blocks > 1 else items).collect()
        held = docs.sparkSession.sparkContext.broadcast([(r["item"], r["text"].encode()) for r in rows])

        def make(held=held):
            machine = automaton(held.value, width)
            return lambda batch: batch.filter(pa.array([not scan(machine, t)[1] for t in as_bytes(batch.column(text_col))], pa.bool_()))

        docs = map_arrow(docs, make, docs.schema)
    return docs
