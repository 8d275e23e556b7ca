"""Quality rules: word and line counts, and bands of zstandard ratios over whole texts and fixed chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import as_bytes, map_arrow, rolling, split_words

SYMBOLS = b"#*$%&|<>"
_NOT_COUNTED = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))
LEVEL = 3
CHUNK = 4096
#: (bytes up to which it holds, least ratio, greatest ratio) of compressed to plain size: short texts compress less, so their band lies higher. The least ratios are what 99.5 % of the texts labelled good reach, in the half of labelled rows with an even id.
BANDS = ((256, 0.64, 1.10), (512, 0.55, 0.90), (1024, 0.51, 0.85), (2048, 0.475, 0.75), (4096, 0.447, 0.70), (8192, 0.425, 0.65), (16384, 0.41, 0.62), (float("inf"), 0.395, 0.60))
#: The band of a chunk, and the share of chunks that may lie outside.
CHUNK_BAND, CHUNK_SHARE = (0.435, 0.85), 0.34
COLUMNS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, ratio double, n_chunks bigint, n_bad_chunks bigint"


def repeat_words(hashes: np.ndarray, width: int = 8) -> int:
    """Words in windows of ``width`` words that the text has twice or more."""
    if len(hashes) <= width:
        return 0
    runs = rolling(hashes, width)
    order = np.argsort(runs, kind="stable")
    same = np.flatnonzero(runs[order[1:]] == runs[order[:-1]])
    if not len(same):
        return 0
    at = np.unique(np.concatenate((order[same], order[same + 1])))
    change = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + width, -1)
    return int((np.cumsum(change) > 0).sum())


def dup_lines(text: bytes | None) -> int:
    if not text:
        return 0
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def band(n_bytes: int) -> tuple[float, float]:
    return next((low, high) for most, low, high in BANDS if n_bytes <= most)


def measure(text: bytes | None, packer: zstandard.ZstdCompressor) -> tuple:
    words = split_words(text)
    text = text or b""
    n = len(words)
    # words are compared within a text only, so the hash of this process does
    repeated = repeat_words(np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64))
    failed = n < 20 or 100 * repeated > 30 * n
    ratio, full, bad, good = None, 0, 0, False
    if text:
        size = len(packer.compress(text))
        ratio = size / len(text)
        low, high = band(len(text))
        starts = [*range(0, len(text) - CHUNK + 1, CHUNK)]
        if starts and len(text) % CHUNK:  # what is left at the end, with bytes before it for a full chunk; a shorter text is judged whole
            starts.append(len(text) - CHUNK)
        for k in starts:
            full += 1
            part = len(packer.compress(text[k : k + CHUNK])) / CHUNK
            bad += not CHUNK_BAND[0] <= part <= CHUNK_BAND[1]
        good = low <= ratio <= high and bad <= CHUNK_SHARE * full
    return n, len(text.translate(None, _NOT_COUNTED)), len(text) - len(text.translate(None, SYMBOLS)), dup_lines(text), repeated, failed, good and not failed, ratio, full, bad


def _measurer():
    packer = zstandard.ZstdCompressor(level=LEVEL)
    return lambda column: [measure(t, packer) for t in as_bytes(column)]


_TYPES = (("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("n_chunks", pa.int64()), ("n_bad_chunks", pa.int64()))


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, counts, ratios and verdict.

    A null or empty text has no words, a null ratio, fails the base rules and is
    not kept; ids may be null or repeat, rows are judged one by one; an empty
    table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def make():
        of = _measurer()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = list(zip(*of(batch.column("text")), strict=True))
            return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {name: pa.array(x, kind) for (name, kind), x in zip(_TYPES, got, strict=True)})

        return one

    return map_arrow(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")


def kept_only(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""

    def make():
        of = _measurer()
        return lambda batch: batch.filter(pa.array([x[6] for x in of(batch.column(text_col))], pa.bool_()))

    return map_arrow(docs, make, docs.schema)
