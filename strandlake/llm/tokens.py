"""Token counts and ids: public tokenizers, splicing of overlapping chunks, and a cache of words."""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import as_bytes, map_arrow, split_words

#: Characters of a text that are encoded at once; longer texts go through ``spliced``.
CHUNK, OVERLAP = 65_536, 512
#: No boundary nearer than this to a cut counts: longer than a special token and any look-ahead of the pattern.
GUARD = 16
#: Bytes of text given to the library in one call, and words that a worker keeps.
CALL_BYTES, KEPT_WORDS, KEPT_LENGTH = 1_000_000, 800_000, 40


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def load_ranks(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encoded(tok, text: str, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, start of each token in the whole text, and where pre-tokens begin."""
    got = tok.encode(text, add_special_tokens=False)
    starts = np.array([a for a, _ in got.offsets], dtype=np.int64) + at
    words = np.array([-1 if w is None else w for w in got.word_ids], dtype=np.int64)
    first = np.ones(len(words), dtype=bool)
    first[1:] = words[1:] != words[:-1]
    return np.array(got.ids, dtype=np.int64), starts, starts[first]


def spliced(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[np.ndarray]:
    """Token ids of ``text``, in pieces, from overlapping chunks.

    The scan for pre-tokens runs left to right and looks at most a few characters
    ahead, so where two chunks both begin a pre-token at one place, away from
    their cuts, they agree from there on: the left chunk's ids up to it and the
    right chunk's from it are those of the whole text. If no such place lies in
    the overlap, it is doubled, at last to all that is left of the text.
    """
    end = min(chunk, len(text))
    ids, starts, begins = _encoded(tok, text[:end], 0)
    done = 0
    while end < len(text):
        wide, size = overlap, chunk
        while True:
            at = max(done, end - wide)
            to = min(len(text), at + max(size, 2 * (end - at)))
            right = _encoded(tok, text[at:to], at)
            common = np.intersect1d(begins, right[2])
            common = common[(common >= (at + GUARD if at > done else at)) & (common > done) & (common <= end - GUARD)]
            if len(common):
                break
            if at == done:  # nothing to agree on: encode more at once, from a boundary already proven
                size, at = 2 * max(size, end - done), done
                end = min(len(text), done + size)
                ids, starts, begins = _encoded(tok, text[done:end], done)
                if end == len(text):
                    common = None
                    break
            else:
                wide *= 2
        if common is None:
            break
        cut = int(common[-1])
        yield ids[(starts >= done) & (starts < cut)]
        done, end = cut, to
        ids, starts, begins = right
    yield ids[starts >= done]


def grouped(texts: list[bytes | None], size: int = CALL_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``size`` bytes together, or one longer text."""
    at = total = 0
    for k, t in enumerate(texts):
        n = len(t or b"")
        if k > at and total + n > size:
            yield at, k
            at, total = k, 0
        total += n
    if texts:
        yield at, len(texts)


#: Runs of blanks with what follows them: a pre-token of a byte-level tokenizer holds blanks at its start only, so one begins before each such run that follows something else.
_PIECE = re.compile(rb"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: UTF-8 of other white space; next to it, a run of blanks may begin inside a pre-token.
_ODD_BLANK = re.compile(rb"[\x0b\x0c\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8b\xa8\xa9\xaf]|\xe2\x81[\x9f\xa0]|\xe3\x80\x80|\xef\xbb\xbf")


class PieceCounts(dict):
    """Token counts of pieces of text, for a byte-level tokenizer without a normalizer; kept for a bounded number of pieces."""

    def __init__(self, tok):
        super().__init__()
        self.tok = tok
        self.cuts = tok.normalizer is None and type(tok.pre_tokenizer).__name__ == "ByteLevel"
        self.special = [t.content.encode() for t in tok.get_added_tokens_decoder().values()]

    def library(self, texts: list[bytes]) -> list[int]:
        return [len(e) for e in self.tok.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def splits(self, text: bytes) -> bool:
        """Whether the pieces of a text have its tokens: not if it holds the string of an added token, or white space that leaves a cut unproven."""
        return self.cuts and not any(t in text for t in self.special) and not _ODD_BLANK.search(text)

    def of(self, texts: list[bytes]) -> list[int]:
        """Token counts of whole texts."""
        pieces = [_PIECE.findall(t) if self.splits(t) else None for t in texts]
        rest = iter(self.library([t for t, p in zip(texts, pieces, strict=True) if p is None]))
        new = [p for p in set().union(*(p for p in pieces if p)) if p not in self]  # a difference would walk through all that is kept
        found = dict(zip(new, self.library(new), strict=True))
        if len(self) + len(found) > KEPT_WORDS:
            found |= {p: self[p] for p in set().union(*(p for p in pieces if p)) if p in self}
            self.clear()
        self.update(found)
        n = [next(rest) if p is None else sum(map(self.__getitem__, p)) for p in pieces]
        for p in new:
            if len(p) > KEPT_LENGTH:
                del self[p]
        return n


@cache
def piece_counts(path: str) -> PieceCounts:
    """One memory of pieces for all tasks of a Python worker."""
    return PieceCounts(load(path))


def counts(memory: PieceCounts, texts: list[bytes | None], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Token counts of texts: those of more than ``chunk`` characters by splicing, others by their pieces."""
    out: list[int] = []
    for a, b in grouped(texts):
        part = [t or b"" for t in texts[a:b]]
        long = {k: text for k, t in enumerate(part) if len(t) > chunk and len(text := t.decode()) > chunk}
        n = iter(memory.of([t for k, t in enumerate(part) if k not in long]))
        out += [sum(map(len, spliced(memory.tok, long[k], chunk, overlap))) if k in long else next(n) for k in range(len(part))]
    return out


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row.

    Null counts as empty: no bytes, no tokens. Texts of any length are read
    whole, in bounded chunks. Rows are counted one by one, so ids may be null or
    repeat; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def make():
        memory = piece_counts(path)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = as_bytes(batch.column("text"))
            n = counts(memory, texts, chunk, overlap)
            return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(t or b"") for t in texts], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())})

        return one

    return map_arrow(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")


#: A word of Latin letters that keep their form under NFC, and punctuation behind it: two pre-tokens, or one.
_PLAIN = re.compile("([a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\\[-`{-~]*)")


def byte_letters() -> dict[int, int]:
    """Byte to the character that stands for it in byte-level vocabularies: printable ones as they are, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


class WordIds(dict):
    """Ids of words as little-endian unsigned 32-bit bytes, for a lower-casing tokenizer that drops white space.

    Such a tokenizer normalises and splits within white-space-free pieces only, so
    the ids of a text are those of its pieces in turn. Plain words go to its model
    at once, others through all its steps. Pieces are kept, for a bounded number.
    """

    def __init__(self, tok):
        super().__init__()
        self.tok, self.model, self.letters = tok, tok.model, byte_letters()
        self._marks = lru_cache(10_000)(lambda marks: array("I", self._plain(marks)).tobytes())

    def _plain(self, pre_token: str) -> list[int]:
        if not pre_token.isascii():
            pre_token = pre_token.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(pre_token)]

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        found, rest = {}, []
        for w in words:
            low = w.lower()
            stem = low if low.isalpha() else low[:-1] if low[-1:] in b".,;:!?" and low[:-1].isalpha() else None
            if stem is not None:  # ASCII letters, and one mark behind them
                ids = self.get(stem) or found.get(stem) or array("I", [t.id for t in self.model.tokenize(stem.decode())]).tobytes()
                found[w] = ids if len(stem) == len(low) else ids + self._marks(low[-1:].decode())
            elif m := _PLAIN.fullmatch(w.decode()):
                ids = array("I", self._plain(m[1].lower())).tobytes()
                found[w] = ids + self._marks(m[2]) if m[2] else ids
            else:
                rest.append(w)
        for k in range(0, len(rest), 10_000):
            part = rest[k : k + 10_000]
            for w, e in zip(part, self.tok.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                found[w] = array("I", e.ids).tobytes()
        return found

    def of(self, texts: list[bytes | None]) -> Iterator[bytes]:
        for a, b in grouped(texts):
            words = [split_words(t) for t in texts[a:b]]
            ids = [list(map(self.get, ws)) for ws in words]
            gaps = []
            for xs in ids:
                at, k = [], -1
                for _ in range(xs.count(None)):
                    at.append(k := xs.index(None, k + 1))
                gaps.append(at)
            found = self._learn({ws[k] for ws, at in zip(words, gaps, strict=True) for k in at})
            for ws, xs, at in zip(words, ids, gaps, strict=True):
                for k in at:
                    xs[k] = found[ws[k]]
                yield b"".join(xs)
            if len(self) + len(found) > KEPT_WORDS:
                self.clear()
            self.update((w, x) for w, x in found.items() if len(w) <= KEPT_LENGTH)


@cache
def word_ids(path: str) -> WordIds:
    """One memory of words for all tasks of a Python worker."""
    return WordIds(load(path))
