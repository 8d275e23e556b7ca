"""Language identification: log frequencies of known words, backing off to ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import as_bytes, map_arrow, mixed, split_words

#: Labelled rows that the model is fitted on, at most about so many. It keeps every word and n-gram of theirs.
FIT_ROWS = 5_000
#: Lengths of n-grams for unseen words, in order.
GRAMS = (4, 3, 2, 1)
#: Words whose scores a worker keeps.
CACHE = 500_000
UNKNOWN = "und"

_RUNS = re.compile(r"[^\W\d_]+|\n")


def letter_runs(words: list[bytes]) -> tuple[list[str], np.ndarray]:
    """Lower-case letter runs of all words, and the number of the word that each is of."""
    runs, owner, k = [], [], 0
    for found in _RUNS.findall("\n".join(w.decode() for w in words).lower()):
        if found == "\n":
            k += 1
        else:
            runs.append(found)
            owner.append(k)
    return runs, np.array(owner, dtype=np.int64)


def run_keys(runs: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(r.encode()) for r in runs), dtype=np.uint64, count=len(runs))


def gram_keys(runs: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams of runs, framed by ^ and $ (single letters without the frame), and the number of the run that each is of."""
    codes = np.frombuffer("".join(f"^{r}$" for r in runs).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs)) + 2
    starts = np.cumsum(sizes) - sizes
    if n == 1:
        sizes, starts = sizes - 2, starts + 1
    many = np.maximum(sizes - n + 1, 0)
    of = np.repeat(np.arange(len(runs)), many)
    at = np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(len(of))
    keys = np.full(len(at), n, dtype=np.uint64)
    for k in range(n):
        keys = keys * np.uint64(0x110003) + codes[at + k]
    return mixed(keys), of


class Model:
    """Log frequencies of words and n-grams by language, found by their keys; from columns n (0 for words), key, lang and count."""

    def __init__(self, n: np.ndarray, key: np.ndarray, lang: np.ndarray, count: np.ndarray):
        self.langs = sorted(set(lang.tolist()))
        column = np.searchsorted(np.array(self.langs, dtype=object), lang) if len(lang) else np.empty(0, np.int64)
        self.keys, at = np.unique(key, return_inverse=True)
        counts = np.zeros((len(self.keys), max(1, len(self.langs))))
        np.add.at(counts, (at, column), count)
        kind = np.zeros(len(self.keys), dtype=np.int64)
        kind[at] = n
        self.scores = np.zeros_like(counts)
        for k in np.unique(kind):
            mine = kind == k
            self.scores[mine] = np.log((counts[mine] + 0.5) / (counts[mine].sum(axis=0) + 0.5 * (mine.sum() + 1)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of ``scores``, -1 for unknown keys."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def run_scores(self, runs: list[str]) -> np.ndarray:
        """Log frequencies of each run, or the mean ones of its longest n-grams that are known, less the greatest; 0 where nothing is known."""
        out = np.zeros((len(runs), self.scores.shape[1]))
        at = self.find(run_keys(runs))
        out[at >= 0] = self.scores[at[at >= 0]]
        left = np.flatnonzero(at < 0)
        for n in GRAMS:
            if not len(left):
                break
            keys, of = gram_keys([runs[k] for k in left.tolist()], n)
            at = self.find(keys)
            of, at = of[at >= 0], at[at >= 0]
            hits = np.bincount(of, minlength=len(left))
            for k in range(out.shape[1]):
                out[left, k] = np.bincount(of, weights=self.scores[at, k], minlength=len(left)) / np.maximum(hits, 1)
            left = left[hits == 0]
        return out - out.max(axis=1, keepdims=True) if len(runs) else out


class Scorer:
    """Language of texts. Words are scored once, all new ones of a batch together, and kept, for a bounded number of words."""

    def __init__(self, model: Model):
        self.model = model
        self._empty()

    def _empty(self):
        self.index: dict[bytes, int] = {}
        self.scores = np.zeros((1, max(1, len(self.model.langs))))  # row 0: no letter

    def _learn(self, words: list[bytes]) -> None:
        runs, owner = letter_runs(words)
        with_letters, row = np.unique(owner, return_inverse=True)
        scores = np.zeros((len(with_letters), self.scores.shape[1]))
        if self.model.langs and runs:
            np.add.at(scores, row, self.model.run_scores(runs))
        rows = np.zeros(len(words), dtype=np.int64)
        rows[with_letters] = len(self.scores) + np.arange(len(with_letters))
        self.index.update(zip(words, rows.tolist(), strict=True))
        self.scores = np.concatenate((self.scores, scores))

    def languages(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        if len(self.index) > CACHE:
            self._empty()
        words = [split_words(t) for t in texts]
        if new := list(set().union(*words).difference(self.index)):
            self._learn(new)
        return [self._best(np.fromiter(map(self.index.__getitem__, ws), dtype=np.int64, count=len(ws))) for ws in words]

    def _best(self, at: np.ndarray) -> tuple[str, float]:
        at = at[at > 0]
        if not len(at) or not self.model.langs:
            return UNKNOWN, 0.0
        total = self.scores[at].sum(axis=0)
        p = np.exp(total - total.max())
        best = int(p.argmax())
        return self.model.langs[best], float(p[best] / p.sum())


def fitted(rows: DataFrame, limit: int = FIT_ROWS) -> Model:
    """Model from ``rows`` (id, text, lang), null neither in text nor lang; of more than ``limit`` rows, those with a low hash of the id."""
    known = rows.where("text is not null and lang is not null")
    total = known.count()
    if total > limit:
        known = known.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) < int((1 << 30) * limit / total))

    def run(batches):
        words: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(as_bytes(batch.column("text")), batch.column("lang").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(text.split())
        for lang, found in words.items():
            runs, owner = letter_runs(list(found))
            weights = np.fromiter(found.values(), dtype=np.int64, count=len(found))[owner]
            for n in (0, *GRAMS):
                keys, of = gram_keys(runs, n) if n else (run_keys(runs), np.arange(len(runs)))
                keys, at = np.unique(keys, return_inverse=True)
                count = np.bincount(at, weights=weights[of], minlength=len(keys)).astype(np.int64)
                for k in range(0, len(keys), 50_000):
                    part = slice(k, k + 50_000)
                    size = len(keys[part])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, n, np.int32)), pa.array(keys[part].view(np.int64)), pa.array([lang] * size, pa.string()), pa.array(count[part])], names=["n", "key", "lang", "c"])

    counts = known.select("text", "lang").mapInArrow(run, "n int, key bigint, lang string, c bigint").groupBy("n", "key", "lang").agg(F.sum("c").alias("c"))
    found = counts.toArrow()
    return Model(found.column("n").to_numpy(), found.column("key").to_numpy().view(np.uint64), np.array(found.column("lang").to_pylist(), dtype=object), found.column("c").to_numpy())


def languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limit: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row.

    Learns from rows with a language whose crc32 of the id, as text, isn't 2
    modulo 4; a row without an id is never learned from and not held out. Text is
    the only input of a prediction and read whole. Null text and text without a
    letter give ``und`` and 0, as does all text if nothing was learned. Rows are
    judged one by one, so ids may repeat; an empty table gives no rows; other
    columns are not read.
    """
    out = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), out.alias("held_out"))
    held = docs.sparkSession.sparkContext.broadcast(fitted(rows.where("not held_out and id is not null"), limit))

    def make():
        scorer = _scorer(held)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = scorer.languages(as_bytes(batch.column("text")))
            return pa.RecordBatch.from_pydict({"doc_id": batch.column("id"), "held_out": batch.column("held_out"), "lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64())})

        return one

    return map_arrow(rows.select("id", "text", "held_out"), make, f"doc_id {rows.schema['id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


_SCORERS: dict[int, Scorer] = {}


def _scorer(held) -> Scorer:
    """The worker's scorer for a broadcast model: its words stay known from task to task."""
    if id(held.value) not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[id(held.value)] = Scorer(held.value)
    return _SCORERS[id(held.value)]
