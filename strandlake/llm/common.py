"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a key table up to which it is broadcast; above, Spark shuffles both sides.
BROADCAST_ROWS = 1_000_000
#: Bytes of its Parquet files up to which it is broadcast.
BROADCAST_BYTES = 64 << 20
#: Rows of a batch, and about how many bytes, that are turned into Python objects at once.
SLICE, SLICE_BYTES = 1000, 8 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local one on a local master; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='strandlake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
    return found


def _hadoop(path: str) -> tuple:
    """File system and path, by a gateway that outlives a stopped session."""
    from pyspark import SparkContext

    jvm = SparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    active = SparkContext._active_spark_context
    conf = active._jsc.hadoopConfiguration() if active is not None and active._jsc is not None else jvm.org.apache.hadoop.conf.Configuration()
    return at.getFileSystem(conf), at


def _remove(path: str) -> None:
    """Delete a stored table, also after its session was stopped; one that can't be reached any more is left."""
    _KEPT.discard(path)
    try:
        files, at = _hadoop(path)
        files.delete(at, True)
    except (Py4JError, AttributeError, OSError):
        warnings.warn(f"{path} was not removed", stacklevel=2)


#: Paths of the tables stored inside each open ``scratch``, and of those that results read.
_SCRATCH: list[list[str]] = []
_KEPT: set[str] = set()


def release() -> None:
    """Remove the stored tables that results so far read; call it when they are consumed. The end of the driver does it as well."""
    for path in list(_KEPT):
        _remove(path)


atexit.register(release)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends there, and lost executors cost no recomputation. The table goes with its ``scratch``, by ``release``, or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    else:
        _KEPT.add(path)
    return _named(spark.read.schema(df.schema).parquet(path), path)


def _named(df: DataFrame, path: str) -> DataFrame:
    df._stored_at = path
    return df


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored inside are removed at the end, but for those given to the function that this yields: what is built from these alone may leave."""
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._stored_at)
        return df

    _SCRATCH.append([])
    try:
        yield keep
    finally:
        for path in _SCRATCH.pop():
            if path not in kept:
                _remove(path)
            elif _SCRATCH:
                _SCRATCH[-1].append(path)
            else:
                _KEPT.add(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Arrow batches of at most ``rows`` and SLICE_BYTES for what runs inside: rows that carry whole texts or sets need little memory so."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": SLICE_BYTES}
    before = {name: spark.conf.get(name, None) for name in limits}
    for name, value in limits.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def is_small(table: DataFrame) -> bool:
    """Whether the rows and bytes of a stored table stay under BROADCAST_ROWS and BROADCAST_BYTES."""
    files, at = _hadoop(table._stored_at)
    return files.getContentSummary(at).getLength() <= BROADCAST_BYTES and table.count() <= BROADCAST_ROWS


def sized(keys: DataFrame) -> DataFrame:
    """``keys``, stored, with a broadcast hint if the table is small."""
    if not hasattr(keys, "_stored_at"):
        keys = stored(keys, "keys")
    return F.broadcast(keys) if is_small(keys) else keys


def renamed(table: DataFrame, **names: str) -> DataFrame:
    """A stored table under other names (old=new), which is not stored again."""
    return _named(table.withColumnsRenamed(names), table._stored_at)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def split_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split cuts at exactly these six bytes. Null has none."""
    return text.split() if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters its argument."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` items; a shorter, non-empty sequence is one run."""
    n = len(hashes)
    width = min(width, n)
    if not n:
        return hashes
    out = hashes[: n - width + 1].copy()
    for k in range(1, width):
        out = out * _MIX + hashes[k : n - width + 1 + k]
    return mixed(out + np.uint64(width))


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_STEP = 0x9E3779B97F4A7C15
_UNSTEP = pow(_STEP, -1, 1 << 64)
#: Bytes of text whose words are hashed at once.
HASHED = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < n:  # doubling
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


@cache
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_STEP, n), _powers(_UNSTEP, n)


#: A number for each byte; A-Z have those of a-z.
_LETTERS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_LETTERS[ord("A") : ord("Z") + 1] = _LETTERS[ord("a") : ord("z") + 1]


def word_hashes(texts: list[bytes | None]) -> list[np.ndarray]:
    """Stable 64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of each text, A-Z as a-z; null has none.

    All words of a run of texts are hashed together: the sum of their letters'
    numbers, each times a power for its place, is a difference of running sums.
    """
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or b"") < HASHED):
            size += len(texts[end] or b"") + 1
            end += 1
        data = np.frombuffer(b"\n".join([*(t or b"" for t in texts[at:end]), b""]), dtype=np.uint8)
        up, down = _tables(max(HASHED, 1 << (len(data) - 1).bit_length()))
        blank = _BLANK[data]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if len(data) and not blank[0]:
            edge = np.concatenate(([0], edge))
        starts, ends = edge[0::2], edge[1::2]  # the last byte is blank
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTERS[data] * up[: len(data)], dtype=np.uint64)))
        hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        borders = np.searchsorted(starts, np.cumsum([len(t or b"") + 1 for t in texts[at:end]]))
        out += np.split(hashes, borders[:-1])
        at = end
    return out


def shingles(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Hashes of the ``width``-word runs of each text, in order; fewer words are one run, none give none."""
    return [rolling(h, width) for h in word_hashes(texts)]


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function made once in each task."""

    def run(batches):
        one = make()
        for batch in batches:
            step = max(1, min(SLICE, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
            for k in range(0, batch.num_rows, step):
                got = one(batch.slice(k, step))
                if isinstance(got, pa.RecordBatch):
                    yield got
                elif got is not None:
                    yield from got

    return df.mapInArrow(run, schema)


def least_of_component(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of the component of each) of a graph with the edges (u, v); both ends of each are nodes."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    root, a, b = np.arange(len(nodes)), ends[: len(u)], ends[len(u) :]
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))  # each root to the least that an edge leads to, then all to their roots
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[root]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u, v): (node, component), stored, the component being its smallest node.

    A table of edges that is small enough to be broadcast is read by one task: rounds
    of joins cost the driver memory for the plans and exchanges of each. A larger one
    alternates the large-star and small-star steps of Kiveris et al. until the edges
    are stars. Each step is a minimum with map-side combine and a join that adaptive
    execution can split; no neighbour list is collected. Loops and null ends are
    ignored; nodes without an edge are absent.
    """

    def at_once(batches):
        held = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if held:
            got = least_of_component(*(pa.concat_tables(held).column(k).to_numpy() for k in ("u", "v")))
            for k in range(0, len(got[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 50_000]) for x in got], names=["node", "component"])

    with scratch(edges.sparkSession) as keep:
        edges = edges if hasattr(edges, "_stored_at") else stored(edges, "edges")
        if is_small(edges):
            return keep(stored(edges.where("u != v").select("u", "v").coalesce(1).mapInArrow(at_once, "node bigint, component bigint"), "components"))
        now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
        mark = None
        while True:
            both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v").distinct()
            now = stored(small, "edges")
            got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first()
            if got == mark:
                break
            mark = got
        found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        return keep(stored(found, "components"))
