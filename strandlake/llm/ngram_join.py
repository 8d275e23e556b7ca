"""N-gram Jaccard join: blocked sparse product of the document by shingle incidence matrix with itself.

Rows of the matrix are the distinct shingle sets, columns the shingles. Column
blocks are multiplied first over each row's size-derived prefix: a task holds a
block of columns and accumulates common counts of row pairs, blocks are summed,
and pairs below the bound that their sizes set are discarded. The products of the
pairs that are left are completed over all columns, in blocks of rows. Columns with many rows
are not multiplied with themselves: their rows are held against the column's first
row, and what that leaves apart is paired by sizes and marks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import SLICE, as_bytes, components, map_arrow, renamed, scratch, shingles, sized, small_batches, stored

WIDTH = 5
#: Two sets link when NUM / DEN <= intersection / union.
NUM, DEN = 75, 100
#: Shingles known as frequent: they come last in the order of prefixes. Only speed depends on them.
HEAVY = 200_000
#: Shingles that a task counts at once to find frequent ones.
COUNTED = 8_000_000
#: Rows of one column up to which all its pairs are counted.
LIST = 128
#: Rows of a long column that one copy of those outside its main component meets, and of the latter at once.
BLOCK, PART = 2048, 256
#: Partners in a block of the second product, and their items that a task holds.
PARTNERS, HELD = 256, 1_000_000
#: Words of 64 marks of a set by which pairs are sifted in a join; marks by which rows of long columns are held against each other.
MARKS, MANY_MARKS = 8, 4096
#: Partners, of those whose marks allow most, that a row is multiplied with in each of so many rounds; what these leave apart is multiplied in full.
BEST, ROUNDS = 3, 2


def shingle_sets(texts: list[bytes | None], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``width``-word runs of each text; fewer words are one run, none give an empty set."""
    return [np.unique(x) for x in shingles(texts, width)]


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> tuple[int, int]:
    """(p, m): sets of which one has ``n`` items and that reach the threshold share m of the first p items of each."""
    least = -(-num * n // den)
    m = min(1 + n // 20, least)
    return n - least + m, m


def heavy_shingles(rows: DataFrame, width: int, limit: int) -> np.ndarray:
    """The most frequent shingles among those met twice in a task's share, rarest first. They only set an order, so a bound on their number loses nothing."""

    def run(batches):
        held, total = [], 0

        def flush():
            shingles, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= 2
            yield pa.RecordBatch.from_arrays([pa.array(shingles[often].view(np.int64)), pa.array(n[often])], names=["h", "n"])

        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                held += shingle_sets(as_bytes(batch.column("text").slice(k, SLICE)), width)
                total = sum(map(len, held))
                if total >= COUNTED:
                    yield from flush()
                    held, total = [], 0
        if held:
            yield from flush()

    found = rows.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(limit)
    return found.select("h").toArrow().column("h").to_numpy().view(np.uint64)[::-1]


def marks(s: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of the ``bits`` that the items of a set put on."""
    put = np.zeros(bits, dtype=bool)
    put[s & np.uint64(bits - 1)] = True
    return np.packbits(put)


SIGNATURES = "id bigint, n bigint, th bigint, node bigint, light array<bigint>, heavy array<bigint>, marks binary, " + ", ".join(f"b{k} bigint" for k in range(MARKS))


def signatures(rows: DataFrame, heavy: np.ndarray, width: int, num: int, den: int) -> DataFrame:
    """id, n, th (hash of the text), node (hash of the set, null if empty), the shingles of its prefix, light and heavy, and its marks."""
    by_value = np.argsort(heavy)
    held = rows.sparkSession.sparkContext.broadcast((heavy[by_value], by_value.astype(np.uint64)))

    def make():
        values, ranks = held.value

        def prefix(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            p, _ = prefix_length(len(s), num, den)
            order = s >> np.uint64(1)
            if len(values):
                at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                known = values[at] == s
                order[known] = np.uint64(1 << 63) + ranks[at[known]]
            first = np.argpartition(order, p - 1)[:p] if p < len(s) else np.arange(len(s))
            often = order[first] >= np.uint64(1 << 63)
            return s[first[~often]].view(np.int64), s[first[often]].view(np.int64)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(as_bytes(batch.column("text")), width)
            parts = [prefix(s) if len(s) else (s.view(np.int64), s.view(np.int64)) for s in sets]
            put = np.stack([marks(s, 64 * MARKS).view(np.int64) for s in sets])
            columns = {"id": batch.column("id"), "n": pa.array([len(s) for s in sets], pa.int64())}
            columns["th"] = batch.column("th")
            columns["node"] = pa.array([signed(xxhash.xxh3_64_intdigest(s.tobytes())) if len(s) else None for s in sets], pa.int64())
            columns |= {name: _lists([p[k] for p in parts]) for k, name in enumerate(("light", "heavy"))}
            columns["marks"] = pa.array([marks(s, MANY_MARKS).tobytes() for s in sets], pa.binary())
            return pa.RecordBatch.from_pydict(columns | {f"b{k}": pa.array(put[:, k]) for k in range(MARKS)})

        return one

    return map_arrow(rows, make, SIGNATURES)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64()))


def sizes_fit(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Sizes that can reach the threshold."""
    return num * np.maximum(a, b) <= den * np.minimum(a, b)


def block_product(h: np.ndarray, node: np.ndarray, n: np.ndarray, most: int, num: int, den: int) -> tuple[np.ndarray, ...]:
    """Product of a block of columns, given by their non-zeros: (u, v, least size, common) of row pairs in it; a column of more than ``most`` rows gives its first row with each other, common -1."""
    order = np.lexsort((node, h))
    h, node, n = h[order], node[order], n[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
    h, node, n = h[fresh], node[fresh], n[fresh]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(h)))
    start, size = np.repeat(first, size), np.repeat(size, size)
    rows = np.flatnonzero((size > 1) & (size <= most))
    left, right = [], []
    ends = start + size
    step = 1
    while len(rows := rows[rows + step < ends[rows]]):
        fit = rows[sizes_fit(n[rows], n[rows + step], num, den)]
        left.append(fit)
        right.append(fit + step)
        step += 1
    left = np.concatenate(left) if left else np.empty(0, np.int64)
    right = np.concatenate(right) if right else np.empty(0, np.int64)
    order = np.lexsort((node[right], node[left]))
    left, right = left[order], right[order]
    new = np.ones(len(left), dtype=bool)
    new[1:] = (node[left[1:]] != node[left[:-1]]) | (node[right[1:]] != node[right[:-1]])
    at = np.flatnonzero(new)
    common = np.diff(np.append(at, len(left)))
    a, b = left[at], right[at]
    long = np.flatnonzero((size > most) & (start != np.arange(len(h))))
    return tuple(np.concatenate(x) for x in ((node[a], node[start[long]]), (node[b], node[long]), (np.minimum(n[a], n[b]), n[long]), (common, np.full(len(long), -1))))


def _left_of(p: str, q: str) -> Column:
    """Bound of the items of row p that q has too: each mark that p has alone stands for an item that it has alone."""
    alone = sum((F.bit_count(F.col(f"{p}.b{k}").bitwiseAND(F.bitwise_not(F.col(f"{q}.b{k}")))) for k in range(MARKS)), F.lit(0))
    return F.col(f"{p}.n") - alone


def most_common() -> Column:
    """Bound of the items that rows x and y (n, marks) share."""
    return F.least(_left_of("x", "y"), _left_of("y", "x"))


def marks_allow(num: int, den: int) -> Column:
    """Whether rows x and y can link, by their sizes and the marks of x: den * common >= num * (n + m - common). Kept short, so that it is compiled."""
    n, m = F.col("x.n"), F.col("y.n")
    return (num * n <= den * m) & (num * m <= den * n) & ((den + num) * _left_of("x", "y") >= num * (n + m))


def crossing_pairs(dealt: DataFrame, best: int | None, num: int, den: int) -> DataFrame:
    """u, v, most: rows of different components in a block of a long column that may link by their sizes and marks, most bounding what they share; with ``best``, so many for each row that asks.

    ``dealt``: u, block, asks, v, inside (its component), n, marks, sorted; rows that
    ask are those outside the main component, and meet all of the block. Common
    marks are a product of the bits; marks that a row has alone stand for items
    that it has alone.
    """

    def run(batches):
        key, rows = None, []

        def meet():
            ask, names, inside, n, bits = (np.array(c) for c in zip(*((r[0], r[1], r[2], r[3], k) for k, r in enumerate(rows)), strict=True))
            put = np.unpackbits(np.frombuffer(b"".join(r[4] for r in rows), dtype=np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32)
            total = put.sum(axis=1)
            asking, others = np.flatnonzero(ask), np.flatnonzero(~ask)
            for part in (asking[k : k + PART] for k in range(0, len(asking), PART)):
                common = put[part] @ put[others].T
                a, b = n[part][:, None], n[others][None, :]
                most = np.minimum(a - (total[part][:, None] - common), b - (total[others][None, :] - common))
                good = sizes_fit(a, b, num, den) & ((den + num) * most >= num * (a + b)) & (inside[part][:, None] != inside[others][None, :])
                i, j = np.nonzero(good)
                value = most[i, j].astype(np.int64)
                if best is not None and len(i):
                    order = np.lexsort((names[others[j]], -value, i))
                    i, j, value = i[order], j[order], value[order]
                    first = np.searchsorted(i, i, side="left")
                    keep = np.arange(len(i)) - first < best
                    i, j, value = i[keep], j[keep], value[keep]
                if len(i):
                    one, two = names[part[i]], names[others[j]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(value)], names=["u", "v", "most"])

        for batch in batches:
            for u, block, *row in zip(*(batch.column(c).to_pylist() for c in ("u", "block", "asks", "v", "inside", "n", "marks")), strict=True):
                if key != (u, block):
                    if rows:
                        yield from meet()
                    key, rows = (u, block), []
                rows.append(row)
        if rows:
            yield from meet()

    return dealt.mapInArrow(run, "u bigint, v bigint, most bigint")


def row_products(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """Links (u, v) of blocks of rows; ``blocks``: u, salt, v, s, sorted: the set of u (v null), then those of its partners."""

    def run(batches):
        key, one, names, others, held, out = None, None, [], [], 0, []

        def multiply():
            nonlocal held
            if others and one is not None:
                sizes = np.array([len(s) for s in others])
                rest = np.concatenate(others)
                equal = one[np.minimum(np.searchsorted(one, rest), len(one) - 1)] == rest
                overlap = np.add.reduceat(equal, np.concatenate(([0], np.cumsum(sizes)[:-1])), dtype=np.int64)
                good = den * overlap >= num * (len(one) + sizes - overlap)
                out.extend((key[0], names[k]) for k in np.flatnonzero(good))
            names.clear(), others.clear()
            held = 0

        for batch in batches:
            for u, salt, v, s in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if key != (u, salt):
                    multiply()
                    key, one = (u, salt), None
                if v is None:
                    one = np.frombuffer(s, dtype=np.uint64)
                else:
                    names.append(v)
                    others.append(np.frombuffer(s, dtype=np.uint64))
                    held += len(others[-1])
                    if held > HELD:
                        multiply()
            if len(out) > 10_000:
                yield _pairs(out)
        multiply()
        if out:
            yield _pairs(out)

    return blocks.mapInArrow(run, "u bigint, v bigint")


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*out, strict=True)
    out.clear()
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def ngram_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id for each row.

    Words are lower-cased (A-Z); a document's set is its distinct ``width``-word
    shingles, or all its words where they are fewer; documents link when
    den * intersection >= num * union. component_id is the smallest id reachable.
    Null, empty and blank texts have an empty set and stand alone, as do rows
    with a null id without an equal set. Rows that repeat an id are answered one
    by one. An empty table gives no rows; other columns are not read. Ids are
    numbers, or text that casts to one. No link between different components is
    lost: rows with equal sets are one node, nodes that link share a known number
    of items in their prefixes, and pairs are left out only if a bound says so, or
    if links found before join them.
    """
    with scratch(docs.sparkSession) as keep:
        rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
        sigs = stored(signatures(rows, heavy_shingles(rows, width, HEAVY), width, num, den), "signatures")
        traits = ["n", *(f"b{k}" for k in range(MARKS))]
        whole = sigs.where("node is not null")
        nodes = stored(whole.groupBy("node").agg(F.min("id").alias("rep"), F.min(F.struct("th", "id")).alias("first"), *(F.min(c).alias(c) for c in traits)), "nodes")

        # the product over prefixes, in blocks of columns
        def product(batches):
            held = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
            if held:
                got = block_product(*(pa.concat_tables(held).column(k).to_numpy() for k in ("h", "node", "n")), LIST, num, den)
                for k in range(0, len(got[0]), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 50_000]) for x in got], names=["u", "v", "n", "common"])

        blocks = whole.select(F.explode("light").alias("h"), "node", "n").repartition("h")
        partial = blocks.mapInArrow(product, "u bigint, v bigint, n bigint, common bigint").groupBy("u", "v").agg(F.min("common").alias("least"), F.sum("common").alias("common"), F.min("n").alias("n"))
        enough = F.least(1 + F.floor(F.col("n") / 20), F.ceil(F.col("n") * num / den))
        partial = stored(partial.where((F.col("least") < 0) | (F.col("common") >= enough)).select("u", "v", (F.col("least") < 0).alias("star")), "pairs")
        often = whole.select(F.explode("heavy").alias("h"), "node").distinct()
        heads = often.groupBy("h").agg(F.min("node").alias("u"))
        stars = often.join(sized(heads), "h").where("node != u").select("u", F.col("node").alias("v"))
        stars = stored(partial.where("star").select("u", "v").union(stars).distinct(), "stars")
        candidates = stored(partial.where("not star").select("u", "v").union(stars).distinct(), "candidates")

        def linked(pairs: DataFrame) -> DataFrame:
            """The pairs that link: the product over all columns, in blocks of a row and its partners."""

            def make():
                def one(batch: pa.RecordBatch) -> pa.RecordBatch:
                    texts = dict(zip(batch.column("node").to_pylist(), as_bytes(batch.column("text")), strict=True))
                    sets = [s.tobytes() for s in shingle_sets(list(texts.values()), width)]
                    return pa.RecordBatch.from_arrays([pa.array(texts, pa.int64()), pa.array(sets, pa.binary())], names=["node", "s"])

                return one

            pairs = stored(pairs, "asked")
            salts = pairs.groupBy("u").agg(F.ceil(F.count("*") / PARTNERS).alias("salts"))
            wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
            sources = stored(nodes.join(sized(wanted), "node", "left_semi").select("node", F.col("first.th").alias("of_th"), F.col("first.id").alias("of")), "sources")
            found = rows.join(sized(sources), (F.col("th") == F.col("of_th")) & F.col("id").eqNullSafe(F.col("of"))).select("node", "text")
            sets = stored(map_arrow(found, make, "node bigint, s binary").dropDuplicates(["node"]), "sets")
            leads = salts.select("u", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt")).withColumn("v", F.lit(None).cast("bigint")).withColumn("node", F.col("u"))
            partners = pairs.join(sized(salts), "u").select("u", F.pmod(F.xxhash64("v"), F.col("salts")).alias("salt"), "v", F.col("v").alias("node"))
            dealt = sets.join(sized(leads.union(partners)), "node").select("u", "salt", "v", "s").repartition("u", "salt").sortWithinPartitions("u", "salt", F.asc_nulls_first("v"))
            return row_products(dealt, num, den)

        with small_batches(docs.sparkSession):
            # at first each row with the smallest of its partners: most links lie within what these join
            chains = stored(candidates.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), "chains")
            links = stored(linked(chains), "links")
            joined = components(links)

            def placed(df: DataFrame, name: str) -> DataFrame:
                """``df`` with the component of its node ``name`` so far."""
                found = sized(renamed(joined, node=name, component=f"{name}_in"))
                return df.join(found, name, "left").withColumn(f"{name}_in", F.coalesce(f"{name}_in", name))

            described = nodes.select("node", F.struct(*traits).alias("t"))

            def apart(best: int | None) -> DataFrame:
                """u, v, most: pairs of different components that may link and were not multiplied so far; most bounds what they share."""
                both = placed(placed(candidates, "u"), "v").where("u_in != v_in").select("u", "v")
                both = both.join(described.withColumnsRenamed({"node": "u", "t": "x"}), "u").join(described.withColumnsRenamed({"node": "v", "t": "y"}), "v")
                met = both.where(marks_allow(num, den)).select("u", "v", most_common().alias("most"))
                # long columns: rows outside the first row's component with all rows of other components
                members = placed(placed(stars.union(stars.select("u", F.col("u").alias("v"))).distinct(), "u"), "v")
                open_heads = members.groupBy("u").agg(F.min("v_in").alias("a"), F.max("v_in").alias("b"), F.ceil(F.count("*") / BLOCK).alias("blocks")).where("a != b").select("u", "blocks")
                members = stored(members.join(sized(open_heads), "u"), "members")
                described_in_full = whole.select("node", "n", "marks").join(sized(members.select(F.col("v").alias("node")).distinct()), "node", "left_semi").dropDuplicates(["node"]).withColumnRenamed("node", "v")
                members = members.join(described_in_full, "v")
                columns = ("v", F.col("v_in").alias("inside"), "n", "marks")
                x = members.where("v_in != u_in").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select("u", "block", F.lit(True).alias("asks"), *columns)
                y = members.withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks"))).select("u", "block", F.lit(False).alias("asks"), *columns)
                dealt = x.union(y).repartition("u", "block").sortWithinPartitions("u", "block")
                crossing = crossing_pairs(dealt, best, num, den)
                return met.union(crossing).groupBy("u", "v").agg(F.max("most").alias("most")).join(asked, ["u", "v"], "left_anti")

            asked = chains
            for k in range(ROUNDS + 1):
                pairs = apart(BEST if k < ROUNDS else None)
                if k < ROUNDS:  # links join rows fast, so that few pairs are left to be multiplied in full
                    by_most = Window.partitionBy("v").orderBy(F.desc("most"), "u")
                    pairs = pairs.withColumn("place", F.row_number().over(by_most)).where(F.col("place") <= BEST)
                pairs = stored(pairs.select("u", "v"), "pairs")
                if pairs.isEmpty():
                    break
                links = stored(links.union(linked(pairs)), "links")
                joined = components(links)
                asked = asked.union(pairs)
        members = nodes.select("node", "rep").join(sized(joined), "node", "left")
        least = members.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
        named = members.withColumn("component", F.coalesce("component", "node")).join(sized(least), "component", "left")
        named = keep(stored(named.select("node", F.coalesce("least", "rep").alias("least")), "named"))
        keep(sigs)
    return sigs.select("id", "n", "node").join(sized(named), "node", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the document of the smallest id of each component; rows that repeat an id stay or go together, rows without an id stay."""
    with scratch(docs.sparkSession) as keep:
        gone = keep(stored(ngram_components(docs, id_col=id_col, text_col=text_col).where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone"))
    return docs.join(sized(gone), F.col(id_col).cast("bigint") == F.col("__gone"), "left_anti").select(docs.columns)
