"""Substring dedup: compact windows of token min-hashes, joined across hash functions and verified."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import SLICE, as_bytes, map_arrow, mixed, rolling, scratch, shingles, sized, small_batches, stored

#: Words of a token, and of the shortest passage; hash functions, and how many must agree; similarity.
WIDTH, WORDS, FUNCTIONS, AGREE, SIMILARITY = 5, 50, 5, 2, 0.75
#: Occurrences in a list up to which all are paired. In longer lists those with the same words to both sides form a class and meet its first; the classes meet the first with their words to the right, the first with those to the left, and so many of the list's firsts. In all of these each passage within meets the first that has the whole of it.
LIST, HEADS = 16, 1
#: Pairs whose windows are compared at once, about how many rows of lists candidates are taken from at once, and places of lists that are compared at once, if they are short.
COUNTED, GATHERED, TOGETHER = 256, 1 << 16, 1 << 11
#: Tokens of lists, times rows, for which bits are looked up at once.
TABLE = 1 << 20
#: Tokens to each side that stand for those words: a passage has so many on one side of any of its tokens.
REACH = 16
#: In place of a function, for pairs of equal runs of words.
WHOLE = 15
#: Partners of a leading document that one task verifies.
PARTNERS = 256

_SEEDS = mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def ranks(tokens: np.ndarray, seed: np.uint64) -> np.ndarray:
    """Hashes of a function, made distinct: equal ones are told apart at random, so that the tree of a repetitive text stays shallow."""
    low = np.uint64((1 << 20) - 1)
    return (mixed(tokens ^ seed) & ~low) | (mixed(np.arange(len(tokens), dtype=np.uint64)) & low)


def least_places(rank: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(first, last, c): the runs of ``least`` tokens of texts that begin at ``first`` to ``last`` have their least rank at c, for each such c."""
    if len(rank) < least:
        return (np.empty(0, np.int64),) * 3
    low, width = rank, 1
    while 2 * width <= least:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    if width < least:
        low = np.minimum(low[: len(rank) - least + 1], low[least - width : len(rank) - width + 1])
    inside = np.zeros(len(rank) + 1, dtype=np.int64)  # runs that lie in one text
    enough = ends - starts >= least
    np.add.at(inside, starts[enough], 1)
    np.add.at(inside, ends[enough] - least + 1, -1)
    at = np.flatnonzero(np.cumsum(inside)[: len(low)] > 0)
    if not len(at):
        return (np.empty(0, np.int64),) * 3
    new = np.ones(len(at), dtype=bool)
    new[1:] = (low[at[1:]] != low[at[:-1]]) | (at[1:] != at[:-1] + 1)
    first = at[new]
    last = np.append(at[np.flatnonzero(new)[1:] - 1], at[-1])
    c = first + least - 1  # a lesser token has come in at the end, or the least has gone out and another is to be found
    found = rank[c] != low[first]
    gone = np.flatnonzero(found)
    for k in range(0, len(gone), 100_000):
        part = first[gone[k : k + 100_000]]
        c[gone[k : k + 100_000]] = part + rank[part[:, None] + np.arange(least)].argmin(axis=1)
    return first, last, c


def nearest_lesser(value: np.ndarray, edge: np.ndarray, step: int) -> np.ndarray:
    """Of each place, the nearest one behind (step 1) that is less, or before (-1) that isn't more; its ``edge``, the first beyond its text, if none is. A place that can't be it is left for where it looks itself, since all between are out too."""
    active = np.arange(len(value))
    at = active + step
    while len(active := active[at[active] != edge[active]]):
        other, own = value[at[active]], value[active]
        active = active[other > own if step < 0 else other >= own]
        at[active] = at[at[active]]
    return at


def compact_windows(rank: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(l, c, r, number of the text): all runs that begin in l..c and end in c..r have their least rank at c.

    These are the nodes of the Cartesian trees of the texts whose subtrees hold at
    least ``least`` tokens: the places that are least in some run of ``least``
    tokens. A node's subtree ends at the nearest lesser tokens; one that is farther
    than a run is a node too, so it is looked for among the nodes.
    """
    first, last, c = least_places(rank, starts, ends, least)
    doc = np.searchsorted(starts, c, side="right") - 1
    while len(c) and (empty := starts[doc] == ends[doc]).any():  # texts without tokens share their start with the next
        doc = doc - empty
    l, r = first.copy(), last + least - 1
    far_left, far_right = np.flatnonzero((first == c - least + 1) & (first > starts[doc])), np.flatnonzero((last == c) & (r < ends[doc] - 1))
    begin, end = _ends(doc)
    before, behind = nearest_lesser(rank[c], begin - 1, -1)[far_left], nearest_lesser(rank[c], end, 1)[far_right]
    l[far_left] = np.where(before < begin[far_left], starts[doc[far_left]], c[before] + 1)
    r[far_right] = np.where(behind == end[far_right], ends[doc[far_right]], c[np.minimum(behind, len(c) - 1)]) - 1
    return l, c, r, doc


def sides(tokens: np.ndarray, c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two 32-bit hashes in one: of the words from token c to c + REACH, and from c - REACH to c; 0 where the text, start to end, is shorter."""
    out = []
    for step in (1, -1):
        inside = (c + step * REACH >= start) & (c + step * REACH < end)
        at, h = c[inside], np.zeros(int(inside.sum()), dtype=np.uint64)
        for k in range(0, REACH + 1, WIDTH - 1):
            h = mixed(h + tokens[at + step * k])
        side = np.zeros(len(c), dtype=np.uint64)
        side[inside] = h % np.uint64(0xFFFFFFFF) + np.uint64(1)
        out.append(side)
    return ((out[0] << np.uint64(32)) | out[1]).view(np.int64)


def tokens_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of texts, one behind the other, and where each text starts and ends."""
    found = shingles(texts, WIDTH)
    ends = np.cumsum([len(t) for t in found], dtype=np.int64)
    return np.concatenate(found), np.concatenate(([0], ends[:-1])), ends


def windows_of(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, f: int, least: int) -> tuple[np.ndarray, ...]:
    """l, c, r, number of the text and key of the windows of function ``f``."""
    l, c, r, doc = compact_windows(ranks(tokens, _SEEDS[f]), starts, ends, least)
    return l, c, r, doc, ((mixed(tokens[c] ^ _SEEDS[f]) & ~np.uint64(15)) | np.uint64(f)).view(np.int64)


def window_rows(rows: DataFrame, words: int, functions: int) -> DataFrame:
    """key (function and least hash), id, place (token c), reach (to both sides) and side (words around c) of each window."""
    least = words - WIDTH + 1

    def make():
        def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            tokens, starts, ends = tokens_of(as_bytes(batch.column("text")))
            ids = batch.column("id").to_numpy()
            for f in range(functions):
                l, c, r, doc, key = windows_of(tokens, starts, ends, f, least)
                start, end = starts[doc], ends[doc]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, ids[doc], c - start, ((c - l) << 32) | (r - c), sides(tokens, c, start, end))], names=["key", "id", "place", "reach", "side"])

        return one

    return map_arrow(rows, make, "key bigint, id bigint, place bigint, reach bigint, side bigint")


def span_rows(docs: DataFrame, words: int) -> DataFrame:
    """key, id, first and spans of windows of function 0 (at: key, place, reach): the hashes of its runs of ``words`` words around c, the first of which begins at token ``first``. Each run of a text belongs to one window."""
    least = words - WIDTH + 1

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            tokens, starts, _ = tokens_of(as_bytes(batch.column("text")))
            at, n = batch.column("at"), batch.column("at").value_lengths().to_numpy()
            key, place, reach = (at.flatten().field(k).to_numpy() for k in ("key", "place", "reach"))
            base = np.repeat(starts, n)
            l, c, r = base + place - (reach >> 32), base + place, base + place + (reach & 0xFFFFFFFF)
            first = np.maximum(l, c - least + 1)
            many = np.minimum(c, r - least + 1) - first + 1
            to = np.cumsum(many)
            inside = np.repeat(first - (to - many), many) + np.arange(to[-1])
            spans = pa.ListArray.from_arrays(pa.array(np.append(0, to), pa.int32()), pa.array(rolling(tokens, least)[inside].view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(batch.column("id").to_numpy(), n)), pa.array(first - base), spans], names=["key", "id", "first", "spans"])

        return one

    return map_arrow(docs, make, "key bigint, id bigint, first bigint, spans array<bigint>")


def span_pairs(ids: np.ndarray, first: np.ndarray, n: np.ndarray, spans: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """As listed_pairs, from windows with ``n`` spans each: each run of words with the first equal one (by id and place), once for a window, its partner and how far they are apart. All are sure."""
    window = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(spans)) - np.repeat(np.cumsum(n) - n, n) + first[window]
    order = np.lexsort((at, ids[window], spans))
    spans, window, at = spans[order], window[order], at[order]
    new = np.ones(len(spans), dtype=bool)
    new[1:] = spans[1:] != spans[:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(spans)), 0)) if len(spans) else order
    rest = np.flatnonzero(~new)
    rest = rest[np.lexsort((at[rest], at[rest] - at[lead[rest]], window[lead[rest]], window[rest]))]
    marks = np.stack((window[rest], window[lead[rest]], at[rest] - at[lead[rest]]))
    fresh = np.ones(len(rest), dtype=bool)
    fresh[1:] = (marks[:, 1:] != marks[:, :-1]).any(axis=0)
    rest = rest[fresh]
    one = lead[rest]
    reach = np.full(len(rest), least - 1)
    return ids[window[one]], ids[window[rest]], (at[one] << 32) | at[rest], reach, reach, np.full(len(rest), 2 * WHOLE + 1)


def _all_pairs(rows: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within runs of ``rows``: each with those behind it, up to where its run ends (``end``)."""
    left, right, at, step = [], [], np.arange(len(rows)), 1
    while len(at := at[at + step < end[at]]):
        left.append(rows[at])
        right.append(rows[at + step])
        step += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def _ends(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted ``marks``: where each one's run of equal marks starts and ends."""
    first = np.flatnonzero(np.concatenate(([True], marks[1:] != marks[:-1]))) if len(marks) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(marks)))
    return np.repeat(first, size), np.repeat(first + size, size)


def classes_of(key: np.ndarray, side: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``rows`` with equal keys and words to both sides: the first of each class, and the first and each other member."""
    by_class = rows[np.lexsort((rows, side[rows], key[rows]))]
    new = np.ones(len(by_class), dtype=bool)
    new[1:] = (key[by_class[1:]] != key[by_class[:-1]]) | (side[by_class[1:]] != side[by_class[:-1]])
    first = by_class[np.maximum.accumulate(np.where(new, np.arange(len(by_class)), 0))]
    return np.sort(by_class[new]), first[~new], by_class[~new]


def met(left: np.ndarray, right: np.ndarray, key: np.ndarray, ids: np.ndarray, place: np.ndarray, reach: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, ...]:
    """(u, v, places, reach of u, reach of v, code) of pairs of rows; places holds those of u and v in its halves, code the function and, as its last bit, whether they share the words at one side."""
    differ = side[left] ^ side[right]
    same = (differ >> 32 == 0) & (side[left] >> 32 != 0) | (differ & 0xFFFFFFFF == 0) & (side[left] & 0xFFFFFFFF != 0)
    return ids[left], ids[right], (place[left] << 32) | place[right], reach[left], reach[right], 2 * (key[left] & 15) + same


def listed_pairs(key: np.ndarray, ids: np.ndarray, place: np.ndarray, reach: np.ndarray, side: np.ndarray, most: int, heads: int) -> tuple[tuple[np.ndarray, ...], ...]:
    """The meetings (see ``met``) of lists of equal keys, u the smaller id (or the earlier place), and the rows of long lists."""
    order = np.lexsort((place, ids, key))
    key, ids, place, reach, side = columns = tuple(x[order] for x in (key, ids, place, reach, side))
    start, end = _ends(key)
    short = end - start <= most
    pairs = [_all_pairs(np.flatnonzero(short), (np.cumsum(short) + end - np.arange(len(key)) - 1)[short])]
    firsts, first, member = classes_of(key, side, np.flatnonzero(~short))
    pairs.append((first, member))
    for half in ((side >> 32) & 0xFFFFFFFF, side & 0xFFFFFFFF):
        mine = firsts[half[firsts] != 0]
        mine = mine[np.lexsort((mine, half[mine], key[mine]))]
        new = np.ones(len(mine), dtype=bool)
        new[1:] = (key[mine[1:]] != key[mine[:-1]]) | (half[mine[1:]] != half[mine[:-1]])
        lead = mine[np.maximum.accumulate(np.where(new, np.arange(len(mine)), 0))] if len(mine) else mine
        pairs.append((lead[~new], mine[~new]))
    begin, _ = _ends(key[firsts])
    for k in range(heads):  # near copies, whose words differ at both sides
        behind = np.flatnonzero(np.arange(len(firsts)) - begin > k)
        pairs.append((firsts[begin[behind] + k], firsts[behind]))
    left, right = (np.concatenate(x) for x in zip(*pairs, strict=True))
    return met(left, right, *columns), tuple(x[~short] for x in columns)


#: Bits of a word of 64 below each place.
_BELOW = np.array([(1 << k) - 1 for k in range(65)], dtype=np.uint64)


def bits_from_to(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``n`` words of 64 bits, of which those from ``low`` to ``high`` are set."""
    first = 64 * np.arange(n)
    return _BELOW[np.clip(high[:, None] + 1 - first, 0, 64)] & ~_BELOW[np.clip(low[:, None] - first, 0, 64)]


def bit_sums(bits: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """How often each bit is set in the runs of rows that begin at ``starts``, which have ``most`` rows at most."""
    each = np.unpackbits(bits.astype("<u8", copy=False).view(np.uint8), axis=-1, bitorder="little")
    return np.add.reduceat(each, starts, dtype=np.uint8 if most < 256 else np.int32).astype(np.int32)


class Groups:
    """Rows that links connect, and the links that connected them."""

    def __init__(self, n: int):
        self.of, self.members = np.arange(n), {k: [k] for k in range(n)}
        self.left, self.right = [], []

    def link(self, i: int, j: int) -> None:
        """Connect rows j and i, which aren't yet."""
        self.left.append(j)
        self.right.append(i)
        small, large = sorted((self.of[i], self.of[j]), key=lambda g: len(self.members[g]))
        self.of[self.members[small]] = large
        self.members[large] += self.members.pop(small)


def windows_alike(both: np.ndarray, one: np.ndarray, other: np.ndarray, similarity: float) -> np.ndarray:
    """Whether any window of a pair is similar: ``both`` has the bits of its common tokens (tokens, pairs, words), ``one`` and ``other`` the different tokens of each window."""
    each = np.unpackbits(both.astype("<u8", copy=False).view(np.uint8), axis=-1, bitorder="little")
    common = np.add.reduce(each, axis=0, dtype=np.uint8 if len(both) < 256 else np.int32).astype(np.int32)  # sums over the first axis are by far the fastest
    return (common / np.maximum(one + other - common, 1) >= similarity).any(axis=1)


def tokens_inside(rows: np.ndarray, tokens: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Different tokens of each window of the rows, which come in order: ``low`` to ``high`` are the windows that hold a token. ``n``: words of 64 windows."""
    order = np.lexsort((tokens, rows))
    rows, tokens, low, high = (x[order] for x in (rows, tokens, low, high))
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (tokens[1:] != tokens[:-1])
    bits, ends = np.bitwise_or.reduceat(bits_from_to(low, high, n), np.flatnonzero(new)), _ends(rows[new])[1]
    ends = ends[np.flatnonzero(np.append(ends[1:] != ends[:-1], True))]
    starts = np.append(0, ends[:-1])
    blocks = [(starts[k], starts[k : k + COUNTED] - starts[k], ends[min(k + COUNTED, len(ends)) - 1]) for k in range(0, len(ends), COUNTED)]
    return np.concatenate([bit_sums(bits[k:end], at, int((ends - starts).max())) for k, at, end in blocks])


def near_pairs(regions: list[np.ndarray], centres: np.ndarray, ids: np.ndarray, places: np.ndarray, least: int, similarity: float, lists: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (earlier, later) of surroundings, tokens around ``centres``, that hold a similar window of ``least`` tokens around both: so many that all which are similar, directly or by others, are connected.

    ``lists``: numbers of the lists they are in, from 0 and in order; only those of
    one list are compared, and many short lists cost as much as one. Candidates are
    all that share a token among the rarest of each, so many as a similar window
    can't avoid; their common tokens are counted, and all windows compared, unless
    both are connected already. None is left out. First each is held against the
    nearest that has one of these tokens too: that connects most copies, so that few
    candidates are left. Each token has a bit for each window around the centre that
    holds it, so the windows of many pairs are compared at once. ``ids`` and
    ``places`` tell which lie in one text: those less than ``least`` apart don't count.
    """
    n, words = len(regions), (least + 63) // 64
    lists = np.zeros(n, dtype=np.int64) if lists is None else lists
    size = np.array([len(x) for x in regions])
    rows = np.repeat(np.arange(n), size)
    tokens = (lists[rows] << 32).astype(np.uint64) | np.concatenate(regions)
    begin = np.cumsum(size) - size

    def spans(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows that hold tokens, first and last."""
        row = rows[entries]
        at = entries - (begin + centres)[row]
        return np.maximum(np.maximum(at, 0), least - 1 - centres[row]), np.minimum(np.minimum(at, 0) + least, (size - centres)[row]) - 1

    # codes of the tokens that come more than once: by list, in the order of rarity
    order = np.argsort(tokens)
    of = tokens[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = of[1:] != of[:-1]
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(of)))
    often = np.repeat(count > 1, count)
    of, count = (of[start[count > 1]] >> np.uint64(32)).astype(np.int64), count[count > 1]
    by_rarity = np.lexsort((count, of))
    base = np.searchsorted(of[by_rarity], np.arange(int(lists[-1]) + 2))
    code = np.empty(len(of), dtype=np.int64)
    code[by_rarity] = np.arange(len(of))
    often, at = order[often], np.repeat(code, count)
    del order, new, start
    order = np.argsort(rows[often] << 32 | at)
    often, at = often[order], at[order]
    mine = rows[often]
    new = np.ones(len(mine), dtype=bool)
    new[1:] = (mine[1:] != mine[:-1]) | (at[1:] != at[:-1])
    plain = np.ones(n, dtype=bool)  # all tokens are different
    plain[mine[~new]] = False
    window = np.arange(64 * words)
    inside = least * ((window >= (least - 1 - centres)[:, None]) & (window < np.minimum(size - centres, least)[:, None])).astype(np.int32)  # different tokens of each window
    if not plain.all():
        part = np.flatnonzero(~plain[rows])
        inside[~plain] = tokens_inside(rows[part], tokens[part], *spans(part), words)
    bits = np.bitwise_or.reduceat(bits_from_to(*spans(often), words), np.flatnonzero(new)) if len(mine) else np.empty((0, words), dtype=np.uint64)
    del tokens, often, order
    rows, at = mine[new], at[new]
    del mine, new
    others_too = np.bincount(at)[at] > 1
    rows, at, bits = rows[others_too], at[others_too], bits[others_too]
    # a window shares at least so much of its own tokens; more, if the tokens of both surroundings are all different
    need = np.ceil(similarity * np.where(inside > 0, inside, least).min(axis=1) - 1e-9).astype(np.int64)
    need_of_plain = math.ceil(2 * least * similarity / (1 + similarity) - 1e-9)
    need[np.bincount(lists, weights=~plain)[lists] == 0] = need_of_plain
    shared = np.bincount(rows, minlength=n)
    rank = np.arange(len(at)) - (np.cumsum(shared) - shared)[rows]
    none = int(np.diff(base).max())
    held = np.full((max(1, int(shared.max())), n), none, dtype=np.int32)
    bits_of_held = np.zeros((*held.shape, words), dtype=np.uint64)
    held[rank, rows], bits_of_held[rank, rows] = at - base[lists[rows]], bits
    # rows whose tokens are in the same windows are like the same others
    whole = mixed(inside.astype(np.uint64) @ mixed(np.arange(1, 64 * words + 1, dtype=np.uint64)))
    mark = np.zeros(len(at), dtype=np.uint64)
    for k in range(words):
        mark = mixed(mark ^ bits[:, k])
    if len(at):
        filled = np.flatnonzero(shared)
        whole[filled] += np.add.reduceat(mixed(mark + mixed(at.astype(np.uint64))), (np.cumsum(shared) - shared)[filled])
    kind = np.unique(whole, return_inverse=True)[1]
    del bits, mark
    groups = Groups(n)
    group = groups.of
    most = max(1, min(2 * COUNTED, TABLE // (none + 1)))
    lookup = np.zeros((most * (none + 1), words), dtype=np.uint64)

    def alike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        order, out = np.argsort(i, kind="stable"), np.zeros(len(i), dtype=bool)
        i, j = i[order], j[order]
        first = _ends(i)[0] == np.arange(len(i))
        row = np.cumsum(first)
        end = 0
        while end < len(i):
            start, end = end, min(end + 2 * COUNTED, int(np.searchsorted(row, row[end] + most)))
            a, b, mine = i[start:end], j[start:end], row[start:end] - row[start]
            own = np.unique(a)
            filled, wide = np.arange(len(own)) * (none + 1) + held.take(own, axis=1), int(shared[b].max())
            lookup[filled] = bits_of_held.take(own, axis=1)  # places that aren't used have none
            both = lookup.take(mine * (none + 1) + held[:wide].take(b, axis=1), axis=0)
            lookup[filled] = 0
            needed = np.where(plain[a] & plain[b], need_of_plain, np.maximum(need[a], need[b]))
            good = np.flatnonzero(both.any(axis=2).sum(axis=0, dtype=np.int32) >= needed)
            if len(good):
                a, b = a[good], b[good]
                out[order[start + good]] = windows_alike(both.take(good, axis=1) & bits_of_held[:wide].take(b, axis=1), inside[a], inside[b], similarity)
        return out

    def kinds(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.minimum(kind[i], kind[j]) * n + np.maximum(kind[i], kind[j])

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        """Connect those pairs (later, earlier) that are similar."""
        rest = (group[i] != group[j]) & ((ids[i] != ids[j]) | (places[i] - places[j] >= least))
        i, j = i[rest], j[rest]
        _, one, back = np.unique(kinds(i, j), return_index=True, return_inverse=True)
        good = alike(i[one], j[one])[back]
        for later, earlier in zip(i[good].tolist(), j[good].tolist(), strict=True):
            if group[later] != group[earlier]:
                groups.link(later, earlier)

    prefix = np.flatnonzero(rank <= (shared - need)[rows])
    prefix = prefix[np.argsort(at[prefix] << 32 | rows[prefix])]
    listed, rank = rows[prefix], rank[prefix]
    list_start, _ = _ends(at[prefix])
    behind = np.flatnonzero(np.arange(len(prefix)) > list_start)
    behind = behind[np.argsort(-rank[behind], kind="stable")]
    parts = np.split(behind, np.flatnonzero(np.diff(rank[behind])) + 1)
    for others, each in ((list_start, parts), (np.arange(-1, len(prefix) - 1), parts[::-1])):  # the first that has the token, from the most frequent on; then the one before
        for part in each:
            part = part[group[listed[part]] != group[listed[others[part]]]]
            if len(part):
                compare(listed[part], listed[others[part]])
    if not len(behind):
        return np.array(groups.left, dtype=np.int64), np.array(groups.right, dtype=np.int64)
    # of tokens whose rows aren't all connected, each row with all before it
    differ = np.concatenate(([0], np.cumsum((group[listed[1:]] != group[listed[:-1]]) & (list_start[1:] == list_start[:-1]))))
    last = _ends(list_start)[1] - 1
    behind = np.sort(behind)
    behind = behind[differ[last[behind]] > differ[list_start[behind]]]
    behind = behind[np.argsort(listed[behind], kind="stable")]
    tried, of_row = np.zeros(n, dtype=bool), -1  # candidates of a row that comes in several parts
    for part in np.split(behind, np.flatnonzero(np.diff(np.cumsum(behind - list_start[behind]) // GATHERED)) + 1):
        many = part - list_start[part]
        j = listed[np.arange(many.sum()) + np.repeat(list_start[part] - np.cumsum(many) + many, many)]
        i = np.repeat(listed[part], many)
        new = group[i] != group[j]
        new &= (i != of_row) | ~tried[j]
        i, j = np.divmod(np.unique(i[new] * n + j[new]), n)
        if len(i):
            if i[-1] != of_row:
                tried[:], of_row = False, i[-1]
            tried[j[i == of_row]] = True
        some = 1
        while len(i):  # of each two groups at first one pair, then ever more of them
            low, high = np.minimum(group[i], group[j]), np.maximum(group[i], group[j])
            two, what = low * n + high, kinds(i, j)
            order = np.lexsort((what, two))
            i, j, two, what = i[order], j[order], two[order], what[order]
            start, _ = _ends(two)
            new = np.ones(len(i), dtype=bool)
            new[1:] = (what[1:] != what[:-1]) | (start[1:] != start[:-1])
            new = np.cumsum(new)
            now = new - new[start] < some
            compare(i[now], j[now])
            rest = ~now & (group[i] != group[j])
            i, j, some = i[rest], j[rest], 4 * some
    return np.array(groups.left, dtype=np.int64), np.array(groups.right, dtype=np.int64)


def agreeing(places: np.ndarray, one: np.ndarray, other: np.ndarray, code: np.ndarray, asked: np.ndarray, agree: int) -> np.ndarray:
    """Interval join of the windows of one pair of texts: those of ``asked`` that meet windows of ``agree`` functions, their own included, in both texts. ``one`` and ``other``: reach in each text."""
    x, y, f = places >> 32, places & 0xFFFFFFFF, code >> 1
    ends = [(c - (r >> 32), c + (r & 0xFFFFFFFF)) for c, r in ((x, one), (y, other))]
    good = np.zeros(len(asked), dtype=bool)
    for k in range(0, len(asked), 256):
        part = asked[k : k + 256]
        meets = np.ones((len(part), len(places)), dtype=bool)
        for low, high in ends:
            meets &= (low[None, :] <= high[part, None]) & (high[None, :] >= low[part, None])
        good[k : k + 256] = sum(meets[:, f == g].any(axis=1).astype(int) for g in np.unique(f)) >= agree
    return asked[good]


class Windows:
    """Similarity of all windows of ``least`` tokens that begin at one place in two slices, as sets."""

    def __init__(self, a: np.ndarray, b: np.ndarray, least: int):
        n = len(a) - least + 1
        values, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        inside = []
        for side in (at[: len(a)], at[len(a) :]):
            place = np.arange(len(side))
            row = side * (n + 1)  # windows that hold each token, by where they begin
            change = np.bincount(row + np.minimum(np.maximum(place - least + 1, 0), n), minlength=len(values) * (n + 1)) - np.bincount(row + np.minimum(place + 1, n), minlength=len(values) * (n + 1))
            inside.append(np.cumsum(change.reshape(-1, n + 1)[:, :n], axis=1) > 0)
        common = (inside[0] & inside[1]).sum(axis=0)
        self.value = common / (inside[0].sum(axis=0) + inside[1].sum(axis=0) - common)

    def best(self, low: int, high: int, enough: float) -> tuple[int, float]:
        """(start, similarity) of the most similar window that begins at ``low`` to ``high``; less than ``enough`` is given as 0."""
        k = low + int(self.value[low : high + 1].argmax())
        return k, float(self.value[k]) if self.value[k] >= enough else 0.0


class DistinctWindows(Windows):
    """The same where no slice repeats a token: pairs of equal tokens are the common ones."""

    def __init__(self, a: np.ndarray, b: np.ndarray, least: int):
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        first, last = np.maximum(np.maximum(i, j) - least + 1, 0), np.minimum(i, j)
        inside = first <= last
        change = np.bincount(first[inside], minlength=len(a) + 1) - np.bincount(last[inside] + 1, minlength=len(a) + 1)
        common = np.cumsum(change)[: len(a) - least + 1]
        self.value = common / (2 * least - common)


def windows(a: np.ndarray, b: np.ndarray, least: int) -> Windows:
    plain = len(set(a.tolist())) == len(a) and len(set(b.tolist())) == len(b)
    return (DistinctWindows if plain else Windows)(a, b, least)


class Spans:
    """Verified passages of a pair of texts (``a`` and ``b``, as tokens): found from places where they meet.

    First the run of equal tokens around a place; if it is shorter than ``least``,
    all windows of ``least`` tokens that hold the place, by the Jaccard similarity
    of their sets, of which the most similar counts. A place inside a passage found
    before on its diagonal is skipped, and one where equal runs of ``least`` tokens begin
    (whole), if equal passages found before hold both runs: a repetitive text gives
    no row for each of its shifts. ``apart``: how much b begins behind a, if both
    are one text; then passages less than ``least`` apart don't count.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, least: int, similarity: float, apart: int | None = None):
        self.a, self.b, self.least, self.similarity, self.apart = a, b, least, similarity, apart
        self.found: list[tuple[int, int, int, int, float]] = []
        self.done: dict[int, list[tuple[int, int]]] = {}
        self.held = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)  # where runs of found equal passages begin

    def covered(self, i: int, j: int) -> bool:
        for start, end in self.done.get(i - j, ()):
            if start <= i < end:
                return True
        return False

    def add(self, start: int, n: int, shift: int, value: float) -> None:
        self.found.append((start, n, start + shift, n, value))
        self.done.setdefault(-shift, []).append((start, start + n))

    def runs(self, x: np.ndarray, y: np.ndarray, whole: np.ndarray) -> list[tuple[int, int]]:
        """Look for equal runs at the places x of a and y of b; gives the places that lie in none."""
        a, b, least, short = self.a, self.b, self.least, []
        order = np.lexsort((y, x))
        for i, j, run in zip(x[order].tolist(), y[order].tolist(), whole[order].tolist(), strict=True):
            if self.covered(i, j) or self.apart is not None and abs(i - j - self.apart) < least or run and self.held[0][i] and self.held[1][j]:
                continue
            if a[i] != b[j]:  # places meet by hash; a false meeting proves nothing
                continue
            p, q = i - min(i, j, least), j - min(i, j, least)  # at first near the place, where most runs end
            n = min(len(a) - p, len(b) - q, 2 * least)
            equal = (a[p : p + n] == b[q : q + n]).tobytes()
            before, after = equal.rfind(0, 0, i - p) + 1, equal.find(0, i - p)
            after = n if after < 0 else after
            start, end, shift = p + before, p + after, j - i
            if before == 0:
                more = np.flatnonzero(a[max(0, -shift) : p] != b[max(0, -shift) + shift : q])
                start = max(0, -shift) + (int(more[-1]) + 1 if len(more) else 0)
            if after == n:
                most = min(len(a) - end, len(b) - end - shift)
                more = np.flatnonzero(a[end : end + most] != b[end + shift : end + shift + most])
                end += int(more[0]) if len(more) else most
            if end - start >= least:
                self.add(start, end - start, shift, 1.0)
                self.held[0][start : end - least + 1] = True
                self.held[1][start + shift : end + shift - least + 1] = True
            else:
                short.append((i, j))
        return short

    def windows(self, places: list[tuple[int, int]]) -> None:
        """Look for similar windows around places; those of one diagonal that lie near are looked at together."""
        a, b, least = self.a, self.b, self.least
        places = sorted({(i - j, i) for i, j in places if a[i] == b[j] and not self.covered(i, j) and not (self.apart is not None and abs(i - j - self.apart) < least)})
        k = 0
        while k < len(places):
            end = k + 1
            while end < len(places) and places[end][0] == places[k][0] and places[end][1] - places[end - 1][1] < least:
                end += 1
            diagonal = places[k][0]
            p = max(places[k][1] - least + 1, 0, diagonal)
            stop = min(places[end - 1][1] + least, len(a), len(b) + diagonal)
            if stop - p >= least:
                both = windows(a[p:stop], b[p - diagonal : stop - diagonal], least)
                for _, i in places[k:end]:
                    low, high = max(0, i - p - least + 1), min(i - p, stop - p - least)
                    if low <= high and not self.covered(i, i - diagonal):
                        at, value = both.best(low, high, self.similarity)
                        if value:
                            self.add(p + at, least, -diagonal, value)
            k = end


def similar_spans(a: np.ndarray, b: np.ndarray, places: np.ndarray, one: np.ndarray, other: np.ndarray, code: np.ndarray, base: int, least: int, similarity: float, agree: int, apart: int | None = None) -> list[tuple[int, int, int, int, float]]:
    """Passages of a pair (start and length in a and b, in tokens; similarity) from where its windows meet; ``b`` begins at token ``base`` of its text. Equal runs are looked for where they share words; then similar windows, there and around what no passage covers and ``agree`` functions have."""
    spans = Spans(a, b, least, similarity, apart)
    x, y, sure = places >> 32, (places & 0xFFFFFFFF) - base, code & 1 == 1
    near = spans.runs(x[sure], y[sure], code[sure] >> 1 == WHOLE)
    rest = np.flatnonzero(~sure)
    rest = rest[[not spans.covered(i, j) for i, j in zip(x[rest].tolist(), y[rest].tolist(), strict=True)]] if len(rest) else rest
    if len(rest):
        rest = agreeing(places, one, other, np.where(code >> 1 == WHOLE, code & 1, code), rest, agree)
    spans.windows(near + list(zip(x[rest].tolist(), y[rest].tolist(), strict=True)))
    return spans.found


RESULT = "doc_id bigint, start bigint, n_words bigint, other_id bigint, other_start bigint, other_n_words bigint, similarity double"


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, functions: int = FUNCTIONS, agree: int = AGREE, similarity: float = SIMILARITY) -> DataFrame:
    """Passages of at least ``words`` words that a text shares with an earlier one (by id), or has twice.

    One row a passage: doc_id, start and n_words (in words), and the same of its
    partner, which has the smaller id. Words are lower-cased (A-Z). Texts that are
    equal form a class: its rows but the first name the first, with similarity 1
    over the whole text, and only the first is searched. Every run of ``words``
    equal words is found, in long lists by a hash of the whole run; passages that
    differ within are found with the probability that ``agree`` of ``functions``
    min-hashes agree, and wherever one does in a list of more than LIST windows. A passage that many texts share links each to some of them,
    not each to each, but all that are similar within a list are connected by such
    links. Null, empty and short texts and rows with a null id give no rows; rows that repeat an id with
    another text count as one document's texts; other columns are not read.
    """
    least = words - WIDTH + 1
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    hashed = rows.select("id", F.xxhash64("text").alias("p"), F.xxhash64("text", F.lit(1)).alias("q"))
    firsts = hashed.groupBy("p", "q").agg(F.min("id").alias("first"))
    reps = rows.join(sized(firsts.select(F.col("first").alias("id")).distinct()), "id", "left_semi")

    with scratch(docs.sparkSession) as keep:
        meeting = "u bigint, v bigint, places bigint, one bigint, other bigint, code bigint, kind tinyint"  # kind: a meeting, or a row of a long list, which has id, nothing, key, place, reach, side
        names = [c.split()[0] for c in meeting.split(", ")]

        def rows_of(got: tuple[np.ndarray, ...], kind: int = 0) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(got[0]), 50_000):
                part = [pa.array(x[k : k + 50_000]) if x is not None else pa.nulls(len(got[0][k : k + 50_000]), pa.int64()) for x in got]
                yield pa.RecordBatch.from_arrays([*part, pa.array(np.full(len(part[0]), kind, np.int8))], names=names)

        def pairs(batches):
            held = [b for b in batches if b.num_rows]
            if held:
                table = pa.Table.from_batches(held)
                got, (key, ids, place, reach, side) = listed_pairs(*(table.column(k).to_numpy() for k in ("key", "id", "place", "reach", "side")), LIST, HEADS)
                yield from rows_of(got)
                yield from rows_of((ids, None, key, place, reach, side), 1)

        def exact(batches):
            held = [b for b in batches if b.num_rows]
            if held:
                table = pa.Table.from_batches(held)
                spans = table.column("spans").combine_chunks()
                spans = spans if isinstance(spans, pa.Array) else pa.concat_arrays(spans.chunks)
                yield from rows_of(span_pairs(table.column("id").to_numpy(), table.column("first").to_numpy(), spans.value_lengths().to_numpy(), spans.flatten().to_numpy(), least))

        listed = stored(window_rows(reps, words, functions).repartition("key").mapInArrow(pairs, meeting), "alignments")
        # in long lists of function 0, which equal runs of words have in common, each run is held against the first that equals it
        places = listed.where("kind = 1").select(F.col("u").alias("id"), F.col("places").alias("key"), F.col("one").alias("place"), F.col("other").alias("reach"))

        def at_places(found: DataFrame, columns: list[str]) -> DataFrame:
            """id, text and at, an array of ``columns``: the texts of the rows of ``found``."""
            grouped_by_id = found.groupBy(F.col("id").alias("of")).agg(F.collect_list(F.struct(*columns)).alias("at"))
            return reps.join(sized(grouped_by_id), F.col("id") == F.col("of")).select("id", "text", "at")

        whole = span_rows(at_places(places.where("key & 15 = 0"), ["key", "place", "reach"]), words).repartition("key").mapInArrow(exact, meeting)
        place = F.col("places").bitwiseAND(0xFFFFFFFF)

        def grouped(meetings: DataFrame) -> DataFrame:
            """u, v, mask of functions, sure, low and high place in v, met: the meetings of each pair of texts."""
            return meetings.groupBy("u", "v").agg(F.expr("bit_or(shiftleft(1L, int(shiftright(code, 1))))").alias("mask"), F.max(F.col("code") % 2).alias("sure"), F.min(place).alias("low"), F.max(place).alias("high"), F.collect_list(F.struct("places", "one", "other", "code")).alias("met"))

        def make():
            def one(batch: pa.RecordBatch) -> pa.RecordBatch:
                tokens = shingles(as_bytes(batch.column("text")), WIDTH)
                return pa.RecordBatch.from_pydict({"id": batch.column("id"), "tokens": pa.array([(t >> np.uint64(32)).astype(np.uint32).tobytes() for t in tokens], pa.binary())})

            return one

        def verified(chosen: DataFrame) -> DataFrame:
            """Passages of pairs that met, ``need`` functions having to agree: each leading text goes with blocks of its partners."""
            salts = chosen.groupBy("u").agg(F.ceil(F.count("*") / PARTNERS).alias("salts"))
            salted = chosen.join(sized(salts), "u").withColumn("salt", F.pmod(F.xxhash64("v"), F.col("salts")))
            wanted = chosen.select(F.explode(F.array("u", "v")).alias("id")).distinct()
            # verified on 32 bits of a token: a passage needs dozens of equal ones
            texts = stored(map_arrow(rows.join(sized(wanted), "id", "left_semi"), make, "id bigint, tokens binary"), "tokens")
            # of a partner, the part around its places: a run of equal words reaches less than a passage beyond its outermost places
            offset = F.greatest(F.col("low") - 2 * least, F.lit(0))
            part = F.substr("tokens", (4 * offset + 1).cast("int"), (4 * (F.col("high") + 2 * least - offset)).cast("int"))
            none = F.lit(None)
            lead = salts.select("u", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt")).join(texts, F.col("u") == F.col("id")).select("u", "salt", none.cast("bigint").alias("v"), none.cast("bigint").alias("base"), "tokens", none.cast(chosen.schema["met"].dataType).alias("met"), none.cast("int").alias("need"))
            partner = salted.join(texts, F.col("v") == F.col("id")).select("u", "salt", "v", offset.alias("base"), part.alias("tokens"), "met", "need")
            dealt = lead.union(partner).repartition("u", "salt").sortWithinPartitions("u", "salt", F.asc_nulls_first("v"))

            def verify(batches):
                key, one, out = None, None, []

                def batch_of():
                    columns = list(zip(*out, strict=True))
                    out.clear()
                    return pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 6 else pa.int64()) for k, c in enumerate(columns)], names=[c.split()[0] for c in RESULT.split(", ")])

                for part in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
                    flat = part.column("met").flatten()
                    ends = np.cumsum(part.column("met").value_lengths().fill_null(0).to_numpy()).tolist()
                    places = [flat.field(k).to_numpy() for k in ("places", "one", "other", "code")]
                    for k, (u, salt, v, base, tokens, need) in enumerate(zip(*(part.column(c).to_pylist() for c in ("u", "salt", "v", "base", "tokens", "need")), strict=True)):
                        if v is None:
                            key, one = (u, salt), np.frombuffer(tokens, dtype=np.uint32)
                        elif key == (u, salt):
                            mine = slice(ends[k - 1] if k else 0, ends[k])
                            for p, n, q, m, value in similar_spans(one, np.frombuffer(tokens, dtype=np.uint32), *(x[mine] for x in places), base, least, similarity, need, base if u == v else None):
                                out.append((v, q + base, m + WIDTH - 1, u, p, n + WIDTH - 1, value))
                    if len(out) > 10_000:
                        yield batch_of()
                if out:
                    yield batch_of()

            with small_batches(docs.sparkSession):
                return stored(dealt.mapInArrow(verify, RESULT), "passages")

        several = F.bit_count("mask") >= agree
        first_met = stored(grouped(listed.where("kind = 0").union(whole)).withColumn("met", F.when(several | (F.col("sure") == 1), F.col("met"))), "pairs")
        found = verified(first_met.where("met is not null").withColumn("need", F.lit(agree)))

        # in lists where not all met: each place, but for those whose surroundings an earlier text has whole, which stands for them in the list
        whole_from, whole_to = F.col("start") + least - 1, F.col("start") + F.col("n_words") - WIDTH + 1 - least
        covers = found.where("similarity = 1").select(F.col("doc_id").alias("id"), F.when(F.col("start") == 0, 0).otherwise(whole_from).alias("a"), whole_to.alias("b")).where("a <= b").distinct()
        covered = places.join(sized(covers), "id").where(F.col("place").between(F.col("a"), F.col("b"))).select("key", "id", "place").distinct()
        asked = places.select("key", "id", "place").join(covered, ["key", "id", "place"], "left_anti")

        def surroundings():
            def one(batch: pa.RecordBatch) -> pa.RecordBatch:
                out = []
                for name, tokens, at in zip(batch.column("id").to_pylist(), shingles(as_bytes(batch.column("text")), WIDTH), batch.column("at").to_pylist(), strict=True):
                    tokens = (tokens >> np.uint64(32)).astype(np.uint32)
                    out += [(x["key"], name, x["place"], tokens[max(0, x["place"] - least + 1) : x["place"] + least].tobytes()) for x in at]
                return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["key", "id", "place", "region"])

            return one

        regions = map_arrow(at_places(asked, ["key", "place"]), surroundings, "key bigint, id bigint, place bigint, region binary")

        def apart(batches):
            key, held, lists = None, [], []

            def close():
                held.sort()
                once = {}  # equal surroundings are equal runs, which are found by function 0
                for name, place, region in held:
                    once.setdefault((min(place, least - 1), region), (name, place))
                if len(once) > 1:
                    lists.append((key, once))

            def meetings():
                if lists:
                    ids, place = (np.array(x, dtype=np.int64) for x in zip(*(v for _, once in lists for v in once.values()), strict=True))
                    centres, regions = zip(*((c, np.frombuffer(x, dtype=np.uint32)) for _, once in lists for c, x in once), strict=True)
                    number = np.repeat(np.arange(len(lists)), [len(once) for _, once in lists])
                    left, right = near_pairs(list(regions), np.array(centres), ids, place, least, similarity, number)
                    code = np.array([2 * (k & 15) for k, _ in lists])[number[left]]
                    lists.clear()
                    if len(left):
                        yield from rows_of((ids[left], ids[right], (place[left] << 32) | place[right], *(np.full(len(left), least - 1),) * 2, code))

            for batch in batches:
                for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "place", "region")), strict=True):
                    if k != key:
                        close()
                        if sum(len(once) for _, once in lists) >= TOGETHER:
                            yield from meetings()
                        key, held = k, []
                    held.append(tuple(row))
            close()
            yield from meetings()

        with small_batches(docs.sparkSession, 5000):
            late = stored(regions.repartition("key").sortWithinPartitions("key").mapInArrow(apart, meeting), "met")
            known = found.select(F.col("other_id").alias("u"), F.col("doc_id").alias("v"), "start", "n_words", "other_start", "other_n_words")
            at_u, at_v = F.shiftright("places", 32), place
            inside = (at_u >= F.col("other_start")) & (at_u <= F.col("other_start") + F.col("other_n_words") - WIDTH) & (at_v >= F.col("start")) & (at_v <= F.col("start") + F.col("n_words") - WIDTH)
            kept = known.join(sized(late.select("u", "v").distinct()), ["u", "v"], "left_semi").withColumnsRenamed({"u": "u_", "v": "v_"})
            late = late.join(kept, (F.col("u") == F.col("u_")) & (F.col("v") == F.col("v_")) & inside, "left_anti")
            late = grouped(late).withColumn("need", F.lit(1))  # the exact check decides
            late = stored(late.select(*first_met.columns, "need"), "late")
        found = found.union(verified(late))
        found = keep(stored(found, "found"))
    length = F.size(F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")).cast("bigint")
    copies = hashed.join(firsts, ["p", "q"]).where("id > first").select("id", "first")
    copies = rows.join(sized(copies.distinct()), "id").select(F.col("id").alias("doc_id"), F.lit(0).cast("bigint").alias("start"), length.alias("n_words"), F.col("first").alias("other_id"), F.lit(0).cast("bigint").alias("other_start"), F.col("n_words").alias("other_n_words"), F.lit(1.0).alias("similarity"))
    return found.union(copies.where(F.col("n_words") >= words))
