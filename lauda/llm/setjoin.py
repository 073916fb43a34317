"""Exact similarity join of sets by a count-vector R-tree over prefix blocks.

Every set is summarised as a vector of counts over 64 token groups (a token's group is its top six
hash bits). The overlap of two sets is at most the sum of the coordinate minima of their vectors.
Counts are kept in thermometer form (one bit word per level, two levels, the rest as an excess), so
the sum of minima is the popcount of an AND, and the upper corner of a bounding box is an OR.

A single R-tree over all points doesn't scale out, so points are first blocked without loss: tokens
are ordered globally from rare to frequent, and two sets of similarity t or more must share a token
of their prefixes. In each block an R-tree is bulk loaded (points ordered by set size, eight to a
leaf, eight children to an inner node, up to a root level of at most eight nodes) and joined with
itself from the top: node pairs are cut by size and by the bound of their boxes, point pairs by the
sum of minima, size and position, and what is left is verified on the sets themselves.

Token frequencies come from a sketch of fixed size (2^20 counters) over all sets; any consistent
order keeps the join exact, so collisions cost time only. A block expected to be larger than
BLOCK_ROWS is split into stripes and every pair of stripes becomes a block of its own: nothing is
capped. Sets that are equal are one class and never paired with themselves.

Edge cases: an empty set pairs with nothing; similarity is overlap over union, compared in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lauda.llm.kernels import mix

SKETCH_BITS = 20
BLOCK_ROWS = 16384
LEAF = 8
#: Children of an inner node; also the most nodes of a root level.
FAN = 8
#: Node pairs looked at together.
PAIRS = 1 << 18
#: Similarity as a fraction: 3/5.
SIM = (3, 5)
POSTING = "blk bigint, n int, cid bigint, w1 bigint, w2 bigint, meta bigint"
_G = np.uint64(58)


def _tokens(batch: pa.RecordBatch, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hash, owner row, sizes) of a batch's grams column; the seed keeps tables apart."""
    lists = batch.column(batch.schema.get_field_index("grams"))
    off = lists.offsets.to_numpy().astype(np.int64)
    size = np.diff(off)
    owner = np.repeat(np.arange(len(size)), size)
    g = lists.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].view(np.uint32).astype(np.uint64)
    return mix((g << np.uint64(8)) ^ seeds[owner]), owner, size


def frequency_sketch(sets: DataFrame) -> np.ndarray:
    """Counts of all tokens of all sets, hashed to 2^SKETCH_BITS counters: bounded by that size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            tok, _, _ = _tokens(b, b.column(0).to_numpy().astype(np.uint64))
            acc += np.bincount((tok & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=1 << SKETCH_BITS)
        at = np.flatnonzero(acc)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(acc[at])], names=["slot", "n"])

    rows = sets.select("seed", "grams").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << SKETCH_BITS, np.int32)
    out[rows["slot"].to_numpy()] = np.minimum(rows["n"].to_numpy(), 2**31 - 1)
    return out


def signatures(tok: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Thermometer words (counts of at least one, of at least two) of each row's 64 group counts."""
    counts = np.bincount(owner * 64 + (tok >> _G).astype(np.int64), minlength=rows * 64).reshape(rows, 64)
    pack = lambda m: np.packbits(m, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return pack(counts >= 1), pack(counts >= 2)


def postings(sets: DataFrame, sketch: np.ndarray, sim: tuple[int, int] = SIM, frozen: bool = False) -> DataFrame:
    """Sets (seed, cid, load, grams) to the rows of their prefix tokens' blocks.

    frozen says that the sketch is older than these sets, so tokens it doesn't know are kept.
    meta packs position, excess, load, stripe and whether the block pairs two different stripes.
    """
    shared = sets.sparkSession.sparkContext.broadcast(sketch)  # fixed size: 4 MB
    p, q = sim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        for b in batches:
            cid, load = b.column(1).to_numpy(), b.column(2).to_numpy().astype(np.int64)
            tok, owner, size = _tokens(b, b.column(0).to_numpy().astype(np.uint64))
            if not len(tok):
                continue
            w1, w2 = signatures(tok, owner, len(size))
            excess = size - np.bitwise_count(w1) - np.bitwise_count(w2)
            f = freq[(tok & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
            order = np.lexsort((tok, f, owner))
            tok, f, owner = tok[order], f[order], owner[order]
            pos = np.arange(len(tok)) - (np.cumsum(size) - size)[owner]
            n = size[owner]
            keep = (pos < n - (p * n + q - 1) // q + 1) & (frozen | (f > 1))  # a token seen once has no partner
            tok, f, owner, pos = tok[keep], f[keep].astype(np.int64), owner[keep], pos[keep]
            stripes = np.maximum(1, -(-f // BLOCK_ROWS))
            rep = np.repeat(np.arange(len(tok)), stripes)  # one row unless the block is too large
            other = np.arange(len(rep)) - np.repeat(np.cumsum(stripes) - stripes, stripes)
            tok, owner, pos, s = tok[rep], owner[rep], pos[rep], stripes[rep].astype(np.uint64)
            mine = (mix(cid[owner].view(np.uint64)) % s).astype(np.int64)
            cell = np.minimum(mine, other) * (1 << 20) + np.maximum(mine, other)
            blk = tok ^ mix(cell.astype(np.uint64) + np.uint64(0x9E37))
            cross = mine != other
            meta = np.minimum(pos, 0xFFFF) | np.minimum(excess[owner], 0xFFFF) << 16 | load[owner] << 32 | ((mine > other) & cross).astype(np.int64) << 60 | cross.astype(np.int64) << 61
            yield pa.RecordBatch.from_arrays(
                [pa.array(blk.view(np.int64)), pa.array(size[owner].astype(np.int32)), pa.array(cid[owner]), pa.array(w1[owner].view(np.int64)), pa.array(w2[owner].view(np.int64)), pa.array(meta)],
                names=[c.split()[0] for c in POSTING.split(", ")],
            )

    return sets.select("seed", "cid", F.col("load_no").cast("int").alias("load"), "grams").mapInArrow(run, POSTING)


def _need(na: np.ndarray, nb: np.ndarray, p: int, q: int) -> np.ndarray:
    """Least overlap of sets of these sizes that are similar enough."""
    return np.maximum(1, -(-(p * (na + nb)) // (p + q)))


class Level:
    """Nodes of one tree level in block order: boxes (upper corners o1, o2 and excess, sizes low to high)."""

    def __init__(self, block, o1, o2, most, low, high, child):
        self.block, self.o1, self.o2, self.most, self.low, self.high = block, o1, o2, most, low, high
        self.child = child  # first child of each node and the end of the last one; None for leaves

    def up(self) -> "Level | None":
        """The level above, or None where no block has more than FAN nodes."""
        new = np.concatenate(([True], self.block[1:] != self.block[:-1]))
        begin = np.flatnonzero(new)
        if np.diff(np.append(begin, len(self.block))).max() <= FAN:
            return None
        within = np.arange(len(self.block)) - np.repeat(begin, np.diff(np.append(begin, len(self.block))))
        at = np.flatnonzero(within % FAN == 0)
        over = lambda f, v: f.reduceat(v, at)
        return Level(
            self.block[at], over(np.bitwise_or, self.o1), over(np.bitwise_or, self.o2), over(np.maximum, self.most), over(np.minimum, self.low), over(np.maximum, self.high), np.append(at, len(self.block))
        )

    def pairs_of_roots(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs x <= y of nodes of one block, at most FAN * (FAN + 1) / 2 a block."""
        end = np.searchsorted(self.block, self.block, side="right")
        n = end - np.arange(len(end))
        x = np.repeat(np.arange(len(end)), n)
        return x, x + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)

    def below(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children of node pairs; a node with itself gives each pair of children once."""
        nx, ny = self.child[x + 1] - self.child[x], self.child[y + 1] - self.child[y]
        n = nx * ny
        rep = np.repeat(np.arange(len(x)), n)
        k = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
        a, b = self.child[x[rep]] + k // ny[rep], self.child[y[rep]] + k % ny[rep]
        once = a <= b
        return a[once], b[once]

    def near(self, x: np.ndarray, y: np.ndarray, p: int, q: int, bounded: bool) -> np.ndarray:
        """Which pairs of boxes can hold points that are similar enough: by sizes and summed minima."""
        ok = self.high[x] * q >= p * self.low[y]  # nodes follow size inside a block
        if bounded:
            most = np.bitwise_count(self.o1[x] & self.o1[y]).astype(np.int64) + np.bitwise_count(self.o2[x] & self.o2[y]) + np.minimum(self.most[x], self.most[y])
            ok &= most >= _need(self.low[x], self.low[y], p, q)
        return ok


def tree_pairs(leaves: Level, p: int, q: int, bounded: bool, stats: dict | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs x <= y of leaves whose boxes are near, found from the roots down."""
    levels = [leaves]
    while above := levels[-1].up():
        levels.append(above)

    def descend(depth: int, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        level = levels[depth]
        ok = level.near(x, y, p, q, bounded)
        if stats is not None:
            stats[depth] = stats.get(depth, 0) + len(x)
        x, y = x[ok], y[ok]
        if not depth:
            yield x, y
            return
        step = max(1, PAIRS // FAN**2)
        for c in range(0, len(x), step):
            yield from descend(depth - 1, *level.below(x[c : c + step], y[c : c + step]))

    x, y = levels[-1].pairs_of_roots()
    for c in range(0, len(x), PAIRS):
        yield from descend(len(levels) - 1, x[c : c + PAIRS], y[c : c + PAIRS])


def block_candidates(cols: list[np.ndarray], sim: tuple[int, int], by_load: bool, stats: dict | None = None) -> tuple[np.ndarray, ...]:
    """Candidate pairs of complete blocks (rows sorted by block, size, class).

    Returns (a, b, load of a): classes with a < b, or with by_load (earlier, later, earlier load).
    """
    p, q = sim
    blk, n, cid, w1, w2, meta = cols
    load = meta >> 32 & 0xFFFFFFF
    new = np.ones(len(blk), bool)
    new[1:] = (blk[1:] != blk[:-1]) | (cid[1:] != cid[:-1]) | (load[1:] != load[:-1] if by_load else False)
    blk, n, cid, w1, w2, meta, load = (c[new] for c in (blk, n, cid, w1, w2, meta, load))
    start = np.flatnonzero(np.concatenate(([True], blk[1:] != blk[:-1])))
    count = np.diff(np.append(start, len(blk)))
    many = count > 1
    start, count = start[many], count[many]
    empty = np.empty(0, np.int64)
    if not len(start):
        return empty, empty, empty
    # leaves of LEAF points each, a block's last leaf padded with -1
    leaves = -(-count // LEAF)
    first = np.cumsum(leaves) - leaves
    block = np.repeat(np.arange(len(start)), leaves)
    within = np.arange(leaves.sum()) - first[block]
    at = start[block][:, None] + within[:, None] * LEAF + np.arange(LEAF)[None, :]
    real = at < (start + count)[block][:, None]
    at = np.where(real, at, 0)
    pick = lambda v: np.where(real, v[at], v.dtype.type(0))
    full = n.max(initial=0) < 4000 and (meta >> 16 & 0xFFFF).max(initial=0) < 255  # narrow arithmetic holds
    size, a1, a2 = pick(n.astype(np.uint16 if full else np.int64)), pick(w1.view(np.uint64)), pick(w2.view(np.uint64))
    exc = pick(np.minimum(meta >> 16 & 0xFFFF, 255).astype(np.uint8))
    o1, o2 = np.bitwise_or.reduce(a1, axis=1), np.bitwise_or.reduce(a2, axis=1)
    most, low, high = exc.max(axis=1).astype(np.int64), np.where(real, size.astype(np.int64), 1 << 40).min(axis=1), size.max(axis=1).astype(np.int64)
    out = []

    def leaf_pairs(la: np.ndarray, lb: np.ndarray) -> None:
        for c in range(0, len(la), 16384):
            x, y = la[c : c + 16384], lb[c : c + 16384]
            bound = np.bitwise_count(a1[x][:, :, None] & a1[y][:, None, :]) + np.bitwise_count(a2[x][:, :, None] & a2[y][:, None, :])
            if full:
                bound = bound.astype(np.uint16) + np.minimum(exc[x][:, :, None], exc[y][:, None, :])  # up to 128 + 254
                total = size[x][:, :, None] + size[y][:, None, :]
                hit = bound * np.uint16(p + q) >= np.maximum(total * np.uint16(p), 1)
            else:  # very large sets: wide arithmetic, excess from the packed value
                total = size[x][:, :, None] + size[y][:, None, :]
                ex = pick(meta >> 16 & 0xFFFF)
                ex = np.where(ex == 0xFFFF, 1 << 40, ex)
                hit = (bound + np.minimum(ex[x][:, :, None], ex[y][:, None, :])) * (p + q) >= np.maximum(total * p, 1)
            k, i, j = np.nonzero(hit)
            if len(k):
                out.append(exact(at[x[k], i], at[y[k], j]))

    def exact(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        """What size, position, stripe and load leave of point pairs; keeps a dense block's memory to its result."""
        ok = (i < j) & (n[i] > 0) & (n[j] > 0) & (blk[i] == blk[j])
        i, j = i[ok], j[ok]
        na, nb, pa_, pb = n[i].astype(np.int64), n[j].astype(np.int64), meta[i] & 0xFFFF, meta[j] & 0xFFFF
        need = _need(na, nb, p, q)
        # as the first shared token of the pair, this one leaves at most the rest of the smaller tail
        ok = (na * q >= p * nb) & (cid[i] != cid[j]) & (pa_ < na - need + 1) & (pb < nb - need + 1) & (np.minimum(na - pa_, nb - pb) >= need)
        cross = meta[i] >> 61 & 1
        ok &= (cross == 0) | ((meta[i] >> 60 & 1) != (meta[j] >> 60 & 1))
        if by_load:
            ok &= load[i] != load[j]
        return i[ok], j[ok]

    for x, y in tree_pairs(Level(block, o1, o2, most, low, high, None), p, q, full, stats):
        leaf_pairs(x, y)
    if not out:
        return empty, empty, empty
    i, j = (np.concatenate(v) for v in zip(*out))
    swap = load[i] > load[j] if by_load else cid[i] > cid[j]
    a, b = np.where(swap, j, i), np.where(swap, i, j)
    return cid[a], cid[b], load[a]


def candidates(rows: DataFrame, sim: tuple[int, int] = SIM, by_load: bool = False, partitions: int | None = None) -> DataFrame:
    """Distinct candidate pairs (a, b, load_a) of the postings' blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows_held = 0

        def flush(cols: list[np.ndarray]) -> pa.RecordBatch:
            found = block_candidates(cols, sim, by_load)
            if not by_load:
                found = (found[0], found[1], np.zeros(len(found[0]), np.int64))
            if len(found[0]):
                found = np.unique(np.stack(found), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(v) for v in found], names=["a", "b", "load_a"])

        for b in batches:
            held.append([b.column(c).to_numpy(zero_copy_only=False) for c in range(b.num_columns)])
            rows_held += b.num_rows
            if rows_held >= 100_000:
                cols = [np.concatenate(v) for v in zip(*held)]
                cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last block may go on
                if cut:
                    yield flush([c[:cut] for c in cols])
                held, rows_held = [[c[cut:] for c in cols]], len(cols[0]) - cut
        if rows_held:
            yield flush([np.concatenate(v) for v in zip(*held)])

    n = partitions or max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = rows.repartition(n, "blk").sortWithinPartitions("blk", "n", "cid", "meta")
    return blocks.mapInArrow(run, "a bigint, b bigint, load_a bigint").groupBy("a", "b").agg(F.min("load_a").alias("load_a"))


def verified(pairs: DataFrame, sets: DataFrame, sim: tuple[int, int] = SIM) -> DataFrame:
    """Candidates whose sets are really similar enough: (a, b, load_a, shared, size_a, size_b).

    With sizes na and nb this is the same as an insert/delete distance of the sorted sets of at most
    (q - p) / (q + p) * (na + nb).
    """
    p, q = sim
    one = sets.filter(F.col("grams").isNotNull()).groupBy("cid").agg(F.first("grams").alias("grams"))
    with_a = pairs.join(one.withColumnsRenamed({"cid": "a", "grams": "grams_a"}), "a")
    both = with_a.join(one.withColumnsRenamed({"cid": "b", "grams": "grams_b"}), "b")
    na, nb = F.size("grams_a"), F.size("grams_b")
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    return both.select("a", "b", "load_a", shared.alias("shared"), na.alias("size_a"), nb.alias("size_b")).filter(
        F.col("shared") * (p + q) >= (F.col("size_a") + F.col("size_b")) * p
    )
