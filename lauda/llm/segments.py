"""Persisted segment index for bounded edit distance over strings of symbols.

A record is the string of its distinct word pairs in one global order, rare first. The insert/delete
distance of two such strings of lengths na and nb is na + nb - 2 * shared, so a similarity of p/q is a
distance of at most (q - p) / (q + p) * (na + nb).

Store. A string of length n is cut into a fixed number of segments, s(n) = n - ceil(p n / q) + 1: the
symbol at position i belongs to segment i mod s(n), so every segment begins with one of the s(n) rarest
symbols and holds two or three symbols (one, where n is tiny). A similar partner lacks at most s(n) - 1
of the symbols, so by pigeonhole it holds at least one segment whole. A segment is stored under its
first symbol and the string's length class (classes grow by q/p, so partners lie in at most three
neighbouring ones) with its position, the exact length, a mask of its other symbols and the string's
count vector.

Probe. A batch string asks, for each length class in reach, with its own symbols at the positions that
the distance allows: the first symbol of an intact segment j lies at a position of at most
j + nb - shared and, seen from the other side, j is at most that position + na - shared. The segment's
other symbols have to be in the string's mask and the sum of minima of the count vectors has to reach
the overlap that is needed.

Verify. The distance itself is computed for what is left, given up as soon as it passes the bound.

Append. The batch's own segments are added. The index is bucketed by key and the strings by class, so
a batch is shuffled to them and what is stored is never shuffled again; texts are never read again.
The symbol order is frozen with the first load (later symbols count as rarest: any order is exact).

Hot keys. The segments of one append that share a key beyond BLOCK_ROWS are spread over stripes, counted
per append, so stripes grow with the history; the few batch rows are repeated for them. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lauda.buckets import Bucketed
from lauda.llm.kernels import mix
from lauda.llm.setjoin import SIM, SKETCH_BITS, _tokens, frequency_sketch, signatures
from lauda.session import materialize

BLOCK_ROWS = 1 << 18
#: Symbols of one numpy pass.
PASS_SYMBOLS = 1 << 20
SEGMENT = "key bigint, cid bigint, load_no int, n int, pos int, rest bigint, w1 bigint, w2 bigint, excess int"
STRING = "seed bigint, cid bigint, load_no int, grams array<int>"
#: Rows of a bucket up to which a batch is hashed in memory instead of sorted.
HASHED_ROWS = 2_000_000
_SLOT = np.uint64((1 << SKETCH_BITS) - 1)


def length_bounds(sim: tuple[int, int]) -> np.ndarray:
    """Least length of every length class: a class ends where its least length cannot be similar any more."""
    p, q = sim
    out = [1]
    while out[-1] < 1 << 31:
        out.append(out[-1] * q // p + 1)
    return np.array(out, np.int64)


def by_symbols(batches, column: str = "grams") -> Iterator[pa.RecordBatch]:
    """Batches cut to some PASS_SYMBOLS symbols, so very long strings don't set the memory."""
    for b in batches:
        off = b.column(b.schema.get_field_index(column)).offsets.to_numpy().astype(np.int64)
        start = 0
        while start < b.num_rows:
            end = max(start + 1, int(np.searchsorted(off, off[start] + PASS_SYMBOLS, side="right")) - 1)
            yield b.slice(start, min(end, b.num_rows) - start)
            start = end


def _keys(tok: np.ndarray, length_class: np.ndarray) -> np.ndarray:
    return mix(tok ^ mix(length_class.astype(np.uint64) + np.uint64(0x5E6)))


def _striped(key: np.ndarray, generation: int, stripe: np.ndarray) -> np.ndarray:
    return mix(key ^ mix(stripe.astype(np.uint64) + np.uint64((generation + 1) << 32)))


class Strings:
    """The strings of one batch in the global order, with what segments and probes need of them."""

    def __init__(self, b: pa.RecordBatch, freq: np.ndarray):
        col = lambda name: b.column(b.schema.get_field_index(name)).to_numpy()
        self.cid, self.load = col("cid"), col("load_no")
        tok, owner, self.size = _tokens(b, col("seed").astype(np.uint64))
        self.w1, self.w2 = signatures(tok, owner, len(self.size))
        self.excess = self.size - np.bitwise_count(self.w1) - np.bitwise_count(self.w2)
        order = np.lexsort((tok, freq[(tok & _SLOT).astype(np.int64)], owner))
        self.tok, self.owner = tok[order], owner[order]
        self.start = np.cumsum(self.size) - self.size
        self.pos = np.arange(len(tok)) - self.start[self.owner]

    def table(self, key, owner, pos, extra: dict[str, np.ndarray]) -> pa.RecordBatch:
        cols = {
            "key": key.view(np.int64), "cid": self.cid[owner], "load_no": self.load[owner].astype(np.int32), "n": self.size[owner].astype(np.int32), "pos": pos.astype(np.int32),
            **extra, "w1": self.w1[owner].view(np.int64), "w2": self.w2[owner].view(np.int64), "excess": self.excess[owner].astype(np.int32),
        }
        return pa.RecordBatch.from_arrays([pa.array(v) for v in cols.values()], names=list(cols))


def cut_segments(s: Strings, sim: tuple[int, int], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, owner, segment number, mask of the other symbols) of all segments of the strings."""
    p, q = sim
    count = s.size - -(-p * s.size // q) + 1
    of = s.pos % count[s.owner]
    head = s.pos < count[s.owner]
    rest = np.zeros(len(s.tok), np.uint64)
    tail = np.flatnonzero(~head)
    np.bitwise_or.at(rest, s.start[s.owner[tail]] + of[tail], np.uint64(1) << (s.tok[tail] >> np.uint64(58)))
    at = np.flatnonzero(head)
    length_class = np.searchsorted(bounds, s.size, side="right") - 1
    return _keys(s.tok[at], length_class[s.owner[at]]), s.owner[at], of[at], rest[at]


def select_probes(s: Strings, sim: tuple[int, int], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, owner, position) of the symbols with which the strings ask, per length class in reach."""
    p, q = sim
    nb = s.size
    least, most = np.maximum(1, -(-p * nb // q)), q * nb // p
    first = np.searchsorted(bounds, least, side="right") - 1
    out = []
    for d in range(3):
        c = first + d
        lo, hi = np.maximum(least, bounds[np.minimum(c, len(bounds) - 1)]), np.minimum(most, bounds[np.minimum(c + 1, len(bounds) - 1)] - 1)
        reach = (hi - -(-p * hi // q)) + nb - -(-(p * (lo + nb)) // (p + q))
        ask = (lo <= hi)[s.owner] & (s.pos <= reach[s.owner])
        at = np.flatnonzero(ask)
        out.append((_keys(s.tok[at], c[s.owner[at]]), s.owner[at], s.pos[at]))
    return tuple(np.concatenate(v) for v in zip(*out))


def bounded_distance(a: np.ndarray, a_off: np.ndarray, b: np.ndarray, b_off: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Insert/delete distance of each pair of ascending strings, bound + 1 where it is larger.

    Both strings of a pair follow one order without repeats, so the cheapest script is one merge; all
    pairs advance together and a pair leaves once it has passed its bound.
    """
    end = np.int64(1) << 40
    a, b = np.append(a, end), np.append(b, end)
    i, j, ie, je = a_off[:-1].copy(), b_off[:-1].copy(), a_off[1:], b_off[1:]
    edits = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    while len(live):
        x = np.where(i[live] < ie[live], a[i[live]], end)
        y = np.where(j[live] < je[live], b[j[live]], end)
        edits[live] += x != y
        i[live] += x <= y
        j[live] += y <= x
        live = live[((x < end) | (y < end)) & (edits[live] <= bound[live])]
    return np.minimum(edits, bound + 1)


def verified(pairs: DataFrame, sim: tuple[int, int] = SIM) -> DataFrame:
    """(a, b, load_a) of the pairs (a, b, load_a, grams_a, grams_b) within the distance that sim allows."""
    p, q = sim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_symbols([whole], "grams_a"):
                sides = []
                for c in (3, 4):
                    v, off = b.column(c), b.column(c).offsets.to_numpy().astype(np.int64)
                    sides += [v.values.to_numpy()[off[0] : off[-1]].view(np.uint32).astype(np.int64), off - off[0]]
                total = np.diff(sides[1]) + np.diff(sides[3])
                bound = total - 2 * -(-(p * total) // (p + q))
                ok = pa.array(bounded_distance(*sides, bound) <= bound)
                yield pa.RecordBatch.from_arrays([b.column(c).filter(ok) for c in range(3)], names=["a", "b", "load_a"])

    return pairs.select("a", "b", "load_a", "grams_a", "grams_b").mapInArrow(run, "a bigint, b bigint, load_a int")


class SegmentIndex:
    """Segments and strings of all loads so far. sets are rows (seed, cid, load_no, grams)."""

    def __init__(self, first: DataFrame, buckets: int = 8, sim: tuple[int, int] = SIM):
        self.spark = first.sparkSession
        self.sim, self.bounds = sim, length_bounds(sim)
        self.freq = self.spark.sparkContext.broadcast(frequency_sketch(first))  # fixed size: 4 MB
        self.segments = Bucketed(self.spark, "segments", SEGMENT, ["key"], buckets)
        self.strings = Bucketed(self.spark, "strings", STRING, ["cid"], buckets)
        self.stripes: list[np.ndarray | None] = []  # per append: stripes of each key slot, None without a hot one

    def intake(self, sets: DataFrame, load: int) -> DataFrame:
        """Store the strings of classes that the index does not hold yet and give them back: one shuffle by
        class serves the reduction to one row a class, the anti-join and the bucketed table."""
        placed = sets.select("seed", "cid", F.lit(load).alias("load_no"), "grams").repartition(self.strings.buckets, "cid")
        one = placed.groupBy("cid").agg(F.first("seed").alias("seed"), F.first("load_no").alias("load_no"), F.first("grams").alias("grams"))
        fresh = one.join(self.strings.read().select("cid"), "cid", "left_anti")
        self.strings.append_placed(fresh.select("seed", "cid", "load_no", "grams"))
        return self.strings.read().filter(F.col("load_no") == load)  # files of other loads are skipped by their statistics

    def _hot(self, fresh: DataFrame, strings: int) -> np.ndarray | None:
        """Stripes of each slot of first symbols in these strings; hashed to a fixed number of slots."""
        if strings <= BLOCK_ROWS:  # a key has one segment of a string at most
            return None
        freq, sim, bounds = self.freq, self.sim, self.bounds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = np.zeros(1 << SKETCH_BITS, np.int64)
            for b in by_symbols(batches):
                key = cut_segments(Strings(b, freq.value), sim, bounds)[0]
                acc += np.bincount((key & _SLOT).astype(np.int64), minlength=1 << SKETCH_BITS)
            at = np.flatnonzero(acc)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(acc[at])], names=["slot", "n"])

        slots = materialize(fresh.mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")), "slots")
        block = max(BLOCK_ROWS, 16 * (slots.agg(F.sum("n")).first()[0] or 0) >> SKETCH_BITS)
        hot = slots.filter(F.col("n") > block).toPandas()  # at most 2^SKETCH_BITS / 16 rows
        if not len(hot):
            return None
        out = np.ones(1 << SKETCH_BITS, np.int32)
        out[hot["slot"].to_numpy()] = -(-hot["n"].to_numpy() // block)
        return out

    def append(self, fresh: DataFrame, strings: int) -> None:
        """Add the segments of strings that intake gave; strings bounds their number."""
        hot = self._hot(fresh, strings)
        freq, sim, bounds, generation = self.freq, self.sim, self.bounds, len(self.stripes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in by_symbols(batches):
                s = Strings(b, freq.value)
                key, owner, number, rest = cut_segments(s, sim, bounds)
                if hot is not None:
                    n = hot[(key & _SLOT).astype(np.int64)]
                    stripe = mix(s.cid[owner].view(np.uint64)) % n.astype(np.uint64)
                    key = np.where(n > 1, _striped(key, generation, stripe), key)
                yield s.table(key, owner, number, {"rest": rest.view(np.int64)})

        self.segments.append(fresh.mapInArrow(run, SEGMENT))
        self.stripes.append(hot)

    def probes(self, sets: DataFrame) -> DataFrame:
        freq, sim, bounds = self.freq, self.sim, self.bounds
        hot = [(g, s) for g, s in enumerate(self.stripes) if s is not None]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in by_symbols(batches):
                s = Strings(b, freq.value)
                key, owner, pos = select_probes(s, sim, bounds)
                asked = [(key, owner, pos)]
                for g, stripes in hot:
                    n = stripes[(key & _SLOT).astype(np.int64)]
                    rep = np.repeat(np.flatnonzero(n > 1), n[n > 1])
                    stripe = np.arange(len(rep)) - np.repeat(np.cumsum(n[n > 1]) - n[n > 1], n[n > 1])
                    asked.append((_striped(key[rep], g, stripe), owner[rep], pos[rep]))
                for part in asked:
                    yield s.table(*part, {})

        return sets.mapInArrow(run, SEGMENT.replace("rest bigint, ", ""))

    def candidates(self, fresh: DataFrame, symbols: int) -> DataFrame:
        """Distinct (a, b, load_a) with b of these strings whose bounds allow the similarity; symbols bounds
        their length in sum."""
        p, q = self.sim
        mine = self.probes(fresh).withColumnsRenamed({c: f"b_{c}" for c in ("cid", "n", "pos", "w1", "w2", "excess")}).drop("load_no")
        if 3 * symbols <= HASHED_ROWS * self.segments.buckets:
            mine = mine.hint("shuffle_hash")  # the index streams past, unsorted
        na, nb = F.col("n"), F.col("b_n")
        need = F.expr(f"({p} * (n + b_n) + {p + q - 1}) div {p + q}")
        bound = F.bit_count(F.col("w1").bitwiseAND(F.col("b_w1"))) + F.bit_count(F.col("w2").bitwiseAND(F.col("b_w2"))) + F.least("excess", "b_excess")
        near = (na * q >= nb * p) & (nb * q >= na * p) & (F.col("b_pos") - F.col("pos") <= nb - need) & (F.col("pos") - F.col("b_pos") <= na - need)
        whole = F.col("rest").bitwiseAND(F.bitwise_not("b_w1")) == 0
        return self.segments.read().join(mine, "key").filter(near & whole & (bound >= need)).groupBy(F.col("cid").alias("a"), F.col("b_cid").alias("b")).agg(F.min("load_no").alias("load_a"))

    def probe(self, fresh: DataFrame, symbols: int) -> DataFrame:
        """Verified (a, b, load_a): class of the index, class of the batch, load that brought a."""
        stored = self.strings.read()
        pairs = self.candidates(fresh, symbols).join(stored.select(F.col("cid").alias("a"), F.col("grams").alias("grams_a")), "a")
        return verified(pairs.join(fresh.select(F.col("cid").alias("b"), F.col("grams").alias("grams_b")), "b"), self.sim)

    def drop(self) -> None:
        self.segments.drop()
        self.strings.drop()
        self.freq.unpersist()
