"""Evaluation passages leaking into documents: shared seeds and greedy string tiling.

A seed is a run of `seed` words. Document windows are tested against a bitmap of fixed size of all
item seeds, so most documents end there; the rest is joined with the items by seed, and each pair is
tiled: Karp-Rabin hashes of all windows of min_tile words give the windows that both texts have,
windows that follow one another on a diagonal grow together to maximal matches, and the longest match
of unmarked words is marked one after the other until none of min_tile words is left. Tiles don't
overlap, so a passage whose parts were put in another order still covers the item.

Edge cases: texts that are null or shorter than a seed give no row; an item or document that occurs
twice gives its pair once; runs never cross a text; mark-up counts as words.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lauda.llm import kernels as k
from lauda.session import checked_broadcast, materialize

BITMAP_BITS = 26
_BASE = 0x9E3779B97F4A7C15 | 1


def windows(h: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every window of `size` words that lies inside one text."""
    if len(h) < size:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    acc = h[: len(h) - size + 1].copy()
    for d in range(1, size):
        acc *= np.uint64(_BASE)
        acc += h[d : len(h) - size + 1 + d]
    ends = np.repeat(offsets[1:], np.diff(offsets))
    at = np.flatnonzero(np.arange(len(acc)) + size <= ends[: len(acc)])
    return k.mix(acc[at]), at


def maximal_matches(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(doc start, item start, length) of all common runs of `least` words or more that cannot be extended."""
    have, d_at = windows(doc, np.array([0, len(doc)]), least)
    want, i_at = windows(item, np.array([0, len(item)]), least)
    order = np.argsort(want, kind="stable")
    want, i_at = want[order], i_at[order]
    lo, hi = np.searchsorted(want, have, side="left"), np.searchsorted(want, have, side="right")
    n = hi - lo
    rep = np.repeat(np.arange(len(have)), n)
    d, i = d_at[rep], i_at[np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n) + lo[rep]]
    if not len(d):
        return []
    order = np.lexsort((d, d - i))
    d, i = d[order], i[order]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(d) != 1) | (np.diff(d - i) != 0))))
    size = np.diff(np.append(first, len(d))) + least - 1
    return list(zip(d[first].tolist(), i[first].tolist(), size.tolist()))


def greedy_tiles(doc, item, min_tile: int) -> list[tuple[int, int, int]]:
    """Non-overlapping matches (doc start, item start, length), longest first, of min_tile words or more.

    Matches wait in a heap by length; one that lost words to an earlier tile goes back with what is left of it.
    """
    doc, item = (np.array(x, dtype=object).astype(np.uint64) if not isinstance(x, np.ndarray) else x for x in (doc, item))
    waiting = [(-n, i, d) for d, i, n in maximal_matches(doc, item, min_tile)]
    heapq.heapify(waiting)
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    while waiting:
        n, i, d = heapq.heappop(waiting)
        open_ = free_d[d : d - n] & free_i[i : i - n] & (doc[d : d - n] == item[i : i - n])  # the words themselves, not their hashes
        if open_.all():
            tiles.append((d, i, -n))
            free_d[d : d - n] = free_i[i : i - n] = False
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([False], open_, [False])).astype(np.int8)))
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if end - start >= min_tile:
                heapq.heappush(waiting, (start - end, i + start, d + start))
    return tiles


def coverage_bound(doc: np.ndarray, item: np.ndarray, min_tile: int) -> int:
    """Item words inside runs of min_tile words that the document has too: tiles cover no others."""
    own, at = windows(item, np.array([0, len(item)]), min_tile)
    hit = at[np.isin(own, windows(doc, np.array([0, len(doc)]), min_tile)[0])]
    mark = np.zeros(len(item), bool)
    for d in range(min_tile):
        mark[hit + d] = True
    return int(mark.sum())


def item_seeds(items: DataFrame, seed: int) -> DataFrame:
    """(item_id, words, seeds) per item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, off = k.hash_texts(b.column(1).to_pylist())
            w, at = windows(h, off, seed)
            owner = np.searchsorted(off, at, side="right") - 1
            cut = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=b.num_rows))))
            yield pa.RecordBatch.from_arrays([b.column(0), k.list_array(h.view(np.int64), off), k.list_array(w.view(np.int64), cut)], names=["item_id", "item_words", "seeds"])

    return items.select("item_id", "text").mapInArrow(run, "item_id bigint, item_words array<bigint>, seeds array<bigint>")


def seed_bitmap(items: DataFrame) -> np.ndarray:
    """Bitmap of 2^BITMAP_BITS bits of all item seeds: its size doesn't grow with the items."""
    slot = F.shiftrightunsigned(F.col("s"), 64 - BITMAP_BITS)
    words = items.select(F.explode("seeds").alias("s")).groupBy(F.shiftright(slot, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(s, {64 - BITMAP_BITS}) & 63 as int))")).alias("bits"))
    rows = words.toPandas()  # at most 2^(BITMAP_BITS - 6) rows of 12 bytes
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    out[rows["w"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint8)


def seeded_documents(docs: DataFrame, bitmap: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, doc_words, seeds) of the documents with at least one window in the bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in k.by_size(batches, 1):
            h, off = k.hash_texts(b.column(1).to_pylist())
            w, at = windows(h, off, seed)
            slot = (w >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
            hit = (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
            w, at = w[hit], at[hit]
            owner = np.searchsorted(off, at, side="right") - 1
            rows, first = np.unique(owner, return_index=True)
            if not len(rows):
                continue
            cut = np.append(first, len(w))
            doc_words = pa.array([h[off[r] : off[r + 1]].view(np.int64) for r in rows], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), doc_words, k.list_array(w.view(np.int64), cut)], names=["doc_id", "doc_words", "seeds"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, doc_words array<bigint>, seeds array<bigint>")


def leaks(docs: DataFrame, items: DataFrame, seed: int, min_tile: int, least: tuple[int, int] = (0, 1)) -> DataFrame:
    """(doc_id, item_id, longest, n_tiles, covered, item_words) of every pair that shares a seed; a seed
    above min_tile leaves out pairs whose tiles are all shorter than a seed. Pairs whose bound shows
    that they cover less than the fraction `least` of the item are not tiled and give no row."""
    its = materialize(item_seeds(items.filter("item_id is not null").dropDuplicates(["item_id"]), seed), "items")
    hits = materialize(seeded_documents(docs.filter("doc_id is not null"), seed_bitmap(its), seed), "leak-docs")
    seeds = its.select("item_id", F.explode("seeds").alias("s")).distinct()
    pairs = hits.select("doc_id", F.explode("seeds").alias("s")).distinct().join(checked_broadcast(seeds), "s").select("doc_id", "item_id").distinct()
    both = pairs.join(hits.drop("seeds"), "doc_id").join(checked_broadcast(its.select("item_id", "item_words")), "item_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, kept = [], []
            (doc, doc_off), (item, item_off) = ((c.values.to_numpy().view(np.uint64), c.offsets.to_numpy()) for c in (b.column(2), b.column(3)))
            for r in range(b.num_rows):
                d, i = doc[doc_off[r] : doc_off[r + 1]], item[item_off[r] : item_off[r + 1]]
                if least[0] and coverage_bound(d, i, min_tile) * least[1] < len(i) * least[0]:
                    continue
                t = greedy_tiles(d, i, min_tile)
                kept.append(r)
                out.append((max((n for _, _, n in t), default=0), len(t), sum(n for _, _, n in t), len(i)))
            cols = [b.column(0).take(pa.array(kept)), b.column(1).take(pa.array(kept)), *(pa.array(c, pa.int32()) for c in zip(*out))] if out else None
            if cols:
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "longest", "n_tiles", "covered", "n_words"])

    spread = both.select("doc_id", "item_id", "doc_words", "item_words").repartition(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "item_id")
    tiled = spread.mapInArrow(
        run, "doc_id bigint, item_id bigint, longest int, n_tiles int, covered int, n_words int"
    )
    # a document delivered twice has two rows; the one that covers more of the item speaks for it
    best = F.max(F.struct("covered", "longest", "n_tiles", "n_words")).alias("b")
    return tiled.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.longest", "b.n_tiles", "b.covered", "b.n_words")
