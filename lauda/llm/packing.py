"""Filling containers of fixed capacity: vector bin packing with the dot-product heuristic.

An item has three sizes: tokens, one segment, and loss-bearing tokens (those after the prompt, the
first block of a text of several blocks). A container limits all three. The open container takes,
among the items that fit, the one whose sizes have the largest dot product with what is left of the
container, each dimension weighted by its share of total demand; when none fits it is closed. A
document larger than the capacity is cut into full pieces and a remainder; nothing else is cut.

The loss limit lies between the corpus' own share of loss-bearing tokens and the capacity, so it binds:
a container cannot be filled with answers alone, and those that are short of prompts take in others. It
is a limit on putting items together; an item that alone bears more stands alone, since it may not be cut.

Items of equal token count form one list ordered by loss-bearing tokens, so a choice looks at the
distinct counts (at most the capacity), not at the items. Documents are spread over packing buckets
of about BUCKET_ITEMS items by hash; a bucket is the unit of memory, and costs at most one container
that is not full.

Edge cases: texts that are null or give no token, and rows without doc_id, are no items; the segment limit
is at least 1; in a corpus without prompts the loss limit is the capacity. Equal documents are packed each;
ties go to the smaller doc_id.
"""

from __future__ import annotations

import base64
import os
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lauda.llm.kernels import by_size

#: Where the public tokenizer's ranks are; a parameter, read where the tasks run.
TOKENIZER = os.environ.get("LAUDA_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: the split pattern the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKET_ITEMS = 10_000
ASSIGNMENT = "spec_id int, container_id bigint, doc_id bigint, piece_no int, token_start int, n_tokens int, loss_tokens int"
_BREAK = re.compile(r"\r?\n\s*\n")


@dataclass(frozen=True)
class Limits:
    """Limits of one container."""

    spec_id: int
    tokens: int
    segments: int
    loss: int

    @classmethod
    def of(cls, spec_id: int, capacity: int, tokens_per_segment: int = 32, loss_share: float = 1.0) -> "Limits":
        """loss_share: loss-bearing tokens that may stand together, as a share of the capacity."""
        return cls(spec_id, capacity, max(1, capacity // tokens_per_segment), max(1, int(capacity * loss_share)))


#: Where the loss limit lies between the corpus' share of loss-bearing tokens (0) and the capacity (1).
LOSS_HEADROOM = 0.5


def loss_share(tokens: int, prompt: int, headroom: float = LOSS_HEADROOM) -> float:
    """Share of a container that loss-bearing tokens may take, from the sums over the whole corpus."""
    own = 1 - prompt / tokens if tokens else 1.0
    return own + (1 - own) * headroom


def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("lauda", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, n_prompt) of every document with a token; whole texts, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in by_size(batches, 1):
            n = np.zeros(b.num_rows, np.int64)
            prompt = np.zeros(b.num_rows, np.int64)
            for i, t in enumerate(b.column(1).to_pylist()):
                if t:
                    n[i] = len(enc.encode_ordinary(t))
                    m = _BREAK.search(t)
                    if m and m.end() < len(t):
                        prompt[i] = min(n[i], len(enc.encode_ordinary(t[: m.start()])))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(n[at]), pa.array(prompt[at])], names=["doc_id", "n_tokens", "n_prompt"])

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, n_prompt bigint")


def cut(doc: np.ndarray, tokens: np.ndarray, prompt: np.ndarray, limit: Limits) -> tuple[np.ndarray, ...]:
    """(doc, piece, start, tokens, loss) of all pieces."""
    size = limit.tokens
    pieces = -(-tokens // size)
    row = np.repeat(np.arange(len(doc)), pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = piece * size
    n = np.minimum(size, tokens[row] - start)
    loss = n - np.clip(prompt[row] - start, 0, n)
    return doc[row], piece, start, n, loss


def pack(n: np.ndarray, loss: np.ndarray, limit: Limits) -> np.ndarray:
    """Container number of each item; items are given in order of doc and piece."""
    where = np.full(len(n), -1, np.int64)
    if not len(n):
        return where
    # lists per token count, loss ascending, later items first so that pop() takes the earliest
    order = np.lexsort((-np.arange(len(n)), loss, n))
    lists: dict[int, list[tuple[int, int]]] = {}
    for i in order.tolist():
        lists.setdefault(int(n[i]), []).append((int(loss[i]), -i))
    sizes = sorted(lists)
    weight = (n.sum() / limit.tokens, len(n) / limit.segments, loss.sum() / limit.loss)
    total = sum(weight)
    wt, ws, wl = (w / total for w in weight)
    binding = limit.loss < limit.tokens
    left, bin_no = len(n), 0
    while left:
        tokens, segments, room = limit.tokens, limit.segments, limit.loss
        while segments:
            # weights of this state: what is left, per dimension
            ct, cl = wt * tokens / limit.tokens**2, wl * room / limit.loss**2
            best, pick = -1.0, None
            k = bisect_right(sizes, tokens) - 1
            while k >= 0:
                s = sizes[k]
                items = lists[s]
                if best >= ct * s + cl * (s if segments == limit.segments else min(s, max(0, room))):  # no smaller count can do better
                    break
                at = len(items) - 1 if not binding or segments == limit.segments or items[-1][0] <= room else bisect_right(items, (room, 1)) - 1
                if at >= 0:
                    value = ct * s + cl * items[at][0]
                    if value > best:
                        best, pick = value, (s, at, k)
                k -= 1
            if pick is None:
                break
            s, at, k = pick
            lost, i = lists[s].pop(at)
            where[-i] = bin_no
            left -= 1
            tokens, segments, room = tokens - s, segments - 1, room - lost
            if not lists[s]:
                del lists[s], sizes[k]
        bin_no += 1
    return where


def assignments(counts: DataFrame, limits: list[Limits], buckets: int) -> DataFrame:
    """(spec_id, container_id, doc_id, piece_no, token_start, n_tokens, loss_tokens)."""
    if not limits:
        return counts.sparkSession.createDataFrame([], ASSIGNMENT)
    by_spec = {x.spec_id: x for x in limits}
    specs = F.array(*[F.lit(x.spec_id) for x in limits])  # a handful of container kinds
    rows = counts.select("doc_id", "n_tokens", "n_prompt", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket")).select(
        "*", F.explode(specs).alias("spec_id")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> pa.RecordBatch:
            spec, bucket = t.column("spec_id")[0].as_py(), t.column("bucket")[0].as_py()
            doc, piece, start, n, loss = cut(*(t.column(c).to_numpy() for c in ("doc_id", "n_tokens", "n_prompt")), by_spec[spec])
            at = pack(n, loss, by_spec[spec]) + (bucket << 32)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(doc), spec, np.int32)), pa.array(at), pa.array(doc), *(pa.array(c.astype(np.int32)) for c in (piece, start, n, loss))],
                names=["spec_id", "container_id", "doc_id", "piece_no", "token_start", "n_tokens", "loss_tokens"],
            )

        last = None
        for b in batches:
            t = pa.table(b)
            key = t.column("spec_id").to_numpy().astype(np.int64) << 32 | t.column("bucket").to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
            for x, y in zip(edges[:-1], edges[1:]):
                if last is not None and key[x] != last:
                    yield done(pa.concat_tables(held))
                    held = []
                held.append(t.slice(x, y - x))
                last = key[x]
        if held:
            yield done(pa.concat_tables(held))

    grouped = rows.repartition(max(len(limits), buckets * len(limits)), "spec_id", "bucket").sortWithinPartitions("spec_id", "bucket", "doc_id")
    return grouped.mapInArrow(run, ASSIGNMENT)
