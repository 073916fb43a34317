"""Subject areas of documents by interpolated n-gram language models.

One bigram model per area and one of the background, each interpolated with its unigrams and those
with the background's. A sentence's score for an area is the difference of the per-token
cross-entropies of background and area. Models are fitted on at most MAX_LABELLED labelled documents
and MAX_CHARS characters (those of smallest hash, so the sample doesn't depend on partitions):
document labels are handed down to sentences in ROUNDS rounds, each giving a sentence to the label of
its document that explains it best, or to none; the sentences given to none make a second background.
Acceptance is calibrated per area on held-out halves of the labelled documents: the score from which
a sentence counts is the one that makes the documents' areas agree best with the labels. A document
is about every area that holds at least SHARE of its sentences.

Applying the models covers every document whole, in one pass without a shuffle. Headings (short
blocks without closing punctuation) and mark-up are no sentences.

Edge cases: null, blank or heading-only texts have no sentence and no area; an area without labels is
never found; a document may have several areas or none; without any labels the result is empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lauda.llm import kernels as k
from lauda.session import materialize

MAX_LABELLED = 8000
MAX_CHARS = 64_000_000
ROUNDS = 3
SHARE = 0.25
L1, L2 = 0.8, 0.3
MARGIN, RIVAL = 0.15, 0.3
DEFAULT_ACCEPT = 0.5
GRID = np.round(np.arange(0.0, 1.0, 0.05), 2)

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_BLOCK = re.compile(r"\n\s*\n|\r\r+")
_SENTENCE = re.compile(r"(?<=[.!?:;…])[\"'»”)\]]*\s+")
_CLOSED = re.compile(r"[.!?:;…][\"'»”)\]]*\s*$")
HEADING_WORDS = 8


def sentences(text: str | None) -> list[list[str]]:
    """The sentences of a text as word lists."""
    if not text:
        return []
    t = _TAG.sub("\n\n", text.replace("\r\n", "\n")) if "<" in text else text.replace("\r\n", "\n")
    out = []
    for block in _BLOCK.split(t):
        parts = _SENTENCE.split(block)
        for s in parts:
            w = k.words(s)
            if w and (len(w) > HEADING_WORDS or _CLOSED.search(s)):
                out.append(w)
    return out


class Ids(dict):
    """Word ids by word without accents; new words get the next id, or -1 once frozen."""

    frozen = False

    def __init__(self):
        super().__init__()
        self.bare: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        b = k.bare(word)
        n = self.bare.get(b)
        if n is None:
            n = -1 if self.frozen else self.bare.setdefault(b, len(self.bare))
        if len(self) < 1 << 20:
            self[word] = n
        return n


def flatten(texts: list[str | None], ids: Ids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word ids, sentence offsets, sentences per text)."""
    flat: list[int] = []
    offsets, per = [0], np.zeros(len(texts), np.int64)
    get = ids.__getitem__
    for n, t in enumerate(texts):
        for s in sentences(t):
            flat.extend(map(get, s))
            offsets.append(len(flat))
            per[n] += 1
    return np.array(flat, np.int64), np.array(offsets, np.int64), per


@dataclass
class Models:
    """Log ratios to the background: per word, per known pair of words, and per area acceptance."""

    areas: list[str]
    vocabulary: dict[str, int]
    uni: np.ndarray  # words + 1 (unknown), areas + 1 (about none)
    keys: np.ndarray  # sorted pair keys
    bi: np.ndarray  # pairs, areas + 1
    accept: np.ndarray

    def scores(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per-token cross-entropy of the better background less that of the area, per sentence and area.

        Two backgrounds: all sentences (0 in the log ratios) and those about no area (the last column).
        """
        if not len(words):
            return np.zeros((len(offsets) - 1, len(self.areas)), np.float32)
        v = len(self.vocabulary)
        token = self.uni[words]  # unknown words have id -1: the last row, no evidence
        first = np.zeros(len(words), bool)
        first[offsets[:-1]] = True
        key = np.empty(len(words), np.int64)
        key[0], key[1:] = -1, words[:-1] * v + words[1:]
        key[first | (words < 0)] = -1
        key[1:][words[:-1] < 0] = -1
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            token[known] = self.bi[at[known]]
        sums = np.add.reduceat(token, offsets[:-1], axis=0)
        sums /= np.diff(offsets)[:, None]
        return sums[:, :-1] - np.maximum(sums[:, -1:], 0)


def estimate(words: np.ndarray, offsets: np.ndarray, owner: np.ndarray, v: int, areas: list[str], vocabulary: dict[str, int]) -> Models:
    """Models from sentences given to areas: owner is a weight matrix of sentences and areas; what is
    left of a sentence's weight goes to the model of sentences about none."""
    owner = np.column_stack([owner, np.maximum(0, 1 - owner.sum(1))])
    per = np.diff(offsets)
    sent = np.repeat(np.arange(len(per)), per)
    key = words[:-1] * v + words[1:]
    inside = sent[:-1] == sent[1:]
    key, left, of = key[inside], words[:-1][inside], sent[:-1][inside]
    keys, code = np.unique(key, return_inverse=True)
    heads = keys // v if v else keys
    tails = keys % v if v else keys
    total = np.bincount(words, minlength=v).astype(float)
    p0 = (total + 0.5) / (total.sum() + 0.5 * v)
    pair_total = np.bincount(code, minlength=len(keys)).astype(float)
    head_total = np.maximum(np.bincount(left, minlength=v), 1)
    bg2 = L2 * pair_total / head_total[heads] + (1 - L2) * p0[tails]
    uni, bi = np.zeros((v + 1, owner.shape[1]), np.float32), np.zeros((len(keys), owner.shape[1]), np.float32)
    for a in range(owner.shape[1]):
        w = owner[:, a]
        if not w.any():
            uni[:, a], bi[:, a] = -20, -20
            continue
        c1 = np.bincount(words, weights=w[sent], minlength=v)
        p1 = L1 * c1 / c1.sum() + (1 - L1) * p0
        c2 = np.bincount(code, weights=w[of], minlength=len(keys))
        head = np.bincount(left, weights=w[of], minlength=v)[heads]
        p2 = np.where(head > 0, L2 * c2 / np.maximum(head, 1e-9) + (1 - L2) * p1[tails], p1[tails])
        uni[:v, a] = np.log(p1 / p0)
        bi[:, a] = np.log(p2 / bg2)
    return Models(areas, vocabulary, uni, keys, bi, np.full(len(areas), DEFAULT_ACCEPT, np.float32))


def fit(texts: list[str | None], labels: list[set[str]], areas: list[str]) -> Models:
    """Models of all labelled documents; acceptance from two halves, each judged by the models of the
    other, since models know the word pairs of their own sentences too well."""
    models = _rounds(texts, labels, areas)
    halves = [range(h, len(texts), 2) for h in (0, 1)]
    held_out = []
    for mine, other in (halves, halves[::-1]):
        m = _rounds([texts[n] for n in mine], [labels[n] for n in mine], areas)
        ids = Ids()
        ids.bare, ids.frozen = m.vocabulary, True
        words, offsets, per = flatten([texts[n] for n in other], ids)
        held_out.append((m.scores(words, offsets), per, [labels[n] for n in other]))
    scores, per, real = zip(*held_out)
    models.accept = calibrate(np.concatenate(scores), np.concatenate(per), [x for r in real for x in r], areas)
    return models


def _rounds(texts: list[str | None], labels: list[set[str]], areas: list[str]) -> Models:
    ids = Ids()
    words, offsets, per = flatten(texts, ids)
    ids.frozen = True
    v = len(ids.bare)
    doc = np.repeat(np.arange(len(texts)), per)
    mask = np.array([[a in s for a in areas] for s in labels], bool).reshape(len(texts), len(areas))[doc]
    owner = mask / np.maximum(mask.sum(1, keepdims=True), 1)
    models = estimate(words, offsets, owner, v, areas, ids.bare)
    for _ in range(ROUNDS if v and areas else 0):
        s = models.scores(words, offsets)
        own = np.where(mask, s, -np.inf)
        best = own.argmax(1)
        top = own[np.arange(len(own)), best]
        owner = np.zeros_like(s)
        owner[np.arange(len(s)), best] = (top >= MARGIN) & (s.max(1) - top < RIVAL)
        models = estimate(words, offsets, owner, v, areas, ids.bare)
    return models


def calibrate(scores: np.ndarray, per: np.ndarray, labels: list[set[str]], areas: list[str]) -> np.ndarray:
    """Per area the middle of the scores that give the best F1 of documents against labels."""
    accept = np.full(len(areas), DEFAULT_ACCEPT, np.float32)
    if not len(scores) or not areas:
        return accept
    best, doc = scores.argmax(1), np.repeat(np.arange(len(per)), per)
    for a, name in enumerate(areas):
        real = np.array([name in s for s in labels])
        if not real.any():
            continue
        f1 = []
        for t in GRID:
            n = np.bincount(doc[(best == a) & (scores[:, a] >= t)], minlength=len(per))
            got = (n >= SHARE * per) & (n > 0)  # documents without sentences have none
            f1.append(2 * (got & real).sum() / max(1, got.sum() + real.sum()))
        at = np.flatnonzero(np.isclose(f1, max(f1)))
        accept[a] = GRID[at].mean()
    return accept


def train(docs: DataFrame, labels: DataFrame, areas: list[str]) -> Models:
    """Fit on the driver from the bounded sample of labelled documents."""
    chosen = (
        labels.filter(F.col("area_code").isin(areas))
        .groupBy("doc_id")
        .agg(F.collect_set("area_code").alias("codes"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MAX_LABELLED)
    )
    joined = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "labelled")
    n = F.length(F.coalesce("text", F.lit("")))
    so_far = F.sum(n).over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id"))  # at most MAX_LABELLED rows
    fits = joined.select("doc_id", so_far.alias("sum")).filter(F.col("sum") <= MAX_CHARS).select("doc_id").distinct()
    rows = joined.join(F.broadcast(fits), "doc_id").orderBy("doc_id").select("text", "codes").toPandas()
    return fit(rows["text"].tolist(), [set(c) for c in rows["codes"]], areas)


def area_counts(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, area_code, n_about, n_sentences) for every area with at least one sentence, and one
    row with a null area for the sentences about none."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the labelled sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        ids = Ids()
        ids.bare, ids.frozen = m.vocabulary, True
        names = [*m.areas, None]
        for b in k.by_size(batches, 1):
            words, offsets, per = flatten(b.column(1).to_pylist(), ids)
            if len(offsets) < 2 or not m.areas:
                continue
            s = m.scores(words, offsets)
            best = s.argmax(1)
            best[s[np.arange(len(s)), best] < m.accept[best]] = len(m.areas)
            doc = np.repeat(np.arange(len(per)), per)
            n = np.bincount(doc * len(names) + best, minlength=len(per) * len(names))
            at = np.flatnonzero(n)
            row = at // len(names)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array([names[x] for x in at % len(names)], pa.string()), pa.array(n[at].astype(np.int32)), pa.array(per[row].astype(np.int32))],
                names=["doc_id", "area_code", "n_about", "n_sentences"],
            )

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id bigint, area_code string, n_about int, n_sentences int")
