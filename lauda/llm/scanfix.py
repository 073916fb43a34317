"""Repair of text taken from scanned pages: misread words, cut words, running heads, page numbers.

Four passes. (1) Count words and line shapes over all pages and statements; words that occur MIN_COUNT
times make the lexicon, kept as a trie in arrays. (2) Learn confusions: every word outside the lexicon is
looked up among the far more frequent ones, and what recurs in the aligned differences of many words, but
not between words of the lexicon themselves, is a confusion of this collection's recognizer; the fixed
list below is only where it starts. (3) Look at the edge lines of every page: running heads repeat in
their document or have a shape that is found at page edges only, page numbers keep a constant distance
from the page's position. (4) Go through the lines: words outside the lexicon are looked up by
intersecting Levenshtein automata with the trie (complete up to two edits); a word is misread when
confusions explain its difference from a candidate, or when it holds characters no word has; candidates are
ranked by their neighbours and presence on the same page, then by frequency; words cut at a line or page
end are joined unless their hyphen was printed. A misreading that is itself a word of the lexicon is not
questioned.

The lexicon's floor is a fixed count, so a page is judged alike in collections of any size as far as its
words are known there. Lexicon and line shapes are what is broadcast, once; their size follows the
vocabulary, not the text (the trie takes some 16 bytes a node). Page context comes by joins on (document,
page), never by gathering a document.

Edge cases: null texts have no line; blank lines are counted but never reported; a page without
number takes part with itself only; a line reported for several copies of a page is reported once;
a page that cuts a word at its end uses the next page's first body word if that page is there; words of
more than 61 characters are compared by plain dynamic programming.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lauda.llm.kernels import by_size
from lauda.session import materialize, release

MIN_COUNT = 3
RIVAL_RATIO = 50
EDGE_SHARE = 0.9
#: Lines from each end of a page that may be furniture whatever lies before them; further ones may be as long
#: as all lines between them and the end may.
EDGE_LINES = 3
#: Lines from each end whose shapes count as seen at the edge; the others speak for the inside.
COUNTED_LINES = 2
#: A learned confusion: in so many words at least, so many times as often as between words of the lexicon.
LEARNED_WORDS, LEARNED_RATIO = 8, 4
#: ... and in such a share of all words that differ from a frequent one, explained ones included, so that chance among more words teaches no more.
LEARNED_SHARE = 0.005
#: How many times as frequent the word must be that a learned confusion is aligned with.
LEARNED_RIVAL = 10
#: What a candidate gains over one that is e times as frequent: per neighbour it has elsewhere on the page, for being there.
NEIGHBOUR_WEIGHT, PAGE_WEIGHT = 3.0, 2.0
#: Length up to which an automaton fits a machine word.
AUTOMATON_CHARS = 61
#: Words looked up in the trie together.
QUERY_BLOCK = 512
HYPHENS = "-‐­¬‑"

#: What a recognizer takes a letter for, several characters first.
CONFUSIONS = [
    ("p", "|o"), ("v", "\\/"), ("n", "ri"), ("d", "cl"), ("m", "rn"), ("u", "ii"), ("h", "li"),
    ("a", "@"), ("e", "c"), ("o", "0"), ("i", "!"), ("r", "�"), ("t", "f"), ("c", "("), ("l", "1"), ("s", "5"),
    ("g", "9"), ("b", "6"), ("ã", "ä"), ("ç", "¢"), ("q", "g"), ("í", "f"), ("b", "8"), ("z", "2"), ("s", "$"),
    ("a", "4"),
]
_MULTI = [(seen, real) for real, seen in CONFUSIONS if len(seen) > 1]
#: One character per class of characters that are taken for one another.
_CLASS = str.maketrans({
    "@": "a", "c": "e", "(": "e", "0": "o", "!": "i", "l": "i", "1": "i", "|": "i", "�": "r", "f": "t", "í": "t",
    "4": "a", "5": "s", "$": "s", "9": "g", "q": "g", "6": "b", "8": "b", "2": "z", "ä": "ã", "¢": "e", "ç": "e",
})
_ALIEN = re.compile(r"[^\W\d_][0-9@|\\!(¢$�]|[0-9@|\\!(¢$�][^\W\d_]|�|ä|¢|@")
_ORDINAL = re.compile(r"^\d+(?:[ºªoa°]s?|h\d*|m|km|kg|%)$")
_OUTER = ".,;:?\"'“”«»‘’*…)]}–—"
_OPEN = "\"'“”«»‘’*([{¿¡–—…"
_NUMBER = re.compile(r"^\W*(?:([^\W\d]{1,8}|p[^\W\d]?9ina|[^\W\d]{2}9)\W{0,2})?\s*(\d{1,4})(?:\s*(?:/|de)\s*\d{1,4})?\W*$", re.I)
_DIGIT = re.compile(r"\d")
_SUFFIX = re.compile(r"^(.*\S)\s{2,}(\S.*)$")
_PAGE_WORDS = {"pagina", "pag", "p", "folha", "fl", "fls", "pg"}
_CUT_NEXT = re.compile(f"[^\\W\\d_][{HYPHENS}]\\s*\\n\\s*(\\S+)")


def skeleton(word: str) -> str:
    """A form that a word and its misread variants share."""
    w = word
    for seen, real in _MULTI:
        if seen in w:
            w = w.replace(seen, real)
    return w.translate(_CLASS)


def flat_skeleton(word: str) -> str:
    """Skeleton by single characters only, for words in which a run merely looks like a misread one."""
    return word.translate(_CLASS)


def by_first(pairs: list[tuple[str, str]]) -> dict[str, list[tuple[str, str]]]:
    """Confusions by the first real character."""
    out: dict[str, list[tuple[str, str]]] = {}
    for real, seen in pairs:
        out.setdefault(real[0], []).append((real, seen))
    return out


_BY_FIRST = by_first(CONFUSIONS)


def confusable(real: str, seen: str, table: dict[str, list[tuple[str, str]]] = _BY_FIRST) -> bool:
    """Whether confusions alone, at least one, turn the real word into the seen one."""
    states = {(0, 0)}
    done = False
    while states:
        following = set()
        for i, j in states:
            if i == len(real) and j == len(seen):
                done = True
                continue
            if i < len(real):
                if j < len(seen) and real[i] == seen[j]:
                    following.add((i + 1, j + 1))
                for r, s in table.get(real[i], ()):
                    if real.startswith(r, i) and seen.startswith(s, j):
                        following.add((i + len(r), j + len(s)))
        states = following
    return done and real != seen


def difference(real: str, seen: str) -> tuple[str, str]:
    """What is left of both words without their common start and end."""
    most = min(len(real), len(seen))
    a = next((k for k in range(most) if real[k] != seen[k]), most)
    b = next((k for k in range(most - a) if real[-1 - k] != seen[-1 - k]), most - a)
    return real[a : len(real) - b], seen[a : len(seen) - b]


def core(token: str) -> str:
    """A token in lower case without the punctuation around it."""
    t = token.rstrip(_OUTER + "!").lstrip(_OPEN)
    return t.lower()


def _plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))


def page_number(text: str) -> tuple[int, bool] | None:
    """(number, unmistakable) of a line that is only a page number."""
    m = _NUMBER.match(text)
    if not m or any(c not in "-–—[]()|./•·" and not c.isspace() and not c.isalnum() for c in text):
        return None
    word = _plain(m.group(1) or "").replace("9", "g")
    if word and word not in _PAGE_WORDS and skeleton(word) not in {skeleton(w) for w in _PAGE_WORDS}:
        return None
    marked = bool(word) or "/" in text or " de " in text or not text.strip().isdigit()
    if text.strip().rstrip(".").isdigit() and text.strip().endswith("."):
        marked = False
    return int(m.group(2)), marked


def head_of(line: str) -> tuple[str, int | None]:
    """(line without a page number set apart at its end or start, that number)."""
    m = _SUFFIX.match(line.rstrip())
    if m and (n := page_number(m.group(2))):
        return m.group(1), n[0]
    if m and (n := page_number(m.group(1))) and n[1]:
        return m.group(2), n[0]
    return line.strip(), None


def shape(line: str) -> str:
    """Line with capitalised words as X, upper case words as U and digits as 9."""
    out = []
    for t in line.split():
        w = t.translate(str.maketrans({"0": "o", "1": "i", "4": "a", "5": "s", "9": "g", "6": "b", "!": "i", "@": "a", "(": "(", "�": "r"})) if _ALIEN.search(t) and not t.strip("()").isdigit() else t
        letters = [c for c in w if c.isalpha()]
        if not letters:
            out.append(re.sub(r"\d+", "9", w))
        elif len(letters) > 1 and all(c.isupper() for c in letters):
            out.append(re.sub(r"[^\W\d_]+", "U", re.sub(r"\d+", "9", w)))
        elif letters[0].isupper():
            out.append(re.sub(r"[^\W\d_]+", "X", w))
        else:
            out.append(w.lower() if len(letters) < 4 else "w")
    return " ".join(out)


def _could_be_head(line: str) -> bool:
    """Cheap test before any pattern: no sentence end, and not a lower-case start."""
    x = line.strip()
    return x[-1] not in ".:;?!," and (x[0].isupper() or not x[0].isalpha()) and x[0] != "("


def _looks_titled(line: str) -> bool:
    """Two or more capitalised words and at least half of all words capitalised, numbers or marks."""
    words = shape(line).split()
    high = sum(w[0] in "XU9|–—-«(" for w in words)
    return sum(c in "XU" for w in words for c in w[:2]) >= 2 and 2 * high >= len(words)


def short_key(text: str) -> str:
    """The text, or a 128-bit digest of a long one: equal for equal texts only, of bounded size."""
    return text if len(text) <= 160 else "#" + xxhash.xxh3_128_hexdigest(text.encode())


def shape_key(line: str) -> str:
    return short_key(shape(line))


def within_edits(a: str, b: str, most: int) -> int:
    """Edit distance of two long words, most + 1 where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


# ---------------------------------------------------------------------------------- lexicon trie


@dataclass
class Trie:
    """Lexicon trie in arrays: children of a node are consecutive, breadth first."""

    chars: np.ndarray  # character id of each node
    first: np.ndarray  # first child
    last: np.ndarray  # one past the last child
    word: np.ndarray  # word number or -1
    alphabet: dict[str, int]
    words: list[str]
    long: list[str] = field(default_factory=list)  # words that a query beyond AUTOMATON_CHARS can be near to

    @classmethod
    def build(cls, words: list[str]) -> "Trie":
        words = sorted(words)
        alphabet = {c: n for n, c in enumerate(sorted({c for w in words for c in w}))}
        chars, first, last, word = [0], [], [], [-1]
        level = [(0, len(words), 0)]  # (from, to, depth) of each node of this level
        while level:
            following = []
            for lo, hi, d in level:
                first.append(len(chars))
                k = lo
                while k < hi and len(words[k]) == d:
                    k += 1
                while k < hi:
                    c, e = words[k][d], k
                    while e < hi and words[e][d] == c:
                        e += 1
                    chars.append(alphabet[c])
                    word.append(k if len(words[k]) == d + 1 else -1)
                    following.append((k, e, d + 1))
                    k = e
                last.append(len(chars))
            level = following
        return cls(*(np.array(x, np.int32) for x in (chars, first, last, word)), alphabet, words, [w for w in words if len(w) >= AUTOMATON_CHARS - 1])

    def within(self, queries: list[str], edits: list[int]) -> list[list[tuple[str, int]]]:
        """All words within that many edits of each query, with their distance: the automata of all
        queries run over the trie together, one bit per position and edit count."""
        out: list[list[tuple[str, int]]] = [[] for _ in queries]
        if not len(self.words):
            return out
        use = [n for n, q in enumerate(queries) if 0 < len(q) <= AUTOMATON_CHARS]
        for n, q in enumerate(queries):
            if len(q) > AUTOMATON_CHARS:
                out[n] = [(w, d) for w in self.long if (d := within_edits(q, w, edits[n])) <= edits[n]]
        if len(use) > QUERY_BLOCK:  # the frontier grows with the queries that run together
            for c in range(0, len(use), QUERY_BLOCK):
                part = use[c : c + QUERY_BLOCK]
                for n, found in zip(part, self.within([queries[n] for n in part], [edits[n] for n in part])):
                    out[n] = found
            return out
        if not use:
            return out
        masks = np.zeros((len(queries), len(self.alphabet)), np.uint64)
        for n in use:
            for p, c in enumerate(queries[n]):
                a = self.alphabet.get(c)
                if a is not None:
                    masks[n, a] |= np.uint64(1 << p)
        size = np.array([len(q) for q in queries])
        valid = np.array([(1 << (min(s, 62) + 1)) - 1 for s in size], np.uint64)
        most = np.array(edits)
        one = np.uint64(1)
        q = np.array(use, np.int64)
        node = np.zeros(len(q), np.int64)
        r0, r1, r2 = np.full(len(q), 1, np.uint64), np.full(len(q), 3, np.uint64), np.full(len(q), 7, np.uint64)
        while len(q):
            n = self.last[node] - self.first[node]
            rep = np.repeat(np.arange(len(q)), n)
            if not len(rep):
                break
            child = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n) + self.first[node][rep]
            q, p0, p1, p2 = q[rep], r0[rep], r1[rep], r2[rep]
            m, v = masks[q, self.chars[child]], valid[q]
            r0 = ((p0 & m) << one) & v
            r1 = (((p1 & m) << one) | p0 | (p0 << one) | (r0 << one)) & v
            r2 = (((p2 & m) << one) | p1 | (p1 << one) | (r1 << one)) & v
            alive = np.where(most[q] > 1, r2, r1) != 0
            q, node, r0, r1, r2 = q[alive], child[alive], r0[alive], r1[alive], r2[alive]
            end = one << size[q].astype(np.uint64)
            reach = np.where(r0 & end, 0, np.where(r1 & end, 1, np.where((r2 & end != 0) & (most[q] > 1), 2, 9)))
            hit = np.flatnonzero((self.word[node] >= 0) & (reach < 9))
            for h in hit.tolist():
                out[q[h]].append((self.words[self.word[node[h]]], int(reach[h])))
        return out


@dataclass
class Model:
    """What the first pass learned."""

    lexicon: dict[str, int]
    shapes: dict[str, tuple[int, int]]
    skeletons: dict[str, str] = field(default_factory=dict)
    flat: dict[str, str] = field(default_factory=dict)
    trigrams: Counter = field(default_factory=Counter)
    trie: Trie | None = None
    start: list[tuple[str, str]] = field(default_factory=lambda: CONFUSIONS)
    learned: list[tuple[str, str]] = field(default_factory=list)
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def prepare(self) -> "Model":
        """Drop lexicon entries that look like misread forms of far more frequent ones; build the trie."""
        top: dict[str, str] = {}
        for w, n in sorted(self.lexicon.items()):
            s = skeleton(w)
            if s not in top or n > self.lexicon[top[s]]:
                top[s] = w
        self.lexicon = {
            w: n for w, n in self.lexicon.items() if n * RIVAL_RATIO > self.lexicon[top[skeleton(w)]] and (not _ALIEN.search(w) or w.isdigit())
        }
        self.lexicon = {w: n for w, n in self.lexicon.items() if not self._outdone(w, n)}
        self.skeletons = {s: w for s, w in top.items() if w in self.lexicon}
        for w, n in sorted(self.lexicon.items()):
            s = flat_skeleton(w)
            if n > self.lexicon.get(self.flat.get(s, ""), 0):
                self.flat[s] = w
        for w in self.lexicon:
            if w.isalpha():
                x = f"^{w}$"
                self.trigrams.update({x[i : i + 3] for i in range(len(x) - 2)})
        self.trie = Trie.build([w for w in self.lexicon if len(w) > 1])
        return self

    def _outdone(self, word: str, n: int) -> bool:
        """Whether undoing one confusion gives a word that is RIVAL_RATIO times as frequent."""
        for real, seen in self.start:
            at = word.find(seen)
            while at >= 0:
                if self.lexicon.get(word[:at] + real + word[at + len(seen) :], 0) >= RIVAL_RATIO * n:
                    return True
                at = word.find(seen, at + 1)
        return False

    def is_head_shape(self, line: str) -> bool | None:
        """True or False where the shape is known well enough, else None. A head has a capitalised
        word and no closing punctuation."""
        if line.rstrip()[-1:] in ".:;?!," or not re.search(r"[^\W\d_]", line) or not any(c.isupper() for c in line):
            return False
        if not _looks_titled(line):
            return False
        edge, inner = self.shapes.get(shape_key(line), (0, 0))
        if edge + inner < 3:
            return None
        return edge >= EDGE_SHARE * (edge + inner)


def count_pass(texts: DataFrame) -> DataFrame:
    """(kind, key, n, m): words with their count, line shapes with counts at page edges and inside.

    texts is (is_page boolean, text).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: Counter = Counter()
        edge: Counter = Counter()
        inner: Counter = Counter()
        limit = 500_000

        def flush() -> pa.RecordBatch:
            words: Counter = Counter()
            for t, n in raw.items():
                if "!" in t or ("(" in t) != (")" in t):  # may hide a misread letter at its edge
                    continue
                w = core(t)
                if w and any(c.isalpha() for c in w) and w[-1] not in HYPHENS:
                    words[w] += n
            keys = [k for k in edge.keys() | inner.keys()]
            kind = ["w"] * len(words) + ["s"] * len(keys)
            out = pa.RecordBatch.from_arrays(
                [pa.array(kind), pa.array([*words, *keys]), pa.array([*words.values(), *(edge[k] for k in keys)], pa.int64()), pa.array([0] * len(words) + [inner[k] for k in keys], pa.int64())],
                names=["kind", "key", "n", "m"],
            )
            raw.clear(), edge.clear(), inner.clear()
            return out

        for b in by_size(batches, 1):
            for page, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t:
                    continue
                t = unicodedata.normalize("NFC", t)
                raw.update(t.split())
                raw.subtract(_CUT_NEXT.findall(t))
                if page:
                    lines = [x for x in t.split("\n") if x.strip()]
                    for n, x in enumerate(lines):
                        if _could_be_head(x):
                            h, num = head_of(x)
                            near = n < COUNTED_LINES or n >= len(lines) - COUNTED_LINES
                            (edge if near else inner)[shape_key(h)] += 1
            if len(raw) + len(edge) + len(inner) > limit:
                yield flush()
        yield flush()

    return texts.mapInArrow(run, "kind string, key string, n bigint, m bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def learn(texts: DataFrame, start: list[tuple[str, str]] | None = None) -> Model:
    """The model of all texts: words and shapes from MIN_COUNT occurrences on, confusions learned beyond those
    it starts with (the fixed list, unless given)."""
    counts = materialize(count_pass(texts), "scan-counts")
    kept = counts.filter(((F.col("kind") == "w") & (F.col("n") >= MIN_COUNT)) | ((F.col("kind") == "s") & (F.col("n") >= 1) & (F.col("n") + F.col("m") >= MIN_COUNT))).toPandas()
    words = kept[kept["kind"] == "w"]
    shapes = kept[kept["kind"] == "s"]
    model = Model(dict(zip(words["key"], words["n"])), {k: (n, m) for k, n, m in zip(shapes["key"], shapes["n"], shapes["m"])})
    model.start = CONFUSIONS if start is None else start
    model.prepare()
    model.learned = learned_confusions(counts.filter("kind = 'w'").select("key", "n"), model)
    release(counts)
    return model


def _is_confusion(d: tuple[str, str]) -> bool:
    return all(1 <= len(part) <= 2 for part in d)


def block_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(key, number of the word): hash of what is left of a word around each block of one or two characters.
    Words that differ in such a block only share a key."""
    keys = [(xxhash.xxh3_64_intdigest(f"{w[:i]}\0{w[i + k :]}"), n) for n, w in enumerate(words) for k in (1, 2) for i in range(len(w) - k + 1)]
    return np.array([k for k, _ in keys], np.uint64), np.array([n for _, n in keys], np.int64)


def learned_confusions(words: DataFrame, model: Model) -> list[tuple[str, str]]:
    """(real, seen) differences of up to two characters that many words outside the lexicon have from the one
    far more frequent word nearest to them, and that frequent words rarely have among themselves.

    Partners are found by the block keys of the words frequent enough to be one, in sorted arrays.
    """
    partners = [w for w, n in sorted(model.lexicon.items()) if n >= LEARNED_RIVAL and len(w) > 3]
    keys, numbers = block_keys(partners)
    order = np.argsort(keys, kind="stable")
    shared = words.sparkSession.sparkContext.broadcast((model, partners, keys[order], numbers[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, common, held, owner = shared.value
        start = by_first(m.start)
        found: Counter = Counter()
        natural: Counter = Counter()

        def explained(w: str) -> bool:
            """Whether a confusion that the model starts with explains the word: it teaches nothing new."""
            real = m.skeletons.get(skeleton(w))
            return real is not None and confusable(real, w, start)

        for b in batches:
            rows = []
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(w) > 3 and n > 0:
                    if n >= LEARNED_RIVAL if w in m.lexicon else not explained(w):
                        rows.append((w, n))
                    elif w not in m.lexicon:
                        found["", ""] += 1  # counts among all differences
            asked, of = block_keys([w for w, _ in rows])
            lo, hi = np.searchsorted(held, asked, side="left"), np.searchsorted(held, asked, side="right")
            rep = np.repeat(np.arange(len(asked)), hi - lo)
            hit = owner[np.arange(len(rep)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[rep]]
            near: dict[int, set[str]] = {}
            for k, x in {*zip(of[rep].tolist(), hit.tolist())}:
                near.setdefault(k, set()).add(common[x])
            for k, others in near.items():
                w, n = rows[k]
                apart = [(difference(x, w), x) for x in others if x != w]
                if w in m.lexicon:
                    natural.update(d for d, _ in apart if _is_confusion(d))
                    continue
                strong = [(max(map(len, d)), d) for d, x in apart if m.lexicon[x] >= LEARNED_RIVAL * n]
                least = min((e for e, _ in strong), default=0)
                best = [d for e, d in strong if e == least]
                if len(best) == 1 and _is_confusion(best[0]):
                    found[best[0]] += 1
        pairs = list(found.keys() | natural.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in pairs], pa.string()), pa.array([k[1] for k in pairs], pa.string()), pa.array([found[k] for k in pairs], pa.int64()), pa.array([natural[k] for k in pairs], pa.int64())],
            names=["real", "seen", "found", "natural"],
        )

    counted = materialize(words.mapInArrow(run, "real string, seen string, found bigint, natural bigint").groupBy("real", "seen").agg(F.sum("found").alias("found"), F.sum("natural").alias("natural")), "differences")
    back = counted.select(F.col("seen").alias("real"), F.col("real").alias("seen"), F.col("found").alias("back"))
    against = F.col("natural") + F.coalesce("back", F.lit(0))  # names differ either way, a recognizer errs one way
    least = F.greatest(F.lit(LEARNED_WORDS), F.ceil(LEARNED_SHARE * F.lit(counted.agg(F.sum("found")).first()[0] or 0)))
    rows = counted.join(back, ["real", "seen"], "left").filter((F.col("real") != "") & (F.col("found") >= least) & (F.col("found") >= LEARNED_RATIO * against)).collect()  # pairs of at most two characters each
    release(counted)
    shared.unpersist()
    return sorted((r.real, r.seen) for r in rows if (r.real, r.seen) not in model.start)


# ---------------------------------------------------------------------------------- page edges


def _edge_reach(lines: list[str]) -> int:
    """How many lines from the start may be furniture: EDGE_LINES, or all up to the first that cannot be."""
    if len(lines) <= EDGE_LINES or not (_could_be_head(lines[EDGE_LINES]) or _DIGIT.search(lines[EDGE_LINES])):
        return EDGE_LINES
    n = 0
    while n < len(lines) and ((_could_be_head(lines[n]) and _looks_titled(lines[n])) or page_number(lines[n])):
        n += 1
    return max(EDGE_LINES, n)


def edge_lines(pages: DataFrame, shared) -> DataFrame:
    """The edge lines with text of every page, as far as they could be furniture; shared is the broadcast model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in by_size(batches, 2):
            out: list[tuple] = []
            for doc, page, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if not t:
                    continue
                lines = [(n, x) for n, x in enumerate(unicodedata.normalize("NFC", t).split("\n"), 1) if x.strip()]
                texts = [x for _, x in lines]
                reach, back = _edge_reach(texts), _edge_reach(texts[::-1])
                if max(reach, back) >= len(lines):  # a page of titles alone has no body to be set off from
                    reach, back = EDGE_LINES, EDGE_LINES
                for k, (n, x) in enumerate(lines):
                    top, bottom = k < reach, k >= len(lines) - back
                    if not top and not bottom:
                        continue
                    outer = k == 0 or k == len(lines) - 1
                    words = x.split()
                    pure = page_number(x) if len(words) <= 6 and _DIGIT.search(x) else None
                    if not pure and not _could_be_head(x):
                        out.append((doc, page, n, top, bottom, outer, False, False, None, None, False, words[0], words[-1]))
                        continue
                    head, num = (x.strip(), None) if pure else head_of(x)
                    known = None if pure else m.is_head_shape(head)
                    out.append((doc, page, n, top, bottom, outer, bool(pure), bool(pure and pure[1]), pure[0] if pure else num, short_key(skeleton(_plain(head))), known, words[0], words[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _EDGE_TYPES)], names=_EDGE_NAMES) if out else pa.RecordBatch.from_arrays([pa.array([], t) for t in _EDGE_TYPES], names=_EDGE_NAMES)

    return pages.select("document_id", "page_number", "text").mapInArrow(
        run, "document_id string, page_number int, line_no int, top boolean, bottom boolean, outer boolean, pure boolean, marked boolean, num int, key string, known boolean, first_word string, last_word string"
    )


_EDGE_NAMES = ["document_id", "page_number", "line_no", "top", "bottom", "outer", "pure", "marked", "num", "key", "known", "first_word", "last_word"]
_EDGE_TYPES = [pa.string(), pa.int32(), pa.int32(), *[pa.bool_()] * 5, pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string()]


def page_context(edges: DataFrame) -> DataFrame:
    """(document_id, page_number, furniture, next_word, prev_word) per page.

    Heads and page-number offsets are counted by (document, key) and (document, offset): a document
    with a third of all pages is summed map-side and its rows may be split by AQE.
    """
    e = edges.withColumn("offset", F.col("num") - F.col("page_number"))
    heads = e.filter("not pure and key is not null").groupBy("document_id", "key").agg(F.count("*").alias("n_head"))
    offsets = e.filter("num is not null and (outer or not pure)").groupBy("document_id", "offset").agg(F.count("*").alias("n_offset"))
    e = e.join(heads, ["document_id", "key"], "left").join(offsets, ["document_id", "offset"], "left")
    steady = F.coalesce(F.col("n_offset"), F.lit(0)) >= 2
    number = F.col("pure") & F.col("outer") & (F.col("marked") | steady)
    unknown = F.col("known").isNull()
    head = ~F.col("pure") & (F.coalesce("known", F.lit(False)) | (unknown & ((F.coalesce("n_head", F.lit(0)) >= 2) | (F.col("num").isNotNull() & steady))))
    e = e.withColumn("furniture", number | head)
    body = ~F.col("furniture")
    own = e.groupBy("document_id", "page_number").agg(
        F.collect_set(F.when(F.col("furniture"), F.col("line_no"))).alias("furniture"),  # edge lines of one page
        F.min_by("first_word", F.when(body & F.col("top"), F.col("line_no"))).alias("first_word"),
        F.max_by("last_word", F.when(body & F.col("bottom"), F.col("line_no"))).alias("last_word"),
    )
    none = F.lit(None).cast("string")
    ahead = own.select("document_id", (F.col("page_number") - 1).alias("page_number"), F.array().cast("array<int>").alias("furniture"), F.col("first_word").alias("next_word"), none.alias("prev_word"))
    behind = own.select("document_id", (F.col("page_number") + 1).alias("page_number"), F.array().cast("array<int>").alias("furniture"), none.alias("next_word"), F.col("last_word").alias("prev_word"))
    here = own.select("document_id", "page_number", "furniture", none.alias("next_word"), none.alias("prev_word"))
    return here.unionByName(ahead).unionByName(behind).groupBy("document_id", "page_number").agg(
        F.max_by("furniture", F.size("furniture")).alias("furniture"), F.max("next_word").alias("next_word"), F.max("prev_word").alias("prev_word")
    )


# ---------------------------------------------------------------------------------- lines


class Reader:
    """Judges tokens against a model; remembers what it has judged, up to a bounded number."""

    LIMIT = 400_000

    def __init__(self, model: Model):
        self.m = model
        self.seen: dict[str, tuple[bool, str | None]] = {}
        self.bad: set[str] = set()
        self.confusions = by_first([*model.start, *model.learned])
        self.reverse = [(seen, real) for real, seen in [*model.start, *model.learned] if seen.isalpha()]
        self.rivals: dict[str, list[tuple[int, str]]] = {}  # token: explained candidates, where there are several

    def rough(self, token: str) -> str:
        """Lower case without outer punctuation, keeping what could be a misread letter."""
        c = core(token)
        if "(" in token and ")" not in token and token.lstrip(_OPEN.replace("(", "")).startswith("(") and f"c{c}" in self.m.lexicon:
            return f"({c}"  # an opening mark that isn't closed may be a letter
        if c in self.m.lexicon:
            return c
        t = token.rstrip(_OUTER).lower()
        if ")" in token or not t.lstrip(_OPEN.replace("(", "")).startswith("("):
            t = t.lstrip(_OPEN)
        else:
            t = t.lstrip(_OPEN.replace("(", ""))
            if c and (skeleton(t) not in self.m.skeletons):
                t = t[1:]
        if t.endswith("!") and skeleton(t) not in self.m.skeletons:
            t = t.rstrip("!")
        return t

    def known(self, word: str) -> bool:
        lex = self.m.lexicon
        return word in lex or ("-" in word and all(x in lex or not x for x in word.split("-")))

    def prepare(self, tokens: set[str]) -> None:
        """Judge all new tokens of a batch together."""
        if len(self.seen) > self.LIMIT:
            self.seen.clear()
            self.bad.clear()
            self.rivals.clear()
        ask: list[tuple[str, str]] = []
        for t in tokens - self.seen.keys():
            w = self.rough(t)
            letters = sum(c.isalpha() for c in w)
            alien = bool(_ALIEN.search(w)) or w.startswith("(") or "!" in w
            if not letters or self.known(w) or (w[0] != "(" and self.known(core(t))) or _ORDINAL.match(w) or ("@" in w and "." in w):
                self.seen[t] = (False, None)
            elif alien or not t.lstrip(_OPEN)[:1].isupper() or skeleton(w) in self.m.skeletons or flat_skeleton(w) in self.m.flat or t.isupper():
                ask.append((t, w))
            else:
                self._note(t, self._name(w))
        if not ask:
            return
        found = self.m.trie.within([w for _, w in ask], [2] * len(ask))
        for (t, w), near in zip(ask, found):
            self._note(t, self._rank(t, w, near))

    def _note(self, token: str, verdict: tuple[bool, str | None]) -> None:
        self.seen[token] = verdict
        if verdict[0]:
            self.bad.add(token)

    def _rank(self, token: str, w: str, near: list[tuple[str, int]]) -> tuple[bool, str | None]:
        lex, s = self.m.lexicon, skeleton(w)
        if s in self.m.skeletons and all(self.m.skeletons[s] != x for x, _ in near):
            near = [*near, (self.m.skeletons[s], 3)]  # several confusions in one word
        explained = [(lex[x], x) for x, _ in near if confusable(x, w, self.confusions)]
        if explained:
            if len(explained) > 1:
                self.rivals[token] = explained
            return True, max(explained)[1]
        if _ALIEN.search(w) and sum(c.isalpha() for c in w) >= 2:
            best = min(((d, -lex[x], x) for x, d in near), default=None)
            return True, best[2] if best else None
        if token.lstrip(_OPEN)[:1].isupper() and not token.isupper():
            return self._name(w)
        return False, None

    def by_context(self, token: str, words: list[str], at: int, page: "PageWords") -> str | None:
        """The best of several explained candidates given the words around the token on its page."""
        before, after = words[at - 1] if at else "", words[at + 1] if at + 1 < len(words) else ""
        score = lambda n, x: math.log(n) + NEIGHBOUR_WEIGHT * (((before, x) in page.pairs) + ((x, after) in page.pairs)) + PAGE_WEIGHT * (x in page.words)
        return max((score(n, x), n, x) for n, x in self.rivals[token])[2]

    def _odd(self, w: str) -> int:
        x = f"^{w}$"
        return sum(x[i : i + 3] not in self.m.trigrams for i in range(len(x) - 2))

    def _name(self, w: str) -> tuple[bool, str | None]:
        """A name outside the lexicon is misread if undoing one confusion turns letter runs that occur
        nowhere into ones that do."""
        if not w.isalpha() or self._odd(w) < 2:
            return False, None
        for seen, real in self.reverse:
            at = w.find(seen)
            while at >= 0:
                v = w[:at] + real + w[at + len(seen) :]
                if not self._odd(v):
                    return True, v
                at = w.find(seen, at + 1)
        return False, None

    def is_cut(self, left: str, right: str) -> bool:
        """Whether a word that ends a line with a hyphen was cut there, not printed with it."""
        lex, sk = self.m.lexicon, self.m.skeletons
        body, mark = left[:-1], left[-1]
        a, b = core(body), core(right)
        if not b:
            return bool(a)
        if not b[0].isalpha() and not _ALIEN.search(b[:2]):
            return False
        joined, printed = lex.get(a + b, 0), lex.get(f"{a}-{b}", 0)
        if joined or printed:
            return joined >= printed
        if skeleton(a + b) in sk:
            return True
        if skeleton(f"{a}-{b}") in sk:
            return False
        return not (mark in "-‐‑" and len(a) > 2 and a in lex and b in lex)


class PageWords:
    """Words of a page and pairs of neighbouring ones."""

    def __init__(self, lines: list[str]):
        flow = [core(t) for x in lines for t in x.split()]
        self.words, self.pairs = set(flow), set(zip(flow, flow[1:]))


_READERS: dict[str, Reader] = {}


def reader_of(model: Model) -> Reader:
    """The reader of a model; a worker that runs several tasks judges a token once."""
    if model.name not in _READERS:
        _READERS.clear()
        _READERS[model.name] = Reader(model)
    return _READERS[model.name]


def cut_left(line: str) -> str | None:
    """The last token of a line that ends in a hyphen after a letter."""
    t = line.rstrip()
    if len(t) > 1 and t[-1] in HYPHENS and (t[-2].isalpha() or _ALIEN.search(t[-3:-1])):
        return t.split()[-1]
    return None


def read_lines(reader: Reader, lines: list[str], furniture: set[int], next_word: str | None, prev_word: str | None, with_text: bool = False) -> tuple[list[tuple[int, str]], str]:
    """([(line number, kind)], repaired text) of a page or statement whose tokens are prepared."""
    seen = reader.seen
    found = [(n, "furniture") for n in sorted(furniture)]
    body = [(n, x) for n, x in enumerate(lines, 1) if n not in furniture and x.strip()]
    carried = prev_word if prev_word and len(prev_word) > 1 and prev_word[-1] in HYPHENS and prev_word[-2].isalpha() else None
    parts: list[str] = []
    page: PageWords | None = None
    blank_before = {n for n in range(1, len(lines) + 1) if n > 1 and not lines[n - 2].strip()}
    for k, (n, x) in enumerate(body):
        tokens = x.split()
        right = body[k + 1][1].split()[0] if k + 1 < len(body) else next_word
        left = cut_left(x)
        cut = bool(left) and (reader.is_cut(left, right) if right else True)
        if cut:
            found.append((n, "hyphen"))
        if not left and not carried and not with_text:
            if not reader.bad.isdisjoint(tokens):
                found.append((n, "misread"))
            continue
        bad = False
        fixed: list[str] = []
        for i, t in enumerate(tokens):
            whole, mine = t, "all"
            if i == 0 and carried:
                whole, mine = carried[:-1] + t if reader.is_cut(carried, t) else t, "right"
                if whole == t:
                    mine = "all" if reader.known(core(carried[:-1] + "-" + t)) is False else "skip"
            if left and i == len(tokens) - 1:
                if not right:
                    mine = "skip"
                elif cut:
                    whole, mine = whole[:-1] + right, "left" if mine == "all" else mine
                elif reader.known(core(whole[:-1] + "-" + right)):
                    mine = "skip"
                else:
                    whole = whole[:-1]
            wrong, better = (False, None) if mine == "skip" else seen.get(whole) or reader_judge(reader, whole)
            if whole in reader.rivals:
                page = page or PageWords([y for _, y in body])
                better = reader.by_context(whole, [core(y) for y in tokens], i, page)
            if wrong and mine != "all":
                w = reader.rough(whole)
                piece = core(t[:-1]) if mine == "left" else core(t)
                if _ALIEN.search(w):
                    wrong = bool(_ALIEN.search(t)) or (mine == "left" and any(c in t for c in "!(@"))
                elif better:
                    wrong = not (better.startswith(piece) if mine == "left" else better.endswith(piece))
            bad |= wrong
            if with_text:
                fixed.append(_repaired(whole if mine in ("all", "left") else t, better) if mine != "right" else "")
        if bad:
            found.append((n, "misread"))
        if n in blank_before and parts and not carried:
            parts.append("\n\n")
        parts.append(" ".join(f for f in fixed if f) + ("" if left and not cut and right else " "))
        carried = left if cut or left else None
    text = re.sub(r" *\n\n *", "\n\n", "".join(parts))
    return found, re.sub(r" {2,}", " ", text).strip()


def reader_judge(reader: Reader, token: str) -> tuple[bool, str | None]:
    reader.prepare({token})
    return reader.seen[token]


def _repaired(token: str, better: str | None) -> str:
    if not better:
        return token
    bare = token.rstrip(_OUTER)
    tail = token[len(bare) :]
    head = token[: len(token) - len(token.lstrip(_OPEN.replace("(", "")))]
    word = better.upper() if bare.isupper() and len(bare) > 1 else better.capitalize() if bare[:1].isupper() else better
    return head + word + tail


def _tokens_to_judge(lines: list[str], furniture: set[int]) -> set[str]:
    out: set[str] = set()
    for n, x in enumerate(lines, 1):
        if n not in furniture:
            out.update(x.split())
    return out


def statement_furniture(lines: list[str], model: Model) -> set[int]:
    """Lines of a staged statement that are heads by shape or marked page numbers."""
    out = set()
    if len(lines) < 2:
        return out
    for n, x in enumerate(lines, 1):
        if not x.strip():
            continue
        pure = page_number(x) if _DIGIT.search(x) else None
        if pure:
            if pure[1]:
                out.add(n)
            continue
        if not _could_be_head(x):
            continue
        head, num = head_of(x)
        known = model.is_head_shape(head)
        if known or (num is not None and known is None):
            out.add(n)
    return out


def judged(rows: DataFrame, shared, with_text: bool = False) -> DataFrame:
    """rows: (src_table, record_id, page_number, text, furniture, next_word, prev_word), furniture null
    for statements; shared is the broadcast model. Gives (src_table, record_id, page_number, line_no, kind),
    or the repaired text."""
    head = "src_table string, record_id string, page_number int"
    names = ["src_table", "record_id", "page_number"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        reader = reader_of(m)
        for b in by_size(batches, 3):
            texts = [unicodedata.normalize("NFC", t).split("\n") if t else [] for t in b.column(3).to_pylist()]
            furniture = [set(f) if f is not None else statement_furniture(x, m) for f, x in zip(b.column(4).to_pylist(), texts)]
            todo: set[str] = set()
            for x, f in zip(texts, furniture):
                todo |= _tokens_to_judge(x, f)
            reader.prepare(todo)
            row, line, kind, text = [], [], [], []
            for n, (x, f, nxt, prev) in enumerate(zip(texts, furniture, b.column(5).to_pylist(), b.column(6).to_pylist())):
                found, repaired = read_lines(reader, x, f, nxt, prev, with_text)
                if with_text:
                    row.append(n)
                    text.append(repaired)
                    continue
                for number, what in found:
                    row.append(n)
                    line.append(number)
                    kind.append(what)
            at = pa.array(row, pa.int32())
            keys = [b.column(c).take(at) for c in range(3)]
            if with_text:
                yield pa.RecordBatch.from_arrays([*keys, pa.array(text, pa.string())], names=[*names, "text"])
            else:
                yield pa.RecordBatch.from_arrays([*keys, pa.array(line, pa.int32()), pa.array(kind, pa.string())], names=[*names, "line_no", "kind"])

    return rows.mapInArrow(run, head + (", text string" if with_text else ", line_no int, kind string"))


def repair(pages: DataFrame, staging: DataFrame, with_text: bool = False, start: list[tuple[str, str]] | None = None) -> DataFrame:
    """All three passes over pages (document_id, page_number, text) and staging (id, statement)."""
    texts = pages.select(F.lit(True).alias("is_page"), "text").unionByName(staging.select(F.lit(False).alias("is_page"), F.col("statement").alias("text")))
    shared = pages.sparkSession.sparkContext.broadcast(learn(texts, start))
    context = page_context(materialize(edge_lines(pages, shared), "scan-edges"))  # read three times
    rows = pages.select("document_id", "page_number", "text").join(context, ["document_id", "page_number"], "left").select(
        F.lit("pages").alias("src_table"), F.col("document_id").alias("record_id"), "page_number", "text",
        F.coalesce("furniture", F.array().cast("array<int>")).alias("furniture"), "next_word", "prev_word",
    )
    none = F.lit(None).cast("string")
    staged = staging.select(
        F.lit("question_staging").alias("src_table"), F.col("id").alias("record_id"), F.lit(0).alias("page_number"), F.col("statement").alias("text"),
        F.lit(None).cast("array<int>").alias("furniture"), none.alias("next_word"), none.alias("prev_word"),
    )
    out = judged(rows, shared, with_text).unionByName(judged(staged, shared, with_text))
    return out if with_text else out.distinct()
