"""Arrow kernels over question texts: canonical keys and sets of neighbouring words.

Spark has no built-in for Unicode composition (NFC/NFD), so these columns are made in one pass over
Arrow batches; what leaves the kernel is hashes, never text, so no later shuffle carries text.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def _kept_class() -> str:
    """Regex class body of the symbols and combining marks that a canonical key keeps."""
    kept = [c for c in range(0x80, 0x10000) if unicodedata.category(chr(c))[0] in "SM"]
    out, start, last = ["$+<=>\\^`|~"], None, None
    for c in [*kept, sys.maxunicode + 2]:
        if last is None or c != last + 1:
            if start is not None:
                out.append(f"{chr(start)}-{chr(last)}" if last > start else chr(start))
            start = c
        last = c
    return "".join(out)


_DROPPED = re.compile(f"[^\\w{_kept_class()}]+|_+")
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]+")
_LETTER = re.compile(r"[\W_]+")


def compact(text: str | None) -> str:
    """Text as compared for copies: composed accents, no case, white space or punctuation."""
    if not text:
        return ""
    t = text.casefold()
    return _DROPPED.sub("", t if t.isascii() else unicodedata.normalize("NFC", t))


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case. Accents are taken off when a word is hashed, which
    happens once per distinct word."""
    if not text:
        return []
    t = text.lower()
    if not t.isascii() and not unicodedata.is_normalized("NFC", t):
        t = unicodedata.normalize("NFC", t)
        if _MARKS.search(t):  # marks without a composed form
            t = _MARKS.sub("", unicodedata.normalize("NFKD", t))
    return _WORD.findall(t)


def bare(word: str) -> str:
    """A word without accents."""
    return word if word.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", word))


def _text(v) -> str | None:
    return v if isinstance(v, str) else None if v is None else json.dumps(v, sort_keys=True)


def alternatives_of(v) -> list[tuple[str, str]]:
    """(letter, text) entries of a list of {letter, text} or of a {letter: text} object."""
    if isinstance(v, dict):
        v = [{"letter": k, "text": t} for k, t in v.items()]
    if not isinstance(v, list):
        return []
    out = []
    for a in v:
        if isinstance(a, dict) and (t := _text(a.get("text"))):
            out.append((_LETTER.sub("", _text(a.get("letter")) or "").upper(), t))
    return out


def parse_payload(payload: str | None) -> tuple[str | None, list[tuple[str, str]]] | None:
    """(statement, alternatives) of a payload, or None where it doesn't parse to an object."""
    try:
        d = json.loads(payload)
    except (TypeError, ValueError, RecursionError):
        return None
    if not isinstance(d, dict):
        return None
    return _text(d.get("statement")), alternatives_of(d.get("alternatives"))


def parse_staged(statement: str | None, alternatives: str | None) -> tuple[str | None, list[tuple[str, str]]]:
    """(statement, alternatives) of a staged row; alternatives that don't parse count as none."""
    try:
        v = json.loads(alternatives) if alternatives else None
    except (ValueError, RecursionError):
        v = None
    return statement, alternatives_of(v)


def copy_key(statement: str | None, alternatives: list[tuple[str, str]]) -> bytes | None:
    """128-bit key that is equal exactly for copies; None where there is no letter or digit at all."""
    body = compact(statement)
    alts = sorted({(letter, t) for letter, text in alternatives if (t := compact(text))})
    if not body and not alts:
        return None
    return xxhash.xxh3_128_digest("\x00".join([body, *(f"{a}\x01{t}" for a, t in alts)]).encode())


BATCH_BYTES = 16 * 1024 * 1024


def by_size(batches, *columns: int):
    """Batches cut so that the texts of these columns stay near BATCH_BYTES: memory follows neither the
    number of rows in a batch nor the length of the texts (a single longer text is a batch of its own)."""
    for b in batches:
        size = np.zeros(b.num_rows, np.int64)
        for c in columns:
            size += pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if size.sum() <= BATCH_BYTES:
            yield b
            continue
        start = total = 0
        for n, s in enumerate(size.tolist()):
            if total and total + s > BATCH_BYTES:
                yield b.slice(start, n - start)
                start, total = n, 0
            total += s
        yield b.slice(start)


class WordHashes(dict):
    """Odd 64-bit hash per word, remembered for up to a bounded number of words."""

    LIMIT = 1 << 20

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(bare(word).encode()) | 1
        return h


HASHES = WordHashes()


def hash_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts, offsets of the texts)."""
    flat: list[int] = []
    offsets = np.zeros(len(texts) + 1, np.int64)
    get = HASHES.__getitem__
    for k, t in enumerate(texts):
        flat.extend(map(get, words(t)))
        offsets[k + 1] = len(flat)
    return np.array(flat, np.uint64), offsets


_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (murmur style), elementwise."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_sets(docs: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed pairs of neighbouring words per record.

    docs holds for each record its fields as lists of words; pairs never cross a field. Returns the
    concatenated sorted 32-bit hashes and the offsets of the records.
    """
    flat: list[int] = []
    lengths = np.empty(len(docs), np.int64)
    get = HASHES.__getitem__
    for k, fields in enumerate(docs):
        before = len(flat)
        for f in fields:
            flat.extend(map(get, f))
            flat.append(0)
        lengths[k] = len(flat) - before
    h = np.array(flat, np.uint64)
    owner = np.repeat(np.arange(len(docs), dtype=np.int64), lengths)
    if len(h) < 2:
        return np.empty(0, np.int32), np.zeros(len(docs) + 1, np.int64)
    ok = (h[:-1] != 0) & (h[1:] != 0)
    g = (mix(h[:-1] * _P1 + h[1:] * _P2)[ok] >> np.uint64(32)).astype(np.int64)
    both = np.unique((owner[:-1][ok] << 32) | g)  # record in the high half, hash in the low one
    own = both >> 32
    return both.astype(np.uint32).view(np.int32), np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(docs))))).astype(np.int64)


def list_array(values: np.ndarray, offsets: np.ndarray, null: np.ndarray | None = None) -> pa.ListArray:
    """Arrow list column; rows marked in null become null and their values are left out."""
    if null is not None and null.any():
        values = values[~np.repeat(null, np.diff(offsets))]
        offsets = np.concatenate(([0], np.cumsum(np.where(null, 0, np.diff(offsets)))))
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), pa.array(values), mask=pa.array(null))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), pa.array(values))
