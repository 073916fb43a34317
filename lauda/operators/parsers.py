"""Text to records: links, chunks, answer keys, questions. Arrow kernels, one row in, many rows out."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qs, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame


def expand(df: DataFrame, key: str, text: str, parse: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """(key, parsed columns): parse every text into rows; null texts give none."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(k, *r) for k, t in zip(pdf[key], pdf[text]) if isinstance(t, str) for r in parse(t)]
            yield pd.DataFrame(rows, columns=[key, *names])

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {schema}")


class _Links(HTMLParser):
    def __init__(self, base: str):
        super().__init__()
        self.base, self.found, self.open, self.section = base, [], None, None
        self.heading: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a" and a.get("href"):
            self.open = [urljoin(self.base, a["href"]), []]
        elif re.fullmatch("h[1-6]", tag):
            self.heading = []

    def handle_data(self, data):
        if self.open:
            self.open[1].append(data)
        if self.heading is not None:
            self.heading.append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self.open:
            url, text = self.open
            inner = parse_qs(urlsplit(url).query).get("file")
            self.found.append((urljoin(self.base, inner[0]) if inner else url, " ".join("".join(text).split()), self.section))
            self.open = None
        elif re.fullmatch("h[1-6]", tag) and self.heading is not None:
            self.section, self.heading = " ".join("".join(self.heading).split()), None


def links(html: str, base: str = "") -> list[tuple]:
    """(ordinal, url, title, section) of every link; viewers' ?file= targets unwrapped, the section is
    the last heading before the link."""
    p = _Links(base)
    p.feed(html)
    return [(n, u, t, s) for n, (u, t, s) in enumerate(p.found, 1)]


LINK_SCHEMA = "ordinal int, url string, title string, section string"


def chunks(text: str, size: int = 12000, overlap: int = 800) -> list[tuple]:
    """(chunk_no, start, text): at most `size` characters, broken at a line end in the last quarter
    where there is one, each starting `overlap` before the last one's end."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            cut = text.rfind("\n", at + size * 3 // 4, end)
            end = cut + 1 if cut > 0 else end
        out.append((len(out) + 1, at, text[at:end]))
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return out


CHUNK_SCHEMA = "chunk_no int, start int, chunk string"

#: Answer letters, signs and words of an annulled question, marks between number and answer.
ANSWERS, VOID_SIGNS, VOID_WORDS, BETWEEN = "ABCDEFGH", ("X", "*"), ("ANULADA", "ANULADO"), ".-):"
_TOKEN = re.compile(r"\d+|[^\W\d_]+|\S")


def _verdict(token: str) -> tuple[str | None, bool] | None:
    """(answer, annulled) that a token states, None when it states neither."""
    t = token.upper()
    if len(t) == 1 and t in ANSWERS:
        return t, False
    return (None, True) if t in VOID_SIGNS or t in VOID_WORDS else None


def _number_row(line: str) -> list[int]:
    """The numbers of a line of two or more numbers and nothing else."""
    parts = line.split()
    return [int(x) for x in parts] if len(parts) > 1 and all(x.isdecimal() and len(x) <= 3 for x in parts) else []


def _answer_row(line: str) -> list[tuple[str | None, bool]]:
    """The verdicts of a line of single letters and signs, dots aside."""
    signs = [_verdict(c) for c in "".join(line.split()).replace(".", "")]
    return signs if signs and all(signs) else []


def _stated_pairs(line: str) -> tuple[list[tuple[int, str | None, bool]], bool]:
    """((number, answer, annulled) of a line, whether they make up all of it).

    Pairs with a mark between number and answer come before pairs that merely stand side by side; a
    verdict has to end at white space. A word for annulled without a mark counts only on a line of its own.
    """
    found = list(_TOKEN.finditer(line))
    marked, plain, used = [], [], 0
    for at, m in enumerate(found):
        if not m.group().isdecimal() or len(m.group()) > 3:
            continue
        mark = at + 1 < len(found) and found[at + 1].group() in BETWEEN
        end = found[at + 1 + mark] if at + 1 + mark < len(found) else None
        verdict = _verdict(end.group()) if end else None
        if verdict is None or not line[end.end() : end.end() + 1].isspace() and end.end() < len(line):
            continue
        pair = (int(m.group()), *verdict)
        if mark:
            marked.append(pair)
            used += 3
        elif len(found) == 2 or (end.start() > m.end() and len(end.group()) == 1):
            plain.append(pair)
    return marked or plain, bool(marked) and used == len(found)


def answer_key(text: str) -> list[tuple]:
    """(number, answer, annulled) of a key given as lines, pairs in a line, a table, or rows of numbers
    above rows of letters; a later entry of a number wins."""
    stated: dict[int, tuple] = {}
    above: list[int] = []
    for line in text.splitlines():
        if numbers := _number_row(line):
            above = numbers
            continue
        below = _answer_row(line)
        if above and len(below) == len(above):
            pairs, above = [(n, *v) for n, v in zip(above, below)], []
        else:
            pairs = _stated_pairs(line)[0]
        stated.update((p[0], p) for p in pairs)
    return [stated[n] for n in sorted(stated)]


KEY_SCHEMA = "number int, answer string, annulled boolean"


#: Fixed value: letters of right and wrong as letters of a first and second alternative.
TRUE_FALSE = {"C": "A", "E": "B", None: None}


def true_false_to_letters(entries: list[tuple]) -> list[tuple]:
    """C/E answers as A/B; nothing when any answer is another letter."""
    said = [(n, None if void else a, void) for n, a, void in entries]
    if {a for _, a, void in said if not void} <= TRUE_FALSE.keys() - {None}:
        return [(n, TRUE_FALSE[a], void) for n, a, void in said]
    return []


_HEADER = re.compile(r"^\s*quest[ãa]o\s*(?:n[ºo.]*)?\s*(\d{1,3})\b[.:)\-]?\s*(.*)$", re.I)
_BARE = re.compile(r"^\s*(\d{1,3})[.)]?\s*$")
_ALT = re.compile(r"^\s*\(?([A-H])\s*[).:\-]\s+(\S.*)$")
_ANSWER = re.compile(r"^\s*(?:resposta|gabarito|alternativa correta)\s*:\s*([A-H])\b", re.I)


def questions(text: str) -> list[tuple]:
    """(number, statement, n_alternatives, alternatives, answer) of the questions in a text. Bare
    numbers open a question only where no explicit header exists in the text."""
    explicit = any(_HEADER.match(x) for x in text.splitlines())
    out: list[tuple] = []
    cur: dict | None = None

    def close():
        if cur and (cur["alts"] or cur["st"]):
            out.append((cur["n"], " ".join(cur["st"]).strip(), len(cur["alts"]), "|".join(f"{a}:{' '.join(t)}" for a, t in cur["alts"]), cur["ans"]))

    for x in text.splitlines():
        h = _HEADER.match(x) or (None if explicit else _BARE.match(x))
        if h:
            close()
            cur = {"n": int(h.group(1)), "st": [h.group(2)] if h.lastindex and h.lastindex > 1 and h.group(2) else [], "alts": [], "ans": None}
            continue
        if cur is None or not x.strip():
            continue
        if m := _ANSWER.match(x):
            cur["ans"] = m.group(1).upper()
        elif m := _ALT.match(x):
            cur["alts"].append((m.group(1), [m.group(2).strip()]))
        elif cur["alts"]:
            cur["alts"][-1][1].append(x.strip())
        else:
            cur["st"].append(x.strip())
    close()
    return out


QUESTION_SCHEMA = "number int, statement string, n_alternatives int, alternatives string, answer string"


def true_false_items(text: str) -> list[tuple]:
    """(number, statement): items must come in order; an item ends where the next expected number starts."""
    out, expected, cur = [], None, None
    for x in text.splitlines():
        m = re.match(r"^\s*(\d{1,3})\s+(\S.*)$", x)
        if m and (expected is None or int(m.group(1)) == expected):
            if cur:
                out.append((cur[0], " ".join(cur[1])))
            cur, expected = (int(m.group(1)), [m.group(2).strip()]), int(m.group(1)) + 1
        elif cur and x.strip():
            cur[1].append(x.strip())
    if cur:
        out.append((cur[0], " ".join(cur[1])))
    return out


def discipline_ranges(text: str) -> list[tuple]:
    """(discipline, first, last) from a heading line whose next lines (at most three on) name as many
    ranges as it has parts; ranges must rise."""
    lines = [x for x in text.splitlines() if x.strip()]
    out = []
    for n, x in enumerate(lines):
        names = [p.strip() for p in re.split(r"\s{2,}|\t|\|", x) if p.strip()]
        if not names or any(re.search(r"\d", p) for p in names):
            continue
        for y in lines[n + 1 : n + 4]:
            spans = [(int(a), int(b)) for a, b in re.findall(r"(\d{1,3})\s*(?:a|-|–)\s*(\d{1,3})", y)]
            if len(spans) == len(names) and all(a <= b <= 500 for a, b in spans) and all(s[1] < t[0] for s, t in zip(spans, spans[1:])):
                out += [(d, a, b) for d, (a, b) in zip(names, spans)]
                break
    return out


_MARK = re.compile(r"^\s*\{(\d{1,3})\}\s*$")


def marked_questions(text: str) -> list[tuple]:
    """(number, statement, n_alternatives, alternatives, answer) of texts whose questions open with a
    {NN} line and end with a line of five or more #; questions of fewer than two alternatives and
    questions without their end are left out."""
    out = []
    cur: tuple[int, list[str], list[tuple[str, list[str]]]] | None = None
    for x in text.splitlines():
        if m := _MARK.match(x):
            cur = (int(m.group(1)), [], [])
        elif cur and re.match(r"^\s*#{5,}\s*$", x):
            if len(cur[2]) >= 2:
                out.append((cur[0], " ".join(cur[1]), len(cur[2]), "|".join(f"{a}:{' '.join(t)}" for a, t in cur[2]), None))
            cur = None
        elif cur and x.strip():
            if m := _ALT.match(x):
                cur[2].append((m.group(1), [m.group(2).strip()]))
            elif cur[2]:
                cur[2][-1][1].append(x.strip())
            else:
                cur[1].append(x.strip())
    return out


_GRID = re.compile(r"^\s*(.+?)\s*[-–—]\s*(?:tipo|prova)\s*([1-9]\d*)\s*(?:\(([^)]*)\)|[-–—]\s*(.+?))?(?:\s+folha\s*:\s*\d+)?\s*$", re.I)


def answer_grids(text: str) -> list[tuple]:
    """(grid, label, variant, turn, number, answer, annulled) of a key with one grid per heading
    'role – Tipo n (turn)'. A number that a grid gives two different answers is left out."""
    out: dict[tuple, tuple] = {}
    bad: set[tuple] = set()
    grid, head, waiting = 0, None, []
    for line in text.splitlines():
        if m := _GRID.match(line):
            key = (m.group(1).strip(), int(m.group(2)), (m.group(3) or m.group(4) or "").strip() or None)
            grid, head, waiting = grid + 1, key, []
            continue
        if head is None or not line.strip():
            continue
        if numbers := _number_row(line):
            waiting = numbers
            continue
        below = _answer_row(line)
        if waiting and len(below) == len(waiting):
            pairs, waiting = [(n, *v) for n, v in zip(waiting, below)], []
        else:
            pairs, whole = _stated_pairs(line)
            if not whole:
                continue
        for pair in pairs:
            k, row = (*head, pair[0]), (*head, *pair)
            if k in out and out[k][1:] != row:
                bad.add(k)
            out.setdefault(k, (grid, *row))
    return [v for k, v in out.items() if k not in bad]


GRID_SCHEMA = "grid int, label string, variant int, turn string, number int, answer string, annulled boolean"


#: Board whose exams may be of right-or-wrong items, and what their openings say, folded.
TRUE_FALSE_BOARD, TRUE_FALSE_OPENING = "cebraspe", ("certo ou errado", "julgue os itens", "julgue o item")
OPENING_CHARS = 2000


def route(text: str, board: str | None = None, form: str | None = None) -> str:
    """Which parser a text is for: true_false, marked or generic."""
    fold = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x.casefold()) if not unicodedata.combining(c))
    if TRUE_FALSE_BOARD in fold(board or "") and (form == "true_false" or any(x in fold(text[:OPENING_CHARS]) for x in TRUE_FALSE_OPENING)):
        return "true_false"
    return "marked" if any(map(_MARK.match, text.splitlines())) else "generic"


def parse_document(text: str, board: str | None = None, form: str | None = None) -> list[tuple]:
    """(route, number, statement, n_alternatives, alternatives, answer) by the parser of the text's route. Cut
    words are to be joined before (hyphens.repaired)."""
    way = route(text, board, form)
    if way == "true_false":
        return [(way, n, t, 0, "", None) for n, t in true_false_items(text)]
    return [(way, *row) for row in (marked_questions if way == "marked" else questions)(text)]


ROUTED_SCHEMA = f"route string, {QUESTION_SCHEMA}"


def section_exceptions(numbers: list[int], sections: list[tuple[str, int, int]]) -> list[tuple]:
    """(section, kind, number) against the expected sections (name, first, last): missing, duplicate and
    out_of_order numbers of each section, numbers outside all as out_of_range of no section."""
    out, seen = [], Counter(numbers)
    for name, first, last in sections:
        inside = [n for n in numbers if first <= n <= last]
        out += [(name, "missing", n) for n in range(first, last + 1) if n not in seen]
        out += [(name, "duplicate", n) for n in sorted(set(inside)) if seen[n] > 1]
        out += [(name, "out_of_order", b) for a, b in zip(inside, inside[1:]) if b < a]
    return out + [(None, "out_of_range", n) for n in sorted(seen) if not any(a <= n <= b for _, a, b in sections)]


def answer_blocks(text: str, heading: str) -> dict[str, list[tuple]]:
    """Keys of an annex with one block per booklet: booklet to its entries. heading is a pattern whose first
    group names the booklet; a block that gives a number two answers is empty, as is one that repeats a booklet
    with another key."""
    blocks: dict[str, list[str]] = {}
    lines: list[str] | None = None
    for line in text.splitlines():
        if m := re.search(heading, line, re.I):
            lines = blocks.setdefault(m.group(1).strip(), [])
            line = line[m.end() :]
        if lines is not None and line.strip():
            lines.append(line)
    out = {}
    for booklet, lines in blocks.items():
        stated = [p for line in lines for p in _stated_pairs(line)[0]]
        answers = {n: {(a, v) for m, a, v in stated if m == n} for n, _, _ in stated}
        out[booklet] = [] if any(len(x) > 1 for x in answers.values()) else sorted({p for p in stated})
    return out
