"""Problem 7: sentence units in any language and script.

A semi-Markov dynamic programme over each line.  Every mark that could close a sentence is a
possible boundary, and the programme chooses the sequence of whole spans with the greatest sum of
span scores.  The score of a span adds up four things, none of which decides alone: how its first
word opens a sentence, how its last word and mark close one, how long it is, and whether quotation
marks and brackets balance within it.  A line end is certain; nothing else is.

The length score is flat between SHORT and LONG and falls outside, so the best predecessor of a
boundary is a maximum over a sliding window and a running maximum: the programme is linear in the
number of marks, however long a line is, and looks at whole lines.

Null texts hold no sentence; a stretch without a letter or digit holds none.  Positions count
code points from 0.  Repeated rows give their sentences once.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_map, per_task

# Quotation marks and brackets with what closes them.
QUOTES = {"「": "」", "『": "』", "“": "”", "«": "»", "‘": "’", "｢": "｣", "„": "“", "‹": "›", "〝": "〞"}
BRACKETS = {"(": ")", "（": "）", "[": "]", "［": "］", "【": "】", "《": "》", "〈": "〉", "〔": "〕", "{": "}", "⟨": "⟩"}
# Abbreviations of the four languages that are followed by more of their sentence.
ABBREVIATIONS = frozenset(
    "tp ts gs pgs ths bs cn ks ls q tr sđd sdd st tk nxb v vd tcn scn đ ô p k h m dr mr mrs ms prof rev gen col capt lt st jr sr vol vols no nos fol fols pp p pg ed eds op cit al ca c cf eg ie viz fig figs ch chap sec art ibid id loc approx vs "
    "mme mlle mm me pr env av apr ap fo f t éd etc sq sqq chap ms mss num art trad coll attn inc ltd dept est tel tél ext".split()
)
#: Abbreviations that may also end a sentence.
MAY_END = frozenset("etc sq sqq al cit đ vv inc ltd jr sr h m c k env".split())

#: Marks that differ only in width close each other.
_SAME = {"｣": "」", "）": ")", "］": "]"}

_SPECIAL = regex.compile(r"[「」『』“”«»‘’｢｣„‹›〝〞()（）\[\]［］【】《》〈〉〔〕{}⟨⟩\"]|[.．。｡!！?？؟।՞‼⁇⁈⁉﹖﹗︒]+")
_INVISIBLE = regex.compile(r"\p{Cf}+")
_REAL = regex.compile(r"[\p{L}\p{N}]")
_FIRST = regex.compile(r"[^\s\p{Cf}\p{Z}]")
_NEXT_LETTER = regex.compile(r"\p{L}|\p{N}")
_HAN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_ENDS = frozenset(".．。｡!！?？؟।՞‼⁇⁈⁉﹖﹗︒")
_MARK = regex.compile("[.．。｡!！?？؟।՞‼⁇⁈⁉﹖﹗︒]")
#: Invisible characters that part words.
_NO_WIDTH = "​‌‍⁠﻿"

#: Weights of the span score, in units in which an ordinary full stop closes a sentence with 3.
FULL_STOP, STRONG_MARK, ELLIPSIS = 3.0, 4.0, -2.0
ABBREVIATION, MAY_CLOSE, INITIAL, IN_NUMBER = -8.0, -4.5, -9.0, -20.0
OPENS_UPPER, OPENS_OTHER, OPENS_LOWER, RUNS_ON = 1.5, 0.5, -9.0, -20.0
#: Each end of a span that lies within a quotation or bracket.
UNBALANCED = -10.0
#: Lengths in code points at which a span is no longer of usual size, and what it loses there.
SHORT, TOO_SHORT = 3, -1.5
LONG, TOO_LONG = 600, 0.5


def _matched(line: str, marks: list) -> tuple[list[tuple[int, int]], set[int]]:
    """Outer spans of balanced quotations and brackets, and the closing places of the quotations."""
    stack: list[tuple[str, int, bool]] = []
    open_: Counter = Counter()  # by what closes them
    pairs: list[tuple[int, int, bool]] = []
    for m in marks:
        c, at = m[0], m.start()
        if c[0] in _ENDS:
            continue
        if c == "’" and 0 < at < len(line) - 1 and line[at - 1].isalpha() and line[at + 1].isalpha():
            continue
        same = _SAME.get(c, c)
        if open_[same]:
            # What was opened later and never closed is given up.
            opener = None
            while opener is None or opener[0] != same:
                opener = stack.pop()
                open_[opener[0]] -= 1
            pairs.append((opener[1], at, opener[2]))
        elif c == '"' or c in QUOTES or c in BRACKETS:
            closer = QUOTES.get(c) or BRACKETS.get(c) or c
            stack.append((_SAME.get(closer, closer), at, c not in BRACKETS))
            open_[stack[-1][0]] += 1
    pairs.sort()
    outer: list[tuple[int, int]] = []
    ends: set[int] = set()
    for a, b, quote in pairs:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
            if quote:
                ends.add(b)
    return outer, ends


def _words_before(line: str, marks: list) -> list[tuple[str, bool]]:
    """For each mark the word it follows, and whether that is a chain of dotted parts of at most two letters.

    A word runs back over full stops, so a chain is carried from mark to mark instead of read anew.
    """
    out: list[tuple[str, bool]] = []
    edge, chain, short = -1, "", True
    for m in marks:
        at = m.start()
        end = at
        while end and _INVISIBLE.match(line[end - 1]):
            end -= 1
        begin = end
        while begin > max(edge, 0) and (line[begin - 1].isalpha() or line[begin - 1] in "-" or unicodedata.category(line[begin - 1])[0] == "M"):
            begin -= 1
        part = line[begin:end]
        if chain and begin == edge:
            chain, short = (chain + part)[-24:], short and len(part) <= 2
        else:
            chain, short = part, len(part) <= 2
        out.append((chain, short))
        if m[0] == ".":
            edge, chain = m.end(), chain + "."
        else:
            edge, chain, short = m.end(), "", True
    return out


def _closing(line: str, m, word: str, short: bool, spaced: bool, following: str) -> float:
    """How well the mark ``m`` and the word before it close a sentence."""
    run, at = m[0], m.start()
    if run.strip(".．"):
        return STRONG_MARK
    if len(run) > 1:
        return ELLIPSIS if len(run) == 3 else 0.0
    before = line[at - 1] if at else ""
    if before and not before.isalnum():
        before = _INVISIBLE.sub("", line[max(0, at - 4) : at])[-1:]
    if before.isdigit():
        if following.isdigit() and not spaced or not line[:at].strip().strip("0123456789"):
            return IN_NUMBER  # a decimal, or the number of a list entry
    if _HAN.match(before) or run == "．" and not before.isdigit():
        return FULL_STOP - OPENS_LOWER
    word = word.lstrip(".-")
    plain = word.replace(".", "").replace("-", "").lower()
    if len(word) == 1 and word.isupper():
        return FULL_STOP + INITIAL
    if "." in word and short:
        return FULL_STOP + (INITIAL if plain not in MAY_END or following.isdigit() else MAY_CLOSE if plain == "vv" else ABBREVIATION)
    if plain in ABBREVIATIONS:
        may = word.islower() and plain in MAY_END and plain not in ("q", "p") and len(plain) > 1
        return FULL_STOP + (MAY_CLOSE if may and following.isupper() else ABBREVIATION)
    return FULL_STOP


def _opening(line: str, after: int, following: str, first: int, mark: str, before: str) -> float:
    """How well what follows opens a sentence; ``first`` is the place of its first letter or digit."""
    spaced = after < len(line) and (line[after].isspace() or line[after] in _NO_WIDTH)
    plain = mark[0] in ".．"
    if _HAN.match(following):
        return OPENS_UPPER if not plain or len(mark) == 1 else OPENS_OTHER
    if following.islower():
        # Lower case goes on, unless the mark is that of a script without case.
        return OPENS_OTHER if not plain and _HAN.match(before) and (not spaced or mark[0] in "!?") else OPENS_LOWER
    if plain and not spaced and not (len(mark) == 1 and (_HAN.match(before) or mark == "．")):
        return RUNS_ON if first == after or len(mark) > 1 else OPENS_OTHER
    if len(mark) > 1 and plain:
        return OPENS_UPPER + 2.5 if following.isupper() else OPENS_OTHER
    return OPENS_UPPER if following.isupper() else OPENS_OTHER


def places(line: str) -> list[tuple[int, int, float, float]]:
    """The possible boundaries of a line, (end, first letter after it, closing, opening), its end last."""
    marks = list(_SPECIAL.finditer(line))
    outer, ends = _matched(line, marks)
    starts = [a for a, _ in outer]
    marks = [m for m in marks if m[0][0] in _ENDS]
    words = _words_before(line, marks)
    out: list[tuple[int, int, float, float]] = []
    later = len(line)
    first = len(line)
    # From the right, so that the next letter is looked for once.
    for m, (word, short) in zip(reversed(marks), reversed(words)):
        after = m.end()
        k = bisect_right(starts, m.start()) - 1
        inside = k >= 0 and outer[k][1] > m.start()
        closes = inside and after == outer[k][1] and after in ends and not (len(m[0]) > 1 and not m[0].strip(".．"))
        if closes:
            after += 1
        if found := _NEXT_LETTER.search(line, after, later) if later > after else None:
            first = found.start()
        later = min(later, after)
        following = line[first] if first < len(line) else ""
        if not following:
            out.append((after, first, 0.0, 0.0))  # nothing readable follows on this line
            continue
        before = _INVISIBLE.sub("", line[max(0, m.start() - 4) : m.start()])[-1:] if m.start() else ""
        if closes:
            # The quotation that closes here ends with its sentence.
            out.append((after, first, STRONG_MARK, OPENS_LOWER if following.islower() else OPENS_UPPER))
            continue
        spaced = after < len(line) and (line[after].isspace() or line[after] in _NO_WIDTH)
        closing = _closing(line, m, word, short, spaced, following)
        opening = _opening(line, after, following, first, m[0], before)
        if inside:
            closing, opening = closing + UNBALANCED, opening + UNBALANCED
        out.append((after, first, closing, opening))
    out.reverse()
    out.append((len(line), len(line), 0.0, 0.0))
    return out


def length_score(size: int) -> float:
    """What a span of ``size`` code points loses; one without a letter or digit (none or less) holds no sentence."""
    if size <= 0:
        return 0.0
    return TOO_SHORT if size < SHORT else 0.0 if size <= LONG else -TOO_LONG * (size - LONG) / LONG


def boundaries(line: str) -> list[int]:
    """Ends of the sentences of one line, the line's end included: the best sequence of spans."""
    if not _MARK.search(line):
        return [len(line)]
    nodes = places(line)
    begin = _NEXT_LETTER.search(line)
    # Nodes with the same first letter after them are alternatives; the best of each such group is kept.
    groups: list[list] = []  # (first letter, value, node)
    window: deque[int] = deque()  # groups at a usual distance, values falling
    far, usual, near = (float("-inf"), -1), 0, 0
    best, back = [0.0] * (len(nodes) + 1), [-1] * (len(nodes) + 1)

    def add(first: int, value: float, node: int) -> None:
        if groups and groups[-1][0] == first:
            if value > groups[-1][1]:
                groups[-1][1:] = [value, node]
        else:
            groups.append([first, value, node])

    add(begin.start() if begin else len(line), 0.0, 0)
    for j, (end, first, closing, opening) in enumerate(nodes, 1):
        # Groups that have come to a usual distance, and those that have gone beyond it.
        while near < len(groups) and end - groups[near][0] >= SHORT:
            while window and groups[window[-1]][1] <= groups[near][1]:
                window.pop()
            window.append(near)
            near += 1
        while usual < near and end - groups[usual][0] > LONG:
            value = groups[usual][1] + TOO_LONG * (groups[usual][0] + LONG) / LONG
            far = max(far, (value, groups[usual][2]))
            if window and window[0] == usual:
                window.popleft()
            usual += 1
        options = [(groups[g][1] + length_score(end - groups[g][0]), groups[g][2]) for g in range(near, len(groups))]
        if window:
            options.append((groups[window[0]][1], groups[window[0]][2]))
        if far[1] >= 0:
            options.append((far[0] - TOO_LONG * end / LONG, far[1]))
        value, back[j] = max(options)
        best[j] = value + closing
        add(first, best[j] + opening, j)
    chosen, j = [], len(nodes)
    while j > 0:
        chosen.append(nodes[j - 1][0])
        j = back[j]
    return chosen[::-1]


def spans(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of every sentence of ``text``."""
    base = 0
    for line in text.split("\n"):
        begin = 0
        for end in boundaries(line):
            part = line[begin:end]
            if _REAL.search(part):
                first = _FIRST.search(part)
                yield base + begin + first.start(), base + begin + len(part.rstrip())
            begin = end
        base += len(line) + 1


def sentence_units(rows: DataFrame, key: str) -> DataFrame:
    """(key, sent_start, sent_end) of every sentence, each once."""
    kind = dict(rows.dtypes)[key]

    @per_task
    def split():
        def each(ident, text):
            if text and (found := list(spans(text))):
                yield ident, [a for a, _ in found], [b for _, b in found]

        return each

    # One row a text goes through the shuffle that removes repeated rows.
    units = flat_map(rows.select(key, "text"), split, f"{key} {kind}, starts array<bigint>, ends array<bigint>").distinct()
    every = units.select(key, F.explode(F.arrays_zip("starts", "ends")).alias("s"))
    return every.select(key, F.col("s.starts").alias("sent_start"), F.col("s.ends").alias("sent_end"))
