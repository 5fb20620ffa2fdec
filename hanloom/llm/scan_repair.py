"""Problem 6: repair of text from scanned pages.

Running headers and page numbers are recognised by form and repetition, and words broken at a
line's end are put together.  Misrecognised characters are found in context.

Words that glyph confusions can turn into each other share a skeleton, in which each letter is spelt
by the strokes it can be taken for; a word of a scan is linked to the more frequent words of its
skeleton.  How much more frequent one is, and how much better its vector fits the words around this
occurrence than the vector of what was read, decide together.  A word's dense skip-gram vector is the
sum of fixed random vectors of the words around it (a random projection of its skip-gram counts, so
it is learnt from all texts by addition alone); vectors are learnt for all linked words which
frequency leaves open.

Han characters: each that glyph confusions can change has the explicit counts of its positional
contexts as its vector, and is corrected where the contexts of the glyph it is taken for fit better.

Null texts and blank lines give nothing; repeated rows of a document count once in the result.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep
from .common import arrow_map, flat_map

# What a scanner makes of letters, as (read, meant), and of Han characters.
GLYPHS = [("li", "h"), ("ri", "n"), ("rn", "m"), ("ii", "u"), ("cl", "d"), ("vv", "w"), ("c", "e"), ("0", "o"), ("0", "O"), ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("+", "t"), ("|", "l"), ("l", "I"), ("5", "s"), ("8", "B")]
HAN_GLYPHS = dict(zip("入犬便日乒域賦艮宮侖卒晝末土巳干王間烏甲遺", "人大使曰兵城賊民官命率書未士己千玉問鳥申遣"))

#: A word is garbled when frequency and context together say so: a neighbour this many times as frequent counts
#: 1, and so does a cosine to the words around that is greater by 1; a sign between letters counts SIGN.
RATIO = 12
SIGN = 0.6
#: A vector of this many occurrences counts half.
FEW = 2
#: Dimensions of a word's vector, and random vectors that context words are hashed to.
WIDTH, ROWS = 32, 4096
#: Bits for each word of the filter of words whose vectors are wanted, and its least and greatest size.
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 28
#: A Han character is garbled when its contexts favour the neighbour by this much (natural logarithm).
MARGIN = 3.0

_WORD = regex.compile(r"[[\p{L}\p{M}0-9!+|]--\p{Han}]+", regex.V1)
_SITES = regex.compile("|".join(regex.escape(a) for a in dict.fromkeys(a for a, _ in GLYPHS)))
_SIGN_INSIDE = regex.compile(r"\p{L}[0!+1|58]|[0!+1|58]\p{L}")
_HYPHEN = regex.compile(r"(?<=\p{L}\p{M}*)[\-‐¬­‑](?:[\s​]*)$")
_PAGE = regex.compile(
    r"^[\s\-–—―·.•*\[\](){}<>《》【】〔〕（）|/~_=+]*(?:第|page|p\.|pg\.?|tr\.|trang|頁|页|葉)?\s*(?:[0-9０-９lOoI]{0,3}[0-9０-９][0-9０-９lOoI]{0,3}|[一二三四五六七八九十百千〇零]{1,7}|[ivxlcdm]{1,7})\s*(?:葉|頁|页|张|張)?[\s\-–—―·.•*\[\](){}<>《》【】〔〕（）|/~_=+]*$",
    regex.I,
)
_PAGE_MARK = regex.compile(r"[\-–—―·.•*\[\](){}<>（）【】〔〕|/~第葉頁页]|page|trang", regex.I)
_HAN_HEADER = regex.compile(r"^\s*(?:[0-9０-９]{1,5}\s+)?[\p{Han}]{2,12}[卷巻](?!之)[一二三四五六七八九十百]+\s*(?:[0-9０-９]{1,5}|[一二三四五六七八九十百]+葉)?\s*$")
_VOLUME = regex.compile(r"\s*(?:卷之?[一二三四五六七八九十百]+|[,，]\s*(?:quyển|scroll|rouleau)\s*\d+).*$", regex.I)
# A heading of the work itself, its name before the volume, and what may follow the name in a header.
_HAN_HEADING = regex.compile(r"^\s*(\p{Han}{2,12})[卷巻]之")
_HAN_TITLE = regex.compile(r"^\s*(\p{Han}{2,12}?)(?:[卷巻]之?[一二三四五六七八九十百]|[^\p{Han}]|$)")
_HAN_REST = regex.compile(r"(?:(?!之)\p{Han}[一二三四五六七八九十百]+)?")
_HAN_NAME = regex.compile(r"\p{Han}{3,20}")
_NUMBER_AT_EDGE = regex.compile(r"^\s*\d{1,5}\s{1,}|\s{1,}\d{1,5}\s*$")
_HAN = regex.compile(r"\p{Han}")


def _plain(text: str) -> str:
    """Letters without accents or case, as a scanner loses those first."""
    base = unicodedata.normalize("NFD", text.lower()).replace("đ", "d").replace("0", "o").replace("1", "l")
    return "".join(c for c in base if c.isalpha())


_MEANT = str.maketrans(HAN_GLYPHS | {"巻": "卷"})


def _han_name(line: str) -> str:
    """The characters of a short Han line without page number and blanks, glyph edits undone; '' for any other line."""
    bare = "".join(_NUMBER_AT_EDGE.sub("", line).split())
    return bare.translate(_MEANT) if _HAN_NAME.fullmatch(bare) else ""


def _han_headers(lines: list[str], kinds: list[str], titles: tuple[str | None, ...]) -> list[int]:
    """The lines of Han, besides those that have the form, that repeat a header, each other or the title beside page breaks."""
    short = {at: name for at, line in enumerate(lines) if kinds[at] == "body" and not _HAN_HEADING.match(line) and (name := _han_name(line))}
    if not short:
        return []
    headers = {name for at, kind in enumerate(kinds) if kind == "header" and (name := _han_name(lines[at]))}
    works = {m[1].translate(_MEANT) for t in titles if t and (m := _HAN_TITLE.match(t))} | {m[1].translate(_MEANT) for line in lines if (m := _HAN_HEADING.match(line))}
    filled = [at for at, kind in enumerate(kinds) if kind != "blank"]
    place = {at: k for k, at in enumerate(filled)}

    def by_break(at: int) -> bool:
        k = place[at]
        return k == 0 or k == len(filled) - 1 or any(kinds[filled[j]] == "page_no" for j in (k - 1, k + 1)) or _NUMBER_AT_EDGE.search(lines[at]) is not None

    beside = {at: name for at, name in short.items() if by_break(at)}
    # A name that differs in one glyph of six is the same name, misread.
    out = [at for at, name in short.items() if any(_misread(name, other) for other in headers)]
    for at, name in beside.items():
        of_work = any(name.startswith(w) and _HAN_REST.fullmatch(name[len(w) :]) for w in works)
        if of_work or any(_misread(name, other) for k, other in beside.items() if k != at):
            out.append(at)
    return out


def _misread(a: str, b: str) -> bool:
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= len(a) // 6


def line_kinds(text: str, titles: tuple[str | None, ...] = ()) -> list[str]:
    """For each line: 'header', 'page_no', 'blank' or 'body'."""
    lines = text.split("\n")
    works = {p for t in titles if t and (p := _plain(_VOLUME.sub("", t)))}
    works |= {p for line in lines if (m := _VOLUME.search(line)) and len(line) < 60 and (p := _plain(line[: m.start()]))}
    seen: Counter = Counter()
    upper: dict[int, str] = {}
    kinds = []
    for at, line in enumerate(lines):
        if not line.strip():
            kinds.append("blank")
            continue
        if len(line) < 30 and _PAGE.match(line) and (any(c.isdigit() for c in line) or _PAGE_MARK.search(line)):
            kinds.append("page_no")
            continue
        if _HAN.search(line):
            kinds.append("header" if _HAN_HEADER.match(line) else "body")
            continue
        kinds.append("body")
        bare = _NUMBER_AT_EDGE.sub("", line).strip()
        letters = [c for c in bare if c.isalpha()]
        caps = sum(c.isupper() or c in "l" for c in letters)
        words = bare.split()
        spaced = len(words) >= 4 and sum(len(w) == 1 or len(unicodedata.normalize("NFC", w)) == 1 for w in words) >= 0.7 * len(words)
        if len(letters) >= 5 and len(bare) < 90 and (caps >= 0.8 * len(letters) or spaced):
            upper[at] = _plain(bare)
            seen[upper[at]] += 1
    for at, name in upper.items():
        near = any(_alike(name, work) for work in works)
        paged = _NUMBER_AT_EDGE.search(lines[at]) is not None
        by_break = at == 0 or any(kinds[j] == "page_no" for j in (at - 1, at + 1) if 0 <= j < len(kinds))
        repeated = seen[name] > 1 or any(_alike(name, other) for k, other in upper.items() if k != at)
        if near or repeated and (by_break or paged or len(name) < 60):
            kinds[at] = "header"
    for at in _han_headers(lines, kinds, titles):
        kinds[at] = "header"
    return kinds


def _alike(a: str, b: str) -> bool:
    """Whether two names differ by at most a fifth of their letters."""
    if a == b:
        return True
    if not a or not b or abs(len(a) - len(b)) > 0.25 * max(len(a), len(b)):
        return False
    grams = [Counter(x[i : i + 2] for i in range(len(x) - 1)) for x in (a, b)]
    common = sum((grams[0] & grams[1]).values())
    return common >= 0.6 * max(len(a), len(b), 2) - 1


@lru_cache(1)
def _strokes() -> dict[int, str]:
    """Letter → its skeleton: letters taken for each other have the same one, and a letter that is read as
    several has theirs."""
    same: dict[str, str] = {}

    def root(c: str) -> str:
        while c in same:
            c = same[c]
        return c

    for read, meant in GLYPHS:
        if len(read) == 1 and root(read) != root(meant):
            same[root(read)] = root(meant)
    apart = {root(meant): read for read, meant in GLYPHS if len(read) > 1}

    def spell(c: str) -> str:
        c = root(c)
        return "".join(map(spell, apart[c])) if c in apart else c

    return {ord(c): spell(c) for pair in GLYPHS for c in "".join(pair)}


def skeleton(word: str) -> str:
    return word.translate(_strokes())


def edits(read: str, meant: str) -> int | None:
    """The least number of glyph confusions that turn ``meant`` into ``read``; None if they cannot."""
    best = {(0, 0): 0}
    for i in range(len(read)):
        for j in range(len(meant)):
            if (done := best.get((i, j))) is None:
                continue
            steps = [(1, 1, 0)] if read[i] == meant[j] else []
            steps += [(len(a), len(b), 1) for a, b in GLYPHS if read.startswith(a, i) and meant.startswith(b, j)]
            for di, dj, cost in steps:
                if best.get((i + di, j + dj), 1 << 30) > done + cost:
                    best[i + di, j + dj] = done + cost
    return best.get((len(read), len(meant)))


@lru_cache(1)
def _projection() -> np.ndarray:
    return np.random.default_rng(11).choice(np.array([-1, 1], np.float32), (ROWS, WIDTH))


@lru_cache(200_000)
def _row(word: str) -> int:
    return xxhash.xxh32_intdigest(word) % ROWS


def _around(words: list[str], at: int) -> list[int]:
    """The random vectors of the two words before and the two after."""
    return [_row(words[i]) for i in (at - 2, at - 1, at + 1, at + 2) if 0 <= i < len(words)]


def _body(text: str, titles: tuple) -> tuple[list[str], list[str], list[tuple[int, str]]]:
    lines = text.split("\n")
    kinds = line_kinds(text, titles)
    return lines, kinds, [(i, lines[i]) for i, k in enumerate(kinds) if k == "body"]


def _stream(text: str, titles: tuple) -> tuple[list[str], list[str], list[tuple[int, str]], list[str], list[bool]]:
    """Lines, their kinds, the body lines, each body line's piece of the joined stream and whether it is broken off."""
    lines, kinds, body = _body(text, titles)
    pieces, broken = [], []
    for k, (_, line) in enumerate(body):
        cut = _HYPHEN.search(line)
        if cut and k + 1 < len(body) and body[k + 1][1].lstrip()[:1].isalpha():
            pieces.append(line[: cut.start()])
            broken.append(True)
        else:
            pieces.append(line.rstrip() + ("" if _HAN.search(line[-2:]) else " "))
            broken.append(False)
    return lines, kinds, body, pieces, broken


def _evidence(ident, text, title, html_title):
    """Layout rows at once; suspicious words and Han characters with their contexts for the joins.

    ``at`` and ``size`` are the place in the joined stream, ``following`` the line where a broken word ends.
    """
    if not text:
        return
    _, kinds, body, pieces, broken = _stream(text, (title, html_title))
    for number, kind in enumerate(kinds, 1):
        if kind in ("header", "page_no"):
            yield ident, number, kind, None, None, None, None, None, None, None, None, None, None
    owners = []
    for (at, _), piece, cut in zip(body, pieces, broken):
        if cut:
            yield ident, at + 1, "hyphen", None, None, None, None, None, None, None, None, None, None
        owners += [at + 1] * len(piece)
    joined = "".join(pieces)
    found = list(_WORD.finditer(joined))
    words = [unicodedata.normalize("NFC", m[0]) for m in found]
    for k, (m, word) in enumerate(zip(found, words)):
        if len(word) > 1 and not word[0].isdigit() and _SITES.search(word) and any(c.isalpha() for c in word):
            first, last = owners[m.start()], owners[m.end() - 1]
            cut = next((i for i in range(m.start(), m.end()) if owners[i] != first), m.end()) - m.start()
            yield ident, first, "word", word, None, None, None, None, m.start(), m.end() - m.start(), last, cut, _around(words, k)
    for at, char in enumerate(joined):
        if char in HAN_GLYPHS:
            yield ident, owners[at], "han", char, HAN_GLYPHS[char], *_contexts(joined, at), at, 1, None, None, None


def _contexts(text: str, at: int) -> tuple[str, str, str]:
    return "a" + text[max(0, at - 2) : at], "b" + text[at + 1 : at + 3], "c" + text[max(0, at - 1) : at] + "_" + text[at + 1 : at + 2]


_WATCHED = regex.compile("[" + "".join(sorted(set(HAN_GLYPHS) | set(HAN_GLYPHS.values()))) + "]")


def han_counts(texts: DataFrame) -> DataFrame:
    """(context, unit, n) over all texts: watched Han characters with three contexts each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(seen: Counter) -> pa.RecordBatch:
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(seen.values()), pa.int64())], ["context", "unit", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and _WATCHED.search(text):
                    flat = unicodedata.normalize("NFC", text).replace("\n", "")
                    for m in _WATCHED.finditer(flat):
                        for context in _contexts(flat, m.start()):
                            seen[(context, m[0])] += 1
            if len(seen) > 300_000:
                yield flush(seen)
                seen = Counter()
        if seen:
            yield flush(seen)

    return arrow_map(texts.select("text"), count, "context string, unit string, n bigint").groupBy("context", "unit").agg(F.sum("n").alias("n"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(seen: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(_WORD.findall(text if text.isascii() else unicodedata.normalize("NFC", text)))
            if len(seen) > 300_000:
                yield flush(seen)
                seen = Counter()
        if seen:
            yield flush(seen)

    return arrow_map(texts.select("text"), count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def mean_context(counts: DataFrame) -> np.ndarray:
    """The mean of the contexts of all words: each word stands in those of four others."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total, n = _projection(), np.zeros(WIDTH), 0
        for batch in batches:
            if batch.num_rows:
                weights = batch.column(1).to_numpy()
                total += weights @ table[[_row(w) for w in batch.column(0).to_pylist()]]
                n += int(weights.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.float64()))], ["n", "total"])

    # One row of fixed size for each partition.
    total, n = np.zeros(WIDTH), 0
    for part in arrow_map(counts.select("word", "n"), add, "n bigint, total array<double>").toLocalIterator():
        total, n = total + np.array(part.total), n + part.n
    return 4 * total / max(n, 1)


def _bit(word: str, bits: int) -> int:
    return xxhash.xxh3_64_intdigest(word) >> (64 - bits)


def word_filter(words: DataFrame) -> tuple[int, bytes]:
    """(log2 of its bits, the filter) of the words (word); a filter that is full lets all words pass, which costs time only."""
    bits = (min(max(BITS_EACH * words.count(), LEAST_BITS), MOST_BITS) - 1).bit_length()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, bool)
        for batch in batches:
            for word in batch.column(0).to_pylist():
                table[_bit(word, bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(table).tobytes()], pa.binary())], ["bits"])

    whole = np.zeros((1 << bits) // 8, np.uint8)
    for part in arrow_map(words.coalesce(8), fill, "bits binary").toLocalIterator():
        whole |= np.frombuffer(part.bits, np.uint8)
    return bits, whole.tobytes()


def word_vectors(texts: DataFrame, wanted: tuple[int, bytes]) -> DataFrame:
    """(word, vec): the sums of the contexts of the words that pass the filter ``wanted``, over all texts."""
    bits, packed = wanted
    shared = texts.sparkSession.sparkContext.broadcast(packed)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.vstack([_projection(), np.zeros((1, WIDTH), np.float32)])
        passes = shared.value
        numbers: dict[str, int] = {}  # the number of a word, -1 if it is not wanted
        names: list[str] = []
        sums = np.zeros((1024, WIDTH), np.float32)

        def flush() -> pa.RecordBatch:
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(sums[: len(names)].ravel()), WIDTH).cast(pa.list_(pa.float32()))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), vectors], ["word", "vec"])

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                at: list[int] = []
                near: list[list[int]] = []
                for text in batch.column(0).slice(start, 256).to_pylist():
                    if not text:
                        continue
                    words = _WORD.findall(text if text.isascii() else unicodedata.normalize("NFC", text))
                    for k, word in enumerate(words):
                        if (number := numbers.get(word)) is None:
                            place = _bit(word, bits)
                            number = -1
                            if passes[place >> 3] >> (7 - (place & 7)) & 1:
                                number = len(names)
                                names.append(word)
                            numbers[word] = number
                        if number >= 0:
                            around = _around(words, k)
                            at.append(number)
                            near.append(around + [ROWS] * (4 - len(around)))
                if at:
                    if len(names) > len(sums):
                        sums = np.pad(sums, [(0, (1 << (len(names) - 1).bit_length()) - len(sums)), (0, 0)])
                    np.add.at(sums, np.array(at), table[np.array(near)].sum(axis=1))
            if len(numbers) > 300_000:
                yield flush()
                numbers, names, sums = {}, [], np.zeros((1024, WIDTH), np.float32)
        yield flush()

    parts = arrow_map(texts.select("text"), learn, "word string, vec array<float>")
    summed = [F.sum(F.col("vec")[i]).alias(f"v{i}") for i in range(WIDTH)]
    return parts.groupBy("word").agg(*summed).select("word", F.array(*[F.col(f"v{i}") for i in range(WIDTH)]).alias("vec"))


def linked_words(words: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, meant, n, meant_n, prior): each distinct word with the more frequent ones that glyphs link it to.

    ``prior`` is what frequency, and a sign between letters, say for ``meant``.
    """
    spelt = flat_map(counts, lambda w, n: [(skeleton(w), w, n)], "skeleton string, word string, n bigint")
    mine = spelt.join(words.select("word").distinct(), "word", "left_semi")
    other = spelt.select("skeleton", F.col("word").alias("meant"), F.col("n").alias("meant_n"))
    pairs = mine.join(other, "skeleton").where("word <> meant and meant_n > n and meant_n > 2")

    def possible(w, m, n, k):
        if edits(w, m):
            yield w, m, n, k, float(np.log(k / n) / np.log(RATIO) + (SIGN if _SIGN_INSIDE.search(w) else 0.0))

    return flat_map(pairs.select("word", "meant", "n", "meant_n"), possible, "word string, meant string, n bigint, meant_n bigint, prior double")


def garbled_words(words: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """Occurrences of words (key, line_no, word, at, size, following, cut) that are misread, with what is meant."""
    counts = keep(word_counts(corpus))
    links = keep(linked_words(words, counts))
    mean = mean_context(counts)
    # The context says between -1 and 1, so a prior of 2 needs no vector, and one of 0 is never enough.
    certain = words.join(links.where("prior >= 2"), "word").withColumn("score", F.col("prior") + 1)
    open_ = links.where("prior > 0 and prior < 2")
    wanted = keep(open_.select("word").unionByName(open_.select(F.col("meant").alias("word"))).distinct())
    vectors = keep(word_vectors(corpus, word_filter(wanted)).join(wanted, "word", "left_semi"))
    held = open_.join(vectors, "word").join(vectors.toDF("meant", "meant_vec"), "meant")
    kind = dict(words.dtypes)[key]

    def decide(ident, line_no, word, at, size, following, cut, near, meant, n, meant_n, prior, vec, meant_vec):
        own = _projection()[near].sum(axis=0) if near else np.zeros(WIDTH)
        around = own - mean

        def fit(vector, count):
            v = np.array(vector, np.float64) - count * mean
            norm = np.linalg.norm(v) * np.linalg.norm(around)
            # A vector of few occurrences says little.
            return float(v @ around / norm) * count / (count + FEW) if norm > 1e-9 else 0.0

        # The occurrence itself does not speak for what was read.
        gain = fit(meant_vec, meant_n) - (fit(np.array(vec) - own, n - 1) if n > 1 else 0.0)
        if (score := prior + min(1.0, max(-1.0, gain))) >= 1:
            yield ident, line_no, word, at, size, following, cut, meant, score

    columns = [key, "line_no", "word", "at", "size", "following", "cut"]
    cases = words.join(held, "word").select(*columns, "near", "meant", "n", "meant_n", "prior", "vec", "meant_vec")
    judged = flat_map(cases, decide, f"{key} {kind}, line_no bigint, word string, at int, size int, following bigint, cut int, meant string, score double")
    found = judged.unionByName(certain.select(*columns, "meant", "score"))
    return found.groupBy(*columns).agg(F.max_by("meant", F.struct("score", "meant")).alias("meant"))


def scan_evidence(rows: DataFrame, corpus: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Layout lines, garbled words and garbled Han characters of ``rows``, judged by ``corpus``."""
    kind = dict(rows.dtypes)[key]
    schema = f"{key} {kind}, line_no bigint, kind string, unit string, meant string, left string, right string, around string, at int, size int, following bigint, cut int, near array<int>"
    evidence = keep(flat_map(rows.select(key, "text", "title", "html_title"), _evidence, schema).distinct())
    layout = evidence.where("kind in ('header', 'page_no', 'hyphen')").select(key, "line_no", "kind")
    words = evidence.where("kind = 'word'").select(key, "line_no", F.col("unit").alias("word"), "at", "size", "following", "cut", "near")
    bad_words = garbled_words(words, corpus, key)
    han = evidence.where("kind = 'han'").select(key, "line_no", "unit", "meant", "left", "right", "around", "at")
    vectors = keep(han_counts(corpus))
    distinct = han.select("unit", "meant", "left", "right", "around").distinct()
    scored = distinct
    for side in ("left", "right", "around"):
        for unit in ("unit", "meant"):
            vector = vectors.select(F.col("context").alias(side), F.col("unit").alias(unit), F.col("n").alias(f"{side}_{unit}"))
            scored = scored.join(vector, [side, unit], "left")

    def gain(side: str):
        # The occurrence itself is taken from the count of what was read.
        read = F.greatest(F.coalesce(f"{side}_unit", F.lit(0)) - 1, F.lit(0))
        return F.log((F.coalesce(f"{side}_meant", F.lit(0)) + 0.5) / (read + 0.5))

    # A character that is rare beside its neighbour in all contexts is suspect before any is seen.
    total = vectors.where("context like 'c%'").groupBy("unit").agg(F.sum("n").alias("n"))
    scored = scored.join(total.toDF("unit", "unit_n"), "unit", "left").join(total.toDF("meant", "meant_n"), "meant", "left")
    rare = F.when(F.col("meant_n") >= RATIO * F.coalesce("unit_n", F.lit(0)), MARGIN).otherwise(0.0)
    fit = scored.where(gain("left") + gain("right") + gain("around") + rare >= MARGIN).select("unit", "meant", "left", "right", "around")
    bad_han = han.join(fit, ["unit", "meant", "left", "right", "around"])
    return layout, bad_words, bad_han


def scan_faults(rows: DataFrame, corpus: DataFrame, key: str = "global_id") -> DataFrame:
    """(key, line_no, kind) of running headers, page numbers, broken words and garbled body lines."""
    layout, words, han = scan_evidence(rows, corpus, key)

    def side(word, meant, cut, line_no, following):
        # The line that holds the first letter which differs.
        differs = next((i for i, (a, b) in enumerate(zip(word, meant)) if a != b), min(len(word), len(meant)))
        return line_no if differs < cut else following

    kind = dict(rows.dtypes)[key]
    placed = flat_map(words.select(key, "line_no", "word", "meant", "cut", "following"), lambda k, n, w, m, c, f: [(k, side(w, m, c, n, f))], f"{key} {kind}, line_no bigint")
    garbled = placed.unionByName(han.select(key, "line_no")).withColumn("kind", F.lit("garble"))
    return reduce(DataFrame.unionByName, [layout, garbled]).distinct()


def repaired_text(rows: DataFrame, corpus: DataFrame, key: str = "global_id") -> DataFrame:
    """(key, text) in continuous paragraphs: furniture removed, broken words joined, glyphs corrected.

    Corrections are made in place, in the stream of body lines, before it is set in paragraphs.
    """
    _, words, han = scan_evidence(rows, corpus, key)
    fixes = words.select(key, "at", "size", "meant").unionByName(han.select(key, "at", F.lit(1).alias("size"), "meant")).distinct()
    packed = fixes.groupBy(key).agg(F.collect_set(F.struct("at", "size", "meant")).alias("fixes"))

    def mend(ident, text, title, html_title, found):
        if text is None:
            return [(ident, None)]
        _, _, body, pieces, broken = _stream(text, (title, html_title))
        chars = list("".join(pieces))
        for fix in found or []:
            if fix["at"] + fix["size"] <= len(chars):
                # What a broken word becomes stands where it began.
                chars[fix["at"] : fix["at"] + fix["size"]] = [fix["meant"]] + [""] * (fix["size"] - 1)
        paragraphs: list[str] = []
        longest = max((len(line) for _, line in body), default=0)
        open_, at, joins = False, 0, False
        for (_, line), piece, cut in zip(body, pieces, broken):
            mended = "".join(chars[at : at + len(piece)])
            at += len(piece)
            mended = mended if cut else mended.rstrip()
            if open_ and paragraphs:
                glue = "" if joins or _HAN.search(mended[:1]) or _HAN.search(paragraphs[-1][-1:]) else " "
                paragraphs[-1] += glue + mended.lstrip()
            else:
                paragraphs.append(mended)
            joins = cut
            # A short line ends its paragraph.
            open_ = cut or len(line.rstrip()) >= 0.75 * longest
        return [(ident, "\n".join(paragraphs))]

    kind = dict(rows.dtypes)[key]
    joined = rows.select(key, "text", "title", "html_title").dropDuplicates([key]).join(packed, key, "left")
    return flat_map(joined, mend, f"{key} {kind}, text string")
