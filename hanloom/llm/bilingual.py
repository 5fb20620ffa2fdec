"""Problem 4: sentence alignment in pairs of documents that translate each other.

Cross-lingual vectors come from a singular value decomposition of paired document terms: the
terms are Vietnamese syllables and Han characters, the paired documents are the entries of the
translation table and the document pairs themselves, in a second round the line pairs found in the
first.  Lines, and parts of lines cut at joints, are compared by how much of each side's weight the
other side's vectors cover.  A pair is kept when its lines are each other's nearest, or when one
line merges units and the other is nearest to it, by a margin over the competing neighbours.  A
line merges units if it has a joint, or if a window that joins two lines whose nearest it is covers
it better than either does alone.  Nothing asks for the same order.

Null or missing texts, pairs that name no file and blank lines give no row; repeated rows count once.
The vocabulary (syllables of a language, Han characters) is closed and held in tables of fixed size.
Of several texts under one file name the least counts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep
from .common import arrow_map, flat_map

_VI = regex.compile(r"\d+(?:[.,]\d+)*|[\p{L}\p{M}]+")
_ZH = regex.compile(r"[一二三四五六七八九十百千萬万正廿卅〇零]+(?=[^\p{L}]|\p{L}|$)|\d+(?:[.,]\d+)*|\p{Han}")
_CUT_VI, _CUT_ZH = regex.compile(r"[;；]\s*|,\s*rồi\s+|(?<!\d),\s+(?=\p{Lu})"), regex.compile(r"[；;，,]")
_VOLUME_VI, _VOLUME_ZH = regex.compile(r"(?:quyển|q\.)\s*(\d+)\s*$", regex.I), regex.compile(r"卷之?([一二三四五六七八九十百]+)\s*$")
_DIGIT = {c: i for i, c in enumerate("〇一二三四五六七八九")} | {"零": 0}
_UNIT = {"十": 10, "百": 100, "千": 1000, "萬": 10000, "万": 10000}

#: Rank of the decomposition, a random projection of OVER more dimensions sharpened by STEPS power steps.
RANK, OVER, STEPS = 300, 60, 4
#: Terms of a language are rows by their hash, so vectors of any vocabulary have a size with a proven bound; with
#: the closed vocabularies of syllables and Han characters, collisions are rare.
TERMS = 1 << 16
#: Two terms are paired if their joint weight is at least this share of the mean of their own.
LEAST_ASSOCIATION = 0.02
#: Terms in a table of counts held by a task; a fuller table is passed on and begun anew.
TABLE = 3_000
#: Least cosine that counts, least score of a pair and its margin over the rest.
LEAST_COSINE, LEAST_SCORE, MARGIN = 0.4, 0.54, 0.1
#: What a window of two lines must score above the better of them for the line opposite to merge both.
JOINED = 0.04


def han_number(text: str) -> int | None:
    """The value of a numeral, or None where the characters make none."""
    total = section = digit = 0
    for c in text:
        if c in _DIGIT:
            digit = _DIGIT[c]
        elif c in _UNIT:
            unit = _UNIT[c]
            if unit == 10000:
                total += (section + digit or 1) * unit
                section = 0
            else:
                section += (digit or 1) * unit
            digit = 0
        else:
            return None
    return total + section + digit


def vi_terms(line: str) -> list[str]:
    out = []
    for t in _VI.findall(unicodedata.normalize("NFC", line).lower()):
        out.append("#" + regex.sub(r"\D", "", t).lstrip("0") if t[0].isdigit() else t)
    return out


def zh_terms(line: str) -> list[str]:
    out = []
    for t in _ZH.findall(unicodedata.normalize("NFKC", line)):
        if t[0].isdigit():
            out.append("#" + regex.sub(r"\D", "", t).lstrip("0"))
        elif len(t) > 1 and (n := han_number(t)):
            out.append(f"#{n}")
        else:
            # One numeral may be part of a name as well as a number.
            out.append(t)
            if (n := han_number(t)) is not None:
                out.append(f"#{n}")
    return out


@lru_cache(1 << 17)
def row_of(term: str) -> int:
    """The row of a term in its language's table."""
    return xxhash.xxh32_intdigest(term) % TERMS


class Vectors:
    """Vectors of both languages' terms and the weights of terms, by their rows."""

    def __init__(self, left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, weights: tuple[np.ndarray, np.ndarray]) -> None:
        self.place = tuple(self._index(rows) for rows in (left, right))
        width = a.shape[1] if len(a) else 1
        # The last row, of zeros, stands for terms without a vector.
        self.vectors = tuple(np.vstack([v.reshape(-1, width), np.zeros((1, width))]).astype(np.float32) for v in (a, b))
        self.weights = weights

    @staticmethod
    def _index(rows: np.ndarray) -> np.ndarray:
        index = np.full(TERMS, -1, np.int32)
        index[rows] = np.arange(len(rows))
        return index

    def of(self, side: int, terms: list[str]) -> np.ndarray:
        return self.vectors[side][self.place[side][[row_of(t) for t in terms]]]

    def cosines(self, left: list[str], right: list[str]) -> np.ndarray:
        sim = self.of(0, left) @ self.of(1, right).T
        sim[sim < LEAST_COSINE] = 0
        place = {t: j for j, t in enumerate(right)}
        for i, t in enumerate(left):
            if t[0] == "#" and t in place:
                sim[i, place[t]] = 1
        return np.minimum(sim, 1)

    def weight(self, side: int, terms: list[str]) -> np.ndarray:
        rows = self.weights[side][[row_of(t) for t in terms]]
        for i, t in enumerate(terms):
            if t[0] == "#":
                rows[i] = 2.5 if len(t) > 2 else 0.7
        return rows


def _blend(forth, back):
    return 0.6 * np.maximum(forth, back) + 0.4 * np.minimum(forth, back)


class Coverage:
    """How much of the weight of each line the lines of the other side cover, alone or joined."""

    def __init__(self, lines_a: list[list[str]], lines_b: list[list[str]], vectors: Vectors) -> None:
        ta, tb = sorted({t for x in lines_a for t in x}), sorted({t for x in lines_b for t in x})
        sim = vectors.cosines(ta, tb)
        ia, ib = {t: i for i, t in enumerate(ta)}, {t: i for i, t in enumerate(tb)}

        places = [[sorted({index[t] for t in x}) for x in lines] for lines, index in ((lines_a, ia), (lines_b, ib))]

        def one(rows, terms, columns, table, side):
            own = vectors.weight(side, terms)
            weight = np.zeros((len(rows), len(terms)), np.float32)
            for i, x in enumerate(rows):
                weight[i, x] = own[x]
            flat = np.concatenate([np.array(y) for y in columns])
            starts = np.cumsum([0, *map(len, columns[:-1])])
            return weight, np.maximum.reduceat(np.ascontiguousarray(table.T)[flat], starts, axis=0).T

        # For each side: the weights (line, term) and the best cosine of (term, line of the other side).
        self.sides = one(places[0], ta, places[1], sim, 0), one(places[1], tb, places[0], sim.T, 1)

    def scores(self) -> np.ndarray:
        """The score of each line of a with each line of b."""
        forth, back = (weight @ best / np.maximum(weight.sum(axis=1, keepdims=True), 1e-6) for weight, best in self.sides)
        return _blend(forth, back.T)

    def joined(self, side: int, line: int, j: int, k: int) -> float:
        """The score of a line of ``side`` with the window that joins the lines j and k of the other side."""
        (mine, best), (theirs, best_of_theirs) = self.sides[side], self.sides[1 - side]
        both = np.maximum(theirs[j], theirs[k])
        forth = mine[line] @ np.maximum(best[:, j], best[:, k]) / max(mine[line].sum(), 1e-6)
        return float(_blend(forth, both @ best_of_theirs[:, line] / max(both.sum(), 1e-6)))


def _windows(text: str, terms, cuts: regex.Pattern) -> list[tuple[int, list[str]]]:
    """(line number, terms) of every line, and of the parts of lines that may merge two units."""
    lines = [(n, line, t) for n, line in enumerate(text.split("\n"), 1) if (t := terms(line))]
    usual = float(np.median([len(t) for _, _, t in lines])) if lines else 0.0
    out = []
    for n, line, t in lines:
        out.append((n, t))
        for m in cuts.finditer(line):
            if len(t) > 1.3 * usual or m[0].strip() not in ("，", ",", "、"):
                for part in (line[: m.start()], line[m.end() :]):
                    if len(found := terms(part)) >= 5:
                        out.append((n, found))
    return out


def _by_line(matrix: np.ndarray, rows: list[int], columns: list[int]) -> np.ndarray:
    """The best of each line's windows."""
    out = np.maximum.reduceat(matrix, np.flatnonzero(np.diff(rows, prepend=-1)), axis=0)
    return np.maximum.reduceat(out, np.flatnonzero(np.diff(columns, prepend=-1)), axis=1)


def align(text_a: str, text_b: str, vectors: Vectors, least: float = LEAST_SCORE) -> list[tuple[int, int, float]]:
    """(line of a, line of b, score) of the lines that translate each other, numbered from 1."""
    rows_a, rows_b = _windows(text_a, vi_terms, _CUT_VI), _windows(text_b, zh_terms, _CUT_ZH)
    if not rows_a or not rows_b:
        return []
    cover = Coverage([t for _, t in rows_a], [t for _, t in rows_b], vectors)
    numbers_a, numbers_b = [n for n, _ in rows_a], [n for n, _ in rows_b]
    windows = cover.scores()
    score = _by_line(windows, numbers_a, numbers_b)
    lines_a, lines_b = list(dict.fromkeys(numbers_a)), list(dict.fromkeys(numbers_b))
    merged_a = np.array([numbers_a.count(n) > 1 for n in lines_a])
    merged_b = np.array([numbers_b.count(n) > 1 for n in lines_b])
    whole_a, whole_b = np.flatnonzero(np.diff(numbers_a, prepend=-1)), np.flatnonzero(np.diff(numbers_b, prepend=-1))
    whole = windows[np.ix_(whole_a, whole_b)]
    nearest_a, nearest_b = score.argmax(axis=1), score.argmax(axis=0)
    all_a, all_b = text_a.split("\n"), text_b.split("\n")
    first_a, first_b = score.max(axis=1), score.max(axis=0)

    def rest(matrix: np.ndarray) -> np.ndarray:
        """The mean of the next neighbours of each row, the two best left out as a line may merge two."""
        order = np.sort(matrix, axis=1)[:, ::-1]
        return order[:, 2:5].mean(axis=1) if order.shape[1] > 2 else np.zeros(len(matrix))

    def merges(side: int, line: int, other: int) -> bool:
        """Whether ``line`` merges the unit of ``other`` and that of a further line whose nearest it is."""
        alone, own, back = (whole[line], nearest_a[line], nearest_b) if side == 0 else (whole[:, line], nearest_b[line], nearest_a)
        mine, theirs = (whole_a, whole_b) if side == 0 else (whole_b, whole_a)
        scored = score[line] if side == 0 else score[:, line]
        partners = {int(own), *map(int, np.flatnonzero((back == line) & (scored >= least)))} - {int(other)}
        return any(cover.joined(side, mine[line], theirs[other], theirs[k]) >= max(alone[other], alone[k]) + JOINED for k in partners)

    rest_a, rest_b = rest(score), rest(score.T)
    out = []
    for i, j in zip(*np.where(score >= least)):
        s = score[i, j]
        margin = s - (rest_a[i] + rest_b[j]) / 2
        best_a, best_b = s >= first_a[i] - 1e-9, s >= first_b[j] - 1e-9
        # Mutual neighbours, or the neighbour of one side inside the other's merged line.
        if margin >= MARGIN and (best_a and (best_b or merged_b[j] or merges(1, j, i)) or best_b and (merged_a[i] or merges(0, i, j))):
            a, b = all_a[lines_a[i] - 1], all_b[lines_b[j] - 1]
            volume_a, volume_b = _VOLUME_VI.search(a), _VOLUME_ZH.search(b)
            if volume_a and volume_b and int(volume_a[1]) != han_number(volume_b[1]):
                continue  # headings of different volumes name the same work only
            out.append((lines_a[i], lines_b[j], float(s)))
    return out


def document_pairs(sources: DataFrame, candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """(src, tgt, a, b): the texts of every listed pair with both present, each pair once."""
    pairs = gold.select("src", "tgt").where("src is not null and tgt is not null").distinct()
    a = sources.where("text is not null").groupBy(F.col("file_name").alias("src")).agg(F.min("text").alias("a"))
    named = candidates.where("txt_path is not null and text is not null").select(F.element_at(F.split("txt_path", "/"), -1).alias("tgt"), "text")
    wanted = pairs.select("tgt").distinct()
    b = named.join(wanted, "tgt", "left_semi").groupBy("tgt").agg(F.min("text").alias("b"))
    return pairs.join(a, "src").join(b, "tgt").select("src", "tgt", "a", "b")


def _counts(units: DataFrame) -> DataFrame:
    """(s, c, n): the joint weight of two terms' rows over the paired units; s or c is -1 for a term alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Terms are numbered as they come; row and column 0 count a term alone.
        rows: dict[int, int] = {-1: 0}
        columns: dict[int, int] = {-1: 0}
        table = np.zeros((TABLE + 1, TABLE + 1), np.float32)

        def flush() -> pa.RecordBatch:
            i, j = np.nonzero(table[: len(rows), : len(columns)])
            s, c = np.array(list(rows)), np.array(list(columns))
            keep = (i > 0) | (j > 0)
            return pa.RecordBatch.from_arrays([pa.array(s[i[keep]], pa.int32()), pa.array(c[j[keep]], pa.int32()), pa.array(table[i[keep], j[keep]].astype(np.float64))], ["s", "c", "n"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = sorted({row_of(t) for t in vi_terms(a) if t[0] != "#"})
                y = sorted({row_of(t) for t in zh_terms(b) if t[0] != "#"})
                # A short unit says more about its terms than a long one.
                weight = 1.0 / max(1, len(x), len(y))
                for k in range(0, max(len(x), 1), TABLE):
                    for m in range(0, max(len(y), 1), TABLE):
                        part_x, part_y = x[k : k + TABLE], y[m : m + TABLE]
                        if len(rows) + len(part_x) > TABLE or len(columns) + len(part_y) > TABLE:
                            if sum(t not in rows for t in part_x) + len(rows) > TABLE + 1 or sum(t not in columns for t in part_y) + len(columns) > TABLE + 1:
                                yield flush()
                                rows, columns = {-1: 0}, {-1: 0}
                                table[:] = 0
                        i = [rows.setdefault(t, len(rows)) for t in part_x]
                        j = [columns.setdefault(t, len(columns)) for t in part_y]
                        table[np.ix_(i, j)] += weight
                        # A term alone counts once, whatever parts a long unit has.
                        if m == 0:
                            table[i, 0] += weight
                        if k == 0:
                            table[0, j] += weight
        yield flush()

    return arrow_map(units, count, "s int, c int, n double").groupBy("s", "c").agg(F.sum("n").alias("n"))


def decompose(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int], rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows and of the columns of a sparse matrix, from its leading singular vectors.

    A random projection, sharpened by power steps, spans the leading singular vectors; where the matrix has no
    more dimensions than the projection, that is the whole decomposition.
    """
    if not len(values):
        return np.zeros((shape[0], 1)), np.zeros((shape[1], 1))

    def product(i: np.ndarray, j: np.ndarray, size: tuple[int, int]):
        """Multiplies the matrix with entries at (i, j) from the left: densely in strips of rows where that is less work."""
        order = np.argsort(i, kind="stable")
        i, j, v = i[order], j[order], values[order]
        if len(v) * 25 >= size[0] * size[1]:
            strip = max(1, (1 << 24) // size[1])
            edges = np.searchsorted(i, np.arange(0, size[0] + strip, strip))

            def dense(x: np.ndarray) -> np.ndarray:
                out = np.empty((size[0], x.shape[1]), np.float32)
                for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
                    part = np.zeros((min(strip, size[0] - k * strip), size[1]), np.float32)
                    part[i[lo:hi] - k * strip, j[lo:hi]] = v[lo:hi]
                    out[k * strip : k * strip + len(part)] = part @ x.astype(np.float32)
                return out

            return dense
        first = np.flatnonzero(np.diff(i, prepend=-1))

        def sparse(x: np.ndarray) -> np.ndarray:
            out = np.zeros((size[0], x.shape[1]))
            for k in range(0, x.shape[1], 32):
                out[i[first], k : k + 32] = np.add.reduceat(v[:, None] * x[j, k : k + 32], first, axis=0)
            return out

        return sparse

    forth, back = product(rows, columns, shape), product(columns, rows, shape[::-1])
    basis = np.random.default_rng(7).standard_normal((shape[1], min(rank + OVER, *shape)))
    for _ in range(STEPS):
        left_basis, _ = np.linalg.qr(forth(basis))
        basis, _ = np.linalg.qr(back(left_basis))
    inner, sv, vt = np.linalg.svd(back(left_basis).T, full_matrices=False)
    rank = min(rank, len(sv))
    a, b = (left_basis @ inner)[:, :rank] * np.sqrt(sv[:rank]), vt[:rank].T * np.sqrt(sv[:rank])
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-6), b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-6)


def _columns(rows: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns as arrays, read batch by batch."""
    table = rows.select(*names).toArrow()
    return [table.column(n).to_numpy() for n in names]


def learn_vectors(units: DataFrame, lines: DataFrame) -> Vectors:
    """Vectors from the paired units (a, b) by decomposition; weights from how many lines hold a term.

    The associations that come to the driver are those of two tables of TERMS rows, without the pairs that
    stand together by chance; they depend on the two vocabularies and not on how many texts there are.
    """
    counts = keep(_counts(units))
    alone_s, alone_c = counts.where("c = -1").select("s", F.col("n").alias("n_s")), counts.where("s = -1").select("c", F.col("n").alias("n_c"))
    both = counts.where("s >= 0 and c >= 0").join(F.broadcast(alone_s), "s").join(F.broadcast(alone_c), "c")
    value = F.col("n") / F.sqrt(F.col("n_s") * F.col("n_c"))
    s, c, values = _columns(both.where(value >= LEAST_ASSOCIATION).select("s", "c", (value * value).alias("value")).orderBy("s", "c"), "s", "c", "value")
    (left,), (right,) = _columns(alone_s.orderBy("s"), "s"), _columns(alone_c.orderBy("c"), "c")
    a, b = decompose(np.searchsorted(left, s), np.searchsorted(right, c), values, (len(left), len(right)))

    def held(side, text, _):
        cut = vi_terms if side == 0 else zh_terms
        for line in text.split("\n"):
            for t in {t for t in cut(line) if t[0] != "#"}:
                yield side, row_of(t)

    sides = lines.select(F.lit(0).alias("side"), F.col("a").alias("text"), "src").distinct().unionByName(lines.select(F.lit(1).alias("side"), F.col("b").alias("text"), F.col("tgt").alias("src")).distinct())
    side, row, n = _columns(flat_map(sides, held, "side int, row int").groupBy("side", "row").count(), "side", "row", "count")
    weights = (np.full(TERMS, 4.0, np.float32), np.full(TERMS, 4.0, np.float32))
    for k, table in enumerate(weights):
        if (mine := side == k).any():
            table[row[mine]] = np.log(1 + 4 * max(1, int(n[mine].max())) / n[mine])
    return Vectors(left, right, a, b, weights)


def aligned_lines(sources: DataFrame, candidates: DataFrame, gold: DataFrame, table: DataFrame, rounds: int = 2) -> DataFrame:
    """(tgt, tgt_line, src, src_line, score) of the lines that translate each other."""
    pairs = keep(document_pairs(sources, candidates, gold))
    entries = table.where("tgt <> ''").select(F.col("src_norm").alias("a"), F.col("tgt").alias("b"))
    units = entries.unionByName(pairs.select("a", "b"))
    found = None
    for turn in range(rounds):
        shared = pairs.sparkSession.sparkContext.broadcast(learn_vectors(units, pairs))
        last = turn == rounds - 1

        def match(src, tgt, a, b, shared=shared, last=last):
            rows_a, rows_b = a.split("\n"), b.split("\n")
            for i, j, s in align(a, b, shared.value, LEAST_SCORE if last else LEAST_SCORE + 0.05):
                yield tgt, j, src, i, s, None if last else rows_a[i - 1], None if last else rows_b[j - 1]

        schema = "tgt string, tgt_line bigint, src string, src_line bigint, score double, a string, b string"
        spread = pairs.repartition(F.xxhash64("src", "tgt"))
        found = flat_map(spread.select("src", "tgt", "a", "b"), match, schema)
        units = entries.unionByName(found.select("a", "b")) if not last else units
    return found.select("tgt", "tgt_line", "src", "src_line", "score")
