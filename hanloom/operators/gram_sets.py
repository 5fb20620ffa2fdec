"""Sets of character runs in numpy, over Arrow batches: classes of equal sets, and candidates and proofs of similar ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..session import ship

#: Hashed places of the count of each run and of the runs looked up (powers of two), parts a table travels in, texts handled at once.
COUNTS, FLAGS, PARTS, TEXTS = 22, 26, 64, 512
_U = np.uint64


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> _U(27))) * _U(0x94D049BB133111EB)
    return values ^ (values >> _U(31))


def sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, run): the different runs of ``n`` characters of each text, sorted; a shorter text is its own only run, an empty one has none.

    Up to three characters are a number of their own, longer runs a 64-bit hash.
    """
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + _U(1)
    owner, first = np.repeat(np.arange(len(texts)), lengths), np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.arange(len(chars)) - first
    width = np.minimum(lengths, n)[owner]
    start = place + width <= lengths[owner]
    at, owner, width = np.flatnonzero(start), owner[start], width[start]
    value = np.zeros(len(at), np.uint64)
    for k in range(n):
        char = np.where(k < width, chars[np.minimum(at + k, len(chars) - 1)] if len(chars) else value, _U(0))
        value = np.where(k < width, value << _U(21) | char if n <= 3 else _mix(value * _U(31) + char), value)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def _map(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run(columns as lists)`` for some texts at a time gives columns."""
    ship(df.sparkSession)
    kind = _parse_datatype_string(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                made = run(*(c.to_pylist() for c in batch.slice(at, TEXTS).columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, arrow)], schema=arrow)

    return df.mapInArrow(each, kind)


def with_class(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(key, scope, cls, size, text) of (key, scope, text); texts without runs are left out."""

    def run(keys, scopes, texts):
        owner, runs = sets(texts, n)
        size = np.bincount(owner, minlength=len(texts))
        ends = np.cumsum(size)
        some = np.flatnonzero(size)
        names = [xxhash.xxh3_64_intdigest(runs[ends[i] - size[i] : ends[i]].tobytes(), xxhash.xxh32_intdigest("" if scopes[i] is None else "=" + scopes[i])) for i in some]
        return [keys[i] for i in some], [scopes[i] for i in some], np.array(names, np.uint64).view(np.int64), size[some], [texts[i] for i in some]

    kind = dict(rows.dtypes)[key]
    return _map(rows.where("text is not null"), run, f"{key} {kind}, scope string, cls bigint, size int, text string")


def _hashes(scopes, texts, n):
    owner, runs = sets(texts, n)
    salt = np.array([0 if s is None else xxhash.xxh3_64_intdigest(s) for s in scopes], np.uint64)
    return owner, _mix(runs + salt[owner])


def _table(classes: DataFrame, fill: Callable, cells: int, kind: type, join: Callable) -> np.ndarray:
    """A table of fixed size that each task fills and executors join part by part."""
    ship(classes.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(cells, kind)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                fill(own, *(c.to_pylist() for c in batch.slice(at, TEXTS).columns))
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([x.tobytes() for x in np.split(own, PARTS)], pa.binary())], ["part", "cells"])

    def whole(t: pa.Table) -> pa.Table:
        out = np.zeros(cells // PARTS, kind)
        for x in t.column("cells"):
            out = join(out, np.frombuffer(x.as_buffer(), kind))
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "cells": pa.array([out.tobytes()], pa.binary())})

    parts = classes.coalesce(8).mapInArrow(each, "part int, cells binary").groupBy("part").applyInArrow(whole, "part int, cells binary")
    return np.concatenate([np.frombuffer(r.cells, kind) for r in sorted(parts.collect(), key=lambda r: r.part)])


def _joined_counts(a, b):
    return np.minimum(a.astype(np.uint32) + b, 65535).astype(np.uint16)


def candidates(classes: DataFrame, n: int, least: float, metric: str) -> DataFrame:
    """(a, b): pairs of classes (cls, scope, text, size) that may reach ``least``, among them all that do.

    Runs are ordered by a hashed count, rarest first (any order that is the same for all sets is right); similar sets share
    one of the first runs.  Those found there must also agree in a sketch: for jaccard the parities of 128 groups of runs,
    of which no more can differ than runs do; for containment 256 marks, of which the smaller set may miss no more than runs.
    """
    context = classes.sparkSession.sparkContext
    jaccard = metric == "jaccard"
    source = classes.select("cls", "scope", "text")

    def count(own, scopes, texts):
        at, times = np.unique(_hashes(scopes, texts, n)[1] >> _U(64 - COUNTS), return_counts=True)
        own[at] = np.minimum(own[at].astype(np.uint32) + times.astype(np.uint32), 65535)

    counts = context.broadcast(_table(source.select("scope", "text"), count, 1 << COUNTS, np.uint16, _joined_counts).tobytes())

    def ordered(scopes, texts):
        """owner, hash, place in its set, size of the set, length of the set's beginning, and whether another set can hold it."""
        owner, hashes = _hashes(scopes, texts, n)
        df = np.frombuffer(counts.value, np.uint16)[hashes >> _U(64 - COUNTS)]
        order = np.lexsort((hashes, df, owner))
        size = np.bincount(owner, minlength=len(texts))
        place = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
        start = size - np.ceil(size * least - 1e-6).astype(np.int64) + 1
        return owner, hashes[order], place, size, start, df[order] > 1

    def sketch(owner, hashes, size, words, join, where):
        bit = hashes & _U(64 * words - 1)
        first, out = (np.cumsum(size) - size)[size > 0], np.zeros((words, len(size)), np.uint64)
        for w in range(words):
            out[w][size > 0] = join.reduceat(np.where(where & (bit >> _U(6) == _U(w)), _U(1) << (bit & _U(63)), _U(0)), first)
        return out.view(np.int64)

    def emit(names, owner, hashes, size, extra, marks, taken):
        at = owner[taken]
        return hashes[taken].view(np.int64), np.array(names, np.int64)[at], size[at], extra[taken], *(m[at] for m in marks)

    words = 2 if jaccard else 4
    schema = "gram bigint, cls bigint, size int, rest int, " + ", ".join(f"m{w} bigint" for w in range(words))

    def begin(names, scopes, texts):
        owner, hashes, place, size, start, met = ordered(scopes, texts)
        if not len(owner):
            return [[]] * (4 + words)
        marks = sketch(owner, hashes, size, words, np.bitwise_xor if jaccard else np.bitwise_or, True if jaccard else place >= start[owner])
        return emit(names, owner, hashes, size, start[owner] - 1 - place, marks, met & (place < start[owner]))

    # Spread by run once for both sides of the join.
    first = _map(source, begin, schema).repartition(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "gram")
    if jaccard:
        second = first
    else:

        def flag(own, scopes, texts):
            owner, hashes, place, _, start, met = ordered(scopes, texts)
            at = hashes[met & (place < start[owner])] >> _U(64 - FLAGS)
            np.bitwise_or.at(own, at >> _U(3), np.left_shift(1, (at & _U(7)).astype(np.uint8)).astype(np.uint8))

        flags = context.broadcast(_table(source.select("scope", "text"), flag, 1 << FLAGS - 3, np.uint8, np.bitwise_or).tobytes())

        def every(names, scopes, texts):
            owner, hashes, place, size, _, met = ordered(scopes, texts)
            if not len(owner):
                return [[]] * (4 + words)
            at = hashes >> _U(64 - FLAGS)
            asked = np.frombuffer(flags.value, np.uint8)[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & 1 == 1
            return emit(names, owner, hashes, size, place, sketch(owner, hashes, size, words, np.bitwise_or, True), met & asked)

        second = _map(source, every, schema)
    x = first.toDF("gram", "x", "nx", "rest", *(f"x{w}" for w in range(words)))
    y = second.toDF("gram", "y", "ny", "place", *(f"y{w}" for w in range(words)))
    both = F.col("nx") + F.col("ny")
    bits = lambda of: sum((F.bit_count(of(F.col(f"x{w}"), F.col(f"y{w}"))) for w in range(words)), F.lit(0))
    if jaccard:
        fit = (F.col("x") < F.col("y")) & (F.least("nx", "ny") >= F.greatest("nx", "ny") * least - 1e-6) & (bits(lambda a, b: a.bitwiseXOR(b)) <= both - 2 * F.ceil(both * (least / (1 + least)) - 1e-6))
    else:
        fit = (F.col("x") != F.col("y")) & (F.col("nx") <= F.col("ny")) & (bits(lambda a, b: a.bitwiseAND(F.bitwise_not(b))) <= F.col("rest"))
    return x.join(y, "gram").where(fit).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def common_runs(pairs: DataFrame, n: int) -> DataFrame:
    """(a, b, size_a, size_b, common) of pairs (a, b, size_a, size_b, text_a, text_b, same); nothing is common where ``same`` is false."""

    def run(a, b, na, nb, ta, tb, same):
        # Told here, as a filter would become a key of the join and spread the texts twice.
        ta = [t if s else "" for t, s in zip(ta, same)]
        (oa, ga), (ob, gb) = sets(ta, n), sets(tb, n)
        owner, runs = np.concatenate([oa, ob]), np.concatenate([ga, gb])
        order = np.lexsort((runs, owner))
        owner, runs = owner[order], runs[order]
        twice = owner[1:][(owner[1:] == owner[:-1]) & (runs[1:] == runs[:-1])]
        return a, b, na, nb, np.bincount(twice, minlength=len(a))

    return _map(pairs.select("a", "b", "size_a", "size_b", "text_a", "text_b", "same"), run, "a bigint, b bigint, size_a int, size_b int, common int")
