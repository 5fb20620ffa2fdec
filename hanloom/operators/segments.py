"""Keyword-side segments: character chunks, entity spans and token annotation with offline defaults, and the encoder hook."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

SEPARATORS = ("\n\n", "\n", ".", " ", "")


def split_text(text: str, size: int = 1500, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, packed greedily at the coarsest separator that is present."""
    if len(text) <= size:
        return [text] if text else []
    mark = next(s for s in separators if s == "" or s in text)
    units = list(text) if mark == "" else [u + mark for u in text.split(mark)[:-1]] + [text.split(mark)[-1]]
    finer = separators[separators.index(mark) + 1 :] or ("",)
    out, current = [], ""
    for unit in units:
        if len(unit) > size:
            if current:
                out.append(current)
                current = ""
            out += split_text(unit, size, overlap, finer)
        elif len(current) + len(unit) > size:
            out.append(current)
            tail = current[-overlap:] if overlap else ""
            current = (tail if len(tail) + len(unit) <= size else "") + unit
        else:
            current += unit
    return [*out, current] if current else out


def chunks(text: Column, size: int = 1500, overlap: int = 50) -> Column:
    from ..session import ship

    from pyspark.sql import SparkSession

    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)

    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap) if t else [])

    return F.pandas_udf(cut, ArrayType(StringType()))(text)


def entity_spans(tokens: list[str], entities: list[tuple[str, str]]) -> list[tuple[int, int, str, str]]:
    """(start, end, surface, label) of entities in a token list, in order, the earlier and shorter first, without overlap.

    An entity matches a run of tokens exactly, or by the end of its own words where its start was cut.
    """
    low = [t.lower().replace("_", " ") for t in tokens]
    found = []
    for surface, label in entities:
        words = surface.lower().replace("_", " ").split()
        for skip in range(len(words)):
            want = words[skip:]
            if skip and len(want) < 2:
                break
            spots = [(i, i + n) for i in range(len(low)) for n in range(1, len(want) + 1) if " ".join(low[i : i + n]).split() == want]
            if spots:
                found += [(a, b, " ".join(tokens[a:b]), label) for a, b in spots]
                break
    out, edge = [], 0
    for span in sorted(found, key=lambda s: (s[0], s[1])):
        if span[0] >= edge:
            out.append(span)
            edge = span[1]
    return out


def merge_spans(tokens: list[tuple[str, str]], spans: list[tuple[int, int, str, str]]) -> list[tuple[str, str]]:
    """The tagged tokens with each span replaced by one proper name."""
    out, at = [], 0
    for start, end, surface, _ in spans:
        if start >= at:
            out += [*tokens[at:start], (surface.replace(" ", "_"), "Np")]
            at = end
    return out + tokens[at:]


def merge_pieces(pieces: list[tuple[str, str, float, int, int]]) -> list[tuple[str, str, float]]:
    """(text, label, least score) of recogniser pieces: ``##`` pieces join the piece that ends where they start."""
    out: list[list] = []
    for text, label, score, start, end in pieces:
        if out and text.startswith("##") and start == out[-1][3]:
            last = out[-1]
            last[0] += text[2:]
            last[2] = min(last[2], score)
            last[3] = end
        else:
            out.append([text, label, score, end])
    return [(t, label, s) for t, label, s, _ in out]


def hashed_encoder(size: int = 64) -> Callable[[list[str]], np.ndarray]:
    """The offline encoder: unit vectors of hashed character trigrams."""
    import xxhash

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for row, text in zip(out, texts):
            for i in range(max(1, len(text) - 2)):
                row[xxhash.xxh32_intdigest(text[i : i + 3]) % size] += 1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)

    return encode


def encoded(rows: DataFrame, text: str = "text", make: Callable[[], Callable[[list[str]], np.ndarray]] = hashed_encoder) -> DataFrame:
    """``rows`` with ``vec``; the encoder is made once in each worker and called by batch."""
    from ..session import ship

    ship(rows.sparkSession)

    def run(batches):
        encode = make()
        for texts in batches:
            yield pd.Series(list(encode([t or "" for t in texts])))

    import typing

    run.__annotations__ = {"batches": typing.Iterator[pd.Series], "return": typing.Iterator[pd.Series]}
    return rows.withColumn("vec", F.pandas_udf(run, ArrayType(DoubleType()))(F.col(text)))
