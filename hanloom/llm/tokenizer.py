"""Problem 8: encoding of a corpus with a public byte-level BPE tokenizer.

Every pre-token is cut at the byte boundaries that no vocabulary entry covers, so that a merge
can never cross a cut; each remaining segment is merged with a segment tree whose leaves are byte
positions and whose nodes keep the leftmost smallest pair rank.  A merge updates the two live
neighbours in logarithmic time.  Segments recur, so their ids are remembered.

Defined results: a null text and an empty text both give the empty list.  Special tokens are never
produced; their strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: Where the public vocabulary files lie; a parameter of every function that needs them.
VOCABULARIES = "/opt/tokenizers"
#: Fixed value: the published pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_HAN_RUN = re.compile("[\u4e00-\u9fff]{2,}")

#: Remembered segments of one task; the memory is emptied beyond this, which changes no result.
REMEMBERED = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    """The merge ranks of a tiktoken file: token bytes → id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MinTree:
    """Segment tree over pair positions holding rank * size + position; the root is the leftmost minimum."""

    __slots__ = ("size", "nodes")
    FREE = 1 << 62

    def __init__(self, ranks: list[int]) -> None:
        size = 1
        while size < len(ranks):
            size *= 2
        self.size = size
        nodes = [self.FREE] * (2 * size)
        for position, rank in enumerate(ranks):
            if rank >= 0:
                nodes[size + position] = rank * size + position
        for i in range(size - 1, 0, -1):
            left, right = nodes[2 * i], nodes[2 * i + 1]
            nodes[i] = left if left < right else right
        self.nodes = nodes

    def first(self) -> int:
        """The position of the leftmost pair of smallest rank, or -1."""
        root = self.nodes[1]
        return -1 if root == self.FREE else root % self.size

    def set(self, position: int, rank: int) -> None:
        nodes, i = self.nodes, self.size + position
        nodes[i] = self.FREE if rank < 0 else rank * self.size + position
        i //= 2
        while i:
            left, right = nodes[2 * i], nodes[2 * i + 1]
            least = left if left < right else right
            if nodes[i] == least:
                return
            nodes[i] = least
            i //= 2


class Encoder:
    """Byte-pair encoding of one text at a time."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.words = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {}
        self.pieces = self._piece_pattern()

    def _piece_pattern(self) -> re.Pattern:
        """Finds the pieces of a run of Han characters that no vocabulary entry reaches across.

        The characters from U+4E00 to U+9FFF take three bytes and begin with 0xE4 to 0xE9.  Where
        the last byte of a character precedes such a byte within some entry, no cut is made.
        """
        held = {t[i - 1] for t in self.ranks for i in range(1, len(t)) if 0xE4 <= t[i] <= 0xE9}
        sticky = "".join(chr(c) for c in range(0x4E00, 0xA000) if (0x80 | (c & 0x3F)) in held)
        return re.compile(f"[{sticky}]*[^{sticky}]|[{sticky}]+" if sticky else ".")

    def merge(self, data: bytes) -> list[int]:
        """The ids of one segment."""
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return [whole]
        n = len(data)
        end = list(range(1, n + 1))  # the token that begins at i covers data[i:end[i]]
        before = list(range(-1, n - 1))
        tree = MinTree([ranks.get(data[i : i + 2], -1) for i in range(n - 1)])
        while (at := tree.first()) >= 0:
            right = end[at]
            end[at] = after = end[right]
            if right < n - 1:
                tree.set(right, -1)
            if after < n:
                before[after] = at
                tree.set(at, ranks.get(data[at : end[after]], -1))
            else:
                tree.set(at, -1)
            if (left := before[at]) >= 0:
                tree.set(left, ranks.get(data[left:after], -1))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[data[i : end[i]]])
            i = end[i]
        return ids

    def _learn(self, segment: str) -> bytes:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        made = array("i", self.merge(segment.encode("utf-8", "surrogatepass"))).tobytes()
        if len(segment) < 64:
            self.known[segment] = made
        return made

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as packed 32-bit integers."""
        known, learn, pieces, han = self.known, self._learn, self.pieces.findall, _HAN_RUN.fullmatch
        out = []
        for word in self.words.findall(text):
            if (made := known.get(word)) is not None:
                out.append(made)
            elif han(word):
                for part in pieces(word):
                    out.append(known.get(part) or learn(part))
            else:
                out.append(learn(word))
        return b"".join(out)


def token_ids(rows: DataFrame, key: str = "doc_id", vocabulary: str = f"{VOCABULARIES}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(key, ids): one row for each row of ``rows``, null and empty texts with an empty list."""
    kind = dict(rows.dtypes)[key]
    # The file is sent to the executors, so that it need not lie there.
    context = rows.sparkSession.sparkContext
    context.addFile(str(Path(vocabulary)))
    name = Path(vocabulary).name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load_ranks(SparkFiles.get(name)))
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                packed = [encoder.encode(t) if t else b"" for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(packed) + 1, np.int32)
                np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(packed), np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], [key, "ids"])

    return arrow_map(rows.select(key, F.col("text")), run, f"{key} {kind}, ids array<int>")
