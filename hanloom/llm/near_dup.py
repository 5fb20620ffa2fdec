"""Problem 5: near-duplicate records.

Each distinct set of 5-character shingles becomes a sketch of one-bit minima.  Sketches are the
keys of binary tries; the tries form a forest in which the leading levels are minima that must
agree in full (they are the shuffle key, so a trie is one small bucket), and below them two
nodes are walked together, adding up the bits that differ and turning back as soon as the Hamming
error budget is exceeded.  What survives is checked exactly on the shingle sets.

Texts with equal shingle sets are one class before the join: the walk sees one representative of
each, so a group of copies of any size costs as much as one row; pairs within and between classes
are made from the membership at the end.  Null texts and texts with fewer letters than a
shingle form the set of their whole text, if any; empty ones take part in no pair.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, keep
from .common import arrow_map, flat_map, signed64

WIDTH = 5
#: Minima in a sketch, tries in the forest and minima that lead a trie.
MINIMA = 128
TRIES = 32
LEAD = 5
_OTHER = regex.compile(r"[^\p{L}\p{N}]+")


def letters(text: str) -> str:
    """Letters and digits only, composed and in lower case."""
    return _OTHER.sub("", unicodedata.normalize("NFC", text).lower())


def shingle_hashes(plain: str) -> np.ndarray:
    """A 64-bit value for each distinct run of five characters, sorted."""
    codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) == 0:
        return codes
    if len(codes) < WIDTH:
        return np.array([signed64(plain) & 0xFFFFFFFFFFFFFFFF], np.uint64)
    out = np.zeros(len(codes) - WIDTH + 1, np.uint64)
    for i in range(WIDTH):
        out = (out ^ codes[i : len(codes) - WIDTH + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9) ^ (out >> np.uint64(31)))


def error_budget(threshold: float) -> int:
    """Bits of a sketch that may differ: the expectation at the threshold and 3.5 deviations."""
    share = (1 - threshold) / 2
    return int(MINIMA * share + 3.5 * (MINIMA * share * (1 - share)) ** 0.5)


@lru_cache(4)
def _leads(tries: int, lead: int) -> np.ndarray:
    """Which minima lead each trie: draws without repetition from a fixed seed."""
    draw = np.random.default_rng(20)
    out = []
    while len(out) < tries:
        out += [*draw.permutation(MINIMA)[: MINIMA // lead * lead].reshape(-1, lead)]
    return np.array(out[:tries])


def minima(hashes: np.ndarray) -> np.ndarray:
    """One-permutation minima: the least value of each of MINIMA bins, empty bins filled from a neighbour."""
    bins = (hashes >> np.uint64(57)).astype(np.int64)
    out = np.full(MINIMA, 0xFFFFFFFFFFFFFFFF, np.uint64)
    starts = np.flatnonzero(np.diff(bins, prepend=-1))
    out[bins[starts]] = hashes[starts]  # sorted, so the first of a bin is its least
    empty = out == 0xFFFFFFFFFFFFFFFF
    if empty.any() and not empty.all():
        filled = np.flatnonzero(~empty)
        for at in np.flatnonzero(empty):
            for attempt in range(1, 400):
                # Each empty bin looks at its own fixed sequence of other bins.
                other = (int(at) * 7919 + attempt * 104729 + attempt * attempt * 31) % MINIMA
                if not empty[other]:
                    out[at] = (int(out[other]) * 0x9E3779B97F4A7C15 + int(at)) & 0xFFFFFFFFFFFFFFFF
                    break
            else:
                out[at] = out[filled[at % len(filled)]]
    return out


def _mix(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    return values ^ (values >> np.uint64(29))


class BitTrie:
    """A binary trie over sketches, self-joined within a Hamming budget.

    Entries may have labels; pairs of equal labels are left out, and so are whole pairs of nodes all of whose
    entries have one label.
    """

    def __init__(self, sketches: list[int], idents: list[int], labels: list[int] | None = None) -> None:
        self.bits = MINIMA
        # Without labels each entry has one of its own.
        self.root = self._build(sorted(zip(sketches, idents, labels or range(len(idents)))), 0)

    def _build(self, entries: list[tuple[int, int, int]], depth: int):
        # A path without branches is kept as a leaf of whole sketches, compared at once.
        while True:
            if len(entries) == 1 or depth == self.bits or entries[0][0] == entries[-1][0]:
                return entries
            shift = self.bits - 1 - depth
            split = bisect_left(entries, 1, key=lambda e: e[0] >> shift & 1)
            if split not in (0, len(entries)):
                break
            depth += 1
        left, right = self._build(entries[:split], depth + 1), self._build(entries[split:], depth + 1)
        one = self._label(left)
        return shift, left, right, entries[0][0], one if one is not None and one == self._label(right) else None

    @staticmethod
    def _label(node) -> int | None:
        """The label that all entries of a node have, if they have one."""
        if isinstance(node, tuple):
            return node[4]
        first = node[0][2]
        return first if all(e[2] == first for e in node) else None

    def pairs(self, budget: int) -> Iterator[tuple[int, int]]:
        """Each unordered pair of entries with different labels within ``budget`` differing bits once."""
        stack = [(self.root, self.root)]
        while stack:
            a, b = stack.pop()
            if (one := self._label(a)) is not None and one == self._label(b):
                continue
            leaf_a, leaf_b = isinstance(a, list), isinstance(b, list)
            if leaf_a and leaf_b:
                same = a is b
                for i, (x, p, own) in enumerate(a):
                    for y, q, other in a[i + 1 :] if same else b:
                        if own != other and (x ^ y).bit_count() <= budget:
                            yield (p, q) if p < q else (q, p)
                continue
            if a is b:
                stack += [(a[1], a[1]), (a[2], a[2]), (a[1], a[2])]
                continue
            # Bits above the deeper of the two branchings are common to all entries of both nodes.
            top = max(0 if leaf_a else a[0], 0 if leaf_b else b[0]) + 1
            first_a, first_b = a[0][0] if leaf_a else a[3], b[0][0] if leaf_b else b[3]
            if (first_a >> top ^ first_b >> top).bit_count() > budget:
                continue
            if leaf_b or not leaf_a and a[0] >= b[0]:
                stack += [(a[1], b), (a[2], b)]
            else:
                stack += [(a, b[1]), (a, b[2])]


def classes(rows: DataFrame, key: str) -> DataFrame:
    """(key, class): texts with equal shingle sets share a class, which is a hash of the set."""
    kind = dict(rows.dtypes)[key]

    def sign(ident, text):
        if not text or not (plain := letters(text)):
            return []
        return [(ident, signed64(shingle_hashes(plain).tobytes()), plain)]

    return flat_map(rows.select(key, "text"), sign, f"{key} {kind}, class bigint, plain string")


def sketches(representatives: DataFrame) -> DataFrame:
    """(trie, class, sketch): each class in the tries of the forest."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leads = _leads(TRIES, LEAD)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                made = [minima(shingle_hashes(t)) for t in part.column(1).to_pylist()]
                if not made:
                    continue
                table = np.stack(made)
                bits = np.packbits((_mix(table) & np.uint64(1)).astype(np.uint8), axis=1)
                keys = np.zeros((len(made), TRIES), np.uint64)
                for i in range(LEAD):
                    keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + table[:, leads[:, i]])
                keys = _mix(keys + np.arange(TRIES, dtype=np.uint64)).view(np.int64)
                wide = np.repeat(np.arange(len(made)), TRIES)
                raw = [b.tobytes() for b in bits]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel(), pa.int64()), part.column(0).take(pa.array(wide)), pa.array([raw[i] for i in wide], pa.binary())], ["trie", "class", "sketch"]
                )

    return arrow_map(representatives.select("class", "plain"), sketch, "trie bigint, class bigint, sketch binary")

def walked(placed: DataFrame, each) -> DataFrame:
    """(class_a, class_b) that ``each(sketches, classes, labels)`` gives for the entries of every trie.

    ``placed`` are rows (trie, class, sketch, label), the label null where there is none.  Sorting by trie lets a
    task walk one trie at a time, without gathering the partition.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        current, idents, marks, labels = None, [], [], []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["class_a", "class_b"])

        def join() -> Iterator[pa.RecordBatch]:
            if len(idents) > 1:
                for pair in each([int.from_bytes(m, "big") for m in marks], idents, labels):
                    found.append(pair)
                    if len(found) >= 50_000:
                        yield flush()
                        found.clear()

        for batch in batches:
            tries = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(tries, prepend=tries[0] - 1 if len(tries) else 0)).tolist() + [len(tries)]
            for lo, hi in zip(edges, edges[1:]):
                if tries[lo] != current:
                    yield from join()
                    current, idents, marks, labels = tries[lo], [], [], []
                if hi - lo > 1 or hi == len(tries) or lo == 0:
                    idents += batch.column(1).slice(lo, hi - lo).to_pylist()
                    marks += batch.column(2).slice(lo, hi - lo).to_pylist()
                    labels += batch.column(3).slice(lo, hi - lo).to_pylist()
        yield from join()
        yield flush()

    spread = placed.select("trie", "class", "sketch", "label").repartition("trie").sortWithinPartitions("trie")
    return arrow_map(spread, walk, "class_a bigint, class_b bigint").distinct()


def verified(candidates: DataFrame, representatives: DataFrame, threshold: float) -> DataFrame:
    """The pairs (class_a, class_b) whose shingle sets reach ``threshold``."""
    plain = representatives.select("class", "plain")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, np.ndarray] = {}
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                for t in (a, b):
                    if t not in known:
                        if len(known) > 2000:
                            known.clear()
                        known[t] = shingle_hashes(t)
                x, y = known.get(a), known.get(b)
                x = shingle_hashes(a) if x is None else x
                y = shingle_hashes(b) if y is None else y
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= threshold * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], ["class_a", "class_b"])

    both = candidates.join(plain.toDF("class_a", "plain_a"), "class_a").join(plain.toDF("class_b", "plain_b"), "class_b")
    return arrow_map(both.select("class_a", "class_b", "plain_a", "plain_b"), verify, "class_a bigint, class_b bigint")


def similar_classes(representatives: DataFrame, threshold: float) -> DataFrame:
    """(class_a, class_b) of classes whose shingle sets have a Jaccard similarity of at least ``threshold``."""
    budget = error_budget(threshold)
    alone = sketches(representatives).withColumn("label", F.lit(None).cast("bigint"))
    return verified(walked(alone, lambda marks, idents, _: BitTrie(marks, idents).pairs(budget)), representatives, threshold)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(class, label): the least class of the connected part of each node (class) of the graph with ``edges`` (class_a, class_b).

    Labels run along the edges with pointer jumping, so the number of rounds is logarithmic in a part's diameter;
    the lineage is cut each round in the shared checkpoint folder.
    """
    edges = cut_lineage(edges.unionByName(edges.toDF("class_b", "class_a").select("class_a", "class_b")).distinct())
    # Nodes without an edge are their own label, and take no part in the rounds.
    current = cut_lineage(edges.select(F.col("class_a").alias("class")).distinct().withColumn("label", F.col("class")))
    while True:
        near = edges.join(current.toDF("class_b", "offer"), "class_b").groupBy(F.col("class_a").alias("class")).agg(F.min("offer").alias("offer"))
        stepped = current.join(near, "class").select("class", F.least("label", "offer").alias("next"), "label")
        jumps = stepped.select(F.col("class").alias("next"), F.col("next").alias("jump"))
        jumped = cut_lineage(stepped.join(jumps, "next", "left").select("class", F.least("next", F.coalesce("jump", "next")).alias("label"), F.col("label").alias("before")))
        current = jumped.select("class", "label")
        if jumped.where("label <> before").isEmpty():
            break
    return nodes.join(current, "class", "left").select("class", F.coalesce("label", "class").alias("label"))


def similar_pairs(rows: DataFrame, key: str, threshold: float) -> DataFrame:
    """Pairs of keys, smaller first, whose texts reach ``threshold``, from class pairs and membership."""
    signed = keep(classes(rows, key))
    members = keep(signed.select(key, "class").distinct())
    representatives = signed.groupBy("class").agg(F.min("plain").alias("plain"))
    linked = similar_classes(keep(representatives), threshold)
    a, b = members.toDF("a", "class_a"), members.toDF("b", "class_b")
    across = linked.join(a, "class_a").join(b, "class_b").select("a", "b")
    within = members.toDF("a", "class").join(members.toDF("b", "class"), "class").where("a < b").select("a", "b")
    return across.unionByName(within).select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b")).distinct()


def groups(rows: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, group_id, copies): one row for each text, its connected group by the smallest key, and how many texts are equal to it.

    No link between different texts is lost, and those of a group are not made: first every class is compared with
    one other of each of its tries, which joins most of a group of near copies; then the tries are walked for pairs
    of classes that are not in one group yet, and nodes of the tries that lie in one group are passed over whole.
    """
    signed = keep(classes(rows, key))
    members = signed.select(key, "class").distinct()
    representatives = keep(signed.groupBy("class").agg(F.min("plain").alias("plain")))
    budget = error_budget(threshold)
    # A class that is alone in a trie has no partner there; most are.
    crowd = F.count("*").over(Window.partitionBy("trie"))
    placed = keep(sketches(representatives).withColumn("n", crowd).where("n > 1").drop("n"))

    def stars(marks, idents, _):
        return [(min(idents[0], other), max(idents[0], other)) for mark, other in zip(marks[1:], idents[1:]) if (marks[0] ^ mark).bit_count() <= budget]

    nodes = representatives.select("class")
    first = cut_lineage(components(nodes, verified(walked(placed.withColumn("label", F.lit(None).cast("bigint")), stars), representatives, threshold)))
    labelled = placed.join(first, "class")
    rest = verified(walked(labelled, lambda marks, idents, labels: BitTrie(marks, idents, labels).pairs(budget)), representatives, threshold)
    # The links that are left run between the groups of the first round.
    between = rest.join(first.toDF("class_a", "a"), "class_a").join(first.toDF("class_b", "b"), "class_b").select(F.col("a").alias("class_a"), F.col("b").alias("class_b"))
    last = components(first.select(F.col("label").alias("class")).distinct(), between).toDF("label", "whole")
    own = members.join(first, "class").join(last, "label")
    named = own.groupBy("whole").agg(F.min(key).alias("group_id"))
    copies = members.groupBy("class").agg(F.count("*").alias("copies"))
    return own.join(named, "whole").join(copies, "class").select(key, "group_id", "copies")
