"""Problem 9: passages of evaluation items inside a training corpus.

A prefix-filtered set join in Spark.  An item is cut into all its windows of the required length; a
window is the set of its shingles, and a document contains the window only if it holds every shingle,
so by the prefix principle for containment 1.0 it suffices to join on the window's rarest shingle.
The order of rarity comes from the whole corpus.  A joined pair is verified exactly on both texts.

Documents give the hashes of those shingles that pass a Bloom filter of all item shingles; the filter
is made on the executors, has a size with a fixed bound and is all that is sent to them.  Its false
positives, and hash collisions, are removed by the join and by the verification; they cost time only.

Null and blank documents and items take part in no pair; items shorter than the window leak never.
Where an item id has several texts, each of them counts.  Repeated rows give one row.
"""

from __future__ import annotations

import unicodedata
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..session import keep
from .common import arrow_map, flat_map

# The run that counts as a leak, by language of the item, and the shingles joined on (powers of two).
RUN = {"zh": 20}
RUN_OTHER = 80
SHINGLE = {20: 8, 80: 32}
#: Bits of the filter for each item shingle, and the least and greatest size; a filter that is full stays correct.
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 20, 1 << 28
PROBES = 3

_OTHER = regex.compile(r"[^\p{L}\p{N}]+")


def letters(text: str) -> str:
    """Letters and digits only, composed and in lower case."""
    return _OTHER.sub("", text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower())


def _mix(values: np.ndarray) -> np.ndarray:
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


def shingle_hashes(plain: str) -> dict[int, np.ndarray]:
    """For each shingle width the hash of every run of that many characters, by doubling."""
    values = _mix(np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    out, width = {}, 1
    while width < max(SHINGLE.values()):
        values = _mix(values[: max(0, len(values) - width)] ^ (values[width:] * np.uint64(0x94D049BB133111EB) + np.uint64(width)))
        width *= 2
        if width in SHINGLE.values():
            out[width] = values
    return out


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(hashes >> np.uint64(k * 18)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k) >> np.uint64(64 - bits) for k in range(PROBES)]


def _item_table(items: DataFrame) -> DataFrame:
    """(item_id, run, plain) of every different item text that is long enough."""
    kind = dict(items.dtypes)["item_id"]

    def bring(item, lang, text):
        run = RUN.get(lang, RUN_OTHER)
        if len(plain := letters(text)) >= run:
            yield item, run, plain

    return flat_map(items.where(F.col("text").isNotNull()).select("item_id", "lang", "text"), bring, f"item_id {kind}, run int, plain string").distinct()


def shingle_filter(items: DataFrame) -> tuple[int, bytes]:
    """(log2 of its bits, the filter) over the shingles of ``items`` (item_id, run, plain)."""
    letters_ = items.agg(F.sum(F.length("plain"))).first()[0] or 0
    size = min(max(BITS_EACH * letters_, LEAST_BITS), MOST_BITS)
    bits = (size - 1).bit_length()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, bool)
        for batch in batches:
            for run, plain in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for places in _places(shingle_hashes(plain)[SHINGLE[run]], bits):
                    table[places] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(table).tobytes()], pa.binary())], ["bits"])

    whole = np.zeros((1 << bits) // 8, np.uint8)
    # Parts of fixed size come one by one.
    for part in arrow_map(items.select("run", "plain").coalesce(8), fill, "bits binary").toLocalIterator():
        whole |= np.frombuffer(part.bits, np.uint8)
    return bits, whole.tobytes()


def touched_documents(documents: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """(key, plain, grams): the documents with shingles that pass the filter, with the hashes of those."""
    bits, packed = shingle_filter(items)
    shared = documents.sparkSession.sparkContext.broadcast(packed)
    kind = dict(documents.dtypes)[key]
    schema = _parse_datatype_string(f"{key} {kind}, plain string, grams array<bigint>")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        table = np.frombuffer(shared.value, np.uint8)

        def held(hashes: np.ndarray) -> np.ndarray:
            """The places whose hashes pass the filter."""
            at = np.arange(len(hashes))
            for places in ((lambda h, k=k: _places(h, bits)[k]) for k in range(PROBES)):
                where = places(hashes[at])
                at = at[(table[where >> np.uint64(3)] >> (np.uint64(7) - (where & np.uint64(7))).astype(np.uint8)) & 1 == 1]
            return at

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                plains = [letters(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([len(t) for t in plains])
                hits: list[set[int]] = [set() for _ in plains]
                # The texts are hashed as one; runs that reach into the next text are left out.
                for width, hashes in shingle_hashes("".join(plains)).items():
                    at = held(hashes)
                    owner = np.searchsorted(ends, at, side="right")
                    inside = at + width <= ends[owner] if len(at) else np.zeros(0, bool)
                    for k, h in zip(owner[inside].tolist(), hashes[at[inside]].view(np.int64).tolist()):
                        hits[k].add(h)
                some = [k for k, h in enumerate(hits) if h]
                if some:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), pa.array([plains[k] for k in some], pa.string()), pa.array([list(hits[k]) for k in some], pa.list_(pa.int64()))], schema=arrow)

    return arrow_map(documents.select(key, "text"), probe, schema)


def _rarest(plain: str, run: int, counts: dict[int, int]) -> set[int]:
    """The places of the rarest shingle of every window; ties go to the rightmost, so that windows share them."""
    hashes = shingle_hashes(plain)[SHINGLE[run]].view(np.int64).tolist()
    order = [(counts.get(h, 0), -i) for i, h in enumerate(hashes)]
    out: set[int] = set()
    width = run - SHINGLE[run] + 1
    least: deque[int] = deque()
    for i, o in enumerate(order):
        while least and order[least[-1]] >= o:
            least.pop()
        least.append(i)
        if least[0] <= i - width:
            least.popleft()
        if i >= width - 1:
            out.add(least[0])
    # A shingle that no document holds rules its windows out.
    return {i for i in out if order[i][0]}


def common_run(plain: str, other: str, places: list[int], width: int, run: int) -> bool:
    """Whether the texts have a run of ``run`` characters in common through one of the shingles of ``other`` at ``places``."""
    for at in places:
        gram = other[at : at + width]
        i = plain.find(gram)
        while i >= 0:
            left = 0
            while left < min(i, at) and plain[i - left - 1] == other[at - left - 1]:
                left += 1
            right = width
            most = min(len(plain) - i, len(other) - at)
            while left + right < run and right < most and plain[i + right] == other[at + right]:
                right += 1
            if left + right >= run:
                return True
            i = plain.find(gram, i + 1)
    return False


def leaked_items(documents: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, item_id) of every document and item with a common run of the required length."""
    kinds = dict(documents.dtypes)[key], dict(items.dtypes)["item_id"]
    table = keep(_item_table(items).withColumn("item", F.xxhash64("run", "plain")))
    texts = table.select("item", "run", "plain").dropDuplicates(["item"])
    touched = keep(touched_documents(documents.where(F.col("text").isNotNull()), table.select("item_id", "run", "plain"), key))

    def cut(item, run, plain):
        return [(item, h) for h in set(shingle_hashes(plain)[SHINGLE[run]].view(np.int64).tolist())]

    held = touched.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    rarity = flat_map(texts, cut, "item bigint, gram bigint").join(held, "gram").groupBy("item").agg(F.collect_list(F.struct("gram", "n")).alias("counts"))

    def choose(item, run, plain, counts):
        places = _rarest(plain, run, {c["gram"]: c["n"] for c in counts or []})
        hashes = shingle_hashes(plain)[SHINGLE[run]].view(np.int64)
        return [(item, int(hashes[i]), i) for i in places]

    prefixes = flat_map(texts.join(rarity, "item").select("item", "run", "plain", "counts"), choose, "item bigint, gram bigint, at int")
    met = touched.select(key, F.explode("grams").alias("gram")).join(prefixes, "gram").groupBy(key, "item").agg(F.collect_set("at").alias("places"))
    both = met.join(texts.withColumnRenamed("plain", "other"), "item").join(touched.select(key, "plain").distinct(), key)

    def verify(ident, item, plain, other, run, places):
        return [(ident, item)] if common_run(plain, other, sorted(places), SHINGLE[run], run) else []

    leaks = flat_map(both.select(key, "item", "plain", "other", "run", "places"), verify, f"{key} {kinds[0]}, item bigint")
    return leaks.join(table.select("item", "item_id"), "item").select(key, "item_id").distinct()
