"""Problem 2: lines repeated across the documents of one site.

A distributed PrefixSpan over line identifiers: sequences of lines that many documents of a source
hold in this order, with other lines between them, are grown from projected databases to any length.
Every occurrence of a line of a frequent sequence, single lines included, is a line to delete.

Null texts hold no line; rows without a source belong to no site; repeated rows count once.
"""

from __future__ import annotations

import unicodedata

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, keep
from .common import flat_map, signed64

_OTHER = regex.compile(r"\P{L}+")

# The definition of excessive repetition.
MIN_DOCUMENTS = 4
MIN_SHARE = 0.05
MIN_LETTERS = 2


def line_key(line: str) -> str:
    """The letters of a line, composed and in lower case."""
    return _OTHER.sub("", unicodedata.normalize("NFC", line).lower())


def line_table(rows: DataFrame, key: str, source: str) -> DataFrame:
    """(source, key, numbers, items): for each text its lines of at least two letters, as numbers and 64-bit identifiers."""
    kinds = dict(rows.dtypes)

    def lines(site, ident, text):
        if text is None or site is None:
            return
        # A line end is no letter, so the whole text can be brought into form at once.
        plain = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
        numbers, items = [], []
        for number, line in enumerate(plain.split("\n"), 1):
            letters = _OTHER.sub("", line)
            if len(letters) >= MIN_LETTERS:
                numbers.append(number)
                items.append(signed64(letters))
        if items:
            yield site, ident, numbers, items

    return flat_map(rows.select(source, key, "text"), lines, f"{source} {kinds[source]}, {key} {kinds[key]}, numbers array<bigint>, items array<bigint>").distinct()


def _frequent(counted: DataFrame, sizes: DataFrame, source: str) -> DataFrame:
    """The rows whose ``support`` is excessive among the documents of their source."""
    enough = F.col("support") >= F.col("documents") * MIN_SHARE - 1e-9
    return counted.where(F.col("support") >= MIN_DOCUMENTS).join(sizes, source).where(enough).drop("documents")


def frequent_sequences(lines: DataFrame, sizes: DataFrame, key: str, source: str) -> DataFrame:
    """(source, sequence, support): the frequent sequences of lines, any lines between them, of any length.

    PrefixSpan.  The database of a source is the sequences of frequent lines of its documents, equal ones
    counted together; a prefix is projected on what follows its first occurrence, and projections that are
    equal are again one row.  Two rules keep the number of prefixes near that of the templates of a site,
    and lose no line and no support:  what all projections of a prefix begin with is taken over at once (the
    common beginning of the least and the greatest of them), and an item that some other item always comes
    before is grown from that one.
    """
    item = lines.select(source, key, F.explode("items").alias("item"))
    single = _frequent(item.groupBy(source, "item").agg(F.count_distinct(key).alias("support")), sizes, source).select(source, "item")
    placed = lines.select(source, key, F.posexplode("items").alias("at", "item")).join(single, [source, "item"])
    ordered = placed.groupBy(source, key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]).alias("rest"))
    state = ordered.groupBy(source, "rest").agg(F.count("*").alias("n")).withColumn("prefix", F.array().cast("array<bigint>"))
    state = cut_lineage(state.select(source, "prefix", "rest", "n"))
    found = None
    while True:
        # Each item that can follow a prefix, with what stands before it in all of its projections.
        first = F.array_distinct("rest")
        step = state.select(source, "prefix", "rest", "n", F.explode(first).alias("item")).withColumn("at", F.array_position("rest", F.col("item")))
        after, before = F.slice("rest", F.col("at") + 1, F.size("rest")), F.slice("rest", F.lit(1), F.col("at").cast("int") - 1)
        step = step.select(source, "prefix", "item", "n", after.alias("rest"), before.alias("before"))
        least, most = F.min("rest"), F.max("rest")
        same = F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.size(least), F.size(most)), F.lit(1))), lambda i: F.slice(least, 1, i) != F.slice(most, 1, i))
        shared = F.when(F.least(F.size(least), F.size(most)) < 1, 0).otherwise(F.coalesce(F.get(same, F.lit(0)) - 1, F.least(F.size(least), F.size(most))))
        # The least of what stands before is a candidate for what always does; empty if something begins at once.
        grown = step.groupBy(source, "prefix", "item").agg(F.sum("n").alias("support"), F.min("before").alias("least"), shared.alias("shared"), least.alias("begin"))
        grown = _frequent(grown, sizes, source)
        always = step.join(grown.where(F.size("least") > 0).select(source, "prefix", "item", "least"), [source, "prefix", "item"])
        # An item of the least that stands before in all projections, weighed by their counts.
        common = always.select(source, "prefix", "item", F.explode(F.array_distinct(F.array_intersect("least", "before"))).alias("other"), "n").groupBy(source, "prefix", "item", "other").agg(F.sum("n").alias("m"))
        covered = common.join(grown.select(source, "prefix", "item", "support"), [source, "prefix", "item"]).where("m = support").select(source, "prefix", "item").distinct()
        grown = grown.join(covered, [source, "prefix", "item"], "left_anti")
        longer = F.concat("prefix", F.array("item"), F.slice("begin", F.lit(1), F.col("shared")))
        grown = cut_lineage(grown.select(source, "prefix", "item", "shared", "support", longer.alias("sequence")))
        if grown.isEmpty():
            break
        level = grown.select(source, "sequence", "support")
        found = level if found is None else found.unionByName(level)
        next_ = step.join(grown.select(source, "prefix", "item", "shared", "sequence"), [source, "prefix", "item"])
        next_ = next_.select(source, F.col("sequence").alias("prefix"), F.slice("rest", F.col("shared") + 1, F.size("rest")).alias("rest"), "n").where(F.size("rest") > 0)
        state = cut_lineage(next_.groupBy(source, "prefix", "rest").agg(F.sum("n").alias("n")))
    return found if found is not None else state.select(source, F.col("prefix").alias("sequence"), F.col("n").alias("support")).limit(0)


def repeated_lines(rows: DataFrame, key: str = "global_id", source: str = "domain") -> DataFrame:
    """(key, line_no) of every line that occurs in a frequent sequence of its source."""
    rows = rows.where(F.col(source).isNotNull())
    sizes = rows.groupBy(source).agg(F.count_distinct(key).alias("documents"))
    lines = keep(line_table(rows, key, source))
    mined = frequent_sequences(lines, sizes, key, source)
    items = mined.select(source, F.explode("sequence").alias("item")).distinct()
    every = lines.select(source, key, F.explode(F.arrays_zip("numbers", "items")).alias("l")).select(source, key, F.col("l.numbers").alias("line_no"), F.col("l.items").alias("item"))
    return every.join(items, [source, "item"], "left_semi").select(key, "line_no").distinct()


def without_lines(rows: DataFrame, drop: DataFrame, key: str = "global_id") -> DataFrame:
    """(key, text) with the listed lines deleted; a text of which nothing is left becomes empty."""
    gone = drop.groupBy(key).agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.transform(F.split("text", "\n"), lambda line, i: F.struct((i + 1).cast("bigint").alias("n"), line.alias("line"))), lambda x: ~F.array_contains(F.coalesce("gone", F.array().cast("array<bigint>")), x["n"]))
    texts = rows.select(key, "text").dropDuplicates([key])
    return texts.join(gone, key, "left").select(key, F.when(F.col("text").isNotNull(), F.array_join(F.transform(kept, lambda x: x["line"]), "\n")).alias("text"))
