"""Problem 3: the main body of a page without what its site puts around it.

Host suffix array.  The pages of a host are concatenated as streams of tokens: its lines, and the
segments of lines that are menus (letters in lower case, numbers masked).  The array is sharded by
the token a suffix begins with; a shard is counted by partial aggregation, so no host and no repeated
line is ever gathered in one task.  Two depths of it decide.  At depth one, the suffixes that begin
with a token give the distinct pages that repeat it; a token inside any longer repeated substring
heads such a bucket itself, so these buckets cover all repeated substrings.  At depth two, the tokens
that follow a repeated one tell what it heads: one that goes on in fragments not repeated themselves is
the heading of a list of links, and the unique fragments below it belong to the list.

Covered lines are boilerplate, on the host or, for hosts with few pages, because several other hosts
repeat them (the site's own name masked).  Unique runs are kept, lists below a list heading excepted.
A line that begins like the page's title is the work's own heading and ends a list; ornament lines
stay with the work.

Null texts give no line, blank lines are never reported, repeated rows of a page count once, and
pages without a host or title are judged by what is known of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep
from .common import arrow_map, flat_map, signed64

#: Support of a repeated token: distinct pages of its host, as a number and as a share.
HOST_PAGES, HOST_SHARE = 3, 0.02
#: Hosts on which a token has this support, for it to count on every host.
HOSTS = 2
#: A repeated token heads a list if, of its occurrences, this share goes on in a fragment that is not repeated on the host.
LIST_SHARE = 0.7

_DIGITS = regex.compile(r"\d+")
_KEEP = regex.compile(r"[^\p{L}#]+")
_PARTS = regex.compile(r"\s*[|｜»›>/·•‧→]\s*|\s{2,}|　")
_TITLE_SPLIT = regex.compile(r"\s+[–\-|｜—:]\s+|\s*[：_｜|]\s*")
#: How a sentence ends; what ends otherwise, cut-off sentences included, is a fragment.
_SENTENCE = regex.compile(r"(?:(?<![.。])[.。]|[！？!?｡．」』”»\"’；;])\Z")

SENTENCE, FRAGMENT, WORK, ORNAMENT = 0, 1, 2, 3


def site_of(title: str | None) -> str:
    """The site's name at the end of a page title, if it has one."""
    parts = _TITLE_SPLIT.split(title.strip(" .…")) if title else []
    return parts[-1].strip() if len(parts) > 1 and len(parts[-1].strip()) >= 3 else ""


def work_of(title: str | None) -> str:
    """The work's name at the beginning of a page title; '' for an address."""
    head = _TITLE_SPLIT.split(title.strip(" .…"))[0].strip(" .…").lower() if title else ""
    return "" if "." in head and " " not in head else head


def is_own(line: str, work: str) -> bool:
    """Whether line and name begin alike: three characters, and more than half of each."""
    common = 0
    for a, b in zip(line, work):
        if a != b:
            break
        common += 1
    return common >= 3 and common * 2 > max(len(line), len(work))


def mask(line: str) -> str:
    return _KEEP.sub("", _DIGITS.sub("#", line.lower()))


def _line_rows(host, address, doc, page, html_title, title, text):
    """One row for each line and for each segment of a fragment with several."""
    if text is None:
        return
    site = site_of(html_title).lower()
    work = work_of(html_title) or work_of(title)
    place, where = signed64(host or ""), signed64(address or f"{doc} {page}")
    seen = set()
    lines = []
    for number, line in enumerate(text.split("\n"), 1):
        if not (plain := line.strip()):
            continue
        token = mask(plain)
        if not token.replace("#", ""):
            lines.append((number, plain, token, ORNAMENT if not token else FRAGMENT))
        elif _SENTENCE.search(plain):
            lines.append((number, plain, token, SENTENCE))
        else:
            lines.append((number, plain, token, WORK if work and is_own(plain.lower(), work) else FRAGMENT))
    follows = None
    rows = []
    for number, plain, token, form in reversed(lines):
        if not token.replace("#", ""):
            rows.append((number, plain, token, form, None))
            continue
        key = signed64(token)
        rows.append((number, plain, key, form, follows))
        follows = key if form == FRAGMENT else None
    for number, plain, key, form, follows in reversed(rows):
        if isinstance(key, str):
            yield place, where, doc, page, number, 0, 1, None, None, form, None, bool(work), False
            continue
        low = plain.lower()
        wide = signed64(mask(low.replace(site, "§site§"))) if site and site in low else key
        first = key not in seen
        seen.add(key)
        parts = [m for p in _PARTS.split(low) if p and (m := mask(p))] if form == FRAGMENT or form == WORK else []
        many = len(parts) if len(parts) > 1 else 0
        yield place, where, doc, page, number, 0, 1 + many, key, wide, form, follows, bool(work), first
        if many:
            for at, part in enumerate(parts, 1):
                key = signed64(part)
                first = key not in seen
                seen.add(key)
                yield place, where, doc, page, number, at, 1 + many, key, key, form, None, bool(work), first


_LINES = "host bigint, page bigint, doc_id string, page_id string, line_no bigint, part int, parts int, token bigint, wide bigint, form int, follows bigint, titled boolean, first boolean"


def repeated_tokens(lines: DataFrame) -> DataFrame:
    """(host, token, head) of the lines and segments covered by a repeated substring, and whether they head lists."""
    counted = keep(lines.where("token is not null and first").groupBy("host", "token", "wide").agg(F.count_distinct("page").alias("n")))
    hosts = lines.where("part = 0").groupBy("host").agg(F.count_distinct("page").alias("pages"))
    on_host = counted.where(F.col("n") >= HOST_PAGES).join(hosts, "host").where(F.col("n") >= F.col("pages") * HOST_SHARE).select("host", "token", "wide")
    widely = on_host.groupBy("wide").agg(F.count_distinct("host").alias("hosts")).where(F.col("hosts") >= HOSTS).select("wide")
    everywhere = counted.join(widely, "wide").select("host", "token", "wide")
    hits = keep(on_host.unionByName(everywhere).distinct())
    # Depth two: how often the suffixes that begin with a token go on in a fragment that is not itself repeated on its host.
    # Shares do not depend on the number of pages; that of different fragments falls as the stock of fragments is used up.
    pairs = lines.where("part = 0 and token is not null and first").where(F.col("form") == FRAGMENT).groupBy("host", "wide", "follows").agg(F.count("*").alias("n"))
    repeated = hits.select("host", F.col("token").alias("follows"), F.lit(True).alias("repeated")).distinct()
    after = pairs.join(hits.select("host", "wide").distinct(), ["host", "wide"], "left_semi").join(repeated, ["host", "follows"], "left")
    fresh = F.sum(F.when(F.col("follows").isNotNull() & F.col("repeated").isNull(), F.col("n")).otherwise(0))
    heads = after.groupBy("wide").agg(F.sum("n").alias("n"), fresh.alias("fresh")).where((F.col("n") >= HOST_PAGES) & (F.col("fresh") >= F.col("n") * LIST_SHARE)).select("wide", F.lit(True).alias("head"))
    return hits.join(heads, "wide", "left").groupBy("host", "token").agg(F.coalesce(F.max("head"), F.lit(False)).alias("head"))


def _judge(rows: list[tuple]) -> list[int]:
    """The boilerplate lines of one page; rows are (line_no, part, form, titled, hit, head)."""
    by_line: dict[int, dict[int, tuple]] = {}
    for number, part, form, titled, hit, head in rows:
        by_line.setdefault(number, {})[part] = (form, titled, hit, head)
    out, listing = [], False
    ordered = [n for n in sorted(by_line) if by_line[n][0][0] != ORNAMENT]
    for at, number in enumerate(ordered):
        line = by_line[number]
        form, titled, hit, head = line[0]
        hits = [line[p][2] for p in sorted(line) if p]
        menu = len(hits) > 1 and (all(hits) or len(hits) >= 3 and (hits[0] or sum(hits) * 2 > len(hits)))
        if menu or hit and form != WORK:
            out.append(number)
            listing = listing or head
        elif form == FRAGMENT and listing:
            # Where the title is not known, the fragment right before sentences is taken for the work's heading.
            follows = by_line[ordered[at + 1]][0] if at + 1 < len(ordered) else None
            if not titled and follows and follows[0] == SENTENCE and not follows[2]:
                listing = False
            else:
                out.append(number)
        else:
            listing = False
    return out


def boilerplate_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_id, line_no) of the lines that are not the work's own text."""
    address = F.coalesce(*[F.col(c) for c in ("canonical_url", "url") if c in pages.columns], F.lit(None).cast("string"))
    source = pages.where(F.col("text").isNotNull()).select("domain", address.alias("address"), "doc_id", "page_id", "html_title", "title", "text")
    lines = keep(flat_map(source, _line_rows, _LINES))
    judged = lines.select("host", "token", "doc_id", "page_id", "line_no", "part", "form", "titled").join(repeated_tokens(lines), ["host", "token"], "left")
    cells = F.struct("line_no", "part", "form", "titled", F.col("head").isNotNull().alias("hit"), F.coalesce("head", F.lit(False)).alias("head"))
    packed = judged.groupBy("doc_id", "page_id").agg(F.collect_set(cells).alias("rows"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, pages_, numbers = [], [], []
            cells = batch.column(2)
            flat = cells.flatten()
            columns = [flat.field(i).to_pylist() for i in range(6)]
            offsets = cells.offsets.to_pylist()
            base = offsets[0] if offsets else 0
            for i, (doc, page) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                lo, hi = offsets[i] - base, offsets[i + 1] - base
                found = _judge(list(zip(*(c[lo:hi] for c in columns))))
                docs += [doc] * len(found)
                pages_ += [page] * len(found)
                numbers += found
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(pages_, pa.string()), pa.array(numbers, pa.int64())], ["doc_id", "page_id", "line_no"])

    return arrow_map(packed, judge, "doc_id string, page_id string, line_no bigint")


def main_body(pages: DataFrame) -> DataFrame:
    """(doc_id, page_id, text) with only the work's own lines; a null text stays null."""
    gone = boilerplate_lines(pages).groupBy("doc_id", "page_id").agg(F.collect_set("line_no").alias("gone"))

    def keep(doc, page, text, lines):
        drop = set(lines or ())
        return [(doc, page, None if text is None else "\n".join(x for n, x in enumerate(text.split("\n"), 1) if n not in drop))]

    texts = pages.select("doc_id", "page_id", "text").distinct().join(gone, ["doc_id", "page_id"], "left")
    return flat_map(texts, keep, "doc_id string, page_id string, text string")
