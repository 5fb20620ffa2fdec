"""Text expressions: script counts, cleaners, sentence units and windows, all as columns."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character classes and marker sets, and the lines that cleaning drops.
HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}"
LATIN = r"A-Za-z\x{C0}-\x{24F}\x{1E00}-\x{1EFF}"
SPACE = r"\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
TRADITIONAL = "欽鑑綱紀記書國為爲舊開寶閭條維輯體廣萬與義實錄學東龍門師後臺"
SIMPLIFIED = "钦鉴纲纪记书国为旧开宝闾条维辑体广万与义实录学东龙门师后台"
BOILERPLATE = (
    "|返回.*|上一页|下一页|上一頁|下一頁|目录|目錄|编辑|編輯|本页面最后修订于.*|本頁面最後修訂於.*|此页面最后编辑于.*|此頁面最後編輯於.*"
    "|维基文库.*|維基文庫.*|Wikisource.*|Chinese Text Project.*|中國哲學書電子化計劃.*|Copyright.*|版权所有.*|版權所有.*|登录|登入|注册|搜尋|搜索"
)
DROPPED_QUOTES = "「」『』〈〉《》“”‘’\"'"
ZERO_WIDTH = "​‌‍﻿"


def _normalised(form: str, text: Column) -> Column:
    """There is no built-in for Unicode forms; the function travels by value, so executors need no package."""

    def change(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return F.pandas_udf(change, StringType())(text)


def nfc(text: Column) -> Column:
    """Composed form."""
    return _normalised("NFC", text)


def nfkc(text: Column) -> Column:
    """Compatibility form."""
    return _normalised("NFKC", text)


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def count_of(text: Column, chars: str) -> Column:
    """How many code points of ``text`` the class ``chars`` holds; null counts as none."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{chars}]", ""))


def ratio(part: Column, other: Column) -> Column:
    """part / (part + other), 0 where both are none."""
    return F.when(part + other > 0, part / (part + other)).otherwise(F.lit(0.0))


def traditional_score(text: Column) -> Column:
    """Share of traditional among marker characters, 0.5 where there is none."""
    old, new = count_of(text, TRADITIONAL), count_of(text, SIMPLIFIED)
    return F.when(old + new > 0, old / (old + new)).otherwise(F.lit(0.5))


def clean_tables(text: Column) -> Column:
    """Cells of table-like lines."""
    text = F.regexp_replace(text, r"(?m)^\|\s*\d+\s*\|", "")
    text = F.regexp_replace(text, r"(?m)\|\s*$", "")
    return F.regexp_replace(text, r"(?m)^[ \t]+|[ \t]+$", "")


def clean_navigation(text: Column) -> Column:
    """Lines with arrows to other pages."""
    return F.regexp_replace(text, r"(?m)^[^\n]*[◄►][^\n]*$", "")


def clean_edit_marks(text: Column) -> Column:
    """Edit markers and pointers to encyclopedia articles."""
    text = F.regexp_replace(text, r"(?i)\[(编辑|編輯|edit)\]", "")
    return F.regexp_replace(text, rf"(?mi)^[{SPACE}]*\|?[{SPACE}]*(维基百科条目|維基百科條目|Wikipedia article)[{SPACE}]*[:：][^\n]*$", "")


def drop_boilerplate(text: Column) -> Column:
    """Blank lines and the fixed list of site lines."""
    kept = F.filter(F.split(text, "\n"), lambda line: ~line.rlike(rf"(?i)^[{SPACE}]*(?:{BOILERPLATE})[{SPACE}]*$"))
    return strip(F.array_join(kept, "\n"))


def clean_annotations(text: Column, mode: str = "light") -> Column:
    """Bracketed notes: none, light (numbers and editors' brackets) or aggressive (all brackets)."""
    if mode == "none":
        return text
    text = F.regexp_replace(F.regexp_replace(text, r"\[\d+\]|\(\d+\)", ""), r"〔[^\n]*?〕|【[^\n]*?】", "")
    return F.regexp_replace(text, r"\[[^\n]*?\]|\([^\n]*?\)|\{[^\n]*?\}|〈[^\n]*?〉|《[^\n]*?》|（[^\n]*?）", "") if mode == "aggressive" else text


def clean_spaces(text: Column) -> Column:
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"[ \t]*\n[ \t]*", "\n")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def clean_for_export(text: Column, mode: str = "light") -> Column:
    """The cleaners in their fixed order; null becomes empty."""
    text = F.translate(nfc(F.coalesce(text, F.lit(""))), ZERO_WIDTH, "")
    text = drop_boilerplate(clean_edit_marks(clean_navigation(clean_tables(text))))
    return clean_spaces(F.translate(clean_annotations(text, mode), "〇「」『』", ""))


# What keyword text loses or gains, in this order, as (pattern, replacement).
KEYWORD_TEXT = [
    (r"\[[^\]]*?\]", " "),
    (r"\([^)]*?\)", " "),
    (r"\r\n?", "\n"),
    (r" *\n *", "\n"),
    (r"(?<![.!?;:])\n+", ". "),
    (r"\n+", " "),
    (r"[ \t]+", " "),
    (r"\s+([,;:.!?])", "$1"),
    (r"([!?])\.", "$1"),
    (r"\.{2,}", "."),
    (r"([,;:.!?])([^\s\"”’')\]])", "$1 $2"),
    (r"^[\s.,;:!?-]+", ""),
    (r"[\s.,;:!?-]+$", ""),
]


def clean_for_keywords(text: Column) -> Column:
    """Notes, line ends and punctuation brought into the form keyword extraction wants."""
    return strip(reduce(lambda t, step: F.regexp_replace(t, *step), KEYWORD_TEXT, text))


def signature(text: Column, chars: str = HAN) -> Column:
    """What duplicates are compared by: bracketed notes off, one script kept."""
    bare = F.regexp_replace(text, r"\[[^\n]*?\]|\([^\n]*?\)|\{[^\n]*?\}|〈[^\n]*?〉|《[^\n]*?》|〔[^\n]*?〕|【[^\n]*?】|（[^\n]*?）", "")
    kept = F.regexp_replace(bare, f"[^{chars}]", "")
    return kept if chars == HAN else F.lower(kept)


def is_junk(sentence: Column) -> Column:
    """Blank or without a letter or digit."""
    return ~sentence.rlike(r"[\p{L}\p{N}]")


def sentences(text: Column, han: Column, longest: int | None = 10_000) -> Column:
    """Sentence units, each cut off at ``longest`` characters; ``han`` says which rule a row takes."""

    def split(plain: Column) -> Column:
        # One replacement puts a sign behind each unit, so that the text is searched and split once.
        by_han = rf"([。！？…])[）\]\}}]*[{SPACE}]*|\n+"
        by_latin = rf"([.!?…。！？])[{SPACE}]*|\n+"
        return F.when(han, F.regexp_replace(plain, by_han, "$1\x01")).otherwise(F.regexp_replace(plain, by_latin, "$1\x01"))

    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "^﻿+|\x01", ""), r"\r\n?", "\n"), f"[{DROPPED_QUOTES}]", "")
    plain = strip(F.regexp_replace(plain, r"[ \t]+", " "))
    units = F.element_at(F.transform(F.array(plain), lambda t: F.split(split(t), "\x01", -1)), 1)
    kept = F.filter(units, lambda s: ~is_junk(s))
    return kept if longest is None else F.transform(kept, lambda s: F.substring(s, 1, longest))


def windows(items: Column, size: int, overlap: int, glue: str = " ") -> Column:
    """Overlapping groups of ``size`` items as texts; the last one is the first to reach the end."""
    step = max(1, size - overlap)
    n = F.size(items)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda i: (i == 0) | (i - step + size < n))
    return F.when(n > 0, F.transform(starts, lambda i: F.array_join(F.slice(items, i + 1, F.lit(size)), glue))).otherwise(F.array().cast("array<string>"))


def ngrams(text: Column, n: int) -> Column:
    """The set of runs of ``n`` code points; a shorter text is its own only run, an empty one has none."""

    def of(t: Column) -> Column:
        # Split into characters once; a run joins neighbours, so the work is linear in the length.
        chars = F.filter(F.split(t, ""), lambda c: c != "")
        runs = F.element_at(F.transform(F.array(chars), lambda cs: F.transform(F.sequence(F.lit(0), F.greatest(F.size(cs) - n, F.lit(0))), lambda i: F.concat(*[F.get(cs, i + k) for k in range(n)]))), 1)
        return F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) < n, F.array(t)).otherwise(F.array_distinct(runs))

    # Bound to a variable, so that the expression behind ``text`` is evaluated once and not for each run.
    return F.element_at(F.transform(F.array(text), of), 1)


def gram_hashes(text: Column, n: int) -> Column:
    """The set of runs as sorted 64-bit hashes, which is what is compared and shuffled."""
    return F.array_sort(F.transform(ngrams(text, n), lambda g: F.xxhash64(g)))


def safe_filename(name: Column, longest: int = 120) -> Column:
    """A name that file systems accept."""
    name = F.regexp_replace(nfkc(F.coalesce(name, F.lit("unknown"))), r"[\x00-\x1f\x7f]", "")
    name = F.regexp_replace(F.regexp_replace(name, r'[\\/:*?"<>|]+', "_"), r"\s+", " ")
    name = F.regexp_replace(name, r"^[. ]+|[. ]+$", "")
    return F.regexp_replace(F.substring(F.when(name == "", "unknown").otherwise(name), 1, longest), r"^[. ]+|[. ]+$", "")


def normal_phrase(phrase: Column) -> Column:
    """Lower case, underscores and white space as single blanks."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(phrase), "_", " "), f"[{SPACE}]+", " "))


def unit_form(phrase: Column) -> Column:
    """A phrase as one unit: white space as underscores."""
    return F.regexp_replace(strip(phrase), f"[{SPACE}]+", "_")


# Names of sites at the end of a page title.
SITE_SUFFIX = r"(?i)\s*[-_｜|]\s*(?:Wikisource|Chinese Text Project|中國哲學書電子化計劃).*$"


def without_site(title: Column) -> Column:
    return F.regexp_replace(strip(title), SITE_SUFFIX, "")


def size_in_bytes(text: str | None) -> int | None:
    """The number of bytes of a size such as 500000, 500KB or 1.5G, to the base 1024; None for a blank one."""
    if text is None or not text.strip():
        return None
    found = re.fullmatch(r"(\d+(?:\.\d+)?)\s*(?:([kmgt])b?|b|bytes?)?", text.strip().lower())
    if not found:
        raise ValueError(f"not a size: {text!r}")
    return int(float(found[1]) * 1024 ** (" kmgt".index(found[2]) if found[2] else 0))
