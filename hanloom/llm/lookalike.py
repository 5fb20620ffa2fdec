"""Problem 1: text that is displayed alike but written with other characters.

The vocabulary of plainly written tokens is held in tries and walked with a weighted edit
automaton: look-alikes and ignorable characters cost nothing, a letter of another script than its
word's costs one, any other edit is not allowed.  A walk that costs nothing gives an irregular token
its canonical spelling: the plain spelling of the vocabulary, or where none is attested the most
frequent spelling in one script (so that Russian or Greek words stay what they are).  A walk that
costs one reads an unknown letter by the word around it; a letter that several words read alike, and
hardly any otherwise, is learnt as a look-alike and from then on costs nothing (``learnt_letters``).
What no vocabulary entry matches is folded by table.

Nulls give a null canonical text and take part in no pair.  Empty texts are equal to each
other code point for code point and therefore make no pair.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep
from .common import arrow_map, flat_map, per_task, signed64

# Letters of other blocks that are drawn like a Latin letter or a Han character.
GREEK_AS_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ", "ABEZHIKMNOPTYXocj"))
CYRILLIC_AS_LATIN = dict(zip("АВЕЅІЈКМНОРСТУХЬаеѕіјорсухһԁԛԝԚԜӏ", "ABESIJKMHOPCTYXbaesijopcyxhdqwQWl"))
LATIN_AS_LATIN = dict(zip("ÐƉɑɡ", "ĐĐag"))
KANA_AS_HAN = dict(zip("ニハロタカエト", "二八口夕力工卜"))
RADICALS_AS_HAN = {"⺅": "亻", "⺌": "小", "⻌": "辶", "⻑": "長", "⻔": "門", "⻩": "黃", "⿊": "黑"}

IGNORABLE_MARKS = [0x34F, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), *range(0x180B, 0x180F)]


@lru_cache(1)
def fold_table() -> dict[int, str | None]:
    """Character → what it stands for, over decomposed text; None: left out."""
    table: dict[int, str | None] = {}
    for code in [*range(0x10000), *range(0x110BD, 0x110CE), *range(0x1BCA0, 0x1BCA4), *range(0x1D173, 0x1D17B), *range(0x1D400, 0x1D800), *range(0x1EE00, 0x1EF00), *range(0xE0000, 0xE0080)]:
        char = chr(code)
        kind = unicodedata.category(char)
        if kind == "Cf":
            table[code] = None
        elif kind == "Zs" or char == "\t":
            table[code] = " "
        elif unicodedata.decomposition(char).startswith(("<font>", "<wide>", "<narrow>")):
            # Letters of another style or width, mathematical alphabets included.
            table[code] = unicodedata.normalize("NFKD", char)
        elif 0x2F00 <= code <= 0x2FD5 or 0x2E80 <= code <= 0x2EF3 or 0xFF00 <= code <= 0xFFEF or 0xFB00 <= code <= 0xFB06 or 0x2160 <= code <= 0x217F:
            if (plain := unicodedata.normalize("NFKD", char)) != char:
                table[code] = plain
    table |= dict.fromkeys(IGNORABLE_MARKS)
    for alike in (GREEK_AS_LATIN, CYRILLIC_AS_LATIN, LATIN_AS_LATIN, RADICALS_AS_HAN):
        table |= {ord(a): unicodedata.normalize("NFD", b) for a, b in alike.items()}
    del table[32]
    return table


#: Kana are read as Han characters only beside Han characters, as kana words are real text.
_KANA = regex.compile(r"(?<![\p{Katakana}\p{Hiragana}ー])[ニハロタカエト](?![\p{Katakana}\p{Hiragana}ー])")
#: Tokens: a word of an alphabetic script with what may be inside it; a Han character, here only one that is
#: compatible with another, a radical or followed by a selector, as the plain ones need no rewriting.
_WORD = r"[\p{L}\p{M}\p{Cf}--\p{Han}]+"
_ODD_HAN = r"[\u2e80-\u2fd5\uf900-\ufaff\U0002f800-\U0002fa1f][\ufe00-\ufe0f\U000E0100-\U000E01EF]*|\p{Han}[\ufe00-\ufe0f\U000E0100-\U000E01EF]+"
_TOKEN = regex.compile(f"{_ODD_HAN}|{_WORD}", regex.V1)
_HAN = regex.compile(r"\p{Han}")


_LETTERS = regex.compile(r"[\p{L}\p{M}]+")


def _read(word: str, learnt: dict[str, str]) -> str:
    odd = [i for i in foreign(word) if word[i] in learnt]
    if not odd:
        return word
    chars = list(word)
    for i in odd:
        chars[i] = learnt[word[i]]
    return "".join(chars)


class Folded(dict):
    """token → folded token, remembered as tokens recur; emptied when it has grown."""

    def __init__(self, learnt: dict[str, str] | None = None) -> None:
        super().__init__()
        self.learnt = learnt

    def __missing__(self, token: str) -> str:
        if len(self) > 200_000:
            self.clear()
        self[token] = plain = fold(token, self.learnt)
        return plain


def odd_tokens(text: str, known: Folded) -> set[str]:
    """The tokens of ``text`` that are not in folded form."""
    if text.isascii():
        return set()
    return {t for t in set(_TOKEN.findall(text)) if known[t] != t}


@lru_cache(4096)
def script(char: str) -> str:
    """The script of a letter: the first word of its name; '' for what is no letter."""
    return unicodedata.name(char, "").split(" ")[0] if char.isalpha() else ""


def foreign(plain: str) -> list[int]:
    """The places of the letters of a decomposed word that are of another script than most of it."""
    scripts = [script(c) for c in plain]
    counted = Counter(s for s in scripts if s)
    if len(counted) < 2:
        return []
    (main, most), (_, second) = counted.most_common(2)
    return [i for i, s in enumerate(scripts) if s and s != main] if most > second else []


def fold(text: str, learnt: dict[str, str] | None = None) -> str:
    """The one form of all texts displayed like ``text``, by table; ``learnt`` letters are read in words of another script."""
    plain = unicodedata.normalize("NFD", text).translate(fold_table())
    if learnt and not plain.isascii() and any(c in plain for c in learnt):
        plain = _LETTERS.sub(lambda m: _read(m[0], learnt), plain)
    plain = unicodedata.normalize("NFC", plain)
    return _KANA.sub(lambda m: KANA_AS_HAN[m[0]], plain) if _KANA.search(plain) else plain


class SpellingTrie:
    """Vocabulary of spellings with their counts, in decomposed form."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, token: str, count: int) -> None:
        node = self.root
        for char in unicodedata.normalize("NFD", token):
            node = node.setdefault(char, {})
        node[""] = (count, token)

    def nearest(self, token: str, budget: int = 0) -> list[tuple[int, int, str]]:
        """(cost, count, spelling) of what ``token`` may stand for, look-alikes and ignorables being free.

        Letters of another script than the word's cost one each, up to ``budget``; other letters must agree.
        """
        plain = unicodedata.normalize("NFD", token).translate(fold_table())
        if len(plain) == 1:
            plain = unicodedata.normalize("NFD", fold(token))
        odd = set(foreign(plain)) if budget else set()
        states: dict[int, tuple[dict, int]] = {id(self.root): (self.root, 0)}
        for at, char in enumerate(plain):
            after: dict[int, tuple[dict, int]] = {}

            def reach(node: dict, cost: int) -> None:
                if cost <= budget and (id(node) not in after or after[id(node)][1] > cost):
                    after[id(node)] = (node, cost)

            for node, cost in states.values():
                if char in node:
                    reach(node[char], cost)
                if at in odd:
                    for letter, child in node.items():
                        if letter and letter != char and letter.isalpha():
                            reach(child, cost + 1)
            states = after
            if not states:
                return []
        return sorted(((cost, -node[""][0], node[""][1]) for node, cost in states.values() if "" in node))


def _tokens(rows: DataFrame) -> DataFrame:
    """(token, n): distinct tokens with counts, added up in each partition before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(seen: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

        seen: Counter = Counter()
        chars: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(_TOKEN.findall(text))
                    chars.update(text)
            if len(seen) > 200_000:
                yield flush(seen)
                seen = Counter()
        seen.update({c: n for c, n in chars.items() if _HAN.match(c)})
        if seen:
            yield flush(seen)

    return arrow_map(rows, count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


#: A letter is learnt from at least this many words, if at least this share of the words it stands in read it alike.
LEAST_WORDS, LEAST_SHARE = 3, 0.8


def _in_buckets(rows: DataFrame, each) -> DataFrame:
    """Rows (bucket, token, odd, n) walked bucket by bucket: ``each(trie, odd tokens)`` gives (token, canonical) rows.

    A bucket is a hash of one folded form or of a word but for one letter, so it holds a few spellings; a
    task sees its buckets in order and keeps one at a time.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[str, str]] = []
        current, trie, odd = None, SpellingTrie(), []
        for batch in batches:
            for bucket, token, is_odd, n in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != current:
                    found += each(trie, odd)
                    current, trie, odd = bucket, SpellingTrie(), []
                if is_odd:
                    odd.append((token, n))
                else:
                    trie.add(token, n)
            if len(found) > 50_000:
                yield _two(found)
                found = []
        found += each(trie, odd)
        yield _two(found)

    return arrow_map(rows.repartition("bucket").sortWithinPartitions("bucket"), walk, "token string, canonical string")


def _two(pairs: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], ["token", "canonical"])


def _readings(trie: SpellingTrie, odd: list[tuple[str, int]]) -> list[tuple[str, str]]:
    """(unknown letter, what it is read as) for each word that the vocabulary holds but for this letter.

    The most frequent word decides, if it is far more frequent than one with another letter.
    """
    out = []
    for token, _ in odd:
        near = [x for x in trie.nearest(token, 1) if x[0] == 1]
        if near and (len(near) == 1 or near[0][1] <= 4 * near[1][1]):
            plain, meant = unicodedata.normalize("NFD", token).translate(fold_table()), unicodedata.normalize("NFD", near[0][2])
            out += [(a, b) for a, b in zip(plain, meant) if a != b]
    return out


def learnt_letters(counted: DataFrame) -> dict[str, str]:
    """Letter → the letter it is drawn like, learnt from words that are in the vocabulary but for it.

    The result has at most one entry for each character there is.
    """

    def marked(token, n):
        plain = unicodedata.normalize("NFD", token).translate(fold_table())
        odd = foreign(plain)
        if len(odd) == 1:
            at = odd[0]
            yield signed64(f"{at} {plain[:at]} {plain[at + 1:]}"), token, True, n

    odd = flat_map(counted, marked, "bucket bigint, token string, odd boolean, n bigint")

    def spread(token, n):
        plain = unicodedata.normalize("NFD", token)
        if len(plain) > 1 and len({script(c) for c in plain} - {""}) == 1 and fold(token) == token:
            for at, char in enumerate(plain):
                if char.isalpha():
                    yield signed64(f"{at} {plain[:at]} {plain[at + 1:]}"), token, False, n

    # Only the vocabulary that shares a bucket with an odd word goes on.
    plain = flat_map(counted, spread, "bucket bigint, token string, odd boolean, n bigint").join(odd.select("bucket").distinct(), "bucket", "left_semi")
    read = _in_buckets(odd.unionByName(plain), _readings).toDF("letter", "meant")
    votes = read.groupBy("letter", "meant").agg(F.count("*").alias("words"))
    total = votes.groupBy("letter").agg(F.sum("words").alias("total"), F.max_by("meant", F.struct("words", "meant")).alias("meant"), F.max("words").alias("words"))
    return {r.letter: r.meant for r in total.where((F.col("words") >= LEAST_WORDS) & (F.col("words") >= F.col("total") * LEAST_SHARE)).toLocalIterator()}


def _regular(token: str) -> bool:
    """Composed, of one script, and nothing but letters and accents."""
    return unicodedata.is_normalized("NFC", token) and len({script(c) for c in token} - {""}) == 1 and all(c.isalpha() or unicodedata.category(c)[0] == "M" for c in token)


def canonical_tokens(counted: DataFrame, learnt: dict[str, str]) -> DataFrame:
    """(token, canonical) of every irregular token of the vocabulary that a plain spelling matches."""

    def placed(token, n):
        plain = fold(token, learnt)
        yield signed64(plain), token, plain != token, n

    def select(trie: SpellingTrie, odd: list[tuple[str, int]]) -> list[tuple[str, str]]:
        if not odd:
            return []
        out = []
        # Without a plain spelling the most frequent regular one stands for all.
        others = [(n, t) for t, n in odd if _regular(t)]
        stand_in = min(others, key=lambda x: (-x[0], x[1]))[1] if others else None
        for token, _ in odd:
            near = trie.nearest(unicodedata.normalize("NFD", fold(token, learnt)))
            if (chosen := near[0][2] if near else stand_in) is not None:
                out.append((token, chosen))
        return out

    return _in_buckets(flat_map(counted, placed, "bucket bigint, token string, odd boolean, n bigint"), select)


def vocabulary(texts: DataFrame, learn: bool = True) -> tuple[dict[str, str], DataFrame]:
    """The learnt letters and the canonical spellings of the irregular tokens of ``texts``."""
    counted = keep(_tokens(texts.select("text")))
    learnt = learnt_letters(counted) if learn else {}
    return learnt, canonical_tokens(counted, learnt)


def _spellings(texts: DataFrame, names: DataFrame, key: str, kind: str, learnt: dict[str, str]) -> DataFrame:
    """(key, spelling): for each text with irregular tokens, their canonical spellings as a map."""

    @per_task
    def irregular():
        known = Folded(learnt)
        return lambda ident, text: [(ident, t) for t in odd_tokens(text, known)]

    wanted = flat_map(texts, irregular, f"{key} {kind}, token string")
    return wanted.join(names, "token").groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("token", "canonical"))).alias("spelling"))


def rewritten(text: str, spelling: list | None, learnt: dict[str, str]) -> str:
    """``text`` in canonical form: matched tokens by the vocabulary, the rest by table."""
    if not spelling:
        return fold(text, learnt)
    known, out, at = dict(spelling), [], 0
    for m in _TOKEN.finditer(text):
        if (canonical := known.get(m[0])) is not None:
            out += [fold(text[at : m.start()], learnt), canonical]
            at = m.end()
    return unicodedata.normalize("NFC", "".join(out) + fold(text[at:], learnt))


def canonicalise(rows: DataFrame, key: str) -> DataFrame:
    """(key, text, canonical): each distinct row of ``rows`` with its canonical text."""
    texts = rows.select(key, "text").where(F.col("text").isNotNull())
    learnt, names = vocabulary(texts)
    kind = dict(texts.dtypes)[key]
    found = _spellings(texts, names, key, kind, learnt)
    return flat_map(texts.join(found, key, "left"), lambda ident, text, spelling: [(ident, text, rewritten(text, spelling, learnt))], f"{key} {kind}, text string, canonical string")


def display_forms(rows: DataFrame, key: str) -> DataFrame:
    """(key, form, form2, exact): two hashes of the canonical text and one of the text as it stands, each row once."""
    texts = rows.select(key, "text").where(F.col("text").isNotNull())
    learnt, names = vocabulary(texts)
    kind = dict(texts.dtypes)[key]
    found = _spellings(texts, names, key, kind, learnt)

    def sign(ident, text, spelling):
        canonical = rewritten(text, spelling, learnt)
        return [(ident, signed64(canonical), signed64("#" + canonical), signed64(text))]

    return flat_map(texts.join(found, key, "left"), sign, f"{key} {kind}, form bigint, form2 bigint, exact bigint").distinct()


def same_display_groups(rows: DataFrame, key: str) -> DataFrame:
    """(key, group_id, texts): one row for each text, the smallest key displayed alike, and in how many ways the group is written."""
    signs = keep(display_forms(rows, key))
    groups = signs.groupBy("form", "form2").agg(F.min(key).alias("group_id"), F.count_distinct("exact").alias("texts"))
    return signs.join(groups, ["form", "form2"]).select(key, "group_id", "texts").distinct()


def same_display_pairs(rows: DataFrame, key: str) -> DataFrame:
    """Pairs of keys, smaller first, whose texts differ in code points but not in display."""
    signs = keep(display_forms(rows, key))
    several = signs.groupBy("form", "form2").agg(F.min("exact").alias("lo"), F.max("exact").alias("hi")).where("lo <> hi").select("form", "form2")
    kept = signs.join(several, ["form", "form2"])
    a, b = kept.alias("a"), kept.alias("b")
    on = (F.col("a.form") == F.col("b.form")) & (F.col("a.form2") == F.col("b.form2")) & (F.col("a.exact") != F.col("b.exact")) & (F.col(f"a.{key}") < F.col(f"b.{key}"))
    return a.join(b, on).select(F.col(f"a.{key}").alias(f"{key}_a"), F.col(f"b.{key}").alias(f"{key}_b")).distinct()
