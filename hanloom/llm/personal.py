"""Problem 10: personal information inside free text.

Contextual extraction by bootstrapping.  Entities with a form of their own (e-mail addresses,
telephone and identity numbers, postal addresses) are the seeds.  Around each seed, every
name-shaped stretch gives lexical patterns: the words before it and the words between it and the
seed.  Spark scores the graph of patterns and instances: a pattern is worth as much as its
instances are varied, and an instance is taken by its best pattern.  The accepted patterns then
find names, and every span is replaced by a placeholder of its kind.  Numbers behind words that no
list holds are found in the same way: a pattern of the words before a number and of what joins it
to a name is accepted if names and numbers vary and most numbers are written like those of seeds.

Two further rounds take the seed out of the patterns.  In the second, the words before a name and the
character after it are a pattern by themselves, trusted if nearly all names it holds beside seeds are
known; it takes names whose joint with the seed is rare.  In the third, the trusted words are looked
up in every text, seed or no seed; a pattern is kept if most of what it holds there is known from
the rounds before, so that words which also announce cited authors are dropped.

Null and empty texts hold no span.  Positions count code points; repeated rows give one span.
"""

from __future__ import annotations

from collections.abc import Iterable

import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, keep
from .common import flat_map, per_task

# Forms of entities in the four languages of the corpus.
_DIGIT = r"[0-9０-９]"
_GAP = r"[ .\-－　]?"
_EMAIL = r"[A-Za-z0-9][\w.+\-]*[ ]?(?:@|＠|[\[(（](?:at|a còng|arobase)[\])）])[ ]?[A-Za-z0-9\-]+(?:(?:\.|[ ]?\[dot\][ ]?|[ ]?\(dot\)[ ]?)[A-Za-z0-9\-]+)*(?:\.|[ ]?\[dot\][ ]?|[ ]?\(dot\)[ ]?)[A-Za-z]{2,}"
_EXTENSION = r"(?:[ ]?(?:轉|ext\.?|máy lẻ|poste)[ ]?[0-9０-９]{1,5})?"
_PHONE = rf"(?:[+＋]|[(（][+＋]?)?{_DIGIT}(?:[()（） .\-－]{{0,2}}{_DIGIT}){{7,14}}{_EXTENSION}"
_NUMBER = rf"[A-Z]{{0,2}}[ ]?{_DIGIT}(?:[ .\-－]?{_DIGIT}){{4,20}}(?:[ \-]?[A-Z](?![A-Za-z]))?"
# The words that announce a number, and those after which a number is a shelf mark, a film or a book.
_PHONE_CUE = r"(?:電話[：:]?|điện thoại:?|(?<!\p{L})đt\.?|Liên hệ|tél\.|Appelez le|Call|Tel\.?:?|phone|\()[ ]?"
_ID_CUE = r"(?:身分證號(?:碼)?|證件號碼|護照號(?:碼)?|số căn cước|CCCD|CMND|hộ chiếu(?: số)?|số định danh|passport(?: no\.?)?|passeport(?: n[o°]\.?)?|carte d[’']identité(?: n[o°]\.?)?|identity card(?: no\.?)?|social security(?: number| no\.?)?|sécurité sociale(?: n[o°]\.?)?)[ :：]?[ ]?"
_ID_FORM = r"(?:[A-Z]{1,2}[ ]?)?[0-9０-９](?:[ .\-－]?[0-9０-９A-Z](?![a-wyz])){4,24}[xX]?"
# How addresses are built.
_UPPER = r"\p{Lu}[\p{L}\p{M}’'\-]*"
_WORDS = rf"{_UPPER}(?:[ ]{_UPPER})*"
_ADDRESS_ZH = r"(?![在住於居址])\p{Han}{2,3}[市縣](?:\p{Han}{1,3}[區鄉鎮])?\p{Han}{1,3}(?:街|路|村|巷)(?:[一二三四五六七八九十百〇零0-9]+巷)?[0-9０-９]+號(?:之[0-9０-９]+|[0-9０-９]+樓)?"
_ADDRESS_VI = (
    rf"(?:(?:[Ss]ố[ ]\d+(?:/\d+)*|\d+(?:/\d+)+|\d+(?=,?[ ](?:ngõ|ngách|hẻm|tổ|đường|phố)[ ])),?[ ](?:(?:ngõ|ngách|hẻm|tổ)[ ]\d+,?[ ])*(?:(?:đường|phố)[ ])?{_WORDS}|(?:thôn|xóm|ấp|bản)[ ]{_WORDS})"
    rf"(?:[,\n][ ]?(?:(?:phường|quận|xã|huyện|thành phố|thị xã|tỉnh)[ ]{_WORDS}|P\.[ ]?\d+|Q\.[ ]?\d+|TP\.[ ]?{_WORDS}|{_WORDS}))+"
)
_TOWN = rf"{_UPPER}(?:[ ]{_UPPER}(?![\p{{L}}\d]))*"
_ADDRESS_EN = rf"P\.[ ]?O\.[ ]Box[ ]\d+,[ ]{_TOWN}|(?:(?:Flat|Apt\.?|Unit)[ ]\d+,[ ])?\d+[A-Za-z]?[ ](?:{_UPPER}[ ]){{1,3}}(?:Street|Lane|Road|Avenue|Close|Row|Square),[ ]{_TOWN}(?:[ ][A-Z]{{1,2}}\d{{1,2}}[A-Z]?[ ]\d[A-Z]{{2}})?"
_ADDRESS_FR = rf"\d+(?:[ ](?:bis|ter))?,[ ](?:rue|avenue|impasse|quai|boulevard|place|allée|chemin)[ ](?:(?:des|du|de la|de l’|de|d’|l’)[ ]?)?{_WORDS}(?:,[ ](?:\d{{5}}[ ])?{_UPPER}(?:[ ]{_UPPER})*)+"

# A name: words with capitals and initials, in one script, or two to four Han characters.
_NAME_LATIN = r"(?:\p{Lu}\.(?:-\p{Lu}\.)?|\p{Lu}[\p{L}\p{M}’'\-]*)(?:[ ](?:\p{Lu}\.|\p{Lu}[\p{L}\p{M}’'\-]*))*"

#: Reach of a pattern around an entity, in code points.
REACH = 34
#: A pattern needs as many different first and last parts of names as this.
VARIETY = 4
#: Of the names that words announce beside seeds, and in all texts, these shares must be known.
TRUST_NEAR, TRUST_ANYWHERE = 0.8, 0.6
#: Announcing words looked up in one pass over the texts; more of them are looked up in several.
CUE_BLOCK = 100_000


class Finder:
    """Entities with a form of their own, and the contexts of name-shaped stretches near them."""

    def __init__(self) -> None:
        c = regex.compile
        self.email = c(_EMAIL, regex.V1)
        self.ident = c(rf"(?i:{_ID_CUE})(?P<x>{_ID_FORM})", regex.V1)
        self.phone = c(rf"(?:{_PHONE_CUE})(?P<x>{_PHONE})", regex.V1)
        self.phone_trunk = c(rf"(?<![\w+＋])[+＋]{_DIGIT}(?:[()（） .\-－]{{0,2}}{_DIGIT}){{8,14}}{_EXTENSION}", regex.V1)
        self.number = c(rf"(?<![\w.\-－/])(?P<p>[A-Z]{{1,2}}[ ]?|[+＋(（])?(?P<x>{_DIGIT}(?:[()（） .\-－]{{0,2}}[0-9０-９A-Z](?![a-wyz])){{5,24}})(?![\w/])", regex.V1)
        self.gap = c(r"[^.!?。\d\n\p{Lu}]{1,12}")
        self.cue = c(r"(?:[^\s.!?。\d]+ ){1,3}\Z")
        self.before = c(r"(?:^|(?<=[\s,;:(]))(?P<n>" + _NAME_LATIN + r")(?P<g>[^.!?。\d\n\p{Lu}]{3,26})\Z", regex.V1)
        self.zh = c(_ADDRESS_ZH, regex.V1)
        self.vi, self.en, self.fr = c(_ADDRESS_VI, regex.V1), c(_ADDRESS_EN, regex.V1), c(_ADDRESS_FR, regex.V1)
        # What a text must hold at all for a form to be possible; a quick test before the search.
        self.hints = [
            (self.email, "email", c(r"[@＠]|[\[(（](?:at|a còng|arobase)[\])）]")),
            (self.ident, "id_number", c(r"(?i)證號|證件|護照|căn cước|CCCD|CMND|hộ chiếu|định danh|passe?port|identi|securi|sécuri")),
            (self.phone, "phone", c(rf"{_DIGIT}(?:\D{{0,2}}{_DIGIT}){{7}}")),
            (self.phone_trunk, "phone", c(rf"[+＋]{_DIGIT}")),
            (self.zh, "address", c(r"[0-9０-９]號")),
            (self.vi, "address", c(r"[Ss]ố \d|\d/\d|\d,? (?:ngõ|ngách|hẻm|tổ|đường|phố) |(?:thôn|xóm|ấp|bản) \p{Lu}")),
            (self.en, "address", c(r"Box \d|Street|Lane|Road|Avenue|Close|Row|Square")),
            (self.fr, "address", c(r"\d(?: bis| ter)?, (?:rue|avenue|impasse|quai|boulevard|place|allée|chemin) ")),
        ]
        self.digits = c(_DIGIT)
        self.latin = c(_NAME_LATIN, regex.V1)
        self.sentence_end = c(r"[。｡]|(?<=\p{L}{3}|\d)(?<!attn)[.!?]+(?=\s|\Z)|\A[.!?]+(?=\s|\Z)", regex.V1)
        self.last_sentence = c(r".*(?:(?<=\p{L}{3}|\d|[)”’»])[.!?…]+[”»]?|[…」』—])\s+", regex.V1 | regex.S)
        self.letters = c(r"\p{L}{2}")

    def entities(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) without overlaps, in order."""
        spans = []
        for form, kind, hint in self.hints:
            if not hint.search(text):
                continue
            for m in form.finditer(text):
                start, end = m.span("x") if form is self.phone or form is self.ident else m.span()
                if form is self.phone:
                    if text[start - 1 : start] == "(" and text[start - 2 : start - 1] not in (" ", "") and m[0].startswith("("):
                        continue
                    start = self._with_bracket(text, start)
                spans.append((start, end, kind))
        spans.sort(key=lambda s: (s[0], -s[1]))
        out: list[tuple[int, int, str]] = []
        for span in spans:
            if not out or span[0] >= out[-1][1]:
                out.append(span)
        return out

    @staticmethod
    def _with_bracket(text: str, start: int) -> int:
        """An area code in brackets belongs to the number, brackets around the whole number do not."""
        if start and text[start - 1] in "(（":
            close = min([p for p in (text.find(")", start), text.find("）", start)) if p >= 0], default=-1)
            if 0 <= close - start <= 5:
                return start - 1
        return start

    def numbers(self, text: str, entities: list[tuple[int, int, str]]) -> Iterable[tuple[int, int, int, str, str, str, str]]:
        """(start, end, first digit, cue, gap, first, last) of every number that is no entity and is joined to a name."""
        for m in self.number.finditer(text):
            at, end = m.span("x")
            if any(a < end and m.start() < b for a, b, _ in entities):
                continue
            # What looks like letters of the number may be the last word of the cue.
            for start in dict.fromkeys((m.start(), at)):
                line = text[max(text.rfind("\n", 0, start) + 1, start - 3 * REACH) : start]
                if (gap := self.gap.match(text, end)) and (name := self.latin.match(text, gap.end())) and (cue := self.cue.search(line)) and self.letters.search(cue[0]):
                    words = name[0].split(" ")
                    yield start, end, at, cue[0], gap[0], words[0], words[-1]
                if (name := self.before.search(line)) and self.letters.search(name["g"]):
                    words = name["n"].split(" ")
                    yield start, end, at, "<name>" + name["g"], "", words[0], words[-1]

    def contexts(self, text: str, entities: list[tuple[int, int, str]]) -> Iterable[tuple[int, int, str, str, str, str]]:
        """(start, end, left, right, first, last) of every name-shaped stretch near an entity."""
        edge = 0
        for i, (start, end, kind) in enumerate(entities):
            lo = max(edge, text.rfind("\n", 0, start) + 1, start - 2 * REACH)
            edge = end
            before = text[lo:start]
            stop = max(before.rfind("。"), before.rfind("｡"), before.rfind("）"))
            lo += stop + 1
            yield from self._around(text, lo, start, f"<{kind}>", "", start, "")
            limit = entities[i + 1][0] if i + 1 < len(entities) else len(text)
            hi = min(limit, end + 3 * REACH, n if (n := text.find("\n", end)) >= 0 else len(text))
            after = text[end:hi]
            if stop := self.sentence_end.search(after):
                hi = end + stop.start()
            yield from self._around(text, end, hi, "", f"<{kind}>", hi, text[hi : hi + 1])

    def _around(self, text: str, lo: int, hi: int, right: str, left: str, bound: int, closing: str) -> Iterable[tuple]:
        part = text[lo:hi]
        han = sum("㐀" <= c <= "鿿" for c in part)
        if han >= 2 and han * 2 >= sum(c.isalpha() for c in part):
            for a in range(len(part)):
                for size in (2, 3, 4):
                    name = part[a : a + size]
                    if len(name) < size or not all("一" <= c <= "鿿" for c in name):
                        break
                    if left:
                        if a > 3 or len(part) - a - size > 3:
                            continue
                        yield lo + a, lo + a + size, left + part[:a], part[a + size :] + closing, name[0], name[-1]
                    elif len(part) - a - size <= 12:
                        before = part[max(0, a - 3) : a]
                        if len(before) >= 2:
                            yield lo + a, lo + a + size, before, part[a + size :] + right, name[0], name[-1]
            return
        for m in self.latin.finditer(part):
            words = m[0].split(" ")
            a = m.start()
            for drop in range(len(words)):
                name = words[drop:]
                if drop:
                    a += len(words[drop - 1]) + 1
                b = lo + m.end()
                gap = text[b:bound] if not left else part[m.end() : m.end() + 2]
                if left:
                    lead = part[:a]
                    if len(lead) > 24 or not self.letters.search(lead):
                        continue
                    yield lo + a, b, left + lead, gap[:1], name[0], name[-1]
                elif len(gap) <= 26:
                    lead = part[:a]
                    if ended := self.last_sentence.match(lead):
                        lead = lead[ended.end() :]
                    # Two widths: the nearest word alone, and up to two words and what joins them.
                    for lead in dict.fromkeys((" ".join(lead.split(" ")[-3:])[-18:], " ".join(lead.split(" ")[-2:])[-18:])):
                        yield lo + a, b, lead, gap + right, name[0], name[-1]


def structured_spans(rows: DataFrame, key: str) -> DataFrame:
    """(key, kind, start_pos, end_pos) of the entities with a form of their own."""
    kind = dict(rows.dtypes)[key]

    @per_task
    def find():
        finder = Finder()
        return lambda ident, text: [(ident, k, a, b) for a, b, k in finder.entities(text)] if text else []

    return flat_map(rows.select(key, "text"), find, f"{key} {kind}, kind string, start_pos bigint, end_pos bigint")


_AS_NINE, _AS_LETTER = regex.compile(_DIGIT), regex.compile(r"[A-Z]")


def number_shape(number: str) -> str:
    """How a number is written: digits as 9, letters as A, the rest as it stands."""
    return _AS_NINE.sub("9", _AS_LETTER.sub("A", number))


def _evidence(rows: DataFrame, key: str) -> DataFrame:
    """One row for each entity (left is null), each context of a name-shaped stretch near one, each other number
    joined to a name (kind 'number') and each context near such a number (kind 'near', of the number at ``start``)."""
    kind = dict(rows.dtypes)[key]

    @per_task
    def find():
        finder = Finder()

        def each(ident, text):
            entities = finder.entities(text) if text else []
            for a, b, k in entities:
                yield ident, k, a, b, None, None, None, None, number_shape(text[a:b]) if k in ("phone", "id_number") else None, None, None, None
            if entities:
                for a, b, left, right, first, last in finder.contexts(text, entities):
                    yield ident, "name", a, b, left, right, first, last, None, None, None, None
            starts = {}
            for a, b, digit, cue, gap, first, last in finder.numbers(text, entities) if text else ():
                starts[a] = b
                yield ident, "number", a, b, cue, gap, first, last, number_shape(text[a:b]), text[a:b], a, digit
            for at, end in starts.items():
                for a, b, left, right, first, last in finder.contexts(text, [(at, end, "number")]):
                    yield ident, "near", a, b, left, right, first, last, None, None, at, None

        return each

    schema = f"{key} {kind}, kind string, start_pos bigint, end_pos bigint, left string, right string, first string, last string, shape string, number string, start bigint, digit bigint"
    return flat_map(rows.select(key, "text"), find, schema).distinct()


def discovered_numbers(evidence: DataFrame, key: str) -> DataFrame:
    """(key, kind, start_pos, end_pos) of the numbers that stand in an accepted pattern and are in no list of cues."""
    written = evidence.where("left is null and shape is not null").groupBy("shape").agg(F.mode("kind", True).alias("of"))
    numbers = evidence.where("kind = 'number'").drop("kind").join(written, "shape", "left")
    # Of the readings of one number the one written like a seed, else the longest.
    order = Window.partitionBy(key, "digit").orderBy(F.col("of").isNull(), "start_pos", F.length("left"), "left")
    numbers = numbers.withColumn("best", F.first("start_pos").over(order)).where("start_pos = best")
    varied = numbers.groupBy("left", "right").agg(*[F.count_distinct(c).alias(f"n_{c}") for c in ("first", "last", "number")], F.count("*").alias("n"), F.count("of").alias("known"), F.mode("of", True).alias("kind"))
    accepted = varied.where(F.least("n_first", "n_last", "n_number") >= VARIETY).where("2 * known >= n")
    # Words that are trusted vouch for other joints, where the number is written like a seed.
    trusted = accepted.groupBy("left").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"), F.collect_set("right").alias("rights"))
    found = numbers.join(trusted, "left").where(F.array_contains("rights", F.col("right")) | F.col("of").isNotNull())
    return found.groupBy(key, "start_pos", "end_pos").agg(F.min(F.coalesce("of", "kind")).alias("kind")).select(key, "kind", "start_pos", "end_pos")


def _variety(least: int = VARIETY):
    return (F.col("firsts") >= least) & (F.col("lasts") >= least)


def _announced(found: DataFrame) -> DataFrame:
    """Contexts with the seed taken out: ``cue``, the words before the name, and ``next``, the character after it."""
    cue = F.regexp_replace("left", "^<[a-z_]+>", "")
    next_ = F.substring(F.regexp_replace("right", "<[a-z_]+>$", ""), 1, 1)
    return found.withColumns({"cue": cue, "next": next_}).where(F.col("cue").rlike(r"\p{L}\p{M}*\p{L}"))


def trusted_cues(contexts: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(cue, next) of the announcing words nearly all of whose names beside seeds are ``known`` (key, start_pos, end_pos)."""
    marked = _announced(contexts).join(known.select(key, "start_pos", "end_pos").distinct().withColumn("known", F.lit(1)), [key, "start_pos", "end_pos"], "left")
    scored = marked.groupBy("cue", "next").agg(
        F.count_distinct(F.when(F.col("known") == 1, F.col("first"))).alias("firsts"), F.count_distinct(F.when(F.col("known") == 1, F.col("last"))).alias("lasts"),
        F.count("known").alias("known"), F.count("*").alias("n"),
    )
    return scored.where(_variety() & (F.col("known") >= TRUST_NEAR * F.col("n"))).select("cue", "next")


def names_anywhere(rows: DataFrame, cues: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, start_pos, end_pos) of the names that trusted words announce in any text, where most they announce are ``known``."""
    kind = dict(rows.dtypes)[key]
    found = None
    block: dict[str, set[str]] = {}

    def look_up(block: dict[str, set[str]]) -> DataFrame:
        @per_task
        def find():
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for cue, followed in block.items():
                automaton.add_word(cue, (len(cue), cue, followed))
            automaton.make_automaton()
            latin = regex.compile(_NAME_LATIN, regex.V1)

            def each(ident, text):
                for last, (size, cue, followed) in automaton.iter(text) if text else ():
                    at = last + 1
                    if at > size and text[at - size - 1].isalpha() and not "㐀" <= text[at - size - 1] <= "鿿":
                        continue
                    if m := latin.match(text, at):
                        if text[m.end() : m.end() + 1] in followed:
                            yield ident, at, m.end(), cue, text[m.end() : m.end() + 1]
                        continue
                    for end in (at + 2, at + 3, at + 4):
                        if all("一" <= c <= "鿿" for c in text[at:end]) and text[end : end + 1] in followed and len(text) >= end:
                            yield ident, at, end, cue, text[end : end + 1]

            return each

        return flat_map(rows.select(key, "text"), find, f"{key} {kind}, start_pos bigint, end_pos bigint, cue string, next string").distinct()

    for row in cues.toLocalIterator():
        block.setdefault(row.cue, set()).add(row.next)
        if len(block) >= CUE_BLOCK:
            part = look_up(block)
            found, block = part if found is None else found.unionByName(part), {}
    if block:
        part = look_up(block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return known.select(key, "start_pos", "end_pos").limit(0)
    marked = found.join(known.select(key, "start_pos", "end_pos").distinct().withColumn("known", F.lit(1)), [key, "start_pos", "end_pos"], "left")
    # An unknown stretch that overlaps a known one is another reading of it, not another name.
    whole = Window.partitionBy(key).orderBy("start_pos").rangeBetween(-4, 4)
    marked = keep(marked.withColumn("beside", F.max(F.coalesce("known", F.lit(0))).over(whole)))
    scored = marked.where("known = 1 or beside = 0").groupBy("cue", "next").agg(F.count("known").alias("known"), F.count("*").alias("n")).where(F.col("known") >= TRUST_ANYWHERE * F.col("n")).select("cue", "next")
    return marked.where("known is null and beside = 0").join(scored, ["cue", "next"]).select(key, "start_pos", "end_pos").distinct()


def _without_overlaps(spans: DataFrame, key: str) -> DataFrame:
    """Of the stretches (key, start_pos, end_pos, score) that overlap, the best; a document's names are few."""
    before = Window.partitionBy(key).orderBy("start_pos", "end_pos").rowsBetween(Window.unboundedPreceding, -1)
    groups = spans.withColumn("reach", F.max("end_pos").over(before)).withColumn("new", (F.col("reach").isNull() | (F.col("start_pos") >= F.col("reach"))).cast("int"))
    groups = groups.withColumn("cluster", F.sum("new").over(Window.partitionBy(key).orderBy("start_pos", "end_pos")))
    pick = F.row_number().over(Window.partitionBy(key, "cluster").orderBy(F.desc("score"), F.desc(F.col("end_pos") - F.col("start_pos")), "start_pos"))
    return groups.withColumn("pick", pick).where("pick = 1").select(key, "start_pos", "end_pos")


def personal_spans(rows: DataFrame, key: str = "doc_id", rounds: int = 3) -> DataFrame:
    """(key, kind, start_pos, end_pos) of all personal information."""
    evidence = keep(_evidence(rows, key))
    discovered = cut_lineage(discovered_numbers(evidence, key))
    seeds = evidence.where("left is null").select(key, "kind", "start_pos", "end_pos").unionByName(discovered)
    sides = [key, "start_pos", "end_pos", "left", "right", "first", "last"]
    # Discovered numbers are seeds in turn.
    turn = discovered.select(key, F.col("start_pos").alias("start"), F.concat(F.lit("<"), "kind", F.lit(">")).alias("mark"))
    near = evidence.where("kind = 'near'").join(turn, [key, "start"])
    near = near.withColumns({side: F.replace(F.col(side), F.lit("<number>"), F.col("mark")) for side in ("left", "right")})
    contexts = keep(evidence.where("kind = 'name'").select(*sides).unionByName(near.select(*sides)).distinct())
    # First round: a pattern is both sides together; variety of the first and last parts is its score.
    patterns = contexts.groupBy("left", "right").agg(F.count_distinct("first").alias("firsts"), F.count_distinct("last").alias("lasts"))
    accepted = patterns.where(_variety()).select("left", "right", F.least("firsts", "lasts").cast("double").alias("score"))
    matched = contexts.join(accepted, ["left", "right"])
    names = _without_overlaps(matched.groupBy(key, "start_pos", "end_pos").agg(F.max("score").alias("score")), key)
    if rounds > 1:
        first = cut_lineage(names)
        cues = trusted_cues(contexts, first, key)
        # Second round: trusted words take names beside seeds whatever joins them; the first round goes before.
        more = _announced(contexts).join(cues, ["cue", "next"], "left_semi").select(key, "start_pos", "end_pos").distinct()
        names = first.withColumn("score", F.lit(2.0)).unionByName(more.withColumn("score", F.lit(1.0)))
        names = _without_overlaps(names.groupBy(key, "start_pos", "end_pos").agg(F.max("score").alias("score")), key)
    if rounds > 2:
        second = cut_lineage(names)
        names = second.unionByName(names_anywhere(rows, cues, second, key))
    return seeds.unionByName(names.select(key, F.lit("name").alias("kind"), "start_pos", "end_pos"))


def redacted(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text) with every span replaced by a placeholder such as <EMAIL>, the rest unchanged."""
    spans = personal_spans(rows, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "kind"))).alias("spans"))
    kind = dict(rows.dtypes)[key]

    def replace(ident, text, found):
        if text is None or not found:
            return [(ident, text)]
        out, at = [], 0
        for span in found:
            if span["start_pos"] >= at:
                out += [text[at : span["start_pos"]], f"<{span['kind'].upper()}>"]
                at = span["end_pos"]
        return [(ident, "".join(out) + text[at:])]

    return flat_map(rows.select(key, "text").join(spans, key, "left"), replace, f"{key} {kind}, text string")
