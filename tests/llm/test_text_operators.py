"""Small cases, brute force and round trips of the text operators."""

import itertools
import random
import unicodedata

import numpy as np
import pytest

from hanloom.llm import bilingual, leakage, lookalike, near_dup, page_body, personal, queries, scan_repair, sentences, site_lines, tokenizer

CANDIDATE = "global_id bigint, domain string, text string, title string, html_title string, content_kind string, txt_path string"


def candidates(spark, rows):
    """Rows (id, domain, text, kind) with the other columns empty."""
    return spark.createDataFrame([(i, d, t, None, None, k, None) for i, d, t, k in rows], CANDIDATE)


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


# --- 1 --------------------------------------------------------------------------------------


def test_fold_makes_look_alikes_equal():
    for a, b in [("Hеllо", "Hello"), ("ｆｕｌｌ", "full"), ("a​b", "ab"), ("a b", "a b"), ("⼈民", "人民"), ("金", "金"), ("ニ十", "二十"), ("ﬁn", "fin"), ("ệ", "ệ")]:
        assert lookalike.fold(a) == lookalike.fold(b), (a, b)


@pytest.mark.parametrize("a,b", [("hòa", "hoà"), ("國", "国"), ("A", "a"), ("a.", "a,"), ("a\nb", "a b"), ("ニュース", "二ュース"), ("da", "đa")])
def test_fold_keeps_what_differs(a, b):
    assert lookalike.fold(a) != lookalike.fold(b)


def test_same_display_pairs(spark):
    rows = candidates(spark, [(1, "a", "Hello 人", "html"), (2, "a", "Hеllo 人", "html"), (3, "a", "Hello 人", "html"), (4, "a", None, "html"), (5, "a", "", "html"), (5, "a", "", "html"), (2, "a", "Hеllo 人", "html")])
    assert pairs(lookalike.same_display_pairs(rows, "global_id")) == [(1, 2), (2, 3)]
    assert pairs(lookalike.same_display_pairs(rows.limit(0), "global_id")) == []


def test_trie_walks_with_a_budget():
    trie = lookalike.SpellingTrie()
    trie.add("hello", 5)
    trie.add("help", 9)
    assert [x[2] for x in trie.nearest("hеllо")] == ["hello"]
    assert trie.nearest("hexlo", 1) == []
    # An Armenian letter in a Latin word costs one, unless it agrees.
    assert trie.nearest("hellօ", 1) == [(1, -5, "hello")] and trie.nearest("hellօ") == []


def test_letters_are_learnt_from_words(spark):
    words = ["hello", "yellow", "money", "color", "stone"]
    rows = [(i, w) for i, w in enumerate(words * 3)] + [(100 + i, w.replace("o", "օ")) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "global_id bigint, text string")
    assert lookalike.vocabulary(df)[0] == {"օ": "o"}
    assert (0, 100) in pairs(lookalike.same_display_pairs(df, "global_id"))
    # A Russian word stays what it is where no Latin spelling is attested.
    other = spark.createDataFrame([(1, "сосна"), (2, "соснa")], "global_id bigint, text string")
    assert {r.canonical for r in lookalike.canonicalise(other, "global_id").collect()} == {"сосна"}
    assert {(r.global_id, r.group_id, r.texts) for r in lookalike.same_display_groups(other, "global_id").collect()} == {(1, 1, 2), (2, 1, 2)}


# --- 2 --------------------------------------------------------------------------------------


def test_repeated_lines_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), "\n".join(rng.choice(["Share this", "share THIS!", "©", "x y", f"own line {chr(97 + i % 26)}{i}"]) for _ in range(4)), "html") for i in range(30)]
    rows += [rows[0], (99, "a", None, "html")]
    expected = set()
    for site in ("a", "b"):
        own = {r[0]: r[2] for r in rows if r[1] == site}
        for i, text in own.items():
            for n, line in enumerate((text or "").split("\n"), 1):
                key = site_lines.line_key(line)
                support = sum(any(site_lines.line_key(x) == key for x in (t or "").split("\n")) for t in own.values())
                if len(key) >= 2 and support >= 4 and support >= 0.05 * len(own):
                    expected.add((i, n))
    df = candidates(spark, rows)
    assert set(pairs(site_lines.repeated_lines(df))) == expected
    cleaned = dict(pairs(site_lines.without_lines(df, site_lines.repeated_lines(df))))
    assert cleaned[99] is None
    assert all("Share this" not in (t or "") or rows[i][1] is None for i, t in cleaned.items() if i < 30)


def subsequence(a, b):
    it = iter(b)
    return all(x in it for x in a)


def test_frequent_sequences_match_brute_force(spark):
    rng = random.Random(8)
    for turn in range(2):
        docs = {i: [rng.randrange(6) for _ in range(rng.randrange(1, 6))] for i in range(24)}
        if turn:
            docs = {i: [1, 2, 3, *d] for i, d in docs.items()}
        lines = spark.createDataFrame([("s", i, list(range(1, len(d) + 1)), d) for i, d in docs.items()], "domain string, global_id bigint, numbers array<bigint>, items array<bigint>")
        sizes = spark.createDataFrame([("s", 24)], "domain string, documents bigint")
        mined = {tuple(r.sequence): r.support for r in site_lines.frequent_sequences(lines, sizes, "global_id", "domain").collect()}
        support = lambda q: sum(subsequence(q, d) for d in docs.values())
        assert mined and all(support(q) == n >= 4 for q, n in mined.items())
        # Every frequent sequence lies in a mined one that as many documents hold.
        for size in (1, 2, 3):
            for q in itertools.product(range(6), repeat=size):
                if (n := support(q)) >= 4:
                    assert any(m == n and subsequence(q, w) for w, m in mined.items()), (q, n)


# --- 3 --------------------------------------------------------------------------------------


def test_page_body_keeps_the_work(spark):
    schema = "doc_id string, page_id string, domain string, html_title string, title string, text string, content_kind string"
    rows = [(f"d{i}", "1", "s", f"Work{i} kỷ lược, quyển {i} - Site name", None, f"Home page\n\nWork{i} kỷ lược, quyển {i}\nUnique text number {chr(97 + i)} of the work.\n* * *\nMost read\nOther thing, quyển {i + 3}\nAbout us\n© 20{10 + i} Site name", "html") for i in range(9)]
    rows += [("dx", "1", "s", None, None, None, "html"), ("dy", "1", None, None, None, "", "html")]
    df = spark.createDataFrame(rows, schema)
    found = pairs(page_body.boilerplate_lines(df))
    assert found == sorted((f"d{i}", "1", n) for i in range(9) for n in (1, 6, 7, 8, 9))
    body = {r.doc_id: r.text for r in page_body.main_body(df).collect()}
    assert body["dx"] is None and "Unique" in body["d0"] and "Most read" not in body["d0"]
    assert pairs(page_body.boilerplate_lines(df.limit(0))) == []


def test_list_headings_do_not_depend_on_the_number_of_pages(spark):
    schema = "doc_id string, page_id string, domain string, html_title string, title string, text string, content_kind string"
    places = ["alpha", "beta", "gamma", "delta"]
    # Each entry stands once on a host; with more hosts the stock of four recurs.
    text = lambda h, i: f"Home page\nWork{places[i]} of host, scroll {i}\nOwn text {places[i]} of the {h}th work.\nA place, {places[i]} of {h}\nMost read\nThe {places[i]} chronicle\nLife of {places[i - 1]}\nAbout us"
    for hosts in (1, 12):
        rows = [(f"d{h}-{i}", "1", f"host{h}", f"Work{places[i]} of host, scroll {i} - Site name", None, text("abcdefghijkl"[h], i), "html") for h in range(hosts) for i in range(4)]
        found = pairs(page_body.boilerplate_lines(spark.createDataFrame(rows, schema)))
        assert found == sorted((f"d{h}-{i}", "1", n) for h in range(hosts) for i in range(4) for n in (1, 5, 6, 7, 8)), hosts


# --- 4 --------------------------------------------------------------------------------------


def test_han_numbers():
    assert [bilingual.han_number(x) for x in ("十", "二十一", "一千三十五", "三百四", "一萬二千", "〇", "人")] == [10, 21, 1035, 304, 12000, 0, None]


def test_alignment_permits_reordering(spark, data):
    table = spark.read.parquet(f"{data}/translation_cache.parquet")
    src = spark.createDataFrame([("s.txt", "Lê Thành Trung\n\nTrần Quang Phúc 1.035\nNguyễn Hiển Mai"), ("n.txt", None)], "file_name string, text string")
    cand = spark.createDataFrame([(1, "x/t.txt", "陳光福一千三十五\n黎誠忠\n\n別的話")], "global_id bigint, txt_path string, text string")
    gold = spark.createDataFrame([("s.txt", "t.txt"), ("s.txt", "t.txt"), ("s.txt", "none.txt"), ("n.txt", "t.txt"), (None, None)], "src string, tgt string")
    got = {(r.src_line, r.tgt_line) for r in bilingual.aligned_lines(src, cand, gold, table).collect()}
    assert {(1, 2), (3, 1)} <= got and not any(i == 4 for i, _ in got)
    assert bilingual.aligned_lines(src.limit(0), cand, gold, table).count() == 0


def test_line_merged_without_a_joint_gives_both_pairs():
    names = "a b c d e f g h i j k l m n o p q r s t".split()
    signs = [chr(0x4E00 + 100 + k) for k in range(20)]
    even = np.full(bilingual.TERMS, 4.0, np.float32)
    vectors = bilingual.Vectors([bilingual.row_of(t) for t in names], [bilingual.row_of(t) for t in signs], np.eye(20), np.eye(20), (even, even))
    han = dict(zip(names, signs))

    def zh(words):
        return "".join(han.get(w, w) for w in words.split())

    first, second, other, last = "a b c d e j", "f g h i", "k l m n o", "p q r s t"
    merged = f"{first} x y, {second}"
    text = "\n".join(zh(x) for x in (second, last, first, other))
    assert {(i, j) for i, j, _ in bilingual.align("\n".join([merged, other, last]), text, vectors)} == {(1, 3), (1, 1), (2, 4), (3, 2)}
    # The other side may merge, and a line that only resembles one unit is not taken for a second.
    assert {(i, j) for i, j, _ in bilingual.align("\n".join([first, other, second, last]), "\n".join([zh(first + " " + second), zh(other), zh(last)]), vectors)} == {(1, 1), (3, 1), (2, 2), (4, 3)}
    assert {(i, j) for i, j, _ in bilingual.align("\n".join([first, other, last]), "\n".join([zh("a b c 龍 龜"), zh(first), zh(other), zh(last)]), vectors)} == {(1, 2), (2, 3), (3, 4)}


def test_random_projection_agrees_with_full_decomposition():
    rng = np.random.default_rng(1)
    low = rng.standard_normal((60, 4)) @ rng.standard_normal((4, 50))
    i, j = np.nonzero(np.ones_like(low))
    u, sv, vt = np.linalg.svd(low, full_matrices=False)
    full = [m[:, :4] * np.sqrt(sv[:4]) for m in (u, vt.T)]
    full = [m / np.linalg.norm(m, axis=1, keepdims=True) for m in full]
    over, bilingual.OVER = bilingual.OVER, 6
    try:
        # Held in strips, and by its entries where most of it is empty.
        made = [bilingual.decompose(i, j, low.ravel(), low.shape, 4), bilingual.decompose(i * 30, j * 30, low.ravel(), (1800, 1500), 4)]
    finally:
        bilingual.OVER = over
    assert np.allclose(full[0] @ full[1].T, made[0][0] @ made[0][1].T, atol=1e-3)
    assert np.allclose(full[0] @ full[1].T, made[1][0][::30] @ made[1][1][::30].T, atol=1e-3)


def test_counts_are_the_same_in_small_tables(spark):
    units = spark.createDataFrame([("một hai ba bốn", "天地國民"), ("hai ba năm", "地國大水路"), ("", "兵")], "a string, b string")
    whole = {(r.s, r.c): round(r.n, 5) for r in bilingual._counts(units).collect()}
    rows = [bilingual.row_of(t) for t in ("hai", "國")]
    assert whole[rows[0], rows[1]] == round(1 / 4 + 1 / 5, 5) == whole[rows[0], -1]
    # A table of two terms gives the same sums.
    size, bilingual.TABLE = bilingual.TABLE, 2
    try:
        assert {(r.s, r.c): round(r.n, 5) for r in bilingual._counts(units).collect()} == whole
    finally:
        bilingual.TABLE = size


# --- 5 --------------------------------------------------------------------------------------


def brute(rows, least):
    sets = {}
    for i, t in rows:
        plain = near_dup.letters(t or "")
        if plain:
            sets[i] = {plain[k : k + 5] for k in range(max(1, len(plain) - 4))}
    return sorted((a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9)


def test_similar_pairs_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(60)]
        for c in range(4):
            rows.append((len(rows), " ".join(w if rng.random() > 0.03 * c else rng.choice(words) for w in base)))
    rows += [(100, None), (101, ""), (102, "ab"), (103, "ab"), (104, rows[0][1]), (0, rows[0][1])]
    df = candidates(spark, [(i, "d", t, "html") for i, t in rows])
    got = pairs(near_dup.similar_pairs(df, "global_id", 0.7))
    assert got == brute(rows, 0.7) and len(got) > 20
    groups = {r.global_id: r.group_id for r in near_dup.groups(df, "global_id", 0.7).collect()}
    label = {i: i for i, t in rows if near_dup.letters(t or "")}
    for _ in range(20):
        for a, b in got:
            label[a] = label[b] = min(label[a], label[b])
    assert groups == label
    assert pairs(near_dup.similar_pairs(df.limit(0), "global_id", 0.7)) == []


def test_trie_join_finds_all_within_budget():
    rng = random.Random(2)
    base = [rng.getrandbits(near_dup.MINIMA) for _ in range(5)]
    marks = [b ^ sum(1 << k for k in rng.sample(range(near_dup.MINIMA), rng.randrange(12))) for b in base for _ in range(8)] + [base[0]] * 3
    got = set(near_dup.BitTrie(marks, list(range(len(marks)))).pairs(10))
    assert got == {(i, j) for i in range(len(marks)) for j in range(i + 1, len(marks)) if (marks[i] ^ marks[j]).bit_count() <= 10}


# --- 6 --------------------------------------------------------------------------------------


def test_line_kinds():
    text = "NAM GIAO DI SU  183\nNam Giao di su, scroll 2\nThe earth shook on day 10 and fell upon garr-\nison men.\n183\nN A M   G I A O   D I   S U\n- 12 -\n第六十五葉\n[262]\n海南雜誌卷十五\n海南雜誌卷之十六"
    assert scan_repair.line_kinds(text) == ["header", "body", "body", "body", "page_no", "header", "page_no", "page_no", "page_no", "header", "body"]


def test_readings_undo_glyph_confusions():
    for read, meant in [("Tliuc", "Thuc"), ("C0mmissioner", "Commissioner"), ("v!ên", "viên"), ("qiian", "quan"), ("Nhârn", "Nhâm"), ("campcd", "camped"), ("con+re", "contre")]:
        assert scan_repair.skeleton(read) == scan_repair.skeleton(meant) and scan_repair.edits(read, meant)
    # Any number of confusions, and only confusions.
    assert scan_repair.edits("coccccccccccccccccccc", "eoeeeeeeeeeeeeeeeeeee") == 20
    assert scan_repair.edits("hour", "four") is None


def test_context_decides_between_words(spark):
    plain = ["we went home at night", "they came home at noon"] * 4 + ["visit the com site now"] * 9 + ["the green corn was eaten"]
    scans = ["we went horne at night", "the green corn was eaten"]
    rows = [(i, "a", t, "html") for i, t in enumerate(plain)] + [(900 + i, "a", t, "pdf") for i, t in enumerate(scans)]
    df = candidates(spark, rows)
    scanned = df.where("content_kind = 'pdf'")
    # Eight times as frequent is too little by itself, the words around add the rest; and they keep a rare real word.
    assert set(pairs(scan_repair.scan_faults(scanned, df))) == {(900, 1, "garble")}
    assert dict(pairs(scan_repair.repaired_text(scanned, df))) == {900: "we went home at night", 901: "the green corn was eaten"}


def test_scan_faults(spark):
    clean = [(i, "d", "the Commissioner camped his men at the fort\n黃信壽卒，上謂其人曰此使者也", "html") for i in range(40)]
    page = "SOME OLD BOOK  7\nthe C0mmissioner carnped his men at the fo-\nrt and left\n黃信壽卒，上謂其人日此使者也\n7"
    df = candidates(spark, [*clean, (90, "d", page, "pdf"), (90, "d", page, "pdf"), (91, "d", None, "pdf"), (92, "d", "", "pdf")])
    got = set(pairs(scan_repair.scan_faults(df.where("content_kind = 'pdf'"), df)))
    assert {(90, 2, "garble"), (90, 2, "hyphen"), (90, 4, "garble"), (90, 5, "page_no")} <= got
    assert (90, 3, "garble") not in got and not any(k[0] != 90 for k in got)
    mended = {r.global_id: r.text for r in scan_repair.repaired_text(df.where("content_kind = 'pdf'"), df).collect()}
    assert "the Commissioner camped his men at the fort and left" in mended[90] and mended[91] is None


def test_han_headers_by_repetition_and_title():
    text = "嶺蓮風土記巻三十九\n大旱，民饑\n— 204 —\n嶺蓮風土記券三十九\n知縣卒\n嶺蓮風土記卷之五十三\n大水\n— 205 —\n嶺蓮風士記卷三十九\n赦"
    assert [i for i, k in enumerate(scan_repair.line_kinds(text)) if k == "header"] == [0, 3, 8]
    # Without a volume: the title, or lines that are repeated beside page breaks; not those within a page.
    text = "南海會典\n知縣卒\n12\n南海會典\n學士譚朝和\n大水\n學士譚朝和\n13\n赦"
    assert [i for i, k in enumerate(scan_repair.line_kinds(text)) if k == "header"] == [0, 3]
    assert [i for i, k in enumerate(scan_repair.line_kinds("甲乙丙\n12\n南海會典\n大水", ("南海會典卷之七",))) if k == "header"] == [2]


# --- 7 --------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,starts",
    [
        ("Một. Hai ba!\nBốn", [0, 5, 13]),
        ("上謂曰：「卿當如此！」遂罷朝。又一句。", [0, 11, 15]),
        ("今按（甲乙。）其說與此異。次", [0, 13]),
        ("Theo TS. Lê (sđd., tr. 3. Xem), rộng 8.134 mẫu. Xong", [0, 48]),
        ("He said, “Go!” and left. “Stay.” Then he went.", [0, 25, 33]),
        ("Việc ấy... về sau mới biết. J. R. The et al. say so", [0, 28]),
        ("* * *\n　\n……\n  abc", [13]),
        ("", []),
    ],
)
def test_sentence_starts(text, starts):
    assert [a for a, _ in sentences.spans(text)] == starts


def test_programme_finds_the_best_spans():
    rng = random.Random(1)
    parts = ["a", "B", ". ", "! ", "etc. ", "「", "」", "。", "漢", "...", "x" * 400, " "]
    for _ in range(300):
        line = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        nodes = sentences.places(line)
        begin = sentences._NEXT_LETTER.search(line)
        first = [begin.start() if begin else len(line)] + [n[1] for n in nodes]

        def value(ends):
            cut = [0, *ends]
            return sum(sentences.length_score(nodes[j - 1][0] - first[i]) + nodes[j - 1][2] + (nodes[i - 1][3] if i else 0) for i, j in zip(cut, cut[1:]))

        n = len(nodes)
        best = max(value([i + 1 for i in range(n - 1) if mask >> i & 1] + [n]) for mask in range(1 << (n - 1)))
        chosen = sentences.boundaries(line)
        if not sentences._MARK.search(line):
            assert chosen == [len(line)]
            continue
        places = [node[0] for node in nodes]
        assert abs(value([places.index(e) + 1 for e in chosen]) - best) < 1e-6


def test_very_long_line_is_split():
    assert len(list(sentences.spans("Abc def. " * 20_000))) == 20_000


# --- 8 --------------------------------------------------------------------------------------


def test_tokens_equal_the_public_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = tokenizer.load_ranks(f"{tokenizer.VOCABULARIES}/byte_bpe_50k.tiktoken")
    public = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    letters = "漢字龍門路の𡨸é aZ0\n'sẤ🙂,。<|endoftext|>"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(80)))) for i in range(300)] + [(900, ""), (901, None), (902, "a" * 3000), (903, "龍" * 2000)]
    got = {r.doc_id: r.ids for r in tokenizer.token_ids(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i] == (public.encode_ordinary(t) if t else []) for i, t in rows)


# --- 9 --------------------------------------------------------------------------------------


def test_leaks_match_brute_force(spark):
    rng = random.Random(4)
    items = [(i, "zh" if i % 2 else "en", "".join(rng.choice("天地玄黃宇宙洪荒abcd ,。") for _ in range(200))) for i in range(6)] + [(50, "zh", None), (51, "en", "short"), (0, "en", None)]
    docs = []
    for i in range(40):
        item = rng.choice(items[:6])[2]
        a = rng.randrange(150)
        docs.append((i, "甲乙" * rng.randrange(9) + item[a : a + rng.randrange(10, 140)].replace("a", "A") + "丙"))
    docs += [(90, None), (91, ""), (0, docs[0][1])]
    expected = set()
    for d, t in docs:
        for k, lang, s in items[:6]:
            run, x, y = (20 if lang == "zh" else 80), leakage.letters(t or ""), leakage.letters(s)
            if any(y[p : p + run] in x for p in range(len(y) - run + 1)):
                expected.add((d, k))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    it = spark.createDataFrame(items[:8], "item_id bigint, lang string, text string")
    assert set(pairs(leakage.leaked_items(df, it))) == expected and expected
    # A filter that is nearly full costs time only.
    bits, leakage.LEAST_BITS, leakage.MOST_BITS = (leakage.LEAST_BITS, leakage.MOST_BITS), 64, 64
    try:
        assert set(pairs(leakage.leaked_items(df, it))) == expected
    finally:
        leakage.LEAST_BITS, leakage.MOST_BITS = bits
    assert pairs(leakage.leaked_items(df, it.limit(0))) == []


# --- 10 -------------------------------------------------------------------------------------


def test_personal_spans(spark):
    people = ["Lê Văn Thoan", "Trần Thị Quế", "Phạm Bá Sương", "Ngô Như Nhạn", "Đỗ Khả Mẫn", "Vũ Diễm Trầm"]
    rows = [(i, f"Chuyện cũ. Người đánh máy: {p}, điện thoại 010-531-68{10 + i}1. Sách đánh số đăng ký cá biệt 099491491491, phim 010-271-9995.") for i, p in enumerate(people)]
    rows += [(20, "Thư: a.b@han.example hoặc c [at] d [dot] example; ISBN 978-0-00-139139-2"), (21, None), (22, ""), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = dict(rows)
    got = [(r.doc_id, r.kind, texts[r.doc_id][r.start_pos : r.end_pos]) for r in personal.personal_spans(df).collect()]
    assert sorted(x for x in got if x[1] == "name") == sorted((i, "name", p) for i, p in enumerate(people))
    assert sum(k == "phone" for _, k, _ in got) == len(people)
    assert {x[2] for x in got if x[1] == "email"} == {"a.b@han.example", "c [at] d [dot] example"}
    red = {r.doc_id: r.text for r in personal.redacted(df).collect()}
    assert red[0].startswith("Chuyện cũ. Người đánh máy: <NAME>, điện thoại <PHONE>. Sách") and red[21] is None
    assert personal.personal_spans(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,kind,span",
    [
        ("住址：西原市直孝街六十一巷292號；", "address", "西原市直孝街六十一巷292號"),
        ("his Flat 80, 157 Caldbourne Street, Pettimerebury.", "address", "Flat 80, 157 Caldbourne Street, Pettimerebury"),
        ("au 209, rue des Chacombes, 99209 Jarchon-sur-Vire.", "address", "209, rue des Chacombes, 99209 Jarchon-sur-Vire"),
        ("ở số 94 ngõ 81 đường Gò Bưởi, quận Vẹt, Hương Lĩnh.", "address", "số 94 ngõ 81 đường Gò Bưởi, quận Vẹt, Hương Lĩnh"),
        ("電話（099）55506758。", "phone", "（099）55506758"),
        ("身分證號999247-19870709-642x，", "id_number", "999247-19870709-642x"),
    ],
)
def test_forms(text, kind, span):
    assert [(k, text[a:b]) for a, b, k in personal.Finder().entities(text)] == [(kind, span)]


# --- all ------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", list(queries.queries()))
def test_registered_query_runs(spark, data, name):
    df = queries.queries()[name](spark, data)
    assert df.columns and df.count() == df.distinct().count()


def test_composed_and_separate_accents_share_lines():
    assert site_lines.line_key(unicodedata.normalize("NFD", "Điều khoản")) == site_lines.line_key("ĐIỀU KHOẢN!")


def test_identity_numbers_behind_unlisted_words(spark):
    people = ["Adam Ashby", "Bram Birch", "Cosmo Crane", "Dora Drum", "Edith Elm"]
    texts = [f"{p} signed, passport ZZ{i}63423{i}." for i, p in enumerate(people)]
    texts += [f"Pass issued against ID ZZ{i}12345{i} to {p}." for i, p in enumerate(people)]
    # Shelf marks are varied too, but are not written like a seed.
    texts += [f"The volume marked as 90{i}88388388{i} for {p}." for i, p in enumerate(people)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(texts[r.doc_id][r.start_pos : r.end_pos], r.kind) for r in personal.personal_spans(rows).collect() if r.doc_id >= 5}
    assert got == {(f"ZZ{i}12345{i}", "id_number") for i in range(5)} | {(p, "name") for p in people}
