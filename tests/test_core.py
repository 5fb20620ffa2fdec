"""Operators of the core against sequential and brute-force versions, and every query against its SQL."""

import glob
import os
import random

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hanloom.functions import html
from hanloom.functions import text as T
from hanloom.functions import url as U
from hanloom.functions import vector as V
from hanloom.operators import align, dedup, keywords, pages, segments
from hanloom.plans import catalogue
from hanloom.plans.iterate import first_independent, locally_dominant
from hanloom.plans.pipeline import AlignConfig, CleanConfig, Pipeline
from hanloom.sources import sinks, tables
from hanloom.streaming import ingest


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_text_functions(spark):
    assert one(spark, T.count_of(F.col("t"), T.HAN), t="一𠀁a") == 2
    assert one(spark, T.clean_for_export(F.col("t")), t="◄ prev\n 編輯 \n| 8 | text [1] |\n\n\n「a」  b​") == "text\na b"
    assert one(spark, T.clean_for_keywords(F.col("t")), t="Một [ghi chú] hai\nba .. bốn,năm") == "Một hai. ba. bốn, năm"
    assert one(spark, T.sentences(F.col("t"), F.lit(True)), t="甲。乙！」丙\n……\n") == ["甲。", "乙！", "丙"]
    assert one(spark, T.windows(F.col("a"), 3, 1), a=["a", "b", "c", "d", "e"]) == ["a b c", "c d e"]
    assert one(spark, T.windows(F.array().cast("array<string>"), 3, 1)) == []
    assert one(spark, T.ngrams(F.col("t"), 3), t="abcabc") == ["abc", "bca", "cab"]
    assert one(spark, T.ngrams(F.col("t"), 3), t="ab") == ["ab"] and one(spark, T.ngrams(F.col("t"), 3), t="") == []
    assert one(spark, T.safe_filename(F.col("t")), t=' a:b?"c .') == "a_b_c"


@pytest.mark.parametrize(
    "raw,clean",
    [
        ("HTTP://Ex.ORG/a/?utm_source=x&b=1&fbclid=2#top", "http://ex.org/a?b=1"),
        ("ex.org/a//", "https://ex.org/a"),
        ("https://ex.org", "https://ex.org"),
        ("", ""),
    ],
)
def test_canonical_url(spark, raw, clean):
    assert one(spark, U.canonical(F.col("u")), u=raw) == clean


def test_html():
    title, text = html.read_html("<html><head><title> A\n b</title><style>x</style></head><body><h1>H</h1><p>one&nbsp;&amp; two<br>three</p><script>no</script></body>")
    assert text == "H\none & two\nthree" and title in ("A b", "H")
    assert html.read_html(None) == (None, None) and html.read_html("") == ("", "")


def test_vectors(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, V.dot(a, b), a=[1.0, 2.0], b=[3.0, 4.0]) == 11
    assert one(spark, V.normalised(a), a=[3.0, 4.0], b=[0.0]) == [0.6, 0.8]
    assert one(spark, V.cosine(a, b), a=[0.0], b=[0.0]) == 0


def greedy_matching(edges):
    used, out = (set(), set()), []
    for s, d, w in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if s not in used[0] and d not in used[1]:
            used[0].add(s), used[1].add(d)
            out.append((s, d))
    return sorted(out)


quick = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@quick
@given(st.dictionaries(st.tuples(st.integers(0, 5), st.integers(0, 5)), st.integers(0, 4), max_size=18))
def test_matching_equals_the_sequential_rule(spark, edges):
    rows = [(s, d, float(w)) for (s, d), w in edges.items()]
    df = spark.createDataFrame(rows, "src int, dst int, margin double")
    assert sorted((r.src, r.dst) for r in locally_dominant(df, "src", "dst", "margin").collect()) == greedy_matching(rows)


@quick
@given(st.sets(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=16))
def test_greedy_choice_equals_the_sequential_rule(spark, links):
    links = sorted({(a, b) for a, b in links if a < b})
    keeper: dict = {}
    for n in range(8):
        above = [a for a, b in links if b == n and keeper.get(a, 0) is None]
        keeper[n] = min(above) if above else None
    nodes = spark.createDataFrame([(n, n) for n in range(8)], "node int, rank int")
    got = {r.node: r.keeper for r in first_independent(nodes, spark.createDataFrame(links, "better int, worse int")).collect()}
    assert got == keeper


def test_knn_in_blocks(spark):
    rng = random.Random(1)
    rows = [(i % 4, i, [rng.random() for _ in range(5)]) for i in range(40)]
    q, t = (spark.createDataFrame([r for r in rows if r[1] % 2 == p], "doc int, chunk int, vec array<double>") for p in (0, 1))
    expected = set()
    for d, c, v in rows:
        if c % 2 == 0:
            sims = sorted(((-sum(x * y for x, y in zip(v, w)), e, k) for e, k, w in rows if k % 2), key=lambda s: s)[:3]
            expected |= {(d, c, e, k) for _, e, k in sims}
    block, align.BLOCK = align.BLOCK, 7
    try:
        got = {(r.src, r.src_chunk, r.dst, r.dst_chunk) for r in align.knn(q, t, 3).collect()}
    finally:
        align.BLOCK = block
    assert got == expected
    assert align.knn(q.limit(0), t, 3).count() == 0 and align.knn(q, t.limit(0), 3).count() == 0


def test_near_dedup_keeps_the_best(spark):
    rows = [(1, "d", 0.5, 0.9, 9, 9, "甲乙丙丁戊己庚辛"), (2, "d", 0.9, 0.9, 9, 9, "甲乙丙丁戊己庚辛"), (3, "d", 0.1, 0.9, 9, 9, "全然別的一些文字"), (4, "d", 0.2, 0.9, 9, 9, "")]
    df = spark.createDataFrame(rows, "global_id bigint, domain string, traditional_score double, han_ratio double, han_chars int, text_len int, sig string")
    got = {r.node: r.keeper for r in dedup.near(df, "global_id", F.col("sig"), 3, 0.8, dedup.quality_order(True)).collect()}
    assert got == {1: 2, 2: None, 3: None, 4: None}


def test_vertical_text(spark):
    tall, flat = "\n".join("一二三四五" * 8), "\n".join(["一行文字甚長" * 3] * 40)
    for text, expected in [(tall, True), (flat, False), ("", False), (None, None)]:
        assert one(spark, pages.is_vertical(pages.vertical_stats(F.lit(text).cast("string")))) in (expected, False if not expected else True)


def test_keyword_diversity(spark):
    rows = [("a", w, s) for w, s in [("trần hưng", 1.0), ("trần hưng đạo", 0.99), ("sông bạch", 0.9), ("núi", 0.2)]]
    got = {r.word for r in keywords.mmr(spark.createDataFrame(rows, "k string, word string, score double"), "k", top=2, diversity=0.7).collect()}
    assert got == {"trần hưng", "sông bạch"} or "trần hưng" in got and len(got) == 2


def test_segments(spark):
    text = "a b c. " * 400
    parts = segments.split_text(text, 100, 10)
    assert all(len(p) <= 100 for p in parts) and segments.split_text("x" * 250, 100, 0) == ["x" * 100, "x" * 100, "x" * 50]
    assert segments.entity_spans(["Vua", "Trần", "Hưng_Đạo", "đi"], [("Trần Hưng Đạo", "PER")]) == [(1, 3, "Trần Hưng_Đạo", "PER")]
    assert segments.merge_spans([("a", "N"), ("b", "N")], [(0, 2, "a b", "X")]) == [("a_b", "Np")]
    assert segments.merge_pieces([("Ha", "LOC", 0.9, 0, 2), ("##noi", "LOC", 0.7, 2, 5)]) == [("Hanoi", "LOC", 0.7)]
    vec = segments.encoded(spark.createDataFrame([("abc",), (None,)], "text string")).collect()
    assert len(vec[0].vec) == 64


def test_pipeline_end_to_end(spark, data):
    run = Pipeline(CleanConfig(min_len=100, min_han=50, near=True), align=AlignConfig(threshold=-9.0, mode="1-1"))
    kept = run.candidates(spark.read.parquet(f"{data}/pages.parquet"))
    assert kept.count() == kept.select("content_hash").distinct().count() > 0
    vectors = run.segments(kept.limit(12), "global_id").persist()
    matched = run.alignment(vectors, vectors).collect()
    assert all(r.src == r.dst for r in matched) and len(matched) == 12


def test_files(spark, tmp_path):
    folder = tmp_path / "corpus"
    folder.mkdir()
    (folder / "b.txt").write_bytes("乙\n".encode() + b"\xff")
    (folder / "a.txt").write_text("甲", encoding="utf-8")
    got = {r.file_name: (r.doc_idx, r.text) for r in tables.numbered(tables.corpus(spark, str(folder))).collect()}
    assert got == {"a.txt": (0, "甲"), "b.txt": (1, "乙\n�")}
    (tmp_path / "g.tsv").write_text("a.txt\tb.txt\n\nshort\na.txt\tb.txt\n", encoding="utf-8")
    assert [tuple(r) for r in tables.pairs(spark, str(tmp_path / "g.tsv")).collect()] == [("a.txt", "b.txt")]
    (tmp_path / "c.json").write_text('{"a": "甲", "b": ""}', encoding="utf-8")
    assert tables.translations(spark, str(tmp_path / "c.json")).count() == 2
    (tmp_path / "p.json").write_text('{"doc_id": "d", "pages": [{"url": "u", "status": "ok", "text": "t"}]}', encoding="utf-8")
    assert tables.page_rows(tables.documents(spark, str(tmp_path / "p.json"), tables.PAGES)).first().page_id == "0001"
    sinks.alignment(spark.createDataFrame([("x/a", "y/b", 0.5)], "src string, tgt string, score double"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).first().asDict() == {"src_idx": "a", "tar_idx": "b", "score": "0.5000"}


def test_stream_drops_repeated_rows(spark, data, tmp_path):
    source = spark.read.parquet(f"{data}/pages.parquet").select("doc_id", "page_id", "text", "loaded_at").where("loaded_at is not null")
    source.unionByName(source).write.parquet(str(tmp_path / "in"))
    stream = ingest.new_pages(spark, str(tmp_path / "in"), source.schema)
    query = stream.writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("fresh").count() == source.select("doc_id", "page_id", "text").distinct().count()
    assert ingest.only_missing(source, source, ["doc_id", "page_id"]).count() == 0


# --- every query against its SQL -------------------------------------------------------------


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(frame):
    def cell(v):
        if v is None or isinstance(v, float) and v != v:
            return "-"
        return f"{v:.5g}" if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, data, oracle, name):
    frame = catalogue.queries()[name](spark, data).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is not None:
        assert canonical(frame) == canonical(oracle.sql(sql).df())


def test_keyword_candidates_edge_rules(spark):
    rows = spark.createDataFrame([("d", 0, "Vua và quan của triều")], "k string, c int, line string")
    stops = spark.createDataFrame([("và",), ("của",)], "word string")

    def got(**rules):
        return {r.word for r in keywords.candidates(rows, "k", "c", F.col("line"), 3, **rules).collect()}

    # A stop word may stand within a candidate, not at its edge.
    assert got(stops=stops) == {"vua", "quan", "triều", "vua và quan", "quan của triều"}
    assert got(tag=lambda w: F.transform(w, lambda x: F.when(x == "quan", "E").otherwise("N"))) == {"vua", "và", "của", "triều", "vua và", "của triều", "và quan của"}
    assert got(tag=lambda w: F.transform(w, lambda x: F.when(x == "quan", "X").otherwise("N"))) == {"vua", "và", "của", "triều", "vua và", "của triều"}
    assert got(tag=keywords.rule_tags) == got()


def test_sizes_and_names(spark):
    assert [T.size_in_bytes(x) for x in ("500000", "2KB", "1.5G", "3 mb", " ", None)] == [500000, 2048, 1610612736, 3145728, None, None]
    with pytest.raises(ValueError):
        T.size_in_bytes("many")
    assert one(spark, T.unit_form(F.col("t")), t=" a  b　c ") == "a_b_c"
    assert one(spark, T.without_site(F.col("t")), t="國史 - Wikisource, the library") == "國史"


def test_exact_removal_keeps_rows_without_a_hash_apart(spark):
    rows = [(1, "d", "x", 0.5, 0.9, 10, 20), (2, "d", "x", 0.5, 0.9, 10, 20), (3, "d", "x", 0.9, 0.1, 1, 2), (4, "d", None, 0.1, 0.1, 1, 1), (5, "d", None, 0.1, 0.1, 1, 1), (3, "d", "x", 0.9, 0.1, 1, 2)]
    df = spark.createDataFrame(rows, "global_id long, domain string, content_hash string, traditional_score double, han_ratio double, han_chars int, text_len int")
    assert sorted(tuple(r) for r in dedup.exact(df).collect()) == [(1, 3), (2, 3), (3, 3), (4, 4), (5, 5)]
    assert dedup.exact(df.limit(0)).count() == 0


@pytest.mark.parametrize("metric,scope", [("jaccard", None), ("containment", None), ("asymmetric", None), ("jaccard", "doc_id")])
def test_near_removal_equals_the_sequential_rule(spark, metric, scope):
    rng = random.Random(5)
    bases = ["".join(rng.choice("天地玄黃宇宙洪荒日月盈昃辰宿列張") for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(40):
        text = rng.choice(bases)
        if rng.random() < 0.6:
            a = rng.randrange(40)
            text = text[:a] + rng.choice("寒來暑往") + text[a + rng.randrange(12) :]
        rows.append((i, f"d{i % 2}", text, float(rng.randrange(3))))
    rows += [(40, "d0", None, 0.0), (41, "d0", "", 0.0), rows[3]]
    least = 0.8
    grams = {i: {t[k : k + 3] for k in range(max(1, len(t) - 2))} if t else set() for i, _, t, _ in rows}
    kept, expected = [], {}
    for i, doc, t, q in sorted(set(rows), key=lambda r: (-r[3], r[0])):
        keeper = None
        for k, kdoc in kept:
            a, b = grams[k], grams[i]
            if not a or not b or scope and doc != kdoc:
                continue
            m = len(a & b)
            shares = (m / len(b), m / len(a))
            like = {"jaccard": m / (len(a) + len(b) - m) >= least, "containment": m / min(len(a), len(b)) >= least, "asymmetric": shares[0] >= least or min(shares) >= 0.9 * least}[metric]
            if like:
                keeper = k
                break
        expected[i] = keeper
        if keeper is None:
            kept.append((i, doc))
    df = spark.createDataFrame(rows, "global_id long, doc_id string, text string, q double")
    got = {r.node: r.keeper for r in dedup.near(df, "global_id", F.col("text"), 3, least, [F.desc("q"), F.asc("global_id")], metric, scope).collect()}
    assert got == expected and any(v is not None for v in expected.values())


def test_fetching_with_retries():
    from hanloom.sources import connectors as C

    waits, answers = [], iter([C.Unreachable("lost"), {"http_status": 429}, {"http_status": 503}, {"http_status": 404, "final_url": "u", "content_type": "t", "body": b"x"}])

    def call(url):
        answer = next(answers)
        if isinstance(answer, Exception):
            raise answer
        return answer

    page = C.fetch_once(call, "u", sleep=waits.append)
    # Powers 0, 1 + 2 and 2; a 404 is a page by its status.
    assert waits == [1.0, 8.0, 4.0] and page["status"] == "ok" and page["http_status"] == 404

    def broken(url):
        raise KeyError("no")

    assert C.fetch_once(broken, "u", sleep=waits.append)["status"] == "error" and len(waits) == 3
    failed = C.fetch_once(lambda url: {"http_status": 500}, "u", retries=2, sleep=waits.append)
    assert failed["error"] == "HTTP 500" and len(waits) == 5


def test_connectors_ask_once(spark):
    from hanloom.sources import connectors as C

    def fetcher():
        return lambda url: {"http_status": 200, "final_url": url, "content_type": "text/plain", "body": url.encode()}

    urls = spark.createDataFrame([("d", "a"), ("e", "a"), ("e", "b"), ("e", None)], "doc_id string, url string")
    got = sorted((r.doc_id, r.url or "", r.status or "") for r in C.fetched(urls, fetcher, tasks=2, delay=(0, 0)).collect())
    assert got == [("d", "a", "ok"), ("e", "", ""), ("e", "a", "ok"), ("e", "b", "ok")]

    def engine():
        def search(query, wanted, **options):
            if query == "bad":
                raise RuntimeError("down")
            return [{"link": f"{query}{i}", "title": str(options.get("filter"))} for i in range(wanted)]

        return search

    queries = spark.createDataFrame([("d", "q0", "x", 2), ("e", "q1", "x", 2), ("e", "q2", "bad", 1), ("e", "q3", " ", 1)], "doc_id string, query_id string, query string, num_results int")
    found = C.searched(queries, engine, **C.search_options(omitted=True)).collect()
    assert sorted((r.doc_id, r.query_id, r.rank or 0, r.url, r.error) for r in found) == [("d", "q0", 1, "x0", ""), ("d", "q0", 2, "x1", ""), ("e", "q1", 1, "x0", ""), ("e", "q1", 2, "x1", ""), ("e", "q2", 0, "", "down")]
    assert C.search_options("vn") == {"gl": "vn"}


def test_translation_with_a_table(spark):
    from hanloom.sources import connectors as C

    def service():
        return lambda terms: {t: t.upper() for t in terms if t != "none"}

    terms = spark.createDataFrame([("An_Nam",), ("an nam",), ("empty",), ("new  word",), ("none",)], "term string")
    known = spark.createDataFrame([("an nam", "安南"), ("empty", "")], "src_norm string, tgt string")
    made, table = C.translated_terms(terms, known, service, batch=1, rest=0)
    assert sorted(tuple(r) for r in made.collect()) == [("An_Nam", "安南"), ("an nam", "安南"), ("empty", ""), ("new  word", "NEW WORD"), ("none", "")]
    assert {r.src_norm for r in table.collect()} == {"an nam", "empty", "new word"}
    waits = []

    def down(terms):
        raise OSError

    assert C.call_with_retry(down, ["a"], sleep=waits.append) == {} and waits == [1, 2]


def test_files_are_numbered_and_vectors_read_by_index(spark, tmp_path):
    files = spark.createDataFrame([(f"f{i:03d}",) for i in range(50)], "file_name string").repartition(7)
    index = tables.numbered(files)
    assert sorted((r.file_name, r.doc_idx) for r in index.collect()) == [(f"f{i:03d}", i) for i in range(50)]
    assert tables.lookup(index, 7) == "f007" and tables.lookup(index, 99) is None
    rows = spark.createDataFrame([(0, 0, [1.0]), (0, 1, [2.0]), (2, 0, [3.0])], "doc_idx bigint, chunk int, vec array<double>")
    names = index.where("doc_idx < 3").select("doc_idx", F.col("file_name").alias("file_path"))
    sinks.vectors(rows, str(tmp_path / "v"), names, {"mode": "x"})
    assert {(r.doc_idx, r.n_chunks) for r in tables.metadata(spark, str(tmp_path / "v/metadata")).collect()} == {(0, 2), (1, 0), (2, 1)}
    wanted = spark.createDataFrame([(2,), (9,)], "doc_idx bigint")
    assert [r.vec for r in tables.vectors(spark, str(tmp_path / "v/vectors"), wanted).collect()] == [[3.0]]


def test_query_planning(spark):
    ranked = spark.createDataFrame([("d", "a", 0, 1), ("d", "b", 2, 2), ("d", "c", 1, 3), ("e", "x", 0, 1), ("e", "y", 0, 2)], "doc string, term string, support int, place int")
    chosen = lambda **k: sorted((r.doc, r.place, r.term) for r in keywords.select_terms(ranked, "doc", 3, **k).collect())
    assert chosen() == [("d", 1, "b"), ("d", 2, "c"), ("e", 1, "x"), ("e", 2, "y")]
    assert chosen(fill=True) == [("d", 1, "b"), ("d", 2, "c"), ("d", 3, "a"), ("e", 1, "x"), ("e", 2, "y")]
    tagged = ranked.withColumn("tag", F.when(F.col("term") == "c", "N Np").otherwise("N"))
    assert sorted((r.place, r.term, r.is_exact) for r in keywords.exact_and_loose(tagged, "doc", 1).where("doc = 'd'").collect()) == [(1, "c", True), (2, "b", False), (3, "a", False)]
    counts = spark.createDataFrame([("d", 10), ("e", 1)], "doc string, chunks bigint")
    assert sorted(tuple(r) for r in keywords.local_ranges(counts, "doc").collect()) == [("d", 0, 0, 1), ("d", 1, 2, 4), ("d", 2, 5, 6), ("d", 3, 7, 9), ("e", 0, 0, 0)]
    asked = spark.createDataFrame([("wikisource_bot",), ("semantic",), (None,)], "rerank_source string")
    assert [r.num_results for r in keywords.wanted_results(asked, 10, 4).collect()] == [10, 4, 4]
    words = spark.createDataFrame([("d", "p", [1.0, 0.0]), ("d", "q", [1.0, 1.0])], "doc string, word string, vec array<double>")
    docs = spark.createDataFrame([("d", [0.0, 1.0])], "doc string, vec array<double>")
    assert [r.word for r in keywords.rank_by_vector(words, docs, "doc", 1).collect()] == ["q"]


def test_checkpoints_need_a_shared_folder():
    from types import SimpleNamespace

    from hanloom import session as S

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=lambda d: None)
    df = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d)))
    with pytest.raises(ValueError):
        S.cut_lineage(df)


def most_rows(node):
    """The most rows that any step of an executed plan gave."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return most_rows(node.executedPlan())
    if name.endswith("QueryStage"):
        return most_rows(node.plan())
    metric = node.metrics().get("numOutputRows")
    own = metric.get().value() if metric.isDefined() else 0
    children = node.children()
    return max([own, *(most_rows(children.apply(i)) for i in range(children.size()))])


def test_common_terms_of_many_groups_are_counted_once(spark):
    # Each group asks for the same terms, and each document holds them: groups times documents must not meet.
    terms = spark.createDataFrame([(f"g{i}", t) for i in range(300) for t in ("a", "b", "c", "none")], "file_name string, term string")
    corpus = spark.createDataFrame([(f"d{i}", t) for i in range(300) for t in ("a", "b") + ("c",) * (i % 3 == 0)] + [("d0", "a"), (None, "a"), (None, "b")], "doc_id string, term string")
    hits = keywords.pair_hits(terms, corpus, "file_name")
    got = {tuple(r) for r in hits.collect()}
    assert got == {(f"g{i}", a, b, n) for i in range(300) for a, b, n in [("a", "b", 300), ("a", "c", 100), ("b", "c", 100), ("a", "none", 0), ("b", "none", 0), ("c", "none", 0)]}
    assert most_rows(hits._jdf.queryExecution().executedPlan()) < 20_000


def texts_with_a_common_part(count=300):
    """Texts of 60 letters of their own and 30 common ones; every tenth is a near copy of the one before it, in the same document."""
    rng, letters = random.Random(3), [chr(0x4E00 + i) for i in range(4000)]
    common, rows = "".join(letters[:30]), []
    for i in range(count):
        text = rows[-1][2][:-1] + "末" if i % 10 == 9 else "".join(rng.choice(letters[30:]) for _ in range(60)) + common
        rows.append((i, f"d{(i - (i % 10 == 9)) % 7}", text))
    return rows


@pytest.mark.parametrize("metric,least,scope", [("jaccard", 0.85, None), ("containment", 0.9, None), ("containment", 0.855, None), ("jaccard", 0.5, "doc_id")])
def test_runs_of_texts_do_not_meet_one_by_one(spark, metric, least, scope):
    rows = texts_with_a_common_part()
    pairs = dedup.similar_pairs(spark.createDataFrame(rows, "k bigint, doc_id string, t string"), "k", F.col("t"), 3, least, metric, scope)
    grams = [{t[i : i + 3] for i in range(len(t) - 2)} for _, _, t in rows]
    expected = set()
    for a, x in enumerate(grams):
        for b in range(a + 1, len(grams)):
            m = len(x & grams[b])
            score = m / (len(x) + len(grams[b]) - m) if metric == "jaccard" else m / min(len(x), len(grams[b]))
            if score >= least - 1e-9 and (scope is None or rows[a][1] == rows[b][1]):
                expected.add((a, b, m, len(x), len(grams[b])))
    assert {(r.a, r.b, r.common, r.size_a, r.size_b) for r in pairs.collect()} == expected and len(expected) == 30
    # 26,400 runs; what is joined is a small part of them.
    assert most_rows(pairs._jdf.queryExecution().executedPlan()) < 13_000
