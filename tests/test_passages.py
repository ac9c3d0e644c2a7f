from pyspark.sql import functions as F

from placeloom.operators import lookup, passages

SF = "/root/testdata/sf0.001"


def test_sentence_spans_are_places_of_their_text(spark):
    body = "  One two. Three?!\n\nFour…\n five"
    got = spark.createDataFrame([(body,), ("",)], "t string").select(passages.sentence_spans(F.col("t")).alias("s")).collect()
    assert [(body[x.begin : x.end], x.text) for x in got[0].s] == [(t, t) for t in ("One two.", "Three?!", "Four…", "five")]
    assert got[1].s == []


def test_boundary_chunks_cover_whole_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    seen = {}
    for r in passages.boundary_chunks(docs, "doc_id", "text", 200, 50).orderBy("doc_id", "n").collect():
        at = seen.get(r.doc_id, 0)
        assert r.begin <= at < r.end <= r.begin + 200 and r.text == texts[r.doc_id][r.begin : r.end].strip()
        seen[r.doc_id] = r.end
    assert seen == {k: len(v) for k, v in texts.items() if v}


def test_chunks_always_advance(spark):
    rows = spark.createDataFrame([(1, "a b " * 100), (2, "x" * 100), (3, None)], "k long, t string")
    got = passages.boundary_chunks(rows, "k", "t", 8, 7).collect()
    assert {r.k for r in got} == {1, 2} and max(r.end for r in got if r.k == 1) == 400


def test_structure_chunks_keep_headings_code_and_tables(spark):
    body = "# A\nintro 12\n## B\n| x | y |\n| 1 | 2 |\n```\n# no heading\n```\n# C\non 2024-01-02"
    got = passages.structure_chunks(spark.createDataFrame([(1, body)], "k long, t string"), "k", "t").orderBy("n").collect()
    assert [(r.heading, r.role, r.text) for r in got] == [("A", "text", "intro 12"), ("A > B", "table", "| x | y |\n| 1 | 2 |"), ("A > B", "code", "```\n# no heading\n```"), ("C", "text", "on 2024-01-02")]
    assert got[0].numbers == ["12"] and got[3].dates == ["2024-01-02"]


def test_structure_chunks_keep_both_ends(spark):
    body = "\n".join(f"# h{i}\ntext {i}" for i in range(20))
    got = passages.structure_chunks(spark.createDataFrame([(1, body)], "k long, t string"), "k", "t", most=4).orderBy("n").collect()
    assert [r.heading for r in got] == ["h0", "h1", "h18", "h19"]


def test_expanded_queries_begin_with_the_query(spark):
    q = spark.createDataFrame([(1, "Quán phở", "Hà Nội"), (2, "bún", None), (3, "", None)], "query_id long, query string, locality string")
    s = spark.createDataFrame([("pho", "pho bo"), ("pho", "noodle")], "canon string, form string")
    got = lookup.expand_queries(q, s).orderBy("query_id", "i").collect()
    assert [(r.query_id, r.variant) for r in got] == [(1, "quan pho"), (1, "quan pho ha noi"), (1, "quan noodle ha noi"), (1, "quan pho bo ha noi"), (1, "quan noodle"), (1, "quan pho bo"), (2, "bun")]


def test_fuzzy_mentions_take_each_term_once(spark):
    q = spark.createDataFrame([(1, ["at", "hanoy", "city", "hanoi"])], "query_id long, words array<string>")
    t = spark.createDataFrame([("hanoi",), ("hanoi city",)], "term string")
    assert {(r.term, r.gram, r.edits) for r in lookup.fuzzy_mentions(q, t).collect()} == {("hanoi", "hanoi", 0), ("hanoi city", "hanoy city", 1)}


def test_queries_are_understood(spark):
    q = spark.createDataFrame([(1, "Phở Hà Nội ở Sài Gòn"), (2, "ha noy cafe"), (3, "com vs pho")], "query_id long, query string")
    names = spark.createDataFrame([("ha noi", 1), ("sai gon", 2)], "name string, unit long")
    synonyms = spark.createDataFrame([("cafe", "ca phe")], "canon string, form string")
    current = spark.createDataFrame([(2, 20)], "unit long, current long")
    got = {r.query_id: r for r in lookup.understood(q, names, synonyms, current, ["pho ha noi"]).collect()}
    assert (got[1].units, got[1].fuzzy_units) == ([20], []) and (got[2].units, got[2].fuzzy_units) == ([], [1])
    assert "ca phe" in got[2].terms and got[3].targets == ["com", "pho"] and got[3].intent == "comparison"
