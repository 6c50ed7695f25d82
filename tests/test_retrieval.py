import pytest
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import merge, pages, rerank, retrieval, store, tools
from cairn.sources import documents


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_terms(spark):
    assert one(spark, T.cjk_terms(F.lit("中国人 ABC，测试"))) == ["中国", "国人", "ABC", "测试"]
    assert one(spark, T.cjk_terms(F.lit("latency_budget 中"))) == ["latency", "budget", "中"]
    assert one(spark, retrieval.terms(F.lit("École äöü-Straße"))) == ["ecole", "aou", "straße"]
    assert one(spark, rerank.local_terms(F.lit("Ab1 中国人"))) == ["ab1", "中", "国", "人", "中国", "国人"]
    assert sorted(one(spark, T.token_set(F.lit("A the The, -- x9")))) == ["the", "the,", "x9"]


def test_texts(spark):
    assert one(spark, T.signature(F.lit(" A\u00a0\n b\u3000"))) == one(spark, T.signature(F.lit("a b"))) != ""
    assert one(spark, T.signature(F.lit(" \u3000"))) == ""
    assert one(spark, T.clean_utf8(F.lit("a\0b\ufffd"))) == "ab\ufffd"
    broken = F.unhex(F.lit("61EDA08062")).cast("string")
    assert one(spark, T.clean_utf8(broken)) == "ab"
    assert one(spark, T.regex_snippet(F.lit("aa\n  bb cc" + "x" * 300), ["(?imU)c+", "(?imU)B+"])) == "... aa bb cc" + "x" * 197 + " ..."
    assert one(spark, T.regex_snippet(F.lit("aa"), ["b"])) == "" and one(spark, T.closed_up(F.lit("中 文 and, so ( x ) 。 b"))) == "中文 and, so (x) 。b"
    assert one(spark, T.strip_think(F.lit("a<THINK>x\ny</think>b"))) == "ab"
    assert one(spark, T.head_and_tail(F.lit("x" * 300), 250)).startswith("x" * 35 + "\n\n... [output truncated: 300")
    assert one(spark, T.snippet(F.lit("aa bb cc"), F.array(F.lit("zz"), F.lit("bb")), 2)) == "... a bb c ..."
    assert one(spark, T.query_words(F.lit("Who owns, the (Review)?"))) == ["who", "owns", "the", "review"]
    md = "# T\n> q\n- item **b**\n[l](u) ![i](v) http://x.y\n| a | b |\n|---|---|\n```py\ncode\n```\n"
    assert one(spark, T.clean_passage(F.lit(md))) == "T\nq\nitem b\nl  \na, b"
    assert one(spark, T.enriched_passage(F.lit("x"), F.lit('[{"caption":"c","ocr_text":"o"}]'), F.lit('{"generated_questions":[{"question":"q1"},{"question":"q2"}]}'))) == "x\n\nc\no\nq1; q2"


def test_fusion(spark):
    hits = lambda *names: spark.createDataFrame([(1, n, 1.0, i + 1) for i, n in enumerate(names)], "query_id int, chunk_id string, score double, rank int")
    got = {r.chunk_id: (r.score, r.match_type) for r in retrieval.rrf(hits("a", "b"), hits("b", "c")).collect()}
    assert got == {"a": (pytest.approx(0.7 / 61), 0), "b": (pytest.approx(0.7 / 62 + 0.3 / 61), 0), "c": (pytest.approx(0.3 / 62), 1)}
    alone = {r.chunk_id: r.score for r in retrieval.fuse_or_dedup(hits("a", "b").limit(0), hits("b", "c")).collect()}
    assert alone == {"b": 1.0, "c": 1.0}
    rows = spark.createDataFrame([("a", 0.2, 0), ("b", 0.8, 1), ("a", 0.9, 2)], "chunk_id string, score double, ordinal int")
    assert {r.chunk_id: r.score for r in retrieval.dedup_by_max(rows, ["chunk_id"]).collect()} == {"a": 0.9, "b": 0.8}
    assert [retrieval.overfetch(*x) for x in ((5, 1), (20, 2), (200, 3))] == [50, 200, 500]


def test_filters(spark):
    rows = spark.createDataFrame([(1, "a", True), (2, None, None), (3, "b", False)], "chunk_id int, knowledge_id string, is_enabled boolean")
    assert [r.chunk_id for r in retrieval.enabled(rows).collect()] == [1, 2]
    assert [r.chunk_id for r in retrieval.scoped(rows, not_knowledge=["b"]).collect()] == [1]
    assert retrieval.scoped(rows).count() == 3
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "i int, v array<float>")
    assert [r.x for r in zero.orderBy("i").select(retrieval.cosine(F.col("v"), F.array(F.lit(3.0), F.lit(4.0))).alias("x")).collect()] == [None, 1.0]


def test_rerank(spark):
    assert one(spark, rerank.composite(F.lit(0.8), F.lit(0.5), F.lit(0), F.lit(99))) == pytest.approx((0.56 + 0.15) * 1.05)
    sets = [{"alpha", "beta"}, {"alpha", "beta"}, {"gamma", "delta"}]
    assert rerank.mmr_order(sets, [0.9, 0.89, 0.8], 2) == [0, 2] and rerank.mmr_order(sets, [0.9, 0.89, 0.8], 9, swap=True) == [0, 2, 1]
    ranked = spark.createDataFrame([("a", 0, 0.1, 0), ("b", 0, 0.6, 0), ("c", 0, 0.2, 0), ("c", 1, 0.3, 0)], "query_id string, ordinal int, model_score double, doc int")
    assert sorted((r.query_id, r.ordinal) for r in rerank.over_or_best(ranked, 0.8).collect()) == [("b", 0), ("c", 0)]
    assert one(spark, rerank.lexical_score(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a")))) == pytest.approx(0.85 / 2 + 0.15)


def test_merging(spark):
    assert merge.append_overlap("abcdefghijklmnopqrstuvwxyz", "opqrstuvwxyz123", 12) == "abcdefghijklmnopqrstuvwxyz123"
    assert merge.join_ends("abcab", "cabx") == "abcabx" and merge.join_ends("ab", "cd") == "abcd" and merge.join_ends("", "x") == "x"
    assert merge.grow(["A" * 180], "B" * 40, ["C" * 180]) == ("A" * 180 + "B" * 40 + "C" * 180, 180)
    assert merge.grow(["A" * 900], "B" * 40, [])[0] == "A" * 850 and merge.grow([], "", ["x"]) == ("", 0)
    rows = spark.createDataFrame([(1, "a", "x", 0), (1, "b", "x", 1), (1, "b", "y", 2)], "query_id int, chunk_id string, content string, ordinal int")
    assert sorted((r.chunk_id, r.content) for r in merge.dedup_sequential(rows).collect()) == [("a", "x"), ("b", "y")]
    over = spark.createDataFrame([(1, "a", "one two three four", 0.5, 0), (1, "b", "two three", 0.5, 1), (1, "c", "zzz yyy", 0.1, 2)], "query_id int, chunk_id string, content string, score double, ordinal int")
    assert sorted(r.chunk_id for r in merge.drop_partial_overlaps(over).collect()) == ["a", "c"]
    spans = spark.createDataFrame([("q", "k", "text", "a", 0, 26, "abcdefghijklmnopqrstuvwxyz", 0.3, 0), ("q", "k", "text", "b", 14, 29, "opqrstuvwxyz123", 0.8, 1)], "query_id string, knowledge_id string, chunk_type string, chunk_id string, start_at int, end_at int, content string, score double, ordinal int")
    r = merge.merge_overlaps(spans).first()
    assert (r.content, r.score, r.end_at, r.sub_chunk_ids) == ("abcdefghijklmnopqrstuvwxyz123", 0.8, 29, ["b"])
    assert one(spark, merge.faq_answer(F.lit('{"standard_question":"Q1","answers":["a","b"]}'))) == "Q: Q1\nAnswer:\n- a\n- b"


def test_links_and_sequence(spark):
    rows = spark.createDataFrame([("d", "p0", "parent_text", 0), ("d", "c0", "text", 0), ("d", "c1", "text", 1), ("d", "p1", "parent_text", 1), ("e", "x", "text", 0), ("e", "y", "text", 1)], "knowledge_id string, chunk_id string, chunk_type string, chunk_index int")
    got = {r.chunk_id: (r.pre_chunk_id, r.next_chunk_id) for r in store.with_links(rows).collect()}
    assert got == {"p0": (None, "p1"), "p1": ("p0", None), "c0": (None, None), "c1": (None, None), "x": (None, "y"), "y": ("x", None)}
    assert [r.chunk_id for r in store.with_seq(rows, 7, ["knowledge_id"]).orderBy("seq_id").collect()] == ["p0", "c0", "p1", "c1", "x", "y"]
    assert {r.seq_id for r in store.with_seq(rows, 7, ["knowledge_id"]).collect()} == set(range(8, 14))


def test_versions(spark, tmp_path):
    at = str(tmp_path / "t")
    assert documents.current_table(spark, at) is None
    for i in range(3):
        documents.replace_table(spark.range(i + 1), at)
        assert documents.current_table(spark, at).count() == i + 1
    spark.range(9).write.parquet(f"{at}/v3")  # a run that broke off before its pointer
    assert documents.current_table(spark, at).count() == 3
    documents.replace_table(documents.current_table(spark, at).where("id > 0"), at)
    assert documents.current_table(spark, at).count() == 2


def test_whole_corpus_scores_equal_the_index(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 11}" for j in range(1, 3 + i % 9)) if i % 6 else None) for i in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w1 w2 w2 zz"), (2, "w7"), (3, "none"), (4, None)], "query_id int, query string")
    index = retrieval.bm25(asked, retrieval.postings(docs, "doc_id", "text"), retrieval.lengths(docs, "doc_id", "text")).withColumn("score", F.round("score", 2))
    want = sorted((r.query_id, r.rank, r.row_id, r.score) for r in retrieval.top(index, 7).collect())
    got = sorted((r.query_id, r.rank, r.row_id, r.score) for r in retrieval.bm25_top(asked, docs, "doc_id", "text", 7).collect())
    assert got == want and len(got) == 14
    kept = retrieval.bm25_top(asked, docs, "doc_id", "text", 7, F.col("doc_id") % 2 == 1).collect()
    assert {r.row_id % 2 for r in kept} == {1} and retrieval.bm25_top(asked, docs.limit(0), "doc_id", "text", 7).count() == 0


def test_scope(spark):
    rows = spark.createDataFrame([(1, "k1", "d"), (2, "k1", "d"), (1, "k2", "d")], "tenant_id int, kb_id string, knowledge_id string")
    scope = spark.createDataFrame([(1, "k1", None), (1, "k2", "other")], "tenant_id int, kb_id string, knowledge_id string")
    assert [(r.tenant_id, r.kb_id) for r in tools.in_scope(rows, scope).collect()] == [(1, "k1")]
    for bad in ("(", "(?P<a>b)", "x{2,1}"):  # what the executors' engine refuses, though others may take it
        with pytest.raises(ValueError, match="invalid pattern"):
            tools.checked(bad)


def test_layout(spark):
    glyphs = spark.createDataFrame([(1, "a", 0.0, 0.0, 5.0, 10.0), (1, "b", 5.0, 0.0, 10.0, 10.0), (1, "c", 20.0, 1.0, 25.0, 11.0), (1, "d", 0.0, 30.0, 5.0, 40.0)], "page int, ch string, x0 double, y0 double, x1 double, y1 double")
    assert [r.line for r in pages.lines_of(glyphs, ["page"]).orderBy("line_no").collect()] == ["ab c", "d"]


def test_sources(spark, tmp_path):
    assert documents.decode("中文".encode("gb18030")) == "中文" and documents.decode("é".encode()) == "é"
    assert documents.table_lines("| a |b|\n|x|y|\nend") == "| a | b |\n| --- | --- |\n| x | y |\nend"
    assert documents.table_html([["a", "a", "b"]]) == "<table><tr><td colspan='2'>a</td><td>b</td></tr></table>"
    import zipfile

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "b.md").write_text("# x\n![p](data:image/png;base64,QUFB)\n![q](data:image/png;base64,@@)")
    (tmp_path / "c.docx").write_bytes(b"no zip")
    (tmp_path / "d.bin").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in documents.parsed(documents.files(spark, str(tmp_path))).collect()}
    assert got == {"a.docx": "One\n\nTwo\n\n<table><tr><td>c</td></tr></table>", "b.md": "# x\n![p](images/e1faffb3e614e6c2fba74296962386b7.png)\nq", "c.docx": "", "d.bin": ""}
    assert documents.docx_simple((tmp_path / "a.docx").read_bytes()) == "One\n\nTwo\n\nc"
    (tmp_path / "h.jsonl").write_text('{"conv_id":"a","turn":1,"role":"user","content":"x"}\nbroken\n')
    assert [r.content for r in documents.history(spark, str(tmp_path / "h.jsonl")).collect()] == ["x"]
