"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cairn.llm import archive, covertree, decontaminate, langid, licences, maintext, packing, simhash, similar, tokenfile, urls
from cairn.llm.common import new_path

LONG = "lorem ipsum dolor sit amet " * 12_000
CLASH = "doc_id long, text string, lang string, source string, n_chars long, fp long, key long, component_id long, lang_pred string, score double, _kept long, n int, part long"
BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 0, 1, 2, 3, "x", 0.5, 9, 4, 7) for i, t, g in rows], CLASH)


ROWS = [(1, "the quick brown fox jumps over the lazy dog near the river bank", "en"), (2, None, "en"), (3, "", None), (4, LONG, "la"), (5, LONG, "la"), (None, "the quick brown fox jumps", None), (1, "the quick brown fox jumps over the lazy dog near the river bank", "en"), (7, " \n\t ", "en"), (8, "12345 !!!", "de")]


@pytest.fixture(params=["some", "none"])
def table(spark, request):
    return docs(spark, ROWS if request.param == "some" else [])


def test_simhash(spark, table):
    got = simhash.near_duplicates(table).collect()
    n = table.count()
    assert len(got) == n
    if n:
        by = {}
        for r in got:
            by.setdefault(r.doc_id, set()).add((r.fp, r.component_id))
        assert by[2] == by[3] | {(0, 2)} == {(0, 2)} and by[7] == {(0, 2)} and by[5] == {(next(iter(by[4]))[0], 4)} and len(by[1]) == 1
    kept = simhash.dedup(table)
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == (["1", "2", "4", "8", "None"] if n else [])


def test_similar(spark, table):
    kept = similar.dedup(table)
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == (["1", "2", "4", "8", "None"] if table.count() else [])


@pytest.mark.parametrize("by", [simhash, similar])
@pytest.mark.parametrize("repeat", [False, True])
def test_rows_not_ids_are_kept(spark, by, repeat):
    """Unlike texts under null ids or one id all stay; of like ones one row."""
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdefghijk") for _ in range(6)) for _ in range(60)) for _ in range(9)]
    rows = [*[(None, t, "en") for t in texts[:5]], *[(7, t, "en") for t in texts[5:7]], (8, texts[7], "en"), (9, texts[7], "de"), (None, texts[8], "en"), (3, texts[8], "en")]
    kept = by.dedup(docs(spark, rows + rows[:6] * repeat))
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([*[("None", t) for t in texts[:5]], *[("7", t) for t in texts[5:7]], ("8", texts[7]), ("3", texts[8])])


def test_a_text_digest_decides_ties(spark):
    """Near copies under one id: one row stays, and the same one whatever the order of the rows."""
    words = [f"w{i}" for i in range(300)]
    rows = [(4, " ".join(words[:299] + [f"x{i}"]), "en") for i in range(4)]
    got = {similar.dedup(docs(spark, r)).collect()[0].text for r in (rows, rows[::-1], rows[2:] + rows[:2])}
    assert len(got) == 1 and similar.dedup(docs(spark, rows)).count() == 1


def test_packing(spark, table):
    path = public_tokenizers.path(BYTE)
    tokens = packing.tokenised(table, path, 1)
    pieces = packing.packed(tokens, 64).collect()
    assert {r.n for r in tokens.collect()} >= ({1} if table.count() else set())
    total = sum(r.length for r in pieces)
    assert total == sum(r.n for r in tokens.collect())
    cells = sorted((r.sequence_id, r.offset, r.length) for r in pieces)
    at = 0
    for s, o, n in cells:
        assert s * 64 + o == at
        at += n
    assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length for r in pieces)
    assert packing.sequences(packing.packed(tokens, 64)).count() == -(-total // 64)


def test_token_files(spark, table):
    folder, path = new_path(spark, "edge"), public_tokenizers.path(WORD)
    sizes = [(r.shard, r.n_tokens) for r in tokenfile.write(table, folder, path, 2, length=32, shards=3).collect()]
    got = tokenfile.read(spark, folder, sizes).collect()
    assert len(got) == table.count()
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:i]) for i in range(len(ordered))]
    keys = [r.key if r.key is not None else -1 for r in ordered]
    assert keys == sorted(keys)
    empty = zlib.crc32(np.array([2], "<u4").tobytes())
    assert {r.ids_crc32 for r in got if r.key in (2, 3, 7)} <= {empty}


def test_decontaminate(spark, table):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "!!"), (5, "lorem ipsum dolor sit amet lorem ipsum")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table, items).collect()}
    assert got == ({(1, 1), (4, 5), (5, 5)} if table.count() else set())
    kept = decontaminate.clean(table, items)
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == (["2", "3", "7", "8", "None"] if table.count() else [])
    assert decontaminate.leaks(table, items.limit(0)).count() == 0
    blocked = decontaminate.leaks(table, items, block_bytes=16)
    assert {(r.doc_id, r.item_id) for r in blocked.collect()} == got


def test_language(spark, table):
    model = langid.fit(table, F.lit(True), steps=5)
    got = langid.predict(table, model)
    assert got.columns == [c for c in table.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]
    for r in got.collect():
        assert (r.lang_pred == "und") == (r.doc_id in (2, 3, 7, 8)) and 0 <= r.score <= 1
    assert {r.lang_pred for r in langid.predict(table, None).collect()} <= {"und"}


def test_licences(spark, table):
    got = licences.scan(table)
    assert got.count() == table.count() and got.where("licence is not null").count() == 0
    mit = licences.TEXTS[0][1].replace("Software", "SOFTWARE").replace("sublicense", "sub-licence").replace("\n", "\n\nCopyright (c) 2020 A. Name\n")
    more = spark.createDataFrame([(1, mit), (2, mit + " more"), (3, "x\nReleased under the MIT licence.\ny")], "doc_id long, text string")
    assert [(r.licence, r.notices) for r in licences.scan(more).orderBy("doc_id").collect()] == [("MIT", None), (None, None), (None, "MIT")]


PAGES = [(1, "http://a.example.com/x/1", "<p>" + "a" * 2000), (2, None, "<p>" + "a" * 2000), (3, "http://a b/", None), (None, "http://c/", "<p>" + "a" * 2000), (2, "http://z/", "<p>" + "a" * 2000), (5, "", ""), (6, "http://q/\n", "b" * 900), (7, "http://q/", "b" * 900), (8, "http://é/", "é" * 600), (9, "http://long/", LONG)]


@pytest.fixture(params=["some", "none"])
def pages(spark, request):
    rows = PAGES if request.param == "some" else []
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "page_id long, url string, html string, host string, digest int, verdict string")


def test_archive(spark, pages):
    for version in (1, 2):
        folder = new_path(spark, "warc")
        shards = [(r.shard,) for r in archive.write(pages, folder, version=version).collect()]
        got = archive.read(spark.createDataFrame(shards, "shard long"), folder).collect()
        assert len(got) == pages.count()
        kinds = sorted((r.key or "", r.record_type, r.payload_bytes) for r in got)
        if got:
            assert kinds == sorted([("1", "revisit", 2003), ("2", "response", 2003), ("2", "response", 2003), ("", "revisit", 2003), ("3", "response", 0), ("5", "response", 0), ("6", "response", 900), ("7", "response", 900), ("8", "response", 1200), ("9", "response", len(LONG))])
            ids = {r.record_id for r in got if r.key == "2"}
            assert {r.refers_to_id for r in got if r.record_type == "revisit"} <= ids


def test_main_text(spark, pages):
    got = maintext.with_main_text(pages).collect()
    assert sorted(r.text for r in got) == sorted({3: "", 5: "", 6: "b" * 900, 7: "b" * 900, 8: "é" * 600, 9: LONG.strip()}.get(r[0], "a" * 2000) for r in PAGES[: pages.count()])
    clash = pages.withColumn("text", F.lit("x")).withColumn("chars", F.lit(1))
    assert sorted(r.text for r in maintext.with_main_text(clash).collect()) == sorted(r.text for r in got)


def test_urls(spark, pages):
    bad = spark.createDataFrame([(1, True), (2, None), (None, True), (1, False)], "page_id long, bad boolean")
    got = urls.judged(pages, bad, [("com", "/", "allow")]).collect()
    assert len(got) == pages.count() and {r.verdict for r in got} <= {"allow", "block"}
    for r in got:
        if r.page_id == 1:
            assert (r.host, r.path, r.rule, r.verdict) == ("a.example.com", "/x/1", "com/", "allow")
        if r.page_id == 5:
            assert (r.host, r.path, r.rule) == ("", "", None)
    none = urls.judged(pages, bad.limit(0), [])
    assert {r.verdict for r in none.collect()} <= {"allow"}


def test_cover_tree(spark):
    schema = "vec_id long, embedding array<float>, label int, id long, g string, vec string, n long, root int"
    v = [1.0, 0.0, 0.0]
    rows = [(1, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 0.0], 1), (8, [1.0, float("nan"), 0.0], 1), (9, [1.0, float("inf"), 0.0], 1), (None, v, 1), (2, v, 1), (10, [1.0, 0.0], 1), (11, [2.0, 0.1, 0.0], 1), (12, [], 1)]
    t = spark.createDataFrame([(*r, 5, "g", "v", 3, 1) for r in rows], schema)
    got = {}
    for r in covertree.near_duplicates(t).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert got[1] == [(4, 1, True)] and got[2] == [(4, 1, False)] * 2 and got[11] == [(4, 1, False)] and got[None] == [(4, 1, False)]
    assert all(got[i] == [(0, i, True)] for i in (3, 4, 5, 6, 7, 8, 9, 10, 12))
    assert covertree.near_duplicates(t.limit(0)).count() == 0


def test_random_state_is_not_touched():
    random.seed(1)
    a = random.random()
    langid.trained(["abc" * 50, "xyz" * 50], ["a", "b"], steps=2)
    random.seed(1)
    assert random.random() == a
