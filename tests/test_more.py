import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from cairn.operators import images, planning
from cairn.operators.agent import Message
from cairn.operators.service import Library
from cairn.sources import documents, office
from cairn.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_images(spark):
    text = F.lit("aa ![x](u1) bb\n\n\n\n![y](u2) cc")
    info = F.lit('[{"url":"u1","caption":"c"},{"url":"z","original_url":"u2"},{"url":"q"}]')
    assert [i["url"] for i in json.loads(one(spark, images.shown_in(text, info)))] == ["u1", "z"]
    assert [i["url"] for i in json.loads(one(spark, images.shown_in_range(text, F.lit(100), F.lit(100), F.lit(112), info)))] == ["u1"]
    assert one(spark, images.shown_in(F.lit("none"), info)) == "" and one(spark, images.shown_in(text, F.lit("no json"))) == ""
    assert one(spark, images.pruned(text, F.lit(100), F.lit(100), F.lit(112))) == "aa ![x](u1) bb\n\n cc"
    assert one(spark, images.pruned(F.lit("plain  "), F.lit(0), F.lit(0), F.lit(1))) == "plain  "
    both = json.loads(one(spark, images.joined(F.lit('[{"url":"a","n":"1"}]'), F.lit('[{"url":"a","n":"2"},{"url":""},{"url":"b"}]'))))
    assert both == [{"url": "a", "n": "1"}, {"url": "b"}]


def test_image_hits(spark):
    chunks = spark.createDataFrame([("g", None, "parent_text", "0123456789", 0, 10), ("t", "g", "text", "345", 3, 6), ("u", None, "text", "alone", 20, 25)], "chunk_id string, parent_chunk_id string, chunk_type string, content string, start_at int, end_at int")
    hits = spark.createDataFrame([("t", "image_ocr", "o", 0, 1), ("u", "image_caption", "o", 0, 1), ("t", "text", "o", 0, 1), ("no", "image_ocr", "o", 0, 1)], "parent_chunk_id string, chunk_type string, content string, start_at int, end_at int")
    got = {(r.parent_chunk_id, r.chunk_type): (r.content, r.start_at, r.end_at) for r in images.resolve_image_hits(hits, chunks).collect()}
    assert got == {("t", "image_ocr"): ("345", 3, 6), ("u", "image_caption"): ("alone", 20, 25), ("t", "text"): ("o", 0, 1), ("no", "image_ocr"): ("o", 0, 1)}


def test_planning():
    bases = {"a": planning.Base("a", 1, model="m", store="s"), "b": planning.Base("b", 2, model="n", store="s"), "f": planning.Base("f", 1, "faq", "m", "s"), "off": planning.Base("off", 1, vectors=False, keywords=False)}
    assert planning.tenant(None, 0, bases, ["a", "f"]) == 1 and planning.tenant(None, 0, bases, ["a", "b"]) == 0 and planning.tenant(7, 3, bases, []) == 7 and planning.tenant(None, 0, bases, [], "b") == 2
    assert planning.one_model([bases["a"], bases["f"], bases["off"]]) == "m"
    with pytest.raises(ValueError, match="different embedding models"):
        planning.one_model([bases["a"], bases["b"]])
    assert [len(x) for x in planning.by_store(bases.values()).values()] == [2, 1, 1]
    assert [(p.retriever, p.bases) for p in planning.retrievals([bases["a"], bases["f"]], 5)] == [("vector", ("a",)), ("vector", ("f",)), ("keywords", ("a",))]
    home = {"d1": "a", "d2": "b"}
    assert planning.targets(planning.Scope(), bases, home) == []
    assert planning.targets(planning.Scope(["a", "off"]), bases, home) == [planning.Target("a", 1)]
    assert planning.targets(planning.Scope(["a"], ["d1", "d2", "new"]), bases, home) == [planning.Target("a", 1, ("d1",)), planning.Target("a", 1, ("new",))]
    assert planning.scope_rows([planning.Target("a", 1), planning.Target("b", 2, ("x", "y"))]) == [(1, "a", None), (2, "b", "x"), (2, "b", "y")]


def test_thoughts_in_parts():
    for text in ("a<think>b</think>c", "x<thin y", "<think>open"):
        whole = ["", ""]
        s = ingest.ThinkSplitter()
        for c in text:
            for i, x in enumerate(s.feed(c)):
                whole[i] += x
        for i, x in enumerate(s.flush()):
            whole[i] += x
        assert whole == {"a<think>b</think>c": ["b", "ac"], "x<thin y": ["", "x<thin y"], "<think>open": ["open", ""]}[text]


def test_stream(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    (tmp_path / "in").mkdir()
    for i, text in enumerate(("first text", "second text")):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"tenant_id": 1, "kb_id": "k", "knowledge_id": f"d{i}", "title": "t", "text": text}))
        ingest.ingest_stream(lib, ingest.document_stream(spark, str(tmp_path / "in")), str(tmp_path / "state")).awaitTermination(60)
    assert sorted(r.content for r in lib.table("chunks").collect()) == ["first text", "second text"]


def made_pdf(flate=True):
    content = b"BT /F1 12 Tf 72 700 Td (Hello \\(PDF\\)) Tj 0 -14 Td [(Wor) -20 (ld) -300 (two)] TJ T* <48692e> Tj ET"
    body = zlib.compress(content) if flate else content
    kind = b"/Filter /FlateDecode " if flate else b""
    return b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj\n3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R >> endobj\n4 0 obj << " + kind + b"/Length %d >> stream\n" % len(body) + body + b"\nendstream endobj\n%%EOF"


def test_office(spark):
    assert office.pdf(made_pdf()) == office.pdf(made_pdf(False)) == "Hello (PDF)\nWorld two\nHi."
    with pytest.raises(ValueError, match="no PDF"):
        office.pdf(b"x")
    x, p = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(x, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>name</t></si><si><t>Ann</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row><c r="A2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("ppt/slides/slide2.xml", "<s><p><t>two</t></p></s>")
        z.writestr("ppt/slides/slide1.xml", "<s><p><t>one </t><t>more</t></p><p/></s>")
        z.writestr("ppt/media/a.png", b"png")
    assert office.workbook(x.getvalue()) == "| name |  | 5 |\n| --- | --- | --- |\n| Ann |  |  |"
    assert office.slides(p.getvalue()) == "one more\n\ntwo" and office.media(p.getvalue()) == [("ppt/media/a.png", b"png")]
    rows = spark.createDataFrame([("pdf", made_pdf()), ("xlsx", b"broken"), (None, b"x")], "kind string, content binary").withColumn("path", F.lit("p"))
    assert [r.text for r in documents.parsed(rows).collect()] == ["Hello (PDF)\nWorld two\nHi.", "", ""]
    assert Message("user", "x").calls == []


def test_prefix_sums(spark, monkeypatch):
    from cairn.operators import store

    monkeypatch.setattr(store, "BUCKET_ROWS", 50)
    rows = spark.range(0, 900, 3).select((F.col("id") % 7).alias("a"), F.col("id").cast("string").alias("b"), (F.col("id") % 5).alias("v"))
    got = sorted((r.a, r.b, r.v, r.x) for r in store.prefix_sums(rows, ["a", "b"], "v", "x").collect())
    at = 0
    for _, _, v, x in got:
        assert x == at
        at += v
    assert store.prefix_sums(rows.limit(0), ["a"], "v", "x").count() == 0


def test_rerank_stage(spark):
    from cairn.operators import rerank

    rows = [(1, "alpha beta", 0.5, 0, "text", 0, 9, 0, 0.9), (1, "gamma delta", 0.5, 0, "faq", 0, 9, 1, 0.1), (1, " ", 0.5, 0, "text", 0, 9, 2, 0.9), (1, "direct one", 0.5, 7, "text", 0, 9, 3, 0.0), (2, "only weak", 0.5, 0, "faq", 0, 9, 0, 0.2)]
    hits = spark.createDataFrame(rows, "query_id int, content string, score double, match_type int, chunk_type string, start_at int, end_at int, ordinal int, m double")
    got = {(r.query_id, r.content): r.score for r in rerank.stage(hits, F.col("m"), 5, 0.2, 1.5).collect()}
    assert got == {(1, "alpha beta"): pytest.approx((0.63 + 0.15) * 1.05), (1, "direct one"): pytest.approx((0.7 + 0.15) * 1.05), (2, "only weak"): pytest.approx((0.14 + 0.15) * 1.05 * 1.5)}
