import io
import json

import pytest

from cairn import cli
from cairn.operators import clients


def said(argv, spark=None):
    out = io.StringIO()
    code = cli.main(argv, spark, out)
    return code, out.getvalue()


def test_preview(tmp_path):
    (tmp_path / "a.md").write_text("# Title\n\n" + "A sentence of the text. " * 60 + "\n\n## Next\n\nMore.\n")
    code, text = said(["preview", str(tmp_path / "a.md"), "--size", "300", "--overlap", "20"])
    assert code == 0 and "chunk 0 [0:" in text and "warning" not in text
    whole = json.loads(said(["preview", str(tmp_path / "a.md"), "--json", "--parent-child"])[1])
    assert whole["report"]["tier"] == "parent_child" and whole["chunks"]


def test_bridge(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "run.md").write_text("# Runbook\n\nThe latency budget is 120ms for the search path.\n")
    lib = str(tmp_path / "lib")
    assert said(["definitions", lib], spark)[0] == 1
    code, text = said(["init", lib, str(tmp_path / "in")], spark)
    assert code == 0 and json.loads(text)["documents"] == 1
    names = [d["function"]["name"] for d in json.loads(said(["definitions", lib], spark)[1])["definitions"]]
    assert names == ["get_document_info", "grep_chunks", "knowledge_search", "list_knowledge_chunks"]
    code, text = said(["execute", lib, "grep_chunks", '{"patterns": ["120ms"]}'], spark)
    assert code == 0 and "120ms" in json.loads(text)["output"]
    assert said(["execute", lib, "grep_chunks", "[]"], spark)[0] == 1


def test_clients(spark):
    pauses, calls = [], []

    def weak(texts):
        calls.append(list(texts))
        if len(calls) < 3:
            raise OSError("busy")
        return [[float(len(t))] for t in texts]

    known = {}
    assert clients.answers(weak, ["a", "bb", "a"], known, wait=pauses.append) == [[1.0], [2.0], [1.0]]
    assert pauses == [0.2, 0.4] and calls[-1] == ["a", "bb"] and clients.answers(weak, ["bb"], known) == [[2.0]] and len(calls) == 3
    with pytest.raises(ValueError, match="1 answers to 2 texts"):
        clients.answers(lambda x: [0], ["a", "b"], {})
    with pytest.raises(OSError):
        clients.persistent(lambda: (_ for _ in ()).throw(OSError("down")), attempts=2, wait=lambda s: None)
    rows = spark.createDataFrame([(1, "q", "x"), (1, "q", None), (2, "r", "yy")], "query_id int, query string, content string")
    embedded = clients.embedder(lambda texts: [[float(len(t)), 1.0] for t in texts])(rows, "content", "v")
    assert sorted((r.query_id, r.v) for r in embedded.collect()) == [(1, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 1.0])]

    def model(query, passages):
        if query == "r":
            raise OSError("down")
        return [(i, len(p) / 2) for i, p in enumerate(passages) if p]

    scores = sorted((r.query_id, r.content or "", r.model_score) for r in clients.judged(rows, model, attempts=1).collect())
    assert scores == [(1, "", 0.0), (1, "x", 0.5), (2, "yy", None)]


def test_streamed_answers():
    delta = lambda **d: "data: " + json.dumps({"choices": [{"delta": d}]})
    lines = [": note", delta(content="Hel"), "data: broken", delta(content="lo"), delta(tool_calls=[{"index": 0, "id": "c1", "function": {"name": "grep", "arguments": '{"a"'}}]), delta(tool_calls=[{"index": 0, "function": {"arguments": ": 1}"}}]), 'data: {"choices": [{"delta": {}, "finish_reason": "tool_calls"}]}', "data: [DONE]", delta(content="late")]
    assert clients.streamed(lines) == {"content": "Hello", "calls": [{"id": "c1", "name": "grep", "arguments": '{"a": 1}'}], "finish": "tool_calls"}


def test_hashed_vectors(spark):
    """hash_embed against a plain sum over hashes."""
    import hashlib
    import math

    from cairn.operators import rerank

    texts = ["a b a", "", "the quick brown fox", "x" * 50]
    rows = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "i int, terms array<string>")
    for r in rerank.hash_embed(rows, "terms", 16).collect():
        v = [0.0] * 16
        for t in texts[r.i].split():
            v[int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") % 16] += 1
        n = math.sqrt(sum(x * x for x in v))
        assert r.embedding == pytest.approx([x / n if n else 0.0 for x in v], abs=1e-6)


def test_history_and_fallback(spark):
    """Earlier results follow the hits, and a failed model leaves a query to its search results."""
    from pyspark.sql import functions as F

    from cairn.operators import merge, rerank

    schema = "query_id int, query string, chunk_id string, content string, score double, match_type int, ordinal int"
    hits = spark.createDataFrame([(1, "alpha beta", "a", "alpha one", 1.0, 0, 0)], schema)
    earlier = spark.createDataFrame([(1, "alpha beta", c, t, 0.5, 0, i) for i, (c, t) in enumerate([("a", "x"), ("b", "alpha beta two"), ("c", "other words"), ("d", "alpha one"), ("e", "beta alpha")])], schema)
    got = [(r.chunk_id, r.score, r.match_type) for r in merge.with_history(hits, earlier).orderBy("ordinal").collect()]
    assert got == [("a", 1.0, 0), ("b", 0.3, 3), ("e", 0.3, 3)]
    rows = spark.createDataFrame([(1, "x y", 0.5, 0, "text", 0, 9, 0, 0.9), (2, "z", 0.5, 0, "text", 0, 9, 0, None)], "query_id int, content string, score double, match_type int, chunk_type string, start_at int, end_at int, ordinal int, m double")
    assert [r.query_id for r in rerank.stage(rows, F.col("m"), 5).collect()] == [1]


def test_merged_passages(spark):
    """Children become parents without images outside them, answers and neighbours are filled in, and order follows documents."""
    from cairn.operators import merge

    chunk = "chunk_id string, knowledge_id string, chunk_type string, parent_chunk_id string, content string, start_at int, end_at int, chunk_index int, metadata string"
    chunks = spark.createDataFrame(
        [("p", "d", "parent_text", None, "P" * 400 + " ![far](u9)", 0, 411, 0, None), ("c", "d", "text", "p", "P" * 60, 100, 160, 0, None), ("n0", "e", "text", None, "A" * 180, 0, 180, 0, None), ("n1", "e", "text", None, "B" * 40, 180, 220, 1, None), ("n2", "e", "text", None, "C" * 180, 220, 400, 2, None)]
        + [("f", "g", "faq", None, "raw", 0, 3, 0, '{"StandardQuestion":"Q1","Answers":["a","b"]}')],
        chunk,
    )
    hit = "query_id int, query string, chunk_id string, knowledge_id string, chunk_type string, parent_chunk_id string, content string, start_at int, end_at int, score double, match_type int, image_info string, ordinal int"
    hits = spark.createDataFrame([(1, "q", "c", "d", "text", "p", "P" * 60, 100, 160, 0.4, 0, None, 0), (1, "q", "n1", "e", "text", None, "B" * 40, 180, 220, 0.9, 0, None, 1), (1, "q", "f", "g", "faq", None, "raw", 0, 3, 0.5, 0, None, 2), (1, "q", "c", "d", "text", "p", "P" * 60, 100, 160, 0.4, 0, None, 3)], hit)
    got = [(r.chunk_id, r.content, r.start_at, r.sub_chunk_ids) for r in merge.merged(hits, chunks).orderBy("ordinal").collect()]
    assert got == [("c", "P" * 400, 0, ["c"]), ("n1", "A" * 180 + "B" * 40 + "C" * 180, 0, ["n0", "n2"]), ("f", "Q: Q1\nAnswer:\n- a\n- b", 0, [])]


def test_neighbours_beyond_the_first(spark):
    """Short neighbours are taken until the length is reached or the document ends, and the start is never under 0."""
    from cairn.operators import merge

    rows = [(f"k{i}", "d", "text", chr(97 + i % 26) * 5, 5 * i, 5 * i + 5, i) for i in range(200)] + [(f"s{i}", "e", "text", "same", 4 * i, 4 * i + 4, i) for i in range(30)]
    chunks = spark.createDataFrame(rows, "chunk_id string, knowledge_id string, chunk_type string, content string, start_at int, end_at int, chunk_index int")
    got = {r.chunk_id: r for r in merge.expand_neighbours(chunks.where("chunk_id in ('k0', 'k100', 'k199', 's15')"), chunks).collect()}
    for key, at in (("k0", 0), ("k100", 100), ("k199", 199)):
        prev, following = [r[3] for r in rows[:at][::-1]], [r[3] for r in rows[at + 1 : 200]]
        text, before = merge.grow(prev, rows[at][3], following)
        assert (got[key].content, got[key].start_at, got[key].end_at) == (text, max(0, 5 * at - before), max(0, 5 * at - before) + len(text)) and len(text) >= 350
    assert got["s15"].content == "same" and got["s15"].start_at >= 0
