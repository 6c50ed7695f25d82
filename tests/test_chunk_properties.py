"""What holds for every splitter on any text: ranges, order, coverage; and native line views against plain Python."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.operators import chunking

PART = st.sampled_from(["# Head\n", "## Next one\n", "### 深い見出し\n", "```py\n# no heading\nx = 1\n```\n", "| a | b |\n| --- | --- |\n| 1 | 2 |\n", "1. First item\n", "2.1 Second\n", "CHAPTER ONE\n", "\n", "\n\n", "\f", "中文句子。下一句！", "A sentence. Another one? Yes!\n", "word " * 30, "x" * 90, "![i](u)\n", "$$a$$\n", "- bullet\n", "   \n", "\r\n", "😀 é"])
TEXT = st.lists(PART, max_size=40).map("".join)


@settings(max_examples=120, deadline=None)
@given(TEXT, st.sampled_from(["", "auto", "heading", "heuristic", "legacy", "recursive"]), st.integers(30, 400), st.integers(0, 60), st.booleans())
def test_chunks_are_ranges_that_cover_the_text(text, strategy, size, overlap, family):
    plan = chunking.Plan(size=size, overlap=overlap, strategy=strategy, parent_child=family, parent_size=4 * size, child_size=size)
    leaves, parents, report = chunking.split(text, plan)
    for pieces in (leaves, parents):
        assert all(text[p.start : p.end] == p.content for p in pieces)
        assert all(a.start <= b.start for a, b in zip(pieces[:-1], pieces[1:], strict=True))
    assert [p.seq for p in leaves] == list(range(len(leaves))) or family
    held = set()
    for p in leaves:
        held.update(range(p.start, p.end))
    assert all(i in held for i, c in enumerate(text) if not c.isspace())
    assert all(0 <= p.parent < max(1, len(parents)) or p.parent == -1 for p in leaves)
    assert report.tier in ("heading", "heuristic", "legacy", "recursive", "parent_child")


def test_fences_and_breadcrumbs_of_lines(spark):
    """Fence parity and headings above each line, against a plain walk."""
    rng = random.Random(4)
    parts = ["# One", "## Two", "### Three", "text", "```", "~~~", "  ``` py", "# not `` fenced", "", "#### Four #"]
    docs = [(i, "\n".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.n): (r.fence, r.fenced) for r in chunking.line_rows(df, "doc_id", "text").collect()}
    heads = chunking.line_rows(df, "doc_id", "text").where(~F.col("fenced") & F.col("line").rlike(chunking.HEADING))
    crumbs = {(r.doc_id, r.n): r.breadcrumb for r in chunking.breadcrumbs(heads.select("doc_id", "n", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), "line"), "doc_id", "n").collect()}
    for i, text in docs:
        open_, above = False, []
        for n, line in enumerate(text.split("\n")):
            fence = re.match(r"\s*(```|~~~)", line) is not None
            open_ ^= fence
            assert got[i, n] == (fence, fence or open_)
            m = re.match(r"(#{1,6})\s", line)
            if m and not open_ and not fence:
                above = [x for x in above if x[0] < len(m[1])] + [(len(m[1]), line)]
                assert crumbs[i, n] == "\n".join(x for _, x in above)


@pytest.mark.parametrize("overlap", [0, 10, 37])
def test_legacy_against_a_plain_packing(overlap):
    """Texts of words without any other structure: units go into chunks as long as they fit, and chunks share whole units."""
    rng = random.Random(overlap)
    for _ in range(20):
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 120))]
        text = " ".join(words)
        leaves, _, _ = chunking.split(text, chunking.Plan(size=80, overlap=overlap, strategy="legacy", separators=(" ",)))
        assert all(len(p.content) <= 80 for p in leaves)
        for a, b in zip(leaves[:-1], leaves[1:], strict=True):
            assert overlap == 0 or a.end - b.start <= overlap  # no overlap asked for is the default one
            assert b.end > a.end and b.start > a.start
        assert leaves[0].start == 0 and leaves[-1].end == len(text)
