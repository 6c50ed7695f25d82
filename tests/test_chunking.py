import random

import pytest

from cairn.operators.chunking import Document, Plan, chapter_of, fault, heading, heuristic, is_caps, legacy, split
from cairn.operators import chunking
from cairn.plans.chunks import markdown
from cairn.plans.registry import Tables


def exact(text, pieces):
    assert all(text[p.start : p.end] == p.content for p in pieces)


def test_unicode_offsets():
    text = "中文段落内容很多。第二句话也在这里。\n\nemoji 😀 text with ascii words\n\nlast paragraph here"
    pieces = split(text, Plan(size=24, overlap=0))[0]
    exact(text, pieces)
    assert len(pieces) > 1 and [p.seq for p in pieces] == list(range(len(pieces)))


@pytest.mark.parametrize(("plan", "overlap"), [(Plan(size=200, overlap=0), 80), (Plan(size=101, overlap=100), 50), (Plan(size=1000, overlap=800, parent_child=True, child_size=1000), 500)])
def test_overlap_bounds(plan, overlap):
    assert plan.settled().overlap == overlap


def test_token_limit():
    assert Plan(size=512, token_limit=50).settled().size == 200
    assert Plan(size=512, token_limit=50, languages=("zh",)).settled().size == 75


def test_breadcrumbs():
    text = "# Manual\n" + "intro " * 40 + "\n\n## Install\n" + "text one. " * 20 + "\n\n### Docker\n" + "more text here. " * 20 + "\n\n## Use\nx"
    pieces = heading(text, Plan(size=400, overlap=10))
    exact(text, pieces)
    headers = [p.header for p in pieces]
    assert "# Manual\n## Install" in headers and "# Manual\n## Install\n### Docker" in headers


def test_routing():
    md = "# A\nx\n## B\ny\n## C\nz\n## D\nw\n"
    assert split(md, Plan(strategy="auto"))[2].chain == ["heading", "legacy"]
    assert split(md, Plan(strategy="what"))[2].chain == ["heading", "legacy"]
    assert split(md, Plan())[2].chain == ["legacy"]
    assert split("", Plan(strategy="auto"))[:2] == ([], [])


def test_heuristic_makes_progress():
    text = "a" * 50 + "\f" + "b" * 60
    assert [(p.start, p.end) for p in heuristic(text, Plan(size=100, overlap=50))] == [(0, 50), (50, 111)]


def test_patterns():
    d = Document("")
    assert d.line_class("1.2 Title here") == "numbered" and d.line_class("IV. Title") == "numbered" and d.line_class("3 apples") == ""
    assert d.line_class("Page 3 of 9") == "footer" and d.line_class("-----") == "rule" and d.line_class("ALL CAPS LINE") == "caps"
    assert chapter_of("Kapitel 2: Anfang") == "de" and chapter_of("Kapitel 2: Anfang", ["english"]) == "" and chapter_of("第三章 开始") == "zh"
    assert is_caps("中文标题") and not is_caps("ab")


def test_faults():
    assert fault(split("x" * 200, Plan(size=50))[0][:1], 200, Plan(size=50)) == "single chunk for large document"
    assert fault([], 0, Plan()) == "no chunks produced"


def test_table_heads_go_along():
    text = "| a | b |\n| --- | --- |\n" + "".join(f"| r{i} | v{i} |\n" for i in range(12))
    pieces = legacy(text, Plan(size=60, overlap=0))
    exact(text, pieces)
    assert pieces[0].header == "" and {p.header for p in pieces[1:]} == {"| a | b |\n| --- | --- |"}
    other = legacy(text + "| x | y | z |\n", Plan(size=60, overlap=0))
    assert other[-1].header == "" and other[-1].content == "| x | y | z |\n"


def test_hard_cuts():
    text = "w " * 5000
    pieces = legacy(text, Plan(size=100, separators=("@",)))
    exact(text, pieces)
    assert max(len(p.content) for p in pieces) <= 7500 and "".join(p.content for p in pieces) == text


def test_families():
    text = "\n\n".join(f"paragraph {i} " + "word " * 8 for i in range(20))
    children, parents, report = split(text, Plan(parent_child=True, parent_size=1000, child_size=60))
    exact(text, children)
    exact(text, parents)
    assert report.tier == "parent_child" and {c.parent for c in children} == set(range(len(parents)))
    small, none, _ = split("short text", Plan(parent_child=True))
    assert [c.parent for c in small] == [-1] and none == []


def test_protected_ranges():
    text = "see [a](b) and ![c](d)\n```\n# no heading\n```\n$$x\ny$$ end"
    kept = [text[a:b] for a, b in Document(text).protected]
    assert kept == ["[a](b)", "![c](d)", "```\n# no heading\n```\n$$x\ny$$"] and not Document(text).headings


@pytest.mark.parametrize("strategy", ["", "heading", "heuristic", "auto"])
def test_random_texts(strategy):
    rng = random.Random(4)
    bits = ["# H\n", "## S\n", "text text. ", "\n", "\n\n", "| a | b |\n", "| --- | --- |\n", "```\n", "1. item\n", "\f", "CAPS HERE\n", "[l](u)", "中文。", "word " * 30]
    for _ in range(60):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
        for size in (40, 200):
            exact(text, split(text, Plan(size=size, overlap=15, strategy=strategy))[0])


def test_native_profile_equals_the_views(spark):
    rows = markdown(Tables(spark, "/root/testdata/sf0.001"))
    native = {r.doc_id: r for r in chunking.profile_columns(rows, "doc_id", "text").collect()}
    for r in rows.collect():
        p, n = Document(r.text).profile, native[r.doc_id]
        assert [p[k] for k in ("lines", "headings", "fences", "numbered", "chapter", "caps", "rule", "footer", "rows")] == [n.lines, n.headings, n.fences, n.numbered, n.chapter, n.caps, n.rule, n.footer, n.rows]
