"""Structure-aware chunks with exact character offsets.

A document is read once into lines with their offsets, fence state and class; headings, boundaries, protected ranges and
the profile are views of that list. The packers are folds over ranges of one document, so they run in an Arrow UDF per
document; the profile, tier choice and checks are also DataFrame expressions over exploded lines (``profile_columns``).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Sizes, separators, patterns, classes by rank, and names of languages.
SIZE, OVERLAP, PARENT, CHILD, HARD_LIMIT = 512, 80, 4096, 384, 7500
SEPARATORS = ("\n\n", "\n", "。")
NUMBERED = r"^[ \t]*(?:\d+(?:\.\d+){1,3}\.?|(?:\d+|[IVX]{1,5})\.)[ \t]+\S.{0,200}$"
ROMAN = r"^\s*(?:I|II|III|IV|V|VI|VII|VIII|IX|X|XI|XII)[.)]?\s+[A-Z][^\n]{0,140}$"
CHAPTERS = {
    "en": r"(?i)^[ \t]*(?:Chapter|Section|Part)\s+(?:[0-9]+|[IVX]{1,5})[\.: ].{0,200}$",
    "de": r"(?i)^[ \t]*(?:Kapitel|Abschnitt|Teil)\s+(?:[0-9]+|[IVX]{1,5})[\.: ].{0,200}$",
    "zh": r"^[ \t]*第[ \t]*[一二三四五六七八九十百千零〇0-9]+[ \t]*(?:章|节|節|部分|篇)[ \t]?.{0,200}$",
}
RULE = r"^\s*[-=_*]{3,}\s*$"
FOOTER = r"(?i)^[ \t]*(?:Seite|Page|页码?)\s+\d+(?:\s*(?:von|of|/)\s*\d+)?[ \t]*$"
HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
TABLE_RULE = r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$"
TABLE_HEAD = r"^\s*(?:\|[^|\n]*)+\|?\s*(?:\r?\n)+\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*(?:\r?\n)+$"
TABLE_LINE = r"(?m)^\s*(?:\|[^|\n]*)+\|\s*$"
ATOMS = (r"(?s)\$\$.*?\$\$", r"!\[[^\]]*]\([^)]+\)", r"(?<!!)\[[^\]]+]\([^)]+\)")
RANK = {"blank": 1, "footer": 2, "rule": 3, "caps": 4, "chapter": 5, "numbered": 6, "feed": 7}
LANGUAGES = {"en": ("en", "eng", "english"), "de": ("de", "deu", "ger", "german", "deutsch"), "zh": ("zh", "zho", "chi", "chinese", "cn", "zh-cn", "zh-hans", "zh-hant")}
DENSE_SCRIPTS = frozenset("zh zho chi chinese cn ja jpn ko kor".split())

_R = {k: re.compile(v) for k, v in {"numbered": NUMBERED, "roman": ROMAN, "rule": RULE, "footer": FOOTER, "heading": HEADING, "table_rule": TABLE_RULE, "table_head": TABLE_HEAD, "table_line": TABLE_LINE}.items()}
_CHAPTER = {k: re.compile(v) for k, v in CHAPTERS.items()}


@dataclass(frozen=True)
class Plan:
    """How to split; a size of 0 or less means the default."""

    size: int = SIZE
    overlap: int = OVERLAP
    separators: tuple[str, ...] = SEPARATORS
    strategy: str = ""
    token_limit: int = 0
    languages: tuple[str, ...] = ()
    parent_child: bool = False
    parent_size: int = PARENT
    child_size: int = CHILD

    def settled(self, keep_zero_overlap: bool = False) -> Plan:
        positive = lambda x, d: x if x > 0 else d
        sizes = [positive(self.size, SIZE), positive(self.parent_size, PARENT), positive(self.child_size, CHILD)]
        if self.token_limit > 0:
            a_token = 1.5 if DENSE_SCRIPTS & {x.lower() for x in self.languages} else 4.0
            if (most := int(self.token_limit * a_token)) > 0:
                sizes = [min(s, most) for s in sizes]
        overlap = self.overlap if self.overlap > 0 or self.overlap == 0 and keep_zero_overlap else OVERLAP
        overlap = min(overlap, (sizes[2] if self.parent_child else sizes[0]) // 2)
        return replace(self, size=sizes[0], parent_size=sizes[1], child_size=sizes[2], overlap=overlap, separators=tuple(s for s in self.separators if s) or SEPARATORS, strategy=self.strategy.strip().lower())


@dataclass
class Piece:
    start: int
    end: int
    content: str
    header: str = ""
    seq: int = 0
    parent: int = -1


@dataclass(frozen=True)
class Line:
    start: int
    end: int
    text: str
    fenced: bool  # within a fence, or a fence line itself
    fence: bool


def columns(line: str) -> int:
    cells = line.strip().removeprefix("|").removesuffix("|")
    return len(cells.split("|")) if cells else 0


def is_row(line: str) -> bool:
    return line.count("|") >= 2


def row_columns(text: str) -> int:
    """Of the first table row that is no rule; 0 where there is none."""
    return next((columns(x) for x in text.splitlines() if is_row(x) and not _R["table_rule"].match(x.strip())), 0)


def is_caps(line: str) -> bool:
    s = line.strip()
    letters = [c for c in s if c.isalpha()]
    return 3 <= len(s) <= 80 and len(letters) >= 3 and not any(map(str.islower, letters))


def chapter_of(line: str, languages: Iterable[str] = ()) -> str:
    asked = {k for k, names in LANGUAGES.items() if {x.lower() for x in languages} & set(names)} or set(LANGUAGES)
    return next((k for k, r in _CHAPTER.items() if k in asked and r.match(line.strip())), "")


class Document:
    """Views of one text."""

    def __init__(self, text: str, languages: Iterable[str] = ()) -> None:
        self.text, self.languages = text, tuple(languages)

    @cached_property
    def lines(self) -> list[Line]:
        out, at, inside = [], 0, False
        for raw in self.text.splitlines(keepends=True):
            fence = raw.strip().startswith(("```", "~~~"))
            out.append(Line(at, at + len(raw), raw, fence or inside, fence))
            inside ^= fence
            at += len(raw)
        return out

    @cached_property
    def headings(self) -> list[tuple[int, int, str]]:
        """(start, level, line with its hashes)"""
        found = ((x.start, _R["heading"].match(x.text.rstrip("\r\n"))) for x in self.lines if not x.fenced)
        return [(at, len(m[1]), f"{m[1]} {m[2].strip().strip('#').strip()}") for at, m in found if m]

    @cached_property
    def main_level(self) -> int:
        """The highest level that three headings have, else the lowest there is; 0 without headings."""
        levels = [n for _, n, _ in self.headings]
        return min((n for n in levels if levels.count(n) >= 3), default=max(levels, default=0))

    @cached_property
    def protected(self) -> list[tuple[int, int]]:
        """Ranges that stay whole: formulas, images, links, fences, tables; touching ones are one."""
        spans = [m.span() for a in ATOMS for m in re.finditer(a, self.text)]
        fences = [x for x in self.lines if x.fence]
        spans += [(a.start, b.end) for a, b in zip(fences[::2], fences[1::2], strict=False)]
        if len(fences) % 2:
            spans.append((fences[-1].start, len(self.text)))
        run: list[Line] = []
        for x in [*self.lines, Line(0, 0, "", False, False)]:
            if is_row(x.text):
                run.append(x)
                continue
            if len(run) > 1 and any(_R["table_rule"].match(r.text.strip()) for r in run):
                spans.append((run[0].start, run[-1].end))
            run = []
        out: list[tuple[int, int]] = []
        for a, b in sorted(s for s in spans if s[0] < s[1]):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def line_class(self, line: str) -> str:
        s = line.strip()
        tests = (("numbered", lambda: _R["numbered"].match(s) or _R["roman"].match(s)), ("chapter", lambda: chapter_of(s, self.languages)), ("caps", lambda: is_caps(s)), ("rule", lambda: _R["rule"].match(s)), ("footer", lambda: _R["footer"].match(s)))
        return next((k for k, test in tests if test()), "") if s else ""

    @cached_property
    def boundaries(self) -> list[int]:
        """Places to cut at, with both ends, in order."""
        ranked = [(x.start, self.line_class(x.text)) for x in self.lines if not x.fenced]
        ranked += [(i, "feed") for i, c in enumerate(self.text) if c == "\f"] + [(m.end(), "blank") for m in re.finditer(r"\n{3,}", self.text)]
        inside = lambda p: any(a < p < b for a, b in self.protected)
        return sorted({0, len(self.text)} | {p for p, kind in ranked if kind and not inside(p)})

    @cached_property
    def profile(self) -> dict:
        n = {k: 0 for k in ("numbered", "roman", "chapter", "caps", "rule", "footer", "rows")}
        for x in self.lines:
            s = x.text.strip()
            if x.fenced or not s:
                continue
            numbered = bool(_R["numbered"].match(s))
            n["numbered"] += numbered
            n["roman"] += not numbered and bool(_R["roman"].match(s))
            n["chapter"] += bool(chapter_of(s, self.languages))
            n["caps"] += is_caps(s)
            n["rule"] += bool(_R["rule"].match(s))
            n["footer"] += bool(_R["footer"].match(s))
            n["rows"] += is_row(s)
        total = self.text.count("\n") + 1 if self.text else 0
        return n | {"chars": len(self.text), "lines": total, "headings": len(self.headings), "density": len(self.headings) / total if total else 0.0, "main_level": self.main_level, "fences": sum(x.fence for x in self.lines), "feeds": self.text.count("\f"), "blanks": len(re.findall(r"\n{3,}", self.text))}


MARKERS = ("numbered", "roman", "chapter", "caps", "rule", "footer")


def tiers(plan: Plan, profile: dict | None) -> list[str]:
    """The splitters to try, in order; an unknown strategy goes by the profile like auto."""
    if plan.strategy in ("heading", "heuristic"):
        return [plan.strategy, "legacy"]
    if plan.strategy in ("", "legacy", "recursive") or profile is None:
        return ["legacy"]
    found = []
    if profile["headings"] >= 3 and profile["density"] > 0.005:
        found.append("heading")
    if sum(profile[m] for m in MARKERS) >= 5 or profile["feeds"] or profile["chapter"]:
        found.append("heuristic")
    return [*found, "legacy"]


class TableHeader:
    """The head of the table that the units are in: text for chunks that continue it."""

    def __init__(self) -> None:
        self.text = ""
        self.closed = self.waiting = self.broken = self.lately = False

    def _close(self) -> None:
        self.text, self.closed, self.waiting = "", True, False

    def feed(self, unit: str) -> bool:
        """Take the next unit in; True if the chunk so far must end before it."""
        cut = False
        if self.broken:
            self.broken = False
            if self.text:
                self._close()
                if row_columns(unit):
                    cut = True
                else:
                    self.lately = True
        if self.text and not unit.lstrip().startswith("|"):
            self._close()
            self.lately = True
        if self.text and not self.waiting:
            if re.search(r"(?:\r?\n){2,}\s*$", unit):
                self.broken = True
            else:
                here, head = row_columns(unit), row_columns(self.text)
                if here and head and here != head:
                    self._close()
                    cut = self.lately = True
        if self.waiting:
            if self.text and _R["table_line"].search(unit):
                self.text = unit + next((x + "\n" for x in self.text.splitlines() if "---" in x), "")
            self.waiting = False
        if not self.text:
            head = _R["table_head"].search(unit)
            if head and (not self.closed or cut):
                cut, self.lately = cut or self.lately, False
                self.text = head[0]
                first = self.text.splitlines()[0].strip() if self.text else ""
                self.waiting = bool(first) and not first.strip("| \t")
        if not self.text:
            self.closed = False
        return cut


def units(doc: Document, plan: Plan) -> Iterator[tuple[int, int]]:
    """Ranges that are packed whole, in order and without gaps."""
    text = doc.text

    def plain(a: int, b: int, level: int) -> Iterator[tuple[int, int]]:
        sep = plan.separators[level]
        while a < b:
            at = text.find(sep, a, b)
            stop = b if at < 0 else at
            if stop - a > plan.size and level + 1 < len(plan.separators):
                yield from plain(a, stop, level + 1)
            elif stop > a:
                yield a, stop
            if at >= 0:
                yield at, at + len(sep)
            a = b if at < 0 else at + len(sep)

    def table(a: int, b: int) -> Iterator[tuple[int, int]]:
        ends = [m.end() for m in re.finditer(r"\n", text[a:b])]
        cuts = [a, *(a + e for e in ends), *([b] if not ends or ends[-1] != b - a else [])]
        rows = list(pairwise(cuts))
        i = 0
        while i < len(rows):
            fuse = i + 1 < len(rows) and is_row(text[slice(*rows[i])]) and _R["table_rule"].match(text[slice(*rows[i + 1])].strip())
            yield rows[i][0], rows[i + bool(fuse)][1]
            i += 1 + bool(fuse)

    at = 0
    for a, b in doc.protected:
        yield from plain(at, a, 0)
        has_rule = any(_R["table_rule"].match(x.strip()) for x in text[a:b].splitlines() if x.strip())
        yield from table(a, b) if has_rule else [(a, b)]
        at = b
    yield from plain(at, len(text), 0)


def hard_cuts(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most HARD_LIMIT, each ended after the last space or line feed of its last 200 characters."""
    while a < b:
        stop = min(a + HARD_LIMIT, b)
        if stop < b:
            low = max(a, stop - 200)
            stop = max(text.rfind("\n", low, stop), text.rfind(" ", low, stop)) + 1 or stop
        yield a, stop
        a = stop


def legacy(text: str, plan: Plan) -> list[Piece]:
    """Packs units up to the size, with overlap, and keeps a table's head beside chunks that continue the table."""
    plan = plan.settled(keep_zero_overlap=True)
    doc, out, head = Document(text, plan.languages), [], TableHeader()
    held: list[tuple[int, int]] = []
    extra = ""  # a table head that stands before the held units; it counts in their size

    def size() -> int:
        return len(extra) + sum(b - a for a, b in held)

    def flush() -> None:
        nonlocal extra
        if held:
            out.append(Piece(held[0][0], held[-1][1], "".join(text[a:b] for a, b in held), extra.strip()))

    def overlap(following: int) -> list[tuple[int, int]]:
        kept, total = [], 0
        for a, b in reversed(held):
            if total + b - a > plan.overlap or total + b - a + following > plan.size:
                break
            kept.append((a, b))
            total += b - a
        kept.reverse()
        while kept and (not text[slice(*kept[0])].strip() or text[slice(*kept[0])] in plan.separators):
            kept.pop(0)
        if kept:
            a, b = kept[0]
            kept[0] = (b - len(text[a:b].lstrip()), b)
        return kept

    for a, b in units(doc, plan):
        unit, n = text[a:b], b - a
        if n > HARD_LIMIT:
            flush()
            head.feed(unit)
            held, extra = [], ""
            out += [Piece(x, y, text[x:y]) for x, y in hard_cuts(text, a, b)]
            continue
        if head.feed(unit) and held:
            flush()
            held, extra = [], ""
        top = head.text if len(head.text) <= plan.size else ""
        if held and size() + n + len(top) > plan.size:
            flush()
            held, extra = overlap(n) if plan.overlap > 0 else [], ""
            if top and len(top) + n <= plan.size:
                while held and size() + n + len(top) > plan.size:
                    held.pop(0)
                there = not top.strip() or top.strip() in "".join(text[x:y] for x, y in held).strip() or unit.startswith(top) or top.strip() in unit.strip()
                row = next((x for x in unit.splitlines() if x.strip()), "")
                differs = is_row(row) and not _R["table_rule"].match(row.strip()) and 0 < columns(next((x for x in top.splitlines() if is_row(x)), "")) != columns(row) > 0
                if not there and not differs:
                    extra = top
        if held and size() + n > HARD_LIMIT:
            flush()
            held, extra = [], ""
        held.append((a, b))
    flush()
    return out


def crumbs(stack: list[tuple[int, str]]) -> str:
    return "\n".join(x for _, x in stack)


def heading(text: str, plan: Plan, level: int = 0) -> list[Piece]:
    """Sections at headings of the main level or above, each with the headings that it is under."""
    plan = plan.settled(keep_zero_overlap=True)
    doc = Document(text, plan.languages)
    level = level or doc.main_level
    starts = sorted({0} | {at for at, n, _ in doc.headings if n <= level})
    if not level or len(starts) < 2:
        return legacy(text, plan)
    out: list[Piece] = []
    stack: list[tuple[int, str]] = []
    own = {at: (n, line) for at, n, line in doc.headings if n <= level}
    for a, b in pairwise([*starts, len(text)]):
        if a == b:
            continue
        if a in own:
            n, line = own[a]
            stack = [x for x in stack if x[0] < n] + [(n, line)]
        section, crumb = text[a:b], crumbs(stack)
        path, points = list(stack), [(0, crumb)]
        for at, n, line in Document(section).headings:
            if at and n > level:
                path = [x for x in path if x[0] < n] + [(n, line)]
                points.append((at, crumbs(path)))
        stack = path
        if len(crumb) + (2 if crumb else 0) + b - a <= plan.size:
            out.append(Piece(a, b, section, crumb))
        else:
            out += [Piece(a + p.start, a + p.end, p.content, [c for at, c in points if at <= p.start][-1]) for p in legacy(section, plan)]
    target, merged = max(plan.size // 2, 200), out[:1]
    for p in out[1:]:
        now = merged[-1]
        lines = [[x for x in h.splitlines() if x.strip()] for h in (now.header, p.header)]
        shared = next((i for i, (x, y) in enumerate(zip(*lines, strict=False)) if x != y), min(map(len, lines)))
        if shared and now.end == p.start and len(now.content) < target and len(now.content) + len(p.content) <= plan.size:
            merged[-1] = Piece(now.start, p.end, now.content + p.content, "\n".join(lines[0][:shared]))
        else:
            merged.append(p)
    return merged


def heuristic(text: str, plan: Plan) -> list[Piece]:
    """Packs blocks between boundaries, with overlaps that start at boundaries or lines."""
    plan = plan.settled(keep_zero_overlap=True)
    places = Document(text, plan.languages).boundaries
    if not text:
        return []
    if len(places) <= 2 and len(text) > plan.size:
        return legacy(text, plan)
    out: list[Piece] = []
    least = max(plan.size // 4, 50)

    def emit(a: int, b: int) -> None:
        if a < b:
            out.append(Piece(a, b, text[a:b]))

    def back(end: int) -> int:
        if plan.overlap <= 0:
            return end
        low = max(0, end - 2 * plan.overlap)
        near = [p for p in places if low <= p < end and p]
        if near:
            return near[-1]
        target = max(0, end - plan.overlap)
        return text.rfind("\n", low, target + 1) + 1 or target

    first = end = 0
    for stop in places[1:]:
        if stop - end > plan.size:
            emit(first, end)
            out += [Piece(end + p.start, end + p.end, p.content, p.header) for p in legacy(text[end:stop], plan)]
            first = end = stop
            continue
        # a full chunk is let go and the block tried again from its overlap; a small one grows past the size
        while stop - first > plan.size and end > first and end - first >= least:
            emit(first, end)
            begin = back(end)
            first = end if begin <= first or stop - begin > plan.size else begin
        end = stop
    emit(first, end)
    return out


def fault(pieces: list[Piece], total: int, plan: Plan) -> str:
    """Why chunks are no good split of so many characters; empty if they are one."""
    size, n = plan.settled(keep_zero_overlap=True).size, [len(p.content) for p in pieces]
    tiny = sum(x < 50 for x in n[:-1])
    checks = (
        (not n, "no chunks produced"), (len(n) == 1 and total > 2 * size, "single chunk for large document"), (tiny > 2 and tiny > len(n) / 4, "too many tiny chunks"),
        (max(n, default=0) < size / 4 and total > size, "all chunks far below target size"), (max(n, default=0) > 2 * size, "chunk exceeds 2x target size"),
        (any(not 0 <= p.start <= p.end <= total for p in pieces), "chunk offsets out of range"), (any(p.end - p.start > len(p.content) for p in pieces), "chunk offsets exceed content length"),
    )
    return next((why for bad, why in checks if bad), "")


@dataclass
class Report:
    tier: str = ""
    chain: list[str] = field(default_factory=list)
    rejected: list[tuple[str, str]] = field(default_factory=list)


def split(text: str, plan: Plan | None = None) -> tuple[list[Piece], list[Piece], Report]:
    """(chunks or children, parents, report): the first tier whose chunks are good, or the last one's."""
    plan = (plan or Plan()).settled()
    if plan.parent_child:
        return *_families(text, plan), Report("parent_child", ["parent_child"])
    named = plan.strategy in ("", "heading", "heuristic", "legacy", "recursive")
    doc = Document(text, plan.languages)
    chain = tiers(plan, None if named or not text else doc.profile)
    report = Report(chain[-1], chain)
    pieces: list[Piece] = []
    for tier in chain if text else ():
        pieces = {"heading": lambda: heading(text, plan, 0), "heuristic": lambda: heuristic(text, plan), "legacy": lambda: legacy(text, plan)}[tier]()
        report.tier = tier
        why = fault(pieces, len(text), plan)
        if not why:
            break
        report.rejected.append((tier, why))
    for i, p in enumerate(pieces):
        p.seq = i
    return pieces, [], report


def _families(text: str, plan: Plan) -> tuple[list[Piece], list[Piece]]:
    leaf = replace(plan, parent_child=False)
    parents: list[Piece] = []
    children: list[Piece] = []
    for whole in split(text, replace(leaf, size=plan.parent_size))[0] if text else ():
        parts = split(whole.content, replace(leaf, size=plan.child_size))[0]
        index = -1
        if len(parts) > 1 or parts and parts[0].content != whole.content:
            index = len(parents)
            parents.append(replace(whole, seq=index))
        for p in parts:
            lines = p.header.split("\n") if p.header else []
            if whole.header and lines and lines[0].strip() == whole.header.split("\n")[-1].strip():
                lines = lines[1:]
            children.append(Piece(whole.start + p.start, whole.start + p.end, p.content, "\n".join(([whole.header] if whole.header else []) + lines), len(children), index))
    return children, parents


CHUNK = "array<struct<seq:int,start_at:int,end_at:int,content:string,context_header:string,parent_index:int,kind:string>>"


def chunks(docs: DataFrame, key: str, text: str, plan: Plan | None = None) -> DataFrame:
    """One row per chunk: key, seq, start_at, end_at, content, context_header, parent_index, kind (text or parent_text)."""

    @F.pandas_udf(CHUNK)
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            leaves, parents, _ = split(t or "", plan)
            out.append([{"seq": p.seq, "start_at": p.start, "end_at": p.end, "content": p.content, "context_header": p.header, "parent_index": p.parent, "kind": kind} for kind, some in (("parent_text", parents), ("text", leaves)) for p in some])
        return pd.Series(out)

    return docs.select(key, F.explode(cut(F.col(text))).alias("c")).select(key, "c.*")


def line_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, line, fence, fenced): lines in order, and whether they lie in a fence."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("n", "line"))
    fence = F.regexp_replace(F.col("line"), r"^\s+", "").rlike("^(```|~~~)")
    before = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("fence", fence).withColumn("fenced", F.col("fence") | (F.sum(F.col("fence").cast("int")).over(before) % 2 == 1))


def profile_columns(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The profile's counters natively, for texts whose lines end in line feeds."""
    free = ~F.col("fenced")
    s = F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))
    count = lambda c: F.sum(F.when(free & (s != "") & c, 1).otherwise(0))
    chapter = s.rlike(CHAPTERS["en"]) | s.rlike(CHAPTERS["de"]) | s.rlike(CHAPTERS["zh"])
    letters = F.regexp_replace(s, r"\P{L}", "")
    caps = F.length(s).between(3, 80) & (F.length(letters) >= 3) & ~letters.rlike(r"\p{Ll}")
    counted = line_rows(docs, key, text).groupBy(key).agg(
        F.count("*").alias("lines"), count(F.col("line").rlike(HEADING)).alias("headings"), F.sum(F.col("fence").cast("int")).alias("fences"), count(s.rlike(NUMBERED)).alias("numbered"),
        count(chapter).alias("chapter"), count(caps).alias("caps"), count(s.rlike(RULE)).alias("rule"), count(s.rlike(FOOTER)).alias("footer"), count(s.rlike(r"\|[^|]*\|")).alias("rows"),
    )
    return counted


def breadcrumbs(headings: DataFrame, per: str, order: str) -> DataFrame:
    """headings (per, order, level, line) with the headings above each: level l shows where its last place is after those of all levels above it."""
    w = Window.partitionBy(per).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = headings
    for n in range(1, 7):
        out = out.withColumn(f"_p{n}", F.coalesce(F.max(F.when(F.col("level") == n, F.col(order))).over(w), F.lit(-1))).withColumn(f"_l{n}", F.last(F.when(F.col("level") == n, F.col("line")), ignorenulls=True).over(w))
    shown = [F.when((F.col(f"_p{n}") >= 0) & (F.col(f"_p{n}") > F.greatest(*[F.col(f"_p{m}") for m in range(1, n)], F.lit(-1), F.lit(-2))), F.col(f"_l{n}")) for n in range(1, 7)]
    return out.select(*headings.columns, F.concat_ws("\n", *shown).alias("breadcrumb"))
