"""Text of PDF, workbook and slide files with the standard library alone.

PDF: content streams of pages (plain or Flate), their text operators, and character codes by a font's ToUnicode map or
else Latin-1. Pages that only an image covers have no text here. Workbooks and slides: the XML of their archives.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?[\d.]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _unescaped(raw: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        x = m[1]
        if x[:1].isdigit():
            return bytes([int(x, 8) & 255])
        return b"" if x in b"\r\n" else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, raw, flags=re.S)


class Pdf:
    """Objects of a file, and the text of its pages."""

    def __init__(self, data: bytes) -> None:
        if not data.lstrip().startswith(b"%PDF"):
            raise ValueError("no PDF file")
        self.objects = {int(m[1]): m[3] for m in _OBJECT.finditer(data)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                raw = self.stream(body)
                first, n = (int(re.search(rb"/%s\s+(\d+)" % k, body)[1]) for k in (b"First", b"N"))
                head = list(map(int, raw[:first].split()[: 2 * n]))
                starts = [first + x for x in head[1::2]] + [len(raw)]
                self.objects.update({k: raw[a:b] for k, a, b in zip(head[::2], starts[:-1], starts[1:], strict=True)})

    @staticmethod
    def stream(body: bytes) -> bytes:
        m = _STREAM.search(body)
        if not m:
            return b""
        return zlib.decompressobj().decompress(m[1]) if b"FlateDecode" in body[: m.start()] else m[1]

    def refs(self, body: bytes, name: bytes) -> list[int]:
        m = re.search(rb"/%s\s*(\[[^\]]*\]|\d+\s+\d+\s+R)" % name, body)
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []

    def pages(self) -> list[bytes]:
        """Page objects in reading order, or in the file's where its tree is broken."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
        todo, out, seen = self.refs(root, b"Pages"), [], set()
        while todo:
            k = todo.pop(0)
            body = self.objects.get(k, b"")
            if k in seen:
                continue
            seen.add(k)
            kids = self.refs(body, b"Kids")
            if kids:
                todo = kids + todo
            elif re.search(rb"/Type\s*/Page\b", body):
                out.append(body)
        return out or [b for b in self.objects.values() if re.search(rb"/Type\s*/Page\b", b)]

    def maps(self) -> dict[int, tuple[int, str]]:
        """Character codes (with their width in bytes) of all ToUnicode maps together."""
        out: dict[int, tuple[int, str]] = {}
        spelled = lambda x: bytes.fromhex(x.decode()).decode("utf-16-be", "replace")
        for body in self.objects.values():
            for k in self.refs(body, b"ToUnicode"):
                text = self.stream(self.objects.get(k, b""))
                for block in re.findall(rb"beginbfchar(.*?)endbfchar", text, re.S):
                    for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                        out[int(a, 16)] = (len(a) // 2, spelled(b))
                for block in re.findall(rb"beginbfrange(.*?)endbfrange", text, re.S):
                    for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                        for i in range(int(a, 16), min(int(b, 16), int(a, 16) + 65_535) + 1):
                            out[i] = (len(a) // 2, chr(int(c, 16) + i - int(a, 16)) if len(c) <= 4 else spelled(c))
        return out

    def text(self) -> list[str]:
        """The text of each page: a line per text line, a space where a gap is wide."""
        maps = self.maps()

        def shown(token: bytes) -> str:
            raw = _unescaped(token[1:-1]) if token[:1] == b"(" else bytes.fromhex(re.sub(rb"\s", b"", token[1:-1]).decode().ljust(2 * (len(re.sub(rb"\s", b"", token[1:-1])) + 1 >> 1), "0"))
            wide = maps and len(raw) % 2 == 0 and all(n == 2 for n, _ in maps.values())
            codes = [int.from_bytes(raw[i : i + 2]) for i in range(0, len(raw), 2)] if wide else list(raw)
            return "".join(maps[c][1] if c in maps else "" if wide else chr(c) for c in codes)

        out = []
        for page in self.pages():
            lines, now, stack, inside = [], "", [], False
            for k in self.refs(page, b"Contents"):
                for token in _TOKEN.findall(self.stream(self.objects.get(k, b""))):
                    if token == b"BT":
                        inside = True
                    elif token == b"ET":
                        inside = False
                        lines.append(now)
                        now = ""
                    elif token in (b"Td", b"TD", b"T*", b"Tm", b"'", b'"'):
                        moved = token in (b"T*", b"'", b'"') or token == b"Tm" or len(stack) > 1 and stack[-1] not in (b"0", b"0.0")
                        if moved and now:
                            lines.append(now)
                            now = ""
                        if token in (b"'", b'"') and stack:
                            now += shown(stack[-1])
                        stack = []
                    elif token in (b"Tj", b"TJ"):
                        for x in stack:
                            if x[:1] in b"(<":
                                now += shown(x)
                            elif re.fullmatch(rb"[-+]?[\d.]+", x) and float(x) < -200 and token == b"TJ":
                                now += " "
                        stack = []
                    elif token[:1] in b"(<[]/" or re.fullmatch(rb"[-+]?[\d.]+", token):
                        stack.append(token)
                    elif inside or token:
                        stack = []
            lines.append(now)
            out.append("\n".join(x.rstrip() for x in lines if x.strip()))
        return out


def pdf(data: bytes) -> str:
    """The pages' texts joined by blank lines."""
    return "\n\n".join(p for p in Pdf(data).text() if p)


def _parts(z: zipfile.ZipFile, pattern: str) -> list[str]:
    number = lambda n: [int(x) for x in re.findall(r"\d+", n)]
    return sorted((n for n in z.namelist() if re.fullmatch(pattern, n)), key=number)


def workbook(data: bytes) -> str:
    """Each sheet's rows as a Markdown table, sheets joined by blank lines."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        local = lambda e: e.tag.rsplit("}", 1)[-1]
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter() if local(t) == "t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        out = []
        for name in _parts(z, r"xl/worksheets/sheet\d+\.xml"):
            rows = []
            for row in (e for e in ElementTree.fromstring(z.read(name)).iter() if local(e) == "row"):
                cells: list[str] = []
                for c in (e for e in row if local(e) == "c"):
                    at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(re.match(r"[A-Z]*", c.get("r", ""))[0]))) or len(cells) + 1
                    value = "".join(t.text or "" for t in c.iter() if local(t) in ("v", "t"))
                    cells += [""] * (at - len(cells))
                    cells[at - 1] = shared[int(value)] if c.get("t") == "s" and value else value
                rows.append(cells)
            width = max(map(len, rows), default=0)
            table = ["| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in rows]
            out.append("\n".join([*table[:1], "| " + " | ".join(["---"] * width) + " |", *table[1:]]) if table else "")
    return "\n\n".join(x for x in out if x)


def slides(data: bytes) -> str:
    """Each slide's paragraphs, slides joined by blank lines."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        local = lambda e: e.tag.rsplit("}", 1)[-1]
        out = []
        for name in _parts(z, r"ppt/slides/slide\d+\.xml"):
            paragraphs = ("".join(t.text or "" for t in p.iter() if local(t) == "t").strip() for p in ElementTree.fromstring(z.read(name)).iter() if local(p) == "p")
            out.append("\n".join(p for p in paragraphs if p))
    return "\n\n".join(x for x in out if x)


def media(data: bytes) -> list[tuple[str, bytes]]:
    """(name, content) of the pictures in a slide or text archive."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [(n, z.read(n)) for n in _parts(z, r"(?:ppt|word|xl)/media/[^/]+")]


@F.pandas_udf(StringType())
def office_text(kinds: pd.Series, content: pd.Series) -> pd.Series:
    """Text by kind (pdf, xlsx, pptx); null for what cannot be read."""

    def one(kind: str, b: bytes | None) -> str | None:
        read = {"pdf": pdf, "xlsx": workbook, "pptx": slides}.get(kind)
        if read is None or b is None:
            return None
        try:
            return read(bytes(b))
        except (ValueError, KeyError, IndexError, TypeError, zlib.error, zipfile.BadZipFile, ElementTree.ParseError):
            return None

    return pd.Series([one(k, b) for k, b in zip(kinds, content, strict=True)], dtype=object)
