"""Document bytes as text: formats by name, encodings, Markdown repair, embedded images, DOCX, and history files."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cairn.sources.office import office_text

# File types, encodings in the order to try, and leading bytes of formats.
KINDS = {"md": "markdown", "markdown": "markdown", "txt": "markdown", "text": "markdown", "json": "markdown", "docx": "docx", "pdf": "pdf", "xlsx": "xlsx", "pptx": "pptx"}
ENCODINGS = ("utf-8", "gb18030", "gb2312", "gbk", "big5", "ascii", "latin-1")
MAGIC = {"504B0304": "zip", "D0CF11E0A1B11AE1": "ole", "25504446": "pdf"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DATA_IMAGE = r"!\[([^\]]*)\]\(data:image/([a-zA-Z0-9.+-]+);base64,([^)]+)\)"


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, content of each file; an unknown kind is null."""
    return spark.read.format("binaryFile").load(path).select("path", kind_of(F.col("path")).alias("kind"), "content")


def kind_of(name: Column) -> Column:
    ending = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for k, v in KINDS.items():
        out = F.when(ending == k, F.lit(v)).otherwise(out)
    return out


def sniffed(content: Column) -> Column:
    """The container format by its first bytes."""
    out = F.lit("unknown")
    for k, v in MAGIC.items():
        out = F.when(F.startswith(F.hex(F.substring(content, 1, 8)), F.lit(k)), F.lit(v)).otherwise(out)
    return out


def decode(data: bytes) -> str:
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1", errors="replace")


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Text by the first encoding that fits."""
    return content.map(lambda b: None if b is None else decode(bytes(b)))


def table_lines(text: str) -> str:
    """Markdown with single-spaced cells in its tables, a rule under each head, and no empty or rule rows before a head."""
    rule = lambda cells: all(re.fullmatch(r":?-+:?", c) for c in cells) and bool(cells)
    out: list[str] = []
    block: list[list[str]] = []

    def close() -> None:
        nonlocal block
        while block and (rule(block[0]) or not any(block[0])):
            block.pop(0)
        if len(block) == 1 or block and not rule(block[1]):
            block.insert(1, ["---"] * len(block[0]))
        out.extend("| " + " | ".join(cells) + " |" for cells in block)
        block = []

    for line in text.split("\n"):
        s = line.strip()
        if s.startswith("|") and s.endswith("|") and len(s) > 1:
            block.append([c.strip() for c in s[1:-1].split("|")])
        else:
            close()
            out.append(line)
    close()
    return "\n".join(out)


@F.pandas_udf(StringType())
def with_tables(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else table_lines(t))


def embedded_images(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, alt, name, content): inline base64 images, named by their digest."""
    found = docs.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(DATA_IMAGE), 0)).alias("n", "_m"))
    body = F.try_to_binary(F.regexp_replace(F.regexp_extract("_m", DATA_IMAGE, 3), r"\s", ""), F.lit("base64"))
    return found.select(key, "n", F.regexp_extract("_m", DATA_IMAGE, 1).alias("alt"), F.concat(F.lit("images/"), F.md5(body), F.lit("."), F.regexp_extract("_m", DATA_IMAGE, 2)).alias("name"), body.alias("content"))


def image_paths(text: Column) -> Column:
    """Inline images as references to images/<digest>.<type>; those that do not decode as their alternative text."""
    one = F.regexp_extract_all(text, F.lit(DATA_IMAGE), 0)
    body = lambda m: F.try_to_binary(F.regexp_replace(F.regexp_extract(m, DATA_IMAGE, 3), r"\s", ""), F.lit("base64"))
    alt = lambda m: F.regexp_extract(m, DATA_IMAGE, 1)
    link = lambda m: F.coalesce(F.concat(F.lit("!["), alt(m), F.lit("](images/"), F.md5(body(m)), F.lit("."), F.regexp_extract(m, DATA_IMAGE, 2), F.lit(")")), alt(m))
    return F.aggregate(one, text, lambda t, m: F.replace(t, m, link(m)))


def docx(data: bytes) -> tuple[str, list[list[list[str]]]]:
    """Paragraphs joined by blank lines, and the tables as rows of cells."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    spelled = lambda e: "".join((t.text or "") if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" if t.tag == f"{_W}br" else "" for t in e.iter())
    paragraphs = [spelled(p).strip() for p in body.findall(f"{_W}p")]
    tables = [[["\n".join(spelled(p) for p in c.findall(f"{_W}p")).strip() for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")] for t in body.findall(f"{_W}tbl")]
    return "\n\n".join(p for p in paragraphs if p), tables


def table_html(rows: list[list[str]]) -> str:
    """A table with equal neighbours of a row as one cell over several columns."""
    out = []
    for row in rows:
        cells: list[list] = []
        for c in row:
            if cells and cells[-1][0] == c:
                cells[-1][1] += 1
            else:
                cells.append([c, 1])
        out.append("<tr>" + "".join(f"<td colspan='{n}'>{c}</td>" if n > 1 else f"<td>{c}</td>" for c, n in cells) + "</tr>")
    return "<table>" + "".join(out) + "</table>"


def docx_whole(data: bytes) -> str:
    """Paragraphs, and the tables as HTML after them."""
    text, tables = docx(data)
    return "\n\n".join(x for x in (text, *map(table_html, tables)) if x)


def docx_simple(data: bytes) -> str:
    """Paragraphs, then table rows with bars between the cells."""
    text, tables = docx(data)
    return "\n\n".join([text, *(" | ".join(r) for t in tables for r in t)]).strip()


@F.pandas_udf(StringType())
def docx_text(content: pd.Series) -> pd.Series:
    """Text and tables of DOCX bytes; null for what is none."""

    def one(b: bytes | None) -> str | None:
        try:
            return None if b is None else docx_whole(bytes(b))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None

    return content.map(one)


def parsed(rows: DataFrame) -> DataFrame:
    """rows (path, kind, content) with text: the first parser of each kind that gives some, empty where none does."""
    markdown = image_paths(with_tables(decoded(F.col("content"))))
    text = F.when(F.col("kind") == "docx", F.coalesce(docx_text(F.col("content")), F.lit(""))).when(F.col("kind") == "markdown", markdown).otherwise(F.coalesce(office_text(F.coalesce("kind", F.lit("")), "content"), F.lit("")))
    return rows.withColumn("text", text)


def history(spark: SparkSession, path: str) -> DataFrame:
    """Messages of JSON lines files; lines that are no JSON are left out."""
    return spark.read.schema("conv_id string, turn long, role string, content string, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad is null and role is not null").drop("_bad")


def _versions(spark: SparkSession, path: str) -> tuple:
    hadoop = spark._jvm.org.apache.hadoop.fs
    marks = hadoop.Path(f"{path}/_versions")
    fs = marks.getFileSystem(spark._jsc.hadoopConfiguration())
    return hadoop, fs, sorted(int(f.getPath().getName()) for f in fs.listStatus(marks)) if fs.exists(marks) else []


def replace_table(df: DataFrame, path: str) -> None:
    """df as the next version of a table. An empty file named for it is its pointer, made when it is whole: a run that breaks
    off leaves the last version in place. The version before the last is deleted, for nothing reads it any more."""
    hadoop, fs, known = _versions(df.sparkSession, path)
    now = known[-1] + 1 if known else 0
    df.write.mode("overwrite").parquet(f"{path}/v{now}")
    fs.create(hadoop.Path(f"{path}/_versions/{now}"), True).close()
    for old in known[:-1]:
        fs.delete(hadoop.Path(f"{path}/_versions/{old}"), True)
        fs.delete(hadoop.Path(f"{path}/v{old}"), True)


def current_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The last whole version of a table, or None."""
    known = _versions(spark, path)[2]
    return spark.read.parquet(f"{path}/v{known[-1]}") if known else None
