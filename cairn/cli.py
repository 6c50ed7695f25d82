"""Command line: what a splitter makes of a file, and a library's tools as JSON for programs that are no Python.

    python -m cairn.cli preview FILE [--strategy auto] [--size N] ... [--json]
    python -m cairn.cli init LIBRARY FOLDER        reads a folder of files into a library
    python -m cairn.cli definitions LIBRARY        the tools that a model may call
    python -m cairn.cli execute LIBRARY TOOL ARGS  one call of a tool; ARGS is a JSON object

All but a preview print one JSON object; an error is {"success": false, "error": ...} and the exit code is 1.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict
from pathlib import Path
from typing import TextIO

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cairn.operators import chunking
from cairn.operators.service import Library, local_embedder, local_reranker
from cairn.sources import documents

TENANT, BASE, DIMENSIONS = 1, "local", 128


def preview(args: argparse.Namespace, out: TextIO) -> int:
    """The chunks of a file with their ranges, and a warning where a range does not give the chunk's text."""
    text = Path(args.path).read_text(encoding="utf-8")
    plan = chunking.Plan(args.size, args.overlap, tuple(args.separator) or chunking.SEPARATORS, args.strategy, args.token_limit, tuple(args.language), args.parent_child)
    leaves, parents, report = chunking.split(text, plan)
    if args.json:
        print(json.dumps({"report": asdict(report), "parents": [asdict(p) for p in parents], "chunks": [asdict(p) for p in leaves]}, ensure_ascii=False), file=out)
        return 0
    print(f"{args.path}: {len(text)} characters, {len(parents)} parents, {len(leaves)} chunks by {report.tier} of {' > '.join(report.chain)}", file=out)
    for tier, why in report.rejected:
        print(f"not by {tier}: {why}", file=out)
    for name, pieces in (("parent", parents), ("chunk", leaves)):
        for p in pieces:
            shown = p.content if args.full or len(p.content) <= args.most else p.content[: args.most] + " ..."
            print(f"\n{name} {p.seq} [{p.start}:{p.end}]" + (f" of parent {p.parent}" if p.parent >= 0 else ""), file=out)
            for line in [*p.header.splitlines(), *shown.splitlines()]:
                print(f"    {line}", file=out)
            if text[p.start : p.end] != p.content:
                print("    warning: the range gives another text", file=out)
    return 0


def library(spark: SparkSession, path: str) -> Library:
    return Library(spark, path, local_embedder(DIMENSIONS), local_reranker)


def init(spark: SparkSession, path: str, folder: str) -> dict:
    """A folder's files as documents of one base; those without text are left out."""
    rows = documents.parsed(documents.files(spark, folder)).where(F.trim("text") != "")
    docs = rows.select(F.lit(TENANT).alias("tenant_id"), F.lit(BASE).alias("kb_id"), F.sha2("path", 256).alias("knowledge_id"), F.regexp_extract("path", "([^/]*)$", 1).alias("title"), "text")
    done = library(spark, path).ingest(docs)
    return {"success": True, "library": path, "base": BASE, "documents": docs.count(), **done}


def bound(spark: SparkSession, path: str):  # noqa: ANN201
    return library(spark, path).registry(spark.createDataFrame([(TENANT, BASE, None)], "tenant_id int, kb_id string, knowledge_id string"))


def answer(args: argparse.Namespace, spark: SparkSession) -> dict:
    if args.command == "init":
        return init(spark, args.library, args.folder)
    if not library(spark, args.library).commits():
        raise ValueError(f"no library at {args.library}")
    registry = bound(spark, args.library)
    if args.command == "definitions":
        return {"success": True, "definitions": registry.definitions()}
    said = json.loads(args.args)
    if not isinstance(said, dict):
        raise ValueError("the arguments must be a JSON object")
    result = registry.run(args.tool, said)
    return {"success": result.success, "output": result.output, "data": result.data, "error": result.error}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cairn", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("preview")
    p.add_argument("path")
    p.add_argument("--strategy", default="auto")
    for name, default in (("--size", chunking.SIZE), ("--overlap", chunking.OVERLAP), ("--token-limit", 0), ("--most", 160)):
        p.add_argument(name, type=int, default=default)
    for name in ("--separator", "--language"):
        p.add_argument(name, action="append", default=[])
    for name in ("--parent-child", "--json", "--full"):
        p.add_argument(name, action="store_true")
    for name, more in (("init", ["folder"]), ("definitions", []), ("execute", ["tool", "args"])):
        p = commands.add_parser(name)
        for x in ("library", *more):
            p.add_argument(x)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out: TextIO = sys.stdout) -> int:
    args = parser().parse_args(argv)
    if args.command == "preview":
        return preview(args, out)
    try:
        said = answer(args, spark or SparkSession.builder.appName("cairn").getOrCreate())
    except Exception as e:  # noqa: BLE001  the caller reads JSON
        said = {"success": False, "error": str(e)}
    print(json.dumps(said, ensure_ascii=False, default=str), file=out)
    return 0 if said["success"] else 1


if __name__ == "__main__":
    sys.exit(main())
