"""Streams: documents that arrive as files go into a library batch by batch, and thoughts are told from answers as text arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.operators.chunking import Plan
from cairn.operators.service import Library

DOCUMENT = "tenant_id int, kb_id string, knowledge_id string, title string, text string"


def document_stream(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines files of documents, as they arrive."""
    return spark.readStream.schema(DOCUMENT).json(folder)


def ingest_stream(library: Library, docs: DataFrame, checkpoint: str, plan: Plan | None = None) -> StreamingQuery:
    """Ingest each batch of documents; of several rows of a document in a batch the one whose text sorts last counts."""

    def take(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            one = batch.groupBy("tenant_id", "kb_id", "knowledge_id").agg(F.max(F.struct("text", "title")).alias("_d"))
            library.ingest(one.select("tenant_id", "kb_id", "knowledge_id", "_d.title", "_d.text"), plan)

    return docs.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ThinkSplitter:
    """Splits text that arrives in parts into thoughts (between the tags) and answer; a part may end within a tag."""

    TAGS = ("<think>", "</think>")

    def __init__(self) -> None:
        self.inside, self.held = False, ""

    def feed(self, part: str) -> tuple[str, str]:
        """(thought, answer) that are certain so far."""
        text, out = self.held + part, ["", ""]
        while True:
            tag = self.TAGS[self.inside]
            at = text.find(tag)
            if at < 0:
                break
            out[not self.inside] += text[:at]
            text, self.inside = text[at + len(tag) :], not self.inside
        hold = next((k for k in range(min(len(tag) - 1, len(text)), 0, -1) if text.endswith(tag[:k])), 0)
        self.held = text[len(text) - hold :]
        out[not self.inside] += text[: len(text) - hold]
        return out[0], out[1]

    def flush(self) -> tuple[str, str]:
        rest, self.held = self.held, ""
        return (rest, "") if self.inside else ("", rest)
