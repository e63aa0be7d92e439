"""Incremental ingest and standing conditions over streams of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tesselon.operators.nodes import Node
from tesselon.operators.retrieval import Context, Corpus
from tesselon.plans.schema import Schema
from tesselon.sources.index import TextIndex


def index_stream(documents: DataFrame, index: TextIndex, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Each micro-batch becomes a segment of the index; a batch that is run again replaces the same keys."""
    return documents.writeStream.foreachBatch(lambda batch, _: index.index(batch, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def percolate(documents: DataFrame, schema: Schema, node: Node, doc_id: str = "doc_id") -> DataFrame:
    """The documents of a stream that meet a condition; scores, which need the whole corpus, aren't given."""
    ctx = Context(Corpus(documents, schema, doc_id=doc_id))
    node = node.rewrite()
    ctx.ask(node)
    condition, _ = node.build(ctx)
    return ctx.scanned(documents).where(condition).select(*documents.columns)
