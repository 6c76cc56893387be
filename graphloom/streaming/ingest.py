"""Streams of records through a template into a named graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..plans.template import Template, ingest
from ..sources import ntriples


def stream_to_graph(records: DataFrame, template: Template, namespace: str, path: str, graph_id: str, checkpoint: str, key: Column | None = None):
    """Each micro-batch of a streaming DataFrame becomes triples that are appended; triples that are there already are not.

    Appending only what is new makes a batch that is run again harmless.
    """

    def batch(df: DataFrame, _: int) -> None:
        g = ingest(template, df, namespace, fill_unused=key is not None, key=key)
        ntriples.append(g, graph_id, path)

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
