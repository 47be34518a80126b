"""Auditing references as they arrive, against a catalogue that is a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import verify


def audit_stream(refs: DataFrame, works: DataFrame, dois: DataFrame, urls: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **options):
    """Starts a query that audits each micro-batch of the stream ``refs`` (REFS columns) and gives it to ``sink``
    with its number; a sink that overwrites by that number is written exactly once."""

    def batch(rows: DataFrame, number: int) -> None:
        sink(verify.audit(rows, works, dois, urls, **options), number)

    return refs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
