"""Beyond the batch audit: every micro-batch of a stream is audited on arrival."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.model import AuditReport
from tidemark.operators.audit import audit_dataset


def audit_stream(
    stream: DataFrame,
    config: dict[str, Any],
    sink: str,
    checkpoint: str,
    on_report: Callable[[int, AuditReport], None] | None = None,
) -> StreamingQuery:
    """Write the checks of each micro-batch to ``sink`` as Parquet by batch.

    A batch that is retried after a failure overwrites its own folder."""

    def audit(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            report = audit_dataset(batch, config)
            report.to_frame(batch.sparkSession).write.mode("overwrite").parquet(f"{sink}/batch={number}")
            if on_report:
                on_report(number, report)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(audit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
