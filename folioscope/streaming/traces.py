"""Node tables of logged records as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import nested


def node_stream(log: DataFrame, late: str = "7 days") -> DataFrame:
    """Interval-labelled nodes of a stream of log lines (line_id, trace_id, record, logged_at, received_at).

    A line counts once within the time that late copies may take; state older than that is dropped.  A line that was
    never marked as received counts as received when it was logged; a line without either time is left out.
    """
    lines = (
        log.withColumn("_at", F.coalesce("received_at", "logged_at"))
        .where("_at is not null and line_id is not null and trace_id is not null and record is not null")
        .withWatermark("_at", late)
        .dropDuplicatesWithinWatermark(["line_id"])
        .select(F.col("line_id").cast("long"), F.col("trace_id").cast("long"), "record")
    )
    return lines.mapInPandas(nested.label_lines, nested.NODE)
