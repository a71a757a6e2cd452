"""Files that arrive as lines of manifests, imported as they come. An import is idempotent, so a repeated batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strandlake.operators.commands import Commands

MANIFEST = "input string, sample string, tool string, annotation_name string, format string"


def intake(commands: Commands, manifests: str, outputs: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Watch a folder of tab-separated manifests with a header, and import what they list."""

    def take(rows: DataFrame, _: int) -> None:
        rows = rows.dropna(subset=["input", "sample", "tool", "annotation_name"]).distinct()
        if rows.head(1):
            commands.batch(rows, outputs)

    stream = commands.spark.readStream.schema(MANIFEST).option("sep", "\t").option("header", True).csv(manifests)
    out = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
