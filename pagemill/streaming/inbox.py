"""An extension beyond batch: span files that arrive in a folder are preflighted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import preflight
from ..operators.spans import blocks


def spans(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def preflight_reports(stream: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    """Each batch of whole books to reports (JSON in `to`, a folder a batch, so that a batch that is run again writes the same)."""

    def batch(df: DataFrame, number: int) -> None:
        preflight.run(blocks(df)).write.mode("overwrite").json(f"{to}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
