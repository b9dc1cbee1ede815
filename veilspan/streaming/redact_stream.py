"""Structured Streaming: the batch plan over a stream.

Numbering is per document, so no state is kept and no watermark is needed: each
record is masked on arrival, late or not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.redact import Config, mask


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def mask_stream(stream: DataFrame, config: Config | None = None, text: str = "text") -> DataFrame:
    return mask(stream, config, text)


def write_stream(masked: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = False) -> StreamingQuery:
    """Append files, each input exactly once by the sink's log in ``checkpoint``."""
    writer = masked.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def two_phase(stream: DataFrame, first: Callable[[DataFrame, int], None], second: Callable[[DataFrame, int], None], config: Config, checkpoint: str, text: str = "text") -> StreamingQuery:
    """For each micro-batch the deterministic result at once, then the result with the
    models of ``config``."""
    quick = Config(terms=config.terms, given_names=config.given_names, keep=config.keep)

    def both(batch: DataFrame, epoch: int) -> None:
        first(mask(batch, quick, text), epoch)
        second(mask(batch, config, text), epoch)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(both).trigger(availableNow=True).start()
