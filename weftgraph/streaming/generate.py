"""Generation over a stream of rows: each micro-batch asks only prompts that no earlier one has asked.

Results and records of a micro-batch are written under its number, in place of what a failed attempt has left, so
that a restart repeats neither rows nor prompts that were answered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.generate import Options, generate
from ..operators.patterns import Solutions


def records(spark, path: str, before: int) -> DataFrame | None:
    """(key, raw) of micro-batches before a number; None if there are none."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException:
        return None
    return found.where(F.col("batch") < before).groupBy("key").agg(F.min("raw").alias("raw"))


def generate_stream(stream: DataFrame, terms: dict[str, Column], prompt: str, outputs: Sequence[str], provider, out: str, record_path: str, checkpoint: str, options: Options | None = None, watermark: tuple[str, str] | None = None) -> StreamingQuery:
    """Starts a query that extends each row's terms by a model's answers and appends them to out as Parquet.

    terms: variables and their TERM columns. watermark: a column and a delay; rows that repeat within it are dropped.
    """
    theta = (options or Options()).theta
    if watermark:
        stream = stream.withWatermark(*watermark).dropDuplicatesWithinWatermark()
    rows = stream.select(*(c.alias(v) for v, c in terms.items()))

    def each(batch: DataFrame, number: int) -> None:
        known = records(batch.sparkSession, record_path, number)
        made = generate(Solutions(batch), prompt, outputs, provider, Options(theta=theta, records=known))
        made.records().write.mode("overwrite").parquet(f"{record_path}/batch={number}")
        made.solutions.df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
