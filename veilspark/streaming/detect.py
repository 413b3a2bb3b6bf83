"""Detection and redaction on streams.

Both are maps on rows, so they run on a streaming DataFrame as on a table. Counts by event-time window need a watermark,
behind which their state goes; the vault and other tables are kept by foreachBatch, in which a repeated batch changes
nothing."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from veilspark.operators import policy, recognize, vault
from veilspark.plans.engine import Analyzer


def detect(stream: DataFrame, analyzer: Analyzer, *keys: str, text_col: str = "text") -> DataFrame:
    """One row an entity."""
    return recognize.exploded(analyzer.annotate(stream, text_col=text_col), *keys)


def redact(stream: DataFrame, analyzer: Analyzer, rules: policy.Policy, *, text_col: str = "text") -> DataFrame:
    return policy.redact_rows(analyzer.annotate(stream, text_col=text_col), rules, text_col=text_col).drop("entities")


def windowed_counts(entities: DataFrame, time_col: str, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Entities by label and window; rows later than the watermark are dropped."""
    w = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    return entities.withWatermark(time_col, late).groupBy(w.alias("w"), "label").agg(F.count("*").alias("entities")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "label", "entities")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name where driver and executors share files, spark.checkpoint.dir; a folder of this machine only
    where that is not set and all tasks run here."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep_counts(counts: DataFrame, path: str) -> DataStreamWriter:
    """A writer of the windows that each batch changed, in a folder by its number: a repeated batch writes its own anew."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    write(counts.sparkSession.createDataFrame([], counts.schema), -1)  # so that a stream without batches has counts too
    return counts.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write)


def kept_counts(spark: SparkSession, path: str, count: str = "entities") -> DataFrame:
    """The last count of each window that keep_counts() wrote."""
    rows = spark.read.parquet(f"{path}/rows")
    return rows.groupBy(*[c for c in rows.columns if c not in (count, "batch")]).agg(F.max_by(count, "batch").alias(count))


def session_counts(entities: DataFrame, time_col: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return entities.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap).alias("w"), key).agg(F.count("*").alias("entities")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "entities")


def distinct_documents(stream: DataFrame, key: str, time_col: str, late: str = "10 minutes") -> DataFrame:
    """Each id once within the watermark."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark([key])


def fill_vault(entities: DataFrame, path: str, key: bytes) -> DataStreamWriter:
    """A writer that records each batch's pseudonyms."""
    return entities.writeStream.foreachBatch(lambda batch, _: vault.append(vault.entries(batch, key), path))
