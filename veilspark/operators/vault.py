"""The pseudonym vault: a table of (label, value digest) -> surrogate that batches and streams fill once a key.

Surrogates are keyed digests, so two tasks that meet the same value agree without a lock; the table records which were
given, for reversal. Adding is an anti join, so a repeated batch adds nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions import redact


def entries(entities: DataFrame, key: bytes) -> DataFrame:
    """label, value and surrogate of each distinct value."""
    rows = entities.select("label", "value").distinct()
    return rows.withColumn("surrogate", redact.surrogate(F.col("value"), F.col("label"), key=key))


def missing(found: DataFrame, vault: DataFrame) -> DataFrame:
    return found.join(vault.select("label", "value"), ["label", "value"], "left_anti")


def append(found: DataFrame, path: str) -> None:
    """Adds what the vault at path does not have yet."""
    spark = found.sparkSession
    try:
        vault = spark.read.parquet(path)
    except Exception as e:  # the first batch: there is no vault yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        vault = found.limit(0)
    missing(found, vault).write.mode("append").parquet(path)


def reverse(surrogates: DataFrame, vault: DataFrame) -> DataFrame:
    """surrogates (label, surrogate) with the values they stand for; what two writers added alike counts once."""
    known = vault.groupBy("label", "surrogate").agg(F.min("value").alias("original"), F.countDistinct("value").alias("values"))
    sure = F.when(F.col("values") > 1, F.raise_error(F.lit("a surrogate stands for two values"))).otherwise(F.col("original"))
    return surrogates.join(known.select("label", "surrogate", sure.alias("original")), ["label", "surrogate"], "left")
