"""Streams of ledger rows: aliases issued batch by batch, balances kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.instants import with_instant
from ..operators import aliases
from ..session import checkpoint


def running_balances(rows: DataFrame) -> DataFrame:
    """Per account: net and count over a stream (complete or update mode)."""
    return rows.groupBy("account_id").agg(F.sum("amount_cents").alias("net_cents"), F.count("*").alias("txn_count"))


def daily_volume(rows: DataFrame, late: str = "30 days") -> DataFrame:
    """Per UTC posting day: count and sum, rows later than ``late`` behind the newest day dropped by the watermark."""
    at = with_instant(rows, "posted_date").where(F.col("instant").isNotNull())
    return at.withWatermark("instant", late).groupBy(F.window("instant", "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum("amount_cents").alias("cents")).select(F.col("w.start").alias("day"), "n", "cents")


class AliasSink:
    """``foreachBatch`` target: issues tokens for the values a batch brings, in a table that only grows.

    A batch that is delivered again finds its values known and adds nothing, so replays after a failure are harmless.
    """

    def __init__(self, spark: SparkSession, path: str, columns: dict[str, str]):
        self.spark, self.path, self.columns = spark, path, columns

    def mapping(self) -> DataFrame | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.parquet(self.path)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        values = None
        for cls, column in self.columns.items():
            one = batch.select(F.lit(cls).alias("entity_type"), F.col(column).alias("real_value"), F.col("id").alias("seen"))
            values = one if values is None else values.unionByName(one)
        known = self.mapping()
        new = checkpoint(aliases.issue(values, known, aliases.counters(known) if known is not None else None))
        new.select("alias_token", "entity_type", "real_value").write.mode("append").parquet(self.path)
