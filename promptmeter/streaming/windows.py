"""Costs by windows of event time: tumbling and session windows with a watermark, and a side table for rows that come too late.

The same functions take streams and tables: over a table they are the batch form of the same question.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pico
from .pipe import Ledger


def _sums(rows: DataFrame, window: Column, by: tuple[str, ...]) -> DataFrame:
    good = F.col("error").isNull()
    sums = rows.groupBy(window.alias("window"), *by).agg(
        F.count(F.when(good, 1)).alias("lines"),
        F.coalesce(F.sum(F.when(good, F.col("input") + F.col("output"))), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(good, pico("cost"))), F.lit(0)).cast("decimal(38,0)").alias("cost_pico"),
    )
    return sums.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "lines", "tokens", "cost_pico")


def tumbling(rows: DataFrame, time: str, size: str, *by: str, delay: str | None = None) -> DataFrame:
    """start, end, the columns `by`, lines, tokens, cost_pico of rows (time, input, output, cost, error) by windows of one size.

    On a stream `delay` says how long a window waits for rows; those that come later are left out (CostWindows
    keeps them).
    Rows without time have no window.
    """
    return _sums(rows.withWatermark(time, delay) if delay else rows, F.window(time, size), by)


def sessions(rows: DataFrame, time: str, gap: str, *by: str, delay: str | None = None) -> DataFrame:
    """As tumbling(), by sessions: runs of rows of one `by` that follow each other within the gap."""
    return _sums(rows.withWatermark(time, delay) if delay else rows, F.session_window(time, gap), by)


class Upserts:
    """For foreachBatch in update mode: each epoch's changed windows; last() has every window as it was changed last."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/epoch={epoch}")

    def last(self, spark, *keys: str) -> DataFrame:
        rows = spark.read.parquet(self.folder)
        own = [c for c in rows.columns if c != "epoch"]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*own), "epoch").alias("__row")).select("__row.*")


class CostWindows:
    """For foreachBatch: sums of tumbling windows, and apart from them the rows that came when their window had closed.

    A window is closed for a batch when its end isn't after the latest time of the batches before it, less the delay.
    That time is kept in a Ledger and each epoch replaces its own sums and rows, so a restart or a batch that is run
    again changes nothing, and every row is either in a window or among the late ones. Rows without time are neither.
    """

    def __init__(self, folder: str, time: str, size: str, delay_seconds: int, *by: str):
        self.folder, self.time, self.size, self.delay, self.by = folder, time, size, delay_seconds, by

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        ledger = Ledger(batch.sparkSession, f"{self.folder}/ledger")
        latest = (ledger.before(epoch) or {}).get("latest")
        end = F.window(self.time, self.size)["end"].cast("timestamp").cast("double")
        held = batch.withColumn("__late", F.lit(False) if latest is None else end <= latest - self.delay).persist()
        put = lambda rows, part: rows.write.mode("overwrite").parquet(f"{self.folder}/{part}/epoch={epoch}")
        put(held.where("__late").drop("__late"), "late")
        put(tumbling(held.where("not __late"), self.time, self.size, *self.by), "sums")
        most = held.agg(F.max(F.col(self.time).cast("timestamp").cast("double"))).first()[0]
        held.unpersist()
        ledger.put(epoch, {"latest": max((x for x in (latest, most) if x is not None), default=None)})

    def windows(self, spark) -> DataFrame:
        """As tumbling() of the rows that were in time."""
        sums = spark.read.parquet(f"{self.folder}/sums").groupBy("start", "end", *self.by)
        return sums.agg(F.sum("lines").alias("lines"), F.sum("tokens").alias("tokens"), F.sum("cost_pico").cast("decimal(38,0)").alias("cost_pico"))

    def late(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/late").drop("epoch")


def closed(windows: DataFrame, now: datetime | Column) -> DataFrame:
    """The windows that end by then."""
    return windows.where(F.col("end") <= now)
