"""The line pipeline on streams: stateless costing, quotas that outlive a restart, and running totals."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import pico
from ..operators.usage import as_json, classify, totals, until_quota, with_cost
from ..sources.files import with_line_errors


def cost_stream(lines: DataFrame, price: tuple[float, float, float | None], mode: str = "auto", json_field: str = "content", fail_fast: bool = False) -> DataFrame:
    """A stream (or table) of lines as rows with counts, cost and the output line `json`."""
    rows = with_cost(classify(with_line_errors(lines), mode, json_field), price)
    out = rows.withColumn("json", as_json(rows))
    if fail_fast:
        stop = F.raise_error(F.col("error")).cast("boolean")
        out = out.where(F.when(F.col("error").isNotNull(), stop).otherwise(True))
    return out


def with_summary(rows: DataFrame, name: str = "summary") -> DataFrame:
    """rows that report lines, tokens and cost to listeners while they pass."""
    good = F.col("error").isNull()
    return rows.observe(name, F.count(F.when(good, 1)).alias("lines"), F.sum(F.when(good, F.col("input") + F.col("output"))).alias("tokens"), F.sum(F.when(good, F.col("cost"))).alias("cost"))


class Ledger:
    """A row of totals for each epoch of a foreachBatch sink, in a folder that survives the driver.

    A batch builds on the entry of the epoch before it, never on its own, so a batch that is run again after a failure
    gives the same entry. Entries are written after the batch's rows.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, epoch: int):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/epoch={epoch}")

    def before(self, epoch: int) -> dict | None:
        """The entry of the epoch before; None at the first one."""
        if epoch == 0:
            return None
        path = self._path(epoch - 1)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            raise ValueError(f"the ledger {self.folder} lacks epoch {epoch - 1}: it belongs to another checkpoint")
        return json.loads(self.spark.read.text(path.toString()).first()[0])

    def put(self, epoch: int, entry: dict) -> None:
        row = self.spark.createDataFrame([(json.dumps(entry),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(self._path(epoch).toString())


def by_epoch(folder: str, format: str = "parquet"):
    """A writer for sinks: an epoch's rows replace those that an earlier try of the same epoch left."""
    return lambda rows, epoch: rows.write.mode("overwrite").format(format).save(f"{folder}/epoch={epoch}")


class QuotaSink:
    """For foreachBatch: writes rows until a limit is reached, then stops the query; the row that reaches it is written.

    A batch is taken in order of `order`; its running totals are sums of slices first, so no task takes all rows. With
    a folder the totals are kept in a Ledger: a query that starts again from its checkpoint goes on with them, and a
    batch that is run again counts once, if `write` replaces what it wrote for that epoch (see by_epoch). Without
    one they last as long as this object.
    """

    def __init__(self, write, order: str, max_tokens: int | None = None, max_cost_pico: int | None = None, folder: str | None = None):
        self.write, self.order, self.max_tokens, self.max_cost, self.folder = write, order, max_tokens, max_cost_pico, folder
        self.lines = self.tokens = self.cost_pico = 0
        self.query = None

    @property
    def reached(self) -> bool:
        return any(most is not None and used >= most for most, used in ((self.max_tokens, self.tokens), (self.max_cost, self.cost_pico))) and self.lines > 0

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        ledger = Ledger(batch.sparkSession, self.folder) if self.folder else None
        if ledger:
            known = ledger.before(epoch) or {"lines": 0, "tokens": 0, "cost_pico": 0}
            self.lines, self.tokens, self.cost_pico = known["lines"], known["tokens"], known["cost_pico"]
        if not self.reached:
            left = lambda most, used: None if most is None else most - used
            taken = until_quota(batch, self.order, left(self.max_tokens, self.tokens), left(self.max_cost, self.cost_pico)).persist()
            t = totals(taken).first()
            self.write(taken, epoch)
            taken.unpersist()
            self.lines, self.tokens, self.cost_pico = self.lines + t["lines"], self.tokens + t["tokens"], self.cost_pico + int(t["cost_pico"])
        if ledger:
            ledger.put(epoch, {"lines": self.lines, "tokens": self.tokens, "cost_pico": self.cost_pico})
        if self.reached and self.query:
            self.query.stop()


#: Names that begin with an underscore are changed on the way to a processor.
_PICO = "cost_in_pico"


class _KeyedQuota(StatefulProcessor):
    def __init__(self, order: str, columns: list[str], max_tokens: int | None, max_cost: int | None):
        self.order, self.columns, self.max_tokens, self.max_cost = order, columns, max_tokens, max_cost

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "lines long, tokens long, cost string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        lines, tokens, cost = (int(x) for x in self.total.get()) if self.total.exists() else (0, 0, 0)
        over = lambda: lines > 0 and (self.max_tokens is not None and tokens >= self.max_tokens or self.max_cost is not None and cost >= self.max_cost)
        if over():
            return
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        keep = 0
        for good, n, pico_ in zip(batch["error"].isna(), batch["input"] + batch["output"], batch[_PICO], strict=True):
            if over():
                break
            keep += 1
            if good:
                lines, tokens, cost = lines + 1, tokens + int(n), cost + int(pico_)
        self.total.update((lines, tokens, str(cost)))
        yield batch.iloc[:keep][self.columns]

    def close(self) -> None:
        pass


def quota_by_key(rows: DataFrame, key: str, order: str, max_tokens: int | None = None, max_cost_pico: int | None = None) -> DataFrame:
    """A stream of rows with a quota for each key: rows up to and with the one at which the key's total reaches a limit.

    Totals are state of the query, so they outlive a restart from its checkpoint. Rows of a key count in the order
    in which batches bring them, inside a batch by `order`; a task holds the rows of a key of one batch, which the
    source's limits bound, and none of a key that has reached its quota. The session's state store must be RocksDB's.
    """
    wide = rows.withColumn(_PICO, F.coalesce(pico("cost"), F.lit(0)).cast("string"))
    processor = _KeyedQuota(order, rows.columns, max_tokens, max_cost_pico)
    return wide.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=rows.schema, outputMode="Append", timeMode="None")
