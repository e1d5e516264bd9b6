"""Incremental fits on a stream: each micro-batch is one fit aggregate, merged into a running state."""

from __future__ import annotations

import pickle

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import number


class PartialFit:
    """A foreachBatch sink that partial-fits an estimator; a batch that is replayed counts once.

    With `state`, a folder that outlives the driver, each batch leaves one row
    (batch_id, state) there, and a sink on the same folder goes on from the last one.
    Without it, a restart from the stream's checkpoint would begin with an empty
    estimator; start() therefore keeps the state beside the checkpoint.
    """

    def __init__(self, estimator, features: list[str], state: str | None = None):
        self.estimator, self.features, self.last_batch, self.state = estimator, features, -1, None
        if state is not None:
            self._resume(state)

    def _resume(self, state: str) -> None:
        self.state = state
        spark = SparkSession.getActiveSession()
        try:
            last = spark.read.parquet(f"{state}/*").orderBy(F.desc("batch_id")).first()
        except AnalysisException:  # no batch has been counted yet
            return
        if last is not None:
            self.last_batch = last["batch_id"]
            self.estimator.__dict__.update(pickle.loads(bytes(last["state"])))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last_batch or batch.isEmpty():
            return
        self.estimator.partial_fit(batch, self.features)
        self.last_batch = batch_id
        if self.state is not None:
            row = [(batch_id, bytearray(pickle.dumps(self.estimator.__dict__)))]
            batch.sparkSession.createDataFrame(row, "batch_id long, state binary").coalesce(1).write.mode("overwrite").parquet(f"{self.state}/batch-{batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        trigger = trigger or {"availableNow": True}
        if self.state is None:
            self._resume(f"{checkpoint.rstrip('/')}-estimator")
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def windowed_stats(stream: DataFrame, ts: str, value: str, window: str, delay: str) -> DataFrame:
    """Count, mean and population variance of each event-time window; rows later than `delay` are dropped by the watermark."""
    x = number(stream, value)
    timed = stream.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"))
    return timed.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var")).select("w.start", "w.end", "n", "mean", "var")
