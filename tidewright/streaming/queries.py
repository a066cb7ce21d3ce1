"""Structured Streaming twins of the batch operators: file source, watermark, state, file sink."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tidewright.operators.bars import bars
from tidewright.operators.consensus import SETTLE_SQL
from tidewright.session import shared_dir, table


def _place(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/tidewright-stream-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def open_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over a folder, or over one file, which the source takes only as a pattern."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a query over all that is there, each micro-batch appended to Parquet with its number,
    and read the result; a batch that is run again replaces its own rows."""
    spark, path = stream.sparkSession, _place(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema.add("batch", IntegerType())).option("basePath", f"{path}/out").parquet(f"{path}/out")


def bars_from_events(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling bars of the event values per type; rows later than the watermark are dropped."""
    e = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withWatermark("ts", late)
    came = F.struct("ts", "event_id")
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(
        F.min_by("value", came).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", came).alias("close"), F.count(F.lit(1)).alias("volume")
    ).select("event_type", F.unix_micros("w.start").alias("us"), "open", "high", "low", "close", "volume")


def latest(rows: DataFrame, *key: str) -> DataFrame:
    """The last update of every key."""
    w = Window.partitionBy(*key).orderBy(F.col("batch").desc())
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "batch")


def first_wins(candles: DataFrame, late: str = "30 days") -> DataFrame:
    """Rows of one stream and stamp made one: the row that arrived first (the smallest row_id). The state
    holds one row a stamp and lets it go behind the watermark; a batch that brings an earlier arrival
    updates the row, so the last update counts. Rows without a stamp are left out."""
    came = candles.where("ts is not null").withWatermark("ts", late)
    kept = F.min_by(F.struct("row_id", "open", "high", "low", "close", "volume"), "row_id")
    return came.groupBy("stream", "ts").agg(kept.alias("r")).select("stream", "ts", "r.*")


def ema_alerts(events: DataFrame, decay: float = 0.9, factor: float = 5.0) -> DataFrame:
    """Events whose value exceeds ``factor`` times the exponential mean of their type's earlier
    values; the mean lives in the state store. Rows are put in order inside a micro-batch, whose size
    the source's ``maxFilesPerTrigger`` bounds; over batches they must come in order."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        mean = state.get[0] if state.exists else None
        keep = []
        for k, v in enumerate(pdf["value"].to_numpy()):
            if mean is not None and v > factor * mean:
                keep.append((k, mean))
            mean = v if mean is None else decay * mean + (1 - decay) * v
        state.update((float(mean),))
        at = [k for k, _ in keep]
        yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy()[at], "event_type": key[0], "value": pdf["value"].to_numpy()[at], "mean": np.array([m for _, m in keep], float)})

    rows = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return rows.groupBy("event_type").applyInPandasWithState(step, "event_id bigint, event_type string, value double, mean double", "mean double", "append", "NoTimeout")


def settle_stream(rows: DataFrame, up: float = 0.02, down: float = 0.01, horizon: int = 24) -> DataFrame:
    """Settlement of a trade per bar by later bars' highs and lows. The state of a stream is its
    bar count and at most ``horizon`` open trades; a bar settles before it opens its own. Bars must come
    in order over micro-batches (inside one they are put in order); late ones need a buffer before."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values("us")
        n, ids, closes = state.get if state.exists else (0, [], [])
        ids, closes, out = list(ids), list(closes), []
        for hi, lo, c in zip(pdf["high"].to_numpy(), pdf["low"].to_numpy(), pdf["close"].to_numpy(), strict=True):
            kept_i, kept_c = [], []
            for i, entry in zip(ids, closes, strict=True):
                top, bottom = entry * (1 + up), entry * (1 - down)
                if n - i > horizon:
                    continue
                if hi >= top or lo <= bottom:
                    out.append((key[0], i, n, int(hi >= top and lo > bottom)))
                else:
                    kept_i.append(i)
                    kept_c.append(entry)
            ids, closes, n = [*kept_i, n], [*kept_c, float(c)], n + 1
        state.update((n, ids, closes))
        yield pd.DataFrame(out, columns=["stream", "i", "settled_at", "outcome"])

    return rows.groupBy("stream").applyInPandasWithState(step, "stream string, i bigint, settled_at bigint, outcome int", "n bigint, ids array<bigint>, closes array<double>", "append", "NoTimeout")


def q_bars(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    out = run_to_end(bars_from_events(open_stream(spark, path, spark.read.parquet(path).schema)), "update")
    return latest(out, "event_type", "us")


def q_first_wins(spark, sf_dir):
    path = f"{sf_dir}/candles.parquet"
    out = latest(run_to_end(first_wins(open_stream(spark, path, spark.read.parquet(path).schema)), "update"), "stream", "ts")
    return out.groupBy("stream").agg(F.count(F.lit(1)).alias("stamps"), F.unix_micros(F.max("ts")).alias("last_us"), F.sum("row_id").alias("row_ids"), F.max("close").alias("close"))


def q_alerts(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    out = run_to_end(ema_alerts(open_stream(spark, path, spark.read.parquet(path).schema)))
    return out.select("event_id", "event_type", "value", F.round("mean", 6).alias("mean"))


def q_settled(spark, sf_dir):
    place = _place(spark)
    rows = bars(table(spark, sf_dir, "candles"))
    rows.write.parquet(place)
    return run_to_end(settle_stream(open_stream(spark, place, rows.schema))).drop("batch")


BARS_STREAM_SQL = """select event_type, epoch_us(date_trunc('hour', ts)) as us, arg_min(value, {'a': ts, 'b': event_id}) as open, max(value) as high, min(value) as low,
  arg_max(value, {'a': ts, 'b': event_id}) as close, count(*) as volume from events group by 1, 2"""
FIRST_SQL = """select stream, count(*) as stamps, max(us) as last_us, sum(row_id)::bigint as row_ids, max(close) as close
from (select stream, epoch_us(ts) us, min(row_id) row_id, (arg_min({'c': close}, row_id)).c as close from candles where ts is not null group by 1, 2) group by 1"""

QUERIES = {
    "stream_bars": (q_bars, BARS_STREAM_SQL), "stream_first_wins": (q_first_wins, FIRST_SQL), "stream_ema_alerts": (q_alerts, None),
    "stream_settlement": (q_settled, SETTLE_SQL + " where outcome is not null"),
}
