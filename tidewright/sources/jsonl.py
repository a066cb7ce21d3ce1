"""JSON-lines files of bars and funding rows, and whole-JSON panel files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.bars import FIELDS, finite
from tidewright.operators.quality import timestamp_style, to_epoch_ms

BAR_JSON = "stream string, timestamp string, open string, high string, low string, close string, volume string"
FUNDING_JSON = "stream string, timestamp string, fundingRate string, markPrice string"


def format_bars(rows: DataFrame, style: str = "iso") -> DataFrame:
    """One JSON line per bar, the stamp as ISO text, epoch seconds or epoch milliseconds."""
    stamp = {"iso": F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), "ms": F.expr("us div 1000"), "s": F.expr("us div 1000000")}[style]
    return rows.select(F.to_json(F.struct("stream", stamp.alias("timestamp"), *FIELDS)).alias("value"))


def write_bars(rows: DataFrame, path: str, style: str = "iso", mode: str = "error") -> None:
    format_bars(rows, style).write.mode(mode).text(path)


def parse_bars(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(bars, counts)`` of a text column ``value``: valid bars with ``us``, and how many lines were
    blank, broken or invalid. Nothing raises; numbers may be strings."""
    j = F.from_json("value", BAR_JSON)
    rows = lines.withColumn("j", j).withColumn("blank", F.length(F.trim("value")) == 0)
    nums = {c: finite(F.col(f"j.{c}").try_cast("double")) for c in FIELDS}
    us = F.coalesce(F.unix_micros(F.try_to_timestamp(F.when(timestamp_style(F.col("j.timestamp")) == "iso", F.col("j.timestamp")))), to_epoch_ms(F.col("j.timestamp")) * 1000)
    rows = rows.select("blank", F.col("j.stream").alias("stream"), us.alias("us"), timestamp_style(F.col("j.timestamp")).alias("style"), *[x.alias(c) for c, x in nums.items()])
    o, h, lo, c, v = (F.col(x) for x in FIELDS)
    ok = F.coalesce(F.col("us").isNotNull() & (o > 0) & (lo > 0) & (c > 0) & (v >= 0) & (h >= F.greatest(o, c, lo)) & (lo <= F.least(o, c)), F.lit(False))
    counts = rows.agg(F.count_if("blank").alias("blank"), F.count_if(~F.col("blank") & ~ok).alias("invalid"), F.count_if(ok).alias("valid"))
    return rows.where(ok).drop("blank"), counts


def read_bars(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_bars(spark.read.text(path))


def parse_funding(lines: DataFrame) -> DataFrame:
    """Funding rows of a text column; rows without stamp or rate are dropped, the mark may be missing."""
    j = lines.select(F.from_json("value", FUNDING_JSON).alias("j"))
    return j.select(F.col("j.stream").alias("stream"), (to_epoch_ms(F.col("j.timestamp")) * 1000).alias("us"), finite(F.col("j.fundingRate").try_cast("double")).alias("rate"), finite(F.col("j.markPrice").try_cast("double")).alias("mark")).where("us is not null and rate is not null")


def format_funding(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("stream", F.expr("us div 1000").alias("timestamp"), F.col("rate").alias("fundingRate"), F.col("mark").alias("markPrice"))).alias("value"))


def parse_panel(texts: DataFrame, field: str = "oiVal") -> DataFrame:
    """``(symbol, ms, value)`` of documents ``{"symbols": {name: {"t0", "stepMs", field: [...]}}}``;
    values that are not positive are missing."""
    shape = f"symbols map<string, struct<t0: bigint, stepMs: bigint, {field}: array<double>>>"
    one = texts.select(F.explode(F.from_json("value", shape)["symbols"]).alias("symbol", "s"))
    flat = one.select("symbol", "s", F.posexplode(f"s.{field}").alias("i", "value"))
    return flat.where("value > 0").select("symbol", (F.col("s.t0") + F.col("i") * F.col("s.stepMs")).alias("ms"), "value")


def append_json(rows: DataFrame, path: str) -> None:
    """Append-only journal of JSON lines."""
    rows.write.mode("append").json(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Replace a JSON folder; readers see the old or the new one, by the committer's rename."""
    rows.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
