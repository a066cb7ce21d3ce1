"""Row predicates, repairs and audits of bar and funding series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.bars import FIELDS, finite
from tidewright.session import join_small

WICK = 0.9


def is_valid_number(x: Column) -> Column:
    """Whether a string or number is a finite number."""
    return finite(x.try_cast("double")).isNotNull()


is_finite_number = is_valid_number


def is_valid_timestamp(x: Column) -> Column:
    return F.coalesce(F.length(F.trim(x.cast("string"))) > 0, F.lit(False))


def finite_or(x: Column, fallback: float = 0.0) -> Column:
    return F.coalesce(finite(x), F.lit(fallback))


finite_or_null = finite


def truncate_to_decimals(x: Column, decimals: int) -> Column:
    """Cut off toward zero, negative numbers too."""
    p = float(10**decimals)
    return F.signum(x) * F.floor(F.abs(x) * p) / p


def price_decimals(price: Column, min_movement: float = 1e-4, least: int = 2, most: int = 8) -> Column:
    """Decimals that make the grid ten times finer than the smallest movement of the price."""
    need = F.ceil(F.log10(F.lit(10 / min_movement)) - F.log10(price) - 1e-12)
    return F.least(F.lit(most), F.greatest(F.lit(least), need)).cast("int")


def price_grid(price: Column, **kw) -> Column:
    return F.pow(F.lit(10.0), -price_decimals(price, **kw))


def to_epoch_ms(x: Column) -> Column:
    """Milliseconds of a stamp given as epoch seconds, epoch milliseconds or ISO text; numbers
    under 1e12 are seconds."""
    n = finite(x.try_cast("double"))
    return F.coalesce(F.when(F.abs(n) < 1e12, n * 1000).otherwise(n), F.unix_millis(F.try_to_timestamp(x.cast("string"))).cast("double")).cast("bigint")


def timestamp_style(x: Column) -> Column:
    n = finite(x.try_cast("double"))
    return F.when(n.isNull(), "iso").when(F.abs(n) < 1e12, "s").otherwise("ms")


def is_implausible(max_wick: float = WICK) -> Column:
    lo, hi = F.least("open", "close"), F.greatest("open", "close")
    return F.coalesce((F.col("low") < lo * (1 - max_wick)) | (F.col("high") > hi * (1 + max_wick)), F.lit(False))


def repair(rows: DataFrame, max_wick: float = WICK) -> DataFrame:
    """Wicks beyond ``max_wick`` of the body are set to the body's end; ``repaired`` tells so.
    Repairing twice changes nothing. Bars with a missing price stay as they are."""
    whole = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    lo, hi = F.least("open", "close"), F.greatest("open", "close")
    low_bad, high_bad = whole & (F.col("low") < lo * (1 - max_wick)), whole & (F.col("high") > hi * (1 + max_wick))
    return rows.withColumns({"low": F.when(low_bad, lo).otherwise(F.col("low")), "high": F.when(high_bad, hi).otherwise(F.col("high")), "repaired": low_bad | high_bad})


def find_implausible_wicks(rows: DataFrame, max_wick: float = WICK) -> DataFrame:
    return rows.where(is_implausible(max_wick))


def audit_series(candles: DataFrame, manifest: DataFrame, now_us: int) -> DataFrame:
    """One row of integrity counters per stream, over its rows in order of arrival (row_id).

    Neighbours in order of arrival are found without a window over a whole stream: the order of
    arrival is divided into blocks of row ids, each block is a group, and one row per block
    links it to the next.
    """
    step = manifest.groupBy(F.col("stream").alias("ms")).agg(F.max("interval_ms").alias("interval_ms"))
    rows = candles.select("stream", "row_id", F.unix_micros("ts").alias("us"), *FIELDS)
    rows = join_small(rows, step, F.col("stream") == F.col("ms")).withColumn("block", F.expr("row_id div 65536"))
    inner = Window.partitionBy("stream", "block").orderBy("row_id")
    rows = rows.withColumn("prev_us", F.lag("us").over(inner)).withColumn("prev_close", F.lag("close").over(inner))
    ends = candles.select("stream", "row_id", F.unix_micros("ts").alias("us"), "close", F.expr("row_id div 65536").alias("block")).groupBy("stream", "block").agg(F.max_by(F.struct("us", "close"), "row_id").alias("e"))
    ends = ends.withColumn("e", F.lag("e").over(Window.partitionBy("stream").orderBy("block"))).select(F.col("stream").alias("es"), F.col("block").alias("eb"), "e")
    first = F.row_number().over(inner) == 1
    rows = rows.withColumn("first", first).join(ends, (F.col("stream") == F.col("es")) & (F.col("block") == F.col("eb")))
    pu, pc = F.when(F.col("first"), F.col("e.us")).otherwise(F.col("prev_us")), F.when(F.col("first"), F.col("e.close")).otherwise(F.col("prev_close"))
    o, h, lo, c, v = (F.col(x) for x in FIELDS)
    missing = F.col("us").isNull() | o.isNull() | h.isNull() | lo.isNull() | c.isNull() | v.isNull()
    yes = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    grid = F.col("interval_ms") * 1000
    counted = rows.groupBy("stream").agg(
        F.count(F.lit(1)).alias("rows"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), yes(missing).alias("missing_values"),
        yes((o <= 0) | (h <= 0) | (lo <= 0) | (c <= 0) | (v < 0)).alias("bad_numeric"), yes((h < lo) | (h < o) | (h < c) | (lo > o) | (lo > c)).alias("bad_ohlc"),
        yes(F.col("us") <= pu).alias("non_monotonic"), yes(F.col("us") % grid != 0).alias("misaligned"), yes(F.col("us") + grid > now_us).alias("unclosed"),
        yes(v == 0).alias("zero_volume"), F.min("low").alias("min_low"), F.max("high").alias("max_high"), F.max("volume").alias("max_volume"),
        F.round(F.max(F.when(pc > 0, F.abs(c / pc - 1))), 9).alias("max_abs_return"),
    )
    dup = candles.groupBy("stream", "ts").agg(F.count(F.lit(1)).alias("n")).where("ts is not null").groupBy(F.col("stream").alias("ds")).agg(F.sum(F.col("n") - 1).alias("duplicates"))
    return counted.join(dup, F.col("stream") == F.col("ds"), "left").drop("ds").withColumn("duplicates", F.coalesce("duplicates", F.lit(0)))


def audit_problems(audit: DataFrame) -> DataFrame:
    """The reasons against a series, as an array of names."""
    tests = {"no rows": F.col("rows") == 0, **{n.replace("_", " "): F.col(n) > 0 for n in ("missing_values", "bad_numeric", "bad_ohlc", "non_monotonic", "duplicates", "misaligned", "unclosed")}}
    return audit.withColumn("problems", F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])))


def funding_rows(funding: DataFrame) -> DataFrame:
    """Usable funding rows, one per stream and stamp: ``(stream, us, rate, mark)``."""
    rows = funding.select("stream", F.unix_micros("ts").alias("us"), finite(F.col("funding_rate")).alias("rate"), finite(F.col("mark_price")).alias("mark")).where("us is not null and rate is not null")
    return rows.groupBy("stream", "us").agg(F.max("rate").alias("rate"), F.max("mark").alias("mark"))


def audit_funding(funding: DataFrame, grid_ms: int = 28_800_000, tolerance_ms: int = 60_000, extreme: float = 0.01) -> DataFrame:
    """Grid audit per stream. Funding has a few rows a day, so a stream is a small group."""
    w = Window.partitionBy("stream").orderBy("us")
    d = funding_rows(funding).withColumn("dt", (F.col("us") - F.lag("us").over(w)) / 1000)
    half = grid_ms / 2
    k = F.round(F.col("dt") / half)
    off = F.abs(F.col("dt") - k * half) > tolerance_ms
    return d.groupBy("stream").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(off).alias("off_grid"), F.count_if(~off & (k == 1)).alias("steps_4h"), F.count_if(~off & (k == 2)).alias("steps_8h"),
        F.coalesce(F.sum(F.when(F.col("dt") > grid_ms + tolerance_ms, F.round(F.col("dt") / grid_ms) - 1)), F.lit(0.0)).cast("bigint").alias("missing_periods"),
        F.count_if(F.abs("rate") > extreme).alias("extreme_rates"), F.count_if(F.col("rate") == 0).alias("zero_rates"), F.count_if(F.col("rate") < 0).alias("negative"),
        F.round(F.avg("rate"), 9).alias("mean_rate"), F.round(F.avg(F.abs("rate")), 9).alias("mean_abs_rate"), F.round(F.percentile("dt", 0.5), 3).alias("median_step_ms"),
    )


def carry_on_bars(bars: DataFrame, funding: DataFrame, step_us: Column, period_us: int = 28_800_000_000, sign_flip: bool = False) -> DataFrame:
    """As-of join: each bar gets the funding rate most recently due at its stamp (inclusive),
    divided by the bars in a period; 0 before the first.

    Bars and funding rows meet in buckets of ten periods. Each bucket also holds the last rate
    due before it, taken from one row per bucket, so no group is a whole stream.
    """
    bucket = lambda c: F.expr(f"{c} div {period_us * 10}")
    f = funding_rows(funding).select("stream", "us", F.col("rate"))
    ends = f.groupBy("stream", bucket("us").alias("k")).agg(F.max_by("rate", "us").alias("rate"))
    spread = bars.select("stream", bucket("us").alias("k")).distinct().join(ends, ["stream", "k"], "left")
    carried = F.last("rate", ignorenulls=True).over(Window.partitionBy("stream").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    seeds = ends.select("stream", "k", "rate").unionByName(spread.select("stream", "k", F.lit(None).cast("double").alias("rate"))).groupBy("stream", "k").agg(F.max("rate").alias("rate"))
    seeds = seeds.withColumn("before", carried).where("before is not null").select("stream", (F.col("k") * (period_us * 10)).alias("us"), F.col("before").alias("rate"), F.lit(0).alias("kind"))
    every = bars.withColumn("kind", F.lit(2)).unionByName(f.withColumn("kind", F.lit(1)).unionByName(seeds), allowMissingColumns=True)
    order = Window.partitionBy("stream", bucket("us")).orderBy("us", "kind").rowsBetween(Window.unboundedPreceding, 0)
    per = F.greatest(F.lit(1.0), F.round(F.lit(period_us) / step_us))
    rate = F.coalesce(F.last("rate", ignorenulls=True).over(order), F.lit(0.0))
    return every.withColumn("carry", (-rate if sign_flip else rate) / per).where("kind = 2").drop("kind", "rate")
