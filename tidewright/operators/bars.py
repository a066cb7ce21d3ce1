"""Bars of many sources, their order, and chunks of it that windows can run on in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.spikes import FIRST_US
from tidewright.session import cut, join_small, written_once

FIELDS = ("open", "high", "low", "close", "volume")
#: Bars in one chunk of a source, and the bars before it that are computed along and dropped.
CHUNK, HALO = 16_384, 1_024


def finite(x: Column) -> Column:
    """``x`` where it is a finite number, else null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def valid_bar() -> Column:
    """Prices positive, volume not negative, high and low around open and close, nothing missing."""
    o, h, lo, c, v = (finite(F.col(x).cast("double")) for x in FIELDS)
    ok = (o > 0) & (h > 0) & (lo > 0) & (c > 0) & (v >= 0) & (h >= F.greatest(o, c, lo)) & (lo <= F.least(o, c))
    return F.coalesce(ok, F.lit(False))


def normalize_bars(candles: DataFrame) -> DataFrame:
    """Valid rows with a plausible stamp: stream, us (microseconds), the five fields, row_id, ingested_at."""
    rows = candles.where(valid_bar()).select("row_id", "stream", F.unix_micros("ts").alias("us"), *[F.col(c).cast("double").alias(c) for c in FIELDS], "ingested_at")
    return rows.where(F.col("us") >= FIRST_US)


def dedupe_bars(rows: DataFrame, keep: str = "last") -> DataFrame:
    """One row per stream and stamp: the one that came last (files) or first (live store)."""
    came = [F.col("ingested_at"), F.col("row_id")]
    order = [c.desc_nulls_last() for c in came] if keep == "last" else [c.asc_nulls_last() for c in came]
    w = Window.partitionBy("stream", "us").orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def merge_bars(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows over existing ones of the same stream and stamp."""
    both = existing.withColumn("prio", F.lit(0)).unionByName(incoming.withColumn("prio", F.lit(1)))
    w = Window.partitionBy("stream", "us").orderBy(F.col("prio").desc())
    return both.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "prio")


def drop_unclosed(rows: DataFrame, interval_us: Column | int, now_us: int) -> DataFrame:
    """Without bars whose interval has not ended by ``now_us``."""
    return rows.where(F.col("us") + interval_us <= now_us)


def bars(candles: DataFrame) -> DataFrame:
    """Valid bars, one per stream and stamp, last one wins: ``(stream, us, open .. volume)``."""
    return dedupe_bars(normalize_bars(candles)).select("stream", "us", *FIELDS)


def indexed(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``rows`` of ``(stream, us, ...)`` with ``i``, the position in the stream from 0, and
    ``ret``-ready order. Sources are numbered in chunks of time in parallel; the chunks' starts
    come from one count per chunk."""
    rows = cut(rows)
    spans = cut(
        rows.groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("a"), F.max("us").alias("z"), F.percentile_approx("us", F.array(F.lit(0.02), F.lit(0.98)), F.lit(200)).alias("q"))
        .select(F.col("stream").alias("ss"), F.when(F.col("n") > chunk, F.greatest(F.lit(1), F.ceil((F.col("q")[1] - F.col("q")[0]) * chunk / (F.col("n") * 0.96)))).otherwise(F.lit(1 << 62)).cast("bigint").alias("width"))
    )
    cells = join_small(rows, spans, F.col("stream").eqNullSafe(F.col("ss"))).withColumn("cell", F.expr("us div width")).drop("ss", "width")
    before = Window.partitionBy("stream").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(cells.groupBy("stream", "cell").agg(F.count(F.lit(1)).alias("n")).select(F.col("stream").alias("ss"), F.col("cell").alias("sc"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    numbered = cells.withColumn("rn", F.row_number().over(Window.partitionBy("stream", "cell").orderBy("us")) - 1)
    out = join_small(numbered, starts, F.col("stream").eqNullSafe(F.col("ss")) & (F.col("cell") == F.col("sc")))
    return out.withColumn("i", F.col("start") + F.col("rn")).drop("ss", "sc", "start", "rn", "cell")


def numbered(candles: DataFrame) -> DataFrame:
    """``indexed(bars(candles))``: the valid bars of a table in order. They are written once, and every query of
    the session over the same files reads that table; columns others do not need are not read."""
    return written_once(candles, "numbered bars", lambda c: indexed(bars(c)))


def with_halo(rows: DataFrame, halo: int = HALO, chunk: int = CHUNK, ahead: int = 0) -> DataFrame:
    """Rows of ``indexed`` divided into parts of ``chunk`` positions, each preceded by copies of
    the ``halo`` positions before it and followed by the ``ahead`` after it. ``own`` tells a part's rows from the copies: what needs no
    more than ``halo`` earlier rows is right for own rows, and one hot source is many groups."""
    part = F.expr(f"i div {chunk}")
    at = F.expr(f"i % {chunk}")
    places = [part, F.when(at >= chunk - halo, part + 1), F.when((at < ahead) & (part > 0), part - 1)]
    return rows.withColumn("part", F.explode(F.array_compact(F.array(*places)))).withColumn("own", F.col("part") == part)


def own(rows: DataFrame) -> DataFrame:
    return rows.where("own").drop("own", "part")


def order():
    """A chunk's bars in order."""
    return Window.partitionBy("stream", "part").orderBy("i")


def last_k(k: int, back: int = 0):
    """The frame of the ``k`` rows that end ``back`` rows ago."""
    return order().rowsBetween(-(k - 1) - back, -back)


def full(agg: Column, of: str, k: int, back: int = 0) -> Column:
    """A rolling aggregate that is null unless all ``k`` values of ``of`` are there."""
    w = last_k(k, back)
    return F.when(F.count(of).over(w) == k, agg.over(w))


def bar_returns(rows: DataFrame) -> DataFrame:
    """Adds ``ret``, close to close, 0 at the first bar of a stream."""
    return rows.withColumn("ret", F.when(F.col("i") == 0, 0.0).otherwise(F.col("close") / F.lag("close").over(order()) - 1))


def log_returns(rows: DataFrame) -> DataFrame:
    return rows.withColumn("log_ret", F.when(F.col("i") == 0, 0.0).otherwise(F.ln(F.col("close") / F.lag("close").over(order()))))


def resample_bars(rows: DataFrame, factor: int, keep_incomplete: bool = False) -> DataFrame:
    """Every ``factor`` consecutive bars of ``indexed`` rows made one; a short last group only if asked for."""
    g = rows.groupBy("stream", F.expr(f"i div {factor}").alias("g")).agg(
        F.min("us").alias("us"), F.min_by("open", "i").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "i").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n"),
    )
    return g if keep_incomplete else g.where(F.col("n") == factor)


def running(rows: DataFrame, sums: dict[str, Column], peaks: dict[str, str] | None = None) -> DataFrame:
    """Own rows of ``with_halo`` with sums from the start of the stream up to each row, and in
    ``peaks`` the largest value so far of such a sum (0 at least).

    Sums run inside each part; one row of totals per part, summed over the parts before, is
    added to them, so that no task walks a whole stream.
    """
    rows = own_rows(rows)
    rows = cut(rows.withColumns({n: F.sum(c).over(order().rowsBetween(Window.unboundedPreceding, 0)) for n, c in sums.items()}))
    names, tops = list(sums), peaks or {}
    before = Window.partitionBy("stream").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy("stream", "part").agg(*[F.max_by(n, "i").alias(n) for n in names], *[F.max(n).alias(f"top_{n}") for n in set(tops.values())])
    per = per.withColumns({f"off_{n}": F.coalesce(F.sum(n).over(before), F.lit(0.0)) for n in names})
    per = per.withColumns({f"peak_{n}": F.greatest(F.lit(0.0), F.coalesce(F.max(F.col(f"off_{n}") + F.col(f"top_{n}")).over(before), F.lit(0.0))) for n in set(tops.values())})
    per = cut(per.select(F.col("stream").alias("ps"), F.col("part").alias("pp"), *[f"off_{n}" for n in names], *[f"peak_{n}" for n in set(tops.values())]))
    out = join_small(rows, per, F.col("stream").eqNullSafe(F.col("ps")) & (F.col("part") == F.col("pp"))).drop("ps", "pp")
    out = out.withColumns({n: F.col(n) + F.col(f"off_{n}") for n in names})
    out = out.withColumns({p: F.greatest(F.col(f"peak_{n}"), F.max(n).over(order().rowsBetween(Window.unboundedPreceding, 0))) for p, n in tops.items()})
    return out.drop(*[f"off_{n}" for n in names], *[f"peak_{n}" for n in set(tops.values())])


def own_rows(rows: DataFrame) -> DataFrame:
    return rows.where("own").drop("own")


def find_gaps(rows: DataFrame, interval_us: Column) -> DataFrame:
    """Neighbouring bars further apart than their interval: ``(stream, from_us, to_us, missing)``;
    rows as from ``with_halo``."""
    d = rows.withColumn("prev", F.lag("us").over(order())).withColumn("step", interval_us).where("own and us - prev > step")
    return d.select("stream", F.col("prev").alias("from_us"), F.col("us").alias("to_us"), (F.round((F.col("us") - F.col("prev")) / F.col("step")).cast("bigint") - 1).alias("missing"))


def summarize_bars(rows: DataFrame) -> DataFrame:
    """Count, extremes, first and last close and total volume of each stream."""
    return rows.groupBy("stream").agg(
        F.count(F.lit(1)).alias("bars"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.min("low").alias("min_low"), F.max("high").alias("max_high"),
        F.min_by("close", "us").alias("first_close"), F.max_by("close", "us").alias("last_close"), F.round(F.sum("volume"), 4).alias("volume"),
    )


#: The common start of the SQL twins: b = valid bars, last one wins, numbered within the stream.
BARS_SQL = """
v as (select * from candles where ts >= timestamptz '1980-01-01 00:00:00+00' and open > 0 and high > 0 and low > 0 and close > 0 and volume >= 0
  and high >= greatest(open, close, low) and low <= least(open, close)),
d as (select *, row_number() over (partition by stream, ts order by ingested_at desc nulls last, row_id desc) rn from v),
b as (select stream, epoch_us(ts) us, open, high, low, close, volume, row_number() over (partition by stream order by ts) - 1 i from d where rn = 1),
r as (select *, case when i = 0 then 0.0 else close / lag(close) over (partition by stream order by i) - 1 end ret from b)
"""
