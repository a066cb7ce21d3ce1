"""Problem 2: totals and means over trailing calendar periods, days without activity included."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.spikes import FIRST_US
from tidewright.session import table

#: Sums are rounded to as many decimals as the readings have, so that the order of summation cannot show.
VOLUME_DECIMALS, CLOSE_DECIMALS = 4, 9


def latest_bars(candles: DataFrame) -> DataFrame:
    """One row per stream and stamp, the one ingested last (then the highest row_id).

    Rows without a stamp, or with one before 1980 (wrong unit), are left aside.
    """
    rows = candles.select("row_id", "stream", F.unix_micros("ts").alias("us"), "close", "volume", "ingested_at").where(F.col("us") >= FIRST_US)
    last = Window.partitionBy("stream", "us").orderBy(F.col("ingested_at").desc_nulls_last(), F.col("row_id").desc())
    nan = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("close", "volume")]
    return rows.withColumn("rn", F.row_number().over(last)).where("rn = 1").select("stream", "us", *nan)


def rolling_totals(candles: DataFrame, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """For every stream and UTC day from its first to its last bar: per period the sum and mean
    of volume and the mean of close over that many days up to and with the day.

    Each daily total is exploded onto the output days it influences and summed there, together
    with the calendar rows, which bring zeros; there is no window over a whole stream.
    A stream's many bars are first reduced to days, partly before the shuffle.

    Each bar counts once (see ``latest_bars``). Null values count in neither sum nor mean; a
    period without values has volume sum 0 and null means. Empty input gives no rows.
    """
    day = F.expr("cast(us div 86400000000 as int)")
    daily = latest_bars(candles).groupBy("stream", day.alias("day")).agg(
        F.round(F.sum("volume"), VOLUME_DECIMALS).alias("vs"), F.count("volume").alias("vn"), F.round(F.sum("close"), CLOSE_DECIMALS).alias("cs"), F.count("close").alias("cn")
    )
    ends = daily.groupBy("stream").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    both = daily.join(ends.select(F.col("stream").alias("s"), "last"), F.col("stream").eqNullSafe(F.col("s"))).drop("s")
    longest = max(periods)
    spread = both.select("stream", F.explode(F.sequence("day", F.least(F.col("day") + longest - 1, F.col("last")))).alias("out"), "day", "vs", "vn", "cs", "cn")
    zero = F.lit(0).cast("bigint")
    none = F.lit(None).cast("double")
    calendar = ends.select("stream", F.explode(F.sequence("first", "last")).alias("out"), F.lit(None).cast("int").alias("day"), none.alias("vs"), zero.alias("vn"), none.alias("cs"), zero.alias("cn"))
    age = F.col("out") - F.col("day")
    sums = []
    for p in periods:
        near = lambda c, p=p: F.when(age < p, F.col(c))
        sums += [F.coalesce(F.round(F.sum(near("vs")), VOLUME_DECIMALS), F.lit(0.0)).alias(f"volume_sum_{p}d"), F.sum(near("vn")).alias(f"vn{p}"), F.round(F.sum(near("cs")), CLOSE_DECIMALS).alias(f"cs{p}"), F.sum(near("cn")).alias(f"cn{p}")]
    out = spread.unionByName(calendar).groupBy("stream", "out").agg(*sums)
    cols = []
    for p in periods:
        cols += [F.col(f"volume_sum_{p}d"), F.when(F.col(f"vn{p}") > 0, F.col(f"volume_sum_{p}d") / F.col(f"vn{p}")).alias(f"volume_mean_{p}d"), F.when(F.col(f"cn{p}") > 0, F.col(f"cs{p}") / F.col(f"cn{p}")).alias(f"close_mean_{p}d")]
    return out.select("stream", F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("out")), "yyyy-MM-dd").alias("day"), *cols)


def p2_rolling_totals(spark, sf_dir: str) -> DataFrame:
    return rolling_totals(table(spark, sf_dir, "candles"))


P2_SQL = """
with b as (select stream, epoch_us(ts) us, close, volume,
    row_number() over (partition by stream, ts order by ingested_at desc nulls last, row_id desc) rn
  from candles where ts >= timestamptz '1980-01-01 00:00:00+00'),
d as (select stream, (us // 86400000000)::int d, round(sum(volume), 4) vs, count(volume) vn, round(sum(close), 9) cs, count(close) cn
  from b where rn = 1 group by all),
e as (select stream, min(d) a, max(d) z from d group by 1),
cal as (select stream, unnest(generate_series(a, z))::int d from e),
p as (select cal.stream, cal.d,
    coalesce(round(sum(vs) filter (cal.d - d.d < 7), 4), 0) v7, sum(vn) filter (cal.d - d.d < 7) vn7,
    round(sum(cs) filter (cal.d - d.d < 7), 9) c7, sum(cn) filter (cal.d - d.d < 7) cn7,
    coalesce(round(sum(vs), 4), 0) v30, sum(vn) vn30, round(sum(cs), 9) c30, sum(cn) cn30
  from cal left join d on d.stream = cal.stream and d.d between cal.d - 29 and cal.d group by 1, 2)
select stream, strftime(date '1970-01-01' + d, '%Y-%m-%d') as day, v7 as volume_sum_7d, case when vn7 > 0 then v7 / vn7 end as volume_mean_7d,
  case when cn7 > 0 then c7 / cn7 end as close_mean_7d, v30 as volume_sum_30d, case when vn30 > 0 then v30 / vn30 end as volume_mean_30d,
  case when cn30 > 0 then c30 / cn30 end as close_mean_30d
from p
"""
