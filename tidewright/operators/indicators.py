"""Technical indicators of each stream. Windows where the definition is a window; Arrow-fed
numpy over chunks where it is a recursion whose memory fades within the halo."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.bars import BARS_SQL, full, last_k, numbered, order, own, running, with_halo
from tidewright.operators.medians import exact_medians, exact_positions
from tidewright.session import cut, join_small, table

#: Enough earlier bars for a 100-bar exponential mean to forget its start beyond double precision.
LONG_HALO = 2048


def _clip(x, bound):
    return np.clip(x, -bound, bound)


def ema(x: np.ndarray, period: int, bound: float = 5000.0) -> np.ndarray:
    """Exponential mean seeded by the first ``period`` values' mean at position period - 1; zeros before."""
    out = np.zeros(len(x))
    if len(x) < period:
        return out
    a = 2 / (period + 1)
    y = float(_clip(x[:period].mean(), bound))
    out[period - 1] = y
    for i, v in enumerate(x[period:].tolist(), period):
        y = a * v + (1 - a) * y
        y = -bound if y < -bound else bound if y > bound else y
        out[i] = y
    return out


def wilder_rsi(close: np.ndarray, period: int = 14) -> np.ndarray:
    """Relative strength by Wilder's smoothing, NaN before position ``period``. The seed is the
    mean of the first ``period`` changes and the last of these enters once more."""
    out = np.full(len(close), np.nan)
    if len(close) <= period:
        return out
    change = np.diff(close)
    up, down = np.maximum(change, 0), np.maximum(-change, 0)
    g, s = up[:period].mean(), down[:period].mean()
    for i in range(period, len(close)):
        g, s = (g * (period - 1) + up[i - 1]) / period, (s * (period - 1) + down[i - 1]) / period
        out[i] = (50.0 if g <= 0 else 100.0) if s <= 0 else 100 - 100 / (1 + g / s)
    return out


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = close[:-1]
    return np.maximum.reduce([high[1:] - low[1:], np.abs(high[1:] - before), np.abs(low[1:] - before)])


def wilder_atr(high, low, close, period: int = 14, bound: float = 1000.0) -> np.ndarray:
    out = np.full(len(close), np.nan)
    if len(close) <= period:
        return out
    tr = true_range(high, low, close)
    y = min(tr[:period].mean(), bound)
    out[period] = y
    for i in range(period, len(tr)):
        y = min(max((y * (period - 1) + tr[i]) / period, 0.0), bound)
        out[i + 1] = y
    return out


def macd_diff(scaled: np.ndarray, fast: int = 8, slow: int = 21, signal: int = 5) -> np.ndarray:
    """MACD less its signal. The slow mean is read ``slow - fast`` bars late and the signal
    ``signal - 1`` bars late, as the alignment to the series' ends has it."""
    out = np.full(len(scaled), np.nan)
    if len(scaled) < slow + signal:
        return out
    gap, late = slow - fast, signal - 1
    line = _clip(ema(scaled, fast)[gap:] - ema(scaled, slow)[: len(scaled) - gap], 1000.0)
    sig = ema(line[: len(line) - late], signal)
    out[gap + late :] = line[late:] - sig
    return out


def stochastic_diff(high, low, close, period: int = 14, smooth: int = 3) -> np.ndarray:
    out = np.full(len(close), np.nan)
    if len(close) < period + 2 * smooth - 1:
        return out
    view = np.lib.stride_tricks.sliding_window_view
    top, bottom = view(high, period).max(1), view(low, period).min(1)
    span = top - bottom
    k = np.where(span > 0, (close[period - 1 :] - bottom) / np.where(span > 0, span, 1) * 100, 50.0).clip(0, 100)
    ks = ema(k, smooth)
    d = ema(ks[: len(ks) - smooth + 1], smooth)
    out[period + smooth - 2 :] = ks[smooth - 1 :] - d
    return out


def adx(high, low, close, period: int = 14) -> np.ndarray:
    out = np.full(len(close), np.nan)
    if len(close) <= period:
        return out
    up, down = np.diff(high), -np.diff(low)
    plus = np.where((up > down) & (up > 0), up, 0.0)
    minus = np.where((down > up) & (down > 0), down, 0.0)
    tr = ema(true_range(high, low, close), period)
    safe = np.where(tr > 0, tr, 1)
    p = np.where(tr > 0, ema(plus, period) / safe * 100, 0.0)
    m = np.where(tr > 0, ema(minus, period) / safe * 100, 0.0)
    total = p + m
    dx = np.where(total > 0, np.abs(p - m) / np.where(total > 0, total, 1) * 100, 50.0)
    out[period:] = ema(dx, period)[period - 1 :].clip(0, 100)
    return out


RECURSIVE = ("rsi", "macd_diff", "atr", "ema100", "stochastic_diff", "adx")


def recursive_frame(pdf: pd.DataFrame) -> pd.DataFrame:
    """The recursive indicators of one run of bars in order."""
    h, lo, c = (pdf[x].to_numpy(float) for x in ("high", "low", "close"))
    middle = float(pdf["middle"].iloc[0]) or 1.0
    e = ema(c, 100)
    return pdf.assign(rsi=wilder_rsi(c), macd_diff=macd_diff(c / middle), atr=wilder_atr(h, lo, c), ema100=np.where(np.arange(len(c)) >= 99, e, np.nan), stochastic_diff=stochastic_diff(h, lo, c), adx=adx(h, lo, c))


def recursive_indicators(candles: DataFrame) -> DataFrame:
    """RSI, MACD, ATR, EMA(100), stochastic and ADX of every bar, null while undefined.

    Chunks of a stream are computed apart, each over LONG_HALO earlier bars first: the recursions
    forget their start geometrically, so that the rows kept equal those of one long run.
    """
    rows = numbered(candles)
    mid = cut(exact_medians(rows, "stream", {"middle": F.col("close")}, upper=True).withColumnRenamed("stream", "ms"))
    rows = join_small(rows, mid, F.col("stream").eqNullSafe(F.col("ms")))
    parts = with_halo(rows, LONG_HALO).select("stream", "part", "own", "i", "us", "high", "low", "close", "middle")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = recursive_frame(pdf.sort_values("i"))
        return out.loc[out["own"], ["stream", "us", *RECURSIVE]]

    schema = "stream string, us bigint, " + ", ".join(f"{c} double" for c in RECURSIVE)
    return parts.groupBy("stream", "part").applyInPandas(run, schema)


def bollinger_b(k: int = 20, width: float = 2.0) -> Column:
    """Where the close lies between the bands, 0 to 1; one half where the bands meet."""
    m, s = full(F.avg("close"), "close", k), full(F.stddev_pop("close"), "close", k)
    return F.when(m.isNotNull(), F.when(s > 1e-12, (F.col("close") - (m - width * s)) / (2 * width * s)).otherwise(0.5))


def williams_r(k: int = 14) -> Column:
    w = last_k(k)
    hi, lo = F.max("high").over(w), F.min("low").over(w)
    return F.when(F.count("close").over(w) == k, F.when(hi > lo, (hi - F.col("close")) / (hi - lo) * -100).otherwise(-50.0))


def stochastic_k(k: int = 14) -> Column:
    w = last_k(k)
    hi, lo = F.max("high").over(w), F.min("low").over(w)
    return F.when(F.count("close").over(w) == k, F.when(hi > lo, (F.col("close") - lo) / (hi - lo) * 100).otherwise(50.0))


def cci(k: int = 20, bound: float = 1000.0) -> Column:
    """Typical price against its mean in mean absolute deviations; reads column ``typical``."""
    w = last_k(k)
    m = F.avg("typical").over(w)
    dev = F.aggregate(F.collect_list("typical").over(w), F.lit(0.0), lambda s, x: s + F.abs(x - m)) / k
    v = F.when(dev > 1e-12, (F.col("typical") - m) / (0.015 * dev)).otherwise(0.0)
    return F.when(F.count("typical").over(w) == k, F.greatest(F.lit(-bound), F.least(F.lit(bound), v)))


def window_indicators(candles: DataFrame) -> DataFrame:
    rows = with_halo(numbered(candles), 64).withColumn("typical", (F.col("high") + F.col("low") + F.col("close")) / 3)
    rows = rows.withColumns({"bollinger_b": bollinger_b(), "williams_r": williams_r(), "stochastic_k": stochastic_k(), "cci": cci()})
    return own(rows).select("stream", "us", *[F.round(c, 6).alias(c) for c in ("bollinger_b", "williams_r", "stochastic_k", "cci")])


def on_balance_volume(candles: DataFrame, bound: float = 1e9) -> DataFrame:
    """Volume summed with the sign of the close's change, held within ``bound``; sums run in
    chunks (see ``running``)."""
    rows = with_halo(numbered(candles), 1)
    rows = rows.withColumn("signed", F.coalesce(F.signum(F.col("close") - F.lag("close").over(order())), F.lit(0.0)) * F.col("volume"))
    out = running(rows, {"obv": F.col("signed")})
    return out.select("stream", "us", F.round(F.greatest(F.lit(-bound), F.least(F.lit(bound), F.col("obv"))), 4).alias("obv"))


def robust_normalized(rows: DataFrame, recent: int = 3, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """``(stream, i, x, normalized)`` of the last ``recent`` closes of every stream: scaled to [0, 1] between the
    values at the 5th and 95th percentile's positions, widened to hold the recent ones, cut to 4
    decimals; 0.5 where these are one value. Positions are exact and no stream is gathered in a task."""
    at = {"lo": f"floor({low} * total)", "hi": f"ceil({high} * total) - 1"}
    ends = cut(exact_positions(rows, "stream", F.col("close"), at).withColumnRenamed("stream", "es"))
    w = Window.partitionBy("stream").orderBy(F.col("i").desc())
    last = rows.select("stream", "i", F.col("close").alias("x")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= recent)
    j = join_small(last, ends, F.col("stream").eqNullSafe(F.col("es")))
    every = Window.partitionBy("stream")  # the recent ones
    j = j.withColumn("a", F.least("lo", F.min("x").over(every))).withColumn("z", F.greatest("hi", F.max("x").over(every)))
    scaled = (F.col("x") - F.col("a")) / (F.col("z") - F.col("a"))
    return j.select("stream", "i", "x", F.when(F.col("z") > F.col("a"), F.floor(scaled * 1e4) / 1e4).otherwise(0.5).alias("normalized"))


def interleave(a: Column, b: Column) -> Column:
    """a1, b1, a2, b2, ... and then the rest of the longer one."""
    n = F.least(F.size(a), F.size(b))
    paired = F.flatten(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.array(x, y)))
    return F.concat(paired, F.slice(a, n + 1, F.size(a)), F.slice(b, n + 1, F.size(b)))


def q_normalized(spark, sf_dir):
    return robust_normalized(numbered(table(spark, sf_dir, "candles")))


def q_interleaved(spark, sf_dir):
    """The last five closes of every stream alternating with its last three volumes, the newest first."""
    w = Window.partitionBy("stream").orderBy(F.col("i").desc())
    last = numbered(table(spark, sf_dir, "candles")).select("stream", "i", "close", "volume").withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    listed = lambda c, k: F.transform(F.sort_array(F.collect_list(F.when(F.col("rn") <= k, F.struct("rn", F.col(c).alias("x"))))), lambda s: s["x"])
    both = last.groupBy("stream").agg(interleave(listed("close", 5), listed("volume", 3)).alias("v"))
    return both.select("stream", F.posexplode("v").alias("place", "x"))


def q_window(spark, sf_dir):
    return window_indicators(table(spark, sf_dir, "candles"))


def q_recursive(spark, sf_dir):
    out = recursive_indicators(table(spark, sf_dir, "candles"))
    return out.select("stream", "us", *[F.round(F.when(~F.isnan(c), F.col(c)), 6).alias(c) for c in RECURSIVE])


def q_obv(spark, sf_dir):
    return on_balance_volume(table(spark, sf_dir, "candles"))




WINDOW_SQL = f"""with {BARS_SQL}, t as (select *, (high + low + close) / 3 typ from b),
l as (select *, list(typ) over w20 tl, count(*) over w20 n20, count(*) over w14 n14, avg(close) over w20 m, stddev_pop(close) over w20 s, avg(typ) over w20 tm,
  max(high) over w14 hi, min(low) over w14 lo from t
  window w20 as (partition by stream order by i rows between 19 preceding and current row), w14 as (partition by stream order by i rows between 13 preceding and current row)),
k as (select *, list_sum(list_transform(tl, lambda x: abs(x - tm))) / 20 dev from l)
select stream, us, round(case when n20 = 20 then case when s > 1e-12 then (close - (m - 2 * s)) / (4 * s) else 0.5 end end, 6) as bollinger_b,
  round(case when n14 = 14 then case when hi > lo then (hi - close) / (hi - lo) * -100 else -50 end end, 6) as williams_r,
  round(case when n14 = 14 then case when hi > lo then (close - lo) / (hi - lo) * 100 else 50 end end, 6) as stochastic_k,
  round(case when n20 = 20 then greatest(-1000, least(1000, case when dev > 1e-12 then (typ - tm) / (0.015 * dev) else 0 end)) end, 6) as cci from k"""

OBV_SQL = f"""with {BARS_SQL}, s as (select *, coalesce(sign(close - lag(close) over (partition by stream order by i)), 0) * volume sv from b)
select stream, us, round(greatest(-1e9, least(1e9, sum(sv) over (partition by stream order by i))), 4) as obv from s"""

NORMALIZED_SQL = f"""with {BARS_SQL}, l as (select stream, list(close order by close) v, count(*) n from b group by 1), e as (select stream, v[floor(0.05 * n)::bigint + 1] lo, v[ceil(0.95 * n)::bigint] hi from l),
t as (select stream, i, close x, row_number() over (partition by stream order by i desc) k from b), j as (select t.stream, i, x, least(lo, min(x) over (partition by t.stream)) a, greatest(hi, max(x) over (partition by t.stream)) z from t join e using (stream) where k <= 3)
select stream, i, x, case when z > a then floor((x - a) / (z - a) * 1e4) / 1e4 else 0.5 end as normalized from j"""
INTERLEAVED_SQL = f"""with {BARS_SQL}, t as (select *, row_number() over (partition by stream order by i desc) k from b), m as (select stream, least(count(*) filter (where k <= 5), count(*) filter (where k <= 3)) m from t group by 1)
select stream, (case when k <= m then 2 * (k - 1) else m + k - 1 end)::int as place, close as x from t join m using (stream) where k <= 5 union all select stream, (2 * (k - 1) + 1)::int, volume from t where k <= 3"""
