"""Sleeves: a funding-dispersion book end to end, its sizing, and the evidence about its returns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import stats
from tidewright.operators import books, quality
from tidewright.operators.bars import BARS_SQL, bars
from tidewright.operators.books import cross_sectional_target, with_deviation
from tidewright.session import cut, table

GRID_US = 28_800_000_000


def carry_panel(candles: DataFrame, funding: DataFrame) -> DataFrame:
    """``(t, symbol, f_rate, spot_ret)`` on the 8-hour grid: funding summed per bucket, the spot
    return from the bucket before by key."""
    k = F.expr(f"us div {GRID_US}")
    f = quality.funding_rows(funding).groupBy(F.col("stream").alias("symbol"), k.alias("t")).agg(F.round(F.sum("rate"), 12).alias("f_rate"))
    s = bars(candles).groupBy(F.col("stream").alias("symbol"), k.alias("t")).agg(F.max_by("close", "us").alias("spot"))
    before = s.select("symbol", (F.col("t") + 1).alias("t"), F.col("spot").alias("spot0"))
    return f.join(s, ["symbol", "t"], "left").join(before, ["symbol", "t"], "left").select("t", "symbol", "f_rate", (F.col("spot") / F.col("spot0") - 1).alias("spot_ret"))


def carry_book(panel: DataFrame, cap: float = 0.125) -> DataFrame:
    """Per period the book's return: weights from the period before, against funding, capped; the
    position earns spot return plus the funding it receives."""
    p = with_deviation(panel, "f_rate").withColumn("target", cross_sectional_target("f_rate", -1))
    w = p.select((F.col("t") + 1).alias("t"), "symbol", F.greatest(F.lit(-cap), F.least(F.lit(cap), F.col("target"))).alias("weight"))
    gain = F.col("weight") * (F.coalesce("spot_ret", F.lit(0.0)) - F.col("f_rate"))
    return p.join(w, ["t", "symbol"]).groupBy("t").agg(F.sum(gain).alias("ret"), F.count(F.lit(1)).alias("held"))


def trailing_vol(k: int = 21) -> Column:
    """Root mean square of the ``k`` returns before this one. A book is one short series of periods."""
    w = Window.orderBy("t").rowsBetween(-k, -1)
    return F.when(F.count("ret").over(w) == k, F.sqrt(F.avg(F.col("ret") * F.col("ret")).over(w)))


def sized(book: DataFrame, target: float = 0.01, cap: float = 4.0, k: int = 21) -> DataFrame:
    """Returns scaled to a target volatility, unusable periods left out."""
    v = book.withColumn("vol", trailing_vol(k)).where("vol > 0")
    return v.withColumn("scale", F.least(F.lit(cap), target / F.col("vol"))).withColumn("scaled", F.col("ret") * F.col("scale"))


def drawdown_governor(returns: np.ndarray, cap: float = 0.2) -> np.ndarray:
    """1 less the drawdown before each period over its cap, not below 0."""
    equity = np.concatenate(([1.0], np.cumprod(1 + returns)))[:-1]
    return np.maximum(0.0, 1 - (1 - equity / np.maximum.accumulate(equity)) / cap)


def adaptive_targets(vols: np.ndarray) -> np.ndarray:
    """Mean of the positive volatilities so far."""
    ok = vols > 0
    return np.cumsum(np.where(ok, vols, 0)) / np.maximum(1, np.cumsum(ok))


def clipped_median_schedule(capacity: np.ndarray, lookback: int = 26, share: float = 0.05) -> np.ndarray:
    return np.array([min(np.median(capacity[max(0, i - lookback + 1) : i + 1]), share * c) for i, c in enumerate(capacity)])


def yearly(book: DataFrame) -> DataFrame:
    year = F.year(F.timestamp_micros(F.col("t") * GRID_US))
    return book.groupBy(year.alias("year")).agg(F.count(F.lit(1)).alias("periods"), F.round(F.sum("ret"), 9).alias("ret"), F.round(stats.sharpe("ret"), 6).alias("sharpe"))


def halves(net: np.ndarray) -> dict:
    """Sharpe of both halves with its 1.96 standard error, and whether they differ."""
    sr = [x.mean() / x.std(ddof=1) if len(x) > 1 and x.std(ddof=1) > 0 else 0.0 for x in np.array_split(net, 2)]
    se = [math.sqrt((1 + s * s / 2) / max(1, len(x) - 1)) for s, x in zip(sr, np.array_split(net, 2), strict=True)]
    return {"first": sr[0], "last": sr[1], "half_width": [1.96 * e for e in se], "differ": abs(sr[0] - sr[1]) > 1.96 * math.hypot(*se)}


def jackknife_inflation(net: np.ndarray, blocks: int = 6) -> float:
    """Variance of the Sharpe ratio by leaving out blocks, over the independent one; at least 1."""
    parts = np.array_split(net, blocks)
    sr = lambda x: x.mean() / x.std(ddof=1)
    left = np.array([sr(np.concatenate(parts[:k] + parts[k + 1 :])) for k in range(blocks)])
    var = (blocks - 1) / blocks * ((left - left.mean()) ** 2).sum()
    return float(max(1.0, var / ((1 + sr(net) ** 2 / 2) / (len(net) - 1))))


def deflated_block_sharpe(net: np.ndarray, trials: int = 10, blocks: int = 6) -> float:
    """Deflated Sharpe on as many observations as the dependence leaves."""
    n = max(2.0, len(net) / jackknife_inflation(net, blocks))
    s = net.mean() / net.std(ddof=1)
    d = (net - net.mean()) / net.std()
    v = 1 - (d**3).mean() * s + ((d**4).mean() - 1) / 4 * s * s
    hurdle = math.sqrt((1 + s * s / 2) / (n - 1)) * stats.expected_max_factor(trials)
    return stats.normal_cdf_value((s - hurdle) * math.sqrt(n - 1) / math.sqrt(v)) if v > 0 else math.nan


def gates(values: dict[str, float], limits: dict[str, float]) -> dict[str, bool]:
    """Which of several lower limits are met; all must be for a book to pass."""
    met = {k: values.get(k, -math.inf) >= v for k, v in limits.items()}
    return met | {"pass": all(met.values())}


def _book(spark, sf_dir):
    return carry_book(carry_panel(table(spark, sf_dir, "candles"), table(spark, sf_dir, "funding")))


def q_book(spark, sf_dir):
    return _book(spark, sf_dir).select("t", F.round("ret", 10).alias("ret"), "held")


def q_yearly(spark, sf_dir):
    return yearly(_book(spark, sf_dir))


def q_sized(spark, sf_dir):
    """The daily momentum book at a target volatility: forecast, scale and scaled return of every day with a forecast."""
    p, targets = books.momentum_targets(spark, sf_dir)
    gross = books.book_returns(targets.withColumnRenamed("target", "weight"), p.select("t", "symbol", "ret"))
    return sized(cut(gross.select("t", F.round("gross", 12).alias("ret")))).select("t", F.round("vol", 9).alias("vol"), F.round("scale", 6).alias("scale"), F.round("scaled", 9).alias("scaled"))


def q_halves(spark, sf_dir):
    return books.stress(cut(_book(spark, sf_dir).select("t", F.round("ret", 12).alias("gross"))))


_FUND = "f0 as (select stream symbol, epoch_us(ts) us, max(funding_rate) rate from funding where ts is not null and funding_rate is not null group by 1, 2)"
_BOOK = f"""with {BARS_SQL}, {_FUND}, fr as (select symbol, us // {GRID_US} t, round(sum(rate), 12) f_rate from f0 group by 1, 2), sp as (select stream symbol, us // {GRID_US} t, arg_max(close, us) spot from b group by 1, 2),
pl as (select fr.*, x.spot / y.spot - 1 spot_ret from fr left join sp x using (symbol, t) left join sp y on y.symbol = fr.symbol and y.t = fr.t - 1),
dv as (select *, f_rate - avg(f_rate) over (partition by t) dev, count(*) over (partition by t) n from pl),
tg as (select *, case when n >= 3 and sum(abs(dev)) over (partition by t) > 1e-15 then -dev / sum(abs(dev)) over (partition by t) else 0 end tg from dv),
bk as (select a.t, sum(greatest(-0.125, least(0.125, w.tg)) * (coalesce(a.spot_ret, 0) - a.f_rate)) ret, count(*) held from tg a join tg w on w.symbol = a.symbol and w.t = a.t - 1 group by 1)"""
BOOK_SQL = _BOOK + " select t, round(ret, 10) as ret, held from bk"
YEARLY_SQL = _BOOK + f" select year(make_timestamp(t * {GRID_US})) as year, count(*) as periods, round(sum(ret), 9) as ret, round(case when count(*) >= 2 then case when stddev_samp(ret) > 1e-15 then avg(ret) / stddev_samp(ret) else 0 end end, 6) as sharpe from bk group by 1"

SIZED_SQL = books.MOMENTUM_BOOK_SQL + """, rb as (select wt.t, round(sum(w * coalesce(ret, 0)), 12) ret from wt left join pn using (t, symbol) group by 1),
vb as (select *, case when count(*) over w = 21 then sqrt(avg(ret * ret) over w) end vol from rb window w as (order by t rows between 21 preceding and 1 preceding))
select t, round(vol, 9) as vol, round(least(4, 0.01 / vol), 6) as scale, round(ret * least(4, 0.01 / vol), 9) as scaled from vb where vol > 0"""
_SR = "case when count({x}) >= 2 then case when stddev_samp({x}) > 1e-15 then avg({x}) / stddev_samp({x}) else 0 end end"
HALVES_SQL = _BOOK + f""", gk as (select t, round(ret, 12) g, row_number() over (order by t) - 1 k, count(*) over () n from bk), bl as (select k // greatest(1, n // 6) b, {_SR.format(x='g')} s from gk where k < 6 * greatest(1, n // 6) group by 1),
sd as (select count(*) periods, {_SR.format(x='(case when k < n // 2 then g end)')} f, {_SR.format(x='(case when k >= n // 2 then g end)')} s, {_SR.format(x='g')} w from gk)
select periods, round(f, 6) as first, round(s, 6) as second, round(w, 6) as whole, (select round(min(s), 6) from bl) as worst, round(least(f, s), 6) as weaker, round(sqrt((1 + w * w / 2) / (periods - 1)), 6) as se, (select count(*) from bl) as blocks from sd"""

QUERIES = {"carry_book": (q_book, BOOK_SQL), "carry_book_yearly": (q_yearly, YEARLY_SQL), "book_sized": (q_sized, SIZED_SQL), "carry_book_stress": (q_halves, HALVES_SQL)}
