"""Cross-sectional books: weights by stamp, weight policies by symbol, and what they earn.

Panels are long: (t, symbol, value). Everything across symbols partitions by t; what follows one
symbol over time works on periods of 8 hours or a day, so a symbol is a short group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import stats
from tidewright.operators.bars import BARS_SQL, bars
from tidewright.session import cut, table

DAY_US = 86_400_000_000


def at(t: str = "t"):
    return Window.partitionBy(t)


def row_rank_weights(x: str) -> Column:
    """Centred ranks over their absolute sum, ties in order of symbol; null where ``x`` is."""
    present = Window.partitionBy("t", F.col(x).isNull())
    rank = F.row_number().over(present.orderBy(x, "symbol"))
    n = F.count(F.lit(1)).over(present)
    centred = rank - (n + 1) / 2
    return F.when(F.col(x).isNotNull() & (n > 1), centred / F.floor(n * n / 4) * 1.0).when(F.col(x).isNotNull(), 0.0)


def row_level_weights(x: str) -> Column:
    """Deviations from the mean over their absolute sum (the deviation's scale cancels)."""
    d = F.col("_dev")
    return F.when(F.sum(F.abs(d)).over(at()) > 1e-15, d / F.sum(F.abs(d)).over(at())).when(d.isNotNull(), 0.0)


def cross_sectional_target(x: str, sign: int = 1, least: int = 3) -> Column:
    """Demeaned over the symbols present and normalised to absolute sum 1; flat under ``least`` symbols."""
    d = F.col("_dev") * sign
    total = F.sum(F.abs(d)).over(at())
    return F.when((F.count(x).over(at()) >= least) & (total > 1e-15), F.coalesce(d / total, F.lit(0.0))).otherwise(0.0)


def with_deviation(panel: DataFrame, x: str) -> DataFrame:
    return panel.withColumn("_dev", F.col(x) - F.avg(x).over(at()))


def clip_weights(w: Column, cap: float) -> Column:
    return F.when(w.isNotNull(), F.greatest(F.lit(-cap), F.least(F.lit(cap), w)))


def saturate_weights(w: Column, c: float) -> Column:
    return c * F.tanh(w / c)


def normalize_l1(w: str) -> Column:
    total = F.sum(F.abs(F.col(w))).over(at())
    return F.when(total > 0, F.col(w) / total).otherwise(0.0)


def policy_path(target: np.ndarray, kind: str, value: float) -> np.ndarray:
    """Weights held over time for one symbol's targets: ewma (share ``value`` of the way each
    period), band (move only by more than ``value``), hold (renew every ``value`` periods)."""
    out, held = np.empty(len(target)), 0.0
    for k, x in enumerate(target):
        if kind == "ewma":
            held = (1 - value) * held + value * x
        elif kind == "band":
            held = x if k == 0 or abs(x - held) > value else held
        elif kind == "hold":
            held = x if k % int(value) == 0 else held
        else:
            held = x
        out[k] = held
    return out


def held_weights(targets: DataFrame, kind: str = "ewma", value: float = 0.02) -> DataFrame:
    """``targets`` (t, symbol, target) with the weight held under a policy, symbol by symbol."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        return pdf.assign(weight=policy_path(pdf["target"].to_numpy(float), kind, value))

    return targets.select("t", "symbol", "target").groupBy("symbol").applyInPandas(run, "t bigint, symbol string, target double, weight double")


def book_returns(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Gross return of each period: the sum of weight times return, a missing return counting 0."""
    return weights.join(returns, ["t", "symbol"], "left").groupBy("t").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("gross"))


def turnover_series(weights: DataFrame) -> DataFrame:
    """Absolute change of the book per period, from nothing at the start."""
    w = Window.partitionBy("symbol").orderBy("t")
    return weights.withColumn("d", F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(w), F.lit(0.0)))).groupBy("t").agg(F.sum("d").alias("turnover"))


def score_book(gross: DataFrame, turnover: DataFrame, cost_bps: float = 5.0) -> DataFrame:
    """Sharpe before and after costs; the total cost of turnover (the first entry free) is spread evenly."""
    t = turnover.orderBy("t")
    first = t.agg(F.min_by("turnover", "t").alias("entry"), F.sum("turnover").alias("all"))
    both = gross.crossJoin(F.broadcast(first))
    n = F.count(F.lit(1))
    spread = (F.max("all") - F.max("entry")) * (cost_bps / 1e4) / n
    return both.agg(n.alias("periods"), F.round(stats.sharpe("gross"), 6).alias("gross_sharpe"), F.round(F.max("all") - F.max("entry"), 6).alias("turnover"), F.round(F.try_divide(F.avg("gross") - spread, F.stddev_samp("gross")), 6).alias("net_sharpe"))


def inverse_vol_weights(returns: DataFrame) -> DataFrame:
    v = returns.groupBy("symbol").agg(F.stddev_samp("ret").alias("s")).withColumn("inv", F.when(F.col("s") > 1e-15, 1 / F.col("s")).otherwise(0.0))
    return v.crossJoin(v.agg(F.sum("inv").alias("total"))).select("symbol", F.round(F.when(F.col("total") > 0, F.col("inv") / F.col("total")).otherwise(0.0), 9).alias("weight"))


def block_sharpes(gross: DataFrame, blocks: int = 6) -> DataFrame:
    """Sharpe of equal blocks of periods; what does not fill the last block is left out."""
    g = gross.withColumn("i", F.row_number().over(Window.orderBy("t")) - 1)
    n = gross.count() // blocks
    return g.withColumn("block", F.expr(f"i div {max(1, n)}")).where(F.col("block") < blocks).groupBy("block").agg(stats.sharpe("gross").alias("sharpe"))


def daily_panel(candles: DataFrame) -> DataFrame:
    """``(t, symbol, close, ret, mom)``: each symbol's last close of the day, its return from the
    day before (by date) and its sum of log returns over the last 5 present days."""
    d = bars(candles).groupBy(F.col("stream").alias("symbol"), F.expr(f"us div {DAY_US}").alias("t")).agg(F.max_by("close", "us").alias("close"))
    prev = d.select("symbol", (F.col("t") + 1).alias("t"), F.col("close").alias("before"))
    d = d.join(prev, ["symbol", "t"], "left").withColumn("ret", F.col("close") / F.col("before") - 1)
    w = Window.partitionBy("symbol").orderBy("t")
    return d.withColumn("mom", F.round(F.ln(F.col("close") / F.lag("close", 5).over(w)), 9)).drop("before")


def q_weights(spark, sf_dir):
    p = with_deviation(daily_panel(table(spark, sf_dir, "candles")), "mom")
    cols = {"rank_weight": row_rank_weights("mom"), "level_weight": row_level_weights("mom"), "target": cross_sectional_target("mom", -1)}
    return p.select("t", "symbol", *[F.round(c, 8).alias(n) for n, c in cols.items()])


def q_book(spark, sf_dir):
    """Daily book: target of the day before, held weights, next day's returns; per day gross and turnover."""
    p = with_deviation(daily_panel(table(spark, sf_dir, "candles")), "mom")
    targets = p.select((F.col("t") + 1).alias("t"), "symbol", cross_sectional_target("mom").alias("target"))
    w = held_weights(targets, "ewma", 0.25)
    out = book_returns(w, p.select("t", "symbol", "ret")).join(turnover_series(w), "t")
    return out.select("t", F.round("gross", 10).alias("gross"), F.round("turnover", 8).alias("turnover"))


def q_book_score(spark, sf_dir):
    p = with_deviation(daily_panel(table(spark, sf_dir, "candles")), "mom")
    w = p.select((F.col("t") + 1).alias("t"), "symbol", cross_sectional_target("mom").alias("weight"))
    return score_book(book_returns(w, p.select("t", "symbol", "ret")), turnover_series(w))


def q_inverse_vol(spark, sf_dir):
    return inverse_vol_weights(daily_panel(table(spark, sf_dir, "candles")).select("symbol", "ret"))


def q_common_grid(spark, sf_dir):
    """Days on which every one of the busiest venue's streams has a bar: count of distinct streams per day."""
    p = daily_panel(table(spark, sf_dir, "candles"))
    return p.groupBy("t").agg(F.countDistinct("symbol").alias("symbols"), F.round(F.avg("ret"), 9).alias("mean_ret"), F.round(F.stddev_pop("ret"), 9).alias("std_ret")).where("symbols >= 3")


def clean_book(targets: DataFrame, cap: float = 0.1, band: float = 0.02) -> DataFrame:
    """``(t, symbol, weight)``: every target clipped to ``cap``, then held until it has moved by more than ``band``;
    the first of a symbol is taken as it is. Nothing is normalised again."""
    clipped = targets.select("t", "symbol", F.coalesce(clip_weights(F.col("target"), cap), F.lit(0.0)).alias("target"))
    return held_weights(clipped, "band", band).select("t", "symbol", "weight")


def stress(gross: DataFrame, blocks: int = 6) -> DataFrame:
    """One row about a book's ``(t, gross)``: the ratios of both halves, the worst of ``blocks`` equal blocks, and
    the ratio with its standard error. The book is one short series, a row a period."""
    n = gross.count()
    g = gross.withColumn("k", F.row_number().over(Window.orderBy("t")) - 1)
    half, size = n // 2, max(1, n // blocks)
    per = g.where(F.col("k") < blocks * size).groupBy(F.expr(f"k div {size}").alias("block")).agg(stats.sharpe("gross").alias("sharpe"))
    sides = g.agg(stats.sharpe(F.when(F.col("k") < half, F.col("gross"))).alias("first"), stats.sharpe(F.when(F.col("k") >= half, F.col("gross"))).alias("second"), stats.sharpe("gross").alias("whole"), F.count(F.lit(1)).alias("periods"))
    worst = per.agg(F.min("sharpe").alias("worst"), F.count(F.lit(1)).alias("blocks"))
    se = F.sqrt((1 + F.col("whole") * F.col("whole") / 2) / (F.col("periods") - 1))
    both = sides.crossJoin(F.broadcast(worst))
    return both.select("periods", *[F.round(c, 6).alias(c) for c in ("first", "second", "whole", "worst")], F.round(F.least("first", "second"), 6).alias("weaker"), F.round(se, 6).alias("se"), "blocks")


def momentum_targets(spark, sf_dir):
    p = with_deviation(daily_panel(table(spark, sf_dir, "candles")), "mom")
    return p, p.select((F.col("t") + 1).alias("t"), "symbol", cross_sectional_target("mom").alias("target"))


def q_clean(spark, sf_dir):
    """The momentum book capped and banded: per day its gross exposure, turnover and return."""
    p, targets = momentum_targets(spark, sf_dir)
    w = cut(clean_book(targets))
    per = w.groupBy("t").agg(F.round(F.sum(F.abs("weight")), 8).alias("exposure"), F.round(F.max(F.abs("weight")), 8).alias("largest"))
    g = book_returns(w, p.select("t", "symbol", "ret")).select("t", F.round("gross", 9).alias("gross"))
    return per.join(turnover_series(w).select("t", F.round("turnover", 8).alias("turnover")), "t").join(g, "t")


def q_stress(spark, sf_dir):
    p, targets = momentum_targets(spark, sf_dir)
    return stress(cut(book_returns(targets.withColumnRenamed("target", "weight"), p.select("t", "symbol", "ret"))))


def q_saturated(spark, sf_dir):
    """The target weights saturated smoothly and brought back to absolute sum 1."""
    _, targets = momentum_targets(spark, sf_dir)
    w = targets.withColumn("s", saturate_weights(F.col("target"), 0.125))
    return w.select("t", "symbol", F.round("s", 9).alias("saturated"), F.round(normalize_l1("s"), 9).alias("weight"))


_PANEL = f"""dd as (select stream symbol, us // {DAY_US} t, arg_max(close, us) as close from b group by 1, 2),
pn as (select x.*, x.close / p.close - 1 ret, round(ln(x.close / lag(x.close, 5) over (partition by x.symbol order by x.t)), 9) mom from dd x left join dd p on p.symbol = x.symbol and p.t = x.t - 1),
dv as (select *, mom - avg(mom) over (partition by t) dev, count(mom) over (partition by t) nm, row_number() over (partition by t, mom is null order by mom, symbol) rk from pn),
tg as (select *, sum(abs(dev)) over (partition by t) tot from dv)"""
WEIGHTS_SQL = f"""with {BARS_SQL}, {_PANEL} select t, symbol, round(case when mom is not null then case when nm > 1 then (rk - (nm + 1) / 2.0::double) / floor(nm * nm / 4) else 0 end end, 8) as rank_weight,
  round(case when tot > 1e-15 then dev / tot when dev is not null then 0 end, 8) as level_weight, round(case when nm >= 3 and tot > 1e-15 then coalesce(-dev / tot, 0) else 0 end, 8) as target from tg"""
MOMENTUM_BOOK_SQL = f"with {BARS_SQL}, {_PANEL}, wt as (select t + 1 t, symbol, case when nm >= 3 and tot > 1e-15 then coalesce(dev / tot, 0) else 0 end w from tg)"
SCORE_SQL = MOMENTUM_BOOK_SQL + """, gr as (select wt.t, sum(w * coalesce(ret, 0)) g from wt left join pn using (t, symbol) group by 1),
tn as (select t, sum(abs(w - coalesce(lw, 0))) x from (select *, lag(w) over (partition by symbol order by t) lw from wt) group by 1), ta as (select sum(x) - arg_min(x, t) tv from tn)
select count(*) as periods, round(case when stddev_samp(g) > 1e-15 then avg(g) / stddev_samp(g) else 0 end, 6) as gross_sharpe, round(any_value(tv), 6) as turnover, round((avg(g) - any_value(tv) * 0.0005 / count(*)) / stddev_samp(g), 6) as net_sharpe from gr, ta"""
INV_SQL = f"""with {BARS_SQL}, {_PANEL}, sd as (select symbol, stddev_samp(ret) s from pn group by 1), iv as (select symbol, case when s > 1e-15 then 1 / s else 0 end i from sd)
select symbol, round(case when (select sum(i) from iv) > 0 then i / (select sum(i) from iv) else 0 end, 9) as weight from iv"""
GRID_SQL = f"with {BARS_SQL}, {_PANEL} select t, count(distinct symbol) as symbols, round(avg(ret), 9) as mean_ret, round(stddev_pop(ret), 9) as std_ret from pn group by 1 having count(distinct symbol) >= 3"

CLEAN_SQL = "with recursive" + MOMENTUM_BOOK_SQL[4:] + """, cw as (select t, symbol, greatest(-0.1, least(0.1, w)) w, row_number() over (partition by symbol order by t) k from wt),
hb as (select t, symbol, k, w h from cw where k = 1 union all select c.t, c.symbol, c.k, case when abs(c.w - hb.h) > 0.02 then c.w else hb.h end from hb join cw c on c.symbol = hb.symbol and c.k = hb.k + 1),
tn as (select t, symbol, h, abs(h - coalesce(lag(h) over (partition by symbol order by t), 0)) d from hb)
select tn.t, round(sum(abs(h)), 8) as exposure, round(max(abs(h)), 8) as largest, round(sum(d), 8) as turnover, round(sum(h * coalesce(ret, 0)), 9) as gross from tn left join pn on pn.t = tn.t and pn.symbol = tn.symbol group by 1"""
_SR = "case when count({x}) >= 2 then case when stddev_samp({x}) > 1e-15 then avg({x}) / stddev_samp({x}) else 0 end end"
STRESS_SQL = MOMENTUM_BOOK_SQL + f""", gr as (select wt.t, sum(w * coalesce(ret, 0)) g from wt left join pn using (t, symbol) group by 1), gk as (select *, row_number() over (order by t) - 1 k, count(*) over () n from gr),
bl as (select k // greatest(1, n // 6) b, {_SR.format(x='g')} s from gk where k < 6 * greatest(1, n // 6) group by 1),
sd as (select count(*) periods, {_SR.format(x='(case when k < n // 2 then g end)')} f, {_SR.format(x='(case when k >= n // 2 then g end)')} s, {_SR.format(x='g')} w from gk)
select periods, round(f, 6) as first, round(s, 6) as second, round(w, 6) as whole, (select round(min(s), 6) from bl) as worst, round(least(f, s), 6) as weaker, round(sqrt((1 + w * w / 2) / (periods - 1)), 6) as se, (select count(*) from bl) as blocks from sd"""
SATURATED_SQL = MOMENTUM_BOOK_SQL + ", sw as (select t, symbol, 0.125 * tanh(w / 0.125) s from wt) select t, symbol, round(s, 9) as saturated, round(case when sum(abs(s)) over (partition by t) > 0 then s / sum(abs(s)) over (partition by t) else 0 end, 9) as weight from sw"

RETURNS_SQL = "with recursive" + MOMENTUM_BOOK_SQL[4:] + """, cw as (select t, symbol, w, row_number() over (partition by symbol order by t) k from wt),
hb as (select t, symbol, k, 0.25 * w h from cw where k = 1 union all select c.t, c.symbol, c.k, 0.75 * hb.h + 0.25 * c.w from hb join cw c on c.symbol = hb.symbol and c.k = hb.k + 1),
tn as (select t, symbol, h, abs(h - coalesce(lag(h) over (partition by symbol order by t), 0)) d from hb)
select tn.t, round(sum(h * coalesce(ret, 0)), 10) as gross, round(sum(d), 8) as turnover from tn left join pn on pn.t = tn.t and pn.symbol = tn.symbol group by 1"""

QUERIES = {"book_weights": (q_weights, WEIGHTS_SQL), "book_returns": (q_book, RETURNS_SQL), "book_score": (q_book_score, SCORE_SQL), "inverse_vol_weights": (q_inverse_vol, INV_SQL), "common_grid": (q_common_grid, GRID_SQL),
    "clean_book": (q_clean, CLEAN_SQL), "book_stress": (q_stress, STRESS_SQL), "saturated_weights": (q_saturated, SATURATED_SQL)}
