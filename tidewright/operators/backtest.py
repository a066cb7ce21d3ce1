"""Strategy returns, equity, drawdown and the report of a backtest, per stream."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import stats
from tidewright.operators.bars import order, running
from tidewright.operators.features import POSITION_SQL, positions
from tidewright.session import table

COST_BPS, YEAR, TRIALS = 5.0, 252, 10


def strategy(rows: DataFrame, cost_bps: float = COST_BPS, lag: int = 1) -> DataFrame:
    """Adds ``pos`` (the position held: the signal ``lag`` bars ago), ``change``, ``gross``, ``cost`` and ``net``."""
    rows = rows.withColumn("pos", F.coalesce(F.lag("position", lag).over(order()), F.lit(0.0)))
    rows = rows.withColumn("change", F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(order()), F.lit(0.0))))
    rows = rows.withColumn("gross", F.col("pos") * F.col("ret")).withColumn("cost", F.col("change") * (cost_bps / 1e4))
    return rows.withColumn("net", F.col("gross") - F.col("cost"))


def equity(rows: DataFrame) -> DataFrame:
    """Own rows with ``log_equity`` (0 at the start), its ``peak`` so far and the ``drawdown``;
    the sums run over chunks. A loss of everything ends at a floor of 1e-12."""
    growth = F.ln(F.greatest(1 + F.col("net"), F.lit(1e-12)))
    out = running(rows, {"log_equity": growth}, {"peak": "log_equity"})
    return out.withColumn("drawdown", 1 - F.exp(F.col("log_equity") - F.col("peak")))


def moments(x: str) -> tuple[Column, Column]:
    """Population skewness and plain (not excess) kurtosis; 0 and 3 where the values do not vary."""
    flat = F.stddev_pop(x) <= 1e-15
    return F.when(flat, 0.0).otherwise(F.skewness(x)), F.when(flat, 3.0).otherwise(F.kurtosis(x) + 3)


def report(rows: DataFrame, trials: int = TRIALS, year: int = YEAR) -> DataFrame:
    """One row of metrics per stream; hits are counted among bars with a position."""
    skew, kurt = moments("net")
    held, n = F.col("pos") != 0, F.count(F.lit(1))
    agg = equity(rows).groupBy("stream").agg(
        n.alias("bars"), stats.sharpe("net", year).alias("net_sharpe"), stats.sharpe("gross", year).alias("gross_sharpe"), skew.alias("skew"), kurt.alias("kurt"),
        F.max("drawdown").alias("max_drawdown"), F.avg(F.when(held, F.when(F.col("net") > 0, 1.0).otherwise(0.0))).alias("hit_rate"), F.sum("change").alias("turnover"),
        F.count_if(F.col("change") > 1e-12).alias("trades"), F.sum("cost").alias("total_cost"), F.sum("gross").alias("gross_pnl"),
        F.exp(F.max_by("log_equity", "i")).alias("final_equity"), F.avg(F.when(held, 1.0).otherwise(0.0)).alias("in_market"), F.avg(F.abs("pos")).alias("mean_abs_position"),
    )
    sr = F.col("net_sharpe") / math.sqrt(year)
    agg = agg.withColumn("psr", stats.probabilistic_sharpe(sr, F.col("bars"), F.col("skew"), F.col("kurt"))).withColumn("dsr", stats.deflated_sharpe(sr, F.col("bars"), F.col("skew"), F.col("kurt"), trials))
    agg = agg.withColumn("min_track_record", stats.minimum_track_record(sr, F.col("skew"), F.col("kurt"))).withColumn("break_even_bps", F.when(F.col("turnover") > 1e-9, 1e4 * F.col("gross_pnl") / F.col("turnover")))
    return agg.select("stream", "bars", "trades", *[F.round(c, 6).alias(c) for c in METRICS])


METRICS = ("net_sharpe", "gross_sharpe", "max_drawdown", "hit_rate", "turnover", "total_cost", "gross_pnl", "final_equity", "in_market", "mean_abs_position", "psr", "dsr", "break_even_bps")


def restate_at_costs(rows: DataFrame, levels: tuple[float, ...] = (0.0, 2.0, 5.0, 10.0)) -> DataFrame:
    """The net result at several cost levels from one pass over gross and change."""
    own = rows.where("own").withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    net = own.withColumn("net", F.col("gross") - F.col("change") * F.col("level") / 1e4)
    return net.groupBy("stream", "level").agg(F.round(F.sum("net"), 8).alias("net_pnl"), F.round(stats.sharpe("net", YEAR), 6).alias("net_sharpe"))


def fold_metrics(rows: DataFrame, size: int = 100, cost_bps: float = COST_BPS) -> DataFrame:
    """Per fold of ``size`` bars: count, sum and Sharpe of the net returns. Each fold is traded on its
    own: the lag is inside it, so its first bar is flat and its second one pays the entry."""
    at = F.expr(f"i % {size}")
    change = F.when(at == 0, 0.0).when(at == 1, F.abs("pos")).otherwise(F.col("change"))
    net = F.when(at == 0, 0.0).otherwise(F.col("gross")) - change * (cost_bps / 1e4)
    own = rows.where("own").withColumn("fold", F.expr(f"i div {size}")).withColumn("net", net)
    return own.groupBy("stream", "fold").agg(F.count(F.lit(1)).alias("bars"), F.round(F.sum("net"), 8).alias("net_pnl"), F.round(stats.sharpe("net", YEAR), 6).alias("net_sharpe"))


def aggregate_folds(folds: DataFrame) -> DataFrame:
    return folds.groupBy("stream").agg(
        F.count("net_sharpe").alias("folds"), F.round(F.avg("net_sharpe"), 6).alias("mean_sharpe"), F.round(F.stddev_samp("net_sharpe"), 6).alias("std_sharpe"),
        F.round(F.avg(F.when(F.col("net_sharpe") > 0, 1.0).otherwise(0.0)), 6).alias("positive"), F.min("net_sharpe").alias("worst"), F.max("net_sharpe").alias("best"),
    )


def _run(spark, sf_dir):
    return strategy(positions(table(spark, sf_dir, "candles")))


def q_backtest(spark, sf_dir):
    return report(_run(spark, sf_dir))


def q_costs(spark, sf_dir):
    return restate_at_costs(_run(spark, sf_dir))


def q_folds(spark, sf_dir):
    return fold_metrics(_run(spark, sf_dir))


def q_fold_summary(spark, sf_dir):
    return aggregate_folds(fold_metrics(_run(spark, sf_dir)))


STRATEGY_SQL = POSITION_SQL + """, st as (select *, coalesce(lag(position) over (partition by stream order by i), 0) held from pos),
s2 as (select *, abs(held - coalesce(lag(held) over (partition by stream order by i), 0)) chg, held * ret gross from st),
s3 as (select *, chg * 0.0005 as c, gross - chg * 0.0005 net from s2)"""


def _sharpe_sql(x: str, scale: str = "sqrt(252)") -> str:
    return f"case when count({x}) >= 2 then case when stddev_samp({x}) > 1e-15 then avg({x}) / stddev_samp({x}) * {scale} else 0 end end"


REPORT_SQL = STRATEGY_SQL + f""", e as (select *, sum(ln(greatest(1 + net, 1e-12))) over (partition by stream order by i) le from s3),
kk as (select *, 1 - exp(le - greatest(0, max(le) over (partition by stream order by i))) dd, avg(net) over (partition by stream) mu from e),
ag as (select stream, count(*) n, {_sharpe_sql('net')} ns, {_sharpe_sql('gross')} gs, max(dd) md, avg(case when held <> 0 then (net > 0)::int end) hr, sum(chg) tv,
  sum((chg > 1e-12)::int) tr, sum(c) tc, sum(gross) gp, exp(arg_max(le, i)) fe, avg((held <> 0)::int) im, avg(abs(held)) ap, stddev_pop(net) sp,
  avg(pow(net - mu, 3)) m3, avg(pow(net - mu, 4)) m4 from kk group by 1),
mm as (select *, ns / sqrt(252) sr, case when sp <= 1e-15 then 0 else m3 / pow(sp, 3) end sk, case when sp <= 1e-15 then 3 else m4 / pow(sp, 4) end ku from ag),
vv as (select *, 1 - sk * sr + (ku - 1) / 4 * sr * sr v from mm)
select stream, n as bars, tr as trades, round(ns, 6) as net_sharpe, round(gs, 6) as gross_sharpe, round(md, 6) as max_drawdown, round(hr, 6) as hit_rate, round(tv, 6) as turnover,
  round(tc, 6) as total_cost, round(gp, 6) as gross_pnl, round(fe, 6) as final_equity, round(im, 6) as in_market, round(ap, 6) as mean_abs_position,
  round(case when n >= 2 and v > 0 then {stats.normal_cdf_sql('(sr * sqrt(n - 1) / sqrt(v))')} end, 6) as psr,
  round(case when n >= 2 and v > 0 then {stats.normal_cdf_sql(f'((sr - sqrt((1 + sr * sr / 2) / (n - 1)) * {stats.expected_max_factor(TRIALS)!r}) * sqrt(n - 1) / sqrt(v))')} end, 6) as dsr,
  round(case when tv > 1e-9 then 1e4 * gp / tv end, 6) as break_even_bps from vv"""
COSTS_SQL = STRATEGY_SQL + f""", l as (select stream, l::double as level, gross - chg * l / 1e4 net from s3, (select unnest([0.0, 2.0, 5.0, 10.0]) l))
select stream, level, round(sum(net), 8) as net_pnl, round({_sharpe_sql('net')}, 6) as net_sharpe from l group by 1, 2"""
#: The lag and the entry are taken within the fold.
FOLDS_SQL = POSITION_SQL + f""", f1 as (select *, i // 100 fold, coalesce(lag(position) over (partition by stream, i // 100 order by i), 0) held from pos),
f2 as (select *, held * ret - abs(held - coalesce(lag(held) over (partition by stream, fold order by i), 0)) * 0.0005 net from f1)
select stream, fold, count(*) as bars, round(sum(net), 8) as net_pnl, round({_sharpe_sql('net')}, 6) as net_sharpe from f2 group by 1, 2"""
FOLD_SUMMARY_SQL = f"""select stream, count(net_sharpe) as folds, round(avg(net_sharpe), 6) as mean_sharpe, round(stddev_samp(net_sharpe), 6) as std_sharpe,
  round(avg(case when net_sharpe > 0 then 1.0::double else 0 end), 6) as positive, min(net_sharpe) as worst, max(net_sharpe) as best from ({FOLDS_SQL}) group by 1"""
