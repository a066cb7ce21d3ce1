"""Evaluation of signal variants: policies restated from one pass, sweeps, promotion, and the
audit that no position depends on the future."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from tidewright.operators.backtest import fold_metrics, strategy
from tidewright.operators.bars import BARS_SQL, bar_returns, numbered, own, with_halo
from tidewright.operators.features import FEATURE_SQL, FEATURES, POSITION_SQL, Z_SQL, _BASE_SQL, base, causal_z, clamp_position, positions
from tidewright.session import table

YEAR = 252


def confidence_to_position(c: Column, dead_zone: float = 0.0, scale: float = 1.0) -> Column:
    """Nothing inside the dead zone, the rest stretched to the full range."""
    rest = (F.abs(c) - dead_zone) / (1 - dead_zone) * scale
    return F.when(F.abs(c) <= dead_zone, 0.0).otherwise(F.signum(c) * F.least(F.lit(1.0), rest))


def confidence_from_prob(p: Column) -> Column:
    return p / 50 - 1


def held_positions(confidence: np.ndarray, enter: float, leave: float, least_hold: int) -> np.ndarray:
    """Hysteresis: enter above one level, leave below a lower one, not before ``least_hold`` bars."""
    out, pos, since = np.zeros(len(confidence)), 0.0, 0
    for i, c in enumerate(confidence):
        since += 1
        if pos == 0 or np.sign(c) != np.sign(pos):
            if abs(c) >= enter and (pos == 0 or since >= least_hold):
                pos, since = float(np.sign(c)), 0
            elif pos != 0 and since >= least_hold:
                pos, since = 0.0, 0
        elif abs(c) < leave and since >= least_hold:
            pos, since = 0.0, 0
        out[i] = pos
    return out


def policy_grid(rows: DataFrame, dead_zones: tuple[float, ...] = (0.0, 0.1, 0.2, 0.4), cost_bps: float = 5.0) -> DataFrame:
    """Every dead zone of a small grid applied to the same confidences: one scan, no refit."""
    w = Window.partitionBy("stream", "part").orderBy("i")
    cols = {}
    for k, z in enumerate(dead_zones):
        cols[f"p{k}"] = F.lag(confidence_to_position(F.col("position"), z), 1, 0.0).over(w)
    rows = rows.withColumns(cols).withColumns({f"c{k}": F.abs(F.col(f"p{k}") - F.lag(f"p{k}", 1, 0.0).over(w)) for k in range(len(dead_zones))})
    long = rows.where("own").select("stream", "ret", F.inline(F.array(*[F.struct(F.lit(z).alias("dead_zone"), F.col(f"p{k}").alias("p"), F.col(f"c{k}").alias("c")) for k, z in enumerate(dead_zones)])))
    g = F.col("p") * F.col("ret")
    return long.groupBy("stream", "dead_zone").agg(F.round(F.sum(g), 8).alias("gross_pnl"), F.round(F.sum("c"), 6).alias("turnover"), F.round(F.sum(g - F.col("c") * cost_bps / 1e4), 8).alias("net_pnl"), F.round(F.avg(F.when(F.col("p") != 0, 1.0).otherwise(0.0)), 6).alias("in_market"))


def best_policy(grid: DataFrame) -> DataFrame:
    w = Window.partitionBy("stream").orderBy(F.col("net_pnl").desc(), "dead_zone")
    return grid.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def exposure_dead_zone(confidence: Column, share: float) -> Column:
    """The dead zone that leaves about ``share`` of the bars in the market."""
    return F.percentile_approx(F.abs(confidence), F.lit(1 - share), F.lit(1000))


def variant_metrics(candles: DataFrame, variants: tuple[str, ...] = ("momentum", "reversal_window", "range_location"), fold: int = 100) -> DataFrame:
    """Sharpe of every variant per stream and fold from one shared pass over the bars."""
    rows = base(candles).withColumns({v: FEATURES[v]() for v in variants})
    rows = rows.withColumns({f"z_{v}": clamp_position(causal_z(v)) for v in variants})
    out = None
    for v in variants:
        one = fold_metrics(strategy(rows.withColumn("position", F.col(f"z_{v}"))), fold).withColumn("variant", F.lit(v))
        out = one if out is None else out.unionByName(one)
    return out


def promotion(metrics: DataFrame, baseline: str = "momentum", least_delta: float = 0.1, least_wins: float = 0.55) -> DataFrame:
    """Each candidate against the baseline: mean difference, fold wins, sign test, which hurdle is
    tightest and whether all are passed."""
    b = metrics.where(F.col("variant") == baseline).select("stream", "fold", F.col("net_sharpe").alias("base"))
    j = metrics.where(F.col("variant") != baseline).join(b, ["stream", "fold"]).where("net_sharpe is not null and base is not null")
    a = j.groupBy("variant").agg(F.count(F.lit(1)).alias("folds"), F.avg(F.col("net_sharpe") - F.col("base")).alias("delta"), F.avg(F.when(F.col("net_sharpe") > F.col("base"), 1.0).otherwise(0.0)).alias("wins"))
    hurdles = F.array(F.struct((F.col("delta") - least_delta).alias("margin"), F.lit("delta").alias("hurdle")), F.struct((F.col("wins") - least_wins).alias("margin"), F.lit("wins").alias("hurdle")))
    worst = F.array_min(hurdles)
    return a.select("variant", "folds", F.round("delta", 6).alias("delta"), F.round("wins", 6).alias("wins"), worst["hurdle"].alias("tightest"), (worst["margin"] >= 0).alias("promote"))


def shock_factor(after: Column, size: float = 0.1, frequency: float = 1.7, phase: float = 0.0) -> Column:
    """1 up to the cut, then a wave above 1."""
    return F.when(F.col("i") <= after, 1.0).otherwise(1 + size * (1 + F.sin(F.col("i") * frequency + phase)))


def lookahead_audit(candles: DataFrame, at: float = 0.6, feature: str = "momentum") -> DataFrame:
    """Positions on the bars as they are against positions with every bar behind a cut disturbed:
    per stream how many differ up to the cut (none may) and behind it."""
    rows = numbered(candles)
    last = rows.groupBy("stream").agg(F.floor(F.max("i") * at).alias("cut_at"))
    rows = rows.join(last, "stream")
    f = shock_factor(F.col("cut_at"))
    shocked = rows.withColumns({c: F.col(c) * f for c in ("open", "high", "low", "close")})

    def positions_of(r: DataFrame) -> DataFrame:
        r = bar_returns(with_halo(r)).withColumn("m", FEATURES[feature]())
        return own(r.withColumn("position", clamp_position(causal_z("m")))).select("stream", "i", "cut_at", F.round("position", 9).alias("position"))

    a, b = positions_of(rows), positions_of(shocked).select("stream", "i", F.col("position").alias("other"))
    differ = F.col("position") != F.col("other")
    return a.join(b, ["stream", "i"]).groupBy("stream").agg(F.count_if(differ & (F.col("i") <= F.col("cut_at"))).alias("before"), (F.count_if(differ & (F.col("i") > F.col("cut_at"))) > 0).alias("moved_after"))


def minimum_detectable_sharpe(sr: Column, n: Column, z: float = 1.959964) -> Column:
    return z * F.sqrt((1 + sr * sr / (2 * YEAR)) * YEAR / n)


def hysteresis(candles: DataFrame, enter: float = 0.5, leave: float = 0.2, hold: int = 3) -> DataFrame:
    """Positions with hysteresis. The path of a stream is followed chunk by chunk from 512 earlier
    bars, far more than it takes to come to a flat position and forget."""
    rows = base(candles).withColumn("mom", FEATURES["momentum"]())
    rows = rows.withColumn("c", clamp_position(causal_z("mom"))).select("stream", "part", "own", "i", "c")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        pdf = pdf.assign(position=held_positions(pdf["c"].to_numpy(), enter, leave, hold))
        return pdf.loc[pdf["own"], ["stream", "i", "position"]]

    return rows.groupBy("stream", "part").applyInPandas(lambda pdf: run(pdf), "stream string, i bigint, position double")


def q_grid(spark, sf_dir):
    return policy_grid(positions(table(spark, sf_dir, "candles")))


def q_promotion(spark, sf_dir):
    return promotion(variant_metrics(table(spark, sf_dir, "candles")))


def q_audit(spark, sf_dir):
    return lookahead_audit(table(spark, sf_dir, "candles"))


def q_hysteresis(spark, sf_dir):
    return hysteresis(table(spark, sf_dir, "candles")).groupBy("stream").agg(F.count_if(F.col("position") != 0).alias("in_market"), F.round(F.avg("position"), 6).alias("mean_position"))


GRID_SQL = POSITION_SQL + ", gz as (select stream, i, ret, dz as dead_zone, case when abs(position) <= dz then 0 else sign(position) * least(1, (abs(position) - dz) / (1 - dz)) end c from pos, (select unnest([0.0, 0.1, 0.2, 0.4])::double dz)), " + """gp as (select *, lag(c, 1, 0) over (partition by stream, dead_zone order by i) p from gz), gc as (select *, abs(p - lag(p, 1, 0) over (partition by stream, dead_zone order by i)) ch from gp)
select stream, dead_zone, round(sum(p * ret), 8) as gross_pnl, round(sum(ch), 6) as turnover, round(sum(p * ret - ch * 0.0005), 8) as net_pnl, round(avg(case when p <> 0 then 1.0::double else 0 end), 6) as in_market from gc group by 1, 2"""

_FOLDED = _BASE_SQL + ", vx as (" + " union all ".join(f"select '{v}' variant, stream, i, ret, {FEATURE_SQL[v]} x from p" for v in ("momentum", "reversal_window", "range_location")) + f"""),
vz as (select variant, stream, i, ret, i // 100 fold, greatest(-1, least(1, ({Z_SQL.format(x='x').replace('partition by stream', 'partition by variant, stream')}) / 2)) c from vx),
h1 as (select *, coalesce(lag(c) over (partition by variant, stream, fold order by i), 0) h from vz), h2 as (select *, h * ret - abs(h - coalesce(lag(h) over (partition by variant, stream, fold order by i), 0)) * 0.0005 net from h1),
fm as (select variant, stream, fold, round(case when count(*) >= 2 then case when stddev_samp(net) > 1e-15 then avg(net) / stddev_samp(net) * sqrt(252) else 0 end end, 6) sr from h2 group by 1, 2, 3)"""
PROMOTE_SQL = _FOLDED + """, j as (select a.variant, a.sr, b.sr base from fm a join fm b on a.stream = b.stream and a.fold = b.fold and b.variant = 'momentum' and a.variant <> 'momentum' where a.sr is not null and b.sr is not null),
g as (select variant, count(*) folds, avg(sr - base) delta, avg((sr > base)::int) wins from j group by 1)
select variant, folds, round(delta, 6) as delta, round(wins, 6) as wins, case when delta - 0.1 <= wins - 0.55 then 'delta' else 'wins' end as tightest, delta >= 0.1 and wins >= 0.55 as promote from g"""
_MOM = "case when count(ret) over (partition by stream order by i rows between 15 preceding and current row) = 16 then sum(ret) over (partition by stream order by i rows between 15 preceding and current row) end"
_SHOCK = "case when i <= cut_at then 1 else 1 + 0.1::double * (1 + sin(i * 1.7::double)) end"


def _path(name: str, close: str) -> str:
    return f"""{name}1 as (select *, {close} k from cuts), {name}2 as (select *, case when i = 0 then 0.0 else k / lag(k) over (partition by stream order by i) - 1 end ret from {name}1), {name}3 as (select *, {_MOM} mom from {name}2),
{name} as (select stream, i, cut_at, round(greatest(-1, least(1, ({Z_SQL.format(x='mom')}) / 2)), 9) position from {name}3)"""


AUDIT_SQL = f"with {BARS_SQL}, cuts as (select stream, i, close, floor(max(i) over (partition by stream) * 0.6::double)::bigint cut_at from b), {_path('pa', 'close')}, {_path('pb', f'close * ({_SHOCK})')}" + """
select stream, count_if(pa.position <> pb.position and i <= pa.cut_at) as before, count_if(pa.position <> pb.position and i > pa.cut_at) > 0 as moved_after from pa join pb using (stream, i) group by 1"""

QUERIES = {"policy_grid": (q_grid, GRID_SQL), "promotion": (q_promotion, PROMOTE_SQL), "lookahead_audit": (q_audit, AUDIT_SQL), "hysteresis_positions": (q_hysteresis, None)}
