"""Causal features of a return series, their z-scores and positions. All look at most HALO bars back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.bars import BARS_SQL, bar_returns, full, last_k, numbered, order, own, with_halo
from tidewright.session import table

DECIMALS = 8


def rolling_sum(x: str, k: int, back: int = 0) -> Column:
    return full(F.sum(x), x, k, back)


def rolling_mean(x: str, k: int, back: int = 0) -> Column:
    return full(F.avg(x), x, k, back)


def rolling_variance(x: str, k: int, back: int = 0) -> Column:
    return full(F.var_samp(x), x, k, back)


def positive(x: Column) -> Column:
    """``x`` if it is positive beyond rounding noise, else null."""
    return F.when(x > 1e-18, x)


def momentum(k: int = 16) -> Column:
    return rolling_sum("ret", k)


def fractional_diff_weights(d: float, size: int) -> list[float]:
    """Binomial weights of the fractional difference: w0 = 1, w_k = w_{k-1} (k - 1 - d) / k."""
    w = [1.0]
    for k in range(1, size):
        w.append(w[-1] * (k - 1 - d) / k)
    return w


def frac_diff(x: Column, d: float = 0.4, size: int = 16) -> Column:
    """Weighted sum of the last ``size`` values; null until there are so many."""
    total = None
    for k, w in enumerate(fractional_diff_weights(d, size)):
        term = (F.lag(x, k).over(order()) if k else x) * F.lit(w)
        total = term if total is None else total + term
    return total


def frac_momentum(d: float = 0.4, size: int = 16) -> Column:
    return frac_diff(F.ln("close"), d, size) - F.lag(frac_diff_name(d, size), 1).over(order())


def frac_diff_name(d: float, size: int) -> str:
    return f"fd_{size}"


def vol_regime(short: int = 8, long: int = 32) -> Column:
    return F.sqrt(rolling_variance("ret", short) / positive(rolling_variance("ret", long))) - 1


def momentum_agreement(lenses: tuple[int, ...] = (4, 8, 16, 32)) -> Column:
    signs = [F.signum(F.round(rolling_sum("ret", k), 12)) for k in lenses]
    n = sum((F.when(s.isNotNull(), 1).otherwise(0) for s in signs), F.lit(0))
    return F.when(n >= 2, sum((F.coalesce(s, F.lit(0.0)) for s in signs), F.lit(0.0)) / n)


def range_location(k: int = 32) -> Column:
    w = last_k(k)
    lo, hi = F.min("close").over(w), F.max("close").over(w)
    return F.when((F.count("close").over(w) == k) & (hi > lo), (F.col("close") - lo) / (hi - lo) - 0.5)


def volume_imbalance(short: int = 8, long: int = 32) -> Column:
    m = rolling_mean("volume", long)
    return F.when(m > 0, rolling_mean("volume", short) / m - 1)


def autocorr1(k: int = 32) -> Column:
    """Lag-1 autocorrelation about the one mean of the last k returns, from running sums."""
    w = last_k(k)
    m, s1 = F.avg("ret").over(w), F.sum("prev_ret").over(w)
    num = F.sum(F.col("ret") * F.col("prev_ret")).over(w) - m * s1 - m * (k * m) + k * m * m
    den = F.sum(F.col("ret") * F.col("ret")).over(w) - k * m * m
    return F.when((F.col("i") >= k + 1) & (den > 1e-18), num / den)


def acceleration(k: int = 16) -> Column:
    return rolling_sum("ret", k) - rolling_sum("ret", k, k)


def reversal() -> Column:
    return F.when(F.col("i") >= 1, -F.col("ret"))


def reversal_window(k: int = 4) -> Column:
    return -rolling_mean("ret", k)


def reversal_vol(k: int = 16) -> Column:
    return -F.col("ret") / F.sqrt(positive(rolling_variance("ret", k, 1)))


def vol_scaled_momentum(k: int = 16) -> Column:
    return rolling_sum("ret", k) / F.sqrt(positive(rolling_variance("ret", k)))


def blended_momentum(lenses: tuple[int, ...] = (8, 16, 32)) -> Column:
    parts = [vol_scaled_momentum(k) for k in lenses]
    n = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in parts), F.lit(0))
    return F.when(n >= 2, sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)) / n)


def regime_gated_momentum(k: int = 16, gate: int = 32, z: float = 2.0) -> Column:
    v, g = positive(rolling_variance("ret", gate)), rolling_sum("ret", gate)
    shut = F.coalesce(g <= -z * F.sqrt(v) * (gate**0.5), F.lit(False))
    return F.when(~shut, rolling_sum("ret", k))


def panel_mean(x: str, least: int = 2) -> Column:
    """Mean of ``x`` over the streams that have it at one stamp; null under ``least`` of them."""
    w = Window.partitionBy("us")
    return F.when(F.count(x).over(w) >= least, F.avg(x).over(w))


def demeaned(x: str) -> Column:
    return F.col(x) - panel_mean(x)


def cross_sectional_reversal() -> Column:
    return -(F.col("ret") - panel_mean("ret"))


def network_momentum(x: str = "vsm") -> Column:
    """Mean of the other streams' ``x`` at the stamp."""
    w = Window.partitionBy("us")
    n = F.count(x).over(w) - F.when(F.col(x).isNotNull(), 1).otherwise(0)
    return F.when(n >= 1, (F.sum(x).over(w) - F.coalesce(F.col(x), F.lit(0.0))) / n)


def causal_z(x: str, k: int = 32, least: int = 8) -> Column:
    """Z-score of ``x`` among its own last k values; 0 where there are too few or they do not vary."""
    w = last_k(k)
    m, s = F.avg(x).over(w), F.stddev_samp(x).over(w)
    ok = F.col(x).isNotNull() & (F.count(x).over(w) >= least) & (s > 1e-9 * F.greatest(F.lit(1e-3), F.abs(m)))
    return F.when(ok, (F.col(x) - m) / s).otherwise(0.0)


def clamp_position(z: Column, saturation: float = 2.0) -> Column:
    """z / saturation within [-1, 1]; 0 where z is missing."""
    return F.when(z.isNull(), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z / saturation)))


FEATURES = {
    "momentum": momentum, "vol_regime": vol_regime, "momentum_agreement": momentum_agreement, "range_location": range_location,
    "volume_imbalance": volume_imbalance, "autocorr1": autocorr1, "acceleration": acceleration, "reversal": reversal,
    "reversal_window": reversal_window, "reversal_vol": reversal_vol, "vol_scaled_momentum": vol_scaled_momentum,
    "blended_momentum": blended_momentum, "regime_gated_momentum": regime_gated_momentum,
}


def base(candles: DataFrame) -> DataFrame:
    """Bars in chunks with their halo, returns and previous returns: what the features read."""
    rows = bar_returns(with_halo(numbered(candles), ahead=1))
    return rows.withColumn("prev_ret", F.lag("ret").over(order()))


def features(candles: DataFrame) -> DataFrame:
    """``(stream, us, <feature> ...)`` for every bar. One shuffle by chunk serves all windows."""
    rows = base(candles).withColumn("fd_16", frac_diff(F.ln("close")))
    rows = rows.withColumns({n: f() for n, f in FEATURES.items()})
    rows = rows.withColumn("frac_momentum", frac_momentum())
    return own(rows).select("stream", "us", *[F.round(n, DECIMALS).alias(n) for n in (*FEATURES, "frac_momentum")])


def positions(candles: DataFrame, feature: str = "momentum") -> DataFrame:
    """The chunked rows with ``position``, the clamped causal z-score of a feature."""
    rows = base(candles).withColumn(feature, FEATURES[feature]())
    return rows.withColumn("position", clamp_position(causal_z(feature)))


def q_features(spark, sf_dir):
    return features(table(spark, sf_dir, "candles"))


def q_positions(spark, sf_dir):
    return own(positions(table(spark, sf_dir, "candles"))).select("stream", "us", F.round("position", DECIMALS).alias("position"))


def q_panel(spark, sf_dir):
    """Cross-sectional features of streams with bars at one stamp."""
    rows = own(base(table(spark, sf_dir, "candles")).withColumn("mom", momentum()).withColumn("vsm", F.lag(vsm_or_sum(), 1).over(order())))
    rows = rows.withColumns({"xs_reversal": cross_sectional_reversal(), "xs_momentum": demeaned("mom"), "network_momentum": network_momentum()})
    return rows.select("stream", "us", *[F.round(c, DECIMALS).alias(c) for c in ("xs_reversal", "xs_momentum", "network_momentum")])


def vsm_or_sum() -> Column:
    return F.coalesce(vol_scaled_momentum(), momentum())


def _w(k, back=0):
    return f"(partition by stream order by i rows between {k - 1 + back} preceding and {back} {'preceding' if back else 'following'})".replace("and 0 following", "and current row")


def _sql_full(agg, of, k, back=0):
    return f"case when count({of}) over {_w(k, back)} = {k} then {agg} over {_w(k, back)} end"


_S = {k: _sql_full("sum(ret)", "ret", k) for k in (4, 8, 16, 32)}
_V = {k: f"(case when {_sql_full('var_samp(ret)', 'ret', k)} > 1e-18 then {_sql_full('var_samp(ret)', 'ret', k)} end)" for k in (8, 16, 32)}
_FD = " + ".join(f"{w!r} * ln(lag(close, {k}) over (partition by stream order by i))" for k, w in enumerate(fractional_diff_weights(0.4, 16)))


def _nullmean(parts, least=2):
    n = " + ".join(f"(({p}) is not null)::int" for p in parts)
    return f"case when {n} >= {least} then ({' + '.join(f'coalesce({p}, 0)' for p in parts)}) / ({n}) end"


FEATURE_SQL = {
    "momentum": _S[16],
    "vol_regime": f"sqrt(({_sql_full('var_samp(ret)', 'ret', 8)}) / {_V[32]}) - 1",
    "momentum_agreement": _nullmean([f"sign(round({_S[k]}, 12))" for k in (4, 8, 16, 32)]),
    "range_location": f"case when count(*) over {_w(32)} = 32 and max(close) over {_w(32)} > min(close) over {_w(32)} then (close - min(close) over {_w(32)}) / (max(close) over {_w(32)} - min(close) over {_w(32)}) - 0.5 end",
    "volume_imbalance": f"case when ({_sql_full('avg(volume)', 'volume', 32)}) > 0 then ({_sql_full('avg(volume)', 'volume', 8)}) / ({_sql_full('avg(volume)', 'volume', 32)}) - 1 end",
    "autocorr1": f"case when i >= 33 and sum(ret * ret) over {_w(32)} - 32 * pow(avg(ret) over {_w(32)}, 2) > 1e-18 then (sum(ret * prev_ret) over {_w(32)} - avg(ret) over {_w(32)} * sum(prev_ret) over {_w(32)}) / (sum(ret * ret) over {_w(32)} - 32 * pow(avg(ret) over {_w(32)}, 2)) end",
    "acceleration": f"({_S[16]}) - ({_sql_full('sum(ret)', 'ret', 16, 16)})",
    "reversal": "case when i >= 1 then -ret end",
    "reversal_window": f"-({_sql_full('avg(ret)', 'ret', 4)})",
    "reversal_vol": f"-ret / sqrt(case when {_sql_full('var_samp(ret)', 'ret', 16, 1)} > 1e-18 then {_sql_full('var_samp(ret)', 'ret', 16, 1)} end)",
    "vol_scaled_momentum": f"({_S[16]}) / sqrt({_V[16]})",
    "blended_momentum": _nullmean([f"({_S[k]}) / sqrt({_V[k]})" for k in (8, 16, 32)]),
    "regime_gated_momentum": f"case when not coalesce(({_S[32]}) <= -2 * sqrt({_V[32]}) * sqrt(32), false) then {_S[16]} end",
    "frac_momentum": "fd - lag(fd) over (partition by stream order by i)",
}

_BASE_SQL = f"with {BARS_SQL}, p as (select *, lag(ret) over (partition by stream order by i) prev_ret, {_FD} fd from r)"
FEATURES_SQL = _BASE_SQL + " select stream, us, " + ", ".join(f"round({x}, 8) as {n}" for n, x in FEATURE_SQL.items()) + " from p"
Z_SQL = f"""case when {{x}} is not null and count({{x}}) over {_w(32)} >= 8 and stddev_samp({{x}}) over {_w(32)} > 1e-9 * greatest(1e-3, abs(avg({{x}}) over {_w(32)}))
  then ({{x}} - avg({{x}}) over {_w(32)}) / stddev_samp({{x}}) over {_w(32)} else 0 end"""
POSITION_SQL = f"with {BARS_SQL}, m as (select *, {_S[16]} mom from r), z as (select *, {Z_SQL.format(x='mom')} z from m), pos as (select *, greatest(-1, least(1, z / 2)) as position from z)"
POSITIONS_SQL = POSITION_SQL + " select stream, us, round(position, 8) as position from pos"
PANEL_SQL = f"""with {BARS_SQL}, m as (select *, {_S[16]} mom, coalesce(({_S[16]}) / sqrt({_V[16]}), {_S[16]}) v from r),
l as (select *, lag(v) over (partition by stream order by i) vsm from m)
select stream, us, round(-(ret - case when count(*) over t >= 2 then avg(ret) over t end), 8) as xs_reversal,
  round(mom - case when count(mom) over t >= 2 then avg(mom) over t end, 8) as xs_momentum,
  round(case when count(vsm) over t - (vsm is not null)::int >= 1 then (sum(vsm) over t - coalesce(vsm, 0)) / (count(vsm) over t - (vsm is not null)::int) end, 8) as network_momentum
from l window t as (partition by us)"""
