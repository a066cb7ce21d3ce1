"""Volatility estimates, forecasts and their combination, and scores of probability forecasts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.bars import BARS_SQL, bar_returns, full, numbered, order, own, with_halo
from tidewright.operators.features import POSITION_SQL, positions
from tidewright.session import table

LN2 = math.log(2)
DAY_US = 86_400_000_000


def bar_variance(estimator: str = "parkinson") -> Column:
    """Variance of one bar from its prices: cc (close on open), parkinson, garman_klass, rogers_satchell."""
    hl, co = F.ln(F.col("high") / F.col("low")), F.ln(F.col("close") / F.col("open"))
    return {
        "cc": co * co,
        "parkinson": hl * hl / (4 * LN2),
        "garman_klass": hl * hl / 2 - (2 * LN2 - 1) * co * co,
        "rogers_satchell": F.ln(F.col("high") / F.col("close")) * F.ln(F.col("high") / F.col("open")) + F.ln(F.col("low") / F.col("close")) * F.ln(F.col("low") / F.col("open")),
    }[estimator]


def not_negative(x: Column) -> Column:
    """Negative rounding noise made 0; null stays null."""
    return F.when(x < 0, 0.0).otherwise(x)


def realized_volatility(x: str = "ret", k: int = 24) -> Column:
    return F.sqrt(full(F.avg(F.col(x) * F.col(x)), x, k))


def yang_zhang(k: int = 24) -> Column:
    """Rolling Yang-Zhang volatility; reads columns on (overnight), oc (open to close) and rs."""
    w = 0.34 / (1.34 + (k + 1) / (k - 1))
    v = full(F.var_samp("on"), "on", k) + w * full(F.var_samp("oc"), "oc", k) + (1 - w) * full(F.avg("rs"), "rs", k)
    return F.sqrt(not_negative(v))


def volatilities(candles: DataFrame, k: int = 24) -> DataFrame:
    rows = bar_returns(with_halo(numbered(candles), 64))
    rows = rows.withColumns({e: bar_variance(e) for e in ("parkinson", "garman_klass", "rogers_satchell")})
    rows = rows.withColumns({"on": F.ln(F.col("open") / F.lag("close").over(order())), "oc": F.ln(F.col("close") / F.col("open")), "rs": F.col("rogers_satchell")})
    means = {f"{e}_vol": F.sqrt(not_negative(full(F.avg(e), e, k))) for e in ("parkinson", "garman_klass", "rogers_satchell")}
    return own(rows.withColumns({"realized": realized_volatility("ret", k), **means, "yang_zhang": yang_zhang(k)}))


def daily_vols(candles: DataFrame) -> DataFrame:
    """One root mean square return per stream and UTC day: what the forecasters read. A stream's
    days are few however many bars it has."""
    rows = bar_returns(with_halo(numbered(candles), 1)).where("own")
    return rows.groupBy("stream", F.expr(f"us div {DAY_US}").alias("day")).agg(F.sqrt(F.avg(F.col("ret") * F.col("ret"))).alias("vol"))


# forecasters over one short series -------------------------------------------------------------


def ewma_forecast(v: np.ndarray, decay: float = 0.94) -> np.ndarray:
    """Forecast of each value from those before it; the first forecasts itself."""
    out, y = np.empty(len(v)), v[0]
    for i, x in enumerate(v):
        out[i] = y
        y = decay * y + (1 - decay) * x
    return out


def solve_ridge(x: np.ndarray, y: np.ndarray, l2: float = 0.0) -> np.ndarray | None:
    """Least squares with an unpenalised intercept in column 0; None where the matrix is singular."""
    a = x.T @ x + l2 * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    try:
        return np.linalg.solve(a, x.T @ y)
    except np.linalg.LinAlgError:
        return None


def ar_design(v: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.column_stack([np.ones(len(v) - p), *[v[p - k : len(v) - k] for k in range(1, p + 1)]])
    return x, v[p:]


def har_design(v: np.ndarray, spans: tuple[int, ...] = (1, 5, 22)) -> tuple[np.ndarray, np.ndarray]:
    m = max(spans)
    sums = np.concatenate(([0.0], np.cumsum(v)))
    t = np.arange(m, len(v))
    return np.column_stack([np.ones(len(t)), *[(sums[t] - sums[t - k]) / k for k in spans]]), v[m:]


def skill(actual: np.ndarray, forecast: np.ndarray, base: np.ndarray) -> float:
    """1 - MSE / MSE of the baseline."""
    b = np.mean((actual - base) ** 2)
    return float(1 - np.mean((actual - forecast) ** 2) / b) if b > 0 else 0.0


def qlike_skill(actual: np.ndarray, forecast: np.ndarray, base: np.ndarray) -> float:
    ok = (actual > 0) & (forecast > 0) & (base > 0)
    loss = lambda f: np.mean(actual[ok] ** 2 / f[ok] ** 2 - np.log(actual[ok] ** 2 / f[ok] ** 2) - 1)
    b = loss(base) if ok.any() else 0.0
    return float(1 - loss(forecast) / b) if b > 0 else 0.0


def combine_weights(y: np.ndarray, x: np.ndarray, method: str = "ols", l1: float = 0.01, eta: float = 2.0) -> np.ndarray:
    """Weights of forecast columns: least squares, inverse error, equal, exponential in relative
    error (gibbs) or lasso by coordinate descent on columns scaled to unit mean square."""
    k = x.shape[1]
    mse = ((x - y[:, None]) ** 2).mean(0)
    if method == "ols":
        w = solve_ridge(np.column_stack([np.zeros(len(y)), x])[:, 1:], y) if k == 1 else np.linalg.lstsq(x, y, rcond=None)[0]
        return np.full(k, 1 / k) if w is None else w
    if method == "inverse":
        return (1 / mse) / (1 / mse).sum() if (mse > 0).all() else np.full(k, 1 / k)
    if method == "gibbs":
        w = np.exp(-eta * (mse / mse.min() - 1)) if mse.min() > 0 else np.full(k, 1.0)
        return w / w.sum()
    if method == "lasso":
        s, sy = np.sqrt((x**2).mean(0)), math.sqrt((y**2).mean()) or 1.0
        s = np.where(s > 0, s, 1)
        z, t, b = x / s, y / sy, np.zeros(k)
        for _ in range(200):
            for j in range(k):
                r = np.mean(z[:, j] * (t - z @ b + z[:, j] * b[j]))
                b[j] = math.copysign(max(abs(r) - l1, 0.0), r) / np.mean(z[:, j] ** 2)
        return b * sy / s
    return np.full(k, 1 / k)


def one_step(v: np.ndarray, cut_at: int, order_: int = 1) -> dict[str, np.ndarray]:
    """One-step forecasts of v[cut_at:] from fits on v[:cut_at]."""
    out = {"ewma": ewma_forecast(v)[cut_at:], "mean": np.full(len(v) - cut_at, v[:cut_at].mean())}
    for name, design in (("ar", lambda s: ar_design(s, order_)), ("har", har_design)):
        x, y = design(v)
        lead = len(v) - len(y)
        n = cut_at - lead
        b = solve_ridge(x[:n], y[:n]) if n > x.shape[1] + 1 else None
        out[name] = out["mean"] if b is None else x[n:] @ b
    return out


def tournament_frame(pdf: pd.DataFrame, splits: tuple[float, ...] = (0.3, 0.5, 0.7), fewest: int = 60) -> pd.DataFrame:
    """Skill of every forecaster and combination on the days after each split, against the mean before it."""
    v = pdf.sort_values("day")["vol"].to_numpy(float)
    rows = []
    for s in splits:
        at = int(len(v) * s)
        if len(v) < fewest or at < 30:
            continue
        f, y = one_step(v, at), v[at:]
        half = max(5, len(y) // 2)
        cols = np.column_stack([f["ewma"], f["ar"], f["har"]])
        scores = {n: (skill(y, f[n], f["mean"]), qlike_skill(y, f[n], f["mean"])) for n in ("ewma", "ar", "har")}
        for m in ("equal", "ols", "inverse", "gibbs", "lasso"):
            g = cols @ combine_weights(y[:half], cols[:half], m)
            scores[f"combined_{m}"] = (skill(y[half:], g[half:], f["mean"][half:]), qlike_skill(y[half:], g[half:], f["mean"][half:]))
        best = max(("ewma", "ar", "har"), key=lambda n, c=scores: c[n][0])
        rows += [(pdf["stream"].iloc[0], s, n, round(a, 8), round(q, 8), n == best) for n, (a, q) in scores.items()]
    return pd.DataFrame(rows, columns=["stream", "split", "model", "skill", "qlike_skill", "winner"])


def tournament(candles: DataFrame) -> DataFrame:
    return daily_vols(candles).groupBy("stream").applyInPandas(lambda pdf: tournament_frame(pdf), "stream string, split double, model string, skill double, qlike_skill double, winner boolean")


def expanding_forecasts(v: np.ndarray, least: int = 100, step: int = 1) -> np.ndarray:
    """HAR forecasts, refitted on all history at every ``step``."""
    x, y = har_design(v)
    lead, out, b = len(v) - len(y), np.full(len(v), np.nan), None
    for t in range(least, len(v)):
        if (t - least) % step == 0:
            b = solve_ridge(x[: t - lead], y[: t - lead])
        if b is not None:
            out[t] = x[t - lead] @ b
    return out


# probability forecasts ---------------------------------------------------------------------------


def forecast_pairs(rows: DataFrame) -> DataFrame:
    """``(stream, i, p, outcome)``: a position in [-1, 1] as the chance that the next return is positive."""
    rows = rows.withColumn("next", F.lead("ret").over(order())).withColumn("p", (F.col("position") + 1) / 2)
    return rows.where("own and next is not null").select("stream", "i", "p", F.when(F.col("next") > 0, 1).otherwise(0).alias("outcome"))


def brier_bin(p: Column, bins: int = 10) -> Column:
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.round(p * bins, 9)))).cast("int")


def brier_score(p: str = "p", y: str = "outcome") -> Column:
    return F.avg(F.pow(F.col(p) - F.col(y), F.lit(2)))


def log_score(p: str = "p", y: str = "outcome", eps: float = 1e-15) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(p)))
    return F.avg(-F.when(F.col(y) == 1, F.ln(q)).otherwise(F.ln(1 - q)))


def reliability(pairs: DataFrame, bins: int = 10) -> DataFrame:
    return pairs.groupBy("stream", brier_bin(F.col("p"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("outcome").alias("mean_y"), brier_score().alias("brier"), F.sum("p").alias("sp"), F.sum("outcome").alias("sy"))


def brier_decomposition(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """Murphy's parts per stream: reliability - resolution + uncertainty is the binned score;
    ``within`` is what binning leaves out of the full score."""
    b = reliability(pairs, bins)
    tot = b.groupBy("stream").agg(F.sum("n").alias("total"), (F.sum("sy") / F.sum("n")).alias("base"), (F.sum(F.col("n") * F.col("brier")) / F.sum("n")).alias("score"))
    j = b.join(tot, "stream").groupBy("stream").agg(
        F.first("total").alias("n"), F.first("score").alias("brier"), F.first("base").alias("base"),
        (F.sum(F.col("n") * F.pow(F.col("mean_p") - F.col("mean_y"), F.lit(2))) / F.first("total")).alias("reliability"),
        (F.sum(F.col("n") * F.pow(F.col("mean_y") - F.col("base"), F.lit(2))) / F.first("total")).alias("resolution"),
    )
    unc = F.col("base") * (1 - F.col("base"))
    return j.select("stream", "n", *[F.round(x, 8).alias(a) for a, x in (("brier", F.col("brier")), ("reliability", F.col("reliability")), ("resolution", F.col("resolution")), ("uncertainty", unc), ("within", F.col("brier") - (F.col("reliability") - F.col("resolution") + unc)))])


SPANS, WINDOW, ETA = (1, 5, 22), 60, 2.0


def rolling_combination(rows: DataFrame, spans: tuple[int, ...] = SPANS, window: int = WINDOW, eta: float = ETA) -> DataFrame:
    """Per stream the mean squared errors of forecasts of a bar's absolute return, the means of the last ``spans``
    values, and of their combinations: equal, inverse and Gibbs weights by the errors of the ``window`` bars
    before. Everything is a frame behind the bar; bars without a full window are not scored."""
    w = order()
    a = F.abs("ret")
    rows = rows.withColumn("y", a)
    f = {f"f{k}": F.when(F.count("y").over(w.rowsBetween(-k, -1)) == k, F.avg("y").over(w.rowsBetween(-k, -1))) for k in spans}
    rows = rows.withColumns(f).withColumns({f"e{k}": F.pow(F.col("y") - F.col(f"f{k}"), F.lit(2)) for k in spans})
    back = w.rowsBetween(-window, -1)
    rows = rows.withColumns({f"m{k}": F.when(F.count(f"e{k}").over(back) == window, F.avg(f"e{k}").over(back)) for k in spans})
    ok = F.least(*[F.col(f"m{k}") for k in spans]) > 0
    for k in spans:
        ok = ok & F.col(f"m{k}").isNotNull()
    rows = own(rows).where(F.coalesce(ok, F.lit(False)))
    least = F.least(*[F.col(f"m{k}") for k in spans])
    raw = {"eq": lambda k: F.lit(1.0), "inv": lambda k: 1 / F.col(f"m{k}"), "gibbs": lambda k: F.exp(-eta * (F.col(f"m{k}") / least - 1))}
    combined = {n: sum((g(k) * F.col(f"f{k}") for k in spans), F.lit(0.0)) / sum((g(k) for k in spans), F.lit(0.0)) for n, g in raw.items()}
    rows = rows.withColumns({f"c_{n}": F.pow(F.col("y") - x, F.lit(2)) for n, x in combined.items()})
    return rows.groupBy("stream").agg(F.count(F.lit(1)).alias("scored"), *[F.round(F.avg(f"e{k}") * 1e8, 4).alias(f"mse_{k}") for k in spans], *[F.round(F.avg(f"c_{n}") * 1e8, 4).alias(f"mse_{n}") for n in combined])


def q_combination(spark, sf_dir):
    return rolling_combination(bar_returns(with_halo(numbered(table(spark, sf_dir, "candles")))))


def q_volatility(spark, sf_dir):
    out = volatilities(table(spark, sf_dir, "candles"))
    return out.select("stream", "us", *[F.round(c, 8).alias(c) for c in ("realized", "parkinson_vol", "garman_klass_vol", "rogers_satchell_vol", "yang_zhang")])


def q_tournament(spark, sf_dir):
    return tournament(table(spark, sf_dir, "candles"))


def q_brier(spark, sf_dir):
    return brier_decomposition(forecast_pairs(positions(table(spark, sf_dir, "candles"))))


def q_scores(spark, sf_dir):
    pairs = forecast_pairs(positions(table(spark, sf_dir, "candles")))
    return pairs.groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.round(brier_score(), 8).alias("brier"), F.round(log_score(), 8).alias("log_score"), F.round(F.avg("outcome"), 8).alias("base_rate"))


def q_ar1(spark, sf_dir):
    """AR(1) of the absolute returns per stream by sums: slope, intercept and fit."""
    rows = bar_returns(with_halo(numbered(table(spark, sf_dir, "candles")), 2)).withColumn("x", F.abs("ret"))
    rows = rows.withColumn("lagged", F.lag("x").over(order())).where("own and lagged is not null")
    return rows.groupBy("stream").agg(F.round(F.regr_slope("x", "lagged"), 8).alias("slope"), F.round(F.regr_intercept("x", "lagged"), 8).alias("intercept"), F.round(F.regr_r2("x", "lagged"), 8).alias("r2"))


_K = "over (partition by stream order by i rows between 23 preceding and current row)"


def _f(agg: str, of: str) -> str:
    return f"case when count({of}) {_K} = 24 then {agg} {_K} end"


_WYZ = 0.34 / (1.34 + 25 / 23)
VOL_SQL = f"""with {BARS_SQL}, x as (select *, pow(ln(high / low), 2) / (4 * ln(2)) pk, pow(ln(high / low), 2) / 2 - (2 * ln(2) - 1) * pow(ln(close / open), 2) gk,
  ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) rs, ln(open / lag(close) over (partition by stream order by i)) as ovn, ln(close / open) oc from r)
select stream, us, round(sqrt({_f('avg(ret * ret)', 'ret')}), 8) as realized, round(sqrt(case when count(pk) {_K} = 24 then greatest(avg(pk) {_K}, 0) end), 8) as parkinson_vol,
  round(sqrt(case when count(gk) {_K} = 24 then greatest(avg(gk) {_K}, 0) end), 8) as garman_klass_vol, round(sqrt(case when count(rs) {_K} = 24 then greatest(avg(rs) {_K}, 0) end), 8) as rogers_satchell_vol,
  round(sqrt(case when count(ovn) {_K} = 24 then greatest(({_f('var_samp(ovn)', 'ovn')}) + {_WYZ!r} * ({_f('var_samp(oc)', 'oc')}) + (1 - {_WYZ!r}) * ({_f('avg(rs)', 'rs')}), 0) end), 8) as yang_zhang from x"""
_PAIRS = POSITION_SQL + ", fp as (select stream, i, (position + 1) / 2 p, (lead(ret) over (partition by stream order by i) > 0)::int y from pos), q as (select * from fp where y is not null)"
SCORES_SQL = _PAIRS + """ select stream, count(*) as n, round(avg(pow(p - y, 2)), 8) as brier,
  round(avg(-case when y = 1 then ln(greatest(1e-15, least(1 - 1e-15, p))) else ln(1 - greatest(1e-15, least(1 - 1e-15, p))) end), 8) as log_score, round(avg(y), 8) as base_rate from q group by 1"""
BRIER_SQL = _PAIRS + """, bn as (select stream, least(9, greatest(0, floor(round(p * 10, 9)))) bin, count(*) n, avg(p) mp, avg(y) my, avg(pow(p - y, 2)) br from q group by 1, 2),
tt as (select stream, count(*) n, avg(y) base, avg(pow(p - y, 2)) br from q group by 1),
dd as (select stream, any_value(tt.n) n, any_value(tt.br) br, any_value(base) base, sum(bn.n * pow(mp - my, 2)) / any_value(tt.n) rel, sum(bn.n * pow(my - base, 2)) / any_value(tt.n) res from bn join tt using (stream) group by 1)
select stream, n, round(br, 8) as brier, round(rel, 8) as reliability, round(res, 8) as resolution, round(base * (1 - base), 8) as uncertainty, round(br - (rel - res + base * (1 - base)), 8) as within from dd"""
AR1_SQL = f"""with {BARS_SQL}, x as (select stream, abs(ret) x, abs(lag(ret) over (partition by stream order by i)) l from r)
select stream, round(regr_slope(x, l), 8) as slope, round(regr_intercept(x, l), 8) as intercept, round(regr_r2(x, l), 8) as r2 from x where l is not null group by 1"""

_FC = ", ".join(f"case when count(y) over (partition by stream order by i rows between {k} preceding and 1 preceding) = {k} then avg(y) over (partition by stream order by i rows between {k} preceding and 1 preceding) end f{k}" for k in SPANS)
_MS = ", ".join(f"case when count(e{k}) over w = {WINDOW} then avg(e{k}) over w end m{k}" for k in SPANS)
_BESTM = "least(" + ", ".join(f"m{k}" for k in SPANS) + ")"


def _combined(g) -> str:
    return "(" + " + ".join(f"({g(k)}) * f{k}" for k in SPANS) + ") / (" + " + ".join(f"({g(k)})" for k in SPANS) + ")"


COMBINATION_SQL = f"""with {BARS_SQL}, y as (select stream, i, abs(ret) y from r), f as (select *, {_FC} from y), e as (select *, {", ".join(f"pow(y - f{k}, 2) e{k}" for k in SPANS)} from f),
ms as (select *, {_MS} from e window w as (partition by stream order by i rows between {WINDOW} preceding and 1 preceding)), ok as (select * from ms where {" and ".join(f"m{k} > 0" for k in SPANS)}),
cb as (select *, pow(y - {_combined(lambda k: '1.0')}, 2) ceq, pow(y - {_combined(lambda k: f'1 / m{k}')}, 2) cinv, pow(y - {_combined(lambda k: f'exp(-{ETA} * (m{k} / {_BESTM} - 1))')}, 2) cg from ok)
select stream, count(*) as scored, {", ".join(f"round(avg(e{k}) * 1e8, 4) as mse_{k}" for k in SPANS)}, round(avg(ceq) * 1e8, 4) as mse_eq, round(avg(cinv) * 1e8, 4) as mse_inv, round(avg(cg) * 1e8, 4) as mse_gibbs from cb group by 1"""

QUERIES = {"volatility": (q_volatility, VOL_SQL), "volatility_tournament": (q_tournament, None), "brier_decomposition": (q_brier, BRIER_SQL), "forecast_scores": (q_scores, SCORES_SQL), "ar1_fit": (q_ar1, AR1_SQL), "rolling_combination": (q_combination, COMBINATION_SQL)}
