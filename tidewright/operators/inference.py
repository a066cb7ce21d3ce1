"""Tests and standard errors that respect dependence: correlations between streams, clusters,
bootstraps over blocks, reality checks, subsampling and overfitting.

The matrix these tests read, periods by strategies, is an aggregate of a bounded size (one row a
day); its size is checked before it reaches a worker. The replicates are what is many, and they
are spread over tasks by number, each with its own seed.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import stats
from tidewright.operators.bars import BARS_SQL, bar_returns, numbered, order, own, with_halo
from tidewright.operators.features import FEATURES, base, causal_z, clamp_position
from tidewright.session import cut, join_small, table

DAY_US = 86_400_000_000
#: Most numbers in a panel that may be sent to workers whole.
PANEL_CELLS = 20_000_000
STRATEGIES = ("momentum", "range_location", "volume_imbalance", "reversal_window", "acceleration")


# series -----------------------------------------------------------------------------------------


def mulberry32(seed: int) -> Callable[[], float]:
    """The 32-bit generator of that name: numbers in [0, 1)."""
    state = seed & 0xFFFFFFFF

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = state
        t = ((t ^ (t >> 15)) * (t | 1)) & 0xFFFFFFFF
        t ^= (t + ((t ^ (t >> 7)) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296

    return draw


def stationary_indices(n: int, block: float, rng: np.random.Generator) -> np.ndarray:
    """A path through 0 .. n-1 that jumps with chance 1 / block and else goes on, around the end."""
    jump = rng.random(n) < 1 / max(1.0, block)
    jump[0] = True
    starts = rng.integers(0, n, n)
    since = np.arange(n) - np.maximum.accumulate(np.where(jump, np.arange(n), 0))
    return (starts[np.maximum.accumulate(np.where(jump, np.arange(n), 0))] + since) % n


def politis_white(x: np.ndarray) -> float:
    """Automatic block length of the stationary bootstrap (Politis and White, 2004; corrected 2009)."""
    n = len(x)
    if n < 8 or np.std(x) == 0:
        return 1.0
    d = x - x.mean()
    most = int(math.ceil(math.sqrt(n))) + max(5, int(math.sqrt(math.log10(n))))
    acov = np.array([d[: n - k] @ d[k:] / n for k in range(min(most, n - 1) + 1)])
    rho = acov / acov[0]
    run, bound = max(5, int(math.ceil(math.sqrt(math.log10(n))))), 2 * math.sqrt(math.log10(n) / n)
    m = next((k for k in range(len(rho) - run) if (np.abs(rho[k + 1 : k + 1 + run]) < bound).all()), len(rho) - 1)
    m = min(2 * max(1, m), len(acov) - 1)
    k = np.arange(1, m + 1)
    lam = np.clip(2 * (1 - k / m), 0, 1) if m else np.zeros(0)
    g = 2 * (lam * k * acov[1 : m + 1]).sum()
    spread = acov[0] + 2 * (lam * acov[1 : m + 1]).sum()
    if spread <= 0:
        return 1.0
    return float(min(max(1.0, (2 * g * g / (2 * spread**2)) ** (1 / 3) * n ** (1 / 3)), math.ceil(min(3 * math.sqrt(n), n / 3))))


def newey_west(x: np.ndarray, bandwidth: int) -> float:
    """Standard error of the mean with Bartlett weights."""
    d, n = x - x.mean(), len(x)
    v = d @ d / n + 2 * sum((1 - k / (bandwidth + 1)) * (d[:-k] @ d[k:]) / n for k in range(1, min(bandwidth, n - 1) + 1))
    return math.sqrt(max(v, 0.0) / n)


def first_pc(panel: np.ndarray) -> np.ndarray:
    """Weights of the first principal component, its largest weight positive."""
    w = np.linalg.eigh(np.cov(panel, rowvar=False).reshape(panel.shape[1], -1))[1][:, -1]
    return w * np.sign(w[np.abs(w).argmax()])


def factor_neutral(x: np.ndarray, panel: np.ndarray) -> np.ndarray:
    f = (panel - panel.mean(0)) @ first_pc(panel)
    b = (f @ (x - x.mean())) / (f @ f) if f @ f > 0 else 0.0
    return x - b * f


def sharpe(x: np.ndarray) -> float:
    if len(x) < 2:
        return math.nan
    s = x.std(ddof=1)
    return float(x.mean() / s) if s > 0 else 0.0


# clusters ---------------------------------------------------------------------------------------


def cluster_jackknife(clusters: list[np.ndarray], statistic=sharpe) -> tuple[float, float]:
    """The statistic and its standard error from leaving out one cluster at a time."""
    c = len(clusters)
    left = np.array([statistic(np.concatenate(clusters[:k] + clusters[k + 1 :])) for k in range(c)])
    return statistic(np.concatenate(clusters)), math.sqrt((c - 1) / c * ((left - left.mean()) ** 2).sum())


def paired_cluster_test(a: list[np.ndarray], b: list[np.ndarray], statistic=sharpe, alpha: float = 0.05) -> dict:
    c = len(a)
    full_ = statistic(np.concatenate(a)) - statistic(np.concatenate(b))
    drop = lambda x, k: np.concatenate(x[:k] + x[k + 1 :])
    left = np.array([statistic(drop(a, k)) - statistic(drop(b, k)) for k in range(c)])
    se = math.sqrt((c - 1) / c * ((left - left.mean()) ** 2).sum())
    t = full_ / se if se > 0 else 0.0
    wins = sum(statistic(x) > statistic(y) for x, y in zip(a, b, strict=True))
    return {"difference": full_, "se": se, "t": t, "p": stats.student_t_p(t, c - 1), "significant": abs(t) > stats.student_t_critical(c - 1, alpha, True),
            "stable": float((left > 0).mean()), "sign_p": stats.sign_test(wins, c)}


# replicates -------------------------------------------------------------------------------------


def replicates(spark: SparkSession, panel: np.ndarray, n: int, block: float | None = None, seed: int = 1, slices: int = 8) -> np.ndarray:
    """``n`` bootstrap means of every column, resampled in blocks; replicate r depends on (seed, r) alone."""
    if panel.size > PANEL_CELLS:
        raise ValueError("the panel is too large to be sent whole; aggregate it to longer periods")
    length = float(np.mean([politis_white(panel[:, j]) for j in range(panel.shape[1])])) if block is None else block

    def run(frames):
        for f in frames:
            means = np.array([panel[stationary_indices(len(panel), length, np.random.default_rng([seed, int(r)]))].mean(0) for r in f["id"]])
            yield pd.DataFrame({"id": f["id"], "means": list(means)})

    rows = spark.range(0, n, 1, slices).mapInPandas(run, "id bigint, means array<double>")
    return np.array([r["means"] for r in rows.orderBy("id").collect()])


def white_reality_check(panel: np.ndarray, boot: np.ndarray) -> float:
    mean, n = panel.mean(0), len(panel)
    return float((math.sqrt(n) * (boot - mean).max(1) > math.sqrt(n) * mean.max()).mean())


def _studentised(panel: np.ndarray, boot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = panel.mean(0)
    omega = np.sqrt(((boot - mean) ** 2).mean(0))
    return np.where(omega > 0, mean / np.where(omega > 0, omega, 1), 0.0), omega


def hansen_spa(panel: np.ndarray, boot: np.ndarray, consistent: bool = False) -> float:
    """Superior predictive ability; the consistent form does not recentre columns far below 0."""
    t, omega = _studentised(panel, boot)
    n, mean = len(panel), panel.mean(0)
    centre = np.where(mean >= -omega * math.sqrt(2 * math.log(math.log(max(n, 3)))), mean, 0.0) if consistent else mean
    tb = (boot - centre) / np.where(omega > 0, omega, np.inf)
    return float((np.maximum(tb.max(1), 0) > max(t.max(), 0)).mean())


def step_down(t: np.ndarray, tb: np.ndarray, alpha: float = 0.05, k: int = 1) -> list[int]:
    """Step-down rejection on statistics and their reference draws, with the k-th largest for k-FWER."""
    left, out = set(range(len(t))), []
    while len(left) >= k:
        cols = sorted(left)
        level = np.quantile(np.sort(tb[:, cols], axis=1)[:, -k], 1 - alpha)
        new = [j for j in cols if t[j] > level]
        if not new:
            break
        out += new
        left -= set(new)
    return sorted(out)


def step_m(panel: np.ndarray, boot: np.ndarray, alpha: float = 0.05) -> list[int]:
    t, omega = _studentised(panel, boot)
    return step_down(t, (boot - panel.mean(0)) / np.where(omega > 0, omega, np.inf), alpha)


def window_statistics(panel: np.ndarray, window: int, bandwidth: int, starts: np.ndarray) -> np.ndarray:
    """Of the windows that begin at ``starts`` the studentised means, recentred by the whole's. Sums
    are taken anew in every window: running sums would carry one wild day's rounding into all others."""
    n, mean = len(panel), panel.mean(0)
    shrink, lags = math.sqrt(1 - window / n), range(1, min(bandwidth, window - 1) + 1)
    out = np.zeros((len(starts), panel.shape[1]))
    for row, s in zip(out, starts, strict=True):
        w = panel[s : s + window]
        m = w.mean(0)
        d = w - m
        v = (d * d).sum(0) / window + 2 * sum((1 - k / (bandwidth + 1)) * (d[:-k] * d[k:]).sum(0) / window for k in lags)
        e = np.sqrt(np.maximum(v, 0.0) / window)
        row[:] = np.where(e > 0, (m - mean) / shrink / np.where(e > 0, e, 1), 0.0)
    return out


def subsample_statistics(panel: np.ndarray, window: int, bandwidth: int, spark: SparkSession | None = None, slices: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Studentised means of the whole and of every window, recentred: no random numbers. With
    ``spark`` the windows are spread over tasks by their start, at any length of the panel."""
    n, mean = len(panel), panel.mean(0)
    se = np.array([newey_west(panel[:, j], bandwidth) for j in range(panel.shape[1])])
    t = np.where(se > 0, mean / np.where(se > 0, se, 1), 0.0)
    if spark is None:
        return t, window_statistics(panel, window, bandwidth, np.arange(n - window + 1))
    if panel.size > PANEL_CELLS:
        raise ValueError("the panel is too large to be sent whole; aggregate it to longer periods")

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "tb": list(window_statistics(panel, window, bandwidth, f["id"].to_numpy()))})

    rows = spark.range(0, n - window + 1, 1, slices).mapInPandas(run, "id bigint, tb array<double>").toPandas().sort_values("id")
    return t, np.stack(rows["tb"])


def subsampling_spa(panel: np.ndarray, window: int, bandwidth: int = 3) -> float:
    t, tb = subsample_statistics(panel, window, bandwidth)
    return float((tb.max(1) >= t.max()).mean())


def subsampling_fdp(t: np.ndarray, tb: np.ndarray, alpha: float = 0.05, target: float = 0.1) -> list[int]:
    """Step down with a growing number of allowed false rejections, floor(target l) + 1 at step l."""
    by, out = np.argsort(-t), []
    for step, j in enumerate(by, 1):
        k = int(target * step) + 1
        rest = [i for i in by if i not in out]
        if len(rest) < k or t[j] <= np.quantile(np.sort(tb[:, rest], axis=1)[:, -k], 1 - alpha):
            break
        out.append(int(j))
    return sorted(out)


def relative_rank(values: np.ndarray, i: int) -> float:
    """Rank of one value, ties averaged, over n + 1."""
    return ((values < values[i]).sum() + ((values == values[i]).sum() + 1) / 2) / (len(values) + 1)


def overfitting_probability(panel: np.ndarray, blocks: int = 8, most: int = 100_000) -> dict:
    """CSCV: how often the best half-sample strategy ends below the median of the other half."""
    if math.comb(blocks, blocks // 2) > most:
        raise ValueError("too many splits")
    parts = np.array_split(np.arange(len(panel)), blocks)
    n = np.array([len(p) for p in parts])
    s, q = (np.array([(panel[p] ** e).sum(0) for p in parts]) for e in (1, 2))
    logits, ins, outs = [], [], []
    for chosen in itertools.combinations(range(blocks), blocks // 2):
        rest = [b for b in range(blocks) if b not in chosen]
        r = []
        for side in (list(chosen), rest):
            m, v = s[side].sum(0) / n[side].sum(), q[side].sum(0) / n[side].sum()
            sd = np.sqrt(np.maximum(v - m * m, 0) * n[side].sum() / (n[side].sum() - 1))
            r.append(np.where(sd > 0, m / np.where(sd > 0, sd, 1), 0.0))
        best = int(r[0].argmax())
        w = relative_rank(r[1], best)
        logits.append(math.log(w / (1 - w)))
        ins.append(r[0][best])
        outs.append(r[1][best])
    slope = np.polyfit(ins, outs, 1)[0] if np.std(ins) > 0 else 0.0
    return {"splits": len(logits), "pbo": float((np.array(logits) <= 0).mean()), "slope": float(slope), "loss": float((np.array(outs) < 0).mean())}


def diebold_mariano(a: np.ndarray, b: np.ndarray, n: int = 500, seed: int = 12345) -> dict:
    d = a - b
    length = politis_white(d)
    means = np.array([d[stationary_indices(len(d), length, np.random.default_rng([seed, r]))].mean() for r in range(n)])
    se = means.std()
    return {"difference": float(d.mean()), "se": float(se), "p": float(((np.abs(means - d.mean()) >= abs(d.mean())).sum() + 1) / (n + 1))}


def model_confidence_set(losses: np.ndarray, alpha: float = 0.1, n: int = 500, seed: int = 12345) -> list[int]:
    """Models left when the worst is dropped while the range statistic rejects equality."""
    live = list(range(losses.shape[1]))
    length = float(np.mean([politis_white(losses[:, j]) for j in live]))
    boot = np.array([losses[stationary_indices(len(losses), length, np.random.default_rng([seed, r]))].mean(0) for r in range(n)])
    while len(live) > 1:
        m, b = losses[:, live].mean(0), boot[:, live]
        diff, bd = m[:, None] - m[None, :], b[:, :, None] - b[:, None, :] - (m[:, None] - m[None, :])
        se = np.sqrt((bd**2).mean(0))
        safe = np.where(se > 0, se, np.inf)
        stat, ref = np.abs(diff / safe).max(), np.abs(bd / safe).max((1, 2))
        if ((ref >= stat).sum() + 1) / (n + 1) >= alpha:
            break
        live.pop(int((diff / safe).mean(1).argmax()))
    return live


def interquartile_mean(x: np.ndarray) -> float:
    x = np.sort(x)
    k = len(x) // 4
    return float(x[k : len(x) - k].mean())


def stratified_bootstrap(strata: list[np.ndarray], statistic=np.mean, n: int = 2000, alpha: float = 0.05, seed: int = 12345) -> tuple[float, float]:
    rng = np.random.default_rng(seed)
    draws = [statistic(np.concatenate([rng.choice(s, len(s)) for s in strata])) for _ in range(n)]
    return float(np.quantile(draws, alpha / 2)), float(np.quantile(draws, 1 - alpha / 2))


def select_streams(corr: np.ndarray, most: int, least_gain: float = 0.0) -> list[int]:
    """Greedy choice of streams by the effective number of independent ones, k / (1 + (k - 1) rho)."""
    chosen = [0]
    size = lambda c: len(c) / (1 + (len(c) - 1) * max(0.0, np.mean([corr[i, j] for i, j in itertools.combinations(c, 2)]) if len(c) > 1 else 0.0))
    while len(chosen) < min(most, len(corr)):
        best = max((j for j in range(len(corr)) if j not in chosen), key=lambda j: size([*chosen, j]))
        if size([*chosen, best]) - size(chosen) < least_gain:
            break
        chosen.append(best)
    return chosen


# queries ----------------------------------------------------------------------------------------


def daily_returns(candles: DataFrame) -> DataFrame:
    """Sum of the returns of every stream and UTC day."""
    rows = own(bar_returns(with_halo(numbered(candles), 1)))
    return rows.groupBy("stream", F.expr(f"us div {DAY_US}").alias("day")).agg(F.round(F.sum("ret"), 12).alias("ret"))


#: Streams in one block, and days in one part, of the sums of products.
BLOCK_STREAMS, PART_DAYS = 256, 512


def pair_correlations(daily: DataFrame, least: int = 30, block: int = BLOCK_STREAMS) -> DataFrame:
    """Pearson correlation of every two streams that share ``least`` days.

    Streams are laid out in blocks and days in parts; two blocks meet once a part, as matrices of
    days by streams, and send on one row of sums a pair. So a day of many streams is no group,
    and what is shuffled does not grow with the days inside a part. Sums are taken about each
    stream's own mean. Days without a return count as missing.
    """
    daily = daily.where("ret is not null")
    means = cut(daily.groupBy(F.col("stream").alias("ms")).agg(F.avg("ret").alias("mean")))
    blocks = max(1, -(-means.count() // block))
    rows = join_small(daily, means, F.col("stream") == F.col("ms")).select("stream", "day", (F.col("ret") - F.col("mean")).alias("x"), F.pmod(F.xxhash64("stream"), F.lit(blocks)).cast("int").alias("own"), F.expr(f"day div {PART_DAYS}").alias("part"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(pdf["stream"].to_numpy(object))
        wide = np.full((PART_DAYS, len(names)), np.nan)
        wide[pdf["day"].to_numpy() % PART_DAYS, np.searchsorted(names, pdf["stream"].to_numpy(object))] = pdf["x"].to_numpy()
        there = ~np.isnan(wide)
        x, m = np.where(there, wide, 0.0), there.astype(float)
        n, sa, saa, sab = m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x
        home = pdf.groupby("stream")["own"].first().reindex(names).to_numpy()
        a, b = np.nonzero((n > 0) & (np.arange(len(names))[:, None] < np.arange(len(names))[None, :]))
        if pdf["lo"].iloc[0] != pdf["hi"].iloc[0]:
            across = home[a] != home[b]
            a, b = a[across], b[across]
        return pd.DataFrame({"a": names[a], "b": names[b], "n": n[a, b].astype(np.int64), "sa": sa[a, b], "sb": sa[b, a], "saa": saa[a, b], "sbb": saa[b, a], "sab": sab[a, b]})

    parts = rows.groupBy("lo", "hi", "part").applyInPandas(lambda pdf: meet(pdf), "a string, b string, n bigint, sa double, sb double, saa double, sbb double, sab double")
    t = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")]).where(F.col("n") >= least)
    n = F.col("n")
    va, vb = F.col("saa") - F.col("sa") * F.col("sa") / n, F.col("sbb") - F.col("sb") * F.col("sb") / n
    corr = F.when((va > 0) & (vb > 0), (F.col("sab") - F.col("sa") * F.col("sb") / n) / F.sqrt(va * vb))
    return t.select("a", "b", n.alias("days"), F.round(corr, 6).alias("corr"))


def strategy_panel(candles: DataFrame) -> DataFrame:
    """``(day, strategy, ret)``: mean over the streams of each signal's daily net return."""
    rows = base(candles).withColumns({n: FEATURES[n]() for n in STRATEGIES})
    rows = rows.withColumns({f"p_{n}": clamp_position(causal_z(n)) for n in STRATEGIES})
    rows = rows.withColumns({f"h_{n}": F.coalesce(F.lag(f"p_{n}").over(order()), F.lit(0.0)) for n in STRATEGIES})
    rows = own(rows).select("stream", F.expr(f"us div {DAY_US}").alias("day"), F.inline(F.array(*[F.struct(F.lit(n).alias("strategy"), (F.col(f"h_{n}") * F.col("ret")).alias("r")) for n in STRATEGIES])))
    per = rows.groupBy("strategy", "day", "stream").agg(F.sum("r").alias("r"))
    return per.groupBy("strategy", "day").agg(F.avg("r").alias("ret"))


def _matrix(panel: DataFrame) -> np.ndarray:
    rows = cut(panel)
    if rows.count() > PANEL_CELLS:
        raise ValueError("the panel is too large; aggregate it to longer periods")
    return rows.toPandas().pivot(index="day", columns="strategy", values="ret").reindex(columns=list(STRATEGIES)).fillna(0.0).to_numpy()


def q_correlations(spark, sf_dir):
    return pair_correlations(daily_returns(table(spark, sf_dir, "candles")))


def q_design_effect(spark, sf_dir):
    """Mean pair correlation and the number of independent streams it leaves."""
    c = q_correlations(spark, sf_dir)
    k = daily_returns(table(spark, sf_dir, "candles")).agg(F.countDistinct("stream").alias("k"))
    out = c.agg(F.avg("corr").alias("rho"), F.count(F.lit(1)).alias("pairs")).crossJoin(k)
    deff = 1 + (F.col("k") - 1) * F.col("rho")
    return out.select("k", "pairs", F.round("rho", 6).alias("rho"), F.round(deff, 4).alias("design_effect"), F.round(F.when(deff > 0, F.col("k") / deff), 4).alias("effective"))


def q_jackknife(spark, sf_dir):
    """Delete-one-month jackknife of each stream's mean daily return, by sums less each month's own."""
    d = daily_returns(table(spark, sf_dir, "candles"))
    m = d.groupBy("stream", F.expr("day div 30").alias("c")).agg(F.sum("ret").alias("s"), F.count(F.lit(1)).alias("n"))
    t = m.groupBy("stream").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"), F.count(F.lit(1)).alias("clusters")).where("clusters > 2")
    j = m.join(t, "stream").withColumn("left", (F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n")))
    return j.groupBy("stream").agg(F.first("clusters").alias("clusters"), F.round(F.first("ts") / F.first("tn"), 9).alias("mean"), F.round(F.sqrt((F.first("clusters") - 1) * F.var_pop("left")), 9).alias("se"))


def q_reality_check(spark, sf_dir):
    """White, Hansen, step-down, subsampling and overfitting verdicts on the signals."""
    p = _matrix(strategy_panel(table(spark, sf_dir, "candles")))
    boot = replicates(spark, p, 400)
    t, tb = subsample_statistics(p, max(6, len(p) // 4), 3, spark)
    rows = [("white", white_reality_check(p, boot)), ("spa", hansen_spa(p, boot)), ("spa_consistent", hansen_spa(p, boot, True)), ("stepm_rejections", float(len(step_m(p, boot)))),
            ("subsampling_spa", float((tb.max(1) >= t.max()).mean())), ("subsampling_kfwer", float(len(step_down(t, tb, k=2)))), ("subsampling_fdp", float(len(subsampling_fdp(t, tb)))), ("pbo", overfitting_probability(p)["pbo"])]
    return spark.createDataFrame([(a, round(b, 6)) for a, b in rows], "test string, value double")


def q_loss_comparison(spark, sf_dir):
    """Model confidence set and paired tests over the signals' squared daily losses."""
    p = _matrix(strategy_panel(table(spark, sf_dir, "candles")))
    live = model_confidence_set(-p)
    rows = [(n, i in live, round(diebold_mariano(-p[:, i], -p[:, 0])["p"], 6), round(interquartile_mean(p[:, i]), 9)) for i, n in enumerate(STRATEGIES)]
    return spark.createDataFrame(rows, "strategy string, in_set boolean, p_against_first double, interquartile_mean double")


_DAILY = f"dr as (select stream, us // {DAY_US} as day, round(sum(ret), 12) ret from r group by 1, 2)"
_CORR = f"with {BARS_SQL}, {_DAILY}, pc as (select x.stream as a, y.stream as b, count(*) as days, round(corr(x.ret, y.ret), 6) as corr from dr x join dr y on x.day = y.day and x.stream < y.stream group by 1, 2 having count(*) >= 30)"
CORR_SQL = _CORR + " select * from pc"
DEFF_SQL = _CORR + ", z as (select (select count(distinct stream) from dr) k, count(*) pairs, avg(corr) rho from pc) select k, pairs, round(rho, 6) as rho, round(1 + (k - 1) * rho, 4) as design_effect, round(case when 1 + (k - 1) * rho > 0 then k / (1 + (k - 1) * rho) end, 4) as effective from z"
JACK_SQL = f"""with {BARS_SQL}, {_DAILY}, m as (select stream, day // 30 c, sum(ret) s, count(*) n from dr group by 1, 2), t as (select stream, sum(s) ts, sum(n) tn, count(*) k from m group by 1 having count(*) > 2),
j as (select stream, k, ts / tn mu, (ts - s) / (tn - n) lf from m join t using (stream)) select stream, any_value(k) as clusters, round(any_value(mu), 9) as mean, round(sqrt((any_value(k) - 1) * var_pop(lf)), 9) as se from j group by 1"""

QUERIES = {"stream_correlations": (q_correlations, CORR_SQL), "design_effect": (q_design_effect, DEFF_SQL), "cluster_jackknife": (q_jackknife, JACK_SQL), "reality_check": (q_reality_check, None), "loss_comparison": (q_loss_comparison, None)}
