"""Pooled evidence about signal variants: fold-window clusters and their jackknife, power, stability
over blocks, promotion by paired tests, and restatements at other cadences and exposures.

Sums per variant, stream and fold are all these tests read, so the returns are aggregated once and
every fold left out is a subtraction, not another pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.bars import order
from tidewright.operators.features import FEATURE_SQL, FEATURES, Z_SQL, _BASE_SQL, base, causal_z, clamp_position
from tidewright.plans.evaluate import confidence_to_position
from tidewright.session import cut, join_small, table

YEAR, FOLD, Z95 = 252, 100, 1.959964
BASELINE, VARIANTS = "momentum", ("momentum", "reversal_window", "range_location")
COST = 5.0 / 1e4


def sharpe_of(n: Column, s: Column, ss: Column) -> Column:
    """Annualised Sharpe ratio from a count, a sum and a sum of squares; null under two values, 0 without variance."""
    var = F.greatest(F.lit(0.0), (ss - s * s / n) / (n - 1))
    return F.when(n >= 2, F.when(F.sqrt(var) > 1e-12, s / n / F.sqrt(var) * math.sqrt(YEAR)).otherwise(0.0))


def confidences(candles: DataFrame, variants: tuple[str, ...] = VARIANTS) -> DataFrame:
    """Own and neighbouring rows with ``z_...``, each variant's confidence within -1 to 1."""
    rows = base(candles).withColumns({v: FEATURES[v]() for v in variants})
    return rows.withColumns({f"z_{v}": clamp_position(causal_z(v)) for v in variants})


def net_by_fold(pos: Column, prev: Column, at: Column) -> Column:
    """Net return of a bar whose fold is traded on its own: flat at its first bar, entered at its second."""
    change = F.when(at == 0, 0.0).when(at == 1, F.abs(pos)).otherwise(F.abs(pos - prev))
    return F.when(at == 0, 0.0).otherwise(pos * F.col("ret")) - change * COST


def net_rows(rows: DataFrame, variants: tuple[str, ...] = VARIANTS, size: int = FOLD) -> DataFrame:
    """``(variant, stream, i, fold, net)`` of every own bar."""
    at, w = F.expr(f"i % {size}"), order()
    held = {f"p_{v}": F.coalesce(F.lag(f"z_{v}").over(w), F.lit(0.0)) for v in variants}
    rows = rows.withColumns(held).withColumns({f"q_{v}": F.coalesce(F.lag(f"p_{v}").over(w), F.lit(0.0)) for v in variants})
    rows = rows.withColumns({f"n_{v}": net_by_fold(F.col(f"p_{v}"), F.col(f"q_{v}"), at) for v in variants})
    net = [F.struct(F.lit(v).alias("variant"), F.col(f"n_{v}").alias("net")) for v in variants]
    return rows.where("own").select("stream", "i", F.expr(f"i div {size}").alias("fold"), F.inline(F.array(*net)))


def fold_sums(rows: DataFrame, variants: tuple[str, ...] = VARIANTS, size: int = FOLD) -> DataFrame:
    """``(variant, stream, fold, n, s, ss)``: count, sum and sum of squares of the net returns of every complete fold."""
    sums = net_rows(rows, variants, size).groupBy("variant", "stream", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("net").alias("s"), F.sum(F.col("net") * F.col("net")).alias("ss"))
    return sums.where(F.col("n") == size)


def clusters(sums: DataFrame) -> DataFrame:
    """``(variant, fold, n, s, ss)``: the same fold window of all streams is one cluster."""
    return sums.groupBy("variant", "fold").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])


def left_out(per: DataFrame) -> DataFrame:
    """Clusters with ``own`` (their own ratio), ``whole`` (the variant's) and ``left`` (that without the cluster)."""
    total = per.groupBy(F.col("variant").alias("tv")).agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", "s", "ss")])
    j = join_small(per, cut(total), F.col("variant") == F.col("tv"))
    parts = {"own": [F.col(c) for c in ("n", "s", "ss")], "whole": [F.col(f"t_{c}") for c in ("n", "s", "ss")], "left": [F.col(f"t_{c}") - F.col(c) for c in ("n", "s", "ss")]}
    return j.select("variant", "fold", "n", *[sharpe_of(*x).alias(k) for k, x in parts.items()])


def _jackknife(x: str) -> Column:
    c = F.count(x)
    return F.sqrt((c - 1) / c * (c * F.var_pop(x)))


def pooled_report(sums: DataFrame) -> DataFrame:
    """Per variant: the pooled ratio and the mean over folds, what ratio the sample could detect, and the
    same with the cluster jackknife's standard error."""
    per = cut(left_out(clusters(sums)))
    whole = per.groupBy("variant").agg(F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("bars"), F.max("whole").alias("sharpe"), _jackknife("left").alias("se_cluster"))
    folds = sums.groupBy(F.col("variant").alias("fv")).agg(F.count(F.lit(1)).alias("folds"), F.avg(sharpe_of(F.col("n"), F.col("s"), F.col("ss"))).alias("mean_fold_sharpe"))
    j = whole.join(folds, F.col("variant") == F.col("fv"))
    sr = F.col("sharpe")
    j = j.withColumn("se", F.sqrt((YEAR + 0.5 * sr * sr) / F.col("bars"))).withColumn("design_effect", F.pow(F.col("se_cluster") / F.col("se"), F.lit(2)))
    out = {
        "sharpe": sr, "per_bar": sr / math.sqrt(YEAR), "mean_fold_sharpe": F.col("mean_fold_sharpe"), "se": F.col("se"), "detectable": Z95 * F.col("se"), "se_cluster": F.col("se_cluster"),
        "detectable_dependent": Z95 * F.col("se_cluster"), "design_effect": F.col("design_effect"), "effective_bars": F.col("bars") / F.col("design_effect"),
    }
    flags = {"underpowered": Z95 * F.col("se") > 1, "adjust": F.col("design_effect") > 1, "bars_to_detect": F.when(sr > 0, F.ceil(YEAR * F.pow(Z95 / sr, F.lit(2))))}
    return j.select("variant", "folds", "clusters", "bars", *[F.round(x, 5).alias(n) for n, x in out.items()], *[x.alias(n) for n, x in flags.items()])


def sign_tail(wins: Column, n: Column) -> Column:
    """Chance of at least ``wins`` heads of ``n`` fair coins, the binomials followed as logarithms."""
    start = F.struct(F.lit(0.0).alias("log"), F.when(wins <= 0, F.exp(-n * math.log(2))).otherwise(0.0).alias("sum"))

    def step(acc, k):
        log = acc["log"] + F.log(n - k + 1) - F.log(k)
        return F.struct(log.alias("log"), (acc["sum"] + F.when(k >= wins, F.exp(log - n * math.log(2))).otherwise(0.0)).alias("sum"))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), start, step)["sum"]).otherwise(1.0)


def paired_promotion(sums: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Each candidate against the baseline over fold-window clusters: difference of the pooled ratios with
    its jackknife error, the share of left-out differences above 0, and the exact sign test of the windows won."""
    per = cut(left_out(clusters(sums)))
    b = per.where(F.col("variant") == baseline).select(F.col("fold").alias("bf"), F.col("own").alias("b_own"), F.col("whole").alias("b_whole"), F.col("left").alias("b_left"))
    j = per.where(F.col("variant") != baseline).join(b, F.col("fold") == F.col("bf")).withColumn("d", F.col("left") - F.col("b_left"))
    a = j.groupBy("variant").agg(
        F.count(F.lit(1)).alias("clusters"), F.max(F.col("whole") - F.col("b_whole")).alias("difference"), _jackknife("d").alias("se"), F.avg(F.when(F.col("d") > 0, 1.0).otherwise(0.0)).alias("stable"),
        F.count_if(F.col("own") > F.col("b_own")).alias("wins"), F.count_if(F.col("own") != F.col("b_own")).alias("decided"),
    )
    t = F.when(F.col("se") > 0, F.col("difference") / F.col("se")).otherwise(0.0)
    return a.select("variant", "clusters", F.round("difference", 5).alias("difference"), F.round("se", 5).alias("se"), F.round(t, 4).alias("t"), F.round("stable", 6).alias("stable"), "wins", "decided", F.round(sign_tail(F.col("wins"), F.col("decided")), 6).alias("sign_p"))


def block_stability(rows: DataFrame, blocks: int = 6, size: int = FOLD) -> DataFrame:
    """Per variant and block of bars, counted back from the end of each stream's last complete fold: the mean
    over streams of the block's ratio, the share of blocks above 0 and the extremes."""
    ends = rows.where("own").groupBy(F.col("stream").alias("es")).agg((F.floor(F.count(F.lit(1)) / size) * size).alias("bars")).where(F.col("bars") >= blocks)
    j = join_small(net_rows(rows), cut(ends), F.col("stream").eqNullSafe(F.col("es")))
    j = j.withColumn("size", F.expr(f"bars div {blocks}")).withColumn("from", F.col("bars") - blocks * F.col("size"))
    j = j.where((F.col("i") >= F.col("from")) & (F.col("i") < F.col("bars"))).withColumn("block", F.expr("(i - from) div size"))
    one = j.groupBy("variant", "stream", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("net").alias("s"), F.sum(F.col("net") * F.col("net")).alias("ss"))
    per = one.groupBy("variant", "block").agg(F.count(F.lit(1)).alias("streams"), F.avg(F.coalesce(sharpe_of(F.col("n"), F.col("s"), F.col("ss")), F.lit(0.0))).alias("sharpe"))
    w = Window.partitionBy("variant")  # six rows
    return per.select("variant", "block", "streams", F.round("sharpe", 5).alias("sharpe"), F.round(F.avg(F.when(F.col("sharpe") > 0, 1.0).otherwise(0.0)).over(w), 6).alias("positive"), F.round(F.min("sharpe").over(w), 5).alias("lowest"), F.round(F.max("sharpe").over(w), 5).alias("highest"))


def family_correlation(sums: DataFrame) -> DataFrame:
    """Correlation of every two variants' net results over streams and folds."""
    v = VARIANTS
    wide = sums.groupBy("stream", "fold").agg(*[F.max(F.when(F.col("variant") == x, F.col("s"))).alias(x) for x in v])
    pairs = [(a, b) for i, a in enumerate(v) for b in v[i + 1 :]]
    one = wide.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"{a}|{b}"), 6).alias("corr")) for a, b in pairs])))


def at_cadence(rows: DataFrame, sizes: tuple[int, ...] = (25, 50, 100), train: int = FOLD, variant: str = BASELINE) -> DataFrame:
    """One variant's confidences scored again on other walk-forward grids: per test size the folds, the
    pooled ratio and the mean over folds. The confidences stay, only the grid moves."""
    p, q = F.coalesce(F.lag(f"z_{variant}").over(order()), F.lit(0.0)), F.coalesce(F.lag(f"z_{variant}", 2).over(order()), F.lit(0.0))
    rows = rows.withColumns({"p": p, "q": q}).where("own").where(F.col("i") >= train)
    grids = F.array(*[F.struct(F.lit(s).alias("size"), ((F.col("i") - train) % s).alias("at"), F.floor((F.col("i") - train) / s).alias("fold")) for s in sizes])
    long = rows.select("stream", "p", "q", "ret", F.inline(grids))
    net = net_by_fold(F.col("p"), F.col("q"), F.col("at"))
    per = long.withColumn("net", net).groupBy("size", "stream", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("net").alias("s"), F.sum(F.col("net") * F.col("net")).alias("ss")).where(F.col("n") == F.col("size"))
    return per.groupBy(F.col("size").alias("test_size")).agg(F.count(F.lit(1)).alias("folds"), F.sum("n").alias("bars"), F.round(sharpe_of(F.sum("n"), F.sum("s"), F.sum("ss")), 5).alias("sharpe"), F.round(F.avg(sharpe_of(F.col("n"), F.col("s"), F.col("ss"))), 5).alias("mean_fold_sharpe"))


def order_statistics(values: DataFrame, ranks: DataFrame) -> DataFrame:
    """``(arm, rank, x)``: the values of ``(arm, x)`` at places ``(arm, rank)`` from 0. Values lie within 0 to 1:
    a histogram of 65,536 cells finds the cell of a rank, and only that cell's distinct values are put in order."""
    cell = F.floor(F.col("x") * 65_536).cast("int")
    upto = F.sum("n").over(Window.partitionBy("arm").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    hist = values.groupBy("arm", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).withColumn("upto", upto)
    hit = hist.join(ranks.select(F.col("arm").alias("ra"), "rank"), (F.col("arm") == F.col("ra")) & (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    hit = cut(hit.select("ra", F.col("cell").alias("rc"), "rank", (F.col("upto") - F.col("n")).alias("below")))
    inside = join_small(values.withColumn("cell", cell), hit, (F.col("arm") == F.col("ra")) & (F.col("cell") == F.col("rc")))
    by = Window.partitionBy("arm", "rank").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    counted = inside.groupBy("arm", "rank", "x").agg(F.count(F.lit(1)).alias("n"), F.min("below").alias("below")).withColumn("upto", F.sum("n").over(by) + F.col("below"))
    return counted.where(F.col("upto") > F.col("rank")).groupBy("arm", "rank").agg(F.min("x").alias("x"))


def exposure_matched(rows: DataFrame, baseline: str = BASELINE, candidate: str = "reversal_window") -> DataFrame:
    """Two variants at one share of bars in the market, the smaller one's: each gets the dead zone, midway
    between two of its absolute confidences, that leaves as many bars as the target asks for."""
    arms = (baseline, candidate)
    rows = rows.withColumns({f"c_{a}": F.round(f"z_{a}", 9) for a in arms})
    values = cut(rows.where("own").select(F.inline(F.array(*[F.struct(F.lit(a).alias("arm"), F.abs(f"c_{a}").alias("x")) for a in arms]))))
    share = cut(values.groupBy("arm").agg(F.count(F.lit(1)).alias("bars"), F.count_if(F.col("x") > 0).alias("held")))
    target = share.agg(F.min(F.col("held") / F.col("bars")).alias("target"))
    share = cut(share.crossJoin(F.broadcast(target)).withColumn("m", F.floor(F.col("target") * F.col("bars") + 0.5).cast("bigint")))
    ranks = share.select("arm", F.explode(F.array(F.col("bars") - F.col("m"), F.col("bars") - F.col("m") - 1)).alias("rank")).where("rank >= 0")
    edges = order_statistics(values, ranks).groupBy(F.col("arm").alias("ea")).agg(F.max("x").alias("hi"), F.min("x").alias("lo"))
    zone = F.when(F.col("m") <= 0, 0.999).when(F.col("m") >= F.col("bars"), 0.0).otherwise(F.least(F.lit(0.999), F.greatest(F.lit(0.0), F.when(F.col("lo") == F.col("hi"), F.col("hi")).otherwise((F.col("lo") + F.col("hi")) / 2))))
    zones = cut(share.join(edges, F.col("arm") == F.col("ea"), "left").select("arm", "bars", "target", (F.col("held") / F.col("bars")).alias("raw"), zone.alias("zone")))
    found = {r["arm"]: r["zone"] for r in zones.collect()}  # one row an arm
    w, cols = order(), {}
    for a in arms:
        for k, z in (("raw", 0.0), ("met", found.get(a, 0.0))):
            cols[f"{k}_{a}"] = F.coalesce(F.lag(confidence_to_position(F.col(f"c_{a}"), z)).over(w), F.lit(0.0))
    rows = rows.withColumns(cols).withColumns({f"d_{c}": F.abs(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0.0))) for c in cols})
    net = lambda c: F.col(c) * F.col("ret") - F.col(f"d_{c}") * COST
    long = rows.where("own").select(F.inline(F.array(*[F.struct(F.lit(a).alias("arm"), net(f"raw_{a}").alias("raw_net"), net(f"met_{a}").alias("met_net"), F.abs(f"c_{a}").alias("c")) for a in arms])))
    both = join_small(long, zones.withColumnRenamed("arm", "za"), F.col("arm") == F.col("za"))
    n = F.count(F.lit(1))
    ratio = lambda x: F.round(sharpe_of(n, F.sum(x), F.sum(F.col(x) * F.col(x))), 5)
    out = both.groupBy("arm").agg(F.max("zone").alias("zone"), F.max("target").alias("target"), F.max("raw").alias("raw"), (F.count_if(F.col("c") > F.col("zone")) / n).alias("achieved"), ratio("raw_net").alias("raw_sharpe"), ratio("met_net").alias("matched_sharpe"))
    return out.select("arm", *[F.round(c, 9).alias(c) for c in ("zone", "target", "raw", "achieved")], "raw_sharpe", "matched_sharpe", (F.abs(F.col("achieved") - F.col("target")) <= 0.02).alias("within"))


def persistence(rows: DataFrame, variant: str = BASELINE, size: int = FOLD) -> DataFrame:
    """How much of a confidence stays from one bar to the next of its fold: the lag-one correlation over all
    folds, and what a sign lasts on average."""
    at = F.expr(f"i % {size}")
    c, b = F.round(f"z_{variant}", 9), F.round(F.lag(f"z_{variant}").over(order()), 9)
    pairs = rows.withColumns({"c": c, "b": b}).where("own").where(at > 0)
    turns = F.count_if(F.signum("c") != F.signum("b"))
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.corr("b", "c"), 6).alias("persistence"), turns.alias("turns"))


def concentration(sums: DataFrame, tops: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """How much of each variant's result the best folds of all streams make: share of the top k, and the sums of
    the folds above and below 0. Only the best of each part are ranked, so no task sorts all folds."""
    most = max(tops)
    parts = sums.withColumn("part", F.pmod(F.xxhash64("stream", "fold"), F.lit(64)))
    w = Window.partitionBy("variant", "part").orderBy(F.col("s").desc(), "stream", "fold")
    best = parts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("variant").orderBy(F.col("s").desc(), "stream", "fold"))).where(F.col("rank") <= most)
    top = best.groupBy(F.col("variant").alias("tv")).agg(*[F.sum(F.when(F.col("rank") <= k, F.col("s"))).alias(f"t{k}") for k in tops])
    whole = sums.groupBy("variant").agg(F.count(F.lit(1)).alias("folds"), F.sum("s").alias("total"), F.sum(F.when(F.col("s") > 0, F.col("s")).otherwise(0.0)).alias("above"), F.sum(F.when(F.col("s") < 0, F.col("s")).otherwise(0.0)).alias("below"))
    j = whole.join(top, F.col("variant") == F.col("tv"))
    return j.select("variant", "folds", *[F.round(c, 7).alias(c) for c in ("total", "above", "below")], *[F.round(F.when(F.col("total") > 0, F.col(f"t{k}") / F.col("total")), 5).alias(f"top_{k}") for k in tops])


def relative_performance(rows: DataFrame, baseline: str = BASELINE, variants: tuple[str, ...] = VARIANTS, size: int = FOLD) -> DataFrame:
    """Each candidate's net return less the baseline's, bar by bar: count, mean, deviation and ratio."""
    at, w = F.expr(f"i % {size}"), order()
    held = {f"p_{v}": F.coalesce(F.lag(f"z_{v}").over(w), F.lit(0.0)) for v in variants}
    rows = rows.withColumns(held).withColumns({f"q_{v}": F.coalesce(F.lag(f"p_{v}").over(w), F.lit(0.0)) for v in variants})
    rows = rows.withColumns({f"n_{v}": net_by_fold(F.col(f"p_{v}"), F.col(f"q_{v}"), at) for v in variants}).where("own")
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(v).alias("variant"), (F.col(f"n_{v}") - F.col(f"n_{baseline}")).alias("d")) for v in variants if v != baseline])))
    n, s, ss = F.count(F.lit(1)), F.sum("d"), F.sum(F.col("d") * F.col("d"))
    return long.groupBy("variant").agg(n.alias("bars"), F.round(F.avg("d") * 1e6, 5).alias("mean_millionths"), F.round(F.stddev_samp("d"), 8).alias("deviation"), F.round(sharpe_of(n, s, ss), 5).alias("sharpe"))


def variance_components(sums: DataFrame) -> DataFrame:
    """Where the variance of the fold ratios lies: between variants, between the folds of a variant, and
    between the streams of one variant's fold, with the shares. One row."""
    r = sharpe_of(F.col("n"), F.col("s"), F.col("ss"))
    cells = sums.select("variant", "fold", r.alias("x")).groupBy("variant", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    cells = cut(cells)
    arms = cells.groupBy("variant").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])
    whole = arms.agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")]).select("n", (F.col("s") / F.col("n")).alias("mean"), (F.col("ss") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2))).alias("total"))
    between = arms.crossJoin(F.broadcast(whole.select("mean"))).agg((F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("mean"), F.lit(2))) / F.sum("n")).alias("between"))
    rest = cells.agg((F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / F.sum("n")).alias("residual"))
    j = whole.crossJoin(F.broadcast(between)).crossJoin(F.broadcast(rest)).withColumn("folds", F.greatest(F.lit(0.0), F.col("total") - F.col("between") - F.col("residual")))
    share = lambda c: F.round(F.when(F.col("total") > 0, F.col(c) / F.col("total")), 6)
    return j.select(F.coalesce("n", F.lit(0)).alias("cells"), *[F.round(c, 5).alias(c) for c in ("mean", "total", "between", "folds", "residual")], share("between").alias("variant_share"), share("folds").alias("fold_share"))


ARMS = ("momentum", "vol_regime", "momentum_agreement", "range_location", "volume_imbalance", "autocorr1", "acceleration", "reversal", "reversal_window")


def halving_schedule(arms: int, most: int, least: int = 1, eta: int = 3) -> list[tuple[int, int, int]]:
    """``(budget, arms, keep)`` of every rung: the budget grows by ``eta`` and the arms shrink by it."""
    rounds, out, left = max(1, int(math.log(most / least) / math.log(eta) + 1e-12) + 1), [], arms
    for r in range(rounds):
        if left <= 1:
            break
        keep = max(1, -(-left // eta))
        out.append((round(most / eta ** (rounds - 1 - r)), left, keep))
        left = keep
    return out


def race(sums: DataFrame, most: int = 9) -> DataFrame:
    """Successive halving of the variants in ``sums``: every rung scores the arms that are left on the first
    folds of its budget, and keeps the best. ``(variant, rung, budget, score, place, kept)``; ties by name, no
    rows without two variants."""
    per = cut(sums.groupBy("variant", "fold").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")]).where(F.col("fold") < most))
    left = per.select("variant").distinct()
    out = sums.sparkSession.createDataFrame([], "variant string, rung int, budget int, score double, place int, kept boolean")
    for rung, (budget, _, keep) in enumerate(halving_schedule(per.select("variant").distinct().count(), most)):
        one = per.where(F.col("fold") < budget).join(F.broadcast(left), "variant").groupBy("variant").agg(sharpe_of(F.sum("n"), F.sum("s"), F.sum("ss")).alias("score"))
        place = F.row_number().over(Window.orderBy(F.round("score", 9).desc(), "variant"))  # a row an arm
        one = cut(one.withColumn("place", place).select("variant", F.lit(rung).alias("rung"), F.lit(budget).alias("budget"), "score", "place", (F.col("place") <= keep).alias("kept")))
        left, out = one.where("kept").select("variant"), out.unionByName(one)
    return out


def decision_report(sums: DataFrame, blocks: DataFrame) -> DataFrame:
    """One line a candidate from all the evidence: its ratio, the difference to the baseline with its t, the share
    of left-out differences and of blocks above 0, what its five best folds make, and the verdict:
    underpowered, promote or keep."""
    report = pooled_report(sums).select(F.col("variant").alias("rv"), "sharpe", "detectable")
    steady = blocks.select(F.col("variant").alias("bv"), "positive").distinct()
    top = concentration(sums).select(F.col("variant").alias("cv"), "top_5")
    j = paired_promotion(sums).join(report, F.col("variant") == F.col("rv")).join(steady, F.col("variant") == F.col("bv")).join(top, F.col("variant") == F.col("cv"))
    good = (F.col("difference") > 0) & (F.col("t") > 2) & (F.col("stable") >= 1) & (F.col("positive") > 0.5)
    verdict = F.when(good, "promote").when(F.col("detectable") > 1, "underpowered").otherwise("keep")
    return j.select("variant", "sharpe", "difference", "t", "stable", "sign_p", "positive", "top_5", verdict.alias("verdict"))


def _sums(spark, sf_dir):
    return cut(fold_sums(confidences(table(spark, sf_dir, "candles"))))


def q_report(spark, sf_dir):
    return pooled_report(_sums(spark, sf_dir))


def q_promotion(spark, sf_dir):
    return paired_promotion(_sums(spark, sf_dir))


def q_blocks(spark, sf_dir):
    return block_stability(confidences(table(spark, sf_dir, "candles")))


def q_family(spark, sf_dir):
    return family_correlation(_sums(spark, sf_dir))


def q_concentration(spark, sf_dir):
    return concentration(_sums(spark, sf_dir))


def q_cadence(spark, sf_dir):
    return at_cadence(confidences(table(spark, sf_dir, "candles"), (BASELINE,)))


def q_exposure(spark, sf_dir):
    return exposure_matched(confidences(table(spark, sf_dir, "candles"), (BASELINE, "reversal_window")))


def q_persistence(spark, sf_dir):
    return persistence(confidences(table(spark, sf_dir, "candles"), (BASELINE,)))


def q_relative(spark, sf_dir):
    return relative_performance(confidences(table(spark, sf_dir, "candles")))


def q_components(spark, sf_dir):
    return variance_components(_sums(spark, sf_dir))


def q_race(spark, sf_dir):
    out = race(cut(fold_sums(confidences(table(spark, sf_dir, "candles"), ARMS), ARMS)))
    return out.withColumn("score", F.round("score", 5))


def q_decision(spark, sf_dir):
    rows = confidences(table(spark, sf_dir, "candles"))
    return decision_report(cut(fold_sums(rows)), block_stability(rows))


def _ratio(n: str, s: str, ss: str) -> str:
    return f"case when {n} >= 2 then case when sqrt(greatest(0, ({ss} - {s} * {s} / {n}) / ({n} - 1))) > 1e-12 then {s} / {n} / sqrt(greatest(0, ({ss} - {s} * {s} / {n}) / ({n} - 1))) * sqrt(252) else 0 end end"


def _conf(variants: tuple[str, ...]) -> str:
    return _BASE_SQL + ", vx as (" + " union all ".join(f"select '{v}' variant, stream, i, ret, {FEATURE_SQL[v]} x from p" for v in variants) + f"""),
vz as (select variant, stream, i, ret, greatest(-1, least(1, ({Z_SQL.format(x='x').replace('partition by stream', 'partition by variant, stream')}) / 2)) c from vx)"""


_CONF = _conf(VARIANTS)
#: Net returns fold by fold, lag and entry inside the fold.
_FOLDS = """, h1 as (select *, i // 100 fold, coalesce(lag(c) over (partition by variant, stream, i // 100 order by i), 0) h from vz),
h2 as (select *, h * ret - abs(h - coalesce(lag(h) over (partition by variant, stream, fold order by i), 0)) * 0.0005 net from h1),
fs as (select variant, stream, fold, count(*) n, sum(net) s, sum(net * net) ss from h2 group by 1, 2, 3 having count(*) = 100)"""
_NET = _CONF + _FOLDS
_LEFT = _NET + f""", cl as (select variant, fold, sum(n) n, sum(s) s, sum(ss) ss from fs group by 1, 2), tt as (select variant, sum(n) tn, sum(s) ts, sum(ss) tss from cl group by 1),
jk as (select cl.variant, fold, n, {_ratio('n', 's', 'ss')} own, {_ratio('tn', 'ts', 'tss')} whole, {_ratio('(tn - n)', '(ts - s)', '(tss - ss)')} lft from cl join tt using (variant))"""
REPORT_SQL = _LEFT + f""", wh as (select variant, count(*) clusters, sum(n)::bigint bars, max(whole) sr, sqrt((count(*) - 1) * var_pop(lft)) sc from jk group by 1),
ff as (select variant, count(*) folds, avg({_ratio('n', 's', 'ss')}) mf from fs group by 1), al as (select *, sqrt((252 + 0.5 * sr * sr) / bars) se from wh join ff using (variant))
select variant, folds, clusters, bars, round(sr, 5) as sharpe, round(sr / sqrt(252), 5) as per_bar, round(mf, 5) as mean_fold_sharpe, round(se, 5) as se, round(1.959964 * se, 5) as detectable, round(sc, 5) as se_cluster, round(1.959964 * sc, 5) as detectable_dependent,
  round(pow(sc / se, 2), 5) as design_effect, round(bars / pow(sc / se, 2), 5) as effective_bars, 1.959964 * se > 1 as underpowered, pow(sc / se, 2) > 1 as adjust, case when sr > 0 then ceil(252 * pow(1.959964 / sr, 2))::bigint end as bars_to_detect from al"""
PROMOTION_SQL = _LEFT + """, pa as (select a.variant, a.own, b.own bo, a.whole - b.whole w, a.lft - b.lft d from jk a join jk b on a.fold = b.fold and b.variant = 'momentum' and a.variant <> 'momentum'),
ag as (select variant, count(*) clusters, max(w) difference, sqrt((count(*) - 1) * var_pop(d)) se, avg((d > 0)::int) stable, count_if(own > bo)::bigint wins, count_if(own <> bo)::bigint decided from pa group by 1)
select variant, clusters, round(difference, 5) as difference, round(se, 5) as se, round(case when se > 0 then difference / se else 0 end, 4) as t, round(stable, 6) as stable, wins, decided,
  round(case when decided > 0 then (select sum(exp(lgamma(decided + 1) - lgamma(k + 1) - lgamma(decided - k + 1) - decided * ln(2))) from range(wins, decided + 1) r(k)) else 1 end, 6) as sign_p from ag"""
BLOCKS_SQL = _NET + f""", ln as (select stream, count(*) // 100 * 100 bars from h2 where variant = 'momentum' group by 1 having count(*) // 100 * 100 >= 6), bk as (select h2.*, (i - (bars - 6 * (bars // 6))) // (bars // 6) blk from h2 join ln using (stream) where i >= bars - 6 * (bars // 6) and i < bars),
ob as (select variant, stream, blk, count(*) n, sum(net) s, sum(net * net) ss from bk group by 1, 2, 3), mb as (select variant, blk, count(*) streams, avg(coalesce({_ratio('n', 's', 'ss')}, 0)) sr from ob group by 1, 2)
select variant, blk as block, streams, round(sr, 5) as sharpe, round(avg((sr > 0)::int) over w, 6) as positive, round(min(sr) over w, 5) as lowest, round(max(sr) over w, 5) as highest from mb window w as (partition by variant)"""
FAMILY_SQL = _NET + """, wd as (select stream, fold, max(s) filter (where variant = 'momentum') momentum, max(s) filter (where variant = 'reversal_window') reversal_window, max(s) filter (where variant = 'range_location') range_location from fs group by 1, 2)
select 'momentum' as a, 'reversal_window' as b, round(corr(momentum, reversal_window), 6) as corr from wd union all select 'momentum', 'range_location', round(corr(momentum, range_location), 6) from wd union all select 'reversal_window', 'range_location', round(corr(reversal_window, range_location), 6) from wd"""
CADENCE_SQL = _CONF + f""", gz as (select *, z, (i - 100) // z fold from vz, (select unnest([25, 50, 100]) z) where variant = 'momentum' and i >= 100),
g1 as (select *, coalesce(lag(c) over (partition by stream, z, fold order by i), 0) h from gz), g2 as (select *, h * ret - abs(h - coalesce(lag(h) over (partition by stream, z, fold order by i), 0)) * 0.0005 net from g1),
gs as (select z, stream, fold, count(*) n, sum(net) s, sum(net * net) ss from g2 group by 1, 2, 3 having count(*) = z)
select z as test_size, count(*) as folds, sum(n)::bigint as bars, round({_ratio('sum(n)', 'sum(s)', 'sum(ss)')}, 5) as sharpe, round(avg({_ratio('n', 's', 'ss')}), 5) as mean_fold_sharpe from gs group by 1"""
EXPOSURE_SQL = _CONF + f""", ec as (select variant arm, stream, i, ret, round(c, 9) c from vz where variant in ('momentum', 'reversal_window')), eh as (select arm, count(*) bars, count_if(c <> 0) held from ec group by 1), et as (select min(held / bars) target from eh),
em as (select *, floor(target * bars + 0.5)::bigint m, held / bars raw from eh, et), er as (select arm, abs(c) x, row_number() over (partition by arm order by abs(c)) - 1 rk from ec),
ez as (select arm, bars, m, raw, target, max(x) filter (where rk = bars - m) hi, max(x) filter (where rk = bars - m - 1) lo from em join er using (arm) group by 1, 2, 3, 4, 5),
zn as (select *, case when m <= 0 then 0.999::double when m >= bars then 0.0::double else least(0.999, greatest(0, case when lo = hi then hi else (lo + hi) / 2 end)) end dz from ez),
ps as (select ec.*, dz, raw, target, c h0, case when abs(c) <= dz then 0 else sign(c) * least(1, (abs(c) - dz) / (1 - dz)) end h1 from ec join zn using (arm)),
pl as (select *, coalesce(lag(h0) over w, 0) p0, coalesce(lag(h1) over w, 0) p1 from ps window w as (partition by arm, stream order by i)),
pn as (select *, p0 * ret - abs(p0 - coalesce(lag(p0) over w, 0)) * 0.0005 n0, p1 * ret - abs(p1 - coalesce(lag(p1) over w, 0)) * 0.0005 n1 from pl window w as (partition by arm, stream order by i))
select arm, round(max(dz), 9) as zone, round(max(target), 9) as target, round(max(raw), 9) as raw, round(avg((abs(c) > dz)::int), 9) as achieved, round({_ratio('count(*)', 'sum(n0)', 'sum(n0 * n0)')}, 5) as raw_sharpe,
  round({_ratio('count(*)', 'sum(n1)', 'sum(n1 * n1)')}, 5) as matched_sharpe, abs(avg((abs(c) > dz)::int) - max(target)) <= 0.02 as within from pn group by 1"""
PERSISTENCE_SQL = _CONF + """, lp as (select round(c, 9) c, round(lag(c) over (partition by stream, i // 100 order by i), 9) b from vz where variant = 'momentum')
select count(*) as pairs, round(corr(b, c), 6) as persistence, count_if(sign(c) <> sign(b)) as turns from lp where b is not null"""
CONCENTRATION_SQL = _NET + """, rk as (select *, row_number() over (partition by variant order by s desc, stream, fold) r from fs)
select variant, count(*) as folds, round(sum(s), 7) as total, round(sum(case when s > 0 then s else 0 end), 7) as above, round(sum(case when s < 0 then s else 0 end), 7) as below, round(case when sum(s) > 0 then sum(s) filter (where r <= 1) / sum(s) end, 5) as top_1,
  round(case when sum(s) > 0 then sum(s) filter (where r <= 5) / sum(s) end, 5) as top_5, round(case when sum(s) > 0 then sum(s) filter (where r <= 20) / sum(s) end, 5) as top_20 from rk group by 1"""

RELATIVE_SQL = _NET + f""", rl as (select a.variant, a.net - b.net d from h2 a join h2 b on a.stream = b.stream and a.i = b.i and b.variant = 'momentum' and a.variant <> 'momentum')
select variant, count(*) as bars, round(avg(d) * 1e6, 5) as mean_millionths, round(stddev_samp(d), 8) as deviation, round({_ratio('count(*)', 'sum(d)', 'sum(d * d)')}, 5) as sharpe from rl group by 1"""
COMPONENTS_SQL = _NET + f""", cx as (select variant, fold, {_ratio('n', 's', 'ss')} x from fs), gm as (select count(*) n, avg(x) mu, var_pop(x) tot from cx), bt as (select sum(n * pow(m - mu, 2)) / sum(n) b from (select variant, count(*) n, avg(x) m from cx group by 1), (select mu from gm)),
rs as (select sum(pow(x - m, 2)) / count(*) r from (select x, avg(x) over (partition by variant, fold) m from cx)), al as (select n, mu, tot, b, r, greatest(0, tot - b - r) f from gm, bt, rs)
select n as cells, round(mu, 5) as mean, round(tot, 5) as total, round(b, 5) as "between", round(f, 5) as folds, round(r, 5) as residual, round(case when tot > 0 then b / tot end, 6) as variant_share, round(case when tot > 0 then f / tot end, 6) as fold_share from al"""
_RUNGS = halving_schedule(len(ARMS), 9)


def _race_sql() -> str:
    out, parts = _conf(ARMS) + _FOLDS, []
    for r, (budget, _, keep) in enumerate(_RUNGS):
        left = f" where variant in (select variant from rg{r - 1} where kept)" if r else ""
        out += f""", rs{r} as (select variant, {_ratio('sum(n)', 'sum(s)', 'sum(ss)')} score from fs{left or ' where true'} and fold < {budget} group by 1),
rg{r} as (select variant, {r}::int rung, {budget}::int budget, score, row_number() over (order by round(score, 9) desc, variant)::int place, row_number() over (order by round(score, 9) desc, variant) <= {keep} kept from rs{r})"""
        parts.append(f"select variant, rung, budget, round(score, 5) as score, place, kept from rg{r}")
    return out + " " + " union all ".join(parts)


RACE_SQL = _race_sql()
DECISION_SQL = f"""with q1 as ({PROMOTION_SQL}), q2 as ({REPORT_SQL}), q3 as (select distinct variant, positive from ({BLOCKS_SQL})), q4 as ({CONCENTRATION_SQL})
select q1.variant, q2.sharpe, q1.difference, q1.t, q1.stable, q1.sign_p, q3.positive, q4.top_5, case when difference > 0 and t > 2 and stable >= 1 and positive > 0.5 then 'promote' when detectable > 1 then 'underpowered' else 'keep' end as verdict
from q1 join q2 using (variant) join q3 using (variant) join q4 using (variant)"""

QUERIES = {
    "pooled_report": (q_report, REPORT_SQL), "promotion_test": (q_promotion, PROMOTION_SQL), "block_stability": (q_blocks, BLOCKS_SQL), "family_correlation": (q_family, FAMILY_SQL),
    "fold_concentration": (q_concentration, CONCENTRATION_SQL), "cadence_restated": (q_cadence, CADENCE_SQL), "exposure_matched": (q_exposure, EXPOSURE_SQL), "confidence_persistence": (q_persistence, PERSISTENCE_SQL),
    "relative_performance": (q_relative, RELATIVE_SQL), "variance_components": (q_components, COMPONENTS_SQL), "variant_race": (q_race, RACE_SQL), "decision_report": (q_decision, DECISION_SQL),
}
