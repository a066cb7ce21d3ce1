"""Memory-bank arithmetic: surprise, reinforcement, utility, pooled prototypes, query movement,
trust-weighted ensembles, and the small statistics that steer them. Columns where rows are many,
numpy where one short history is at hand."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.hashing import cosine
from tidewright.session import cut, join_small, table


# surprise and reinforcement ---------------------------------------------------------------------


def clamp01(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def surprise_gate(similarity: Column, floor: float = 0.1, sharpness: float = 2.0) -> Column:
    """How much of an update passes, from ``floor`` for the familiar to 1 for the unseen."""
    return floor + (1 - floor) * F.pow(1 - clamp01(similarity), F.lit(sharpness))


def reinforced(value: Column, gain: float, decay: float = 0.999) -> Column:
    return value * decay + gain


def utility() -> Column:
    """sqrt(size x access) x (1 + sqrt(mean variance)) x importance."""
    mean_v = F.aggregate("variance", F.lit(0.0), lambda s, x: s + x) / F.size("variance")
    return F.sqrt(F.col("size") * F.col("access_count")) * (1 + F.sqrt(mean_v)) * F.col("importance")


def quality() -> Column:
    """importance x ln(1 + access) x (1 + size)^-1.5 x (1 + mean)^0.8 x (1 + variance)^-1.2 with plain averages of
    the vectors, missing entries counting 0; bases that are not positive count 1e-8."""

    def avg(c: str) -> Column:
        return F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda s, x: s + F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x)) / F.size(c)).otherwise(0.0)

    def base(x: Column) -> Column:
        return F.when(x <= 0, 1e-8).otherwise(x)

    powers = F.pow(base(F.col("size") + 1), F.lit(-1.5)) * F.pow(base(1 + avg("mean")), F.lit(0.8)) * F.pow(base(1 + avg("variance")), F.lit(-1.2))
    return F.col("importance") * F.ln(base(1 + F.col("access_count") + 1e-8)) * powers


def keep_best(rows: DataFrame, key: str, ident: str, score: str, recency: str, recent: int, best: int) -> DataFrame:
    """Of every key the ``recent`` newest entries and the ``best`` highest of the rest, ties to the smaller
    ``ident``. Both ranks are limits, so Spark keeps no more than that many rows of a key in a task."""
    new = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(recency).desc_nulls_last(), ident))).where(F.col("_r") <= recent).drop("_r")
    new = cut(new)
    rest = rows.join(new.select(F.col(ident).alias("_k")), F.col(ident) == F.col("_k"), "left_anti")
    high = rest.withColumn("_s", F.row_number().over(Window.partitionBy(key).orderBy(F.col(score).desc_nulls_last(), ident))).where(F.col("_s") <= best).drop("_s")
    return new.withColumn("kept_as", F.lit("recent")).unionByName(high.withColumn("kept_as", F.lit("best")))


def deduped_by_hash(rows: DataFrame, digest: str, score: str) -> DataFrame:
    w = Window.partitionBy(digest).orderBy(F.col(score).desc_nulls_last(), "proto_id")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pooled(x: np.ndarray, most: int = 4, factor: float = 1.5) -> tuple[np.ndarray, np.ndarray]:
    """Leader clustering in one pass: a row opens a prototype when it is far from all, while there is
    room; else the nearest takes it in. ``(means, counts)``; the first prototype is the mean of all."""
    spread = x.var(0).mean() * x.shape[1] * factor
    means, counts = [x.mean(0)], [1]
    for row in x:
        d = [((row - m) ** 2).sum() for m in means]
        k = int(np.argmin(d))
        if d[k] > spread and len(means) < most:
            means.append(row.astype(float))
            counts.append(1)
        else:
            counts[k] += 1
            means[k] = means[k] + (row - means[k]) / counts[k]
    return np.array(means), np.array(counts)


def generative_replay(means: np.ndarray, variances: np.ndarray, n: int, pressure: float = 1.0, seed: int = 1) -> np.ndarray:
    """Samples around prototypes, the noise scaled by ``pressure``."""
    rng = np.random.default_rng(seed)
    k = rng.integers(0, len(means), n)
    return means[k] + rng.standard_normal((n, means.shape[1])) * np.sqrt(variances[k]) * pressure


# query movement ---------------------------------------------------------------------------------


def unit(x: np.ndarray) -> np.ndarray | None:
    n = np.linalg.norm(x)
    return x / n if n > 0 and np.isfinite(n) else None


def moved_query(query: np.ndarray, found: np.ndarray, alpha: float = 0.5, top: int = 8) -> np.ndarray:
    """A query moved toward the centroid of its best candidates (Rocchio)."""
    sims = found @ query / np.maximum(np.linalg.norm(found, axis=1) * np.linalg.norm(query), 1e-300)
    best = found[np.argsort(-sims, kind="stable")[:top]]
    centre = unit(np.mean([unit(b) for b in best if unit(b) is not None], axis=0)) if len(best) else None
    q = unit(query)
    return query if centre is None or q is None else unit((1 - alpha) * q + alpha * centre)


# ensemble ---------------------------------------------------------------------------------------


def trust_weights(performance: np.ndarray, recent: int = 5) -> np.ndarray:
    """Ensemble weights from histories of members' scores (rows): the sigmoid of the z-scored mean
    of the last values and their trend, normalised; equal where they do not differ."""
    last = performance[:, -recent:].mean(1)
    trend = performance[:, -1] - performance[:, max(-performance.shape[1], -recent)]
    z = (last - last.mean()) / (last.std() + 1e-6) + 0.5 * trend / (np.abs(trend).max() + 1e-6)
    w = 1 / (1 + np.exp(-z))
    return w / w.sum() if w.sum() > 1e-6 else np.full(len(w), 1 / len(w))


def homeostatic_scale(activity: float, target: float = 0.5, gain: float = 0.5, low: float = 0.5, high: float = 2.0) -> float:
    """Bounded factor that brings an activity back to its target; stable while 0 < gain x target < 2."""
    return float(np.clip(1 + gain * (target - activity), low, high))


def specialization(outputs: np.ndarray, performance: np.ndarray) -> np.ndarray:
    z = np.abs(outputs - outputs.mean()) / (outputs.std() + 1e-6)
    return 1 / (1 + np.exp(-z)) * (0.5 + 0.5 * performance)


# small statistics -------------------------------------------------------------------------------


def deviation_from_median(x: np.ndarray, most: float = 10.0) -> float:
    """Mean absolute deviation from the median, capped."""
    return float(min(most, np.abs(x - np.sort(x)[len(x) // 2]).mean())) if len(x) else 0.0


def ema_last(x: np.ndarray, beta: float) -> float:
    y = x[0]
    for v in x[1:]:
        y = beta * y + (1 - beta) * v
    return float(y)


def dual_ema(x: np.ndarray, short: float, long: float) -> float:
    return ema_last(x, short) - ema_last(x, long)


def conformity(x: np.ndarray) -> float:
    """Share of consecutive changes of one sign, within 0.5 to 1."""
    s = np.sign(np.diff(x))
    return float(np.clip((s[1:] == s[:-1]).mean() if len(s) > 1 else 1.0, 0.5, 1.0))


def percentile_at(x: np.ndarray, p: float) -> float:
    """Value at position floor(p (n - 1)) in order; 1 where it is 0."""
    v = float(np.sort(x)[int(p * (len(x) - 1))]) if len(x) else 0.0
    return v or 1.0


def sudden_drop(history: np.ndarray, current: float, least: float = 0.05) -> float:
    """1, 1.8 or 3 by how far the current value lies below the recent mean, in deviations of the recent values:
    more than one, more than two; a gap under ``least`` is none."""
    if len(history) < 2:
        return 1.0
    gap, spread = history.mean() - current, max(float(history.std()), least)
    return 3.0 if gap > 2 * spread else 1.8 if gap > spread else 1.0


def stagnating(history: np.ndarray, least_var: float = 1e-4, least_gain: float = 1e-3) -> bool:
    half = len(history) // 2
    return bool(len(history) > 3 and (history.var() < least_var or history[half:].mean() - history[:half].mean() < least_gain))


def spectral_norm(m: np.ndarray, steps: int = 50) -> float:
    v = np.ones(m.shape[1]) / np.sqrt(m.shape[1])
    for _ in range(steps):
        w = m.T @ (m @ v)
        n = np.linalg.norm(w)
        if not n:
            return 0.0
        v = w / n
    return float(np.linalg.norm(m @ v))


def clip_by_norm(g: np.ndarray, most: float = 1.0) -> np.ndarray:
    n = np.linalg.norm(g)
    return g * (most / n) if n > most else g


# queries ----------------------------------------------------------------------------------------


def q_utility(spark, sf_dir):
    from tidewright.operators.vault import distinct_protos

    p = distinct_protos(table(spark, sf_dir, "volatile_positive")).where("variance is not null and importance is not null")
    return p.select("proto_id", F.round(utility(), 6).alias("utility"), F.round(quality(), 8).alias("quality"))


def q_surprise(spark, sf_dir):
    """Each prototype against its compat_id's mean vector: similarity and the gate it would open."""
    from tidewright.operators.hashing import mean_vectors
    from tidewright.operators.vault import distinct_protos

    p = distinct_protos(table(spark, sf_dir, "volatile_positive")).select("proto_id", "compat_id", "mean")
    m = cut(mean_vectors(p, "compat_id", "mean").select(F.col("compat_id").alias("c"), F.col("mean").alias("centre")))
    j = join_small(p, m, F.col("compat_id") == F.col("c"), row_bytes=400)
    sim = F.round(cosine(F.col("mean"), F.col("centre")), 9)
    return j.select("proto_id", F.round(sim, 6).alias("similarity"), F.round(surprise_gate(sim), 6).alias("gate"))


def q_pooled(spark, sf_dir):
    """Embeddings pooled to a few prototypes per label and block of ids, in order of id."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, counts = pooled(np.stack(pdf.sort_values("vec_id")["embedding"]).astype(float))
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "block": [pdf["block"].iloc[0]], "prototypes": [len(counts)], "largest": [int(counts.max())]})

    e = table(spark, sf_dir, "embeddings").withColumn("block", F.expr("vec_id div 500"))
    return e.groupBy("label", "block").applyInPandas(lambda pdf: run(pdf), "label int, block bigint, prototypes int, largest int")


def q_pruned(spark, sf_dir):
    """What is kept of each compat_id: the three last used and the five most important of the others."""
    from tidewright.operators.vault import distinct_protos

    p = distinct_protos(table(spark, sf_dir, "volatile_positive")).select("proto_id", "compat_id", "importance", "last_accessed")
    return keep_best(p, "compat_id", "proto_id", "importance", "last_accessed", 3, 5).select("compat_id", "proto_id", "kept_as")


def q_deduped(spark, sf_dir):
    """Of the prototypes of both banks with one hash the most important one."""
    both = [table(spark, sf_dir, f"volatile_{x}").select("proto_id", "hash", "importance") for x in ("positive", "negative")]
    return deduped_by_hash(both[0].unionByName(both[1]).distinct(), "hash", "importance").select("hash", "proto_id", "importance")


_D = "d as (select * from (select *, row_number() over (partition by proto_id order by usage_count desc nulls last, access_count desc nulls last) rn from volatile_positive) where rn = 1)"
_BASE = "case when 1 + list_avg({c}) <= 0 then 1e-8 else 1 + list_avg({c}) end"
UTILITY_SQL = f"""with {_D} select proto_id, round(sqrt(size * access_count) * (1 + sqrt(list_sum(variance) / len(variance))) * importance, 6) as utility,
  round(importance * ln(1 + access_count + 1e-8) * pow(size + 1, -1.5) * pow({_BASE.format(c='mean')}, 0.8) * pow({_BASE.format(c='variance')}, -1.2), 8) as quality from d where variance is not null and importance is not null"""
SURPRISE_SQL = f"""with {_D}, f as (select compat_id, unnest(mean) x, generate_subscripts(mean, 1) j from d), m as (select compat_id, list(x order by j) c from (select compat_id, j, avg(x) x from f group by 1, 2) group by 1),
s as (select proto_id, round(list_sum(list_transform(list_zip(mean, c), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(mean, lambda x: x * x))) * sqrt(list_sum(list_transform(c, lambda x: x * x)))), 9) sim from d join m using (compat_id))
select proto_id, round(sim, 6) as similarity, round(0.1 + 0.9 * pow(1 - greatest(0, least(1, sim)), 2), 6) as gate from s"""

PRUNED_SQL = f"""with {_D}, n as (select compat_id, proto_id from (select *, row_number() over (partition by compat_id order by last_accessed desc nulls last, proto_id) k from d) where k <= 3),
h as (select compat_id, proto_id from (select *, row_number() over (partition by compat_id order by importance desc nulls last, proto_id) k from d where proto_id not in (select proto_id from n)) where k <= 5)
select compat_id, proto_id, 'recent' as kept_as from n union all select compat_id, proto_id, 'best' from h"""
DEDUPED_SQL = """with u as (select proto_id, hash, importance from volatile_positive union select proto_id, hash, importance from volatile_negative)
select hash, proto_id, importance from (select *, row_number() over (partition by hash order by importance desc nulls last, proto_id) k from u) where k = 1"""

QUERIES = {"memory_utility": (q_utility, UTILITY_SQL), "memory_surprise": (q_surprise, SURPRISE_SQL), "memory_pooled": (q_pooled, None), "memory_pruned": (q_pruned, PRUNED_SQL), "memory_deduped": (q_deduped, DEDUPED_SQL)}
