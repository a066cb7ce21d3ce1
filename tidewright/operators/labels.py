"""Event labels, event filters and sample weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.bars import BARS_SQL, numbered, order, own, with_halo
from tidewright.session import cut, join_small, table


def triple_barrier(rows: DataFrame, up: Column, down: Column, horizon: int = 10) -> DataFrame:
    """Adds ``label`` (1 profit, -1 stop, 0 neither) and ``touched``, the position of the first bar
    of the next ``horizon`` at or beyond a level; profit is tried first. ``rows`` come from
    ``with_halo(..., ahead=horizon)``; ``up`` and ``down`` are price levels."""
    ahead = F.collect_list(F.struct("i", "close")).over(order().rowsBetween(1, horizon))
    rows = rows.withColumn("up", up).withColumn("down", down).withColumn("next", ahead)
    hits = F.filter("next", lambda x: (x["close"] >= F.col("up")) | (x["close"] <= F.col("down")))
    first = F.when(F.size(hits) > 0, hits[0])
    end = F.when(F.size("next") > 0, F.col("next")[F.size("next") - 1]["i"]).otherwise(F.col("i"))
    label = F.when(first["close"] >= F.col("up"), 1).when(first["close"] <= F.col("down"), -1).otherwise(0)
    exit_price = F.coalesce(first["close"], F.when(F.size("next") > 0, F.col("next")[F.size("next") - 1]["close"]), F.col("close"))
    return rows.withColumns({"label": label, "touched": F.coalesce(first["i"], end), "gain": exit_price - F.col("close")}).drop("next")


def sample_uniqueness(spans: DataFrame, key: list[str]) -> DataFrame:
    """Mean of 1 / (labels alive) over the positions of each span ``(key, id, s, e)``."""
    at = spans.select(*key, "id", F.explode(F.sequence("s", "e")).alias("t"))
    alive = at.groupBy(*key, "t").agg(F.count(F.lit(1)).alias("c"))
    return at.join(alive, [*key, "t"]).groupBy(*key, "id").agg(F.avg(1 / F.col("c")).alias("uniqueness"))


def clamp_weights(w: Column, low: float = 0.0, high: float = float("inf")) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), w))


def normalize_weights(w: str, key: list[str], to: str = "mean1") -> Column:
    over = Window.partitionBy(*key)
    return F.col(w) / (F.avg(w).over(over) if to == "mean1" else F.sum(w).over(over)) if to != "none" else F.col(w)


def effective_sample_size(w: str) -> Column:
    """Kish: (sum w)^2 / sum w^2."""
    return F.pow(F.sum(w), F.lit(2)) / F.sum(F.col(w) * F.col(w))


def weighted_mean(x: str, w: str) -> Column:
    return F.sum(F.col(x) * F.col(w)) / F.sum(F.when(F.col(x).isNotNull(), F.col(w)))


def cusum_events(rows: DataFrame, threshold: float) -> DataFrame:
    """Positions at which the relative price has drifted more than ``threshold`` either way since
    the last event. The filter starts anew at each event, so a stream is read once in order; the
    state is two numbers, and batches are not kept. ``rows``: stream, i, us, close."""
    flow = rows.select("stream", "i", "us", "close").repartition("stream").sortWithinPartitions("stream", "i")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last, pos, neg = None, 0.0, 0.0, 0.0
        for f in frames:
            keep = []
            for k, (s, c) in enumerate(zip(f["stream"], f["close"], strict=True)):
                if s != at:
                    at, pos, neg = s, 0.0, 0.0
                else:
                    r = c / last - 1
                    pos, neg = max(0.0, pos + r), min(0.0, neg + r)
                    if pos > threshold or neg < -threshold:
                        keep.append(k)
                        pos = neg = 0.0
                last = c
            yield f.iloc[keep][["stream", "i", "us"]]

    return flow.mapInPandas(run, "stream string, i bigint, us bigint")


def sequential_bootstrap(spans: list[tuple[int, int]], size: int, seed: int = 1) -> list[int]:
    """Draws that favour labels with little overlap: a label's weight falls with the picks alive in its span."""
    rng = np.random.default_rng(seed)
    picks = np.zeros(max(e for _, e in spans) + 2)
    out = []
    for _ in range(size):
        w = np.array([np.mean(1 / (1 + picks[s : e + 1])) for s, e in spans])
        k = int(rng.choice(len(spans), p=w / w.sum()))
        out.append(k)
        picks[spans[k][0] : spans[k][1] + 1] += 1
    return out


def labelled(candles: DataFrame, horizon: int = 10, width: float = 0.01) -> DataFrame:
    rows = with_halo(numbered(candles), 1, ahead=horizon)
    return own(triple_barrier(rows, F.col("close") * (1 + width), F.col("close") * (1 - width), horizon))


def q_triple_barrier(spark, sf_dir):
    out = labelled(table(spark, sf_dir, "candles"))
    return out.select("stream", "i", "label", "touched", F.round("gain", 6).alias("gain"))


def q_uniqueness(spark, sf_dir):
    """Uniqueness of the triple-barrier labels, per stream the mean and the effective sample size."""
    spans = labelled(table(spark, sf_dir, "candles")).select("stream", F.col("i").alias("id"), F.col("i").alias("s"), F.col("touched").alias("e"))
    u = sample_uniqueness(spans, ["stream"])
    return u.groupBy("stream").agg(F.round(F.avg("uniqueness"), 8).alias("mean_uniqueness"), F.round(F.sum("uniqueness"), 5).alias("effective_size"), F.round(effective_sample_size("uniqueness"), 4).alias("kish"))


def q_cusum(spark, sf_dir):
    return cusum_events(numbered(table(spark, sf_dir, "candles")), 0.02)


def sample_weights(labels: DataFrame, low: float = 0.1, high: float = 5.0) -> DataFrame:
    """``(stream, id, weight)`` of labels ``(stream, id, uniqueness, gain)``: uniqueness times the size of the
    gain, divided by the stream's mean, kept within bounds and divided by the mean again. The means
    come from aggregates, so a stream with a third of the rows is many tasks; labels without a gain
    weigh nothing, and a stream whose weights are all 0 gets equal ones."""
    w = labels.select("stream", "id", (F.col("uniqueness") * F.abs(F.coalesce("gain", F.lit(0.0)))).alias("w"))
    for last in (False, True):
        means = cut(w.groupBy(F.col("stream").alias("ms")).agg(F.avg("w").alias("mean")))
        scaled = F.when(F.col("mean") > 0, F.col("w") / F.col("mean")).otherwise(1.0)
        w = join_small(w, means, F.col("stream").eqNullSafe(F.col("ms"))).select("stream", "id", (scaled if last else clamp_weights(scaled, low, high)).alias("w"))
    return w.withColumnRenamed("w", "weight")


def q_sample_weights(spark, sf_dir):
    """Per stream: the labels' weights, their effective number, and the weighted and plain mean gain."""
    lab = cut(labelled(table(spark, sf_dir, "candles")).select("stream", F.col("i").alias("id"), F.col("i").alias("s"), F.col("touched").alias("e"), (F.col("gain") / F.col("close")).alias("gain")))
    u = sample_uniqueness(lab.select("stream", "id", "s", "e"), ["stream"]).select(F.col("stream").alias("us"), F.col("id").alias("ui"), F.round("uniqueness", 9).alias("uniqueness"))
    both = cut(lab.join(u, F.col("stream").eqNullSafe(F.col("us")) & (F.col("id") == F.col("ui"))).select("stream", "id", "uniqueness", "gain"))
    w = sample_weights(both).select(F.col("stream").alias("ws"), F.col("id").alias("wi"), "weight")
    j = both.join(w, F.col("stream").eqNullSafe(F.col("ws")) & (F.col("id") == F.col("wi")))
    return j.groupBy("stream").agg(F.count(F.lit(1)).alias("labels"), F.round(F.min("weight"), 6).alias("least"), F.round(F.max("weight"), 6).alias("most"), F.round(effective_sample_size("weight"), 4).alias("effective"), F.round(weighted_mean("gain", "weight"), 9).alias("weighted_gain"), F.round(F.avg("gain"), 9).alias("mean_gain"))


_TB = f"""with {BARS_SQL}, h as (select b.stream, b.i, min(n.i) hit from b join b n on n.stream = b.stream and n.i between b.i + 1 and b.i + 10
    and (n.close >= b.close * (1 + 0.01) or n.close <= b.close * (1 - 0.01)) group by 1, 2),
m as (select stream, max(i) last from b group by 1),
t as (select b.stream, b.i, b.close, coalesce(hit, least(last, b.i + 10)) touched, hit from b join m using (stream) left join h using (stream, i)),
l as (select t.stream, t.i, case when hit is null then 0 when x.close >= t.close * (1 + 0.01) then 1 else -1 end as label, touched, x.close - t.close gain
  from t join b x on x.stream = t.stream and x.i = t.touched)"""
TRIPLE_SQL = _TB + " select stream, i, label, touched, round(gain, 6) as gain from l"
UNIQUE_SQL = _TB + """, e as (select stream, i id, unnest(generate_series(i, touched)) t from l), c as (select stream, t, count(*) c from e group by all),
u as (select stream, id, avg(1.0::double / c) u from e join c using (stream, t) group by all)
select stream, round(avg(u), 8) as mean_uniqueness, round(sum(u), 5) as effective_size, round(pow(sum(u), 2) / sum(u * u), 4) as kish from u group by 1"""
WEIGHTS_SQL = _TB + """, e as (select stream, i id, unnest(generate_series(i, touched)) t from l), c as (select stream, t, count(*) c from e group by all),
u as (select stream, id, round(avg(1.0::double / c), 9) u from e join c using (stream, t) group by all),
g as (select u.stream, u.id, u, l.gain / b.close g from u join l on l.stream = u.stream and l.i = u.id join b on b.stream = u.stream and b.i = u.id),
w1 as (select *, u * abs(g) w from g), w2 as (select *, greatest(0.1, least(5.0, case when avg(w) over p > 0 then w / avg(w) over p else 1 end)) c from w1 window p as (partition by stream)),
w3 as (select *, c / avg(c) over (partition by stream) wt from w2)
select stream, count(*) as labels, round(min(wt), 6) as least, round(max(wt), 6) as most, round(pow(sum(wt), 2) / sum(wt * wt), 4) as effective, round(sum(g * wt) / sum(wt), 9) as weighted_gain, round(avg(g), 9) as mean_gain from w3 group by 1"""
#: Step by step from each stream's first bar; the sums start anew at an event.
CUSUM_SQL = f"""with recursive {BARS_SQL}, q as (select stream, i, us, ret from r),
c as (select stream, i, us, 0.0::double pos, 0.0::double neg, false hit from q where i = 0
  union all select q.stream, q.i, q.us, case when x.p > 0.02 or x.n < -0.02 then 0 else x.p end, case when x.p > 0.02 or x.n < -0.02 then 0 else x.n end, x.p > 0.02 or x.n < -0.02
    from c join q on q.stream = c.stream and q.i = c.i + 1, lateral (select greatest(0.0::double, c.pos + q.ret) p, least(0.0::double, c.neg + q.ret) n) x)
select stream, i, us from c where hit"""
