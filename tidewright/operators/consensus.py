"""Ensemble consensus in two levels of aggregation, settlement of simulated trades, and the
metrics and alerts that watch over it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.bars import BARS_SQL, bar_returns, numbered, order, own, with_halo
from tidewright.session import cut, join_small, table


# consensus --------------------------------------------------------------------------------------


def controller_params(group: Column, section: Column, layer: Column, base_: float, boost: float = 0.1) -> Column:
    """A parameter scaled by its place in the tree."""
    return base_ * (1 + boost * group) * (1 + boost * section) * (1 + boost * layer)


def structure(spark, groups: int, sections: int, layers: int, clusters: int) -> DataFrame:
    """The controller tree, one row per cluster."""
    ids = [(g, s, la, c) for g in range(groups) for s in range(sections) for la in range(layers) for c in range(clusters)]
    return spark.createDataFrame(ids, "group int, section int, layer int, cluster int").withColumn("polarity", F.when(F.col("cluster") % 2 == 0, "positive").otherwise("negative"))


def dynamic_weight() -> Column:
    return F.greatest(F.lit(0.01), F.col("prob") * F.col("score"))


def market_context(bars: DataFrame, last: int = 14) -> DataFrame:
    """``(mk, price, atr, volatility)`` of each key of ``(key, at, high, low, close)``: the last close, the mean
    true range of the last ``last`` bars (0.01 where it is 0) and their ratio. A key's bars are few."""
    w = Window.partitionBy("key").orderBy("at")
    before = F.coalesce(F.lag("close").over(w), F.col("close"))
    ranged = bars.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))).withColumn("back", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("at"))))
    close, atr = F.max_by("close", "at"), F.avg(F.when(F.col("back") <= last, F.col("tr")))
    m = ranged.groupBy(F.col("key").alias("mk")).agg(F.when(close > 0, close).otherwise(1.0).alias("price"), F.when(atr > 0, atr).otherwise(0.01).alias("atr"))
    return m.withColumn("volatility", F.col("atr") / F.col("price"))


def aggregate_layers(signals: DataFrame) -> DataFrame:
    """First level: per group, section, layer and direction the strength (polarity x probability x
    weight), the weight, and the weighted prices that are set (above 0)."""
    s = signals.withColumn("prob", F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("prob")))).withColumn("w", dynamic_weight())
    sign = F.when(F.col("direction") == "BUY", 1).otherwise(-1)
    priced = [F.sum(F.when(F.col(c) > 0, F.col(c) * F.col("w")).otherwise(0.0)).alias(c) for c in ("entry", "exit", "stop")]
    return s.groupBy("key", "grp", "section", "layer", "direction").agg(F.sum(sign * F.col("prob") * F.col("w")).alias("strength"), F.sum("w").alias("weight"), *priced, F.count(F.lit(1)).alias("votes"))


def resolve(layers: DataFrame, market: DataFrame) -> DataFrame:
    """One verdict per key: layers with a positive strength against the others, SELL on a tie. The
    heavier side's share, raised with volatility and kept within 50 to 100, is the confidence; prices
    are the winning side's, and missing exits and stops stand at five and two true ranges."""
    pos = F.col("strength") > 0
    sums = [F.sum(F.when(pos if side == "p" else ~pos, F.col(c)).otherwise(0.0)).alias(f"{side}_{c}") for side in "pn" for c in ("strength", "weight", "entry", "exit", "stop")]
    a = layers.groupBy("key").agg(*sums, F.sum("votes").alias("votes")).withColumn("n_strength", F.abs("n_strength"))
    a = join_small(a, cut(market), F.col("key") == F.col("mk"), "left")
    buy = F.col("p_strength") > F.col("n_strength")
    won = lambda c: F.when(buy, F.col(f"p_{c}")).otherwise(F.col(f"n_{c}"))
    total = F.col("p_strength") + F.col("n_strength")
    share = 100 * F.greatest("p_strength", "n_strength") / F.when(total == 0, 1.0).otherwise(total) * (1 + 1.5 * F.col("volatility"))
    a = a.withColumns({"sign": F.when(buy, 1).otherwise(-1), "confidence": F.greatest(F.lit(50.0), F.least(F.lit(100.0), share)), "w": won("weight")})
    a = a.withColumns({c: F.when(F.col("w") > 0, won(c) / F.col("w")).otherwise(F.col("price") if c == "entry" else F.lit(0.0)) for c in ("entry", "exit", "stop")})
    a = a.withColumns({"exit": F.when(F.col("exit") == 0, F.col("entry") * (1 + F.col("sign") * 5 * F.col("atr"))).otherwise(F.col("exit")), "stop": F.when(F.col("stop") == 0, F.col("entry") * (1 - F.col("sign") * 2 * F.col("atr"))).otherwise(F.col("stop"))})
    a = a.withColumn("entry", F.round(F.when(F.col("entry") > 0, F.col("entry")).otherwise(F.col("price")), 4)).withColumns({c: F.round(c, 4) for c in ("exit", "stop")})
    away = lambda c: F.abs(F.round((F.col(c) - F.col("entry")) / F.col("entry") * 100, 3))
    return a.select("key", F.when(buy, "BUY").otherwise("SELL").alias("direction"), F.round("confidence", 3).alias("confidence"), "entry", "exit", "stop", away("exit").alias("profit_pct"), away("stop").alias("stop_pct"), "votes")


def influence(signals: DataFrame) -> DataFrame:
    """Each voter's share of the weight of its key, in per cent; a key's total comes from an aggregate."""
    s = signals.where("prob >= 0").withColumn("w", dynamic_weight())
    total = cut(s.groupBy(F.col("key").alias("tk")).agg(F.sum("w").alias("total")))
    return join_small(s, total, F.col("key") == F.col("tk")).select("key", "voter", F.round(100 * F.col("w") / F.col("total"), 6).alias("influence"))


def event_signals(events: DataFrame) -> DataFrame:
    """Signals out of the events table: the day is the key, the user the voter and the event's
    value its price; probability, score, exits and stops follow from its numbers."""
    exit_, stop = F.when(F.col("event_id") % 3 == 0, F.col("value") * 1.05).otherwise(0.0), F.when(F.col("event_id") % 7 == 0, F.col("value") * 0.97).otherwise(0.0)
    return events.select(
        F.date_format("ts", "yyyy-MM-dd").alias("key"), F.col("event_id").alias("voter"), (F.col("user_id") % 3).alias("grp"), (F.col("user_id") % 5).alias("section"), (F.col("user_id") % 7).alias("layer"),
        F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("direction"), F.when(F.col("event_id") % 11 == 0, -1.0).otherwise((F.col("user_id") % 101) / 100.0).alias("prob"),
        ((F.col("event_id") % 17) / 16.0).alias("score"), F.col("value").alias("entry"), exit_.alias("exit"), stop.alias("stop"),
    )


def event_market(events: DataFrame) -> DataFrame:
    """Market context of each day, from its hourly bars of event values."""
    when = F.struct("ts", "event_id")
    hourly = events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("key"), F.hour("ts").alias("at")).agg(F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", when).alias("close"))
    return market_context(hourly)


# settlement -------------------------------------------------------------------------------------


def settle(rows: DataFrame, up: float, down: float, horizon: int, policy: str = "conservative") -> DataFrame:
    """Outcome of a trade opened at each bar's close by the first of the next ``horizon`` bars whose
    high or low reaches a level; if one bar reaches both, the policy says which counts."""
    ahead = F.collect_list(F.struct("i", "high", "low")).over(order().rowsBetween(1, horizon))
    rows = rows.withColumn("next", ahead)
    top, bottom = F.col("close") * (1 + up), F.col("close") * (1 - down)
    hit = F.filter("next", lambda x: (x["high"] >= top) | (x["low"] <= bottom))
    first = F.get(hit, F.lit(0))
    wins = first["high"] >= top
    if policy == "conservative":
        wins = wins & (first["low"] > bottom)
    return rows.withColumns({"settled_at": first["i"], "outcome": F.when(first.isNull(), F.lit(None).cast("int")).when(wins, 1).otherwise(0)}).drop("next")


# metrics ----------------------------------------------------------------------------------------




def concentration(rows: DataFrame, key: str, x: str) -> DataFrame:
    """Per key: Herfindahl index, entropy in bits, effective number, Gini and largest share of ``x``.

    Ranks for Gini come from counts per distinct value, so equal values need no order among them."""
    rows = rows.where(F.col(x) > 0).select(F.col(key).alias("key"), F.col(x).alias("x"))
    per = rows.groupBy("key", "x").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("key").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    tot = rows.groupBy("key").agg(F.sum("x").alias("t"), F.count(F.lit(1)).alias("m"))
    j = per.join(tot, "key").withColumn("p", F.col("x") / F.col("t"))
    rank_sum = F.sum(F.col("x") * (F.col("n") * F.col("below") + F.col("n") * (F.col("n") + 1) / 2))
    m, t = F.first("m"), F.first("t")
    out = j.groupBy("key").agg(F.sum(F.col("n") * F.col("p") * F.col("p")).alias("hhi"), (-F.sum(F.col("n") * F.col("p") * F.log2("p"))).alias("entropy"), (2 * rank_sum / (m * t) - (m + 1) / m).alias("gini"), F.max("p").alias("max_share"))
    return out.select(F.col("key").alias(key), *[F.round(c, 6).alias(n) for n, c in (("hhi", F.col("hhi")), ("entropy", F.col("entropy")), ("effective", 1 / F.col("hhi")), ("gini", F.col("gini")), ("max_share", F.col("max_share")))])


def cohens_kappa(a: str, b: str) -> Column:
    """Agreement of two binary votes beyond chance."""
    n = F.count(F.lit(1))
    po = F.count_if(F.col(a) == F.col(b)) / n
    pa, pb = F.count_if(F.col(a) == 1) / n, F.count_if(F.col(b) == 1) / n
    pe = pa * pb + (1 - pa) * (1 - pb)
    return F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0)


def cusum_path(x: np.ndarray, target: float = 0.0, k: float = 0.5, h: float = 5.0, sigma: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper and lower sums and the alarms of a two-sided CUSUM chart."""
    hi, lo, a, b = np.empty(len(x)), np.empty(len(x)), 0.0, 0.0
    for i, v in enumerate((x - target) / sigma):
        a, b = max(0.0, a + v - k), max(0.0, b - v - k)
        hi[i], lo[i] = a, b
    return hi, lo, (hi > h) | (lo > h)


def ewma_series(x: np.ndarray, decay: float = 0.9) -> np.ndarray:
    out, y = np.empty(len(x)), x[0] if len(x) else 0.0
    for i, v in enumerate(x):
        y = decay * y + (1 - decay) * v if i else v
        out[i] = y
    return out


ALERT_RULES = (("gini_high", "gini", ">", 0.3, "warning"), ("one_voter", "max_share", ">", 0.02, "critical"), ("few_voters", "effective", "<", 200.0, "warning"))


def evaluate_alerts(metrics: DataFrame, key: str, rules=ALERT_RULES) -> DataFrame:
    """The rules that fire for each row of metrics."""
    tests = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}
    fired = F.array_compact(F.array(*[F.when(tests[op](F.col(m), F.lit(limit)), F.struct(F.lit(r).alias("rule"), F.lit(level).alias("severity"), F.col(m).alias("value"))) for r, m, op, limit, level in rules]))
    return metrics.select(key, F.inline(fired))


def resolved_alerts(before: DataFrame, now: DataFrame) -> DataFrame:
    return before.join(now, [c for c in ("key", "rule") if c in before.columns], "left_anti")


def q_consensus(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return resolve(aggregate_layers(event_signals(events)), event_market(events))


def q_market(spark, sf_dir):
    return event_market(table(spark, sf_dir, "events")).select(F.col("mk").alias("key"), "price", F.round("atr", 6).alias("atr"), F.round("volatility", 6).alias("volatility"))


def q_structure(spark, sf_dir):
    """The controller tree with the parameters of each place."""
    tree = structure(spark, 3, 3, 4, 2)
    at = [F.col(c) for c in ("group", "section", "layer")]
    return tree.select("group", "section", "layer", "cluster", "polarity", *[F.round(controller_params(*at, base), 6).alias(n) for n, base in (("cache", 250.0), ("speed", 1000.0))])


def q_influence(spark, sf_dir):
    return influence(event_signals(table(spark, sf_dir, "events")))


def q_concentration(spark, sf_dir):
    s = event_signals(table(spark, sf_dir, "events")).where("prob >= 0").withColumn("w", F.round(dynamic_weight(), 9))
    return concentration(s, "key", "w")


def q_alerts(spark, sf_dir):
    return evaluate_alerts(q_concentration(spark, sf_dir), "key")


def q_kappa(spark, sf_dir):
    """Agreement between a rising bar and rising volume, per stream."""
    rows = bar_returns(with_halo(numbered(table(spark, sf_dir, "candles")), 1)).withColumn("v", F.when(F.col("volume") > F.lag("volume").over(order()), 1).otherwise(0)).withColumn("u", F.when(F.col("ret") > 0, 1).otherwise(0))
    return own(rows).where("i > 0").groupBy("stream").agg(F.round(cohens_kappa("u", "v"), 6).alias("kappa"))


def q_settled(spark, sf_dir):
    rows = with_halo(numbered(table(spark, sf_dir, "candles")), 1, ahead=24)
    return own(settle(rows, 0.02, 0.01, 24)).select("stream", "i", "settled_at", "outcome")


def q_accuracy(spark, sf_dir):
    """Settled share, win rate and points per stream."""
    s = q_settled(spark, sf_dir)
    return s.groupBy("stream").agg(F.count(F.lit(1)).alias("trades"), F.count("outcome").alias("settled"), F.round(F.avg("outcome"), 6).alias("win_rate"), F.round(F.avg(F.col("settled_at") - F.col("i")), 4).alias("bars_to_settle"))


_SIG = """s as (select strftime(ts, '%Y-%m-%d') as key, event_id voter, user_id % 3 grp, user_id % 5 section, user_id % 7 layer, case when event_id % 2 = 0 then 'BUY' else 'SELL' end direction,
  case when event_id % 11 = 0 then -1.0::double else (user_id % 101) / 100.0::double end prob, (event_id % 17) / 16.0::double score from events),
wv as (select *, greatest(0.01, prob * score) w from s where prob >= 0)"""
MARKET_SQL = """hb as (select strftime(ts, '%Y-%m-%d') as key, hour(ts) h, max(value) hi, min(value) lo, arg_max(value, (ts, event_id)) cl from events group by 1, 2),
hp as (select *, coalesce(lag(cl) over (partition by key order by h), cl) pc, row_number() over (partition by key order by h desc) back from hb),
mc as (select key, arg_max(cl, h) price, avg(greatest(hi - lo, abs(hi - pc), abs(lo - pc))) filter (where back <= 14) atr from hp group by 1),
mk as (select key, case when price > 0 then price else 1 end price, case when atr > 0 then atr else 0.01 end atr from mc)"""
CONTEXT_SQL = f"with {MARKET_SQL} select key, price, round(atr, 6) as atr, round(atr / price, 6) as volatility from mk"
#: Layer by layer: strength = sign * prob * weight; sides by the sign of a layer's strength; prices of the winning side over its whole weight.
CONSENSUS_SQL = f"""with {MARKET_SQL}, sg as (select strftime(ts, '%Y-%m-%d') as key, user_id % 3 grp, user_id % 5 section, user_id % 7 layer, event_id % 2 = 0 buy,
  greatest(0.01, least(0.99, case when event_id % 11 = 0 then -1.0::double else (user_id % 101) / 100.0::double end)) p, (event_id % 17) / 16.0::double sc, value en,
  case when event_id % 3 = 0 then value * 1.05::double else 0 end ex, case when event_id % 7 = 0 then value * 0.97::double else 0 end st from events),
sw as (select *, greatest(0.01, p * sc) w from sg),
la as (select key, grp, section, layer, buy, sum(case when buy then p * w else -p * w end) strength, sum(w) w, sum(case when en > 0 then en * w else 0 end) en, sum(ex * w) ex, sum(st * w) st, count(*) votes from sw group by 1, 2, 3, 4, 5),
sd as (select key, sum(case when strength > 0 then strength else 0 end) ps, sum(case when strength > 0 then 0 else -strength end) ns, sum(case when strength > 0 then w else 0 end) pw, sum(case when strength > 0 then 0 else w end) nw,
  sum(case when strength > 0 then en else 0 end) pe, sum(case when strength > 0 then 0 else en end) ne, sum(case when strength > 0 then ex else 0 end) px, sum(case when strength > 0 then 0 else ex end) nx,
  sum(case when strength > 0 then st else 0 end) pt, sum(case when strength > 0 then 0 else st end) nt, sum(votes)::bigint votes from la group by 1),
w1 as (select key, ps > ns up, votes, price, atr, greatest(50, least(100, greatest(ps, ns) / case when ps + ns = 0 then 1 else ps + ns end * 100 * (1 + atr / price * 1.5))) conf,
  case when ps > ns then pw else nw end w, case when ps > ns then pe else ne end en, case when ps > ns then px else nx end ex, case when ps > ns then pt else nt end st from sd join mk using (key)),
w2 as (select *, case when w > 0 then en / w else price end e1, case when w > 0 then ex / w else 0 end x1, case when w > 0 then st / w else 0 end s1 from w1),
w3 as (select key, up, conf, votes, round(case when e1 > 0 then e1 else price end, 4) e, round(case when x1 = 0 then e1 * (1 + case when up then 5 else -5 end * atr) else x1 end, 4) x, round(case when s1 = 0 then e1 * (1 - case when up then 2 else -2 end * atr) else s1 end, 4) s from w2)
select key, case when up then 'BUY' else 'SELL' end as direction, round(conf, 3) as confidence, e as entry, x as exit, s as stop, abs(round((x - e) / e * 100, 3)) as profit_pct, abs(round((s - e) / e * 100, 3)) as stop_pct, votes from w3"""
STRUCTURE_SQL = """select g.i::int as "group", s.i::int as section, l.i::int as layer, c.i::int as cluster, case when c.i % 2 = 0 then 'positive' else 'negative' end as polarity,
  round(250.0::double * (1 + 0.1 * g.i) * (1 + 0.1 * s.i) * (1 + 0.1 * l.i), 6) as cache, round(1000.0::double * (1 + 0.1 * g.i) * (1 + 0.1 * s.i) * (1 + 0.1 * l.i), 6) as speed from range(3) g(i), range(3) s(i), range(4) l(i), range(2) c(i)"""
INFLUENCE_SQL = f"with {_SIG} select key, voter, round(100 * w / sum(w) over (partition by key), 6) as influence from wv"
_CONC = f"""with {_SIG}, v as (select key, round(w, 9) x, row_number() over (partition by key order by round(w, 9)) rk, sum(round(w, 9)) over (partition by key) t, count(*) over (partition by key) m from wv),
c as (select key, round(sum(pow(x / t, 2)), 6) as hhi, round(-sum(x / t * log2(x / t)), 6) as entropy, round(1 / sum(pow(x / t, 2)), 6) as effective, round(2 * sum(rk * x) / (any_value(m) * any_value(t)) - (any_value(m) + 1) / any_value(m), 6) as gini, round(max(x / t), 6) as max_share from v group by 1)"""
CONC_SQL = _CONC + " select * from c"
ALERTS_SQL = _CONC + " " + " union all ".join(f"select key, '{r}' as rule, '{level}' as severity, {m} as value from c where {m} {op} {limit}" for r, m, op, limit, level in ALERT_RULES)
KAPPA_SQL = f"""with {BARS_SQL}, u as (select stream, i, (ret > 0)::int a, (volume > lag(volume) over (partition by stream order by i))::int b from r), k as (select stream, avg((a = b)::int) po, avg(a) pa, avg(b) pb from u where i > 0 group by 1)
select stream, round(case when pa * pb + (1 - pa) * (1 - pb) < 1 then (po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) else 1 end, 6) as kappa from k"""
_SETTLE = f"""with {BARS_SQL}, h as (select b.stream, b.i, min(n.i) hit from b join b n on n.stream = b.stream and n.i between b.i + 1 and b.i + 24 and (n.high >= b.close * (1 + 0.02) or n.low <= b.close * (1 - 0.01)) group by 1, 2),
st as (select b.stream, b.i, hit as settled_at, case when hit is null then null when n.high >= b.close * (1 + 0.02) and n.low > b.close * (1 - 0.01) then 1 else 0 end as outcome
  from b left join h using (stream, i) left join b n on n.stream = b.stream and n.i = hit)"""
SETTLE_SQL = _SETTLE + " select * from st"
ACC_SQL = _SETTLE + " select stream, count(*) as trades, count(outcome) as settled, round(avg(outcome), 6) as win_rate, round(avg(settled_at - i), 4) as bars_to_settle from st group by 1"

QUERIES = {"consensus": (q_consensus, CONSENSUS_SQL), "market_context": (q_market, CONTEXT_SQL), "controller_tree": (q_structure, STRUCTURE_SQL), "influence": (q_influence, INFLUENCE_SQL), "concentration": (q_concentration, CONC_SQL), "alerts": (q_alerts, ALERTS_SQL), "vote_kappa": (q_kappa, KAPPA_SQL), "settled_trades": (q_settled, SETTLE_SQL), "trade_accuracy": (q_accuracy, ACC_SQL)}
