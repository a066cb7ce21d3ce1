"""Cross-validation folds as range tables, joined to rows by position."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.bars import BARS_SQL, bars, numbered
from tidewright.session import cut, join_small, table

MOST_FOLDS = 100_000


@dataclass(frozen=True)
class Fold:
    """Inclusive position ranges; ``groups`` are the test blocks of a combinatorial fold."""

    fold: int
    test: tuple[tuple[int, int], ...]
    train: tuple[tuple[int, int], ...]
    purge: tuple[int, int]
    embargo_end: int
    groups: tuple[int, ...] = ()


def blocks(n: int, k: int) -> list[tuple[int, int]]:
    """``k`` neighbouring ranges of 0 .. n-1; the first ones take the remainder."""
    size, rest, out, at = n // k, n % k, [], 0
    for b in range(k):
        m = size + (b < rest)
        out.append((at, at + m - 1))
        at += m
    return out


def _train(n: int, test: list[tuple[int, int]], span: int, low: int, high: int) -> tuple[tuple[int, int], ...]:
    """What is neither tested nor has a label span that meets [low, high], as ranges."""
    shut = sorted([*test, (max(0, low - span + 1), high)])
    out, at = [], 0
    for a, b in shut:
        if a > at:
            out.append((at, a - 1))
        at = max(at, b + 1)
    if at < n:
        out.append((at, n - 1))
    return tuple(out)


def combinatorial_purged(n: int, k: int, test_groups: int = 1, embargo: int = 0, span: int = 1) -> list[Fold]:
    """Every choice of ``test_groups`` of ``k`` blocks; labels of ``span`` positions that reach into
    the test blocks or the embargo behind them leave the training rows."""
    if not (0 < k <= n and 0 < test_groups <= k):
        raise ValueError("need 0 < test_groups <= k <= n")
    if math.comb(k, test_groups) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} folds")
    parts, out = blocks(n, k), []
    for f, chosen in enumerate(itertools.combinations(range(k), test_groups)):
        test = [parts[g] for g in chosen]
        low, high = test[0][0], min(n - 1, test[-1][1] + span - 1)
        end = min(n - 1, high + embargo)
        out.append(Fold(f, tuple(test), _train(n, test, span, low, end), (low, high), end, chosen))
    return out


def purged_k_fold(n: int, k: int, embargo: int = 0, span: int = 1) -> list[Fold]:
    return combinatorial_purged(n, k, 1, embargo, span)


def walk_forward(n: int, train_size: int, test_size: int, step: int | None = None, expanding: bool = False) -> list[Fold]:
    if min(n, train_size, test_size, step or 1) <= 0:
        raise ValueError("sizes must be positive")
    out, end = [], train_size
    while end + test_size <= n:
        test = (end, end + test_size - 1)
        out.append(Fold(len(out), (test,), ((0 if expanding else end - train_size, end - 1),), test, test[1]))
        end += step or test_size
    return out


def leaks(fold: Fold, span: int = 1) -> bool:
    """Whether a training label reaches into a test label."""
    return any(a <= d + span - 1 and c <= b + span - 1 for a, b in fold.train for c, d in fold.test)


def is_causal(fold: Fold) -> bool:
    return max(b for _, b in fold.train) < min(a for a, _ in fold.test)


def walk_forward_table(sizes: DataFrame, train: int, test: int) -> DataFrame:
    """Walk-forward ranges of every stream of ``(stream, n)``, by arithmetic on the size alone."""
    last = F.expr(f"cast((n - {train}) div {test} as int)") - 1
    folds = sizes.where(F.col("n") >= train + test).withColumn("fold", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("fold") * test + train
    return folds.select("stream", "fold", (start - train).alias("train_lo"), (start - 1).alias("train_hi"), start.alias("test_lo"), (start + test - 1).alias("test_hi"))


def purged_table(sizes: DataFrame, k: int, embargo: int, span: int) -> DataFrame:
    """Purged k-fold ranges of every stream of ``(stream, n)``: one row per stream and fold."""
    f = sizes.where(F.col("n") >= k).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    size, rest = F.expr(f"n div {k}"), F.col("n") % k
    lo = F.col("fold") * size + F.least("fold", rest)
    hi = lo + size - 1 + F.when(F.col("fold") < rest, 1).otherwise(0)
    f = f.withColumn("test_lo", lo).withColumn("test_hi", hi)
    f = f.withColumn("purge_hi", F.least(F.col("n") - 1, F.col("test_hi") + span - 1)).withColumn("embargo_hi", F.least(F.col("n") - 1, F.col("purge_hi") + embargo))
    before = F.greatest(F.lit(0), F.col("test_lo") - span + 1)
    return f.withColumn("n_train", before + F.greatest(F.lit(0), F.col("n") - 1 - F.greatest("embargo_hi", "test_hi")))


def _sizes(spark, sf_dir):
    return bars(table(spark, sf_dir, "candles")).groupBy("stream").agg(F.count(F.lit(1)).alias("n"))


def q_purged(spark, sf_dir):
    return purged_table(_sizes(spark, sf_dir), 5, 3, 4).select("stream", F.col("fold").cast("bigint").alias("fold"), *[F.col(c).cast("bigint").alias(c) for c in ("test_lo", "test_hi", "purge_hi", "embargo_hi", "n_train")])


def q_walk_forward(spark, sf_dir):
    """Mean return and its deviation over each fold's test bars: folds joined to rows by position."""
    rows = numbered(table(spark, sf_dir, "candles"))
    folds = cut(walk_forward_table(rows.groupBy("stream").agg(F.count(F.lit(1)).alias("n")), 100, 25))
    tested = rows.withColumn("fold", F.expr("cast((i - 100) div 25 as int)")).where("i >= 100")
    both = tested.join(folds.select("stream", "fold", "train_lo", "test_lo", "test_hi"), ["stream", "fold"]).where("i between test_lo and test_hi")
    return both.groupBy("stream", "fold").agg(F.min("train_lo").alias("train_lo"), F.min("test_lo").alias("test_lo"), F.count(F.lit(1)).alias("bars"), F.round(F.max("high") - F.min("low"), 6).alias("span"))


def combinatorial_table(sizes: DataFrame, k: int, groups: int, embargo: int, span: int) -> DataFrame:
    """Combinatorial purged ranges of every stream of ``(stream, n)``: one row per choice of ``groups`` of
    the ``k`` blocks, with the blocks' ranges in ``test`` and the counts of training and tested rows."""
    if math.comb(k, groups) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} folds")
    chosen = F.array(*[F.array(*[F.lit(g) for g in c]) for c in itertools.combinations(range(k), groups)])
    f = sizes.where(F.col("n") >= k).select("stream", "n", F.posexplode(chosen).alias("fold", "groups"))
    size, rest = F.expr(f"n div {k}"), F.col("n") % k

    def block(g):
        lo = g * size + F.least(g, rest)
        return F.struct(lo.cast("bigint").alias("lo"), (lo + size - 1 + F.when(g < rest, 1).otherwise(0)).cast("bigint").alias("hi"))

    f = f.withColumn("test", F.transform("groups", block))
    f = f.withColumn("purge_lo", F.get("test", F.lit(0))["lo"]).withColumn("purge_hi", F.least(F.col("n") - 1, F.get("test", F.lit(groups - 1))["hi"] + span - 1))
    f = f.withColumn("embargo_hi", F.least(F.col("n") - 1, F.col("purge_hi") + embargo))
    n_test = F.aggregate("test", F.lit(0).cast("bigint"), lambda s, x: s + x["hi"] - x["lo"] + 1)
    before = F.greatest(F.lit(0), F.col("purge_lo") - span + 1)
    return f.withColumn("n_test", n_test).withColumn("n_train", before + F.greatest(F.lit(0), F.col("n") - 1 - F.col("embargo_hi")))


def q_combinatorial(spark, sf_dir):
    f = combinatorial_table(_sizes(spark, sf_dir), 6, 2, 3, 4)
    return f.select("stream", F.col("fold").cast("bigint").alias("fold"), F.concat_ws(",", F.transform("groups", lambda g: g.cast("string"))).alias("blocks"), *[F.col(c).cast("bigint").alias(c) for c in ("purge_lo", "purge_hi", "embargo_hi", "n_test", "n_train")])


def q_roles(spark, sf_dir):
    """What the purged folds do with every row: tested, trained, purged or embargoed, the training rows
    whose label reaches into a test label (none may), and whether the fold is causal."""
    span, k = 4, 5
    rows = numbered(table(spark, sf_dir, "candles")).select("stream", "i")
    folds = cut(purged_table(rows.groupBy("stream").agg(F.count(F.lit(1)).alias("n")), k, 3, span).select(F.col("stream").alias("fs"), "fold", "test_lo", "test_hi", "purge_hi", "embargo_hi"))
    j = join_small(rows, folds, F.col("stream").eqNullSafe(F.col("fs")))
    tested = F.col("i").between(F.col("test_lo"), F.col("test_hi"))
    reaches = (F.col("i") <= F.col("purge_hi")) & (F.col("i") + span - 1 >= F.col("test_lo")) & ~tested
    waits = F.col("i").between(F.col("purge_hi") + 1, F.col("embargo_hi")) & ~tested
    trained = ~(tested | reaches | waits)
    leaks_ = trained & (F.col("i") <= F.col("test_hi") + span - 1) & (F.col("test_lo") <= F.col("i") + span - 1)
    out = j.groupBy("stream", F.col("fold").cast("bigint").alias("fold")).agg(*[F.count_if(c).alias(n) for n, c in (("tested", tested), ("trained", trained), ("purged", reaches), ("embargoed", waits), ("leaking", leaks_))], F.max(F.when(trained, F.col("i"))).alias("last"), F.min("test_lo").alias("lo"))
    return out.withColumn("causal", F.coalesce(F.col("last") < F.col("lo"), F.lit(True))).drop("last", "lo")


PURGED_SQL = f"""with {BARS_SQL}, s as (select stream, count(*) n from b group by 1), f as (select stream, n, unnest(range(5)) fold from s where n >= 5),
t as (select *, fold * (n // 5) + least(fold, n % 5) test_lo, fold * (n // 5) + least(fold, n % 5) + n // 5 - 1 + (fold < n % 5)::int test_hi from f),
p as (select *, least(n - 1, test_hi + 3) purge_hi, least(n - 1, least(n - 1, test_hi + 3) + 3) embargo_hi from t)
select p.stream, fold, test_lo, test_hi, purge_hi, embargo_hi, (select count(*) from range(n) r(i) where not (i between test_lo and test_hi) and not (i <= embargo_hi and i + 3 >= test_lo)) as n_train from p"""
WALK_SQL = f"""with {BARS_SQL}, s as (select stream, count(*) n from b group by 1), f as (select stream, n, unnest(range((n - 100) // 25)) fold from s where n >= 125)
select f.stream, fold::int as fold, fold * 25 as train_lo, fold * 25 + 100 as test_lo, count(*) as bars, round(max(high) - min(low), 6) as span
from f join b on b.stream = f.stream and b.i between fold * 25 + 100 and fold * 25 + 124 group by 1, 2, 3, 4"""
CPCV_SQL = f"""with {BARS_SQL}, s as (select stream, count(*) n from b group by 1), g as (select stream, n, unnest(range(6)) g from s where n >= 6),
bl as (select *, g * (n // 6) + least(g, n % 6) lo, g * (n // 6) + least(g, n % 6) + n // 6 - 1 + (g < n % 6)::int hi from g),
pr as (select x.stream, x.n, x.g a, y.g b, x.lo la, x.hi ha, y.lo lb, y.hi hb, row_number() over (partition by x.stream order by x.g, y.g) - 1 fold from bl x join bl y on x.stream = y.stream and x.g < y.g),
pu as (select *, least(n - 1, hb + 3) ph, least(n - 1, least(n - 1, hb + 3) + 3) eh from pr)
select stream, fold, a || ',' || b as blocks, la as purge_lo, ph as purge_hi, eh as embargo_hi, ha - la + 1 + hb - lb + 1 as n_test,
  (select count(*) from range(n) r(i) where not (i between la and ha) and not (i between lb and hb) and not (i <= eh and i + 3 >= la)) as n_train from pu"""
ROLES_SQL = f"""with {BARS_SQL}, s as (select stream, count(*) n from b group by 1), f as (select stream, n, unnest(range(5)) fold from s where n >= 5),
t as (select *, fold * (n // 5) + least(fold, n % 5) lo, fold * (n // 5) + least(fold, n % 5) + n // 5 - 1 + (fold < n % 5)::int hi from f),
p as (select *, least(n - 1, hi + 3) ph, least(n - 1, least(n - 1, hi + 3) + 3) eh from t),
ro as (select p.*, i, case when i between lo and hi then 'test' when i <= ph and i + 3 >= lo then 'purged' when i between ph + 1 and eh then 'embargo' else 'train' end role from p join b on p.stream is not distinct from b.stream)
select stream, fold, count(*) filter (where role = 'test') as tested, count(*) filter (where role = 'train') as trained, count(*) filter (where role = 'purged') as purged, count(*) filter (where role = 'embargo') as embargoed,
  count(*) filter (where role = 'train' and exists (select 1 from range(lo, hi + 1) x(j) where i <= j + 3 and j <= i + 3)) as leaking, coalesce(max(i) filter (where role = 'train') < min(lo), true) as causal from ro group by 1, 2"""
