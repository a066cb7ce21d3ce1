from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from data import CANDLES, MANIFEST, T0, at, candles, walk
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.operators import bars as B
from tidewright.operators import indicators as I
from tidewright.operators import quality, regular_grid
from tidewright.operators.labels import cusum_events, sequential_bootstrap
from tidewright.operators.rolling_totals import rolling_totals


def test_rolling_totals_by_hand(spark):
    rows = [(1, "a", 0, 1.0, 1.0, 1.0, 10.0, 5.0), (2, "a", 0, 1.0, 1.0, 1.0, 20.0, 7.0), (3, "a", 1440 * 8, 1.0, 1.0, 1.0, 40.0, 1.0), (4, "a", 1440 * 40, 1.0, 1.0, 1.0, None, None), (5, "a", None, 1.0, 1.0, 1.0, 9.0, 9.0)]
    df = candles(spark, rows).withColumn("ingested_at", F.when(F.col("row_id") == 2, F.col("ingested_at") + F.expr("interval 1 hour")).otherwise(F.col("ingested_at")))
    out = {r["day"]: r for r in rolling_totals(df.withColumn("day", F.lit(1)).withColumn("out", F.lit(2))).collect()}
    assert len(out) == 41
    first, ninth, last = out["2024-01-01"], out["2024-01-09"], out["2024-02-10"]
    assert (first["volume_sum_7d"], first["close_mean_7d"]) == (7.0, 20.0)  # the later of two rows
    assert (ninth["volume_sum_7d"], ninth["volume_sum_30d"], ninth["close_mean_30d"]) == (1.0, 8.0, 30.0)
    assert (last["volume_sum_30d"], last["volume_mean_30d"], last["close_mean_7d"]) == (0.0, None, None)
    assert rolling_totals(spark.createDataFrame([], CANDLES)).count() == 0


@pytest.mark.parametrize("chunk", [3, 8, 8192])
def test_grid_by_hand(spark, monkeypatch, chunk):
    monkeypatch.setattr(regular_grid, "CHUNK_SLOTS", chunk)
    rng = np.random.default_rng(chunk)
    minutes = sorted({round(float(x), 3) for x in rng.uniform(3, 100, 40)} - {round(float(x), 3) for x in range(40, 60)})
    minutes = [m for m in minutes if not 40 <= m < 60]
    rows = [(k, "a", m, 1.0, 1.0, 1.0, 100 + m, 1.0) for k, m in enumerate(minutes)] + [(900, "a", 50.0, 1.0, 1.0, 1.0, None, 1.0), (901, "a", None, 1.0, 1.0, 1.0, 1.0, 1.0), (902, "b", 5.0, 1.0, 1.0, 1.0, 1.0, 1.0), (903, "z", 5.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    windows = [("a", "A", "v", 60_000, at(0), at(80)), ("a", "A", "v", 60_000, at(70), at(110)), ("b", "B", "v", 60_000, at(0), at(10)), ("c", "C", "v", 60_000, at(0), at(20)), ("d", "D", "v", None, at(0), at(9))]
    out = regular_grid.regular_grid(candles(spark, rows).withColumn("step", F.lit(7)).withColumn("slot", F.lit("x")), spark.createDataFrame(windows, MANIFEST)).collect()
    base = int(T0.timestamp() * 1000)
    got = {(r["stream"], (r["slot_ms"] - base) // 60_000): r for r in out}
    assert len(got) == len(out) == 110 + 10 + 20
    seen = {int(m) for m in minutes}
    assert {k for (s, k), r in got.items() if s == "a" and r["status"] == "observed"} == seen
    for k in range(110):
        r = got[("a", k)]
        lo, hi = max((x for x in seen if x < k), default=None), min((x for x in seen if x > k), default=None)
        if k in seen:
            assert r["close"] == 100 + max(m for m in minutes if int(m) == k)
        elif lo is None or hi is None:
            assert r["status"] == ("before" if lo is None else "after") and r["close"] is None
        elif hi - lo - 1 > 5:
            assert r["status"] == "gap" and r["close"] is None
        else:
            a, b = (100 + max(m for m in minutes if int(m) == x) for x in (lo, hi))
            assert r["status"] == "interpolated" and r["close"] == pytest.approx(a + (b - a) * (k - lo) / (hi - lo))
    assert {r["status"] for (s, _), r in got.items() if s == "c"} == {"before"}
    assert regular_grid.regular_grid(spark.createDataFrame([], CANDLES), spark.createDataFrame([], MANIFEST)).count() == 0


def test_chunks_with_halo_equal_one_long_run(spark):
    rows = B.indexed(B.bars(candles(spark, walk(700) + walk(90, "b", 2, first=1000))), chunk=50)
    got = rows.toPandas().sort_values(["stream", "i"])
    assert (got.groupby("stream")["us"].apply(lambda x: x.is_monotonic_increasing)).all()
    assert got[got["stream"] == "a"]["i"].tolist() == list(range(700))
    parts = B.with_halo(rows, 20, 64, ahead=5)
    w = Window.partitionBy("stream", "part").orderBy("i")
    out = B.own(parts.withColumn("m", F.avg("close").over(w.rowsBetween(-15, 0))).withColumn("nx", F.lead("close", 3).over(w))).toPandas().sort_values(["stream", "i"])
    one = out[out["stream"] == "a"]
    assert np.allclose(one["m"], one["close"].rolling(16, min_periods=1).mean())
    assert np.allclose(one["nx"].dropna(), one["close"].shift(-3).dropna())


def test_running_sums_and_peaks_over_parts(spark):
    rows = B.with_halo(B.indexed(B.bars(candles(spark, walk(300)))), 1, 32).withColumn("x", F.col("close") - F.lag("close", 1, 100.0).over(B.order()))
    rows = rows.withColumn("x", F.round("x", 6))
    out = B.running(rows, {"s": F.col("x")}, {"top": "s"}).toPandas().sort_values("i")
    s = out["x"].cumsum()
    assert np.allclose(out["s"], s) and np.allclose(out["top"], np.maximum(s.cummax(), 0))


def test_recursions_forget_their_start():
    rng = np.random.default_rng(0)
    c = 100 + np.cumsum(rng.normal(0, 0.3, 4000))
    h, lo = c + 0.2, c - 0.2
    for f in (lambda a, b, x: I.wilder_rsi(x), I.wilder_atr, I.stochastic_diff, I.adx, lambda a, b, x: I.macd_diff(x / 100), lambda a, b, x: I.ema(x, 100)):
        whole, part = f(h, lo, c), f(h[1500:], lo[1500:], c[1500:])
        assert np.allclose(whole[-400:], part[-400:], rtol=0, atol=1e-9)


def test_indicator_values_by_definition():
    assert np.allclose(I.wilder_rsi(np.full(30, 5.0))[14:], 50) and np.allclose(I.wilder_rsi(np.arange(1.0, 40))[14:], 100)
    assert I.ema(np.array([1.0, 2, 3, 4]), 3).tolist() == [0, 0, 2, 3]
    assert I.wilder_atr(np.full(20, 3.0), np.full(20, 1.0), np.full(20, 2.0))[14:].tolist() == [2.0] * 6


def test_wick_repair_and_idempotence(spark):
    df = spark.createDataFrame([(3.0634, 3.0765, 0.0001, 2.4693), (1.0, 9.0, 0.9, 1.1), (None, 1.0, 0.1, 1.0)], "open double, high double, low double, close double")
    once = quality.repair(df)
    assert [(r["high"], r["low"], r["repaired"]) for r in once.collect()][:2] == [(3.0765, 2.4693, True), (1.1, 0.9, True)]
    assert quality.repair(once.drop("repaired")).where("repaired").count() == 0
    assert quality.find_implausible_wicks(df).count() == 2


def test_scalar_rules(spark):
    df = spark.createDataFrame([("1700000000",), ("1700000000123",), ("2024-01-01T00:00:00Z",), ("x",), ("NaN",)], "v string")
    got = [(r[0], r[1], r[2]) for r in df.select(quality.to_epoch_ms(F.col("v")), quality.timestamp_style(F.col("v")), quality.is_valid_number(F.col("v"))).collect()]
    assert got[:3] == [(1700000000000, "s", True), (1700000000123, "ms", True), (1704067200000, "iso", False)] and got[3][0] is None and got[4][2] is False
    one = spark.range(1).select(quality.truncate_to_decimals(F.lit(-1.239), 2), quality.price_decimals(F.lit(30_000.0)), quality.finite_or(F.lit(float("inf")), 7.0)).first()
    assert tuple(one) == (-1.23, 2, 7.0)


def test_cusum_events_and_bootstrap(spark):
    close = [100, 101, 102.1, 102.2, 101, 99.9, 99.9, 103.0]
    rows = spark.createDataFrame([("a", k, k, float(c)) for k, c in enumerate(close)], "stream string, i bigint, us bigint, close double")
    assert [r["i"] for r in cusum_events(rows, 0.02).orderBy("i").collect()] == [2, 5, 7]
    assert len(sequential_bootstrap([(0, 1), (1, 2), (5, 6)], 10)) == 10


def test_carry_is_a_backward_asof_join(spark):
    b = spark.createDataFrame([("a", k * 3_600_000_000) for k in range(200)], "stream string, us bigint")
    f = spark.createDataFrame([("a", T0.replace(year=1970) + timedelta(hours=h), r, None) for h, r in ((3, 0.08), (11, 0.16), (11, 0.16), (180, -0.8))], "stream string, ts timestamp, funding_rate double, mark_price double")
    out = {r["us"] // 3_600_000_000: r["carry"] for r in quality.carry_on_bars(b, f, F.lit(3_600_000_000)).collect()}
    assert out[2] == 0 and out[3] == 0.01 and out[10] == 0.01 and out[11] == 0.02 and out[179] == 0.02 and out[180] == pytest.approx(-0.1)


def test_dedupe_both_ways_and_merge(spark):
    df = candles(spark, [(1, "a", 0, 1.0, 2.0, 1.0, 1.5, 1.0), (2, "a", 0, 1.0, 2.0, 1.0, 1.7, 1.0)])
    rows = B.normalize_bars(df)
    assert B.dedupe_bars(rows).first()["close"] == 1.7 and B.dedupe_bars(rows, "first").first()["close"] == 1.5
    assert B.merge_bars(rows.where("row_id = 1"), rows.where("row_id = 2")).first()["close"] == 1.7
    assert isinstance(rows.toPandas(), pd.DataFrame)
