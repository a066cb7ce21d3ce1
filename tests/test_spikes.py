import numpy as np
import pytest
from data import CANDLES, candles, walk

from tidewright.operators import spikes
from tidewright.operators.medians import exact_medians
from tidewright.operators.spikes import SpikeRules, implausible_readings, stuck_readings
from pyspark.sql import functions as F


def stuck_by_hand(rows, least=5):
    """rows: (row_id, stream, us, open, high, low, volume); every row on its own, no chunks."""
    out = set()
    for s in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == s and r[2] is not None and r[2] >= spikes.FIRST_US]
        stamps = sorted({r[2] for r in mine})
        place = {t: k for k, t in enumerate(stamps)}
        for f, name in enumerate(spikes.STUCK_FIELDS):
            by = {}
            for r in mine:
                v = r[3 + f]
                if v is not None and r[6] != 0:
                    by.setdefault(v, set()).add(place[r[2]])
            for v, bars in by.items():
                run = []
                for b in [*sorted(bars), None]:
                    if run and (b is None or b != run[-1] + 1):
                        if len(run) >= least:
                            out |= {(r[0], name) for r in mine if r[3 + f] == v and place[r[2]] in run}
                        run = []
                    if b is not None:
                        run.append(b)
    return out


@pytest.mark.parametrize("chunk", [3, 7, 10_000])
def test_stuck_runs_do_not_depend_on_chunks(spark, chunk):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(240):
        us = spikes.FIRST_US + int(k // 1.1) * 60_000_000 + (10**12 if k > 150 else 0)
        vals = [float(rng.integers(1, 3)) if rng.random() < 0.95 else None for _ in range(3)] + [float(rng.integers(0, 2))]
        rows.append((k, "s" if k % 5 else "t", us if rng.random() < 0.97 else None, *vals))
    df = spark.createDataFrame(rows, "row_id bigint, stream string, us bigint, open double, high double, low double, volume double")
    got = {(r["row_id"], r["field"]) for r in stuck_readings(df, SpikeRules(chunk_bars=chunk)).collect()}
    assert got == stuck_by_hand(rows)


def test_every_rule_fires_and_nulls_do_not(spark):
    rows = walk(300)
    rows[50] = (50, "a", 50.0, *rows[50][3:4], rows[50][4] * 3, *rows[50][5:])  # high far above
    rows[60] = (*rows[60][:5], -1.0, *rows[60][6:])  # low not positive
    rows[70] = (*rows[70][:7], 1e6)  # volume
    rows[80] = (80, "a", 80.0, None, None, None, None, None)
    for k in range(100, 105):
        rows[k] = (*rows[k][:7], 33.25)
    found = implausible_readings(candles(spark, rows)).collect()
    kinds = {(r["row_id"], r["field"], r["kind"]) for r in found}
    assert (50, "high", "spike") in kinds and (60, "bar", "impossible") in kinds and (70, "volume", "spike") in kinds
    assert {(k, "volume", "stuck") for k in range(100, 105)} <= kinds
    assert not any(r["row_id"] == 80 for r in found)


def test_fitted_cutoffs_decide_below_the_ceiling(spark):
    rows = walk(2000, levels=None)
    spread = float(np.median([r[4] - r[5] for r in rows]))
    for k in (300, 900, 1500):  # a wick of nine medians: under the ceiling of twelve
        o, c = rows[k][3], rows[k][6]
        rows[k] = (*rows[k][:4], max(o, c) + 9 * spread, *rows[k][5:])
    df = candles(spark, rows)
    by_risk = {risk: {(r["row_id"], r["field"]) for r in implausible_readings(df, SpikeRules(risk=risk)).collect() if r["kind"] == "spike"} for risk in (1e-2, 1e-4, 1e-30)}
    assert {(300, "high"), (900, "high"), (1500, "high")} <= by_risk[1e-4] < by_risk[1e-2]
    assert not {(300, "high"), (900, "high"), (1500, "high")} & by_risk[1e-30]
    assert len(by_risk[1e-4]) < 10


def test_a_stretch_of_zero_volume_is_quiet_in_every_field(spark):
    rows = walk(60)
    for k in range(20, 27):  # quiet: the price stands still, nothing is traded
        rows[k] = (*rows[k][:3], 100.0, 100.0, 100.0, 100.0, 0.0)
    for k in range(40, 47):  # stuck: the price stands still under trade
        rows[k] = (*rows[k][:3], 100.0, 100.0, 100.0, 100.0, 10.0 + k)
    stuck = {(r["row_id"], r["field"]) for r in implausible_readings(candles(spark, rows)).collect() if r["kind"] == "stuck"}
    assert stuck == {(k, c) for k in range(40, 47) for c in ("open", "high", "low")}


def test_zero_volume_is_quiet_and_empty_is_empty(spark):
    rows = [(*r[:7], 0.0) for r in walk(40)]
    assert not [r for r in implausible_readings(candles(spark, rows)).collect() if r["kind"] == "stuck"]
    assert implausible_readings(spark.createDataFrame([], CANDLES)).count() == 0


def test_clashing_names_null_source_and_repeats(spark):
    rows = walk(60) + [(r[0] + 100, None, *r[2:]) for r in walk(60, seed=2)] + walk(60)
    df = candles(spark, rows)
    for c in ("k", "m", "n", "x", "s", "h", "us", "chunk", "bar", "field", "value", "width", "z_high", "cs"):
        df = df.withColumn(c, F.lit("clash"))
    plain = implausible_readings(candles(spark, rows)).orderBy("row_id", "field", "kind").collect()
    assert implausible_readings(df).orderBy("row_id", "field", "kind").collect() == plain


def test_medians_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(f"g{k % 7}", float(np.round(rng.normal(0, 10.0 ** (k % 7 - 3)), 4)) if k % 11 else None) for k in range(2000)] + [("none", None), (None, 1.0), (None, 2.0), ("one", -3.5)]
    df = spark.createDataFrame(rows, "k string, x double")
    for upper in (False, True):
        got = {r["k"]: r["med"] for r in exact_medians(df, "k", {"med": F.col("x")}, upper=upper).collect()}
        for key in {r[0] for r in rows}:
            v = sorted(x for g, x in rows if g == key and x is not None)
            if v:
                assert got[key] == (v[len(v) // 2] if upper else np.median(v)), key


