import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import memory as M
from tidewright.operators import sleeves as S


def test_gates_and_scores(spark):
    one = spark.range(1).select(M.surprise_gate(F.lit(1.0)), M.surprise_gate(F.lit(0.0)), M.clamp01(F.lit(float("nan"))), M.reinforced(F.lit(2.0), 1.0, 0.5)).first()
    assert tuple(one) == (0.1, 1.0, 0.0, 2.0)
    rows = spark.createDataFrame([("k", i, float(i % 4)) for i in range(10)], "k string, t int, s double")
    scored = rows.withColumn("x", F.col("s") * 100 - F.col("t"))
    assert sorted(r["t"] for r in M.keep_best(scored, "k", "t", "x", "t", 2, 2).collect()) == [3, 7, 8, 9]
    dup = spark.createDataFrame([("h", "b", 1.0), ("h", "a", 1.0), ("g", "c", None)], "hash string, proto_id string, s double")
    assert sorted(r["proto_id"] for r in M.deduped_by_hash(dup, "hash", "s").collect()) == ["a", "c"]


def test_pools_and_queries():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 0.1, (50, 3)), rng.normal(9, 0.1, (50, 3))])
    means, counts = M.pooled(x, 4, 0.5)
    assert 2 <= len(means) <= 4 and counts.sum() >= 100
    q = M.moved_query(np.array([1.0, 0.0]), np.array([[1.0, 1.0], [1.0, 1.2], [-1.0, 0.0]]), 0.5, 2)
    assert q[1] > 0.3 and np.linalg.norm(q) == pytest.approx(1)
    assert M.generative_replay(means, np.ones_like(means), 7).shape == (7, 3)


def test_ensemble_and_small_statistics():
    w = M.trust_weights(np.array([[0.5] * 6, [0.9] * 6, [0.1] * 6]))
    assert w.sum() == pytest.approx(1) and w[1] > w[0] > w[2]
    assert M.homeostatic_scale(0.5) == 1 and M.homeostatic_scale(9) == 0.5
    assert M.deviation_from_median(np.array([1.0, 2, 3])) == pytest.approx(2 / 3) and M.percentile_at(np.zeros(3), 0.5) == 1.0
    assert M.conformity(np.arange(5.0)) == 1 and M.sudden_drop(np.ones(3), 0.5) == 3.0 and M.stagnating(np.ones(8))
    m = np.random.default_rng(2).normal(size=(6, 4))
    assert M.spectral_norm(m, 500) == pytest.approx(np.linalg.norm(m, 2), rel=1e-6) and np.linalg.norm(M.clip_by_norm(m)) == pytest.approx(1)


def test_sleeve_evidence():
    assert S.drawdown_governor(np.array([0.1, -0.5, 0.2]), 0.5).tolist() == [1.0, 1.0, 0.0]
    assert S.adaptive_targets(np.array([1.0, 0.0, 3.0])).tolist() == [1.0, 1.0, 2.0]
    rng = np.random.default_rng(3)
    good, flat = rng.normal(0.3, 1, 600), rng.normal(0, 1, 600)
    assert S.deflated_block_sharpe(good) > 0.9 > S.deflated_block_sharpe(flat) and S.jackknife_inflation(flat) >= 1
    assert S.halves(np.concatenate([good[:300], -good[300:]]))["differ"] and S.gates({"a": 1.0}, {"a": 0.5})["pass"] and not S.gates({}, {"a": 0.5})["pass"]
    assert S.clipped_median_schedule(np.array([10.0, 20.0, 1000.0]), 2, 0.5).tolist() == [5.0, 10.0, 500.0]
