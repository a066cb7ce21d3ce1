import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import stats
from tidewright.operators import books, hashing, inference, learners, splits, vault
from tidewright.operators.features import fractional_diff_weights
from tidewright.plans.evaluate import held_positions


def test_distribution_values(spark):
    assert stats.normal_inv_cdf(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert stats.normal_cdf_value(stats.normal_inv_cdf(0.2)) == pytest.approx(0.2, abs=1e-6)
    assert stats.student_t_critical(10, 0.05, True) == pytest.approx(2.228139, abs=1e-5)
    assert stats.regularized_incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-10)
    assert stats.sign_test(5, 5) == 1 / 32 == stats.sign_test_floor(5)
    assert spark.range(1).select(stats.normal_cdf(F.lit(1.0))).first()[0] == pytest.approx(0.841345, abs=1e-6)


def test_fractional_weights():
    assert fractional_diff_weights(1.0, 4) == [1, -1, 0, 0]


def test_folds():
    cp = splits.combinatorial_purged(60, 6, 2)
    assert len(cp) == math.comb(6, 2)
    times = np.zeros(60, int)
    for f in cp:
        for a, b in f.test:
            times[a : b + 1] += 1
    assert (times == math.comb(5, 1)).all()
    assert [f.test[0][0] for f in splits.walk_forward(10, 4, 2)] == [4, 6, 8]
    assert all(splits.is_causal(f) for f in splits.walk_forward(50, 10, 5))
    for f in splits.purged_k_fold(53, 5, embargo=2, span=4):
        assert not splits.leaks(f, 4)
    with pytest.raises(ValueError):
        splits.combinatorial_purged(100, 60, 30)
    assert [b - a + 1 for a, b in splits.blocks(11, 4)] == [3, 3, 3, 2]


def test_generator_and_blocks():
    draw = inference.mulberry32(1)
    x = [draw() for _ in range(2000)]
    assert all(0 <= v < 1 for v in x) and abs(np.mean(x) - 0.5) < 0.03 and x[0] != x[1]
    path = inference.stationary_indices(500, 10, np.random.default_rng(1))
    assert ((np.diff(path) == 1) | (np.diff(path) == -499)).mean() > 0.8
    rng = np.random.default_rng(2)
    ar = np.zeros(2000)
    for t in range(1, 2000):
        ar[t] = 0.8 * ar[t - 1] + rng.normal()
    assert inference.politis_white(ar) > inference.politis_white(rng.normal(size=2000))


def test_reality_checks_tell_edge_from_noise(spark):
    rng = np.random.default_rng(4)
    noise = rng.normal(0, 1, (400, 5))
    edge = noise.copy()
    edge[:, 2] += 0.4
    b0, b1 = inference.replicates(spark, noise, 200, 1.0), inference.replicates(spark, edge, 200, 1.0)
    assert np.array_equal(b0, inference.replicates(spark, noise, 200, 1.0, slices=3))  # slicing does not matter
    assert inference.white_reality_check(edge, b1) < 0.05 < inference.white_reality_check(noise, b0)
    assert inference.hansen_spa(edge, b1, True) < 0.05 and inference.step_m(edge, b1) == [2] and inference.step_m(noise, b0) == []
    t, tb = inference.subsample_statistics(edge, 60, 3)
    assert inference.step_down(t, tb) == [2] and inference.subsampling_spa(edge, 60) < 0.05
    assert inference.overfitting_probability(edge)["pbo"] < 0.2 < inference.overfitting_probability(noise)["pbo"]
    assert 2 in inference.model_confidence_set(-edge) and inference.diebold_mariano(-edge[:, 2], -edge[:, 0])["p"] < 0.05


def test_subsampling_of_long_panels(spark, monkeypatch):
    rng = np.random.default_rng(8)
    panel = rng.normal(0, 1, (3200, 5))
    panel[:, 2] += 0.2
    panel[1000:2100, 4] = 0.0
    t, tb = inference.subsample_statistics(panel, 800, 3)
    for s in (0, 1100, 2400):
        w = panel[s : s + 800]
        e = np.array([inference.newey_west(w[:, j], 3) for j in range(5)])
        want = np.where(e > 0, (w.mean(0) - panel.mean(0)) / np.sqrt(0.75) / np.where(e > 0, e, 1), 0.0)
        assert np.allclose(tb[s], want, rtol=1e-9, atol=1e-12)
    t2, tb2 = inference.subsample_statistics(panel, 800, 3, spark, slices=5)
    assert np.array_equal(t, t2) and np.array_equal(tb, tb2) and len(tb) == 2401
    monkeypatch.setattr(inference, "table", lambda *a: None)
    monkeypatch.setattr(inference, "strategy_panel", lambda c: None)
    monkeypatch.setattr(inference, "_matrix", lambda p: panel)
    out = dict(map(tuple, inference.q_reality_check(spark, "").collect()))
    assert out["subsampling_spa"] < 0.05 and out["subsampling_kfwer"] >= 1 and out["subsampling_fdp"] >= 1


def test_clusters():
    rng = np.random.default_rng(5)
    a = [rng.normal(0.5, 1, 30) for _ in range(12)]
    b = [x - 0.4 for x in a]
    r = inference.paired_cluster_test(a, b)
    assert r["p"] < 0.01 and r["stable"] == 1.0
    full, se = inference.cluster_jackknife(a)
    assert full > 0 and se > 0
    panel = rng.normal(size=(100, 3)) + rng.normal(size=(100, 1)) * 3
    assert abs(np.corrcoef(inference.factor_neutral(panel[:, 0], panel), panel @ inference.first_pc(panel))[0, 1]) < 0.05


def test_learners_learn():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] + 0.3 * rng.normal(size=600) > 0).astype(float)
    scores = {n: ((c.create().fit(x[:400], y[:400]).predict(x[400:]) - y[400:]) ** 2).mean() for n, c in learners.LEARNERS.items()}
    assert all(scores[n] < scores["base_rate"] for n in ("ridge", "mlp", "attention"))
    assert learners.successive_halving([1, 5, 3, 4], lambda a, b: a, 9) == [5]
    f = lambda v: float(((v - 1) ** 2).sum())
    v = np.zeros(6)
    for _ in range(60):
        v = learners.low_rank_es_step(f, v, rng)
    assert f(v) < 1
    assert np.allclose(np.linalg.norm(learners.rotate(x), axis=1), np.linalg.norm(x, axis=1))


def test_policies_and_paths():
    assert books.policy_path(np.array([1.0, 1.0, 0.0]), "ewma", 0.5).tolist() == [0.5, 0.75, 0.375]
    assert books.policy_path(np.array([1.0, 1.01, 2.0]), "band", 0.1).tolist() == [1.0, 1.0, 2.0]
    assert books.policy_path(np.array([1.0, 2.0, 3.0]), "hold", 2).tolist() == [1.0, 1.0, 3.0]
    assert held_positions(np.array([0.6, 0.1, 0.1, 0.1, -0.9]), 0.5, 0.2, 2).tolist() == [1.0, 1.0, 0.0, 0.0, -1.0]


def test_hashing_rules(spark):
    assert hashing.perturbations([0.5, -0.1, 0.3], 2, 4) == [(1,), (2,), (1, 2), (0,)]
    assert hashing.poisson_binomial([0.5, 0.5]).tolist() == [0.25, 0.5, 0.25]
    assert hashing.flip_probability(1, 0) == 0 and hashing.bit_information(1, 0) == 1
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0])], "a array<double>, b array<double>")
    assert df.select(hashing.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(1)
    x = np.random.default_rng(7).normal(size=(500, 3)) * np.array([5, 1, 0.1])
    e = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    assert np.allclose(hashing.covariance(e, "v", 3), np.cov(x, rowvar=False, bias=True))
    assert hashing.aligned_planes(np.diag([4.0, 2.0, 1.0]), 2, 2).shape == (2, 2, 3)


@pytest.mark.parametrize("spread", [None, 0.5, 0.15])
def test_bucket_neighbours_recall(spark, spread):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 64))
    if spread is not None:
        x = rng.normal(size=(60, 64))[np.arange(1500) % 60] + spread * x
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in hashing.nearest_by_buckets(df).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["id"]
    assert sorted(got) == list(range(0, 1500, 100)) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    want = {q: [i for i in np.argsort(-(u @ u[q]), kind="stable") if i != q][:5] for q in got}
    assert sum(len(set(want[q]) & set(got[q].values())) for q in got) >= 0.9 * 5 * len(got)


def test_vault_rules(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.5, 0.5], [1.0, 2.0], [0.5, 0.5]), ([1.0], [1.0], [1.0, 2.0], [1.0, 1.0])], "a array<double>, p array<double>, b array<double>, q array<double>")
    d = [r[0] for r in df.select(vault.gaussian_distance(*[F.col(c) for c in "apbq"])).collect()]
    assert d == [0.0, None]
    ranked = vault.globally_ranked(spark.range(1000).withColumn("x", F.col("id") * 37 % 1000), [F.col("x")])
    assert ranked.where("rank <> x + 1").count() == 0
    old = spark.createDataFrame([("a", 1), ("b", 2)], "proto_id string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "proto_id string, v int")
    assert sorted(map(tuple, vault.upsert(old, new).collect())) == [("a", 1), ("b", 9), ("c", 3)]
    assert sorted(map(tuple, vault.insert_ignore(old, new, "proto_id").collect())) == [("a", 1), ("b", 2), ("c", 3)]
    edges = spark.createDataFrame([("v", "p", "a", "b", 1.0), ("v", "p", "b", "c", 1.0), ("v", "p", "a", "c", 5.0), ("v", "p", "c", "d", 1.0)], "source string, polarity string, parent_proto string, child_proto string, accum_distance double")
    r = {x["proto_id"]: x["distance"] for x in vault.reachable(edges, spark.createDataFrame([("a",)], "seed string"), 2).collect()}
    assert r == {"a": 0.0, "b": 1.0, "c": 2.0, "d": 6.0}
