import math

import numpy as np
import pytest
from data import candles, walk
from pyspark.sql import functions as F

from tidewright import session
from tidewright.functions import stats
from tidewright.operators import backtest, bars, books, consensus, hashing, inference, labels, splits
from tidewright.operators.medians import exact_positions
from tidewright.plans import pooling
from tidewright.sources import exchanges


def test_sign_tail_and_schedule(spark):
    for n in (0, 1, 5, 40, 300):
        for wins in {0, n // 3, n // 2, n}:
            got = spark.range(1).select(pooling.sign_tail(F.lit(wins), F.lit(n))).first()[0]
            assert abs(got - stats.sign_test(wins, n)) < 1e-9, (wins, n)
    assert pooling.halving_schedule(9, 9) == [(1, 9, 3), (3, 3, 1)]
    assert pooling.halving_schedule(1, 9) == [] and pooling.halving_schedule(4, 1) == [(1, 4, 2)]


def test_a_fold_is_flat_at_its_first_bar(spark):
    rows = spark.createDataFrame([("s", i, True, 0, 0.01, 1.0 if i else 0.0, 1.0 if i == 1 else 0.0, 0.01 if i else 0.0) for i in range(6)], "stream string, i bigint, own boolean, part int, ret double, pos double, change double, gross double")
    got = {r["fold"]: r["net_pnl"] for r in backtest.fold_metrics(rows, 3, 10.0).collect()}
    assert got == {0: pytest.approx(2 * 0.01 - 0.001), 1: pytest.approx(2 * 0.01 - 0.001)}


def test_clusters_left_out_match_the_arrays(spark):
    rng = np.random.default_rng(2)
    nets = {(v, s, f): rng.normal(0.001 * k, 0.01, 100) for k, v in enumerate(pooling.VARIANTS) for s in "ab" for f in range(5)}
    sums = spark.createDataFrame([(v, s, f, 100, float(x.sum()), float((x * x).sum())) for (v, s, f), x in nets.items()], "variant string, stream string, fold bigint, n bigint, s double, ss double")
    groups = {v: [np.concatenate([nets[v, s, f] for s in "ab"]) for f in range(5)] for v in pooling.VARIANTS}
    year = math.sqrt(pooling.YEAR)
    for r in pooling.paired_promotion(sums).collect():
        t = inference.paired_cluster_test(groups[r["variant"]], groups[pooling.BASELINE])
        assert r["difference"] == pytest.approx(t["difference"] * year, abs=2e-5) and r["se"] == pytest.approx(t["se"] * year, abs=2e-5) and r["stable"] == pytest.approx(t["stable"]) and r["sign_p"] == pytest.approx(t["sign_p"], abs=1e-6)
    for r in pooling.pooled_report(sums).collect():
        sr, se = inference.cluster_jackknife(groups[r["variant"]])
        assert r["sharpe"] == pytest.approx(sr * year, abs=2e-5) and r["se_cluster"] == pytest.approx(se * year, abs=2e-5) and r["folds"] == 10
    one = pooling.variance_components(sums).first()
    assert one["total"] == pytest.approx(one["between"] + one["folds"] + one["residual"], abs=1e-4)
    assert pooling.pooled_report(sums.limit(0)).count() == 0


def test_order_statistics(spark):
    x = np.round(np.random.default_rng(4).random(500), 3)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 1.0)] * 7, "arm string, x double")
    ranks = spark.createDataFrame([("a", 0), ("a", 250), ("a", 499), ("b", 3)], "arm string, rank bigint")
    got = {(r["arm"], r["rank"]): r["x"] for r in pooling.order_statistics(df, ranks).collect()}
    assert got == {("a", 0): np.sort(x)[0], ("a", 250): np.sort(x)[250], ("a", 499): np.sort(x)[499], ("b", 3): 1.0}


def test_positions_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [("g" if k % 3 else None, float(np.round(rng.normal(0, 5), 2)) if k % 11 else None) for k in range(700)]
    got = {r["k"]: (r["lo"], r["hi"]) for r in exact_positions(spark.createDataFrame(rows, "k string, x double"), "k", F.col("x"), {"lo": "floor(0.05 * total)", "hi": "ceil(0.95 * total) - 1"}).collect()}
    for key in ("g", None):
        v = sorted(x for g, x in rows if g == key and x is not None)
        assert got[key] == (v[int(0.05 * len(v))], v[math.ceil(0.95 * len(v)) - 1])


@pytest.mark.parametrize("block", [2, 100])
def test_correlations_do_not_depend_on_blocks(spark, block):
    rng = np.random.default_rng(5)
    days = np.arange(700)
    series = {f"s{k}": {int(d): float(rng.normal()) for d in days if rng.random() < 0.8} for k in range(7)}
    df = spark.createDataFrame([(s, d, x) for s, v in series.items() for d, x in v.items()] + [("s0", 9999, None)], "stream string, day bigint, ret double")
    got = {(r["a"], r["b"]): (r["days"], r["corr"]) for r in inference.pair_correlations(df, 30, block).collect()}
    assert len(got) == 21
    for (a, b), (n, c) in got.items():
        both = sorted(series[a].keys() & series[b].keys())
        assert n == len(both) and c == pytest.approx(np.corrcoef([series[a][d] for d in both], [series[b][d] for d in both])[0, 1], abs=1e-6)


def test_exchange_pages_skip_what_is_short_or_broken(spark):
    rows = bars.indexed(bars.bars(candles(spark, walk(1200))))
    for name in exchanges.SOURCES:
        pages = exchanges.format_pages(rows, name)
        assert pages.count() == 3
        bad = pages.unionByName(spark.createDataFrame([("a", "{"), ("a", ""), ("a", "[]"), ("a", None), ("a", '[["x", "1", "1", "1", "1", "1", "1"]]')], "stream string, value string"))
        got = exchanges.parse_pages(bad, name)
        assert got.count() == 1200 and sorted(r["close"] for r in got.collect()) == sorted(r["close"] for r in rows.collect())


def test_consensus_by_hand(spark):
    s = [("k", 1, 0, 0, 0, "BUY", 0.9, 1.0, 10.0, 0.0, 0.0), ("k", 2, 0, 0, 1, "BUY", 0.5, 1.0, 20.0, 30.0, 0.0), ("k", 3, 0, 0, 0, "SELL", 0.5, 0.5, 100.0, 0.0, 0.0)]
    df = spark.createDataFrame(s, "key string, voter int, grp int, section int, layer int, direction string, prob double, score double, entry double, exit double, stop double")
    market = spark.createDataFrame([("k", 15.0, 0.1, 0.0)], "mk string, price double, atr double, volatility double")
    r = consensus.resolve(consensus.aggregate_layers(df), market).first()
    w1, w2, pos, neg = 0.9, 0.5, 0.9 * 0.9 + 0.5 * 0.5, 0.5 * 0.25
    entry = (10 * w1 + 20 * w2) / (w1 + w2)
    assert r["direction"] == "BUY" and r["confidence"] == pytest.approx(100 * pos / (pos + neg), abs=1e-3) and r["entry"] == pytest.approx(entry, abs=1e-4)
    assert r["exit"] == pytest.approx(30 * w2 / (w1 + w2), abs=1e-4) and r["stop"] == pytest.approx(entry * (1 - 2 * 0.1), abs=1e-4) and r["votes"] == 3


def test_written_tables_are_read_again_until_the_files_change(spark, tmp_path):
    path, built = str(tmp_path / "t"), []

    def build(df):
        built.append(1)
        return df.selectExpr("id * 2 as x")

    spark.range(5).write.parquet(path)
    a = session.written_once(spark.read.parquet(path), "t", build)
    b = session.written_once(spark.read.parquet(path), "t", build)
    assert len(built) == 1 and a.count() == b.count() == 5
    spark.range(7).write.mode("append").parquet(path)
    assert session.written_once(spark.read.parquet(path), "t", build).count() == 12 and len(built) == 2
    assert session.written_once(spark.range(3), "t", build).count() == 3 and len(built) == 3


def test_clean_book_caps_and_holds(spark):
    t = spark.createDataFrame([(k, "a", x) for k, x in enumerate((0.5, 0.09, 0.085, None, -0.4))] + [(0, "b", 0.01)], "t bigint, symbol string, target double")
    got = {(r["t"], r["symbol"]): r["weight"] for r in books.clean_book(t, 0.1, 0.02).collect()}
    assert got == {(0, "a"): 0.1, (1, "a"): 0.1, (2, "a"): 0.1, (3, "a"): 0.0, (4, "a"): -0.1, (0, "b"): 0.01}


def test_covariance_and_flips(spark):
    x = np.random.default_rng(1).normal(0, 1, (300, 4))
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())] + [(900, [1.0]), (901, None), (902, [None, 1.0, 1.0, 1.0])], "id bigint, v array<double>").repartition(3)
    assert np.allclose(hashing.covariance(df, "v", 4), np.cov(x, rowvar=False, bias=True))
    m = [30.0, -400.0, 90.0, -1.0]
    r = hashing.flips(spark.createDataFrame([(1, 0, m)], "id bigint, table int, margins array<double>"), 100.0).first()
    q = [1 - stats.normal_cdf_value(abs(v) / 100) for v in m]
    assert r["expected"] == pytest.approx(sum(q)) and r["none"] == pytest.approx(math.prod(1 - v for v in q)) and r["depth"] == hashing.containment_depth(m, q)


def test_sample_weights_and_folds(spark):
    rows = spark.createDataFrame([("s", k, 0.5, float(k)) for k in range(10)] + [("z", 0, 1.0, None), ("z", 1, 1.0, 0.0)], "stream string, id bigint, uniqueness double, gain double")
    got = {(r["stream"], r["id"]): r["weight"] for r in labels.sample_weights(rows).collect()}
    raw = np.clip(np.arange(10) / 4.5, 0.1, 5)
    assert [got["s", k] for k in range(10)] == pytest.approx((raw / raw.mean()).tolist()) and got["z", 0] == got["z", 1] == 1.0
    sizes = spark.createDataFrame([("a", 23), ("b", 4)], "stream string, n bigint")
    table = {r["fold"]: r for r in splits.combinatorial_table(sizes, 6, 2, 3, 4).collect()}
    plain = splits.combinatorial_purged(23, 6, 2, 3, 4)
    assert len(table) == 15 == len(plain)
    for f in plain:
        r = table[f.fold]
        assert (r["purge_lo"], r["purge_hi"], r["embargo_hi"]) == (*f.purge, f.embargo_end)
        tested = {i for lo, hi in f.test for i in range(lo, hi + 1)}
        assert r["n_test"] == len(tested)
        assert r["n_train"] == sum(i not in tested and not (i <= f.embargo_end and i + 3 >= f.purge[0]) for i in range(23))


def test_market_context(spark):
    rows = [("k", h, 10.0 + h, 9.0 + h, 9.5 + h) for h in range(20)] + [("z", 0, 0.0, 0.0, 0.0)]
    got = {r["mk"]: r for r in consensus.market_context(spark.createDataFrame(rows, "key string, at int, high double, low double, close double")).collect()}
    assert got["k"]["price"] == 28.5 and got["k"]["atr"] == pytest.approx(1.5) and (got["z"]["price"], got["z"]["atr"]) == (1.0, 0.01)
