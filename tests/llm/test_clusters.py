import numpy as np
import pytest

from tidewright.llm import clusters as C

SCHEMA = "proto_id string, compat_id int, mean array<double>, variance array<double>, merged_count int"


def table(seed=1, n=260):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for compat in (1, 2, 3, None):
        d = 6 if compat != 2 else 9
        while k < n:
            centre, scale = rng.normal(0, 4, d), np.exp(rng.normal(-1, 0.8))
            for _ in range(int(rng.integers(1, 9))):
                m, v = centre + rng.normal(0, 0.6, d), scale * np.exp(rng.normal(0, 0.25, d))
                rows.append((f"p{len(rows)}", compat, m.tolist(), v.tolist(), 1))
                k += 1
        k = 0
    rows += [(f"s{j}", *rows[j][1:]) for j in range(0, 60, 3)] + rows[:40]
    rows += [("n1", 1, [1.0] * 6, None, 1), ("n2", 1, None, [1.0] * 6, 1), (None, 1, [1.0] * 6, [1.0] * 6, 1), ("n3", 1, [1.0] * 5, [1.0] * 6, 1), ("n4", 1, [None] + [1.0] * 5, [1.0] * 6, 1), ("n5", 1, [float("nan")] + [1.0] * 5, [1.0] * 6, 1), ("n6", 1, [], [], 1)]
    return rows


def by_hand(rows, near=1.5):
    good = {}
    for p, c, m, v, _ in rows:
        if p and m and v and len(m) == len(v) and None not in m and None not in v:
            good[p] = (c, np.array(m), np.array(v))
    ids = sorted(good)
    a, b = [], []
    for i, x in enumerate(ids):
        for j in range(i + 1, len(ids)):
            y = good[ids[j]]
            if good[x][0] == y[0] and len(good[x][1]) == len(y[1]) and C.distances(good[x][1][None], good[x][2][None], y[1][None], y[2][None])[0] < near:
                a.append(i)
                b.append(j)
    root = C._roots(len(ids), np.array(a, int), np.array(b, int))
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(int(r), set()).add(ids[i])
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("spec", [C.ClusterSpec(), C.ClusterSpec(task_rows=60, leaf=16, partners=2, rounds=3), C.ClusterSpec(rounds=1)])
def test_clusters_are_the_chains_of_alike_records(spark, spec):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as band", "3 as root", "4 as part")
    got = {}
    for r in C.clustered(df, spec).collect():
        assert r["proto_id"] not in got.setdefault(r["root"], set())
        got[r["root"]].add(r["proto_id"])
    assert {frozenset(g) for g in got.values()} == by_hand(rows)


def test_flow_matches_dense_matrices(spark):
    rng = np.random.default_rng(3)
    edges = [(a, b, float(rng.uniform(0.2, 1))) for g in range(4) for a in range(g * 5, g * 5 + 5) for b in range(a + 1, g * 5 + 5)] + [(0, 5, 0.05)]
    spec = C.ClusterSpec(rounds=4, partners=50, prune=0.0)
    got = np.zeros((20, 20))
    for r in C.flow(spark.createDataFrame(edges, "a bigint, b bigint, weight double"), spec).collect():
        got[r["row"], r["col"]] = r["p"]
    m = np.zeros((20, 20))
    for a, b, w in edges:
        m[a, b] = m[b, a] = w
    m[np.arange(20), np.arange(20)] = m.max(0)
    m /= m.sum(0)
    for _ in range(4):
        m = (m @ m) ** 2
        m /= m.sum(0)
    assert np.allclose(got, m, atol=1e-6)


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(200)] + [(k, k + 2) for k in range(1000, 1100)] + [(5, 5)]
    out = {r["node"]: r["root"] for r in C.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert len(out) == 201 + 102 and {out[k] for k in range(201)} == {0} and {out[1001], out[1099]} == {1001} and out[1100] == 1000


def test_empty(spark):
    assert C.clustered(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([("a", 1, [1.0], [1.0], 1)], SCHEMA)
    assert C.clustered(one).count() == 1


def test_a_dense_group_of_twenty_thousand(spark):
    rng = np.random.default_rng(8)
    d, n = 16, 20_000
    rows = [(f"d{k:05d}", 1, m, [1.0] * d, 1) for k, m in enumerate(rng.normal(0, 0.3, (n, d)).tolist())]
    rows += [(f"e{k}", 1, [50.0 + k * 0.5] + [0.0] * (d - 1), [1.0] * d, 1) for k in range(6)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    sizes = C.clustered(df).groupBy("root").count().collect()
    assert sorted(r["count"] for r in sizes) == [6, n]


def test_dense_places_keep_every_chain():
    rng = np.random.default_rng(4)
    d, n = 8, 1500
    m = rng.normal(0, 1.1, (n, d))
    v = np.exp(rng.normal(0, 0.15, (n, d)))
    a, b, _ = C._within(m, v, np.arange(n), 1.5)
    want = C._roots(n, a, b)
    assert 1 < len(set(want.tolist())) < n
    band = rng.integers(0, 2, n)
    i, j, dist, root = C._alike(m, v, band, 1, C.ClusterSpec(leaf=64, dense=128))
    assert (root == want).all() and (dist < 1.5).all() and ((band[i] == 1) | (band[j] == 1)).all()


def test_inflation_decides_the_markov_clusters(spark):
    # two dense balls and a thin bridge: one chain, and with more inflation two Markov clusters
    rows = [(f"a{k}", 1, [0.1 * k, 0.0], [1.0, 1.0], 2) for k in range(6)] + [(f"b{k}", 1, [6.0 + 0.1 * k, 0.0], [1.0, 1.0], 1) for k in range(6)] + [("c", 1, [3.25, 0.0], [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    by = {}
    for inflation in (1.1, 2.0):
        out = C.clustered(df, C.ClusterSpec(inflation=inflation, rounds=20))
        assert C.described(out, df, "root").count() == 1
        by[inflation] = {r["cluster_key"]: r.asDict() for r in C.described(out, df, "attractor").collect()}
    assert len(by[1.1]) < len(by[2.0])
    assert by[2.0]["a0"]["records"] >= 6 and sum(r["merged_count"] for r in by[2.0].values()) == 19 and by[2.0]["a0"]["typical_1"][0] == "a"


def markov_by_hand(rows, near=1.5, rounds=12, prune=1e-3):
    """Limit of the flow over every alike pair, component by component: {proto_id: (attractor's members, strength)}."""
    good = {p: (c, np.array(m), np.array(v)) for p, c, m, v, _ in rows}
    ids = sorted(good)
    n = len(ids)
    w = np.zeros((n, n))
    for i in range(n):
        for j in range(i + 1, n):
            (c1, m1, v1), (c2, m2, v2) = good[ids[i]], good[ids[j]]
            if c1 == c2 and (d := C.distances(m1[None], v1[None], m2[None], v2[None])[0]) < near:
                w[i, j] = w[j, i] = np.exp(-d)
    strength, links = {}, {p: int((w[i] > 0).sum()) for i, p in enumerate(ids)}
    a, b = np.nonzero(np.triu(w))
    root = C._roots(n, a, b)
    for r in set(root.tolist()):
        at = np.flatnonzero(root == r)
        m = w[np.ix_(at, at)]
        if len(at) > 1:
            m[np.arange(len(at)), np.arange(len(at))] = m.max(0)
            m /= m.sum(0)
            for _ in range(rounds):
                m = (m @ m) ** 2
                m[m < prune * m.max(0)] = 0
                m /= m.sum(0)
                if (m.max(0) - (m * m).sum(0)).max() <= 1e-3:
                    break
        strength |= {ids[k]: s for k, s in zip(at, m.sum(1), strict=True)}
    return strength, links


def dense_rows(seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for g, (n, spread) in enumerate([(40, 0.25), (30, 0.6), (3, 0.1), (1, 0.1), (25, 0.4)]):
        for m in rng.normal(0, spread, (n, 4)) + 9.0 * g:
            rows.append((f"g{g}-{len(rows)}", 1 + g % 2, m.tolist(), np.exp(rng.normal(0, 0.05, 4)).tolist(), 1))
    return rows


@pytest.mark.parametrize("dense_nodes", [3072, 3])
def test_every_link_enters_the_flow_of_the_markov_clusters(spark, dense_nodes):
    rows = dense_rows()
    strength, links = markov_by_hand(rows)
    assert max(links.values()) > 30
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["proto_id"]: r for r in C.clustered(df, C.ClusterSpec(partners=None, dense_nodes=dense_nodes, leaf=16)).collect()}
    assert len(got) == len(rows)
    for p, r in got.items():
        assert r["strength"] == pytest.approx(strength[p] if links[p] else 0.0, rel=1e-6, abs=1e-2)


def test_p4_markov_and_p4_clusters_follow_every_link(spark, tmp_path):
    rows = dense_rows()
    strength, links = markov_by_hand(rows)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/volatile_positive.parquet")
    for run in (C.p4_clusters, C.p4_markov):
        out = run(spark, str(tmp_path)).collect()
        assert sum(r["records"] for r in out) == len(rows)
        for r in out:
            if links[r["cluster_key"]]:
                of = max((strength[p] for p in strength if p.startswith(r["cluster_key"][:3])))
                assert run is C.p4_markov or strength[r["typical_1"]] == pytest.approx(of, rel=1e-3)


def test_pairs_are_every_alike_pair_once(spark):
    rng = np.random.default_rng(6)
    rows = [(f"p{k}", 1 + k % 2, m, v, 1) for k, (m, v) in enumerate(zip(rng.normal(0, 1.2, (900, 5)).tolist(), np.exp(rng.normal(0, 0.2, (900, 5))).tolist(), strict=True))]
    classes, members = C.records(spark.createDataFrame(rows, SCHEMA))
    name = {r["id"]: int(r["proto_id"][1:]) for r in members.collect()}
    want = {}
    for c in (0, 1):
        i = np.arange(c, 900, 2)
        m, v = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        a, b, d = C._exact(m, v, *(i[k] for k in np.triu_indices(len(i), 1)), 1.5)
        want |= {(x, y): z for x, y, z in zip(a.tolist(), b.tolist(), d.tolist(), strict=True)}
    for spec in (C.WHOLE, C.ClusterSpec(partners=None, leaf=16, dense=32), C.ClusterSpec(partners=None, leaf=16, task_rows=80, fit_rows=200)):
        graph = C.pairs(classes, spec).collect()
        assert len({(r["a"], r["b"]) for r in graph}) == len(graph)
        got = {tuple(sorted((name[r["a"]], name[r["b"]]))): r["distance"] for r in graph if r["distance"] is not None}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        star = [(name[r["a"]], name[r["b"]]) for r in graph if r["star"]]
        for edges in (star, list(want)):
            e = np.array(edges)
            roots = C._roots(900, e[:, 0], e[:, 1])
            assert edges is not star or len(star) < 4 * 900 or spec.task_rows < 900
            first = roots if edges is star else first
            assert (roots == first).all()


def test_leaves_give_each_pair_once():
    rng = np.random.default_rng(7)
    m, v = rng.normal(0, 2.0, (1200, 3)), np.ones((1200, 3))
    spec = C.ClusterSpec(partners=None, leaf=32)
    a, b = (np.concatenate(c) for c in list(zip(*(t for i, seen in C._leaves(m, v, spec) for t in C._tiles(m, v, i, spec.near, seen)), strict=True))[:2])
    x, y, _ = C._within(m, v, np.arange(1200), spec.near)
    assert len(a) == len(x) and set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(x.tolist(), y.tolist(), strict=True))


def test_pairs_far_from_the_origin_are_found():
    rng = np.random.default_rng(9)
    m, v = rng.normal(0, 1.0, (300, 4)), np.ones((300, 4))
    far = m * 1e-3 + 1e6
    want = C._exact(far, v * 1e-6, *np.triu_indices(300, 1), 1.5)
    a, b, _ = C._within(far, v * 1e-6, np.arange(300), 1.5)
    assert len(want[0]) and set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(want[0].tolist(), want[1].tolist(), strict=True))
