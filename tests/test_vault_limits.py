import numpy as np

from tidewright.operators import vault

SCHEMA = "proto_id string, compat_id int, mean array<double>, variance array<double>, size double, access_count double, importance double, last_accessed int, usage_count int, merged_count int"


def bank(spark, n):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(f"p{i:04d}", 1, (rng.normal(size=4) * 50).tolist(), [0.01] * 4, 1.0 + i, 1.0, float(n - i), 3990, 1, 1) for i in range(n)], SCHEMA)


def test_merging_keeps_all_that_it_does_not_take_in(spark):
    protos = bank(spark, 1100)
    twin = protos.where("proto_id in ('p0900', 'p1050')").selectExpr("concat('t', proto_id) proto_id", *[c for c in protos.columns if c != "proto_id"])
    out = {r["proto_id"]: r for r in vault.merged(protos.unionByName(twin)).collect()}
    assert len(out) == 1101 and "tp0900" not in out  # one of the top 1000 taken in, all others there
    assert out["p0900"]["changed"] and out["p0900"]["merged_count"] == 2
    for i in ("p1050", "tp1050"):  # beyond the limit: as stored, not even decayed
        assert not out[i]["changed"] and out[i]["merged_count"] == 1 and out[i]["size"] == 1051.0


def test_hierarchy_takes_250_with_4_to_16_neighbours(spark):
    protos = bank(spark, 300)
    rows = {r["proto_id"]: np.array(r["mean"]) for r in protos.collect()}
    ids = sorted(rows)[:250]
    want = set()
    for i, p in enumerate(ids):
        near = sorted((j for j in range(250) if j != i), key=lambda j: (((rows[p] - rows[ids[j]]) ** 2).sum(), j))
        for j in near[: int(4 + 12 * (1 - i / 249) + 0.5)]:
            want |= {(p, ids[j]), (ids[j], p)}
    got = [(r["parent_proto"], r["child_proto"]) for r in vault.hierarchy(protos).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_traversal_follows_five_edges(spark, monkeypatch):
    edges = spark.createDataFrame([("v", "positive", f"p{i:04d}", f"p{i + 1:04d}", 1.0) for i in range(7)], "source string, polarity string, parent_proto string, child_proto string, accum_distance double")
    monkeypatch.setattr(vault, "table", lambda s, d, name: edges if name == "proto_edges" else bank(spark, 8))
    got = {r["proto_id"]: r["hops"] for r in vault.QUERIES["vault_traversal"][0](spark, "").collect()}
    assert got == {f"p{i:04d}": i for i in range(6)}
