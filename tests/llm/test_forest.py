import numpy as np
import pytest

from tidewright.llm import forest as Fo

SCHEMA = "id string, vec array<double>"


def table(spark, seed=1, n=900):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        d = (8, 12)[k % 2]
        v = rng.normal(size=d)
        rows.append((f"p{k}", v.tolist()))
        if k % 9 == 0:
            rows.append((f"q{k}", (v * rng.uniform(0.5, 3) * (1 + rng.normal(0, 0.003, d))).tolist()))
        if k % 50 == 0:
            rows += [(f"r{k}", v.tolist()), (f"p{k}", v.tolist())]
    rows += [("zero", [0.0] * 8), ("nan", [float("nan")] + [1.0] * 7), ("null", None), (None, [1.0] * 8), ("hole", [1.0, None] + [1.0] * 6), ("empty", []), ("inf", [float("inf")] + [1.0] * 7)]
    return rows


def by_hand(rows):
    good = {i: np.array(v, float) for i, v in rows if i and v and None not in v and np.isfinite(v).all() and any(v)}
    return {i: v / np.linalg.norm(v) for i, v in good.items()}


@pytest.mark.parametrize("leaf", [16, 1024])
def test_pairs_against_brute_force(spark, leaf):
    rows = table(spark)
    units = by_hand(rows)
    want = {(a, b) for a in units for b in units if a < b and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.9999}
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "2 as code", "'x' as p")
    got = [tuple(r) for r in Fo.similar_pairs(df, 0.9999, Fo.ForestSpec(leaf=leaf)).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got)) >= 0.99 * len(want) > 50


def test_neighbours_recall_and_ties(spark):
    rows = table(spark, 2, 700)
    units = by_hand(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    out = Fo.nearest(df, df.where("crc32(cast(id as binary)) % 10 = 0"), 5, spec=Fo.ForestSpec(leaf=64, sample=300)).collect()
    mine = {}
    for r in out:
        mine.setdefault(r["query"], {})[r["rank"]] = (r["id"], r["cosine"])
    hits = total = 0
    for q, found in mine.items():
        assert q not in {i for i, _ in found.values()} and sorted(found) == list(range(1, len(found) + 1))
        best = sorted(((-float(units[q] @ v), i) for i, v in units.items() if i != q and len(v) == len(units[q])))[:5]
        hits += len({i for _, i in best} & {i for i, _ in found.values()})
        total += len(best)
    assert hits / total >= 0.9


def test_many_copies_and_empty(spark):
    rows = [(f"c{k}", [1.0, 2.0, 3.0]) for k in range(60)]
    assert Fo.similar_pairs(spark.createDataFrame(rows, SCHEMA), 0.9999, Fo.ForestSpec(leaf=4)).count() == 60 * 59 // 2
    assert Fo.similar_pairs(spark.createDataFrame([], SCHEMA), 0.9999).count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert Fo.nearest(empty, empty).count() == 0


def test_copies_of_a_vector_stand_for_one(spark):
    rng = np.random.default_rng(6)
    same, near = rng.normal(0, 1, 12), rng.normal(0, 1, 12)
    rows = [(f"c{k:04d}", same.tolist()) for k in range(3000)] + [("d", (same * 1.00001).tolist()), ("e", near.tolist()), ("f", (near + 1e-4).tolist())] + [(f"r{k}", rng.normal(0, 1, 12).tolist()) for k in range(200)]
    df = spark.createDataFrame(rows, "id string, vec array<double>").repartition(4)
    pairs, members = Fo.similar_classes(df, 0.9999)
    assert {(r["p"], r["q"]) for r in pairs.collect()} == {("c0000", "d"), ("e", "f")}
    assert {r["rep"] for r in members.collect()} == {"c0000"} and members.count() == 2999
    few = df.where("id < 'c0005' or id >= 'd'")
    assert {(r["id_a"], r["id_b"]) for r in Fo.similar_pairs(few, 0.9999).collect()} == {(f"c{a:04d}", f"c{b:04d}") for a in range(5) for b in range(a + 1, 5)} | {(f"c{a:04d}", "d") for a in range(5)} | {("e", "f")}
