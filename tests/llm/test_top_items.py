import random

import pytest
from pyspark.sql import functions as F

from tidewright.llm import top_items

SCHEMA = "g int, id string, score double, seen int"


def by_hand(rows, n):
    best = {}
    for g, i, s, t in rows:
        if i is not None:
            best.setdefault(g, {}).setdefault(i, []).append((s, t))
    key = lambda s, t, i: (s is None, -(s or 0.0), t is None, -(t or 0), i.encode())
    out = set()
    for g, items in best.items():
        ranked = sorted((min(key(s, t, i) for s, t in v), i) for i, v in items.items())
        out |= {(g, i) for _, i in ranked[:n]}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(3000):
        g = rng.choice([None, 0, 0, 0, rng.randrange(200)])
        rows.append((g, f"p{rng.randrange(900)}-é" if rng.random() < 0.98 else None, rng.choice([None, float(rng.randrange(5))]), rng.choice([None, rng.randrange(3)])))
    rows += rows[:300]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rn", F.lit("clash")).withColumn("salt", F.lit(1))
    got = top_items.top_n(df, "g", "id", [("score", True), ("seen", True)], 4).select("g", "id").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == by_hand(rows, 4)


def test_small_batches_and_empty(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(1, f"i{k:03d}", float(k % 3), 0) for k in range(100)]
        got = {tuple(r) for r in top_items.top_n(spark.createDataFrame(rows, SCHEMA), "g", "id", [("score", True), ("seen", True)], 5).select("g", "id").collect()}
        assert got == by_hand(rows, 5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert top_items.top_n(spark.createDataFrame([], SCHEMA), "g", "id", [("score", True)], 5).count() == 0
