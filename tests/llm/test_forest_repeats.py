import numpy as np
from pyspark.sql import functions as F

from tidewright.llm import forest as Fo

SCHEMA = "id string, vec array<double>"


def test_copies_in_other_tasks_take_no_place(spark):
    rng = np.random.default_rng(4)
    near = rng.normal(size=8)
    rows = [(f"n{i:02d}", (near + 0.001 * rng.normal(size=8)).tolist()) for i in range(30)] + [(f"f{i}", rng.normal(size=8).tolist()) for i in range(50)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows * 3, 3), SCHEMA)  # each copy is read in a task of its own
    units = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    want = sorted(((-round(float(units["n00"] @ v), 9), i) for i, v in units.items() if i != "n00"))[:5]
    got = Fo.nearest(df, df.where("id = 'n00'"), 5).orderBy("rank").collect()
    assert [(r["id"], r["rank"]) for r in got] == [(i, k) for k, (_, i) in enumerate(want, 1)]


def test_ties_go_to_the_smaller_id(spark):
    rows = [(f"c{k:03d}", [1.0, 2.0, 3.0 * (1 + (k == 500) * 1e-4)]) for k in range(501)]
    df = spark.createDataFrame(rows, SCHEMA).orderBy(F.xxhash64("id"))
    got = Fo.nearest(df, df.where("id = 'c100'"), 7).orderBy("rank").collect()
    assert [r["id"] for r in got] == [f"c{k:03d}" for k in range(7)]
