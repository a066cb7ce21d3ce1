from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import packing
from tidewright.session import cut


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=6), st.integers(0, 60))
def test_fill_once_is_the_best_sum(counts, room):
    used = packing.fill_once(counts, room)
    assert all(0 < n <= counts[x] for x, n in used.items())
    sums = {0}
    for x, n in counts.items():
        sums = {s + k * x for s in sums for k in range(n + 1)}
    assert sum(x * n for x, n in used.items()) == max(s for s in sums if s <= room)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_plan_places_every_item_once(lengths):
    placed, boxes = Counter(), 0
    for first, times, used in packing.plan(dict(Counter(lengths)), 50):
        assert first == boxes and sum(x * n for x, n in used.items()) <= 50
        boxes += times
        for x, n in used.items():
            placed[x] += n * times
    assert placed == Counter(lengths)
    assert boxes <= 2 * -(-sum(lengths) // 50) if lengths else boxes == 0


def test_items_nulls_zeros_ties_and_giants(spark):
    rows = [(k, n) for k, n in enumerate([0, 0, None, 10, 10, 10, 7, 3, 25, 100, 1, 1, 1, 99])] + [(3, 10)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    out = packing.pack(cut(df), 10).collect()
    by_box = Counter()
    for r in out:
        by_box[r["container"]] += r["n_tokens"]
    assert max(by_box.values()) <= 10 and len(by_box) == -(-sum(n for _, n in rows if n) // 10)
    whole = Counter()
    for r in out:
        whole[r["doc_id"]] += r["n_tokens"]
    assert whole == Counter({0: 0, 1: 0} | {k: n for k, n in rows if n and k != 3} | {3: 20})
    pieces = [(r["doc_id"], r["piece"]) for r in out if r["n_tokens"] == 10 and r["doc_id"] in (8, 9, 13)]
    assert len(pieces) == len(set(pieces)) == 2 + 10 + 9
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint")).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|> x " * 5000)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(df.selectExpr("*", "1 as n_tokens")).collect()}
    assert got[1] == 2 and got[2] == 0 and 3 not in got and got[4] > 20_000


@pytest.mark.parametrize("n", [0, 1, 500])
def test_many_equal_lengths_spread_over_shards(spark, n):
    df = spark.range(n).selectExpr("id as doc_id", "cast(30 as bigint) as n_tokens")
    out = packing.pack(df, 100).groupBy("container").sum("n_tokens").collect()
    assert len(out) == -(-n // 3)
