import json
import subprocess
import sys
from pathlib import Path

import pytest
from data import candles, walk
from pyspark.sql import functions as F

from tidewright.operators.bars import bars, indexed, own, with_halo
from tidewright.operators.consensus import settle
from tidewright.plans.plugins import CONTRACTS, Registry, default_registry, fingerprint, fnv1a, function_plugin
from tidewright.sources import exchanges as X
from tidewright.sources import jsonl
from tidewright.streaming import queries as S

ROOT = Path(__file__).resolve().parent.parent


def page(url: str) -> bytes:
    import re

    lo, hi = (int(re.search(rf"{k}=(\d+)", url)[1]) for k in ("startTime", "endTime"))
    rows = [[t, "1", "2", "0.5", "1.5", "10"] for t in range(0, 60_000 * 2500, 60_000) if lo <= t <= hi]
    return json.dumps([*rows[::-1][:1000], ["short"]]).encode()


def test_paged_walk_and_retries():
    got = list(X.fetch_candles("binance", "btc-usdt", "1m", 0, 60_000 * 2500, page, now=60_000 * 2000, sleep=lambda s: None))
    assert [r[0] for r in got] == list(range(0, 60_000 * 2000, 60_000)) and got[0][1:] == (1.0, 2.0, 0.5, 1.5, 10.0)
    waits, calls = [], []

    def flaky(url):
        import urllib.error

        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 429, "slow", None, None)
        return b"[]"

    assert X.http_json("u", flaky, sleep=waits.append) == [] and waits == [0.5, 1.0]
    assert X.fetch_candles_auto(("none", "binance"), "BTCUSDT", "1m", 0, 120_000, page, now=10**9, sleep=lambda s: None)


def test_exchange_shapes():
    assert X.interval_to_ms("15m") == 900_000 and X.ms_to_interval(604_800_000) == "1w"
    assert list(X.get_source("bybit").read({"result": {"list": [["1000", "1", "2", "0.5", "1.5", "9", "x"]]}})) == [(1000, 1.0, 2.0, 0.5, 1.5, 9.0)]
    assert list(X.get_source("coinbase").read([[60, 0.5, 2, 1, 1.5, 9]])) == [(60_000, 1.0, 2.0, 0.5, 1.5, 9.0)]
    assert list(X.get_source("kraken").read({"result": {"XXBTZUSD": [[60, "1", "2", "0.5", "1.5", "1.2", "9", 3]], "last": 5}})) == [(60_000, 1.0, 2.0, 0.5, 1.5, 9.0)]
    assert X.get_source("coinbase").symbol("btcusd") == "BTC-USD" and X.get_source("kraken").symbol("BTC-USD") == "XBTUSD"
    with pytest.raises(ValueError):
        X.get_source("coinbase").token("3m")
    assert list(X.fetch_funding(lambda a, b: [{"fundingTime": t, "fundingRate": "0.1", "markPrice": ""} for t in (0, 10, 10, 99) if a <= t < b], 0, 100, 50)) == [(0, 0.1, None), (10, 0.1, None)]


def test_data_source(spark, tmp_path):
    f = tmp_path / "page.json"
    f.write_text(json.dumps([[t, "1", "2", "0.5", "1.5", "10"] for t in range(0, 600_000, 60_000)]))
    spark.dataSource.register(X.CandleSource)
    df = spark.read.format("candles").options(source="binance", symbol="AB", interval="1m", start=0, end=600_000, now=10**9, slices=3, replay=str(f)).load()
    assert df.count() == 10 and df.rdd.getNumPartitions() == 3


def test_jsonl_counts_what_it_drops(spark):
    lines = ["", "{broken", '{"stream":"a","timestamp":1700000000,"open":"1","high":"2","low":"0.5","close":1,"volume":0}', '{"stream":"a","timestamp":"2024-01-01T00:00:00Z","open":1,"high":2,"low":0.5,"close":1,"volume":3}', '{"stream":"a","timestamp":"x","open":1,"high":2,"low":0.5,"close":1,"volume":3}', '{"stream":"a","timestamp":1,"open":-1,"high":2,"low":0.5,"close":1,"volume":3}']
    rows, counts = jsonl.parse_bars(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert counts.first().asDict() == {"blank": 1, "invalid": 3, "valid": 2}
    assert {r["us"] for r in rows.collect()} == {1700000000_000000, 1704067200_000000}
    text = spark.createDataFrame([('{"symbols":{"S":{"t0":10,"stepMs":5,"oiVal":[1.0,0.0,3.0]}}}',)], "value string")
    assert sorted(map(tuple, jsonl.parse_panel(text).collect())) == [("S", 10, 1.0), ("S", 20, 3.0)]


def test_stream_in_many_batches_equals_batch(spark, tmp_path):
    rows = bars(candles(spark, walk(400) + walk(300, "b", 3, first=1000)))
    pdf = rows.toPandas().sort_values("us")
    for k in range(4):
        spark.createDataFrame(pdf[(pdf["us"].rank(method="dense") - 1) // 100 == k], rows.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    import os

    for n, p in enumerate(files):
        os.utime(p, (1_700_000_000 + n, 1_700_000_000 + n))
    out = S.run_to_end(S.settle_stream(S.open_stream(spark, str(tmp_path / "in"), rows.schema, 1), 0.004, 0.003, 24))
    assert out.select("batch").distinct().count() == 4
    want = own(settle(with_halo(indexed(rows), 1, ahead=24), 0.004, 0.003, 24)).where("outcome is not null").select("stream", "i", "settled_at", "outcome")
    assert sorted(map(tuple, out.drop("batch").collect())) == sorted(map(tuple, want.collect()))


def test_registry():
    r = Registry()
    r.register("feature", function_plugin("f", "column", lambda: F.lit(1)), default=True)
    with pytest.raises(ValueError):
        r.register("feature", function_plugin("f", "column", lambda: F.lit(1)))
    with pytest.raises(TypeError):
        r.register("label", function_plugin("x", "column", lambda: 1))
    assert r.has("feature", "f") and r.active_roster("feature") == ["f"] and r.resolve_or_none("book", "x") is None and len(CONTRACTS) == 10
    d = default_registry()
    assert d.instantiate("learner", "ridge", penalty=0.5).penalty == 0.5 and d.stack_digest() == default_registry().stack_digest()
    assert fnv1a("a") == 0xE40C292C and fingerprint({"b": 1, "a": 2}) == fingerprint({"a": 2, "b": 1})


def test_entry_stands_without_the_subpackage(tmp_path):
    code = "import sys\nsys.modules['tidewright.llm'] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert 'p1_found' in q and 'p5_found' not in q\nassert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0
    bad = [p for p in (ROOT / "tidewright").rglob("*.py") if "llm" not in p.parts and "tidewright.llm" in p.read_text()]
    assert not bad
