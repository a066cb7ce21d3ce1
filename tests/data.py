"""Small tables for tests."""

from datetime import datetime, timedelta, timezone

import numpy as np

CANDLES = "row_id bigint, stream string, ts timestamp, open double, high double, low double, close double, volume double, ingested_at timestamp"
MANIFEST = "stream string, symbol string, venue string, interval_ms bigint, window_start timestamp, window_end timestamp"
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


def candles(spark, rows):
    """rows: (row_id, stream, minutes or None, open, high, low, close, volume)"""
    return spark.createDataFrame([(i, s, None if t is None else at(t), o, h, lo, c, v, at((t or 0) + 1)) for i, s, t, o, h, lo, c, v in rows], CANDLES)


def walk(n: int, stream: str = "a", seed: int = 1, step: float = 1.0, first: int = 0, levels: float | None = None):
    """Rows of a random walk; with ``levels`` prices and volumes fall on few values, so they repeat."""
    rng = np.random.default_rng(seed)
    rows, close = [], 100.0
    for k in range(n):
        o = close
        close = max(1.0, o + rng.normal(0, 0.5))
        h, lo, v = max(o, close) + abs(rng.normal(0, 0.2)), min(o, close) - abs(rng.normal(0, 0.2)), float(rng.integers(1, 100))
        if levels:
            o, h, lo, close, v = (round(x / levels) * levels for x in (o, h, lo, close, v))
            h, lo = max(h, o, close), min(lo, o, close)
        rows.append((first + k, stream, k * step, float(o), float(h), float(lo), float(close), float(v)))
    return rows
