"""Price sources behind HTTP: how to ask each for a page and how to read it, and a paged walk
as a Python data source. The fetch function is a parameter, as tests and closed networks need."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

UNITS = {"m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
NAMES = ("1m", "3m", "5m", "15m", "30m", "1h", "2h", "4h", "6h", "8h", "12h", "1d", "3d", "1w")
RETRY = {418, 429, 500, 502, 503, 504}


def interval_to_ms(interval: str) -> int:
    m = re.fullmatch(r"(\d+)([mhdw])", interval.strip().lower())
    if not m or not int(m[1]):
        raise ValueError(f"no interval: {interval}")
    return int(m[1]) * UNITS[m[2]]


def ms_to_interval(ms: int) -> str | None:
    return next((n for n in NAMES if interval_to_ms(n) == ms), None)


@dataclass(frozen=True)
class Source:
    """``columns``: where stamp, open, high, low, close and volume stand in a row of a page;
    ``unit``: milliseconds of the stamp's unit; ``rows``: the path to the rows in the answer."""

    name: str
    url: str
    intervals: dict[str, str]
    columns: tuple[int, int, int, int, int, int]
    unit: int = 1
    rows: tuple[str, ...] = ()
    page: int = 1000
    seconds: bool = False

    def symbol(self, s: str) -> str:
        s = s.strip().upper()
        if self.name == "coinbase":
            return s if "-" in s else re.sub(r"(USDT|USDC|USD|EUR)$", r"-\1", s)
        if self.name == "kraken":
            return re.sub(r"^BTC", "XBT", s.replace("-", ""))
        return re.sub(r"[-/]", "", s)

    def request(self, symbol: str, interval: str, start: int, end: int) -> str:
        k = 1000 if self.seconds else 1
        return self.url.format(symbol=self.symbol(symbol), interval=self.token(interval), start=start // k, end=end // k, page=self.page)

    def token(self, interval: str) -> str:
        if interval not in self.intervals:
            raise ValueError(f"{self.name} has no interval {interval}")
        return self.intervals[interval]

    def read(self, answer) -> Iterator[tuple]:
        """Rows ``(ms, open, high, low, close, volume)`` of one page; short or unreadable rows are left out."""
        for step in self.rows:
            answer = next((v for k, v in answer.items() if k != "last"), []) if step == "*" else answer.get(step, [])
        for r in answer or []:
            try:
                ms, *rest = (float(r[c]) for c in self.columns)
                yield (int(ms * self.unit), *rest)
            except (IndexError, TypeError, ValueError):
                continue


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


SOURCES = {
    s.name: s
    for s in (
        Source("binance", "https://api.binance.com/api/v3/klines?symbol={symbol}&interval={interval}&startTime={start}&endTime={end}&limit={page}", _same(*NAMES), (0, 1, 2, 3, 4, 5)),
        Source("bybit", "https://api.bybit.com/v5/market/kline?category=spot&symbol={symbol}&interval={interval}&start={start}&end={end}&limit={page}",
               {n: str(interval_to_ms(n) // 60_000) for n in NAMES if interval_to_ms(n) < 86_400_000} | {"1d": "D", "1w": "W"}, (0, 1, 2, 3, 4, 5), rows=("result", "list")),
        Source("coinbase", "https://api.exchange.coinbase.com/products/{symbol}/candles?granularity={interval}&start={start}&end={end}",
               {n: str(interval_to_ms(n) // 1000) for n in ("1m", "5m", "15m", "1h", "6h", "1d")}, (0, 3, 2, 1, 4, 5), 1000, page=300, seconds=True),
        Source("kraken", "https://api.kraken.com/0/public/OHLC?pair={symbol}&interval={interval}&since={start}",
               {n: str(interval_to_ms(n) // 60_000) for n in ("1m", "5m", "15m", "30m", "1h", "4h", "1d", "1w")}, (0, 1, 2, 3, 4, 6), 1000, ("result", "*"), 720, True),
    )
}


def get_source(name: str) -> Source:
    if name not in SOURCES:
        raise ValueError(f"unknown source {name}; there are {', '.join(SOURCES)}")
    return SOURCES[name]


def interval_name(ms: Column) -> Column:
    """The name of an interval in milliseconds, null where it has none."""
    return F.create_map(*[x for n in NAMES for x in (F.lit(interval_to_ms(n)), F.lit(n))])[ms.cast("int")]


def parse_pages(pages: DataFrame, source: str) -> DataFrame:
    """``(stream, ms, open, high, low, close, volume)`` of recorded answers ``(stream, value)`` of one source,
    parsed in bulk as columns. Short rows and rows with an unreadable stamp are left out; broken and
    empty answers give nothing."""
    src = get_source(source)
    rows = "array<array<string>>"
    if not src.rows:
        found = F.from_json("value", rows)
    elif src.rows[-1] == "*":
        inner = F.explode(F.from_json("value", f"{src.rows[0]} map<string,string>")[src.rows[0]])
        pages = pages.select("stream", inner.alias("k", "value")).where("k <> 'last'")
        found = F.from_json("value", rows)
    else:
        found = F.from_json("value", f"{src.rows[0]} struct<{src.rows[1]}: {rows}>")[src.rows[0]][src.rows[1]]
    one = pages.select("stream", F.explode(found).alias("r")).where(F.size("r") > max(src.columns))
    ms, *nums = (F.get("r", F.lit(c)).try_cast("double") for c in src.columns)
    return one.select("stream", (ms * src.unit).cast("bigint").alias("ms"), *[x.alias(n) for n, x in zip(("open", "high", "low", "close", "volume"), nums, strict=True)]).where("ms is not null")


def format_pages(bars: DataFrame, source: str, page: int = 500) -> DataFrame:
    """Bars of ``(stream, i, us, open .. volume)`` as answers in a source's shape, ``page`` bars each, with a
    short row at the end; Bybit's begin with the latest."""
    src = get_source(source)
    width = max(src.columns) + 1
    fields = dict(zip(src.columns, (F.expr(f"cast(us div {1000 * src.unit} as string)"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")]), strict=True))
    row = F.array(*[fields.get(k, F.lit("0")) for k in range(width)])
    rows = F.sort_array(F.collect_list(F.struct("i", row.alias("r"))), asc=source != "bybit")["r"]
    listed = F.concat(rows, F.array(F.array(F.lit("1"))))
    body = F.to_json(listed)
    if src.rows:
        name = "PAIR" if src.rows[-1] == "*" else src.rows[1]
        body = F.concat(F.lit(f'{{"{src.rows[0]}":{{"{name}":'), body, F.lit(',"last":1}}' if src.rows[-1] == "*" else "}}"))
    return bars.groupBy("stream", F.expr(f"i div {page}").alias("page")).agg(body.alias("value")).select("stream", "value")


def http_json(url: str, fetch: Callable[[str], bytes] | None = None, retries: int = 4, delay: float = 0.5, sleep=time.sleep):
    """GET and parse, waiting twice as long after each refusal that may pass."""
    fetch = fetch or (lambda u: urllib.request.urlopen(u, timeout=15).read())
    for attempt in range(retries + 1):
        try:
            return json.loads(fetch(url))
        except urllib.error.HTTPError as e:
            if e.code not in RETRY or attempt == retries:
                raise
        except (urllib.error.URLError, TimeoutError):
            if attempt == retries:
                raise
        sleep(delay * 2**attempt)


def fetch_candles(source: str, symbol: str, interval: str, start: int, end: int, fetch=None, now: int | None = None, sleep=time.sleep, page_delay: float = 0.0, max_requests: int = 10_000) -> Iterator[tuple]:
    """Walk [start, end) page by page, oldest first: rows in the window, each stamp once, closed bars only."""
    src, step = get_source(source), interval_to_ms(interval)
    now = int(time.time() * 1000) if now is None else now
    at, seen = start, -1
    for _ in range(max_requests):
        if at >= end:
            return
        page = sorted(src.read(http_json(src.request(symbol, interval, at, min(end, at + step * src.page) - 1), fetch, sleep=sleep)))
        fresh = [r for r in page if at <= r[0] < end and r[0] > seen and r[0] + step <= now]
        for r in fresh:
            if r[0] > seen:
                seen = r[0]
                yield r
        if fresh:
            at = seen + step
        else:
            at += step * src.page
            if at > now:
                return
        sleep(page_delay)


def fetch_candles_auto(sources: tuple[str, ...], *args, on_fallback=None, **kw) -> list[tuple]:
    """The first source that answers."""
    problem: Exception | None = None
    for s in sources:
        try:
            return list(fetch_candles(s, *args, **kw))
        except Exception as e:  # noqa: BLE001
            problem = e
            if on_fallback:
                on_fallback(s, e)
    raise problem or ValueError("no sources")


def fetch_funding(fetch_page: Callable[[int, int], list[dict]], start: int, end: int, now: int) -> Iterator[tuple]:
    """Funding rows ``(ms, rate, mark)`` of a paged feed of objects: each stamp once, none from the future."""
    at, seen = start, -1
    while at < min(end, now):
        rows = sorted((int(r["fundingTime"]), float(r["fundingRate"]), float(r["markPrice"]) if r.get("markPrice") else None) for r in fetch_page(at, end) if r.get("fundingRate") is not None)
        rows = [r for r in rows if seen < r[0] < min(end, now + 1)]
        if not rows:
            return
        for r in rows:
            if r[0] > seen:
                seen = r[0]
                yield r
        at = seen + 1


def plan_update(last_ms: int | None, interval: str, now: int) -> tuple[int, int]:
    """The window that is missing behind the last stored bar."""
    return (0 if last_ms is None else last_ms + interval_to_ms(interval), now)


def plan_backfill(interval: str, start: int, end: int, most: float = float("inf")) -> tuple[int, int, int]:
    rows = max(0, -(-(end - start) // interval_to_ms(interval)))
    return start, end, int(min(rows, most))


@dataclass
class Slice(InputPartition):
    start: int
    end: int


class CandleReader(DataSourceReader):
    """Splits the window into slices of whole bars, one task each."""

    def __init__(self, options: dict, fetch=None):
        self.o, self.fetch = options, fetch

    def partitions(self):
        start, end, n = int(self.o["start"]), int(self.o["end"]), int(self.o.get("slices", 4))
        step = interval_to_ms(self.o["interval"])
        bars = max(1, -(-(end - start) // step))
        per = -(-bars // n) * step
        return [Slice(a, min(end, a + per)) for a in range(start, end, per)]

    def read(self, partition):
        o = self.o
        fetch = self.fetch or (_replay(o["replay"]) if "replay" in o else None)
        for ms, *rest in fetch_candles(o["source"], o["symbol"], o["interval"], partition.start, partition.end, fetch, int(o["now"]) if "now" in o else None):
            yield (o["symbol"], ms * 1000, *rest)


def _replay(folder: str) -> Callable[[str], bytes]:
    """Answers from a recorded page of Binance-shaped rows instead of the network."""

    def fetch(url: str) -> bytes:
        lo, hi = (int(re.search(rf"{k}=(\d+)", url)[1]) for k in ("startTime", "endTime"))
        with open(folder) as f:
            return json.dumps([r for r in json.load(f) if lo <= r[0] <= hi]).encode()

    return fetch


class CandleSource(DataSource):
    """``spark.read.format("candles").option("source", ..)``: bars of one symbol over HTTP."""

    @classmethod
    def name(cls):
        return "candles"

    def schema(self):
        return "stream string, us bigint, open double, high double, low double, close double, volume double"

    def reader(self, schema):
        return CandleReader(dict(self.options))
