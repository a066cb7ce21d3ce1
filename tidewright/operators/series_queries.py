"""Queries over the bar and funding series: audits, repairs, gaps, resampling, carry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.operators import quality
from tidewright.operators.bars import BARS_SQL, bars, dedupe_bars, drop_unclosed, find_gaps, merge_bars, normalize_bars, numbered, resample_bars, summarize_bars, with_halo
from tidewright.session import cut, join_small, table

#: "Now" of the audits, 2026-01-01 UTC.
NOW_US = 1_767_225_600_000_000


def _steps(spark, sf_dir):
    return cut(table(spark, sf_dir, "candle_manifest").groupBy(F.col("stream").alias("ms")).agg((F.max("interval_ms") * 1000).alias("step_us")))


def q_audit(spark, sf_dir):
    return quality.audit_problems(quality.audit_series(table(spark, sf_dir, "candles"), table(spark, sf_dir, "candle_manifest"), NOW_US)).withColumn("problems", F.array_join("problems", ","))


def q_repair(spark, sf_dir):
    """Bars whose wicks were cut to the body."""
    fixed = quality.repair(table(spark, sf_dir, "candles").select("row_id", "open", "high", "low", "close"))
    return fixed.where("repaired").select("row_id", "low", "high")


def q_gaps(spark, sf_dir):
    rows = with_halo(numbered(table(spark, sf_dir, "candles")), 1)
    rows = join_small(rows, _steps(spark, sf_dir), F.col("stream") == F.col("ms"))
    return find_gaps(rows, F.col("step_us")).where("missing > 0")


def q_summary(spark, sf_dir):
    return summarize_bars(bars(table(spark, sf_dir, "candles")))


def q_resampled(spark, sf_dir):
    out = resample_bars(numbered(table(spark, sf_dir, "candles")), 4)
    return out.select("stream", "us", "open", "high", "low", "close", F.round("volume", 4).alias("volume"))


def q_jsonl(spark, sf_dir):
    """Bars written as JSON lines, read back as text, parsed and checked: the round trip of the file source and sink."""
    from tidewright.sources.jsonl import format_bars, parse_bars

    rows = normalize_bars(table(spark, sf_dir, "candles"))
    back, _ = parse_bars(format_bars(rows))
    return back.select("stream", "us", "open", "close").distinct()


def q_funding_audit(spark, sf_dir):
    return quality.audit_funding(table(spark, sf_dir, "funding"))


def q_carry(spark, sf_dir):
    """Funding on the bar grid: a backward as-of join, inclusive."""
    rows = bars(table(spark, sf_dir, "candles")).select("stream", "us")
    rows = join_small(rows, _steps(spark, sf_dir), F.col("stream") == F.col("ms"))
    return quality.carry_on_bars(rows, table(spark, sf_dir, "funding"), F.col("step_us")).select("stream", "us", F.round("carry", 12).alias("carry"))


def q_carry_view(spark, sf_dir):
    """Funding summed and the last mark per 8-hour bucket, spot return from the bucket before
    (by key, not by row) and the basis against the mark's return."""
    grid = 28_800_000_000
    b = F.expr(f"us div {grid}")
    spot = bars(table(spark, sf_dir, "candles")).groupBy("stream", b.alias("k")).agg(F.max_by("close", "us").alias("spot"))
    f = quality.funding_rows(table(spark, sf_dir, "funding")).groupBy("stream", b.alias("k")).agg(F.round(F.sum("rate"), 9).alias("f_rate"), F.max_by("mark", "us").alias("mark"))
    both = f.join(spot, ["stream", "k"], "left")
    prev = both.select("stream", (F.col("k") + 1).alias("k"), F.col("spot").alias("spot0"), F.col("mark").alias("mark0"))
    out = both.join(prev, ["stream", "k"], "left").withColumn("spot_ret", F.col("spot") / F.col("spot0") - 1)
    return out.select("stream", "k", "f_rate", F.round("spot_ret", 9).alias("spot_ret"), F.round(F.col("spot_ret") - (F.col("mark") / F.col("mark0") - 1), 9).alias("basis"))


_STEP = "w as (select stream, max(interval_ms) * 1000 step from candle_manifest group by 1)"
_COUNT = ["missing_values", "bad_numeric", "bad_ohlc", "non_monotonic", "duplicates", "misaligned", "unclosed"]
AUDIT_SQL = f"""with {_STEP}, o as (select c.*, epoch_us(ts) us, step, lag(epoch_us(ts)) over q pu, lag(close) over q pc from candles c join w using (stream) window q as (partition by stream order by row_id)),
a as (select stream, count(*) as rows, min(us) as first_us, max(us) as last_us,
  count_if(us is null or open is null or high is null or low is null or close is null or volume is null) as missing_values,
  count_if(coalesce(open <= 0 or high <= 0 or low <= 0 or close <= 0 or volume < 0, false)) as bad_numeric,
  count_if(coalesce(high < low or high < open or high < close or low > open or low > close, false)) as bad_ohlc,
  count_if(coalesce(us <= pu, false)) as non_monotonic, count_if(coalesce(us % step <> 0, false)) as misaligned, count_if(coalesce(us + step > {NOW_US}, false)) as unclosed,
  count_if(coalesce(volume = 0, false)) as zero_volume, min(low) as min_low, max(high) as max_high, max(volume) as max_volume, round(max(case when pc > 0 then abs(close / pc - 1) end), 9) as max_abs_return
  from o group by 1),
d as (select stream, sum(n - 1) n from (select stream, ts, count(*) n from candles where ts is not null group by 1, 2) group by 1)
select a.*, coalesce(d.n, 0) as duplicates, array_to_string(list_filter([{', '.join(f"case when {'coalesce(d.n, 0)' if n == 'duplicates' else n} > 0 then '{n.replace('_', ' ')}' end" for n in _COUNT)}], lambda x: x is not null), ',') as problems
from a left join d using (stream)"""
REPAIR_SQL = """select row_id, case when low < least(open, close) * (1 - 0.9) then least(open, close) else low end as low,
  case when high > greatest(open, close) * (1 + 0.9) then greatest(open, close) else high end as high from candles
where open is not null and high is not null and low is not null and close is not null and (low < least(open, close) * (1 - 0.9) or high > greatest(open, close) * (1 + 0.9))"""
GAPS_SQL = f"""with {BARS_SQL}, {_STEP}, g as (select b.stream, lag(us) over (partition by b.stream order by i) p, us, step from b join w on w.stream = b.stream)
select stream, p as from_us, us as to_us, round((us - p) / step)::bigint - 1 as missing from g where us - p > step and round((us - p) / step) > 1"""
SUMMARY_SQL = f"""with {BARS_SQL} select stream, count(*) as bars, min(us) as first_us, max(us) as last_us, min(low) as min_low, max(high) as max_high,
  arg_min(close, us) as first_close, arg_max(close, us) as last_close, round(sum(volume), 4) as volume from b group by 1"""
RESAMPLE_SQL = f"""with {BARS_SQL} select stream, min(us) as us, arg_min(open, i) as open, max(high) as high, min(low) as low, arg_max(close, i) as close, round(sum(volume), 4) as volume
from b group by stream, i // 4 having count(*) = 4"""
JSONL_SQL = """select distinct stream, epoch_us(ts) as us, open, close from candles where ts >= timestamptz '1980-01-01 00:00:00+00' and open > 0 and high > 0 and low > 0 and close > 0 and volume >= 0
  and high >= greatest(open, close, low) and low <= least(open, close)"""
_FUND = "f as (select stream, epoch_us(ts) us, max(funding_rate) rate, max(mark_price) mark from funding where ts is not null and funding_rate is not null group by 1, 2)"
FUNDING_SQL = f"""with {_FUND}, d as (select *, (us - lag(us) over (partition by stream order by us)) / 1000.0::double dt from f), e as (select *, round(dt / 14400000) k from d)
select stream, count(*) as rows, count_if(abs(dt - k * 14400000) > 60000) as off_grid, count_if(abs(dt - k * 14400000) <= 60000 and k = 1) as steps_4h, count_if(abs(dt - k * 14400000) <= 60000 and k = 2) as steps_8h,
  coalesce(sum(case when dt > 28860000 then round(dt / 28800000) - 1 end), 0)::bigint as missing_periods, count_if(abs(rate) > 0.01) as extreme_rates, count_if(rate = 0) as zero_rates, count_if(rate < 0) as negative,
  round(avg(rate), 9) as mean_rate, round(avg(abs(rate)), 9) as mean_abs_rate, round(median(dt), 3) as median_step_ms from e group by 1"""
CARRY_SQL = f"""with {BARS_SQL}, {_STEP}, {_FUND}, j as (select b.stream, b.us, step, rate from b join w on w.stream = b.stream asof left join f on f.stream = b.stream and f.us <= b.us)
select stream, us, round(coalesce(rate, 0) / greatest(1, round(28800000000 / step)), 12) as carry from j"""
VIEW_SQL = f"""with {BARS_SQL}, {_FUND}, s as (select stream, us // 28800000000 k, arg_max(close, us) spot from b group by 1, 2),
g as (select stream, us // 28800000000 k, round(sum(rate), 9) f_rate, arg_max(mark, us) filter (mark is not null) mark, arg_max_null(mark, us) mk from f group by 1, 2),
x as (select g.stream, g.k, f_rate, mk mark, spot from g left join s on s.stream = g.stream and s.k = g.k)
select x.stream, x.k, x.f_rate, round(x.spot / p.spot - 1, 9) as spot_ret, round(x.spot / p.spot - 1 - (x.mark / p.mark - 1), 9) as basis from x left join x p on p.stream = x.stream and p.k = x.k - 1"""

def q_filters(spark, sf_dir):
    """Per stream how many values, stamps and bars pass each row filter, and the volume with missing values as 0."""
    c = table(spark, sf_dir, "candles")
    fields = ("open", "high", "low", "close", "volume")
    return c.groupBy("stream").agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(quality.is_valid_number(F.col(f)), F.lit(False))).alias(f"valid_{f}") for f in fields], F.count_if(quality.is_valid_timestamp(F.col("ts"))).alias("valid_ts"),
        F.count_if(quality.is_implausible(0.5)).alias("implausible"), F.round(F.sum(quality.finite_or(F.col("volume"))), 3).alias("volume"),
    )


def q_wicks(spark, sf_dir):
    """The bars whose wicks reach beyond half of the body's end."""
    return quality.find_implausible_wicks(table(spark, sf_dir, "candles"), 0.5).select("row_id")


def q_grids(spark, sf_dir):
    """Per stream the decimals its last price needs, the grid they make, and that price cut off to two decimals."""
    last = summarize_bars(bars(table(spark, sf_dir, "candles"))).select("stream", F.col("last_close").alias("price"))
    return last.select("stream", quality.price_decimals(F.col("price")).alias("decimals"), F.round(quality.price_grid(F.col("price")), 9).alias("grid"), quality.truncate_to_decimals(F.col("price"), 2).alias("cut"))


#: "Now" of the stores, 2023-07-22 04:26:40 UTC.
STORE_US = 1_690_000_000_000_000


def q_store(spark, sf_dir):
    """A stored file (rows that came first) with an update merged over it, unclosed bars dropped: per stream."""
    rows = normalize_bars(table(spark, sf_dir, "candles"))
    old, new = (dedupe_bars(rows.where(F.expr(f"row_id % 5 {op} 0"))) for op in ("<>", "="))
    out = join_small(merge_bars(old, new), _steps(spark, sf_dir), F.col("stream").eqNullSafe(F.col("ms")))
    out = drop_unclosed(out, F.col("step_us"), STORE_US)
    return out.groupBy("stream").agg(F.count(F.lit(1)).alias("bars"), F.max("us").alias("last_us"), F.round(F.sum("close"), 4).alias("close"), F.count_if(F.col("row_id") % 5 == 0).alias("updated"))


def q_plan(spark, sf_dir):
    """What an update has to fetch behind each stream's last bar, and what a backfill of its windows has to."""
    from tidewright.sources.exchanges import interval_name

    man = table(spark, sf_dir, "candle_manifest")
    whole = (F.unix_micros("window_end") - F.unix_micros("window_start")) / (F.col("interval_ms") * 1000)
    windows = man.groupBy("stream").agg(F.max("interval_ms").alias("interval_ms"), F.sum(F.ceil(whole)).alias("backfill"))
    last = bars(table(spark, sf_dir, "candles")).groupBy(F.col("stream").alias("s")).agg(F.expr("max(us) div 1000").alias("last_ms"))
    j = windows.join(last, F.col("stream") == F.col("s"), "left")
    start = F.coalesce(F.col("last_ms") + F.col("interval_ms"), F.lit(0))
    return j.select("stream", interval_name(F.col("interval_ms")).alias("interval"), start.alias("start_ms"), F.greatest(F.lit(0), F.ceil((F.lit(NOW_US // 1000) - start) / F.col("interval_ms"))).alias("update"), "backfill")


def q_pages(spark, sf_dir):
    """Bars in the answers of four exchanges, read back: per source and stream."""
    from tidewright.sources.exchanges import SOURCES, format_pages, parse_pages

    rows = numbered(table(spark, sf_dir, "candles"))
    out = None
    for name in SOURCES:
        one = parse_pages(format_pages(rows, name), name).groupBy("stream").agg(F.count(F.lit(1)).alias("bars"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.max_by("open", "ms").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ms").alias("close"), F.round(F.sum("volume"), 1).alias("volume"))
        one = one.select(F.lit(name).alias("source"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def q_funding_lines(spark, sf_dir):
    """Funding rows written as JSON lines and read back."""
    from tidewright.sources.jsonl import format_funding, parse_funding

    return parse_funding(format_funding(quality.funding_rows(table(spark, sf_dir, "funding")))).distinct()


def q_panel_files(spark, sf_dir):
    """Marks as whole-JSON panels of 90 periods, read back: what is positive, with its stamp."""
    from tidewright.sources.jsonl import parse_panel

    period, per = 28_800_000, 90
    marks = quality.funding_rows(table(spark, sf_dir, "funding")).where("mark is not null").groupBy("stream", F.expr(f"us div {period * 1000}").alias("k")).agg(F.max("mark").alias("mark"))
    part = marks.groupBy("stream", F.expr(f"k div {per}").alias("p")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("k") % per).cast("int").alias("i"), F.col("mark")))).alias("by"))
    values = F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda i: F.coalesce(F.element_at("by", i), F.lit(0.0)))
    doc = F.struct(F.create_map("stream", F.struct((F.col("p") * per * period).alias("t0"), F.lit(period).alias("stepMs"), values.alias("oiVal"))).alias("symbols"))
    return parse_panel(part.select(F.to_json(doc).alias("value")))


def q_tail(spark, sf_dir):
    """The last three bars of every stream; a limit by rank, kept small before the shuffle."""
    w = Window.partitionBy("stream").orderBy(F.col("us").desc())
    return bars(table(spark, sf_dir, "candles")).withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("stream", "us", "close", "rn")


def q_missing_days(spark, sf_dir):
    """Days of a stream's windows on which it has no bar: the windows' calendar less the days present."""
    man = table(spark, sf_dir, "candle_manifest")
    last = F.to_date(F.timestamp_micros(F.unix_micros("window_end") - 1))
    calendar = man.select("stream", F.explode(F.sequence(F.to_date("window_start"), last)).alias("day"))
    have = bars(table(spark, sf_dir, "candles")).select("stream", F.to_date(F.timestamp_micros("us")).alias("day"))
    return calendar.exceptAll(calendar.intersect(have)).distinct().select("stream", F.date_format("day", "yyyy-MM-dd").alias("day"))


def q_venues(spark, sf_dir):
    """Windows and milliseconds collected per symbol, a column for each of three interval classes."""
    man = table(spark, sf_dir, "candle_manifest")
    kind = F.when(F.col("interval_ms") < 3_600_000, "minutes").when(F.col("interval_ms") < 86_400_000, "hours").otherwise("days")
    span = F.unix_millis("window_end") - F.unix_millis("window_start")
    return man.withColumn("kind", kind).withColumn("span", span).groupBy("venue").pivot("kind", ["minutes", "hours", "days"]).agg(F.count(F.lit(1)).alias("windows"), F.sum("span").alias("span"))


def q_names(spark, sf_dir):
    """A stream's name taken apart: base and quote currency, interval, venue, and a key of them."""
    s = table(spark, sf_dir, "candle_manifest").select("stream", "symbol", "venue").distinct()
    base = F.regexp_replace("symbol", "(USDT|USDC|USD|EUR)$", "")
    interval = F.substring_index("stream", ":", -1)
    return s.select("stream", base.alias("base"), F.substring(F.col("symbol"), F.length(base) + 1, F.lit(9)).alias("quote"), interval.alias("interval"), F.concat_ws("/", F.lower(base), F.upper("venue"), interval).alias("key"), F.length("symbol").alias("chars"))


def q_relations(spark, sf_dir):
    """Of every controller its peers (same section and layer, another cluster) and its children (same
    section, a lower layer) in the controller tree."""
    from tidewright.operators.consensus import structure

    t = cut(structure(spark, 3, 3, 4, 2))
    o = t.select(F.col("group").alias("g"), F.col("section").alias("s"), F.col("layer").alias("l"), F.col("cluster").alias("c"))
    same = (F.col("group") == F.col("g")) & (F.col("section") == F.col("s"))
    j = t.join(F.broadcast(o), same)  # 72 rows
    peer = (F.col("layer") == F.col("l")) & (F.col("cluster") != F.col("c"))
    return j.groupBy("group", "section", "layer", "cluster").agg(F.count_if(peer).alias("peers"), F.count_if(F.col("l") < F.col("layer")).alias("children"))


def q_fingerprints(spark, sf_dir):
    """FNV-1a over the bytes of every compatibility, as 8 hex digits."""
    mask = F.lit(4294967295)
    h = F.aggregate(F.split("compatibility", ""), F.lit(2166136261).cast("bigint"), lambda a, c: (a.bitwiseXOR(F.ascii(c).cast("bigint")) * F.lit(16777619)).bitwiseAND(mask))
    both = table(spark, sf_dir, "compat_positive").select("compatibility").unionByName(table(spark, sf_dir, "compat_negative").select("compatibility")).distinct()
    return both.select("compatibility", F.lpad(F.lower(F.hex(h)), 8, "0").alias("fingerprint"))


_FIELDS = ("open", "high", "low", "close", "volume")
FILTERS_SQL = "select stream, count(*) as rows, " + ", ".join(f"count_if({f} is not null and isfinite({f})) as valid_{f}" for f in _FIELDS) + ", count(ts) as valid_ts, " + f"""
  count_if(low < least(open, close) * 0.5 or high > greatest(open, close) * 1.5) as implausible, round(sum(case when volume is not null and isfinite(volume) then volume else 0 end), 3) as volume from candles group by 1"""
WICKS_SQL = "select row_id from candles where low < least(open, close) * 0.5 or high > greatest(open, close) * 1.5"
GRIDS_SQL = f"""with {BARS_SQL}, p as (select stream, arg_max(close, us) p from b group by 1), gd as (select *, least(8, greatest(2, ceil(log10(10 / 1e-4) - log10(p) - 1e-12)))::int k from p)
select stream, k as decimals, round(pow(10.0, -k), 9) as grid, floor(abs(p) * 100.0::double) / 100.0::double as cut from gd"""
STORE_SQL = f"""with n as (select row_id, stream, epoch_us(ts) us, ts, close, ingested_at, row_id % 5 = 0 fresh from candles where ts >= timestamptz '1980-01-01 00:00:00+00' and open > 0 and high > 0 and low > 0 and close > 0 and volume >= 0
  and high >= greatest(open, close, low) and low <= least(open, close)), o as (select *, row_number() over (partition by stream, us order by fresh desc, ingested_at desc nulls last, row_id desc) rn from n),
w as (select stream, max(interval_ms) * 1000 step from candle_manifest group by 1)
select o.stream, count(*) as bars, max(us) as last_us, round(sum(close), 4) as close, count_if(fresh) as updated from o join w on o.stream = w.stream where rn = 1 and us + step <= {STORE_US} group by 1"""
_NAMED = "case interval_ms " + " ".join(f"when {ms} then '{n}'" for n, ms in (("1m", 60_000), ("3m", 180_000), ("5m", 300_000), ("15m", 900_000), ("30m", 1_800_000), ("1h", 3_600_000), ("2h", 7_200_000), ("4h", 14_400_000), ("6h", 21_600_000), ("8h", 28_800_000), ("12h", 43_200_000), ("1d", 86_400_000))) + " end"
PLAN_SQL = f"""with {BARS_SQL}, w as (select stream, max(interval_ms) interval_ms, sum(ceil((epoch_us(window_end) - epoch_us(window_start)) / (interval_ms * 1000)))::bigint backfill from candle_manifest group by 1),
l as (select stream, max(us) // 1000 last_ms from b group by 1), j as (select w.*, coalesce(last_ms + interval_ms, 0) start_ms from w left join l using (stream))
select stream, {_NAMED} as "interval", start_ms, greatest(0, ceil(({NOW_US // 1000} - start_ms) / interval_ms))::bigint as "update", backfill from j"""
PAGES_SQL = f"""with {BARS_SQL}, s as (select unnest(['binance', 'bybit', 'coinbase', 'kraken']) source, unnest([1, 1, 1000, 1000]) unit)
select source, stream, count(*) as bars, min(us // (1000 * unit) * unit) as first_ms, max(us // (1000 * unit) * unit) as last_ms, arg_max(open, us) as open, max(high) as high, min(low) as low, arg_max(close, us) as close, round(sum(volume), 1) as volume from b, s group by 1, 2"""
FUNDING_LINES_SQL = f"with {_FUND} select distinct stream, us // 1000 * 1000 as us, rate, mark from f"
PANEL_FILES_SQL = f"with {_FUND} select stream as symbol, us // 28800000000 * 28800000 as ms, max(mark) as value from f where mark is not null group by 1, 2 having max(mark) > 0"

TAIL_SQL = f"with {BARS_SQL}, t as (select stream, us, close, row_number() over (partition by stream order by us desc) rn from b) select * from t where rn <= 3"
MISSING_SQL = f"""with {BARS_SQL}, c as (select distinct stream, unnest(generate_series(cast(window_start as date), cast(make_timestamp(epoch_us(window_end) - 1) as date), interval 1 day))::date as day from candle_manifest)
select stream, strftime(day, '%Y-%m-%d') as day from (select stream, day from c except select stream, make_timestamp(us)::date from b)"""
VENUES_SQL = "select venue, " + ", ".join(
    f"nullif(count_if({w}), 0) as {k}_windows, sum(epoch_ms(window_end) - epoch_ms(window_start)) filter (where {w})::bigint as {k}_span"
    for k, w in (("minutes", "interval_ms < 3600000"), ("hours", "interval_ms >= 3600000 and interval_ms < 86400000"), ("days", "interval_ms >= 86400000"))
) + " from candle_manifest group by 1"
NAMES_SQL = """with s as (select distinct stream, symbol, venue, regexp_replace(symbol, '(USDT|USDC|USD|EUR)$', '') b, split_part(stream, ':', -1) i from candle_manifest)
select stream, b as base, substring(symbol, length(b) + 1) as quote, i as "interval", lower(b) || '/' || upper(venue) || '/' || i as "key", length(symbol)::int as chars from s"""
RELATIONS_SQL = """with t as (select g.i::int g, s.i::int s, l.i::int l, c.i::int c from range(3) g(i), range(3) s(i), range(4) l(i), range(2) c(i))
select a.g as "group", a.s as section, a.l as layer, a.c as cluster, count_if(b.l = a.l and b.c <> a.c) as peers, count_if(b.l < a.l) as children from t a join t b on a.g = b.g and a.s = b.s group by 1, 2, 3, 4"""
FINGERPRINTS_SQL = """with u as (select compatibility from compat_positive union select compatibility from compat_negative),
h as (select compatibility, list_reduce(list_transform(string_split(compatibility, ''), lambda c: ascii(c)::bigint), lambda a, x: ((xor(a, x)::hugeint * 16777619) % 4294967296)::bigint, 2166136261::bigint) v from u)
select compatibility, lpad(lower(to_hex(v)), 8, '0') as fingerprint from h"""

QUERIES = {
    "candles_audit": (q_audit, AUDIT_SQL), "repaired_wicks": (q_repair, REPAIR_SQL), "bar_gaps": (q_gaps, GAPS_SQL), "bar_summary": (q_summary, SUMMARY_SQL),
    "resampled_bars": (q_resampled, RESAMPLE_SQL), "jsonl_round_trip": (q_jsonl, JSONL_SQL), "funding_audit": (q_funding_audit, FUNDING_SQL),
    "carry_asof": (q_carry, CARRY_SQL), "carry_view": (q_carry_view, VIEW_SQL),
    "row_filters": (q_filters, FILTERS_SQL), "implausible_wicks": (q_wicks, WICKS_SQL), "price_grids": (q_grids, GRIDS_SQL), "store_merge": (q_store, STORE_SQL), "fetch_plan": (q_plan, PLAN_SQL),
    "exchange_pages": (q_pages, PAGES_SQL), "funding_lines": (q_funding_lines, FUNDING_LINES_SQL), "panel_files": (q_panel_files, PANEL_FILES_SQL),
    "tail_bars": (q_tail, TAIL_SQL), "missing_days": (q_missing_days, MISSING_SQL), "venue_pivot": (q_venues, VENUES_SQL), "stream_names": (q_names, NAMES_SQL), "controller_relations": (q_relations, RELATIONS_SQL), "config_fingerprints": (q_fingerprints, FINGERPRINTS_SQL),
}
