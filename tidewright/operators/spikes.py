"""Problem 1: implausible spikes, stuck values and impossible readings, per source.

Peaks over threshold: each reading is divided by its source's level for that hour of the
day, a generalised Pareto tail is fitted to what exceeds a high quantile of these seasonal
residuals, and the cutoff is the tail's quantile at a fixed risk. Rules for stuck values
and for values that cannot be true stand beside it.

The table is read three times: for histograms of range and volume, for the residuals' histogram
with the middle values, and for the flags, which share one shuffle with the stuck runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.medians import CELLS_PER_OCTAVE, log_cell, middle_cells, middle_values
from tidewright.session import cut, join_small, table

STUCK_FIELDS = ("open", "high", "low", "volume")
#: What may spike, in the order in which the fitted cutoffs are held.
MEASURES = ("high", "low", "open", "volume")
#: First plausible stamp, 1980-01-01 UTC, in microseconds; earlier ones are in the wrong unit.
FIRST_US = 315_532_800_000_000
#: Cells per octave of the residuals' histogram: fine from half a level up, coarse below.
FINE, COARSE = 64, 4
#: Bytes a source's profile takes, for the check before it is broadcast.
PROFILE_BYTES = 1024


@dataclass(frozen=True)
class SpikeRules:
    """Parameters. The tail begins at the quantile ``tail`` of the residuals; ``risk`` is the
    chance of a sound reading beyond the cutoff, ``shape_most`` the heaviest tail believed.
    ``range_ceiling`` and ``volume_ceiling`` bound the fitted cutoffs from above, in medians of
    the source, and stand alone where fewer than ``fewest_peaks`` peaks exist."""

    tail: float = 0.95
    risk: float = 1e-4
    fewest_peaks: int = 20
    shape_most: float = 0.5
    range_ceiling: float = 12.0
    volume_ceiling: float = 40.0
    stuck_bars: int = 5
    chunk_bars: int = 8192


def _clean(x: str) -> Column:
    return F.when(~F.isnan(F.col(x)), F.col(x))


def _readings(candles: DataFrame) -> DataFrame:
    return candles.select("row_id", "stream", F.unix_micros("ts").alias("us"), *[_clean(c).alias(c) for c in ("open", "high", "low", "close", "volume")])


def _measures() -> dict[str, Column]:
    """What may spike, each against the source's typical range or volume. Nulls drop out of
    greatest and least, so a bar without its open is judged by its close."""
    o, c = F.col("open"), F.col("close")
    return {
        "high": F.col("high") - F.greatest(o, c),
        "low": F.least(o, c) - F.col("low"),
        "open": F.abs(o - c),
        "volume": F.col("volume"),
    }


def impossible(p: str = "") -> Column:
    """Values that no source can print; a null operand never makes a reading impossible."""
    o, h, lo, c, v = (F.col(p + x) for x in ("open", "high", "low", "close", "volume"))
    tests = [o <= 0, h <= 0, lo <= 0, v < 0, h < lo, o < lo, o > h, c < lo, c > h]
    return F.array_contains(F.array(*[F.coalesce(t, F.lit(False)) for t in tests]), True)


def _slot() -> Column:
    """1 to 24 for the hour of the day, 25 where the stamp is missing: the place in a profile's levels."""
    return F.coalesce(F.expr("pmod(us div 3600000000, 24) + 1"), F.lit(25)).cast("int")


def _histograms(rows: DataFrame) -> DataFrame:
    """First reading of the table: ``(k, m, cell, n, logs, a, z)``. m is 0 for ranges and 1 for volumes
    by log cell, 2 and 3 for the same by hour with the sum of their cells, 4 for stamps by
    stretches of about 13 days with the first and last stamp."""
    spread, volume, none = F.col("high") - F.col("low"), F.col("volume"), F.lit(None).cast("bigint")
    # cells first, as columns of their own: a generator does not share what its expressions repeat
    cells = rows.select(
        F.col("stream").alias("k"), log_cell(spread).alias("rc"), spread.isNotNull().alias("r"), (spread > 0).alias("rp"), log_cell(volume).alias("vc"), volume.isNotNull().alias("v"), (volume > 0).alias("vp"),
        _slot().cast("bigint").alias("slot"), F.when(F.col("us") >= FIRST_US, F.col("us")).alias("us"), F.shiftright("us", 40).alias("span"),
    )

    def entry(m: int, cell: str, when: Column, logs: Column = none, us: Column = none) -> Column:
        return F.struct(F.when(when, F.lit(m)).alias("m"), F.col(cell).alias("cell"), logs.alias("logs"), us.alias("us"))

    parts = [
        entry(0, "rc", F.col("r")), entry(1, "vc", F.col("v")), entry(2, "slot", F.col("rp"), F.col("rc") - 1_000_000), entry(3, "slot", F.col("vp"), F.col("vc") - 1_000_000),
        entry(4, "span", F.col("us").isNotNull(), none, F.col("us")),
    ]
    long = cells.select("k", F.inline(F.array(*parts))).where("m is not null")
    return long.groupBy("k", "m", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("logs").alias("logs"), F.min("us").alias("a"), F.max("us").alias("z"))


def _widths(stamps: DataFrame, rules: SpikeRules) -> DataFrame:
    """``(s, width)`` from ``(k, cell, n, a, z)``: the stretch of time in which a source has about
    ``chunk_bars`` bars, judged between the 2nd and the 98th hundredth of its stamps."""
    by = Window.partitionBy("k")
    ranked = stamps.withColumn("upto", F.sum("n").over(by.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(by))
    inner = (F.col("upto") >= F.col("total") * 0.02) & (F.col("upto") - F.col("n") <= F.col("total") * 0.98)
    span = ranked.where(inner).groupBy("k").agg(F.max("total").alias("total"), F.sum("n").alias("n"), (F.max("z") - F.min("a")).alias("span"))
    width = F.when(F.col("total") > rules.chunk_bars, F.greatest(F.lit(1), F.ceil(F.col("span") * rules.chunk_bars / F.col("n")))).otherwise(F.lit(1 << 62)).cast("bigint")
    return span.select(F.col("k").alias("s"), width.alias("width"))


def _chunked(rows: DataFrame) -> DataFrame:
    """Adds ``chunk``, the stretch of time of a row's ``width``; rows without a plausible stamp get negative ones."""
    stray = -1 - F.pmod(F.xxhash64("row_id"), F.lit(1024))
    return rows.withColumn("chunk", F.when(F.col("us") >= FIRST_US, F.expr("us div width")).otherwise(stray))


def _held(rows: DataFrame, kept: list[str]) -> DataFrame:
    """Rows of ``_chunked`` that may belong to a stuck stretch, or have ``flags``: with
    ``bar``, ``first_bar``, ``last_bar`` and in ``f_...`` the fields' values where the neighbouring
    bars may hold them too.

    Where every bar has one row this is plain equality with a neighbour; where a stamp repeats, the
    value must lie within the neighbour's values, which loses none.
    """
    here = Window.partitionBy("stream", "chunk")
    moving = F.coalesce(F.col("volume") != 0, F.lit(True))
    rows = rows.withColumn("bar", F.dense_rank().over(here.orderBy("us"))).withColumns({f"f_{c}": F.when(moving, F.col(c)) for c in STUCK_FIELDS})
    sides = {"p": here.orderBy("bar").rangeBetween(-1, -1), "q": here.orderBy("bar").rangeBetween(1, 1)}
    seen = {f"{s}_{e}_{c}": agg(f"f_{c}").over(w) for s, w in sides.items() for c in STUCK_FIELDS for e, agg in (("lo", F.min), ("hi", F.max))}
    rows = rows.withColumns(seen | {"first_bar": F.col("bar") == 1, "last_bar": F.count(F.lit(1)).over(sides["q"]) == 0})

    def near(c: str) -> Column:
        between = [(F.col(f"f_{c}") >= F.col(f"{s}_lo_{c}")) & (F.col(f"f_{c}") <= F.col(f"{s}_hi_{c}")) for s in sides]
        return F.coalesce(between[0], F.lit(False)) | F.coalesce(between[1], F.lit(False)) | F.col("first_bar") | F.col("last_bar")

    timed = F.col("chunk") >= 0
    rows = rows.withColumns({f"f_{c}": F.when(timed & near(c), F.col(f"f_{c}")) for c in STUCK_FIELDS})
    some = F.coalesce(*[F.col(f"f_{c}") for c in STUCK_FIELDS]).isNotNull() | (timed & (F.col("first_bar") | F.col("last_bar")))
    if "flags" in kept:
        some = some | F.col("flags").isNotNull()
    return rows.where(some).select("row_id", "stream", "chunk", "bar", "first_bar", "last_bar", *[f"f_{c}" for c in STUCK_FIELDS], *kept)


def _stuck(held: DataFrame, rules: SpikeRules) -> DataFrame:
    """``(row_id, field, value, bars)`` from ``_held``; only runs at the edge of a chunk are joined across chunks."""
    chunk = ["stream", "chunk"]
    held = held.where("chunk >= 0")
    long = held.select(
        "row_id", *chunk, "bar", "first_bar", "last_bar",
        F.inline(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"f_{c}").alias("v")) for i, c in enumerate(STUCK_FIELDS)])),
    ).where(F.col("v").isNotNull())
    value = [*chunk, "f", "v"]
    runs = long.withColumn("island", F.col("bar") - F.dense_rank().over(Window.partitionBy(*value).orderBy("bar")))
    run = Window.partitionBy(*value, "island")
    runs = runs.withColumn("first", F.min("bar").over(run)).withColumn("bars", F.max("bar").over(run) - F.col("first") + 1)
    runs = runs.withColumn("opens", F.max("first_bar").over(run)).withColumn("closes", F.max("last_bar").over(run))
    kept = cut(runs.where((F.col("bars") >= rules.stuck_bars) | F.col("opens") | F.col("closes")).select("row_id", *value, "first", "bars", "opens", "closes"))
    place = held.select(*chunk).distinct().withColumn("seq", F.row_number().over(Window.partitionBy("stream").orderBy("chunk"))).select(F.col("stream").alias("s"), F.col("chunk").alias("c"), "seq")
    edge = kept.where(F.col("opens") | F.col("closes")).groupBy(*value, "first").agg(F.min("bars").alias("bars"), F.min("opens").alias("opens"), F.min("closes").alias("closes"))
    edge = edge.join(place, F.col("stream").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    over = Window.partitionBy("stream", "f", "v").orderBy("seq", "first")
    linked = F.col("opens") & F.coalesce(F.lag("closes").over(over) & (F.lag("seq").over(over) == F.col("seq") - 1), F.lit(False))
    joined = (
        edge.withColumn("begins", F.when(linked, 0).otherwise(1)).withColumn("chain", F.sum("begins").over(over.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("total", F.sum("bars").over(Window.partitionBy("stream", "f", "v", "chain")))
        .where(F.col("total") >= rules.stuck_bars)
        .select(F.col("stream").alias("es"), F.col("chunk").alias("ec"), F.col("f").alias("ef"), F.col("v").alias("ev"), F.col("first").alias("efirst"), "total")
    )
    same = F.col("stream").eqNullSafe(F.col("es")) & (F.col("chunk") == F.col("ec")) & (F.col("f") == F.col("ef")) & (F.col("v") == F.col("ev")) & (F.col("first") == F.col("efirst"))
    out = kept.join(joined, same, "left").withColumn("length", F.greatest("bars", F.coalesce("total", F.lit(0))))
    field = F.element_at(F.array(*[F.lit(c) for c in STUCK_FIELDS]), F.col("f") + 1)
    return out.where(F.col("length") >= rules.stuck_bars).select("row_id", field.alias("field"), F.col("v").alias("value"), F.col("length").cast("double").alias("bars"))


def stuck_readings(rows: DataFrame, rules: SpikeRules = SpikeRules()) -> DataFrame:
    """Rows ``(row_id, field, value, bars)`` whose field keeps one value over ``stuck_bars`` or
    more consecutive bars of the source.

    ``rows`` has row_id, stream, us and the fields. Rows of one stamp are one bar. Null values
    end a stretch; a row of zero volume is quiet: none of its fields is stuck, and it ends a
    stretch; rows without a plausible stamp are left aside. Long sources are cut into stretches of
    time of about ``chunk_bars`` bars, each a separate group.
    """
    rows = rows.select("row_id", "stream", "us", *STUCK_FIELDS).where(F.col("us") >= FIRST_US)
    stamps = rows.groupBy(F.col("stream").alias("k"), F.shiftright("us", 40).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("a"), F.max("us").alias("z"))
    timed = join_small(rows, cut(_widths(stamps, rules)), F.col("stream").eqNullSafe(F.col("s")))
    return _stuck(cut(_held(_chunked(timed), [])), rules)


def _residual_cell(x: Column, level: Column) -> Column:
    """Histogram cell of a residual ``x / 2**level``; null where either is missing, the lowest for what is not positive."""
    r = F.log2(x) - level
    return F.when(x.isNull() | level.isNull(), None).when(x <= 0, F.lit(-(1 << 40))).when(r < -1, F.floor(r * COARSE) * 10_000).otherwise(F.floor(r * FINE)).cast("bigint")


def _tails(hist: DataFrame, rules: SpikeRules) -> DataFrame:
    """``(zs, z_...)``: the fitted cutoff of each source and measure, as a residual.

    hist is ``(k, m, cell, n)`` of residual cells. The generalised Pareto tail is fitted by three
    of its quantiles (Pickands, 1975): at the tail's begin, its half and its quarter. Errors that
    make up less than a quarter of the tail's readings move none of them, unlike moments.
    """
    by = Window.partitionBy("k", "m")
    ranked = hist.withColumn("upto", F.sum("n").over(by.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(by))
    depth = 1 - rules.tail
    places = {"q0": 1 - depth, "q1": 1 - depth / 2, "q2": 1 - depth / 4}
    # the residual below which a share lies, linear within its cell
    edge = F.pow(F.lit(2.0), F.col("cell") / FINE)
    got = []
    for q, share in places.items():
        want = F.col("total") * F.lit(share)
        inside = (F.col("upto") >= want) & (F.col("upto") - F.col("n") < want)
        at = edge * (1 + (F.pow(F.lit(2.0), F.lit(1.0 / FINE)) - 1) * (want - (F.col("upto") - F.col("n"))) / F.col("n"))
        got.append(F.max(F.when(inside & (F.col("cell") >= -FINE), at)).alias(q))
    fit = ranked.groupBy("k", "m").agg(F.max("total").alias("total"), *got)
    low, high = F.col("q1") - F.col("q0"), F.col("q2") - F.col("q1")
    shape = F.greatest(F.lit(0.01), F.least(F.lit(rules.shape_most), F.coalesce(F.log2(F.try_divide(high, low)), F.lit(0.01))))
    beyond = low / (F.pow(F.lit(2.0), shape) - 1) * (F.pow(F.lit(rules.risk / depth), -shape) - 1)
    cutoff = F.when(F.col("total") * depth >= rules.fewest_peaks, F.col("q0") + F.greatest(F.lit(0.0), beyond))
    fit = fit.select("k", "m", cutoff.alias("z"))
    return fit.groupBy(F.col("k").alias("zs")).agg(*[F.max(F.when(F.col("m") == i, F.col("z"))).alias(f"z_{m}") for i, m in enumerate(MEASURES)])


def profiles(rows: DataFrame, rules: SpikeRules = SpikeRules()) -> DataFrame:
    """What is normal for each source, one row each: ``s``, ``width``, ``price_level`` and
    ``volume_level`` (logarithms to base 2 by hour, the 25th for rows without a stamp),
    ``range_median``, ``volume_median`` and the fitted cutoffs ``z_...`` as residuals."""
    first = cut(_histograms(rows))
    middle = middle_cells(first.where("m < 2").select("k", "m", "cell", "n"))
    middle = middle.groupBy("hk").agg(F.collect_list(F.struct("hm", "hc", "below", "lo", "hi")).alias("middle"), F.collect_list(F.col("hc") * 2 + F.col("hm")).alias("codes"))
    hours = first.where("m in (2, 3)").groupBy("k").agg(*[
        F.array(*[F.max(F.when((F.col("m") == m) & (F.col("cell") == h), F.col("logs") / F.col("n") / CELLS_PER_OCTAVE)) for h in range(1, 26)]).alias(c)
        for m, c in ((2, "price_level"), (3, "volume_level"))
    ])
    keys = first.select(F.col("k").alias("s")).distinct()
    widths = _widths(first.where("m = 4"), rules).withColumnRenamed("s", "ws")
    start = keys.join(widths, F.col("s").eqNullSafe(F.col("ws")), "left").join(middle, F.col("s").eqNullSafe(F.col("hk")), "left")
    start = cut(start.join(hours, F.col("s").eqNullSafe(F.col("k")), "left").select("s", "width", "middle", "codes", "price_level", "volume_level"))
    known = join_small(rows, start.drop("middle"), F.col("stream").eqNullSafe(F.col("s")), row_bytes=PROFILE_BYTES)
    values, parts = {"range": F.col("high") - F.col("low"), "volume": F.col("volume")}, []
    columns = {}
    for m, (c, x) in enumerate(values.items()):
        columns |= {f"c_{c}": log_cell(x), f"x_{c}": F.when(F.array_contains("codes", log_cell(x) * 2 + m), x)}
        parts.append(F.struct(F.when(F.col(f"x_{c}").isNotNull(), F.lit(m)).alias("m"), F.col(f"c_{c}").alias("cell"), F.col(f"x_{c}").alias("x")))
    for i, (c, x) in enumerate(_measures().items()):
        columns[f"r_{c}"] = _residual_cell(x, F.element_at("volume_level" if c == "volume" else "price_level", _slot()))
        parts.append(F.struct(F.when(F.col(f"r_{c}").isNotNull(), F.lit(2 + i)).alias("m"), F.col(f"r_{c}").alias("cell"), F.lit(None).cast("double").alias("x")))
    cells = known.select(F.col("stream").alias("k"), *[x.alias(c) for c, x in columns.items()])
    second = cells.select("k", F.inline(F.array(*parts))).where("m is not null").groupBy("k", "m", "cell", "x").agg(F.count(F.lit(1)).alias("n"))
    second = cut(second)
    counted = second.where("m < 2").join(start.select("s", F.inline("middle")), F.col("k").eqNullSafe(F.col("s")) & (F.col("m") == F.col("hm")) & (F.col("cell") == F.col("hc")))
    medians = middle_values(counted.select("k", "m", "x", "n", "below", "lo", "hi"), ["range_median", "volume_median"]).withColumnRenamed("k", "ms")
    tails = _tails(second.where("m >= 2").select("k", (F.col("m") - 2).alias("m"), "cell", "n"), rules)
    out = start.drop("middle", "codes").join(medians, F.col("s").eqNullSafe(F.col("ms")), "left").join(tails, F.col("s").eqNullSafe(F.col("zs")), "left")
    return cut(out.drop("ms", "zs"))


def implausible_readings(candles: DataFrame, rules: SpikeRules = SpikeRules()) -> DataFrame:
    """Flag implausible readings: ``(row_id, field, kind, value, cutoff, median)``.

    kind is ``spike`` (beyond the lower of the fitted cutoff and the ceiling; ``value`` is the
    excess, ``median`` the source's own median range or volume), ``stuck`` (``value`` the value,
    ``cutoff`` the length of the stretch) or ``impossible``. A row may be flagged more than once.

    Null values are never flagged, NaN counts as null, a null source is a source of its own;
    repeated rows are judged one by one; an empty table gives no rows. Other columns of the
    table are ignored.
    """
    rows = _readings(candles)
    rows = join_small(rows, profiles(rows, rules), F.col("stream").eqNullSafe(F.col("s")), "left", PROFILE_BYTES)
    none, judged, flags = F.lit(None).cast("double"), {"bad": impossible()}, []
    for m, x in _measures().items():
        mid = F.col("volume_median" if m == "volume" else "range_median")
        level = F.pow(F.lit(2.0), F.element_at("volume_level" if m == "volume" else "price_level", _slot()))
        judged |= {f"x_{m}": x, f"cut_{m}": F.least(F.col(f"z_{m}") * level, mid * (rules.volume_ceiling if m == "volume" else rules.range_ceiling)), f"mid_{m}": mid}
        over = F.struct(F.lit(m).alias("field"), F.lit("spike").alias("kind"), F.col(f"x_{m}").alias("value"), F.col(f"cut_{m}").alias("cutoff"), F.col(f"mid_{m}").alias("median"))
        flags.append((F.col(f"x_{m}") > F.col(f"cut_{m}"), over))
    flags.append((F.col("bad"), F.struct(F.lit("bar").alias("field"), F.lit("impossible").alias("kind"), none.alias("value"), none.alias("cutoff"), none.alias("median"))))
    # what is judged first, as columns of its own, so that the flags do not compute it again
    rows = _chunked(rows).select("row_id", "stream", "us", "chunk", *STUCK_FIELDS, *[x.alias(c) for c, x in judged.items()])
    some = F.coalesce(F.greatest(*[hit for hit, _ in flags]), F.lit(False))
    rows = rows.withColumn("flags", F.when(some, F.array(*[F.when(hit, flag) for hit, flag in flags])))
    held = cut(_held(rows.select("row_id", "stream", "us", "chunk", *STUCK_FIELDS, "flags"), ["flags"]))
    stuck = _stuck(held, rules).select("row_id", "field", F.lit("stuck").alias("kind"), "value", F.col("bars").alias("cutoff"), none.alias("median"))
    return held.select("row_id", F.inline("flags")).where("field is not null").unionByName(stuck)


def p1_flags(spark, sf_dir: str) -> DataFrame:
    """Every flag of the operator, spikes by the fitted cutoffs: ``(row_id, field, kind)``."""
    return implausible_readings(table(spark, sf_dir, "candles")).select("row_id", "field", "kind")


def p1_found(spark, sf_dir: str) -> DataFrame:
    """Rows with a wrong reading: the operator's flags, spikes then checked against the fixed multiples of the median."""
    rules = SpikeRules()
    flags = implausible_readings(table(spark, sf_dir, "candles"), rules)
    times = F.when(F.col("field") == "volume", F.lit(rules.volume_ceiling)).otherwise(F.lit(rules.range_ceiling))
    exact = (F.col("kind") != "spike") | (F.col("value") > times * F.col("median"))
    return flags.where(exact).select("row_id").distinct()


#: The clauses of the problem one by one: (a) impossible, (b) multiples of the medians, (c) five bars of one value, none of them quiet.
P1_SQL = """
with m as (select stream, median(high - low) r, median(volume) v from candles group by stream),
rule_ab as (
  select row_id from candles c join m on c.stream is not distinct from m.stream
  where open <= 0 or high <= 0 or low <= 0 or volume < 0 or high < low
     or open < low or open > high or close < low or close > high
     or high - greatest(open, close) > 12 * r or least(open, close) - low > 12 * r
     or abs(open - close) > 12 * r or volume > 40 * v),
timed as (select *, dense_rank() over (partition by stream order by ts) bar from candles where ts >= timestamptz '1980-01-01 00:00:00+00'),
moving as (select * from timed where volume is null or volume <> 0),
long as (
  select row_id, stream, bar, 'o' f, open x from moving union all
  select row_id, stream, bar, 'h', high from moving union all
  select row_id, stream, bar, 'l', low from moving union all
  select row_id, stream, bar, 'v', volume from moving),
runs as (select *, bar - dense_rank() over (partition by stream, f, x order by bar) g from long where x is not null),
sized as (select row_id, max(bar) over w - min(bar) over w + 1 n from runs window w as (partition by stream, f, x, g))
select row_id from rule_ab union select row_id from sized where n >= 5
"""
