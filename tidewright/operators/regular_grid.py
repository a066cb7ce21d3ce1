"""Problem 3: irregular readings onto a regular grid, holes interpolated or marked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import cut, join_small, table

#: Grid periods in one chunk of a window; chunks are the groups that are sorted.
CHUNK_SLOTS = 8192


def merged_windows(manifest: DataFrame) -> DataFrame:
    """``(w_stream, step, a, z, wid)``: each stream's windows in ms, overlapping ones made one.

    Windows with a null bound, no length or a step under 1 ms are left out.
    """
    w = manifest.select(
        F.col("stream").alias("w_stream"), F.col("interval_ms").alias("step"),
        F.expr("unix_micros(window_start) div 1000").alias("a"), F.expr("unix_micros(window_end) div 1000").alias("z"),
    ).where("step >= 1 and z > a")
    order = Window.partitionBy("w_stream", "step").orderBy("a", "z")
    w = w.withColumn("reach", F.max("z").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    w = w.withColumn("part", F.sum(F.when(F.col("reach") >= F.col("a"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return w.groupBy("w_stream", "step", "part").agg(F.min("a").alias("a"), F.max("z").alias("z")).drop("part")


def regular_grid(candles: DataFrame, manifest: DataFrame, fill_up_to: int = 5) -> DataFrame:
    """One row per grid period of each collection window:
    ``(stream, slot_ms, close, status)``.

    status: ``observed`` (the last reading of the period by ts, ingested_at, row_id),
    ``interpolated`` (hole of at most ``fill_up_to`` periods between two readings, on the line
    between them), ``gap`` (longer hole), ``before`` / ``after`` (ahead of the first or behind
    the last reading of the window); the last three have a null close.

    Consecutive readings are paired with lead inside chunks of the grid; the pairs across chunk
    edges come from one row per chunk. Only the periods between a pair are exploded, in two
    steps, so that a long hole is never one array. Rows without ts or close, or outside all
    windows, are no readings; NaN counts as null. A window without readings comes out whole
    as ``before``. Windows that overlap or repeat give each period once.
    """
    win = cut(merged_windows(manifest))
    rows = candles.select("row_id", "stream", F.expr("unix_micros(ts)").alias("us"), "close", "ingested_at").where("us is not null and close is not null and not isnan(close)")
    inside = (F.col("stream") == F.col("w_stream")) & (F.col("us") >= F.col("a") * 1000) & (F.col("us") < F.col("z") * 1000)
    rows = join_small(rows, win, inside)
    rows = rows.withColumn("slot", F.expr("(us div (step * 1000)) * step")).withColumn("chunk", F.expr(f"slot div (step * {CHUNK_SLOTS})"))
    key = ["stream", "step", "a", "z"]
    order = Window.partitionBy(*key, "chunk").orderBy("us", "ingested_at", "row_id")
    paired = rows.withColumn("next", F.lead("slot").over(order)).withColumn("next_close", F.lead("close").over(order))
    last_of_slot = paired.where(F.col("next").isNull() | (F.col("next") > F.col("slot")))
    observed = last_of_slot.select("stream", F.col("slot").alias("slot_ms"), "close", F.lit("observed").alias("status"))
    # the reading that stands for the next slot is that slot's last one, so its close is looked up among the kept rows
    kept = Window.partitionBy(*key, "chunk").orderBy("slot")
    holes_inside = (
        last_of_slot.withColumn("next", F.lead("slot").over(kept)).withColumn("next_close", F.lead("close").over(kept))
        .where(F.col("next") > F.col("slot") + F.col("step")).select(*key, F.col("slot").alias("lo"), F.col("close").alias("lo_close"), F.col("next").alias("hi"), F.col("next_close").alias("hi_close"))
    )
    reading = F.struct("slot", "us", "ingested_at", "row_id", "close")
    first_slot = rows.groupBy(*key, "chunk", "slot").agg(F.max(reading).alias("r")).groupBy(*key, "chunk").agg(F.min("r").alias("f"), F.max("r").alias("l"))
    edges = Window.partitionBy(*key).orderBy("chunk")
    chunks = first_slot.withColumn("nf", F.lead("f").over(edges)).withColumn("pl", F.lag("l").over(edges))
    between = chunks.where(F.col("nf.slot") > F.col("l.slot") + F.col("step")).select(*key, F.col("l.slot").alias("lo"), F.col("l.close").alias("lo_close"), F.col("nf.slot").alias("hi"), F.col("nf.close").alias("hi_close"))
    none, no_slot = F.lit(None).cast("double"), F.lit(None).cast("bigint")
    before = chunks.where(F.col("pl").isNull() & (F.col("f.slot") > F.col("a"))).select(*key, no_slot.alias("lo"), none.alias("lo_close"), F.col("f.slot").alias("hi"), F.col("f.close").alias("hi_close"))
    after = chunks.where(F.col("nf").isNull() & (F.col("l.slot") + F.col("step") < F.col("z"))).select(*key, F.col("l.slot").alias("lo"), F.col("l.close").alias("lo_close"), no_slot.alias("hi"), none.alias("hi_close"))
    seen = first_slot.select(F.col("stream").alias("s"), F.col("step").alias("st"), F.col("a").alias("sa")).distinct()
    never = win.join(seen, (F.col("w_stream") == F.col("s")) & (F.col("step") == F.col("st")) & (F.col("a") == F.col("sa")), "left_anti").select(
        F.col("w_stream").alias("stream"), "step", "a", "z", no_slot.alias("lo"), none.alias("lo_close"), no_slot.alias("hi"), none.alias("hi_close"))
    holes = holes_inside.unionByName(between).unionByName(before).unionByName(after).unionByName(never)
    holes = holes.withColumn("from", F.coalesce(F.col("lo") + F.col("step"), F.col("a"))).withColumn("to", F.coalesce(F.col("hi"), F.col("z")) - F.col("step")).where(F.col("from") <= F.col("to"))
    block = F.col("step") * CHUNK_SLOTS
    blocks = holes.withColumn("b", F.explode(F.sequence("from", "to", block)))
    slots = blocks.withColumn("slot_ms", F.explode(F.sequence("b", F.least("to", F.col("b") + block - F.col("step")), "step")))
    missing = F.expr("(to - from) div step + 1")
    both = F.col("lo").isNotNull() & F.col("hi").isNotNull()
    status = F.when(F.col("lo").isNull(), "before").when(F.col("hi").isNull(), "after").when(missing <= fill_up_to, "interpolated").otherwise("gap")
    line = F.col("lo_close") + (F.col("hi_close") - F.col("lo_close")) * ((F.col("slot_ms") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    filled = slots.select("stream", "slot_ms", F.when(both & (missing <= fill_up_to), line).alias("close"), status.alias("status"))
    return observed.unionByName(filled)


def p3_grid(spark, sf_dir: str) -> DataFrame:
    out = regular_grid(table(spark, sf_dir, "candles"), table(spark, sf_dir, "candle_manifest"))
    return out.withColumn("close", F.round("close", 9))


def p3_found(spark, sf_dir: str) -> DataFrame:
    """Grid periods without a reading: the operator's rows that are not observed."""
    out = regular_grid(table(spark, sf_dir, "candles"), table(spark, sf_dir, "candle_manifest"))
    return out.where("status <> 'observed'").select("stream", "slot_ms")


P3_FOUND_SQL = """
with w as (select distinct stream, interval_ms i, unnest(generate_series(epoch_ms(window_start), epoch_ms(window_end) - 1, interval_ms)) slot_ms from candle_manifest),
r as (select distinct c.stream, (epoch_us(ts) // (m.i * 1000)) * m.i slot_ms from candles c
  join (select distinct stream, interval_ms i from candle_manifest) m on m.stream = c.stream where ts is not null and close is not null)
select distinct w.stream, w.slot_ms from w where not exists (select 1 from r where r.stream = w.stream and r.slot_ms = w.slot_ms)
"""

P3_GRID_SQL = """
with w as (select distinct stream, interval_ms i, epoch_ms(window_start) a, epoch_ms(window_end) z from candle_manifest),
r as (select w.stream, w.i, w.a, w.z, (epoch_us(ts) // (w.i * 1000)) * w.i slot, close,
    row_number() over (partition by w.stream, w.a, epoch_us(ts) // (w.i * 1000) order by ts desc, ingested_at desc, row_id desc) rn
  from candles c join w on w.stream = c.stream and epoch_ms(ts) >= w.a and epoch_ms(ts) < w.z where close is not null),
k as (select * from r where rn = 1),
g as (select stream, i, a, z, unnest(generate_series(a, z - 1, i)) slot from w),
j as (select g.*, k.close, k.slot ks,
    max(k.slot) over (partition by g.stream, g.a order by g.slot rows between unbounded preceding and current row) lo,
    min(k.slot) over (partition by g.stream, g.a order by g.slot rows between current row and unbounded following) hi
  from g left join k on k.stream = g.stream and k.a = g.a and k.slot = g.slot)
select j.stream, j.slot as slot_ms,
  round(case when j.ks is not null then j.close when lo is not null and hi is not null and (hi - lo) // j.i - 1 <= 5
    then l.close + (h.close - l.close) * ((j.slot - lo)::double / (hi - lo)::double) end, 9) as close,
  case when j.ks is not null then 'observed' when lo is null then 'before' when hi is null then 'after'
    when (hi - lo) // j.i - 1 <= 5 then 'interpolated' else 'gap' end as status
from j left join k l on l.stream = j.stream and l.a = j.a and l.slot = lo left join k h on h.stream = j.stream and h.a = j.a and h.slot = hi
"""
