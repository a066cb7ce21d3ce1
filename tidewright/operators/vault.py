"""The prototype vault: distances, decay, merging, promotion, purging, lookups and the edge graph."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import cut, join_small, table

LEAST_VARIANCE = 1e-8


def gaussian_distance(m1: Column, v1: Column, m2: Column, v2: Column) -> Column:
    """Bhattacharyya distance of Gaussians with diagonal covariance; null for unlike lengths."""
    n = F.size(m1)
    at = F.sequence(F.lit(0), n - 1)

    def term(i):
        p, q = F.greatest(F.get(v1, i), F.lit(LEAST_VARIANCE)), F.greatest(F.get(v2, i), F.lit(LEAST_VARIANCE))
        mid, d = (p + q) / 2, F.get(m1, i) - F.get(m2, i)
        return d * d / mid / 8 + F.ln(mid / F.sqrt(p * q)) / 2

    return F.when((n == F.size(m2)) & (n > 0), F.aggregate(F.transform(at, term), F.lit(0.0), lambda s, x: s + x))


def content_hash(mean: Column) -> Column:
    """FNV-1a over the vector in units of 1e-4, as 8 hex digits."""
    mask = F.lit(4294967295)
    start = F.lit(2166136261).cast("bigint")

    def step(h, x):
        v = F.floor(x * 10000 + 0.5).cast("bigint").bitwiseAND(mask)
        return (h.bitwiseXOR(v) * F.lit(16777619).cast("bigint")).bitwiseAND(mask)

    h = F.aggregate(mean, start, step)
    return F.lpad(F.lower(F.hex(h % mask)), 8, "0")


def decayed(protos: DataFrame, now: int, factor: float = 0.995, floor: float = 0.1) -> DataFrame:
    """size, access_count and importance shrink with the age in batches, not below ``floor``."""
    age = F.greatest(F.lit(0), now - F.col("last_accessed"))
    shrink = F.pow(F.lit(factor), age)
    return protos.withColumns({c: F.when(age > 0, F.greatest(F.lit(floor), F.col(c) * shrink)).otherwise(F.col(c)) for c in ("size", "access_count", "importance")})


def distinct_protos(protos: DataFrame) -> DataFrame:
    """Repeated rows of a prototype made one: the largest counts of use."""
    w = Window.partitionBy("proto_id").orderBy(F.col("usage_count").desc_nulls_last(), F.col("access_count").desc_nulls_last())
    return protos.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def ranked_per_compat(protos: DataFrame) -> DataFrame:
    """Adds ``rn``, the place by importance within the compat_id."""
    w = Window.partitionBy("compat_id").orderBy(F.col("importance").desc_nulls_last(), F.col("access_count").desc_nulls_last(), F.col("last_accessed").desc_nulls_last(), "proto_id")
    return protos.withColumn("rn", F.row_number().over(w))


def top_per_compat(protos: DataFrame, n: int) -> DataFrame:
    """The ``n`` most important of each compat_id; Spark keeps n rows a partition before the shuffle."""
    return ranked_per_compat(protos).where(F.col("rn") <= n)


def globally_ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``rank``, the position from 1 in a total order: a distributed sort, then each sorted
    part's start from the counts of the parts before it. No task sees more than its part."""
    row_in_part = F.monotonically_increasing_id()
    done = cut(rows.orderBy(*order).withColumn("_id", row_in_part))
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = done.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_start"))
    return join_small(done.withColumn("_p", part), cut(starts), F.col("_p") == F.col("_part")).withColumn("rank", F.col("_start") + at + 1).drop("_id", "_p", "_part", "_start")


def purge_lowest(protos: DataFrame, capacity: int) -> DataFrame:
    """The rows over capacity that are to go, least important first."""
    order = [F.col(c).asc_nulls_first() for c in ("importance", "size", "access_count", "last_accessed")]
    over = max(0, protos.count() - capacity)
    return globally_ranked(protos, [*order, F.col("proto_id").asc()]).where(F.col("rank") <= over)


def merge_frame(pdf: pd.DataFrame, threshold: float, now: int) -> pd.DataFrame:
    """Greedy merging inside one group, most important first: each survivor takes in every later
    prototype nearer than ``threshold``, weighted by size, its mean moving as it goes."""
    pdf = pdf.sort_values(["importance", "size", "proto_id"], ascending=[False, False, True], na_position="last").reset_index(drop=True)
    m, v = np.stack(pdf["mean"]).astype(float), np.maximum(np.stack(pdf["variance"]).astype(float), LEAST_VARIANCE)
    size, merged = pdf["size"].to_numpy(float).copy(), pdf["merged_count"].to_numpy(int).copy()
    live, touched = np.ones(len(pdf), bool), np.zeros(len(pdf), bool)
    for i in range(len(pdf)):
        if not live[i]:
            continue
        at = i + 1
        while True:
            later = np.flatnonzero(live[at:]) + at
            if not len(later):
                break
            mid = (v[i] + v[later]) / 2
            d = ((m[i] - m[later]) ** 2 / mid).sum(1) / 8 + np.log(mid / np.sqrt(v[i] * v[later])).sum(1) / 2
            near = later[d < threshold]
            if not len(near):
                break
            j = int(near[0])
            a, b = size[i], size[j]
            new = (a * m[i] + b * m[j]) / (a + b)
            v[i] = np.maximum((a * (v[i] + (m[i] - new) ** 2) + b * (v[j] + (m[j] - new) ** 2)) / (a + b), LEAST_VARIANCE)
            m[i], size[i] = new, a + b
            merged[i] += merged[j]
            live[j], touched[i], at = False, True, j + 1
    out = pdf.loc[live, ["proto_id", "compat_id"]].copy()
    out["size"], out["merged_count"], out["changed"] = size[live], merged[live], touched[live]
    return out


def merged(protos: DataFrame, threshold: float = 0.5, now: int = 4000, most: int = 1000) -> DataFrame:
    """Consolidation of the ``most`` most important prototypes of every compat_id, chosen before they
    decay; those beyond come out as they are stored. The order makes it sequential, and the cap,
    part of the operation (volatileConsolidationLimit), bounds a group."""
    usable = distinct_protos(protos.where("variance is not null and importance is not null and last_accessed is not null"))
    rows = cut(ranked_per_compat(usable).select("proto_id", "compat_id", "mean", "variance", "size", "access_count", "importance", "last_accessed", "merged_count", "rn"))
    top = decayed(rows.where(F.col("rn") <= most), now).select("proto_id", "compat_id", "mean", "variance", "size", "importance", "merged_count")
    done = top.groupBy("compat_id").applyInPandas(lambda pdf: merge_frame(pdf, threshold, now), "proto_id string, compat_id int, size double, merged_count int, changed boolean")
    return done.unionByName(rows.where(F.col("rn") > most).select("proto_id", "compat_id", "size", "merged_count", F.lit(False).alias("changed")))


def promotions(protos: DataFrame, least: int = 5) -> DataFrame:
    return protos.where(F.col("merged_count") >= least)


def hierarchy_frame(pdf: pd.DataFrame, least: int, most: int) -> pd.DataFrame:
    """Edges to the nearest neighbours, fewer for the less important, both ways."""
    pdf = pdf.sort_values("rn").reset_index(drop=True)
    n = len(pdf)
    m, v = np.stack(pdf["mean"]).astype(float), np.maximum(np.stack(pdf["variance"]).astype(float), LEAST_VARIANCE)
    ids, rows = pdf["proto_id"].to_numpy(), []
    for i in range(n if n > 1 else 0):
        mid = (v[i] + v) / 2
        d = ((m[i] - m) ** 2 / mid).sum(1) / 8 + np.log(mid / np.sqrt(v[i] * v)).sum(1) / 2
        d[i] = np.inf
        k = min(max(1, int(np.floor(least + (most - least) * (1 - i / (n - 1)) + 0.5))), n - 1)  # halves go up
        for j in np.argsort(d, kind="stable")[:k]:
            rows += [(ids[i], ids[j], d[j]), (ids[j], ids[i], d[j])]
    out = pd.DataFrame(rows, columns=["parent_proto", "child_proto", "accum_distance"]).drop_duplicates(["parent_proto", "child_proto"])
    return out.assign(compat_id=pdf["compat_id"].iloc[0])


def hierarchy(protos: DataFrame, keep: int = 250, least: int = 4, most: int = 16) -> DataFrame:
    """Edges among the ``keep`` most important of every compat_id, as stored; the defaults are the
    reference's maxHierarchyProtos, volatileMinNeighbors and volatileMaxNeighbors."""
    rows = top_per_compat(distinct_protos(protos.where("variance is not null and importance is not null")), keep).select("proto_id", "compat_id", "mean", "variance", "rn")
    return rows.groupBy("compat_id").applyInPandas(lambda pdf: hierarchy_frame(pdf, least, most), "parent_proto string, child_proto string, accum_distance double, compat_id int")


def both_ways(edges: DataFrame) -> DataFrame:
    """Each undirected edge once per direction, its shortest distance."""
    e = edges.select("source", "polarity", "parent_proto", "child_proto", "accum_distance")
    back = e.select("source", "polarity", F.col("child_proto").alias("parent_proto"), F.col("parent_proto").alias("child_proto"), "accum_distance")
    return e.unionByName(back).where("parent_proto <> child_proto").groupBy("source", "polarity", "parent_proto", "child_proto").agg(F.min("accum_distance").alias("accum_distance"))


def reachable(edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """``(seed, proto_id, distance, hops)``: what each of ``seeds`` (seed) reaches in at most ``hops``
    edges, by the shortest sum of distances among such paths. One join and one minimum a hop;
    each front is written out."""
    e = cut(both_ways(edges).groupBy("parent_proto", "child_proto").agg(F.min("accum_distance").alias("d")))
    front = seeds.select("seed", F.col("seed").alias("proto_id"), F.lit(0.0).alias("distance"), F.lit(0).alias("hops"))
    best = front
    for h in range(1, hops + 1):
        step = front.join(e, F.col("proto_id") == F.col("parent_proto")).select("seed", F.col("child_proto").alias("proto_id"), (F.col("distance") + F.col("d")).alias("distance"), F.lit(h).alias("hops"))
        front = cut(step.groupBy("seed", "proto_id").agg(F.min("distance").alias("distance"), F.min("hops").alias("hops")))
        best = best.unionByName(front)
    return best.groupBy("seed", "proto_id").agg(F.min("distance").alias("distance"), F.min("hops").alias("hops"))


def dangling(edges: DataFrame, protos: DataFrame) -> DataFrame:
    """Edges with an end that is gone."""
    ids = protos.select("proto_id").distinct()
    a = edges.join(ids, F.col("parent_proto") == F.col("proto_id"), "left_anti")
    b = edges.join(ids, F.col("child_proto") == F.col("proto_id"), "left_anti")
    return a.unionByName(b).distinct()


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "proto_id") -> DataFrame:
    """Incoming rows replace existing ones of the same key; others are added."""
    kept = existing.join(incoming.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
    return kept.unionByName(incoming)


def insert_ignore(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    return existing.unionByName(incoming.join(existing.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti"))


def boosted(protos: DataFrame, hits: DataFrame, factor: float = 1.1) -> DataFrame:
    """size, importance and access_count of the hit prototypes grow; their use is counted."""
    j = protos.join(hits.select(F.col("proto_id").alias("_k")).distinct(), F.col("proto_id") == F.col("_k"), "left")
    hit = F.col("_k").isNotNull()
    grown = {c: F.when(hit, F.col(c) * factor).otherwise(F.col(c)) for c in ("size", "importance", "access_count")}
    return j.withColumns(grown | {"usage_count": F.col("usage_count") + F.when(hit, 1).otherwise(0)}).drop("_k")


def _pos(spark, sf_dir):
    return distinct_protos(table(spark, sf_dir, "volatile_positive"))


def q_decay(spark, sf_dir):
    d = decayed(_pos(spark, sf_dir).where("last_accessed is not null"), 4000)
    return d.select("proto_id", *[F.round(c, 6).alias(c) for c in ("size", "access_count", "importance")])


def q_hash(spark, sf_dir):
    return _pos(spark, sf_dir).select("proto_id", content_hash(F.col("mean")).alias("content_hash"))


def q_top(spark, sf_dir):
    return top_per_compat(_pos(spark, sf_dir).where("importance is not null"), 10).select("compat_id", "proto_id", "rn")


def q_purge(spark, sf_dir):
    return purge_lowest(_pos(spark, sf_dir), 500).select("proto_id")


def q_edges(spark, sf_dir):
    return both_ways(table(spark, sf_dir, "proto_edges")).withColumn("accum_distance", F.round("accum_distance", 6))


def q_edge_distance(spark, sf_dir):
    """The distance of the two ends of every positive edge, recomputed from their vectors."""
    e = both_ways(table(spark, sf_dir, "proto_edges")).where("polarity = 'positive' and parent_proto < child_proto")
    p = _pos(spark, sf_dir).where("variance is not null").select("proto_id", "mean", "variance")
    a, b = (p.select(F.col("proto_id").alias(f"i{k}"), F.col("mean").alias(f"m{k}"), F.col("variance").alias(f"v{k}")) for k in (1, 2))
    j = e.join(a, F.col("parent_proto") == F.col("i1")).join(b, F.col("child_proto") == F.col("i2"))
    return j.select("source", "parent_proto", "child_proto", F.round(gaussian_distance(F.col("m1"), F.col("v1"), F.col("m2"), F.col("v2")), 6).alias("distance"))


def q_dangling(spark, sf_dir):
    both = table(spark, sf_dir, "volatile_positive").select("proto_id").unionByName(table(spark, sf_dir, "volatile_negative").select("proto_id"))
    return dangling(table(spark, sf_dir, "proto_edges"), both).withColumn("accum_distance", F.round("accum_distance", 6))


def q_reachable(spark, sf_dir):
    """What the most important prototype of each compat_id reaches in two edges."""
    seeds = top_per_compat(_pos(spark, sf_dir).where("importance is not null"), 1).select(F.col("proto_id").alias("seed"))
    return reachable(table(spark, sf_dir, "proto_edges").where("polarity = 'positive'"), seeds, 2).withColumn("distance", F.round("distance", 6))


def q_traversal(spark, sf_dir):
    """As ``q_reachable``, but to the reference's hierarchyTraversalDepth of five."""
    seeds = top_per_compat(_pos(spark, sf_dir).where("importance is not null"), 1).select(F.col("proto_id").alias("seed"))
    return reachable(table(spark, sf_dir, "proto_edges").where("polarity = 'positive'"), seeds, 5).withColumn("distance", F.round("distance", 6))


def q_merged(spark, sf_dir):
    return merged(table(spark, sf_dir, "volatile_positive")).withColumn("size", F.round("size", 6))


def q_hierarchy(spark, sf_dir):
    return hierarchy(table(spark, sf_dir, "volatile_positive")).withColumn("accum_distance", F.round("accum_distance", 6))


def q_compat(spark, sf_dir):
    """Compatibility dimension against the bank: prototypes per key, keys without any, both polarities."""
    out = None
    for x in ("positive", "negative"):
        c, v = table(spark, sf_dir, f"compat_{x}"), distinct_protos(table(spark, sf_dir, f"volatile_{x}"))
        n = v.groupBy("compat_id").agg(F.count(F.lit(1)).alias("protos"), F.round(F.sum("size"), 4).alias("size"))
        one = c.join(n, "compat_id", "left").select(F.lit(x).alias("polarity"), "compatibility", "compat_id", F.coalesce("protos", F.lit(0)).alias("protos"), "size")
        out = one if out is None else out.unionByName(one)
    return out


def q_upsert(spark, sf_dir):
    """The positive bank with rows written over it: those merged a multiple of three times with doubled size, and the negative bank's."""
    old = _pos(spark, sf_dir).select("proto_id", "compat_id", "size")
    third = _pos(spark, sf_dir).where("merged_count % 3 = 0").select("proto_id", "compat_id", "size").withColumn("size", F.col("size") * 2)
    new = third.unionByName(distinct_protos(table(spark, sf_dir, "volatile_negative")).select("proto_id", "compat_id", "size"))
    return upsert(old, new).withColumn("size", F.round("size", 6))


def q_insert_ignore(spark, sf_dir):
    """The positive compatibilities with the negative ones added, existing ids kept as they are."""
    return insert_ignore(table(spark, sf_dir, "compat_positive"), table(spark, sf_dir, "compat_negative"), "compat_id")


def q_boosted(spark, sf_dir):
    """The bank after its three most important prototypes of each compat_id were hit."""
    p = _pos(spark, sf_dir)
    hits = top_per_compat(p.where("importance is not null"), 3).select("proto_id")
    return boosted(p, hits).select("proto_id", *[F.round(c, 6).alias(c) for c in ("size", "importance", "access_count")], "usage_count")


def q_promotions(spark, sf_dir):
    """Prototypes merged often enough for the core, with their rank by importance in their compat_id."""
    return ranked_per_compat(promotions(_pos(spark, sf_dir).where("importance is not null"), 2)).select("proto_id", "compat_id", "merged_count", "rn")


def q_memory_reads(spark, sf_dir):
    """What a reader of each compat_id gets: the most important positives and negatives in one ranking, by polarity."""
    both = None
    for x in ("positive", "negative"):
        one = top_per_compat(distinct_protos(table(spark, sf_dir, f"volatile_{x}")).where("importance is not null"), 5).select("compat_id", F.lit(x).alias("polarity"), "proto_id", "importance")
        both = one if both is None else both.unionByName(one)
    share = F.sum("importance").over(Window.partitionBy("compat_id"))
    return both.select("compat_id", "polarity", "proto_id", F.round(F.when(share > 0, F.col("importance") / share).otherwise(0.0), 8).alias("share"))


_D = "d as (select * from (select *, row_number() over (partition by proto_id order by usage_count desc nulls last, access_count desc nulls last) rn from volatile_positive) where rn = 1)"
_E = """e as (select source, polarity, parent_proto, child_proto, min(accum_distance) accum_distance from (select source, polarity, parent_proto, child_proto, accum_distance from proto_edges
  union all select source, polarity, child_proto, parent_proto, accum_distance from proto_edges) where parent_proto <> child_proto group by 1, 2, 3, 4)"""
_SH = "case when last_accessed < 4000 then greatest(0.1, {c} * pow(0.995, 4000 - last_accessed)) else {c} end"
DECAY_SQL = f"with {_D} select proto_id, " + ", ".join(f"round({_SH.format(c=c)}, 6) as {c}" for c in ("size", "access_count", "importance")) + " from d where last_accessed is not null"
HASH_SQL = f"""with {_D}, h as (select proto_id, list_reduce(list_transform(mean, lambda x: (floor(x * 10000 + 0.5)::bigint & 4294967295)), lambda a, x: (((xor(a, x)::hugeint * 16777619) % 4294967296)::bigint), 2166136261::bigint) v from d)
select proto_id, lpad(lower(to_hex((v % 4294967295)::bigint)), 8, '0') as content_hash from h"""
TOP_SQL = f"with {_D}, t as (select compat_id, proto_id, row_number() over (partition by compat_id order by importance desc, access_count desc nulls last, last_accessed desc nulls last, proto_id) as n from d where importance is not null) select compat_id, proto_id, n as rn from t where n <= 10"
PURGE_SQL = f"with {_D} select proto_id from d order by importance asc nulls first, size asc nulls first, access_count asc nulls first, last_accessed asc nulls first, proto_id limit (select greatest(0, count(*) - 500) from d)"
EDGES_SQL = f"with {_E} select source, polarity, parent_proto, child_proto, round(accum_distance, 6) as accum_distance from e"
DIST_SQL = f"""with {_D}, {_E}, j as (select e.source, parent_proto, child_proto, a.mean m1, a.variance v1, b.mean m2, b.variance v2 from e join d a on a.proto_id = parent_proto join d b on b.proto_id = child_proto
  where polarity = 'positive' and parent_proto < child_proto and a.variance is not null and b.variance is not null)
select source, parent_proto, child_proto, case when len(m1) = len(m2) then round(list_sum([pow(m1[i] - m2[i], 2) / ((greatest(v1[i], 1e-8) + greatest(v2[i], 1e-8)) / 2) / 8
  + ln((greatest(v1[i], 1e-8) + greatest(v2[i], 1e-8)) / 2 / sqrt(greatest(v1[i], 1e-8) * greatest(v2[i], 1e-8))) / 2 for i in range(1, len(m1) + 1)]), 6) end as distance from j"""
DANGLING_SQL = """with ids as (select proto_id from volatile_positive union select proto_id from volatile_negative)
select distinct source, polarity, parent_proto, child_proto, round(accum_distance, 6) as accum_distance from proto_edges where parent_proto not in (select proto_id from ids) or child_proto not in (select proto_id from ids)"""
REACH_SQL = f"""with {_D}, {_E}, g as (select parent_proto p, child_proto c, min(accum_distance) w from e where polarity = 'positive' group by 1, 2),
s as (select proto_id seed from (select proto_id, row_number() over (partition by compat_id order by importance desc, access_count desc nulls last, last_accessed desc nulls last, proto_id) n from d where importance is not null) where n = 1),
one as (select seed, c x, w, 1 h from s join g on p = seed), two as (select seed, g.c x, one.w + g.w w, 2 h from one join g on g.p = one.x),
u as (select seed, seed x, 0.0::double w, 0 h from s union all select * from one union all select * from two)
select seed, x as proto_id, round(min(w), 6) as distance, min(h) as hops from u group by 1, 2"""
COMPAT_SQL = """with v as (select 'positive' polarity, compat_id, proto_id, any_value(size) size from volatile_positive group by 2, 3 union all select 'negative', compat_id, proto_id, any_value(size) from volatile_negative group by 2, 3),
c as (select 'positive' polarity, * from compat_positive union all select 'negative', * from compat_negative)
select c.polarity, compatibility, c.compat_id, count(v.proto_id) as protos, round(sum(v.size), 4) as size from c left join v on v.polarity = c.polarity and v.compat_id = c.compat_id group by 1, 2, 3"""

_N = "n as (select * from (select *, row_number() over (partition by proto_id order by usage_count desc nulls last, access_count desc nulls last) rn from volatile_negative) where rn = 1)"
UPSERT_SQL = f"""with {_D}, {_N}, u as (select proto_id, compat_id, size * 2 size from d where merged_count % 3 = 0 union all select proto_id, compat_id, size from n)
select proto_id, compat_id, round(size, 6) as size from (select * from u union all select proto_id, compat_id, size from d where proto_id not in (select proto_id from u))"""
INSERT_SQL = "select * from compat_positive union all select * from compat_negative where compat_id not in (select compat_id from compat_positive)"
_TOP = "t as (select proto_id, compat_id, importance, row_number() over (partition by compat_id order by importance desc, access_count desc nulls last, last_accessed desc nulls last, proto_id) k from d where importance is not null)"
BOOST_SQL = f"""with {_D}, {_TOP}, h as (select d.*, coalesce(k <= 3, false) hit from d left join t using (proto_id))
select proto_id, round(case when hit then size * 1.1 else size end, 6) as size, round(case when hit then h.importance * 1.1 else h.importance end, 6) as importance, round(case when hit then access_count * 1.1 else access_count end, 6) as access_count, usage_count + hit::int as usage_count from h"""
PROMOTE_SQL = f"""with {_D}, m as (select * exclude (rn) from d where importance is not null and merged_count >= 2)
select proto_id, compat_id, merged_count, row_number() over (partition by compat_id order by importance desc, access_count desc nulls last, last_accessed desc nulls last, proto_id) as rn from m"""
_BOTH = " union all ".join(f"select compat_id, '{x}' polarity, proto_id, importance, row_number() over (partition by compat_id order by importance desc, access_count desc nulls last, last_accessed desc nulls last, proto_id) k from {t} where importance is not null" for x, t in (("positive", "d"), ("negative", "n")))
READS_SQL = f"with {_D}, {_N}, u as (select * from ({_BOTH}) where k <= 5) select compat_id, polarity, proto_id, round(case when sum(importance) over w > 0 then importance / sum(importance) over w else 0 end, 8) as share from u window w as (partition by compat_id)"

TRAVERSAL_SQL = f"""with recursive {_D}, {_E}, g as (select parent_proto p, child_proto c, min(accum_distance) w from e where polarity = 'positive' group by 1, 2),
s as (select proto_id seed from (select proto_id, row_number() over (partition by compat_id order by importance desc, access_count desc nulls last, last_accessed desc nulls last, proto_id) n from d where importance is not null) where n = 1),
u as (select seed, seed x, 0.0::double w, 0 h from s union select u.seed, g.c, u.w + g.w, u.h + 1 from u join g on g.p = u.x where u.h < 5)
select seed, x as proto_id, round(min(w), 6) as distance, min(h) as hops from u group by 1, 2"""
#: The 250 most important of each compat_id; k nearest falls from 16 to 4 with the rank; each edge is stored both ways.
HIERARCHY_SQL = f"""with {_D}, k as (select proto_id, compat_id, mean, variance, row_number() over (partition by compat_id order by importance desc, access_count desc nulls last, last_accessed desc nulls last, proto_id) - 1 i, count(*) over (partition by compat_id) c
  from d where variance is not null and importance is not null), t as (select *, least(c, 250) n from k where i < 250),
p as (select a.compat_id, a.proto_id a, b.proto_id b, a.i, a.n, b.i j, list_sum([pow(a.mean[x] - b.mean[x], 2) / ((greatest(a.variance[x], 1e-8) + greatest(b.variance[x], 1e-8)) / 2) / 8
  + ln((greatest(a.variance[x], 1e-8) + greatest(b.variance[x], 1e-8)) / 2 / sqrt(greatest(a.variance[x], 1e-8) * greatest(b.variance[x], 1e-8))) / 2 for x in range(1, len(a.mean) + 1)]) w from t a join t b on a.compat_id = b.compat_id and a.i <> b.i),
r as (select *, row_number() over (partition by a order by w, j) rk from p), f as (select * from r where rk <= least(greatest(1, floor(4 + 12 * (1 - i / (n - 1)) + 0.5)), n - 1))
select parent_proto, child_proto, any_value(round(w, 6)) as accum_distance, compat_id from (select a parent_proto, b child_proto, w, compat_id from f union all select b, a, w, compat_id from f) group by parent_proto, child_proto, compat_id"""

QUERIES = {
    "vault_decay": (q_decay, DECAY_SQL), "vault_content_hash": (q_hash, HASH_SQL), "vault_top": (q_top, TOP_SQL), "vault_purge": (q_purge, PURGE_SQL), "vault_edges": (q_edges, EDGES_SQL),
    "vault_edge_distance": (q_edge_distance, DIST_SQL), "vault_dangling_edges": (q_dangling, DANGLING_SQL), "vault_reachable": (q_reachable, REACH_SQL), "vault_traversal": (q_traversal, TRAVERSAL_SQL), "vault_merged": (q_merged, None),
    "vault_hierarchy": (q_hierarchy, HIERARCHY_SQL), "vault_compat": (q_compat, COMPAT_SQL),
    "vault_upsert": (q_upsert, UPSERT_SQL), "vault_insert_ignore": (q_insert_ignore, INSERT_SQL), "vault_boosted": (q_boosted, BOOST_SQL), "vault_promotions": (q_promotions, PROMOTE_SQL), "vault_reads": (q_memory_reads, READS_SQL),
}
