"""Problem 6: most similar vectors by a forest of hash prefixes.

Every vector gets one long string of hyperplane signs per tree, and each tree is a sorted array
of these strings. A vector's best candidates in a tree are those with which it shares the
longest prefix; how long the prefixes are follows from how crowded a place is, as the sorted
array is divided into ranges of one prefix that hold a bounded number of vectors. Where the
matches of the longest prefixes of all trees do not suffice, a query ascends in all trees
together, to shorter prefixes and so to more ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.streams import groups
from tidewright.session import cut, table


@dataclass(frozen=True)
class ForestSpec:
    """``bits`` is the length of the hash strings, ``leaf`` the vectors that a range should hold,
    ``sample`` the bounded number of vectors on which the ranges are laid out."""

    trees: int = 4
    bits: int = 60
    leaf: int = 1024
    sample: int = 20_000
    seed: int = 20240611

    def planes(self, dim: int) -> np.ndarray:
        return np.random.default_rng([self.seed, dim]).standard_normal((dim, self.trees * self.bits))

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """One integer per vector and tree; its bits from the highest are the hash string."""
        signs = (vectors @ self.planes(vectors.shape[1]) > 0).reshape(len(vectors), self.trees, self.bits)
        weights = (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64)).astype(np.int64)
        return signs.astype(np.int64) @ weights

    def layout(self, vectors_by_dim: dict[int, np.ndarray], share: float) -> dict[int, np.ndarray]:
        """``{dim * trees + tree: first key of each range}``: prefixes are lengthened until a
        range of the sample holds its share of ``leaf`` vectors."""
        out = {}
        cap = max(2.0, self.leaf * share)
        for dim, vectors in vectors_by_dim.items():
            keys = self.keys(vectors)
            for t in range(self.trees):
                k = np.sort(keys[:, t])
                starts, todo = [], [(0, 0, len(k), 0)]
                while todo:
                    first, lo, hi, depth = todo.pop()
                    if hi - lo <= cap or depth == self.bits:
                        starts.append(first)
                        continue
                    half = first + (1 << (self.bits - depth - 1))
                    mid = lo + int(np.searchsorted(k[lo:hi], half))
                    todo += [(first, lo, mid, depth + 1), (half, mid, hi, depth + 1)]
                out[dim * self.trees + t] = np.sort(np.array(starts, np.int64))
        return out


def _valid(batch: pa.RecordBatch, seen: set) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, row numbers, vectors)`` per vector length: finite, not all zero, ids not in ``seen``."""
    lists = batch.column(1)
    n = np.asarray(lists.value_lengths().fill_null(0))
    starts = np.asarray(lists.offsets)[:-1]
    flat = lists.values.to_numpy(zero_copy_only=False)
    fresh = np.zeros(batch.num_rows, bool)
    for i, x in enumerate(batch.column(0).to_pylist()):
        if x is not None and x not in seen:
            seen.add(x)
            fresh[i] = True
    for dim in np.unique(n[n > 0]).tolist():
        rows = np.flatnonzero((n == dim) & fresh)
        v = flat[starts[rows][:, None] + np.arange(dim)].astype(np.float64)
        good = np.isfinite(v).all(1) & (v != 0).any(1)
        yield dim, rows[good], v[good]


def _binary(v: np.ndarray) -> pa.Array:
    """Rows as bytes: 4 a value where no value loses anything by it, else 8."""
    small = v.astype(np.float32)
    if not (small == v).all():
        small = v
    width = small.shape[1] * small.itemsize
    offsets = np.arange(0, width * (len(v) + 1), width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(small))])


def _vectors(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    parts = [np.frombuffer(x, np.float32 if len(x) == 4 * dim else np.float64).astype(np.float64) for x in col.to_pylist()]
    return np.stack(parts)


SCHEMA = "code int, range int, key bigint, id string, vec binary"


def tree_rows(vectors: DataFrame, spec: ForestSpec, layout: dict[int, np.ndarray]) -> DataFrame:
    """Each vector of ``(id, vec)`` once per tree: ``(code, range, key, id, vec)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in batches:
            for dim, rows, v in _valid(b, seen):
                if not len(rows):
                    continue
                keys = spec.keys(v)
                ids, vec = b.column(0).take(pa.array(rows)), _binary(v)
                for t in range(spec.trees):
                    code = dim * spec.trees + t
                    starts = layout.get(code, np.zeros(1, np.int64))
                    place = np.maximum(np.searchsorted(starts, keys[:, t], "right") - 1, 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), code, np.int32)), pa.array(place.astype(np.int32)), pa.array(keys[:, t]), ids, vec], ["code", "range", "key", "id", "vec"]
                    )

    return vectors.select("id", "vec").mapInArrow(run, SCHEMA)


def fit(vectors: DataFrame, spec: ForestSpec) -> tuple[dict[int, np.ndarray], int]:
    """Lay the ranges out on a bounded sample of ``(id, vec)``; ``(layout, rows)``."""
    n = vectors.count()
    share = min(1.0, spec.sample / max(1, n))
    some = vectors.select("id", "vec")
    some = (some.sample(fraction=min(1.0, share * 1.05), seed=spec.seed) if share < 1 else some).limit(spec.sample)
    by_dim: dict[int, list[np.ndarray]] = {}
    seen: set = set()
    for b in some.toArrow().to_batches():
        for dim, _, v in _valid(b, seen):
            by_dim.setdefault(dim, []).append(v)
    return spec.layout({d: np.concatenate(v) for d, v in by_dim.items() if sum(map(len, v))}, share), n


def _prefix_blocks(keys: np.ndarray, bits: int, most: int) -> Iterator[np.ndarray]:
    """Parts of a sorted array of keys that share a prefix, descending until a part has at most
    ``most`` members or no bit is left."""
    todo = [(0, len(keys), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo <= most or depth == bits:
            if hi > lo:
                yield np.arange(lo, hi)
            continue
        bit = np.int64(1) << np.int64(bits - depth - 1)
        mid = lo + int(np.searchsorted((keys[lo:hi] & bit) > 0, True))
        todo += [(lo, mid, depth + 1), (mid, hi, depth + 1)]


def _classes(ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(representatives, class of each row)``: rows with the same vector are one class, its representative the
    row of the smallest id."""
    rows = np.ascontiguousarray(v).view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel()
    _, first, inverse, count = np.unique(rows, return_index=True, return_inverse=True, return_counts=True)
    if len(first) < len(ids):
        order, ends = np.argsort(inverse, kind="stable"), np.cumsum(count)
        for c in np.flatnonzero(count > 1).tolist():
            members = order[ends[c] - count[c] : ends[c]]
            first[c] = members[ids[members].argmin()]
    return first, inverse


def similar_classes(vectors: DataFrame, least: float, spec: ForestSpec = ForestSpec()) -> tuple[DataFrame, DataFrame]:
    """``(pairs, members)``: pairs of representatives ``(p, q)``, p < q in byte order, and ``(rep, id)`` of every
    other id whose vector equals its representative's. Copies of one vector never meet one by one.

    Found as candidates of one prefix in any tree and then computed exactly. A pair at the limit
    agrees in a bit with chance 1 - acos(least) / pi, so at 0.9999 and 10 bits of prefix four trees
    miss one pair in 250,000; where vectors crowd, prefixes grow and the chance with them (60 bits:
    one in 300).
    """
    layout, n = fit(vectors, spec)
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * spec.trees // 100_000)
    rows = tree_rows(vectors, spec, layout).repartition(parts, "code", "range").sortWithinPartitions("code", "range", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 2):
            if g.num_rows < 2:
                continue
            ids = np.array(g.column("id").to_pylist(), object)
            code = g.column("code")[0].as_py()
            v = _vectors(g.column("vec"), code // spec.trees)
            first, inverse = _classes(ids, v)
            if len(first) < len(ids) and code % spec.trees == 0:
                rep = ids[first][inverse]
                other = np.flatnonzero(rep != ids)
                if len(other):
                    yield pa.RecordBatch.from_arrays([pa.array(rep[other], pa.string()), pa.array(ids[other], pa.string()), pa.array(np.ones(len(other), np.int8))], ["p", "q", "kind"])
            first = np.sort(first)
            ids, v, keys = ids[first], v[first], g.column("key").to_numpy()[first]
            order = np.argsort(keys, kind="stable")
            ids, v, keys = ids[order], v[order], keys[order]
            unit = v / np.linalg.norm(v, axis=1, keepdims=True)
            rough = unit.astype(np.float32)
            for block in _prefix_blocks(keys, spec.bits, 2 * spec.leaf):
                for lo in range(0, len(block), 1024):  # tiles, for the rare block that no prefix divides
                    for at in range(lo, len(block), 1024):
                        x, y = block[lo : lo + 1024], block[at : at + 1024]
                        a, b = np.nonzero(rough[x] @ rough[y].T >= least - 1e-5)
                        a, b = x[a], y[b]
                        new = a < b
                        a, b = a[new], b[new]
                        exact = np.einsum("ij,ij->i", unit[a], unit[b]) >= least
                        if exact.any():
                            p, q = ids[a[exact]], ids[b[exact]]
                            yield pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(q, pa.string()), pa.array(np.zeros(len(p), np.int8))], ["p", "q", "kind"])

    found = cut(rows.mapInArrow(run, "p string, q string, kind tinyint"))
    pairs = found.where("kind = 0 and p <> q").select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
    return pairs, found.where("kind = 1").select(F.col("p").alias("rep"), F.col("q").alias("id")).distinct()


def similar_pairs(vectors: DataFrame, least: float, spec: ForestSpec = ForestSpec()) -> DataFrame:
    """``(id_a, id_b)`` with id_a < id_b in byte order: vectors of one length whose cosine is at
    least ``least``: ``similar_classes`` with the copies of a vector written out.

    Null, zero and non-finite vectors and null ids have no pairs; repeated rows of an id count
    once; equal vectors of different ids are pairs. Vectors of different lengths never meet.
    """
    pairs, members = similar_classes(vectors, least, spec)
    if members.isEmpty():
        return pairs.select(F.col("p").alias("id_a"), F.col("q").alias("id_b"))
    every = cut(members.unionByName(members.select("rep", F.col("rep").alias("id")).distinct()))
    one, two = (every.select(F.col("rep").alias(f"r{k}"), F.col("id").alias(f"i{k}")) for k in (1, 2))
    across = pairs.join(one, F.col("p") == F.col("r1"), "left").join(two, F.col("q") == F.col("r2"), "left").select(F.coalesce("i1", "p").alias("a"), F.coalesce("i2", "q").alias("b"))
    within = one.join(two, F.col("r1") == F.col("r2")).where("i1 < i2").select(F.col("i1").alias("a"), F.col("i2").alias("b"))
    return across.unionByName(within).where("a <> b").select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


#: Steps in which the cosine a query has reached travels in its key.
COSINE_STEP = 1e-9


def _probe(rows: DataFrame, queries: DataFrame, k: int, spec: ForestSpec, parts: int, reached: bool = False) -> DataFrame:
    """Of every query and range it was sent to, the ``k`` best ids of the range by rounded cosine, ties
    to the smaller id: ``(query, id, cosine)``.
    With ``reached`` a query's key holds its k-th cosine so far, and only what is no worse comes out."""
    both = rows.withColumn("is_query", F.lit(0)).unionByName(queries.withColumn("is_query", F.lit(1)))
    both = both.select("code", "range", "is_query", "key", "id", "vec").repartition(parts, "code", "range").sortWithinPartitions("code", "range", "is_query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 2):
            asks = g.column("is_query").to_numpy() == 1
            if not asks.any() or asks.all():
                continue
            ids = np.array(g.column("id").to_pylist(), object)
            v = _vectors(g.column("vec"), g.column("code")[0].as_py() // spec.trees)
            unit = v / np.linalg.norm(v, axis=1, keepdims=True)
            have, want = np.flatnonzero(~asks), np.flatnonzero(asks)
            have = have[np.argsort(ids[have], kind="stable")]
            own = ids[have]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))  # copies of one id, read in different tasks, lie together
            name = own[first]
            least = g.column("key").to_numpy() * COSINE_STEP - 2 * COSINE_STEP if reached else np.full(len(asks), -1.5)
            for lo in range(0, len(want), 512):
                q = want[lo : lo + 512]
                cos = unit[q] @ unit[have].T
                if len(first) < len(have):
                    cos = np.maximum.reduceat(cos, first, axis=1)
                cos = np.round(cos, 9)
                at = np.searchsorted(name, ids[q])
                at[at == len(name)] = 0
                self_ = np.flatnonzero(name[at] == ids[q])
                cos[self_, at[self_]] = -2
                m = min(k, len(name))
                kth = -np.partition(-cos, m - 1, axis=1)[:, m - 1 : m]
                more, ties = cos > kth, cos == kth
                take = more | (ties & (ties.cumsum(1) <= m - more.sum(1, keepdims=True)))  # ties by id, as in _best
                a, b = np.nonzero(take & (cos >= least[q][:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q][a], pa.string()), pa.array(name[b], pa.string()), pa.array(cos[a, b])], ["query", "id", "cosine"])

    return both.mapInArrow(run, "query string, id string, cosine double")


def _best(found: DataFrame, k: int) -> DataFrame:
    rounded = found.groupBy("query", "id").agg(F.round(F.max("cosine"), 9).alias("cosine"))
    order = Window.partitionBy("query").orderBy(F.col("cosine").desc(), "id")
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, miss: float = 0.02, spec: ForestSpec = ForestSpec()) -> DataFrame:
    """``(query, id, cosine, rank)``: the ``k`` most similar vectors of every query, itself left out.

    First each query meets the range of its longest prefix in every tree. The k-th cosine then
    tells how long a prefix still finds such a neighbour in one of the trees with chance
    ``1 - miss``; a query whose prefixes were longer ascends in all trees to that length and
    meets all ranges under it (at length 0 one tree holds them all). Every vector is indexed;
    ties go to the smaller id. Rules for unusable vectors as in ``similar_pairs``.
    """
    spark = vectors.sparkSession
    layout, n = fit(vectors, spec)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * spec.trees // 100_000)
    rows = cut(tree_rows(vectors, spec, layout))
    asked = cut(tree_rows(queries, spec, layout))
    first = cut(_best(_probe(rows, asked, k, spec, parts), k))
    kth = first.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("c"))
    trees, bits = spec.trees, spec.bits

    def ascend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, key = b.column(0).to_numpy(), b.column(2).to_numpy()
            c = b.column(6).fill_null(-1.0).to_numpy(zero_copy_only=False)
            c = np.where(b.column(5).fill_null(0).to_numpy(zero_copy_only=False) < k, -1.0, c)
            keep = 1 - np.arccos(np.clip(c, -1, 1)) / np.pi  # chance of one equal bit
            one = 1 - miss ** (1 / trees)  # chance that each tree must have
            depth = np.where(keep >= 1, bits, np.floor(np.log(one) / np.log(np.clip(keep, 1e-9, 1 - 1e-12)))).astype(np.int64)
            depth = np.clip(depth, 0, bits)
            at, to = [], []
            for i in range(b.num_rows):
                if depth[i] == 0 and code[i] % trees:
                    continue
                starts = layout.get(int(code[i]), np.zeros(1, np.int64))
                span = 1 << (bits - int(depth[i]))
                low = int(key[i]) // span * span
                lo = max(0, int(np.searchsorted(starts, low, "right")) - 1)
                hi = max(lo + 1, int(np.searchsorted(starts, low + span, "left")))
                own = b.column(1)[i].as_py()
                if hi - lo == 1:
                    continue
                for r in range(lo, hi):
                    if r != own or depth[i] == 0:
                        at.append(i)
                        to.append(r)
            t = b.select(["code", "id", "vec"]).take(pa.array(at, pa.int64()))
            kth_so_far = np.floor(np.where(c > -1, c, -1.2) / COSINE_STEP).astype(np.int64)[at]
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array(to, pa.int32()), pa.array(kth_so_far), t.column(1), t.column(2)], ["code", "range", "key", "id", "vec"])

    more = asked.join(kth, F.col("id") == F.col("query"), "left").select("code", "range", "key", "id", "vec", "n", "c").mapInArrow(ascend, SCHEMA)
    second = _probe(rows, more, k, spec, parts, reached=True)
    return _best(first.select("query", "id", "cosine").unionByName(second), k)


def _banks(spark, sf_dir: str) -> DataFrame:
    both = [table(spark, sf_dir, f"volatile_{x}").select(F.col("proto_id").alias("id"), F.col("mean").alias("vec")) for x in ("positive", "negative")]
    return both[0].unionByName(both[1]).where("id is not null and vec is not null")


def p6_found(spark, sf_dir: str) -> DataFrame:
    pairs = similar_pairs(_banks(spark, sf_dir), 0.9999)
    return pairs.select(F.col("id_a").alias("proto_id_a"), F.col("id_b").alias("proto_id_b"))


def p6_neighbours(spark, sf_dir: str) -> DataFrame:
    """The ten nearest of every prototype whose id's checksum is divisible by 100, among all rows."""
    vectors = _banks(spark, sf_dir)
    return nearest(vectors, vectors.where("crc32(cast(id as binary)) % 100 = 0"))


def p6_classes(spark, sf_dir: str) -> DataFrame:
    """The same in compact form: every vector with a partner or a copy, its representative, the copies it
    stands for, and the number of other representatives it is similar to."""
    pairs, members = similar_classes(_banks(spark, sf_dir), 0.9999)
    both = pairs.select("p", "q").unionByName(pairs.select(F.col("q").alias("p"), F.col("p").alias("q")))
    links = both.groupBy(F.col("p").alias("rep")).agg(F.count(F.lit(1)).alias("links"))
    copies = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    out = links.join(copies, "rep", "full")
    return out.select(F.col("rep").alias("proto_id"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))


P6_SQL = """
with b as (select distinct proto_id, mean from (select proto_id, mean from volatile_positive union all select proto_id, mean from volatile_negative) where mean is not null),
v as (select proto_id, mean, len(mean) d, sqrt(list_sum(list_transform(mean, lambda x: x * x))) n from b),
g as (select * from v where n > 0 and not isnan(n))
select a.proto_id as proto_id_a, b.proto_id as proto_id_b from g a join g b on a.d = b.d and a.proto_id < b.proto_id
where list_cosine_similarity(a.mean, b.mean) >= 0.9999
"""
P6_CLASSES_SQL = """
with b as (select distinct proto_id, mean from (select proto_id, mean from volatile_positive union all select proto_id, mean from volatile_negative) where mean is not null),
v as (select min(proto_id) proto_id, mean, count(*) - 1 copies, len(mean) d, sqrt(list_sum(list_transform(mean, lambda x: x * x))) n from b group by mean),
g as (select * from v where n > 0 and not isnan(n)),
l as (select a.proto_id, count(*) links from g a join g b on a.d = b.d and a.proto_id <> b.proto_id where list_cosine_similarity(a.mean, b.mean) >= 0.9999 group by 1)
select proto_id, copies, coalesce(links, 0) as links from g left join l using (proto_id) where copies > 0 or links > 0
"""
