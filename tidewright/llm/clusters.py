"""Problem 4: clusters of mutually similar records by Markov clustering.

Candidates come from a lossless division of the space, the similarity graph from the exact
distance. Flow is spread by squaring the transition matrix, sharpened by inflation and thinned by
pruning small entries: a component at a time where its matrix fits a task, else by joins and
aggregates; attractors name the clusters and the rows with the strongest flow represent them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.streams import groups, matrix
from tidewright.session import cut, table

#: Variances below this count as this (fixed value of the distance).
LEAST_VARIANCE = 1e-8
#: Most blocks of a part that no cut thins, and the step of their numbers.
BLOCKS = 1024


@dataclass(frozen=True)
class ClusterSpec:
    """``near``: distance under which two records are alike. ``partners``: strongest links of a
    record that enter the flow graph; the rest only matter to which records hang together, and
    that is kept exactly. With None every link enters it and no entry of the flow is left out for
    its rank, which the Markov clusters themselves need (``WHOLE``). ``leaf``: records compared all with all; in a dense place that no cut
    divides, ``dense`` neighbours along the direction of spread are, and chains beyond them are
    still found exactly. ``task_rows``: larger groups are divided among tasks, along directions
    fitted on at most ``fit_rows`` of a group. ``dense_nodes``: largest component whose flow is one
    matrix in a task."""

    near: float = 1.5
    partners: int | None = 12
    inflation: float = 2.0
    prune: float = 1e-3
    rounds: int = 12
    leaf: int = 512
    dense: int = 2048
    task_rows: int = 16_384
    fit_rows: int = 4096
    dense_nodes: int = 3072


#: Every link enters the flow.
WHOLE = ClusterSpec(partners=None)


def distances(m1, v1, m2, v2) -> np.ndarray:
    """Distance between Gaussians with diagonal covariance, row by row (Bhattacharyya, 1943)."""
    v1, v2 = np.maximum(v1, LEAST_VARIANCE), np.maximum(v2, LEAST_VARIANCE)
    mid = (v1 + v2) / 2
    return ((m1 - m2) ** 2 / mid).sum(1) / 8 + np.log(mid / np.sqrt(v1 * v2)).sum(1) / 2


def _rounding(dim: int) -> float:
    """Bound of the relative error of a sum of ``dim`` products."""
    return 4 * (dim + 4) * np.finfo(np.float64).eps


def _direction(x: np.ndarray) -> np.ndarray:
    """Roughly the direction of greatest spread, by a few power iterations."""
    x = x[:: max(1, len(x) // 2048)]
    x = x - x.mean(0)
    u = x.std(0) + 1e-12
    for _ in range(6):
        u = x.T @ (x @ u)
        n = np.linalg.norm(u)
        if not n:
            return np.eye(x.shape[1])[0]
        u = u / n
    return u


def _split(m: np.ndarray, v: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """``(which go left, which go right, ...)``; a record within the margin goes both ways, so any
    two alike records stay together on one side. None where a split would not help.

    Alike records differ by less than sqrt(8 near) in means scaled by the largest variance of
    each place, hence by less along any direction; half of it on either side of the cut suffices.
    """
    x = m / np.sqrt(np.maximum(v, LEAST_VARIANCE).max(0))
    p = x @ _direction(x)
    if not np.isfinite(p).all():
        return None
    at, margin = np.median(p), math.sqrt(8 * near) / 2 * (1 + 1e-9) + _rounding(x.shape[1]) * np.abs(x).sum(1).max()
    left, right = p <= at + margin, p >= at - margin
    if max(left.sum(), right.sum()) > 0.9 * len(p):
        return None
    return left, right, p


def _leaves(m: np.ndarray, v: np.ndarray, spec: ClusterSpec) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(records, seen)`` of each leaf. Two records whose ``seen`` share a bit went left together at
    some cut above, so another leaf has that pair too, and has it once."""
    todo = [(np.arange(len(m)), np.zeros(len(m), np.int64), 0)]
    while todo:
        i, seen, turns = todo.pop()
        cut_ = _split(m[i], v[i], spec.near) if len(i) > spec.leaf else None
        if cut_ is None:
            yield i, seen
        else:
            left, right, _ = cut_
            bit = left.astype(np.int64) << turns if turns < 63 else 0
            todo += [(i[left], seen[left], turns), (i[right], (seen | bit)[right], turns + 1)]


def _within(m: np.ndarray, v: np.ndarray, i: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs ``(a, b, distance)`` under ``near`` among the records ``i``."""
    return tuple(np.concatenate(c) for c in zip(*_tiles(m, v, i, near), strict=True))


def _tiles(m: np.ndarray, v: np.ndarray, i: np.ndarray, near: float, seen: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of ``_within`` in pieces of bounded size, without those that ``seen`` gives to another leaf."""
    x = (m[i] - m[i].mean(0)) / np.sqrt(np.maximum(v[i], LEAST_VARIANCE).max(0))
    sq = (x**2).sum(1)
    for lo in range(0, len(i), 512):
        for hi in range(lo, len(i), 512):
            both = sq[lo : lo + 512, None] + sq[None, hi : hi + 512]
            # what rounding could hide, or what is no number here, is left to the exact distance
            d2 = both * (1 - _rounding(x.shape[1])) - 2 * x[lo : lo + 512] @ x[hi : hi + 512].T
            a, b = np.nonzero(~(d2 >= 8 * near * (1 + 1e-9) + 1e-6))
            if lo == hi:  # a tile against itself holds every pair twice
                a, b = a[a < b], b[a < b]
            if seen is not None:
                new = (seen[a + lo] & seen[b + hi]) == 0
                a, b = a[new], b[new]
            yield _exact(m, v, i[a + lo], i[b + hi], near)


def _exact(m: np.ndarray, v: np.ndarray, a: np.ndarray, b: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the candidate pairs, each with its smaller number first, those under ``near`` with their distance."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    out = []
    for lo in range(0, len(a), 50_000):
        p, q = a[lo : lo + 50_000], b[lo : lo + 50_000]
        d = distances(m[p], v[p], m[q], v[q])
        out.append((p[d < near], q[d < near], d[d < near]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the pairs are joined too, each the smallest member's number."""
    root = _roots(len(label), label[a], label[b])
    return root[label]


def _bridges(m: np.ndarray, v: np.ndarray, i: np.ndarray, label: np.ndarray, near: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs under ``near`` that join what the labels keep apart, until nothing apart is alike.

    A few records of the largest group so far gather what is alike to them, one distance a record.
    Then only records outside the largest group are compared with the others, and of them only
    those with another label; a dense place costs little more than one comparison a record.
    """
    here = label[i]
    for k in range(16):
        ids, n = np.unique(here, return_counts=True)
        main = np.flatnonzero(here == ids[n.argmax()])
        rest = np.flatnonzero(here != ids[n.argmax()])
        if not len(rest):
            return
        pivot = main[(len(main) * k) // 16]
        a, b, d = _exact(m, v, np.full(len(rest), i[pivot]), i[rest], near)
        yield a, b, d
        label = _merged(label, a, b)
        here = label[i]
    ids, n = np.unique(here, return_counts=True)
    rest = np.flatnonzero(here != ids[n.argmax()])
    x = (m[i] - m[i].mean(0)) / np.sqrt(np.maximum(v[i], LEAST_VARIANCE).max(0))
    sq = (x**2).sum(1)
    for lo in range(0, len(rest), 1024):
        r = rest[lo : lo + 1024]
        for hi in range(0, len(i), 4096):
            d2 = (sq[r, None] + sq[None, hi : hi + 4096]) * (1 - _rounding(x.shape[1])) - 2 * x[r] @ x[hi : hi + 4096].T
            a, b = np.nonzero(~(d2 >= 8 * near * (1 + 1e-9) + 1e-6) & (here[r, None] != here[None, hi : hi + 4096]))
            for at in range(0, len(a), 50_000):
                p, q = i[r[a[at : at + 50_000]]], i[b[at : at + 50_000] + hi]
                apart = label[p] != label[q]
                a1, b1, d = _exact(m, v, p[apart], q[apart], near)
                if len(a1):
                    yield a1, b1, d
                    label = _merged(label, a1, b1)
            here = label[i]


def _alike(m: np.ndarray, v: np.ndarray, band: np.ndarray, at: int, spec: ClusterSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, distance, root)``: pairs under ``near`` with i < j, at least one of them of band ``at``, among
    them every record's ``partners`` strongest, and the component of each record under all pairs under ``near``.

    Only the strongest pairs of the leaves seen so far are held, so the memory is in proportion to
    the records. In a leaf no cut divides, records are compared with the ``dense`` next to them along
    its direction, in two layouts that overlap by half; ``_bridges`` then joins what else is alike.
    """
    n = len(m)
    mine = band == at
    label = np.arange(n)
    kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def take(pairs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        nonlocal kept, label
        a, b, d = pairs
        label = _merged(label, a, b)
        ok = mine[a] | mine[b]
        a, b, d = a[ok], b[ok], d[ok]
        a, b, d = (np.concatenate(c) for c in zip(kept, (a, b, d), strict=True))
        _, first = np.unique(a * n + b, return_index=True)
        a, b, d = a[first], b[first], d[first]
        best = _strongest(n, a, b, d, spec.partners)
        kept = a[best], b[best], d[best]

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for leaf, _ in _leaves(m, v, spec):
        if len(leaf) <= spec.dense:
            held.append(_within(m, v, leaf, spec.near))
            if sum(len(h[0]) for h in held) > 500_000:
                take(tuple(np.concatenate(c) for c in zip(*held, strict=True)))
                held = []
            continue
        order = leaf[np.argsort(_along(m, v, leaf), kind="stable")]
        step = spec.dense // 4
        for lo in range(0, max(1, len(order) - step), step):
            take(_within(m, v, order[lo : lo + 2 * step], spec.near))
        take(tuple(np.concatenate(c) for c in zip(*_bridges(m, v, order, label, spec.near), kept, strict=True)))
    if held:
        take(tuple(np.concatenate(c) for c in zip(*held, strict=True)))
    return *kept, label


def _along(m: np.ndarray, v: np.ndarray, i: np.ndarray) -> np.ndarray:
    x = m[i] / np.sqrt(np.maximum(v[i], LEAST_VARIANCE).max(0))
    return x @ _direction(x)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def _strongest(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray, most: int) -> np.ndarray:
    """Mask of the links that are among the ``most`` shortest of either end."""
    ends, other = np.concatenate((a, b)), np.concatenate((np.arange(len(a)),) * 2)
    order = np.lexsort((np.concatenate((d, d)), ends))
    ends, other = ends[order], other[order]
    first = np.searchsorted(ends, np.arange(n))
    rank = np.arange(len(ends)) - first[ends]
    keep = np.zeros(len(a), bool)
    keep[other[rank < most]] = True
    return keep


def records(protos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(classes, members)``. Records with the same compat_id, mean and variance form one class,
    node ``id``, however many there are; members gives each proto_id its class.

    Left out: null ids or vectors, vectors that hold nulls or differ in length, empty vectors.
    """
    fine = protos.select("proto_id", "compat_id", "mean", "variance").where(
        "proto_id is not null and mean is not null and variance is not null and size(mean) = size(variance) and size(mean) > 0"
        " and not exists(mean, x -> x is null) and not exists(variance, x -> x is null)"
    )
    known = fine.withColumn("id", F.xxhash64("compat_id", "mean", "variance"))
    classes = known.groupBy("id").agg(F.first("compat_id").alias("compat_id"), F.first("mean").alias("mean"), F.first("variance").alias("variance"))
    return classes, known.select("proto_id", "id").distinct()


def _grouped(classes: DataFrame, spec: ClusterSpec) -> DataFrame:
    """``classes`` sorted into groups (compat_id, dim, band, part) that together hold every alike pair.

    Two alike records have mean log variances closer than a width that follows from the
    distance's second term, so each record is sent to its band of that width and the next.
    A record with a value that is no finite number is alike to none.
    """
    # sum of log cosh(d/2) >= count * log cosh(mean d / 2), and half of it must stay under near
    dim = F.size("mean")
    ratio = F.exp(F.lit(2 * spec.near) / dim)
    width = 2 * F.log(ratio + F.sqrt(ratio * ratio - 1)) * (1 + 1e-9)
    finite = "not exists(mean, x -> isnan(x) or abs(x) = double('Infinity')) and not exists(variance, x -> isnan(x) or abs(x) = double('Infinity'))"
    level = F.aggregate("variance", F.lit(0.0), lambda s, x: s + F.ln(F.greatest(x, F.lit(LEAST_VARIANCE)))) / dim
    placed = classes.where(finite).withColumn("own", F.floor(level / width).cast("int")).select("compat_id", dim.alias("dim"), F.explode(F.array("own", F.col("own") + 1)).alias("band"), "own", "id", "mean", "variance")
    placed = placed.withColumn("part", F.lit(0).cast("bigint"))
    big = placed.groupBy("compat_id", "dim", "band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > spec.task_rows)
    big = cut(big.select(F.col("compat_id").alias("bc"), F.col("dim").alias("bd"), F.col("band").alias("bb"), "n"))
    if not big.isEmpty():
        placed = _divided(placed, big, spec)
    spark = classes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.select("compat_id", "dim", "band", "part", "own", "id", "mean", "variance").repartition(parts, "compat_id", "dim", "band", "part").sortWithinPartitions("compat_id", "dim", "band", "part")


def links(classes: DataFrame, spec: ClusterSpec = ClusterSpec()) -> DataFrame:
    """``(a, b, distance)``: links of the similarity graph over class ids, a < b.

    Besides each node's strongest links (with their distance) there are links with a null distance
    from parts that they leave apart to the smallest member of the component within a group, so that
    the links together join exactly the nodes that chains of alike pairs join, and their number
    stays in proportion to the nodes in the densest group.

    """
    rows = _grouped(classes, spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 4):
            if g.num_rows < 2:
                continue
            ids = g.column("id").to_numpy()
            m, v = matrix(g.column("mean")), matrix(g.column("variance"))
            a, b, d, root = _alike(m, v, g.column("own").to_numpy(), g.column("band")[0].as_py(), spec)
            if not len(a) and (root == np.arange(len(ids))).all():
                continue
            part = _roots(len(ids), a, b)
            apart = np.flatnonzero((part == np.arange(len(ids))) & (part != root))
            p, q = np.concatenate((ids[a], ids[apart])), np.concatenate((ids[b], ids[root[apart]]))
            dist = np.concatenate((d, np.full(len(apart), np.nan)))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(dist, from_pandas=True)], ["a", "b", "distance"])

    return rows.mapInArrow(run, "a bigint, b bigint, distance double").groupBy("a", "b").agg(F.min("distance").alias("distance"))


def pairs(classes: DataFrame, spec: ClusterSpec = WHOLE) -> DataFrame:
    """``(a, b, distance, star)``: every link of the similarity graph over class ids, a < b, each once.

    Rows with ``star`` join exactly the nodes that chains of links join and are fewer than two a node
    and group; where such a row is no link itself, its distance is null. Tasks hold their group and
    one piece of a leaf's pairs, never all pairs of a group.
    """
    rows = _grouped(classes, spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 4):
            if g.num_rows < 2:
                continue
            ids = g.column("id").to_numpy()
            m, v = matrix(g.column("mean")), matrix(g.column("variance"))
            mine = g.column("own").to_numpy() == g.column("band")[0].as_py()
            label = np.arange(len(ids))
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            count = 0

            def batch(p: np.ndarray, q: np.ndarray, d: np.ndarray, star: bool) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(d, from_pandas=True), pa.array(np.full(len(d), star))], ["a", "b", "distance", "star"])

            for leaf, seen in _leaves(m, v, spec):
                for a, b, d in _tiles(m, v, leaf, spec.near, seen):
                    ok = mine[a] | mine[b]
                    if not ok.any():
                        continue
                    held.append((a[ok], b[ok], d[ok]))
                    count += len(held[-1][0])
                    if count > 200_000:
                        a, b, d = (np.concatenate(c) for c in zip(*held, strict=True))
                        held, count = [], 0
                        label = _merged(label, a, b)
                        yield batch(ids[a], ids[b], d, False)
            if held:
                a, b, d = (np.concatenate(c) for c in zip(*held, strict=True))
                label = _merged(label, a, b)
                yield batch(ids[a], ids[b], d, False)
            far = np.flatnonzero(label != np.arange(len(ids)))
            yield batch(ids[far], ids[label[far]], np.full(len(far), np.nan), True)

    return rows.mapInArrow(run, "a bigint, b bigint, distance double, star boolean").groupBy("a", "b").agg(F.min("distance").alias("distance"), F.max("star").alias("star"))


def _divided(placed: DataFrame, big: DataFrame, spec: ClusterSpec) -> DataFrame:
    """Give the records of groups over ``task_rows`` the parts of their group they belong to.

    The cuts are fitted per group on a bounded sample; any cut loses no pair, as records within
    the margin go both ways. A part that no cut thins is divided into blocks of about
    2 * ``task_rows`` records, and every two blocks become a part. A plan holds two rows of numbers
    per task, so it is small beside the data it divides.
    """
    same = (F.col("compat_id").eqNullSafe(F.col("bc"))) & (F.col("dim") == F.col("bd")) & (F.col("band") == F.col("bb"))
    hot = placed.join(F.broadcast(big) if big.count() < 50_000 else big, same)
    most = cut(
        hot.select("compat_id", "dim", "band", F.posexplode("variance").alias("j", "x")).groupBy("compat_id", "dim", "band", "j").agg(F.max("x").alias("x"))
        .groupBy("compat_id", "dim", "band").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: F.greatest(s["x"], F.lit(LEAST_VARIANCE))).alias("most"))
    )
    sample = hot.where(F.pmod(F.xxhash64("id", F.lit(7)), F.col("n")) < spec.fit_rows).select("compat_id", "dim", "band", "n", "mean")
    plans: dict[tuple, list] = {}
    scale = {(r["compat_id"], r["dim"], r["band"]): np.sqrt(np.array(r["most"])) for r in most.collect()}
    margin = math.sqrt(8 * spec.near) / 2 * (1 + 1e-9)
    for key, rows in _by_key(sample):
        x = np.array([r["mean"] for r in rows], np.float64)
        x = x[np.isfinite(x).all(1)] / scale[key]
        n = rows[0]["n"]
        nodes: list = []

        def grow(i: np.ndarray, x=x, n=n, nodes=nodes) -> int:
            me = len(nodes)
            nodes.append(None)
            if len(i) * n / max(1, len(x)) > spec.task_rows and len(i) > 64:
                u = _direction(x[i])
                p = x[i] @ u
                at = float(np.median(p))
                left, right = p <= at + margin, p >= at - margin
                if max(left.sum(), right.sum()) <= 0.9 * len(p):
                    nodes[me] = (u, at, grow(i[left]), grow(i[right]))
                else:
                    nodes[me] = -(-round(len(i) * n / max(1, len(x))) // (2 * spec.task_rows))
            return me

        grow(np.arange(len(x)))
        plans[key] = nodes

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy()
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            by: dict[tuple, list[int]] = {}
            for i, key in enumerate(keys):
                by.setdefault(key, []).append(i)
            rows, parts = [], []
            for key, at in by.items():
                nodes = plans.get(key)
                if not nodes:
                    rows += at
                    parts += [0] * len(at)
                    continue
                at = np.array(at)
                x = matrix(b.column("mean").take(pa.array(at))) / scale[key]
                todo = [(0, np.arange(len(at)))]
                while todo:
                    k, i = todo.pop()
                    if not len(i):
                        continue
                    if nodes[k] is None or nodes[k] == 1:
                        rows += at[i].tolist()
                        parts += [k * BLOCKS**2] * len(i)
                        continue
                    if isinstance(nodes[k], int):
                        most = min(nodes[k], BLOCKS - 1)
                        block = ids[at[i]] % most
                        for other in range(most):
                            low, high = np.minimum(block, other), np.maximum(block, other)
                            far = np.flatnonzero(low < high)
                            rows += at[i[far]].tolist()
                            parts += (k * BLOCKS**2 + low[far] * BLOCKS + high[far]).tolist()
                        continue
                    u, cut_at, left, right = nodes[k]
                    p = x[i] @ u
                    edge = margin + _rounding(x.shape[1]) * np.abs(x[i]).sum(1)
                    todo += [(left, i[~(p > cut_at + edge)]), (right, i[~(p < cut_at - edge)])]
            t = b.take(pa.array(rows, pa.int64()))
            yield t.set_column(b.schema.get_field_index("part"), "part", pa.array(parts, pa.int64()))

    return placed.mapInArrow(route, placed.schema)


def _by_key(sample: DataFrame) -> Iterator[tuple[tuple, list]]:
    """The fitted sample group by group, one group in memory at a time."""
    last, rows = None, []
    for r in sample.orderBy("compat_id", "dim", "band").toLocalIterator():
        key = (r["compat_id"], r["dim"], r["band"])
        if rows and key != last:
            yield last, rows
            rows = []
        last = key
        rows.append(r)
    if rows:
        yield last, rows


def flow(graph: DataFrame, spec: ClusterSpec = ClusterSpec()) -> DataFrame:
    """Markov clustering of ``(a, b, weight)``: the limit matrix ``(row, col, p)``, columns summing to 1.

    Every round squares the matrix (a join on the middle index and a sum), raises the entries to
    the inflation power, drops what is below ``prune`` of its column's largest entry or beyond the
    ``partners`` largest (if there is such a number), and divides by the column sum. It ends after ``rounds`` rounds, or
    once every column has all its flow in equal entries.
    """
    both = graph.select(F.col("a").alias("row"), F.col("b").alias("col"), "weight").unionByName(graph.select(F.col("b").alias("row"), F.col("a").alias("col"), "weight"))
    loops = both.groupBy("col").agg(F.max("weight").alias("weight")).select(F.col("col").alias("row"), "col", "weight")
    column = Window.partitionBy("col")
    ranked = Window.partitionBy("col").orderBy(F.col("w").desc(), "row")

    def normal(m: DataFrame, prune: float = spec.prune) -> DataFrame:
        if spec.partners is None:
            m = m.withColumn("top", F.max("w").over(column)).where(F.col("w") >= prune * F.col("top"))
        else:
            m = m.withColumn("rn", F.row_number().over(ranked)).withColumn("top", F.first("w").over(ranked))
            m = m.where((F.col("rn") <= spec.partners) & (F.col("w") >= prune * F.col("top")))
        return m.select("row", "col", (F.col("w") / F.sum("w").over(column)).alias("p"))

    m = cut(normal(both.unionByName(loops).withColumnRenamed("weight", "w"), 0.0))
    for _ in range(spec.rounds):
        left = m.select(F.col("row"), F.col("col").alias("mid"), F.col("p").alias("p1"))
        right = m.select(F.col("row").alias("mid"), "col", F.col("p").alias("p2"))
        # brought together by column once: the sums and the ranks of a column need no second shuffle
        squared = left.join(right, "mid").repartition("col").groupBy("row", "col").agg(F.pow(F.sum(F.col("p1") * F.col("p2")), F.lit(spec.inflation)).alias("w"))
        m = cut(normal(squared))
        unsettled = m.groupBy("col").agg((F.max("p") - F.sum(F.col("p") * F.col("p"))).alias("chaos")).where(F.col("chaos") > 1e-3)
        if unsettled.isEmpty():
            break
    return m


def dense_flow(m: np.ndarray, spec: ClusterSpec = WHOLE) -> np.ndarray:
    """``flow`` without partners, of components of one size at a time: ``m[k]`` holds the weights of the
    k-th in both directions and becomes its limit matrix. Each ends by itself."""
    n = m.shape[-1]
    m[:, np.arange(n), np.arange(n)] = m.max(-2)
    m /= m.sum(-2, keepdims=True)
    going = np.arange(len(m))
    for _ in range(spec.rounds):
        x = np.matmul(m[going], m[going]) if len(m) > 1 else np.matmul(m, m)
        np.power(x, spec.inflation, out=x)
        least = spec.prune * x.max(-2, keepdims=True)
        for lo in range(0, n, 256):  # a few rows at a time, as masks of a large matrix are large too
            part = x[:, lo : lo + 256]
            part[part < least] = 0.0
        x /= x.sum(-2, keepdims=True)
        unsettled = (x.max(-2) - np.einsum("kij,kij->kj", x, x) > 1e-3).any(-1)
        if len(m) > 1:
            m[going] = x
        else:
            m = x
        going = going[unsettled]
        if not len(going):
            break
    return m


def attracted(graph: DataFrame, roots: DataFrame, spec: ClusterSpec = WHOLE) -> DataFrame:
    """``(node, att, strength)``: where the flow of each node with links ends, and the flow that ends in it.

    Flow never leaves a component of ``roots``, so components of up to ``dense_nodes`` nodes are one
    matrix each in some task, unless they are large and thin; the others flow together by joins.
    """
    links = cut(graph.where("distance is not null").select("a", "b", F.exp(-F.col("distance")).alias("weight")).join(roots.select(F.col("node").alias("a"), "root"), "a"))
    size = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min(512, spec.dense_nodes))
    size = size.join(links.groupBy(F.col("root").alias("r")).agg(F.count(F.lit(1)).alias("links")), F.col("root") == F.col("r"))
    joined = cut(size.where((F.col("n") > spec.dense_nodes) | (F.col("links") * 64 < F.col("n") * F.col("n"))).select("root"))
    parts = int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = links if joined.isEmpty() else links.join(joined, "root", "left_anti")
    rows = rows.select("root", "a", "b", "weight").repartition(parts, "root").sortWithinPartitions("root")

    def ends(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        nodes, m = np.stack([h[0] for h in held]), dense_flow(np.stack([h[1] for h in held]) if len(held) > 1 else held.pop()[1][None], spec)
        # equal ends differ by rounding only: the smallest node stands for them
        best = np.stack([np.round(m[:, :, k], 9).argmax(1) for k in range(m.shape[-1])], 1)
        return pa.RecordBatch.from_arrays([pa.array(c.ravel()) for c in (nodes, np.take_along_axis(nodes, best, 1), m.sum(-1))], ["node", "att", "strength"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for g in groups(batches):
            a, b = g.column("a").to_numpy(), g.column("b").to_numpy()
            nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
            n = len(nodes)
            m = np.zeros((n, n))
            a, b = place[: len(a)], place[len(a) :]
            m[a, b] = m[b, a] = g.column("weight").to_numpy()
            del g, place, a, b
            same = held.setdefault(n, [])
            same.append((nodes, m))
            del m
            if len(same) * n * n > 65_536 or len(same) >= 1024:
                yield ends(held.pop(n))
        for n in list(held):
            yield ends(held.pop(n))

    found = rows.mapInArrow(run, "node bigint, att bigint, strength double")
    if joined.isEmpty():
        return found
    m = flow(links.join(joined, "root", "left_semi").select("a", "b", "weight"), spec)
    strength = m.groupBy("row").agg(F.sum("p").alias("strength"))
    best = m.groupBy("col").agg(F.max_by("row", F.struct(F.round("p", 9), -F.col("row"))).alias("att"))
    return found.unionByName(best.join(strength, F.col("col") == F.col("row"), "left").select(F.col("col").alias("node"), "att", F.coalesce("strength", F.lit(0.0)).alias("strength")))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node of each component of ``(u, v)``, for nodes with edges.

    Alternates large and small stars (Kiveris et al., 2014); each round is written out, and it
    ends when every edge leads to a node that leads nowhere, which makes each component one star
    about its smallest node. No component is ever in one task's memory.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while not e.join(e.select(F.col("v").alias("x")).distinct(), F.col("u") == F.col("x"), "left_semi").isEmpty() or not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(low, both["u"] == low["x"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low.select(F.col("u").alias("x"), "m"), F.col("u") == F.col("x"))
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether no node has two edges down, so that each belongs to one star."""
    return e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def clustered(protos: DataFrame, spec: ClusterSpec = ClusterSpec()) -> DataFrame:
    """``(id, proto_id, attractor, root, strength)``: every usable record with the cluster it falls into.

    Markov clustering divides the similarity graph: ``attractor`` is the class its flow ends in, and
    records of one attractor are one Markov cluster. Clusters that are linked by an alike pair are
    then joined, so that ``root`` stands for everything a chain of alike pairs connects. ``strength``
    is the flow that ends in the record's class. Records without alike ones are clusters of one.
    Repeated rows count once; unusable records (see ``records``) are in none; an empty table
    gives no rows.
    """
    classes, members = records(protos)
    classes = cut(classes)
    if spec.partners is None:
        graph = cut(pairs(classes, spec))
        roots = cut(components(graph.where("star").select(F.col("a").alias("u"), F.col("b").alias("v"))))
        ends = attracted(graph, roots, spec).withColumnRenamed("node", "end")
        out = members.join(roots, F.col("id") == F.col("node"), "left").join(ends, F.col("id") == F.col("end"), "left")
        return out.select("id", "proto_id", F.coalesce("att", "id").alias("attractor"), F.coalesce("root", "id").alias("root"), F.coalesce("strength", F.lit(0.0)).alias("strength"))
    graph = cut(links(classes, spec))
    m = flow(graph.where("distance is not null").select("a", "b", F.exp(-F.col("distance")).alias("weight")), spec)
    strength = cut(m.groupBy("row").agg(F.sum("p").alias("strength")))
    best = Window.partitionBy("col").orderBy(F.col("p").desc(), "row")
    attractor = cut(m.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("col", F.col("row").alias("att")))
    own = attractor.where("col <> att").select(F.col("col").alias("u"), F.col("att").alias("v"))
    # a link between two attractors joins their clusters; links inside one cluster add nothing
    one = attractor.select(F.col("col").alias("a"), F.col("att").alias("x"))
    two = attractor.select(F.col("col").alias("b"), F.col("att").alias("y"))
    across = graph.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("x", "a").alias("u"), F.coalesce("y", "b").alias("v")).where("u <> v")
    roots = components(own.unionByName(across))
    out = members.join(roots, F.col("id") == F.col("node"), "left").join(strength, F.col("id") == F.col("row"), "left").join(attractor, F.col("id") == F.col("col"), "left")
    return out.select("id", "proto_id", F.coalesce("att", "id").alias("attractor"), F.coalesce("root", "id").alias("root"), F.coalesce("strength", F.lit(0.0)).alias("strength"))


def p4_found(spark, sf_dir: str) -> DataFrame:
    out = cut(clustered(table(spark, sf_dir, "volatile_positive")))
    size = out.groupBy("root").agg(F.min("proto_id").alias("cluster_key"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return out.join(size, "root").select("cluster_key", "proto_id")


def described(out: DataFrame, protos: DataFrame, by: str) -> DataFrame:
    """Each cluster of ``clustered`` by ``by`` (root or attractor): its smallest proto_id, its records, their
    summed merged_count and the three with the strongest flow."""
    out = out.join(protos.select("proto_id", "merged_count").groupBy("proto_id").agg(F.max("merged_count").alias("merged_count")), "proto_id")
    # the three strongest of each part of a cluster first, so that no task ranks a large cluster whole
    parts = out.withColumn("part", F.pmod(F.xxhash64("proto_id"), F.lit(64)))
    best = F.sort_array(F.collect_list(F.struct((-F.col("strength")).alias("s"), "proto_id")))
    ranked = parts.withColumn("rn", F.row_number().over(Window.partitionBy(by, "part").orderBy(F.col("strength").desc(), "proto_id"))).where("rn <= 3")
    top = ranked.groupBy(F.col(by).alias("tk")).agg(F.slice(best, 1, 3).alias("top"))
    sums = out.groupBy(by).agg(F.min("proto_id").alias("cluster_key"), F.count(F.lit(1)).alias("records"), F.sum("merged_count").alias("merged_count"))
    return sums.join(top, F.col(by) == F.col("tk")).select("cluster_key", "records", "merged_count", *[F.get("top", F.lit(i))["proto_id"].alias(f"typical_{i + 1}") for i in range(3)])


def p4_clusters(spark, sf_dir: str) -> DataFrame:
    """Each cluster of chained records with its records, its summed merged_count and its three most typical members."""
    protos = table(spark, sf_dir, "volatile_positive")
    return described(cut(clustered(protos, WHOLE)), protos, "root")


def p4_markov(spark, sf_dir: str) -> DataFrame:
    """The Markov clusters themselves, by attractor, described in the same way."""
    protos = table(spark, sf_dir, "volatile_positive")
    return described(cut(clustered(protos, WHOLE)), protos, "attractor")


P4_SQL = """
with recursive d as (select distinct proto_id, compat_id, mean, variance from volatile_positive where variance is not null and mean is not null),
e as (select a.proto_id x, b.proto_id y from d a join d b on a.compat_id = b.compat_id and a.proto_id <> b.proto_id and len(a.mean) = len(b.mean)
  where list_sum([pow(a.mean[i] - b.mean[i], 2) / ((greatest(a.variance[i], 1e-8) + greatest(b.variance[i], 1e-8)) / 2) / 8
    + ln((greatest(a.variance[i], 1e-8) + greatest(b.variance[i], 1e-8)) / 2 / sqrt(greatest(a.variance[i], 1e-8) * greatest(b.variance[i], 1e-8))) / 2 for i in range(1, len(a.mean) + 1)]) < 1.5),
r as (select x, y from e union select r.x, e.y from r join e on r.y = e.x)
select min(y) as cluster_key, x as proto_id from (select x, y from r union select x, x from r) group by x
"""
