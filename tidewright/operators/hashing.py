"""Vector kernels and hyperplane hashing: sign words, bucket joins, probing, reliability of bits."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import stats
from tidewright.session import cut, join_small, table

TABLES, BITS = 8, 10


# kernels ----------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def add(a: Column, b: Column, ca: float = 1.0, cb: float = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: x * ca + y * cb)


def scale(a: Column, k: float) -> Column:
    return F.transform(a, lambda x: x * k)


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def rms_norm(a: Column, eps: float = 1e-6) -> Column:
    r = F.sqrt(dot(a, a) / F.size(a) + eps)
    return F.transform(a, lambda x: x / r)


def kernel_similarity(m1: Column, v1: Column, m2: Column, v2: Column, gamma: float = 1.0) -> Column:
    from tidewright.operators.vault import gaussian_distance

    return F.exp(-gamma * gaussian_distance(m1, v1, m2, v2))


def mean_vectors(rows: DataFrame, key: str, vector: str, weight: Column | None = None) -> DataFrame:
    """Weighted mean vector of each group, place by place."""
    w = F.lit(1.0) if weight is None else weight
    flat = rows.select(key, w.alias("w"), F.posexplode(vector).alias("j", "x"))
    means = flat.groupBy(key, "j").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("mean"))


# planes and words -------------------------------------------------------------------------------


def plane_value(table_: int, bit: int, j: int) -> int:
    """Component of a hyperplane, a small integer from a multiplicative rule."""
    x = ((table_ * BITS + bit + 1) * 2654435761 + (j + 1) * 40503 * (bit + 7)) & 0xFFFFFFFF
    x ^= x >> 15
    return (x * 2246822519 & 0xFFFFFFFF) % 2001 - 1000


def planes(dim: int, tables: int = TABLES, bits: int = BITS) -> np.ndarray:
    return np.array([[[plane_value(t, b, j) for j in range(dim)] for b in range(bits)] for t in range(tables)], np.float64)


def sign_words(rows: DataFrame, ident: str, vector: str, p: np.ndarray) -> DataFrame:
    """``(id, table, word, margins)``: the sign bits of every vector in every table, lowest bit first."""
    tables, bits, dim = p.shape

    def run(frames):
        import pandas as pd

        for f in frames:
            x = np.stack(f[vector]).astype(np.float64)
            d = np.einsum("nd,tbd->ntb", x, p)
            words = (d > 0).astype(np.int64) @ (1 << np.arange(bits))
            yield pd.DataFrame({"id": np.repeat(f[ident].to_numpy(), tables), "table": np.tile(np.arange(tables), len(f)), "word": words.ravel(), "margins": list(d.reshape(-1, bits))})

    fit = rows.where(F.size(vector) == dim).select(ident, vector)
    return fit.mapInPandas(run, "id bigint, table int, word bigint, margins array<double>")


def margin_order(margins: Column) -> Column:
    """Bits by rising distance from their plane, ties by number."""
    return F.transform(F.array_sort(F.transform(margins, lambda x, i: F.struct(F.abs(x).alias("m"), i.alias("i")))), lambda s: s["i"])


def single_bit_keys(word: Column, margins: Column, budget: int) -> Column:
    """The word and the words with one of its ``budget`` least certain bits turned."""
    return F.concat(F.array(word), F.transform(F.slice(margin_order(margins), 1, budget), lambda i: word.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))))


def perturbations(margins: list[float], most_flips: int = 2, budget: int = 8) -> list[tuple[int, ...]]:
    """Sets of bits to turn, cheapest sum of margins first."""
    near = sorted(range(len(margins)), key=lambda i: (abs(margins[i]), i))[: 2 * budget]
    sets = [c for k in range(1, most_flips + 1) for c in itertools.combinations(near, k)]
    return sorted(sets, key=lambda c: (sum(abs(margins[i]) for i in c), c))[:budget]


def apply_flips(word: int, bits: tuple[int, ...]) -> int:
    for b in bits:
        word ^= 1 << b
    return word


def widened_keys(word: Column, margins: Column, depth: Column) -> Column:
    """All words that agree with ``word`` in its ``depth`` most certain bits."""
    free = F.slice(margin_order(margins), F.lit(1), F.size(margins) - depth)
    turned = lambda acc, i: F.concat(acc, F.transform(acc, lambda x: x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))))
    return F.aggregate(free, F.array(word), turned)


def shared_buckets(words: DataFrame, queries: DataFrame, keys: Column) -> DataFrame:
    """``(query, id, tables)``: ids in one of the buckets ``keys`` of a query, and in how many tables."""
    probes = queries.select(F.col("id").alias("query"), "table", F.explode(keys).alias("word"))
    return probes.join(words.select("table", "word", "id"), ["table", "word"]).groupBy("query", "id").agg(F.countDistinct("table").alias("tables"))


def candidates(words: DataFrame, queries: DataFrame, budget: int = 3) -> DataFrame:
    """``(query, id, tables)``: ids that share a probed bucket with a query, and in how many tables."""
    return shared_buckets(words, queries, single_bit_keys(F.col("word"), F.col("margins"), budget))


def needed_depth(kth: Column, miss: float, tables: int = TABLES, bits: int = BITS) -> Column:
    """How many bits may be asked for so that a vector of cosine ``kth`` agrees with a query in them
    in one of the tables with chance ``1 - miss``."""
    keep = 1 - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), kth))) / math.pi
    depth = F.floor(math.log(1 - miss ** (1 / tables)) / F.log(keep))
    return F.when(keep >= 1, bits).when(keep <= 0, 0).otherwise(F.least(F.lit(bits), depth)).cast("int")


def scanned(vectors: DataFrame, queries: DataFrame, k: int, tile: int = 20_000) -> DataFrame:
    """``(query, id)``: each query of ``(query, qv)`` against all of ``(id, v)`` in tiles, the ``k`` best of each."""
    cols, rows = max(1, -(-vectors.count() // tile)), max(1, -(-queries.count() // tile))
    v = vectors.withColumns({"c": F.pmod(F.hash("id"), F.lit(cols)), "r": F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))})
    q = queries.withColumns({"r": F.pmod(F.hash("query"), F.lit(rows)), "c": F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))})

    def meet(a, b):
        import pandas as pd

        b = b.sort_values("id")
        ids, out = b["id"].to_numpy(), [pd.DataFrame({"query": np.zeros(0, np.int64), "id": np.zeros(0, np.int64)})]
        if len(a) and len(b):
            x, y = (np.stack(z).astype(np.float64) for z in (a["qv"], b["v"]))
            x, y = (z / np.where((n := np.linalg.norm(z, axis=1, keepdims=True)) > 0, n, 1) for z in (x, y))
            for lo in range(0, len(a), 512):
                asks = a["query"].to_numpy()[lo : lo + 512]
                cos = np.round(x[lo : lo + 512] @ y.T, 6)
                cos[asks[:, None] == ids[None, :]] = -2
                best = np.argsort(-cos, axis=1, kind="stable")[:, :k]
                out.append(pd.DataFrame({"query": np.repeat(asks, best.shape[1]), "id": ids[best.ravel()]}))
        return pd.concat(out)

    return q.groupBy("c", "r").cogroup(v.groupBy("c", "r")).applyInPandas(meet, "query bigint, id bigint").where("query <> id")


def nearest_by_buckets(vectors: DataFrame, k: int = 5, budget: int = 3, miss: float = 0.02) -> DataFrame:
    """For the vectors whose id is divisible by 100 the ``k`` most similar.

    First the buckets of the word and of its ``budget`` least certain bits. The k-th cosine then
    tells in how many bits such a neighbour agrees in one of the tables with chance ``1 - miss``;
    a query that asked for more meets all buckets that agree in that many of its most certain
    bits, and where these would hold as much as the whole, every vector once. ``tables`` counts
    the tables of a shared bucket: 0 for what only the whole search found."""
    p = planes(64)
    words = cut(sign_words(vectors, "vec_id", "embedding", p))
    asked = words.where("id % 100 = 0")
    fit = vectors.where(F.size("embedding") == 64)
    a = fit.select(F.col("vec_id").alias("query"), F.col("embedding").alias("qv"))
    b = fit.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))

    def best(found):
        once = found.where("query <> id").groupBy("query", "id").agg(F.max("tables").alias("tables"))
        scored = once.join(b, "id").join(a, "query").withColumn("cosine", F.round(cosine(F.col("qv"), F.col("v")), 6))
        w = Window.partitionBy("query").orderBy(F.col("cosine").desc(), "id")
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "id", "cosine", "rank", "tables")

    first = cut(best(candidates(words, asked, budget)))
    kth = first.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("cosine")).otherwise(-1.0).alias("kth"))
    wider = cut(asked.join(kth.withColumnRenamed("query", "_q"), F.col("id") == F.col("_q"), "left").withColumn("depth", needed_depth(F.coalesce("kth", F.lit(-1.0)), miss)).drop("_q", "kth"))
    whole = int(math.log2(TABLES))  # all tables at this depth hold as much as one scan
    some = shared_buckets(words, wider.where(f"depth > {whole} and depth < {BITS}"), widened_keys(F.col("word"), F.col("margins"), F.col("depth")))
    rest = scanned(b, cut(wider.where(f"depth <= {whole}").select(F.col("id").alias("query")).distinct().join(a, "query")), k)
    return best(first.select("query", "id", "tables").unionByName(some).unionByName(rest.withColumn("tables", F.lit(0).cast("bigint"))))


# reliability ------------------------------------------------------------------------------------


def flip_probability(variance: float, noise: float) -> float:
    return math.acos(math.sqrt(variance / (variance + noise))) / math.pi if variance + noise > 0 else 0.5


def binary_entropy(q: float) -> float:
    return 0.0 if q <= 0 or q >= 1 else -q * math.log2(q) - (1 - q) * math.log2(1 - q)


def bit_information(variance: float, noise: float) -> float:
    return 1 - binary_entropy(flip_probability(variance, noise))


def reliability_weight(variance: float, noise: float) -> float:
    return 1 - 2 * flip_probability(variance, noise)


def poisson_binomial(probs: list[float]) -> np.ndarray:
    """Chances of each number of turned bits."""
    pmf = np.array([1.0])
    for q in probs:
        pmf = np.convolve(pmf, [1 - q, q])
    return pmf


def poisson_binomial_quantile(probs: list[float], coverage: float = 0.9) -> int:
    return int(np.searchsorted(np.cumsum(poisson_binomial(probs)), coverage - 1e-12))


def containment_depth(margins: list[float], flips: list[float], coverage: float = 0.9) -> int:
    """How many of the least certain bits must be probed so that no other bit has turned with that chance."""
    by = sorted(range(len(margins)), key=lambda i: (abs(margins[i]), i))
    for k in range(len(by) + 1):
        if np.prod([1 - flips[i] for i in by[k:]]) >= coverage:
            return k
    return len(by)


def bit_reliability(words: DataFrame, share: float = 0.1) -> DataFrame:
    """Per table and bit of ``sign_words``: the variance of the margin, the chance that noise of ``share`` of the
    tables' mean variance turns the bit, its entropy, the information and weight left, and its rank by weight."""
    flat = words.select("table", F.posexplode("margins").alias("bit", "m"))
    per = flat.groupBy("table", "bit").agg(F.var_pop("m").alias("variance"))  # a row a bit
    noise = F.avg("variance").over(Window.partitionBy("table")) * share
    q = F.acos(F.sqrt(F.col("variance") / (F.col("variance") + F.col("noise")))) / math.pi
    per = per.withColumn("noise", noise).withColumn("flip", F.when(F.col("variance") + F.col("noise") > 0, q).otherwise(0.5))
    flip = F.col("flip")
    entropy = F.when((flip <= 0) | (flip >= 1), 0.0).otherwise(-flip * F.log2(flip) - (1 - flip) * F.log2(1 - flip))
    rank = F.row_number().over(Window.partitionBy("table").orderBy("flip", "bit"))
    return per.select("table", "bit", "variance", "flip", entropy.alias("entropy"), (1 - entropy).alias("information"), (1 - 2 * flip).alias("weight"), rank.alias("rank"))


def flips(words: DataFrame, sigma: float, coverage: float = 0.9) -> DataFrame:
    """``(id, table, expected, none, depth)`` under noise of deviation ``sigma`` on the margins: how many bits turn on
    average, the chance that none does, and how many of the least certain bits must be probed so that no
    other has turned with chance ``coverage``."""
    q = F.transform(F.array_sort(F.transform("margins", lambda x, i: F.struct(F.abs(x).alias("m"), i.alias("i")))), lambda s: 1 - stats.normal_cdf(s["m"] / sigma))
    rows = words.select("id", "table", q.alias("q"))
    kept = lambda a: F.aggregate(a, F.lit(1.0), lambda p, x: p * (1 - x))
    bits = F.size("q")
    # the chance grows with every bit left out, so the depth is the number of prefixes that do not suffice
    short = F.filter(F.sequence(F.lit(1), bits), lambda k: kept(F.slice("q", k, bits)) < coverage)
    return rows.select("id", "table", F.aggregate("q", F.lit(0.0), lambda s, x: s + x).alias("expected"), kept(F.col("q")).alias("none"), F.size(short).alias("depth"))


def weighted_hamming(a: Column, b: Column, weights: list[float]) -> Column:
    """Sum of the weights of the bits in which two words differ."""
    x = a.bitwiseXOR(b)
    return sum((F.when(F.getbit(x, F.lit(i)) == 1, w).otherwise(0.0) for i, w in enumerate(weights)), F.lit(0.0))


def collision_probability(cos: Column) -> Column:
    return 1 - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))) / math.pi


def principal_components(x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions of greatest variance and their variances, of rows about their mean."""
    d = x - x.mean(0)
    w, v = np.linalg.eigh(d.T @ d / len(d))
    return v[:, ::-1][:, :count].T, w[::-1][:count]


def covariance_cells(vectors: DataFrame, vector: str, dim: int) -> DataFrame:
    """``(i, j, cov)`` for i <= j, the population covariance: every task sums its products into one matrix, and
    the matrices are added cell by cell in an aggregate. Vectors of another length or with nulls are left out."""

    def run(frames):
        import pandas as pd

        n, s, ss = 0, np.zeros(dim), np.zeros((dim, dim))
        for f in frames:
            if len(f):
                x = np.stack(f[vector]).astype(np.float64)
                n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        a, b = np.triu_indices(dim)
        if n:
            yield pd.DataFrame({"i": a.astype(np.int32), "j": b.astype(np.int32), "n": np.full(len(a), n), "si": s[a], "sj": s[b], "ss": ss[a, b]})

    fine = vectors.select(vector).where((F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull()))
    parts = fine.mapInPandas(run, "i int, j int, n bigint, si double, sj double, ss double")
    t = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "ss")])
    return t.select("i", "j", (F.col("ss") / F.col("n") - F.col("si") / F.col("n") * F.col("sj") / F.col("n")).alias("cov"))


def covariance(vectors: DataFrame, vector: str, dim: int) -> np.ndarray:
    """``covariance_cells`` as a matrix of ``dim`` x ``dim``."""
    out = np.zeros((dim, dim))
    for r in covariance_cells(vectors, vector, dim).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["cov"]
    return out


def aligned_planes(cov: np.ndarray, tables: int = TABLES, bits: int = BITS, seed: int = 1) -> np.ndarray:
    """Planes along the leading components, turned at random within them."""
    w, v = np.linalg.eigh(cov)
    lead = v[:, ::-1][:, : max(bits, int((w > w.mean()).sum()))]
    rng = np.random.default_rng(seed)
    return np.stack([(lead @ np.linalg.qr(rng.standard_normal((lead.shape[1], lead.shape[1])))[0][:, :bits]).T for _ in range(tables)])


def q_words(spark, sf_dir):
    return sign_words(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", planes(64, 2)).select(F.col("id").alias("vec_id"), "table", "word")


def q_nearest(spark, sf_dir):
    return nearest_by_buckets(table(spark, sf_dir, "embeddings"))


def q_label_means(spark, sf_dir):
    """Distance of every embedding from its label's mean, as cosine."""
    e = table(spark, sf_dir, "embeddings")
    m = cut(mean_vectors(e, "label", "embedding"))
    j = join_small(e, m.withColumnRenamed("label", "l"), F.col("label") == F.col("l"), row_bytes=800)
    return j.select("vec_id", "label", F.round(cosine(F.col("embedding"), F.col("mean")), 6).alias("cosine"))


def q_weighted_hamming(spark, sf_dir):
    """Of every vector and its label's first vector the weighted distance of their words."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    words = cut(sign_words(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", planes(64, 1))).select(F.col("id").alias("vec_id"), "word")
    rows = e.join(words, "vec_id")
    first = cut(rows.groupBy(F.col("label").alias("l")).agg(F.min_by("word", "vec_id").alias("w0")))
    j = join_small(rows, first, F.col("label") == F.col("l"))
    return j.select("vec_id", F.round(weighted_hamming(F.col("word"), F.col("w0"), [1 / (i + 1) for i in range(BITS)]), 6).alias("distance"))


def _words(spark, sf_dir, tables: int = 1):
    return sign_words(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", planes(64, tables))


def q_reliability(spark, sf_dir):
    out = bit_reliability(_words(spark, sf_dir, 2))
    return out.select("table", "bit", F.round("variance", 4).alias("variance"), *[F.round(c, 8).alias(c) for c in ("flip", "entropy", "information", "weight")], "rank")


def q_probe_keys(spark, sf_dir):
    """The word of every vector and the three words with one of its least certain bits turned, in that order."""
    keys = _words(spark, sf_dir).select(F.col("id").alias("vec_id"), F.posexplode(single_bit_keys(F.col("word"), F.col("margins"), 3)).alias("place", "key"))
    return keys


def q_flips(spark, sf_dir):
    out = flips(_words(spark, sf_dir), 300.0)
    return out.select(F.col("id").alias("vec_id"), F.round("expected", 7).alias("expected"), F.round("none", 7).alias("none"), "depth")


def q_covariance(spark, sf_dir):
    out = covariance_cells(table(spark, sf_dir, "embeddings"), "embedding", 64)
    return out.select("i", "j", F.round("cov", 9).alias("cov"))


def q_collisions(spark, sf_dir):
    """Per label: the chance that a member's bit equals its label mean's, on average, and that of the average cosine."""
    e = table(spark, sf_dir, "embeddings")
    m = cut(mean_vectors(e, "label", "embedding"))
    j = join_small(e, m.withColumnRenamed("label", "l"), F.col("label") == F.col("l"), row_bytes=800).withColumn("c", F.round(cosine(F.col("embedding"), F.col("mean")), 9))
    return j.groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.round(F.avg(collision_probability(F.col("c"))), 7).alias("average"), F.round(collision_probability(F.avg("c")), 7).alias("first_order"))


def _bit(t: int, b: int) -> str:
    return f"(list_sum(list_transform(list_zip(embedding, [{', '.join(str(plane_value(t, b, j)) for j in range(64))}]), lambda z: z[1]::double * z[2])) > 0)::bigint * {1 << b}"


_WORD = {t: " + ".join(_bit(t, b) for b in range(BITS)) for t in (0, 1)}
WORDS_SQL = " union all ".join(f"select vec_id, {t}::int as table, {w} as word from embeddings" for t, w in _WORD.items()).replace(" as table", ' as "table"')
MEANS_SQL = """with f as (select label, unnest(embedding)::double x, generate_subscripts(embedding, 1) j from embeddings), m as (select label, list(x order by j) mean from (select label, j, avg(x) x from f group by 1, 2) group by 1)
select vec_id, e.label, round(list_sum(list_transform(list_zip(embedding, mean), lambda z: z[1]::double * z[2])) / (sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(mean, lambda x: x * x)))), 6) as cosine
from e join m using (label)""".replace("from e join", "from embeddings e join")
HAMMING_SQL = f"""with w as (select vec_id, label, {_WORD[0]} word from embeddings), f as (select label, arg_min(word, vec_id) w0 from w group by 1)
select vec_id, round({' + '.join(f"((xor(word::bigint, w0::bigint) >> {i}) & 1) * {1 / (i + 1)!r}::double" for i in range(BITS))}, 6) as distance from w join f using (label)"""

_MARGIN = "list_sum(list_transform(list_zip(embedding, [{v}]), lambda z: z[1]::double * z[2]))"


def _margins_sql(tables: int) -> str:
    one = " union all ".join(f"select vec_id, {t}::int tb, {b}::int bit, " + _MARGIN.format(v=", ".join(str(plane_value(t, b, j)) for j in range(64))) + " m from embeddings" for t in range(tables) for b in range(BITS))
    return f"mg as ({one})"


RELIABILITY_SQL = f"""with {_margins_sql(2)}, v as (select tb, bit, var_pop(m) v from mg group by 1, 2), n as (select *, avg(v) over (partition by tb) * 0.1 n from v), f as (select *, acos(sqrt(v / (v + n))) / pi() q from n),
e as (select *, case when q <= 0 or q >= 1 then 0 else -q * log2(q) - (1 - q) * log2(1 - q) end h from f)
select tb as "table", bit, round(v, 4) as variance, round(q, 8) as flip, round(h, 8) as entropy, round(1 - h, 8) as information, round(1 - 2 * q, 8) as weight, row_number() over (partition by tb order by q, bit) as rank from e"""
PROBE_SQL = f"""with {_margins_sql(1)}, w as (select vec_id, sum((m > 0)::int::bigint << bit)::bigint word from mg group by 1), o as (select vec_id, bit, row_number() over (partition by vec_id order by abs(m), bit) place from mg)
select vec_id, 0 as place, word as key from w union all select vec_id, place::int, xor(word, (1::bigint << bit)) from o join w using (vec_id) where place <= 3"""
FLIPS_SQL = f"""with {_margins_sql(1)}, q as (select vec_id, 1 - {{cdf}} q, row_number() over (partition by vec_id order by abs(m), bit) k from mg), s as (select *, exp(sum(ln(1 - q)) over (partition by vec_id order by k desc)) left_ from q)
select vec_id, round(sum(q), 7) as expected, round(max(left_) filter (where k = 1), 7) as none, count_if(left_ < 0.9)::int as depth from s group by 1"""
COVARIANCE_SQL = """with f as (select vec_id, unnest(embedding)::double x, generate_subscripts(embedding, 1) - 1 j from embeddings)
select a.j::int as i, b.j::int as j, round(covar_pop(a.x, b.x), 9) as cov from f a join f b on a.vec_id = b.vec_id and a.j <= b.j group by 1, 2"""
COLLISION_SQL = MEANS_SQL.replace("select vec_id, e.label, round(", "select e.label, round(").replace(", 6) as cosine", ", 9) c")
COLLISION_SQL = f"select label, count(*) as members, round(avg(1 - acos(greatest(-1, least(1, c))) / pi()), 7) as average, round(1 - acos(greatest(-1, least(1, avg(c)))) / pi(), 7) as first_order from ({COLLISION_SQL}) group by 1"

QUERIES = {"sign_words": (q_words, WORDS_SQL), "bucket_nearest": (q_nearest, None), "label_mean_cosine": (q_label_means, MEANS_SQL), "weighted_hamming": (q_weighted_hamming, HAMMING_SQL),
    "bit_reliability": (q_reliability, RELIABILITY_SQL), "probe_keys": (q_probe_keys, PROBE_SQL), "bit_flips": (q_flips, FLIPS_SQL.format(cdf=stats.normal_cdf_sql("(abs(m) / 300.0)"))), "embedding_covariance": (q_covariance, COVARIANCE_SQL), "label_collisions": (q_collisions, COLLISION_SQL)}
