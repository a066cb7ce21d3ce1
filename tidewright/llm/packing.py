"""Problem 7: items of varying length into containers of fixed capacity.

Minimum bin slack on the multiset of lengths. There are at most ``capacity`` different
lengths however many items there are, so the plan is made on their counts: a container is
filled by subset-sum dynamic programming on a bitset, the choice is traced back to counts per
length, and the same filling is repeated as often as the counts allow. The items are then
numbered within their length in parallel and looked up in the plan.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import cut, join_small, table

TOKENIZERS = "/opt/tokenizers"
#: Parts that the items of one length are spread over while they are numbered.
SHARDS = 64


@lru_cache(maxsize=2)
def _vocabulary(folder: str, name: str) -> tuple[str, dict[bytes, int]]:
    """``(split pattern, ranks)`` of a public tokenizer's files, read on the driver."""
    import sys
    from importlib import util
    from pathlib import Path

    spec = util.spec_from_file_location("tokenizer_files", Path(folder) / "__init__.py")
    files = util.module_from_spec(spec)
    sys.modules.setdefault("tokenizer_files", files)
    spec.loader.exec_module(files)
    with open(Path(folder) / name, "rb") as f:
        return files.PATTERN, {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_encoders: dict[str, object] = {}


def _encoder(key: str, shipped):
    """The tokenizer of a broadcast vocabulary, made once in each worker."""
    if key not in _encoders:
        import tiktoken

        pattern, ranks = shipped.value
        _encoders[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``(doc_id, n_tokens)`` of every document with a text; empty texts have 0, null texts are left out.

    The vocabulary (about a megabyte, however many documents) is read on the driver and broadcast,
    so workers need no copy of its folder."""
    shipped, key = documents.sparkSession.sparkContext.broadcast(_vocabulary(folder, name)), f"{folder}/{name}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(key, shipped)
        for b in batches:
            counts = [len(enc.encode_ordinary(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    kind = dict(documents.dtypes)[id_col]
    return documents.where(F.col(text_col).isNotNull()).select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens bigint")


def fill_once(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most ``counts`` of each, whose sum comes closest to ``room``
    from below: ``{length: times}``. Bit i of a layer says that sum i can be reached."""
    layers: list[tuple[int, int, int]] = []
    reach, mask = 1, (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if 0 < x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:  # k copies at a time: 1, 2, 4, ...
            take = min(k, left)
            layers.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, k = left - take, k * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(layers):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, dict[int, int]]]:
    """Containers for a histogram of lengths: ``(first container, how many, {length: per container})``.

    The longest item left opens a container, which fill_once completes; the filling is repeated
    while every length it uses lasts, so each round uses up at least one length.
    """
    left = {x: n for x, n in counts.items() if n > 0 and x > 0}
    out, first = [], 0
    while left:
        head = max(left)
        left[head] -= 1
        used = fill_once(left, capacity - head)
        left[head] += 1
        used[head] = used.get(head, 0) + 1
        times = min(left[x] // k for x, k in used.items())
        for x, k in used.items():
            left[x] -= k * times
            if not left[x]:
                del left[x]
        out.append((first, times, used))
        first += times
    return out


def pack(sized: DataFrame, capacity: int = 4096) -> DataFrame:
    """``(container, doc_id, piece, n_tokens)``: every item of ``(doc_id, n_tokens)`` placed once.

    An item longer than the capacity is split into full pieces, each a container of its own, and
    a rest that is packed like any item; no other item is split. Items of length 0 take no room
    and share container 0. Nulls in n_tokens leave the row out; repeated rows are items of their
    own; an empty table gives no rows.

    The histogram has at most ``capacity`` rows, and the plan at most ``capacity`` fillings, at
    any number of items; both are sized by the capacity and safe on the driver. Ranks within a
    length come from counts per length and shard, so equal lengths do not meet in one task.
    """
    sized = sized.select("doc_id", "n_tokens").where(F.col("n_tokens").isNotNull() & (F.col("n_tokens") >= 0))
    full = F.expr(f"cast(n_tokens div {capacity} as int)")
    rest = F.col("n_tokens") - full * capacity
    whole = sized.where(full > 0).select("doc_id", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"), F.lit(capacity).cast("bigint").alias("len"))
    rests = sized.where((rest > 0) | (full == 0)).select("doc_id", full.alias("piece"), rest.alias("len"))
    items = whole.unionByName(rests).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SHARDS)))
    per = items.groupBy("len", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("len").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(per.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))))
    counts = {r["len"]: r["n"] for r in offsets.groupBy("len").agg(F.sum("n").alias("n")).collect()}
    fillings = plan(counts, capacity)
    starts: dict[int, list[tuple[int, int, int]]] = {}
    used_up: dict[int, int] = {}
    for first, times, used in fillings:
        for x, k in used.items():
            at = used_up.get(x, 0)
            starts.setdefault(x, []).append((at, k, first))
            used_up[x] = at + k * times
    lengths = np.array([x for x, rows in starts.items() for _ in rows], np.int64)
    at, per_bin, first = (np.array([r[i] for rows in starts.values() for r in rows], np.int64) for i in range(3))
    order = np.lexsort((at, lengths))
    lengths, at, per_bin, first = lengths[order], at[order], per_bin[order], first[order]
    begins = {int(x): int(i) for x, i in zip(*np.unique(lengths, return_index=True), strict=True)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("len").to_numpy(zero_copy_only=False)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            box = np.zeros(len(n), np.int64)
            for x in np.unique(n).tolist():
                if x in begins:
                    rows = n == x
                    lo = begins[x]
                    hi = lo + int(np.searchsorted(lengths[lo:], x, "right"))
                    i = lo + np.searchsorted(at[lo:hi], rank[rows], "right") - 1
                    box[rows] = first[i] + (rank[rows] - at[i]) // per_bin[i]
            yield pa.RecordBatch.from_arrays([pa.array(box), b.column("doc_id"), b.column("piece"), b.column("len")], ["container", "doc_id", "piece", "n_tokens"])

    inside = Window.partitionBy("len", "shard").orderBy("doc_id", "piece")
    offs = offsets.select(F.col("len").alias("ol"), F.col("shard").alias("os"), "start")
    numbered = items.withColumn("rn", F.row_number().over(inside) - 1)
    numbered = join_small(numbered, offs, (F.col("len") == F.col("ol")) & (F.col("shard") == F.col("os")))
    kind = dict(sized.dtypes)["doc_id"]
    return numbered.select("doc_id", "piece", "len", (F.col("start") + F.col("rn")).alias("rank")).mapInArrow(place, f"container bigint, doc_id {kind}, piece int, n_tokens bigint")


def p7_packed(spark, sf_dir: str) -> DataFrame:
    """Whole documents into containers of 4,096 tokens; tokenised once, then planned on counts."""
    return pack(cut(token_counts(table(spark, sf_dir, "documents"))), 4096)


def p7_packed_characters(spark, sf_dir: str) -> DataFrame:
    """Whether a packing is right, in one row: documents sized in characters into containers of 16,384. Pieces
    and characters placed, containers over capacity (none may be), pieces of a split document that do not
    fill their container (its last one only), and whether the containers are within a hundredth of the fewest possible."""
    room = 16_384
    sized = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("n_chars").alias("n_tokens"))
    out = cut(pack(sized, room))
    box = out.groupBy("container").agg(F.sum("n_tokens").alias("fill"))
    boxes = box.agg(F.count_if(F.col("fill") > 0).alias("boxes"), F.count_if(F.col("fill") > room).alias("over"), F.sum("fill").alias("chars"))
    doc = out.groupBy("doc_id").agg(F.count_if(F.col("n_tokens") < room).alias("short"), F.count(F.lit(1)).alias("pieces"))
    docs = doc.agg(F.count(F.lit(1)).alias("documents"), F.sum("pieces").alias("pieces"), F.count_if(F.col("short") > 1).alias("torn"))
    both = boxes.crossJoin(F.broadcast(docs))
    return both.select("documents", "pieces", "chars", "over", "torn", (F.col("boxes") <= 1 + F.ceil(F.col("chars") / room) * 1.01).alias("tight"))


P7_CHARACTERS_SQL = """
select count(*) as documents, sum(n_chars // 16384 + (n_chars % 16384 > 0 or n_chars = 0)::int)::bigint as pieces, sum(n_chars)::bigint as chars, 0 as "over", 0 as torn, true as tight from documents where text is not null
"""
