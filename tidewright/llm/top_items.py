"""Problem 5: the N best items of every group by a secondary sort that streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import table

#: Parts that one group is spread over in the first round; a group with most of the rows is then
#: sorted by as many tasks. Each part sends on at most N rows.
SALTS = 32


def _first_n(group: str, ident: str, n: int):
    """Arrow batches sorted by group and rank in, the first ``n`` distinct ids of each group out.

    Only the current group's value and its ids so far (at most ``n``) are kept between batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, taken = object(), set()
        for b in batches:
            if not b.num_rows:
                continue
            names = b.schema.names
            keys = b.column(names.index(group))
            ids = b.column(names.index(ident))
            run_ends = pc.run_end_encode(keys)
            ends = np.asarray(run_ends.run_ends)
            keep: list[int] = []
            start = 0
            for end, value in zip(ends.tolist(), run_ends.values.to_pylist(), strict=True):
                if value != current:
                    current, taken = value, set()
                i = start
                while len(taken) < n and i < end:
                    x = ids[i].as_py()
                    if x not in taken:
                        taken.add(x)
                        keep.append(i)
                    i += 1
                start = end
            if keep:
                yield b.take(pa.array(keep, pa.int64()))

    return run


def top_n(df: DataFrame, group: str, ident: str, order: list[tuple[str, bool]], n: int = 5) -> DataFrame:
    """The first ``n`` rows of each ``group`` by ``order``, pairs of column and descending; nulls last.

    Ties end with ``ident`` ascending in byte order. Rows are hash-partitioned by group and a
    salt of the id, sorted inside the partitions, and read as a stream of Arrow batches of which
    each group's first ``n`` pass (parts of one group that share a partition need not be told
    apart: the first ``n`` of their union suffice); a second round does the same by group over what passed. No
    group is ever held in memory, and repeated rows of one id, which land in one part, count once
    with their best row. A null group is a group; rows with a null id are left out; an empty
    table gives no rows. Only the named columns are read and returned.
    """
    cols = list(dict.fromkeys([group, *[c for c, _ in order], ident]))
    rows = df.select(*cols).where(F.col(ident).isNotNull())
    rank = [F.col(group).asc_nulls_first(), *[F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order], F.col(ident).asc()]
    cut_off = _first_n(group, ident, n)
    salt = F.pmod(F.xxhash64(ident), F.lit(SALTS))
    some = rows.repartition(F.col(group), salt).sortWithinPartitions(*rank).mapInArrow(cut_off, rows.schema)
    return some.repartition(F.col(group)).sortWithinPartitions(*rank).mapInArrow(cut_off, rows.schema)


def p5_found(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "volatile_positive").where("importance is not null and not isnan(importance)")
    return top_n(rows, "compat_id", "proto_id", [("importance", True), ("last_accessed", True)], 5).select("compat_id", "proto_id")


P5_SQL = """
with d as (select distinct compat_id, proto_id, importance, last_accessed from volatile_positive where importance is not null)
select compat_id, proto_id from (select *, row_number() over (partition by compat_id order by importance desc, last_accessed desc nulls last, proto_id) rn from d) where rn <= 5
"""
