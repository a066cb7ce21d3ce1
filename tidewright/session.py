"""Session-level helpers: the shared folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its rows times its estimated row width stay under this.
BROADCAST_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own;
    on a cluster the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tidewright-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This ends the lineage, so a lost executor costs a re-read and not a recomputation.
    The table goes when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewright-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: dict[tuple, DataFrame] = {}


def written_once(source: DataFrame, what: str, build) -> DataFrame:
    """``build(source)`` as a written table that later queries of the session read again, as long as the
    files behind ``source`` stay the same (name, length and time of change). A source that is not
    read from files is built anew each time, and so is one whose folder cannot be listed."""
    spark = source.sparkSession
    files = source.inputFiles()
    if not files:
        return build(source)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    stamps = []
    for folder in sorted({f.rsplit("/", 1)[0] for f in files}):
        place = jvm.org.apache.hadoop.fs.Path(folder)
        names = {f.rsplit("/", 1)[1] for f in files if f.rsplit("/", 1)[0] == folder}
        for s in place.getFileSystem(conf).listStatus(place):
            if s.getPath().getName() in names:
                stamps.append((folder, s.getPath().getName(), s.getLen(), s.getModificationTime()))
    if len(stamps) != len(set(files)):
        return build(source)
    key = (spark.sparkContext.applicationId, what, source.semanticHash(), hash(tuple(sorted(stamps))))
    if key not in _WRITTEN:
        _WRITTEN[key] = cut(build(source))
    return _WRITTEN[key]


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", row_bytes: int = 96) -> DataFrame:
    """Join with a side that is usually small: broadcast below ``BROADCAST_BYTES``, shuffled beyond.

    ``small`` is counted, so it should be a written table (see ``cut``).
    """
    fits = small.count() * row_bytes <= BROADCAST_BYTES
    return big.join(F.broadcast(small) if fits else small, on, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
