"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: AQE re-plans from measured sizes: it turns a sort-merge join into a broadcast join when a side
#: proves small, and splits a partition that one hot key has filled. The library therefore forces no
#: broadcast except for sides whose row count it bounds itself.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Parquet grows about threefold in memory; broadcast decisions compare the grown size.
    "spark.sql.sources.fileCompressionFactor": "3.0",
    # HotSpot does not compile methods above 8000 bytes. A stage that would need one (an import with its
    # many checks) runs faster as separate operators whose code is split.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(master: str | None = None, app: str = "sojourn", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Codec of what the library stores as parquet: about a quarter smaller than the default one.
CODEC = "zstd"

#: Folders made within the innermost ``stored_copies`` block.
_open_runs: list[list[str]] = []


def scratch_dir(spark: SparkSession, label: str, scratch: str | None = None) -> str:
    """A fresh path on shared storage: below ``scratch``, else ``spark.checkpoint.dir``, else the warehouse.

    Executors exchange the files, so a cluster without any of these on shared storage is refused.
    """
    base = scratch or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        local = base.startswith(("file:", "/"))
        if local and not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; {base} is local")
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if _open_runs:
        _open_runs[-1].append(path)
    return path


@contextmanager
def stored_copies(spark: SparkSession) -> Iterator[None]:
    """Removes the stored copies made inside the block when it ends; finish with the results before that."""
    _open_runs.append([])
    try:
        yield
    finally:
        for path in _open_runs.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and return the stored copy.

    Used for results that several branches of a plan read, and for the side of a join that an aggregate
    has reduced. Unlike a cache the copy survives lost executors, and unlike ``checkpoint()`` it is
    computed once and read back with column pruning. For joins it has two more merits: the planner
    knows the size of the stored side and broadcasts it only below its threshold, and beyond that both
    sides come straight from a shuffle, which is the shape adaptive execution can split hot keys in.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path, compression=CODEC)
    return df.sparkSession.read.schema(df.schema).parquet(path)
