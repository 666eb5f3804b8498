"""Sessions, shared storage for cut lineage, and joins guarded by a size check."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow key table (tens of bytes a row) may be broadcast.
BROADCAST_ROWS = 500_000
#: Pieces into which each key of a too large join is salted.
SALTS = 16


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that tests and bench share."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("loam")
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on a local master a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="loam-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


_WRITTEN: list[str] = []


def release(spark: SparkSession) -> None:
    """Deletes the tables that materialize wrote. Only once nothing of them is needed: results that are read lazily depend on them. It runs by itself when the driver ends."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    while _WRITTEN:
        p = hadoop(_WRITTEN.pop())
        try:
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the folder may be gone
            pass


def _release_all() -> None:
    try:
        spark = SparkSession.getActiveSession() if _WRITTEN else None
        if spark is not None:
            release(spark)
    except Exception:  # the JVM ended first
        pass


atexit.register(_release_all)


def materialize(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut, a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loam/{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def semi_join(big: DataFrame, keys: DataFrame, on: str, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of big whose `on` is in keys (distinct, materialized). The keys are broadcast only up to `limit` rows."""
    keys = keys.select(on)
    rows = keys.count() if rows is None else rows
    return big.join(F.broadcast(keys) if rows <= limit else keys, on, "left_semi")


def lookup_join(big: DataFrame, small: DataFrame, on: str | Sequence[str], how: str = "inner", rows: int | None = None, limit: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """Inner or left join with small (unique by `on`, materialized), robust to a hot key on the big side.

    Up to `limit` rows small is broadcast; beyond, each key is salted into `salts` pieces, so no task gets a whole hot key."""
    on = [on] if isinstance(on, str) else list(on)
    rows = small.count() if rows is None else rows
    if rows <= limit:
        return big.join(F.broadcast(small), on, how)
    salt = "_salt"
    small = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    big = big.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, kind in big.dtypes if "map" not in kind]), F.lit(salts)).cast("int"))
    return big.join(small, [*on, salt], how).drop(salt)


def read_files(files: Sequence[str], columns: Sequence[str] | None = None, rows: int = 4096) -> Iterator:
    """Arrow batches of parquet files of the shared folder, for a task that reads a table beside its own rows."""
    from pyarrow import fs
    from pyarrow.parquet import ParquetFile

    for name in files:
        system, path = fs.FileSystem.from_uri(name)
        with system.open_input_file(path) as f:
            yield from ParquetFile(f).iter_batches(rows, columns=None if columns is None else list(columns))


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, for tokenizers and the like."""
    return sys.modules.setdefault("_loam_worker_cache", types.ModuleType("_loam_worker_cache")).__dict__


def null_safe_hash(columns: Sequence[str | Column]) -> Column:
    """xxhash64 that tells null from empty and keeps columns apart."""
    cols = [F.col(f"`{c}`") if isinstance(c, str) else c for c in columns]
    return F.xxhash64(*[x for c in cols for x in (c.isNull(), c)])
