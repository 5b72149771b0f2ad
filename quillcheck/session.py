"""Session helpers shared by tests, the benchmark and the operators."""

from __future__ import annotations

import os
import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[tuple, str] = {}


def local_session(cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A session for one machine; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillcheck")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", os.environ.get("QUILLCHECK_SCRATCH", f"/tmp/quillcheck-{os.getpid()}"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the one named in ``spark.checkpoint.dir``, else one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not named and warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        warnings.warn("spark.checkpoint.dir is not set and the warehouse is a local path: executors may not share it", stacklevel=2)
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch").rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame, label: str = "settled") -> DataFrame:
    """Write ``df`` once as a table in the shared folder and go on from there.

    Used for a result that several later steps read, and where a later step must see the
    very same rows twice: lineage ends here, so a lost executor cannot change them.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def versions(spark: SparkSession, root: str) -> tuple:
    """Name, size and time of every file under ``root``: another state of the tables is another key."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def parts_of(spark: SparkSession, root: str, size: int = 2 << 20) -> int:
    """Into how many parts rows derived from the tables under ``root`` are dealt: one per ``size`` bytes of their files, 12 at least.

    Never fewer than a shuffle has: Spark deals both sides of a join of fewer parts out anew, and each of those tasks then
    writes a file to every bucket.
    """
    least = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(least, sum(size_ for _, size_, _ in versions(spark, root)) // size)


def once(spark: SparkSession, root: str, label: str, make: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """``settled(make())``, but written only the first time a session asks for ``label`` of the tables under ``root``.

    For tables that belong to a database rather than to a query: its value index, its map of key columns, its clause tables.
    They are made anew when a file under ``root`` has changed. With ``by`` the rows are kept in buckets of that column, so
    that what is grouped or joined by it later needs no shuffle; ``make`` deals them into ``parts_of`` parts by it.
    """
    key = (spark.sparkContext.applicationId, label, versions(spark, root))
    if key not in _WRITTEN:
        path = scratch_path(spark, label)
        if by is None:
            make().write.parquet(path)
        else:
            table = "quillcheck_" + uuid.uuid4().hex
            make().write.bucketBy(parts_of(spark, root), by).option("path", path).saveAsTable(table, format="parquet")
            path = table
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key]) if by is None else spark.table(_WRITTEN[key])
