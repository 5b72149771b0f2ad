"""A value index that is kept up to date file by file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcheck.session import scratch_path, versions

MANIFEST = "tbl string, file string, size long, changed long, part string"
_ENTRIES = "tbl string, file string, col string, value string, n long"


class ValueStore:
    """The values of all columns of some tables with their numbers of rows, by file.

    The folder holds one parquet part for each refresh that found new files, with (tbl, file, col, value, n), and a manifest
    for each state: which files the index knows, by size and time, and the part that holds each. A refresh reads new
    and changed files only; entries of lost files are left where they are and no longer read. A refresh that fails leaves
    the manifest before it in force.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _states(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(p.toString() for p in found if fs.exists(done(p, "_SUCCESS")))

    def manifest(self) -> list:
        """The files that the index knows; a row per file."""
        states = self._states()
        return self.spark.read.schema(MANIFEST).parquet(states[-1]).collect() if states else []

    def refresh(self, tables: dict[str, Sequence[str]]) -> list[str]:
        """Brings the index to the state of ``tables`` (table -> its files or folders of parquet); the files that were read."""
        now = {(t, *f) for t, paths in tables.items() for p in paths for f in versions(self.spark, p) if f[0].endswith(".parquet")}
        known = {(r["tbl"], r["file"], r["size"], r["changed"]): r["part"] for r in self.manifest()}
        kept = {f: known[f] for f in now if f in known}
        new = sorted(now - set(known))
        part = scratch_path(self.spark, "values") if not new else f"{self.folder}/part-{len(self._states()):08d}"
        frames = [self._entries(t, [f[1] for f in new if f[0] == t]) for t in dict.fromkeys(f[0] for f in new)]
        for at, frame in enumerate(frames):
            frame.write.mode("overwrite" if at == 0 else "append").parquet(part)
        rows = [(*f, p) for f, p in kept.items()] + [(*f, part) for f in new]
        if new or len(kept) < len(known) or not self._states():
            state = f"{self.folder}/manifest/state-{len(self._states()):08d}"
            self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(state)
        return [f[1] for f in new]

    def _entries(self, tbl: str, files: list[str]) -> DataFrame:
        frame = self.spark.read.parquet(*files).select("*", F.col("_metadata.file_path").alias("__file"))
        columns = [c for c in frame.columns if c != "__file"]
        pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
        cells = frame.select(F.lit(tbl).alias("tbl"), F.col("__file").alias("file"), F.inline(pairs)).where("value IS NOT NULL")
        return cells.groupBy("tbl", "file", "col", "value").agg(F.count(F.lit(1)).alias("n"))

    def index(self) -> DataFrame:
        """(tbl, col, value, n): the distinct values of the tables as of the last refresh, with their numbers of rows."""
        rows = self.manifest()
        parts = sorted({r["part"] for r in rows})
        if not parts:
            return self.spark.createDataFrame([], "tbl string, col string, value string, n long")
        entries = self.spark.read.schema(_ENTRIES).parquet(*parts).withColumn("part", F.regexp_extract(F.col("_metadata.file_path"), r"(part-\d+)/[^/]*$", 1))
        live = self.spark.createDataFrame([(r["tbl"], r["file"], r["part"].rsplit("/", 1)[1]) for r in rows], "tbl string, file string, part string")
        # a row per file; a file that was written anew has entries in an older part too, which don't count
        return entries.join(live, ["tbl", "file", "part"], "left_semi").groupBy("tbl", "col", "value").agg(F.sum("n").alias("n"))
