"""Stored tables that change by partition.

A table is Parquet below `data`, partitioned by its own columns and, last, by `gen`, the write that made the files. A
line of the log names the folders that count. A change reads the partitions that it touches, writes them as a new
generation and appends a line; all other files stay as they are, with their names. Readers take the folders of the last
line, so they see whole states only, and a change that failed in between has changed nothing. There is one writer at a
time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

LOG = "at timestamp, live array<string>"


@dataclass(frozen=True)
class Table:
    """`schema` is that of the rows with the partition columns `by`."""

    spark: SparkSession
    folder: str
    schema: str
    by: tuple[str, ...]

    def live(self) -> list[str]:
        """The folders that count, relative to `data`: week=2026-W10/gen=..."""
        try:
            log = self.spark.read.schema(LOG).parquet(f"{self.folder}/log")
        except AnalysisException:
            return []
        return log.agg(F.max_by("live", "at")).first()[0] or []

    def read(self, folders: Iterable[str] | None = None) -> DataFrame:
        """All rows, or those of some of the folders. Other folders are not even listed."""
        found = self.live() if folders is None else list(folders)
        if not found:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, gen string").option("basePath", f"{self.folder}/data").parquet(*[f"{self.folder}/data/{p}" for p in found])
        return rows.drop("gen")

    def folders_of(self, rows: DataFrame) -> list[str]:
        """The live folders in which `rows`, a filter of `read()`, has rows."""
        files = rows.select(F.col("_metadata.file_path").alias("f")).distinct()
        parents = files.select(F.regexp_replace("f", "/[^/]*$", "").alias("f")).distinct()
        found = [unquote(r["f"]) for r in parents.collect()]
        return [p for p in self.live() if any(f.endswith(f"/data/{p}") for f in found)]

    def touched(self, values: DataFrame) -> list[str]:
        """The live folders of the partitions in `values`, which has some of the partition columns; as many rows reach the
        driver as there are partitions at most."""
        cols = [c for c in self.by if c in values.columns]
        wanted = {tuple(f"{c}={self._escaped(str(v))}" for c, v in zip(cols, r, strict=True)) for r in values.select(*cols).distinct().collect()}
        return [p for p in self.live() if any(set(w) <= set(p.split("/")) for w in wanted)]

    def _escaped(self, value: str) -> str:
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)

    def append(self, rows: DataFrame) -> list[str]:
        return self.replace(rows, [])

    def replace(self, rows: DataFrame, old: list[str]) -> list[str]:
        """`rows` in place of the folders `old`; gives the folders that were written."""
        gen = uuid.uuid4().hex
        spread = rows.hint("rebalance", *self.by) if self.by else rows
        spread.withColumn("gen", F.lit(gen)).write.mode("append").partitionBy(*self.by, "gen").parquet(f"{self.folder}/data")
        new = self._written(gen)
        kept = [p for p in self.live() if p not in set(old)]
        line = self.spark.createDataFrame([([*kept, *new],)], "live array<string>").select(F.current_timestamp().alias("at"), "live")
        line.coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        return new

    def _written(self, gen: str) -> list[str]:
        found = self._fs().globStatus(self._path("/".join([f"{self.folder}/data", *["*"] * len(self.by), f"gen={gen}"])))
        return sorted("/".join(s.getPath().toString().split("/")[-len(self.by) - 1 :]) for s in found)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def discard(self, folders: Iterable[str]) -> None:
        """Deletes folders that no longer count; older states can't be read after that."""
        now = set(self.live())
        for p in folders:
            if p not in now:
                self._fs().delete(self._path(f"{self.folder}/data/{p}"), True)

    def upsert(self, new: DataFrame, keys: list[str], arrival: str) -> list[str]:
        """Rows of `new` take the place of those of the same key; of several, the last to arrive. Only their partitions are
        read and written, so the keys must hold (or determine) the partition columns. Gives the folders replaced."""
        last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(arrival)))
        fresh = new.withColumn("__n", last).filter("__n = 1").drop("__n", arrival)
        old = self.touched(fresh)
        rows = self.read(old)
        self.replace(rows.join(fresh.select(*keys), keys, "left_anti").select(rows.columns).unionByName(fresh.select(rows.columns)), old)
        return old

    def delete(self, old: list[str], gone: DataFrame, keys: list[str]) -> int:
        """Takes the rows of `gone` (by `keys`) out of the folders `old` and deletes what these held. Gives the number of
        rows that are gone, counted in what was written."""
        if not old:
            return 0
        before = self.read(old)
        n = before.count()
        new = self.replace(before.join(gone.select(*keys).distinct(), keys, "left_anti").select(before.columns), old)
        self.discard(old)
        return n - self.read(new).count()


def bucket(column: Column, buckets: int) -> Column:
    """A partition column that spreads ids evenly."""
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")
