"""Stores of snapshots: an append log of runs as partitioned files, read as the latest row of each key.

A run is a partition. Writing it again replaces it, so a job that is repeated after a failure leaves the same rows. Deletes are rows of
their own; a compaction writes what is kept as the next generation, and readers take the newest generation that has been written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.samples import first_rows

#: Columns of the store itself.
GENERATION, RUN, DELETED = "store_generation", "store_run", "store_deleted"


class SnapshotStore:
    """path: a folder that all executors share. keys: what a row is known by. Runs are in the order of their names."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path, keys
        self.columns = spark.createDataFrame([], schema).schema
        clash = {GENERATION, RUN, DELETED} & set(self.columns.names)
        if clash or not set(keys) <= set(self.columns.names):
            raise ValueError(f"columns have to hold the keys, and not {sorted(clash)}")

    def _put(self, rows: DataFrame, generation: int, run: Column, deleted: Column) -> None:
        named = rows.select(*self.columns.names, deleted.alias(DELETED), F.lit(generation).alias(GENERATION), run.alias(RUN))
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(GENERATION, RUN).parquet(self.path)

    def append(self, run: str, rows: DataFrame) -> None:
        """The rows of a run, in place of what it wrote before."""
        self._put(rows, self.generation(), F.lit(run), F.lit(False))

    def delete(self, run: str, keys: DataFrame) -> None:
        """All rows of these keys (a table of the key columns) that earlier runs wrote."""
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.columns if f.name not in self.keys]
        self._put(keys.select(*self.keys).distinct().select(*self.keys, *empty), self.generation(), F.lit(run), F.lit(True))

    def _files(self) -> DataFrame:
        all_columns = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in self.columns), f"{DELETED} boolean", f"{GENERATION} int", f"{RUN} string"])
        return self.spark.read.schema(all_columns).parquet(self.path)

    def generation(self) -> int:
        """The newest generation; the names of the partitions say it, no file is read."""
        try:
            return self._files().agg(F.max(GENERATION)).first()[0] or 0
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return 0
            raise

    def rows(self) -> DataFrame:
        """All rows that no later run has deleted, with the run that wrote them."""
        now = self._files().filter(F.col(GENERATION) == self.generation())
        gone = now.filter(DELETED).groupBy(*[F.col(k).alias(f"_{k}") for k in self.keys]).agg(F.max(RUN).alias("_gone"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys]
        kept = now.filter(~F.col(DELETED)).join(gone, [*same, F.col("_gone") >= F.col(RUN)], "left_anti")
        return kept.select(*self.columns.names, RUN)

    def latest(self, *order: str) -> DataFrame:
        """The last row of each key: by the order of these columns, then by run."""
        rest = [c for c in self.columns.names if c not in self.keys]
        best = self.rows().groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*order, RUN, *[c for c in rest if c not in order])).alias("_row"))
        return best.select(*self.keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*self.columns.names)

    def retain(self, order: list[Column], newest: int, keep: Column | None = None) -> None:
        """Compaction: of each key the newest rows in this order, and the newest one for which keep holds, become the next generation."""
        rows = self.rows()
        kept = first_rows(rows, self.keys, order, newest, "_n").drop("_n")
        if keep is not None:
            kept = kept.union(first_rows(rows.filter(keep), self.keys, order, 1, "_n").drop("_n")).distinct()
        self._put(kept, self.generation() + 1, F.col(RUN), F.lit(False))
