"""State of running queries: what each micro-batch adds, as Parquet in the folder that all executors share.

A batch writes its own part, overwriting what an earlier try of it left, and reads the parts of the batches before it; so a batch that
is replayed changes nothing. Every ``MERGE`` batches the parts so far become one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MERGE = 32


class Parts:
    def __init__(self, spark: SparkSession, folder: str, merge: Callable[[DataFrame], DataFrame]):
        """``merge`` brings rows together that later reads may find as one."""
        self.spark, self.folder, self.merge = spark, folder, merge

    def put(self, batch: int, rows: DataFrame) -> DataFrame:
        """Write the part of ``batch`` and return it."""
        self.schema = rows.schema
        if batch and batch % MERGE == 0:
            self.merge(self._read(batch)).write.mode("overwrite").parquet(f"{self.folder}/before-{batch}")
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch-{batch}")
        return self.of(batch)

    def before(self, batch: int) -> DataFrame:
        """All parts before that of ``batch``, whose own part must have been put."""
        if batch % MERGE == 0 and batch:
            return self._open([f"{self.folder}/before-{batch}"])
        return self._read(batch)

    def of(self, batch: int) -> DataFrame:
        return self._open([f"{self.folder}/batch-{batch}"])

    def through(self, batch: int) -> DataFrame:
        return self.before(batch).unionByName(self.of(batch))

    def _read(self, batch: int) -> DataFrame:
        merged = (batch - 1) // MERGE * MERGE
        paths = [f"{self.folder}/before-{merged}"] if merged > 0 else []
        return self._open(paths + [f"{self.folder}/batch-{i}" for i in range(max(merged, 0), batch)])

    def _open(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
