"""Sessions and the folder that a cluster's machines share."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import SparkSession


def local(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session in this process, for tests, benchmarks and notebooks."""
    conf = {"spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    return SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """This application's part of ``spark.checkpoint.dir``, without a trailing slash. A single process may go without the setting and
    gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _temporary(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/weir-{spark.sparkContext.applicationId}"


@functools.cache
def _temporary(application: str) -> str:
    return tempfile.mkdtemp(prefix="weir-")
