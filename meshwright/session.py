"""Session helpers shared by every operator: checkpoints that survive lost executors."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; a temporary folder takes its place on a local master only (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries made inside delete their shuffle files when they end; a lost one is made again by its stage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder, cut its lineage there and drop its shuffle files."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    with dropping_shuffles(spark):
        return df.select("*").checkpoint(eager=True)
