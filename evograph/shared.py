"""The folder that driver and executors share, lineage cuts in it, and this package on the workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def is_local(spark: SparkSession) -> bool:
    """Do driver and tasks run in one process? (local-cluster has executors of its own.)"""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master alone, a folder made here if that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    set_by_hand = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_by_hand.isDefined():
        return set_by_hand.get()
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(where := f"file://{tempfile.mkdtemp(prefix='evograph-')}")
    return where


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder; later reads don't run df's plan again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def merge_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of sides that may be far larger than the planner takes them to be: neither goes through the driver as a broadcast."""
    return left.join(right.hint("merge"), on, how)


def ship(spark: SparkSession) -> None:
    """Makes this package known to Python workers: in one process by its path, else as a zip that Spark hands to executors."""
    root, sc = Path(__file__).resolve().parents[1], spark.sparkContext
    if is_local(spark):
        sc.environment.setdefault("PYTHONPATH", str(root))
        return
    if getattr(sc, "_evograph_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="evograph-")) / "evograph.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.glob("evograph/**/*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(path))
    sc._evograph_shipped = True
