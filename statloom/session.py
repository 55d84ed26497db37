"""Session settings the operators read."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A local session without the setting uses the warehouse folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return f"{shared_dir(spark)}/statloom/{name}-{uuid.uuid4().hex}"


_owners: list[list[str]] = []


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def scratch(spark: SparkSession):
    """Owns what operators write inside it, and gives the space back at its end. Use results inside, or write them elsewhere.
    The files of a shuffle go when its query is done; else they stay until the driver collects its garbage.

    with scratch(spark):
        joins.outer_join_with_name_fallback(a, b, "id", "name").write.parquet(target)
    """
    mine: list[str] = []
    _owners.append(mine)
    try:
        with setting(spark, FREE_SHUFFLES, "true"):
            yield mine
    finally:
        _owners[:] = [o for o in _owners if o is not mine]
        give_back(spark, *mine)


_settings: dict[tuple[int, str], list] = {}
_settings_lock = threading.Lock()


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """Holds a setting of the session; threads that hold it at the same time share it, and the last one puts the old value back."""
    at = id(spark._jsparkSession), key
    with _settings_lock:
        held = _settings.setdefault(at, [0, spark.conf.get(key, None)])
        held[0] += 1
        spark.conf.set(key, value)
    try:
        yield
    finally:
        with _settings_lock:
            held[0] -= 1
            if not held[0]:
                del _settings[at]
                spark.conf.unset(key) if held[1] is None else spark.conf.set(key, held[1])


def owned(path: str) -> str:
    """The path, which the scratch around gives back at its end."""
    if _owners:
        _owners[-1].append(path)
    return path


def give_back(spark: SparkSession, *paths: str) -> None:
    """Leaves tables of the shared folder empty."""
    nothing = spark.range(0, 0, 1, 1)
    for path in paths:
        nothing.write.mode("overwrite").parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, for sessions whose workers cannot import it."""
    import statloom

    if getattr(spark, "_statloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(statloom.__file__)))
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "statloom"), "zip", root, "statloom")
    spark.sparkContext.addPyFile(made)
    spark._statloom_shipped = True


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes a table to the shared folder and reads it back: short lineage that outlives lost executors.

    For steps that read their input several times; the table is then computed once.
    """
    path = owned(fresh_path(df.sparkSession, name))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, written as by cut; the intermediate tables of its making give their space back."""
    path = owned(fresh_path(spark, name))
    with scratch(spark):
        made = make()
        made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Spreads a scanned table over the cores before work that is heavy per row, when its scan has fewer splits.

    A table of many files or row groups is left as it is, and so is one that a shuffle has spread already
    (asking for its partitions would run the shuffle).
    """
    if df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
