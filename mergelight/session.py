"""Session helpers: a local test session and lineage cutting."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "mergelight") -> SparkSession:
    """A single-machine session for tests and benches; clusters bring their own."""
    partitions = str(os.cpu_count() if cpus == "*" else cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``.

    A folder of our own is made only where none is named and the session is local.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="mergelight-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


#: Spark removes what a plan shuffled as soon as its action ends; read when the plan is made.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def for_one_action(spark: SparkSession) -> Iterator[None]:
    """Plans that are made inside are for one action: their shuffles go as soon as it ends.

    Else they stay on the executors' disks until the driver happens to collect its garbage, so the
    shuffles of all steps would add up.
    """
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on reliable storage, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    with for_one_action(df.sparkSession):
        own = df.select("*")  # a plan of its own: ``df`` keeps what it shuffles
    return own.checkpoint(eager=True)


def drop_unused(spark: SparkSession) -> None:
    """Collect garbage on the driver, which removes checkpoints and shuffles that nothing refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def by_merge(side: DataFrame) -> DataFrame:
    """``side`` of a join that shuffles and sorts both sides, for tables that grow with the input.

    The planner guesses sizes from compressed files and column types.  It knows neither the rows that
    an ``explode`` makes nor the length of a text, and a checkpoint keeps its guess; where it
    guesses too low, a table of any size would go through the driver to all tasks.
    """
    return side.hint("merge")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once a session, wherever it was started from."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    name = os.path.join(tempfile.mkdtemp(prefix="mergelight-package-"), "mergelight.zip")
    with zipfile.ZipFile(name, "w") as packed:
        for folder, _, files in os.walk(package):
            for file in files:
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    packed.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(name)  # from the driver's disk; executors fetch their own copy


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    """The store that Spark would read ``path`` from, and the path in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder; none where there is no folder."""
    system, place = _file_system(spark, path)
    if not system.exists(place):
        return []
    return [found.getPath().getName() for found in system.listStatus(place)]


def remove_folder(spark: SparkSession, path: str) -> None:
    system, place = _file_system(spark, path)
    system.delete(place, True)
