"""Session helpers shared by every part of the library."""

from __future__ import annotations

import atexit
import os
import sys
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent.parent


def get_session(app: str = "weftline", cpus: str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session that spark-submit made."""
    b = SparkSession.builder.appName(app).master(f"local[{cpus or '*'}]")
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where the session names none (tests, a laptop) a folder of our own is set.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("WEFTLINE_CHECKPOINT_DIR")
    if not d:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = jdir.get() if jdir.isDefined() else None
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        d = f"file:///tmp/weftline-checkpoints-{os.getuid()}"
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


class Scratch:
    """Tables written in the shared folder to cut lineage; removed with close(), at the latest when Python ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/weftline-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self._leave)  # results are lazy, so the tables stay as long as the session may read them

    def save(self, df: DataFrame, name: str = "t", by: tuple[str, ...] = ()) -> DataFrame:
        """The table written and read again; `by` are columns, its last ones, that make folders."""
        self.n += 1
        p = f"{self.path}/{self.n}-{name}"
        w = df.write.mode("overwrite")
        (w.partitionBy(*by) if by else w).parquet(p)
        return self.spark.read.schema(df.schema).parquet(p)

    def drop(self, name: str) -> None:
        """Remove the tables saved by this name, which nothing reads any more."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*-{name}")
        fs = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for found in fs.globStatus(hadoop) or []:
            fs.delete(found.getPath(), True)

    def _leave(self) -> None:
        try:
            self.close()
        except Exception:  # noqa: BLE001 - the session is gone already
            pass

    def close(self) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


@contextmanager
def hash_joins(spark: SparkSession, most: str = "64m") -> Iterator[None]:
    """While it lasts, adaptive execution may hash a join's side whose every shuffled partition is at most `most`.

    Sizes are those that the shuffle wrote; a join with a larger partition is sorted, which spills. For jobs that
    run inside the block.
    """
    key = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def release_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished steps whose results are saved.

    Its cleaner acts when the JVM collects the plans that refer to them; a long job would else keep
    every step's files on the executors' disks until the driver happens to run short of memory.
    """
    import gc
    import time

    for _ in range(2):  # what Python lets go of reaches the JVM first, then its cleaner, which works beside the next step
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Python workers import weftline by name; send the package where they would not find it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(p and Path(p).resolve() == _ROOT for p in known) or any("weftline" in str(p) for p in sys.path if p.endswith(".zip")):
        return
    import tempfile

    z = Path(tempfile.mkdtemp()) / "weftline.zip"
    with zipfile.ZipFile(z, "w") as f:
        for p in sorted((_ROOT / "weftline").rglob("*.py")):
            f.write(p, p.relative_to(_ROOT))
    sc.addPyFile(str(z))
