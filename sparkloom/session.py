"""Sessions, and tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_open: list[list[str]] = []
_swept: set[str] = set()


def session(name: str = "sparkloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; master only where given."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a new local folder if all runs in one JVM, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="loom-")
        atexit.register(shutil.rmtree, local, True)
        found = "file://" + local
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _own_dir(spark: SparkSession) -> str:
    """The application's own part of the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/loom/{spark.sparkContext.applicationId}"
    if path not in _swept:
        fs, target = _fs(spark, path)
        fs.mkdirs(target)
        fs.deleteOnExit(target)
        _swept.add(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: its lineage ends there, and lost executors take nothing with them."""
    path = f"{_own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _open:
        made.append(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._loom_path = path
    return back


def made(spark: SparkSession, name: str) -> str:
    """A new folder's path in the application's part of the shared folder."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def listed(spark: SparkSession, path: str) -> list[str]:
    """The folders in a folder, none if it is not there."""
    fs, target = _fs(spark, path)
    return [str(x.getPath()) for x in fs.listStatus(target) if x.isDirectory()] if fs.exists(target) else []


def removed(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, target = _fs(spark, path)
        fs.delete(target, True)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """stored(df), and its number of rows, taken while it is written: one job."""
    seen = Observation()
    return stored(df.observe(seen, F.count(F.lit(1)).alias("n")), name), seen.get["n"]


def dropped(*frames: DataFrame) -> None:
    """Delete what stored() wrote, when nothing reads it any more."""
    for df in frames:
        if path := getattr(df, "_loom_path", None):
            fs, target = _fs(df.sparkSession, path)
            fs.delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete, at the end, all that stored() wrote inside, but for the frames in the list that is given."""
    made, kept = [], []
    _open.append(made)
    try:
        yield kept
    finally:
        _open.pop()
        stay = {getattr(df, "_loom_path", None) for df in kept}
        for path in made:
            if path not in stay:
                fs, target = _fs(spark, path)
                fs.delete(target, True)
