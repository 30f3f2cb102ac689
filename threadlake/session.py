"""Spark session, table access and staged tables."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def get_spark(app: str = "threadlake", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects; on a cluster spark-submit sets its own master."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset a local session (tests) gets a temporary folder of its own; on a cluster that would be a different disc for every executor, so
    there it is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("threadlake.shared.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="threadlake-")
        spark.conf.set("threadlake.shared.dir", found)
    return found


class Staging:
    """Owner of the intermediate tables written while it is open: ``with Staging(spark): ...`` removes them at its end.

    Results are lazy, so what is read from staged tables must be written or collected inside. Without an owner the tables stay until the program
    ends, and are removed then.
    """

    open: ClassVar[list[Staging]] = []
    program: ClassVar[Staging | None] = None

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Staging:
        Staging.open.append(self)
        return self

    def __exit__(self, *_: object) -> None:
        Staging.open.remove(self)
        self.clear()

    def clear(self) -> None:
        """Remove what was written."""
        while self.paths:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    @classmethod
    def owner(cls, spark: SparkSession, lasting: bool = False) -> Staging:
        """The innermost open owner, or the one of the whole program."""
        if cls.open and not lasting:
            return cls.open[-1]
        if cls.program is None:
            cls.program = cls(spark)
            atexit.register(cls.program._at_end)
        return cls.program

    def _at_end(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone, and its folders with it
            self.clear()


def new_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A fresh path below the shared folder, removed by its owner (see ``Staging``), or at the end of the program if it is ``lasting``."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    Staging.owner(spark, lasting).paths.append(path)
    return path


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and losing an executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_folder(spark: SparkSession, path: str) -> bool:
    """True where ``path`` is a folder (a table of many files) rather than one file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def stamp(spark: SparkSession, path: str) -> str:
    """What tells one state of a table's files from another: their names, sizes and times."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return "|".join(sorted(f"{x.getPath()} {x.getLen()} {x.getModificationTime()}" for x in found))


def in_tasks(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in a fixed number of tasks, for steps whose work isn't shown by the bytes they read.

    A shuffle of given size isn't merged into fewer tasks afterwards; a grouping by the same keys needs no other one.
    """
    return df.repartition(max(1, min(n, 10_000)), *keys)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt over all cores where its files give fewer tasks than there are cores (a table of one file); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table; zone-less timestamps are read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    casts = {f.name: F.col(f"`{f.name}`").cast("timestamp") for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns(casts) if casts else df
