"""The folder that driver and executors share, and tables kept there."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders by application, where the session names none.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; only on one machine, where that is unset, a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="crosswind-"))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder under a name of its own, and read again."""
    return keyed(spark, lambda: df, f"{name}-{uuid.uuid4().hex}")


def keyed(spark: SparkSession, make: Callable[[], DataFrame], key: str) -> DataFrame:
    """What ``make`` gives under a key that names its content: made and written once, and only read where a whole table is there."""
    path = f"{shared_dir(spark)}/{key}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def signature(spark: SparkSession, tables: list[str], *settings: str) -> str:
    """A digest of settings and of the tables' files by path, size and time of change: equal only for the same work on the same files."""
    digest, conf = hashlib.sha256("\0".join(settings).encode()), spark._jsc.hadoopConfiguration()
    for table in tables:
        at = spark._jvm.org.apache.hadoop.fs.Path(table)
        files = at.getFileSystem(conf).listFiles(at, True)
        found = []
        while files.hasNext():
            one = files.next()
            found.append(f"{one.getPath().toString()} {one.getLen()} {one.getModificationTime()}")
        digest.update("\n".join(sorted(found)).encode())
    return digest.hexdigest()[:32]
