"""What the corpus operators share: the shared folder, small tables in it, Arrow row plumbing."""

from __future__ import annotations

import tempfile
import uuid
import weakref
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a function of ``map_rows`` gets at once; Spark's own batches are larger.
SLICE = 1000
#: Code points that the word rules of several operators treat as white space.
ASCII_SPACE = " \t\n\x0b\x0c\r"


#: Word tables of a Python worker, which serves the tasks of many operators one after another.
_TABLES: list[dict] = []


def only_table(table: dict) -> None:
    """Called when a task begins: of the worker's word tables, its operator's own is kept."""
    if not any(t is table for t in _TABLES):
        _TABLES.append(table)
    for other in _TABLES:
        if other is not table:
            other.clear()


#: Temporary folders by application, where the session names none.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset, on one machine, is
    a temporary folder made, once for each application.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="crosswind-")
    return _OWN[app]


def stored(spark: SparkSession, df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read again: lineage ends there.

    A table much smaller than the corpus is written by an eighth of the shuffle's tasks.
    """
    if small:
        df = df.coalesce(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _STORED[table] = path
    return table


#: Where stored tables are, for ``discard``.
_STORED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes stored tables that no later step reads; all that was made of them is stored itself."""
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STORED.pop(table))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """The key and the text alone, null text as the empty string."""
    return df.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def map_rows(df: DataFrame, schema: T.StructType, make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """``mapInArrow`` where ``make()`` runs once a task and returns a function from a batch to columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into, work = to_arrow_schema(schema), make()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                got = work(whole.slice(at, SLICE))
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) if not isinstance(got[f.name], pa.Array) else got[f.name] for f in into], schema=into)

    return df.mapInArrow(run, schema)


def by_position(docs: DataFrame, needed: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs`` with names that can't clash; its result has the input's columns, and gets their names back.

    A needed column is the one of its very name, or else the first that differs in case only; all others are named by their place, whatever dots,
    quotes or capitals their names have.
    """
    names = docs.columns
    own: dict[int, str] = {}
    for name in needed:
        found = [i for i, n in enumerate(names) if n == name] or [i for i, n in enumerate(names) if n.lower() == name]
        if not found:
            raise ValueError(f"no column {name}")
        own[found[0]] = name
    return work(docs.toDF(*[own.get(i, f"_column{i}") for i in range(len(names))])).toDF(*names)


def crc_mod(doc_id: F.Column, by: int) -> F.Column:
    """crc32 of the id as text, modulo ``by``: the folds of the held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(by)


def crc_mod_of(doc_id: int, by: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % by
