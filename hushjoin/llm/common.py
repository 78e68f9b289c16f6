"""Helpers the training-data operators share: scratch tables, batch limits, row mapping."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

# Words are runs of anything but the six ASCII blanks.
WORD = re.compile("[^\x20\x09-\x0d]+")

#: What one Arrow batch may hold. A batch is in memory several times: in the executor's JVM, and in its worker as Arrow and as Python values.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where it is unset, a local session (tests) gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _local_dir()
    return found.rstrip("/")


@cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="hushjoin-")


_scopes: list[list[Scratch]] = []


@contextlib.contextmanager
def scratch_scope() -> Iterator[None]:
    """Delete all scratch tables that operators called inside have made. Results must have been written before it ends."""
    made: list[Scratch] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for scratch in made:
            scratch.drop_all()


class Scratch:
    """Tables written to the shared folder, so that lineage is cut and lost executors cost nothing."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/hushjoin-{uuid.uuid4().hex}"
        self.n = 0
        if _scopes:
            _scopes[-1].append(self)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def _delete(self, path: str) -> None:
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            if t is not None:
                self._delete(t._scratch_path)

    def drop_all(self) -> None:
        self._delete(self.root)


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limits of an Arrow batch, where they are higher, so that long texts do not add up in executors.

    Limits count when a plan runs, long after an operator has returned it, so they stay.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("bB"))
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Word memos of this Python worker. They are emptied after each task, since idle workers stay beside the JVM.
CACHES: list[dict] = []


def release() -> None:
    for c in CACHES:
        c.clear()
    gc.collect()
    trim()


def trim() -> None:
    """Give free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_columns(df: DataFrame, fn: Callable[[], Callable[[dict[str, list]], dict]], ddl: str | StructType) -> DataFrame:
    """Map batches of df, as a dict of Python lists, to a dict of columns. fn() runs once a task and returns
    the mapper, whose attribute `last`, if it has one, gives the columns that follow the last batch."""
    bounded_batches(df.sparkSession)
    schema = _parse_datatype_string(ddl) if isinstance(ddl, str) else ddl
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper = fn()
        for batch in batches:
            if batch.num_rows:
                out = mapper(batch.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        if last := getattr(mapper, "last", None):
            out = last()
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        del mapper
        release()

    return df.mapInArrow(run, schema)


#: So many rows of one key may meet in a task; more where more than HOT_KEYS keys could be hot.
HOT_ROWS, HOT_KEYS = 100_000, 200_000


def join_hot(rows: DataFrame, keyed: DataFrame, key: str | list[str], total: int, by: str) -> DataFrame:
    """Inner join of rows with keyed, which has each key once and in its column n how many of the `total` rows meet it.

    Rows of a hot key are dealt to several tasks by a hash of column `by`, and the key's row is copied to each. What is broadcast
    are the hot keys alone: n adds up to total, so that there are at most HOT_KEYS of them.
    """
    key = [key] if isinstance(key, str) else key
    most = max(HOT_ROWS, total // HOT_KEYS)
    if total <= most:
        return rows.join(keyed.drop("n"), key)
    deals = F.ceil(F.col("n") / most).cast("int")
    hot = F.broadcast(keyed.filter(F.col("n") > most).select(*key, deals.alias("__deals")))
    dealt = rows.join(hot, key, "left").withColumn("__deal", F.when(F.col("__deals").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), "__deals")).cast("int")).drop("__deals")
    copied = keyed.withColumn("__deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("n")
    return dealt.join(copied, [*key, "__deal"]).drop("__deal")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, n: int):
    """crc32 of the id's decimal text, modulo n; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def worker_threads() -> None:
    """One thread for each Python worker: executors already run one worker a core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
