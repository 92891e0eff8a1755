"""What the operators share: tables written to the cluster's shared folder, and Arrow text access."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

_OWN_ROOT: dict[str, str] = {}
_OPEN: list[Tables] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset a folder of our own, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _OWN_ROOT.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='strandex-')}")
    return root


class Tables:
    """Intermediate results of one operator call, written as Parquet to the shared folder.

    Reading a written table cuts lineage and survives the loss of executors. ``drop`` removes a
    table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        _OPEN.append(self)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{name}"
        self.names.add(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        self.names -= set(names)
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def only(self, *names: str) -> None:
        """Removes all tables but these, which the caller's result still reads."""
        self.drop(*self.names - set(names))


def opened() -> int:
    """How many operator calls have opened tables so far (see ``sweep``)."""
    return len(_OPEN)


def sweep(since: int, keep: Tables) -> None:
    """Removes the tables of all calls since then but one's: what read them has been written."""
    for tables in _OPEN[since:]:
        if tables is not keep:
            tables.only()
    _OPEN[since:] = []


def _trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; when they are done, freed memory goes back. Python workers outlive their
    tasks, and would hold what the largest of them once needed beside the next tasks and the executor's heap."""

    def task(batches):
        yield from run(batches)
        _trim()

    return task


def settled(df: DataFrame) -> DataFrame:
    """``df`` behind a generator of one row: a caller's filter on its columns stays above. Pushed below, a
    filter would evaluate costly expressions again, once for each reference to them."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
