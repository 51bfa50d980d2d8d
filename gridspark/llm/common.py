"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of input that a Python worker holds as Python objects at once (one longer row counts alone).
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into pieces of about max_bytes, so that a worker's memory doesn't depend on the text length."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, int(rows * max_bytes / max(batch.nbytes, 1)))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def trim() -> None:
    """Gives freed memory back to the system: Python workers live on between tasks, and what one group needed would stay theirs."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def map_slices(df: DataFrame, fn: Callable[[dict], dict], schema: str, state: Callable[[], object] | None = None) -> DataFrame:
    """mapInArrow over slices: fn gets the columns as lists (and the task's state, if any) and returns columns as lists."""
    names = df.columns

    def run(batches):
        own = state() if state else None
        for part in slices(batches):
            cols = {n: part.column(i).to_pylist() for i, n in enumerate(names)}
            out = fn(cols, own) if state else fn(cols)
            yield pa.RecordBatch.from_pydict(out, schema=out_schema)
        own = cols = out = None
        trim()

    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, and in it one of this application's own.

    Only local sessions that name none get a folder of the machine, until they end.
    """
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="gridspark-shared-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/gridspark-{sc.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage by a table in the shared folder: what is read back depends on no executor.

    A checkpoint() would keep the estimated sizes of the plan behind it, which multiply at each join of a loop until planning alone
    takes minutes; a table has the size of its files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing will read again."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
