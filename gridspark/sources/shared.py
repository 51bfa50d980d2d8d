"""Tables in the folder that driver and executors share: cuts of lineage that depend on no executor, and asking what is there.

Only public Spark calls are used, so that any file system that Spark reads will do.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names, and in it one of this application's own.

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
    """The rows, written once and read back; what is read depends on no executor and has the size of its files."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def emptied(*tables: DataFrame) -> None:
    """Frees what `written` tables hold, once nothing reads them any more: an empty table takes their place."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(path)


def there(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame | None:
    """The table at a path of any file system, None where there is nothing."""
    try:
        return spark.read.format(kind).load(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
