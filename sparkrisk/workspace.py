"""Tables handed from one stage to the next.

A stage result that several later jobs read is written once as Parquet to the shared
folder of the session (``spark.checkpoint.dir``) and read back with its declared
schema. That cuts the lineage, survives the loss of any executor, and gives every
later job column pruning and filter pushdown. Nothing is kept in executor memory only.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_RUNS: dict[str, str] = {}
_STAGED: dict[tuple[str, str], tuple[str, object]] = {}


def _application(spark: SparkSession) -> str:
    return spark.sparkContext.applicationId


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach.

    ``spark.checkpoint.dir`` if the session has it, else ``sparkrisk.workspace.dir``. With
    neither, a session whose executor is the driver's own process gets a temporary folder;
    on a cluster that is an error. No setting of the session is ever changed.
    """
    for key in ("spark.checkpoint.dir", "sparkrisk.workspace.dir"):
        if configured := spark.conf.get(key, None):
            return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir or sparkrisk.workspace.dir to a folder "
                         "shared by the driver and all executors")
    return tempfile.mkdtemp(prefix="sparkrisk-")


def run_dir(spark: SparkSession) -> str:
    """Folder of this application's hand-off tables."""
    app = _application(spark)
    if app not in _RUNS:
        _RUNS[app] = f"{shared_dir(spark).rstrip('/')}/sparkrisk/{app}-{uuid.uuid4().hex[:8]}"
    return _RUNS[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own in the shared folder: lineage ends there."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table called ``name``, built and written the first time it is asked for."""
    key = (_application(spark), name)
    if key not in _STAGED:
        path = f"{run_dir(spark)}/{name}"
        df = build()
        df.write.mode("overwrite").parquet(path)
        _STAGED[key] = (path, df.schema)
    path, schema = _STAGED[key]
    return spark.read.schema(schema).parquet(path)


def fresh(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    """Write ``df`` under a name of its own and read it back."""
    return written(df, name)
