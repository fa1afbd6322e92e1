"""Tables out: CSV, Parquet, JSON summary, saved models, star-schema export."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

#: names the version of an export that readers see; the newest entry counts
POINTER = "_versions"


def swapped_in(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Write a new version of an export beside the old ones, then point readers to it.

    ``write`` gets the folder of the new version. The pointer is one small file that is added
    after everything else is there, so a reader sees the old version until the new one is
    complete, and goes on seeing it if the export fails. Old versions stay until they are
    removed by whoever owns the folder. One writer at a time.
    """
    base = path.rstrip("/")
    version = f"v-{uuid.uuid4().hex}"
    write(f"{base}/{version}")
    place = 1 + max((p for p, _ in versions(spark, base)), default=0)
    spark.createDataFrame([(place, version)], "place long, version string").coalesce(1).write.mode(
        "append").json(f"{base}/{POINTER}")
    return f"{base}/{version}"


def versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(place, folder name) of the complete versions of an export, oldest first."""
    base = path.rstrip("/")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{POINTER}")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return []
    rows = spark.read.schema("place long, version string").json(f"{base}/{POINTER}")
    return sorted((r["place"], r["version"]) for r in rows.collect())


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header, replacing what is there.

    ``single_file`` is for small results only (a worklist, a metric table).
    """
    out = df.coalesce(1) if single_file else df
    # the empty text and null stay apart: null is written as nothing, "" with quotes
    out.write.mode("overwrite").options(
        header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Nested one-row summary as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def export_fact(df: DataFrame, path: str, csv: bool = False) -> None:
    """Scored fact table, partitioned by split so rankings read test rows only."""
    df.write.mode("overwrite").partitionBy("data_split").parquet(path)
    if csv:
        write_csv(df, f"{path.rstrip('/')}_csv")


def publish_fact(df: DataFrame, path: str, csv: bool = False) -> str:
    """The same as a new version beside the old ones (``swapped_in``), for readers at work.

    ``read_export`` reads the newest complete version.
    """
    def write(folder: str) -> None:
        df.write.partitionBy("data_split").parquet(f"{folder}/parquet")
        if csv:
            write_csv(df, f"{folder}/csv")

    return swapped_in(df.sparkSession, path, write)


def export_dims(dims: Mapping[str, DataFrame], out: str) -> None:
    """Dimension tables unchanged, as ``dim_<name>``."""
    for name, df in dims.items():
        write_csv(df, f"{out.rstrip('/')}/dim_{name}", single_file=True)
