"""SQL over the stage tables: (re)build the catalog, run a folder of scripts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import PySparkException


def register(spark: SparkSession, tables: Mapping[str, DataFrame], save: bool = False) -> None:
    """Make each frame a view (or a saved table), replacing one of the same name."""
    for name, df in tables.items():
        if save:
            df.write.mode("overwrite").saveAsTable(name)
        else:
            df.createOrReplaceTempView(name)


def star_tables(encounters: DataFrame, dims: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The fact table and its dimensions under the names SQL scripts use."""
    return {"encounters": encounters, **{f"lookup_{n}": d for n, d in dims.items()}}


@dataclass(frozen=True)
class StatementResult:
    file: str
    number: int
    sql: str
    df: DataFrame | None
    error: str | None


def statements(text: str) -> list[str]:
    """Statements of a script: full-line comments go first, so they may hold semicolons."""
    code = [line for line in text.splitlines() if not line.lstrip().startswith("--")]
    return [part.strip() for part in "\n".join(code).split(";") if part.strip()]


def read_scripts(spark: SparkSession, folder: str) -> dict[str, str]:
    """Name and text of the scripts of a folder, on any storage that Spark reads."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.sql")
    return {r[0]: r[1] for r in files.select("_metadata.file_name", "value").collect()}


def own_scripts() -> dict[str, str]:
    """The scripts that come with the package, read where the package is installed."""
    return {p.name: p.read_text() for p in (Path(__file__).parent.parent / "sql").glob("*.sql")}


def run_scripts(spark: SparkSession, scripts: Mapping[str, str], out: str | None = None
                ) -> Iterator[StatementResult]:
    """Run scripts in name order; a failing statement is reported, not fatal.

    With ``out`` each result is written as ``<out>/<script>_<n>`` and read back, so that
    errors of execution are recorded too and not only those of analysis.
    """
    for name, text in sorted(scripts.items()):
        for number, sql in enumerate(statements(text), start=1):
            try:
                df = spark.sql(sql)
                if out is not None:
                    path = f"{out.rstrip('/')}/{name.removesuffix('.sql')}_{number}"
                    df.write.mode("overwrite").parquet(path)
                    df = spark.read.schema(df.schema).parquet(path)
                yield StatementResult(name, number, sql, df, None)
            except PySparkException as err:
                yield StatementResult(name, number, sql, None, str(err))


def run_sql_dir(spark: SparkSession, folder: str, out: str | None = None
                ) -> Iterator[StatementResult]:
    """``run_scripts`` over the scripts of a folder."""
    yield from run_scripts(spark, read_scripts(spark, folder), out)
