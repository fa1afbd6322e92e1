"""Everything a dashboard reads, written in one go."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from sparkrisk.operators import serve
from sparkrisk.plans.pipeline import ModelRun
from sparkrisk.sources.sinks import export_dims, export_fact, write_csv, write_summary


def export_dashboard(run: ModelRun, dims: Mapping[str, DataFrame], out: str, k: int = 200,
                     csv: bool = False) -> None:
    """Scored fact (Parquet by split, CSV on request), dimensions, model tables, worklist."""
    out = out.rstrip("/")
    export_fact(run.fact, f"{out}/fact_encounters", csv=csv)
    export_dims(dims, out)
    write_csv(run.comparison, f"{out}/model_comparison", single_file=True)
    write_csv(serve.model_performance_table(run.comparison, run.summary),
              f"{out}/model_performance", single_file=True)
    write_csv(serve.fairness_table(run.summary), f"{out}/fairness_check", single_file=True)
    write_csv(serve.worklist(run.fact, k), f"{out}/high_risk_worklist", single_file=True)
    write_summary(run.summary, f"{out}/model_summary")
