"""Scoring of new encounters as they arrive, with a worklist per batch.

Cleaning is stateless once the top-K lists are fixed, so a stream runs through the same
expressions and the same fitted pipeline as the batch table. Tiles of new rows come from
the cut rows of the test set, which makes them comparable from batch to batch.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkrisk.functions import as_column, cut
from sparkrisk.operators.rank import Cut, ranked_top_k, tile_of
from sparkrisk.operators.serve import BAND, DECILE, RISK, score_fact
from sparkrisk.plans.cleaning import clean
from sparkrisk.spec import ENCOUNTERS, RISK_BANDS, EncounterSpec


def score_new(raw: DataFrame, model: PipelineModel, top: dict[str, list], cuts: list[Cut],
              spec: EncounterSpec = ENCOUNTERS) -> DataFrame:
    """Clean, score and tile new raw rows; works on streams and on tables alike."""
    scored = score_fact(clean(raw, spec, frozen_top=top), model, spec)
    return scored.withColumn(DECILE, tile_of(RISK, spec.id, cuts)).withColumn(
        BAND, cut(DECILE, RISK_BANDS))


def start_scoring(stream: DataFrame, model: PipelineModel, top: dict[str, list],
                  cuts: list[Cut], out: str, checkpoint: str, k: int = 200,
                  spec: EncounterSpec = ENCOUNTERS) -> StreamingQuery:
    """Write ``<out>/scored`` and ``<out>/worklist``, one folder per batch.

    A batch replaces its own folder, so a batch repeated after a failure is not counted
    twice.
    """
    scored = score_new(stream, model, top, cuts, spec)

    def write_batch(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/scored/batch={number}")
        written = batch.sparkSession.read.schema(batch.schema).parquet(
            f"{out}/scored/batch={number}")
        ranked_top_k(written, [F.desc(RISK), as_column(spec.id).asc()], k).write.mode(
            "overwrite").parquet(f"{out}/worklist/batch={number}")

    return (scored.writeStream.foreachBatch(write_batch)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
