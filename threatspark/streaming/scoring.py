"""Scoring stream (R3): the prediction endpoint re-aimed as a streaming job.

Request rows (JSON files landing in a folder) are prepared with the state
saved at training (T8), scored by a fitted MLlib pipeline and appended to a
score sink; unreadable rows go to an error sink instead of failing the
batch. ``foreachBatch`` writes both outputs of one micro-batch with the
batch id recorded, so a replayed batch after a failure is idempotent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.models import score
from ..plans.flow import FlowState, score_prepare


def request_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S9 as a stream; malformed rows keep their text in ``_corrupt_record``."""
    if "_corrupt_record" not in schema.fieldNames():
        schema = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    return (spark.readStream.schema(schema).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def score_requests(requests: DataFrame, state: FlowState, model: PipelineModel,
                   keep: Sequence[str] = ("row_id",), threshold: float = 0.5) -> DataFrame:
    """T8 -> model -> decision. Works on batch and streaming frames alike."""
    ok = requests
    if "_corrupt_record" in requests.columns:
        ok = requests.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    prepared = score_prepare(ok, state, keep=keep)
    return score(model, prepared, threshold)


def run_scoring_stream(spark: SparkSession, src: str, out: str, checkpoint: str,
                       schema: T.StructType, state: FlowState, model: PipelineModel,
                       keep: Sequence[str] = ("row_id",), trigger: dict | None = None
                       ) -> StreamingQuery:
    """Request files -> scores (and errors) under ``out``."""
    req = request_stream(spark, src, schema)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # parsed once for both outputs (Spark also refuses queries that read
        # only the corrupt-record column straight from the raw files)
        batch = batch.persist()
        # scored once too: a filter on a score would be pushed down to the rows and evaluate it again
        good = score_requests(batch, state, model, keep).select(*keep, "p", "decision").persist()
        try:
            # a row that cannot be scored (null or NaN probability) has no decision
            scored = F.col("p").isNotNull() & ~F.isnan("p")
            good.where(scored).withColumn("batch_id", F.lit(batch_id)) \
                .write.mode("overwrite").parquet(f"{out}/scores/batch_id={batch_id}")
            bad = batch.where(F.col("_corrupt_record").isNotNull()).select(
                *[F.lit(None).cast(batch.schema[k].dataType).alias(k) for k in keep], "_corrupt_record")
            unscored = good.where(~scored).select(
                *keep, F.lit(None).cast("string").alias("_corrupt_record"))
            bad.unionByName(unscored).write.mode("overwrite").parquet(f"{out}/errors/batch_id={batch_id}")
        finally:
            good.unpersist()
            batch.unpersist()

    w = req.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()
