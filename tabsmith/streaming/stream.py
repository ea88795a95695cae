"""Structured Streaming jobs (ST1-ST3), re-aiming the reference's chunk-and-sleep reader.

* ST1 ``file_stream``: a file source with a bounded batch size
  (``maxFilesPerTrigger``); the schema is given, never inferred per batch.
* ST2 ``score_stream``: a saved feature pipeline + model applied to every
  micro-batch (stateless, so ``transform`` on the stream itself).
* ST3 ``running_metrics``: stateful sums per run (count, correct, tp, fp,
  fn, squared and absolute error) in complete mode; metrics are derived from
  the state, so the final state equals the batch result.
Checkpoints go under the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.score import score_batch
from ..session import scratch_path


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                files_per_trigger: int = 1) -> DataFrame:
    """ST1: micro-batches of at most ``files_per_trigger`` files."""
    return (spark.readStream.format(fmt).schema(schema)
            .option("maxFilesPerTrigger", files_per_trigger).load(path))


def score_stream(stream: DataFrame, features_model, model, keep: list[str],
                 labels: list[str] | None = None) -> DataFrame:
    """ST2: I1 on each micro-batch: label and confidence from a saved pipeline."""
    return score_batch(stream, features_model, model, labels=labels, keep=keep)


def running_metrics(stream: DataFrame, y: str, p: str, run_col: str | None = None,
                    positive=1) -> DataFrame:
    """ST3: running accuracy / binary precision, recall, F1 / RMSE / MAE per run."""
    yy, pp = F.col(y), F.col(p)
    keys = [F.col(run_col)] if run_col else [F.lit("all").alias("run")]
    state = stream.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((yy == pp).cast("long")).alias("correct"),
        F.sum(((yy == positive) & (pp == positive)).cast("long")).alias("tp"),
        F.sum(((yy != positive) & (pp == positive)).cast("long")).alias("fp"),
        F.sum(((yy == positive) & (pp != positive)).cast("long")).alias("fn"),
        F.sum((yy.cast("double") - pp.cast("double")) ** 2).alias("sse"),
        F.sum(F.abs(yy.cast("double") - pp.cast("double"))).alias("sae"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return state.select(
        *[c for c in state.columns if c not in ("n", "correct", "tp", "fp", "fn", "sse", "sae")],
        "n",
        F.try_divide(F.col("correct"), F.col("n")).alias("accuracy"),
        F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1_score"),
        F.sqrt(F.try_divide(F.col("sse"), F.col("n"))).alias("rmse"),
        F.try_divide(F.col("sae"), F.col("n")).alias("mae"),
    )


def run_to_table(stream: DataFrame, out_path: str, mode: str = "append",
                 checkpoint: str | None = None, available_now: bool = True) -> str:
    """Drive a stream to completion into parquet via ``foreachBatch`` (exactly-once per epoch:
    each batch overwrites its own epoch folder)."""
    spark = stream.sparkSession
    ckpt = checkpoint or scratch_path(spark, "stream-ckpt")

    def sink(batch: DataFrame, epoch: int):
        if mode == "complete":
            batch.write.mode("overwrite").parquet(out_path)
        else:
            batch.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")

    w = stream.writeStream.outputMode(mode).option("checkpointLocation", ckpt).foreachBatch(sink)
    w = w.trigger(availableNow=True) if available_now else w
    q = w.start()
    q.awaitTermination()
    return out_path
