"""Results applied to items once each, by a job that can be stopped at any time and started again.

A stream of items goes through a judge in micro-batches. What a batch gives is written to a folder named after the batch, over whatever a
run that was stopped has left there, and then the batch is entered in a commit log, one file a batch. A batch that is run again after a
restart finds its entry and does nothing, or has none and writes its folder anew; so an item's result is there once, and a
reader sees whole batches only. Items that an earlier batch has, or that repeat within one, aren't judged again.

Defined results: a judgement with an error, or without a score, counts as failed: no score, not passed, and the error as reason. Items
without an id are left out; an empty stream gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: The share from which a score passes.
PASSES = 0.5
RESULT = "item_id string, score double, passed boolean, reason string, judge_failed boolean"


def _entry(spark: SparkSession, path: str, batch: int | None = None):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits" + ("" if batch is None else f"/{batch}"))
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def committed(spark: SparkSession, path: str) -> list[int]:
    """The batches in the commit log."""
    at, files = _entry(spark, path)
    return sorted(int(f.getPath().getName()) for f in files.listStatus(at)) if files.exists(at) else []


def results(spark: SparkSession, path: str) -> DataFrame:
    """The results of all committed batches."""
    batches = committed(spark, path)
    if not batches:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(*[f"{path}/batch-{b}" for b in batches])


def judged(rows: DataFrame, passes: float = PASSES) -> DataFrame:
    """Results of a judge's rows (item_id, score, error)."""
    failed = F.col("error").isNotNull() | F.col("score").isNull()
    score = F.when(~failed, F.col("score"))
    reason = F.when(failed, F.concat(F.lit("judge_error: "), F.coalesce("error", F.lit("no score")))).otherwise("")
    return rows.select("item_id", score.cast("double").alias("score"), F.coalesce(score >= passes, F.lit(False)).alias("passed"), reason.alias("reason"), failed.alias("judge_failed"))


def started(items: DataFrame, judge: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, between: Callable[[int], None] | None = None) -> StreamingQuery:
    """A run over the items (item_id and what the judge needs) that there are now.

    judge: rows of items to rows (item_id, score, error). between: called with the batch after its rows are written and before it is entered.
    """

    def apply(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        if batch in committed(spark, path):
            return
        new = rows.filter("item_id IS NOT NULL").dropDuplicates(["item_id"]).join(results(spark, path).select("item_id"), "item_id", "left_anti")
        judged(judge(new)).write.mode("overwrite").parquet(f"{path}/batch-{batch}")
        if between:
            between(batch)
        at, files = _entry(spark, path, batch)
        files.create(at, True).close()

    return items.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
