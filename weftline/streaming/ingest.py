"""Seeds that arrive as files: each micro-batch goes through the same plan as a batch run."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.config import Config
from weftline.plans.planner import GROUP, ROW, Planner, Resources


def stream_seeds(spark: SparkSession, config: Config, source: str, schema: Any, target: str, checkpoint: str, resources: Resources | None = None, kind: str = "parquet") -> Any:
    """Starts a query that gives every seed row its columns and appends them. A batch that is run again replaces its own output.

    Row ids are the batch's number in the upper bits and the place within it below, so draws are the same when a
    batch is repeated from the same rows.
    """
    planner = Planner(spark, config, resources)

    def step(batch: DataFrame, number: int) -> None:
        ids = batch.withColumns({ROW: F.lit(number << 40) + F.monotonically_increasing_id(), GROUP: F.lit(number).cast("long")})
        made = planner.marked(ids)
        keep = [c for c in made.columns if not c.startswith("_skip_") and c not in ("_drop_reason", GROUP)]
        made.where(F.col("_drop_reason").isNull()).select(keep).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return spark.readStream.format(kind).schema(schema).load(source).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
