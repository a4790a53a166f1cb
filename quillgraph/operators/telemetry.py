"""Cost and usage of model calls, as rows: executors share no context, so usage is data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: US dollars per million tokens, input and output.
PRICES = {"small": (0.15, 0.60), "medium": (0.50, 1.50), "large": (2.50, 10.00), "embed": (0.02, 0.0)}


def priced(usage: DataFrame, prices: dict[str, tuple[float, float]] = PRICES) -> DataFrame:
    """``usage`` (model, input_tokens, output_tokens) with cost and whether the model has a price; without one the cost is 0."""
    table = usage.sparkSession.createDataFrame([(m, float(i), float(o)) for m, (i, o) in prices.items()], "model string, per_in double, per_out double")
    joined = usage.join(F.broadcast(table), "model", "left")  # as many rows as there are priced models
    cost = (F.col("input_tokens") * F.col("per_in") + F.col("output_tokens") * F.col("per_out")) / 1e6
    return joined.withColumn("cost_usd", F.coalesce(cost, F.lit(0.0))).withColumn("priced", F.col("per_in").isNotNull()).drop("per_in", "per_out")


def by_stage(usage: DataFrame) -> DataFrame:
    """(stage, calls, input_tokens, output_tokens, total_tokens, cost_usd, latency_ms), the costliest first."""
    return usage.groupBy("stage").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), F.sum("cost_usd").alias("cost_usd"), F.sum("latency_ms").alias("latency_ms")).orderBy(F.desc("cost_usd"), "stage")


def totals(usage: DataFrame, warn_at: float | None = None) -> DataFrame:
    """One row: calls, tokens, cost, and the distinct warnings in order."""
    warn = F.when(~F.col("priced"), F.concat(F.lit("no price for "), F.col("model")))
    got = usage.agg(F.count("*").alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), F.sum("cost_usd").alias("cost_usd"), F.array_sort(F.collect_set(warn)).alias("warnings"))
    if warn_at is None:
        return got
    return got.withColumn("warnings", F.when(F.col("cost_usd") > warn_at, F.concat("warnings", F.array(F.lit(f"cost is over {warn_at}")))).otherwise(F.col("warnings")))
