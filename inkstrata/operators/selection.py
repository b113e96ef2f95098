"""Choosing among candidate restorations by crops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ladder(crops: DataFrame, *, least: float = 0.75, material: float = 0.02) -> DataFrame:
    """Every candidate with its rank, its share of crops that pass all gates, and whether it is selected.

    Candidate 0 is the control. If it passes (``least`` of its crops), the best passing other one is taken only if it gains the larger of ``material`` and two crops and retains no less; if
    it doesn't pass, the best passing other one; else none. crops: candidate, retention, edge, energy, ssim.
    """
    rate = lambda c: F.avg(F.col(c).cast("int"))
    f = crops.groupBy("candidate").agg(F.avg((F.col("retention") & F.col("edge") & F.col("energy")).cast("int")).alias("gate"), rate("retention").alias("retained"), rate("edge").alias("edged"), rate("energy").alias("energetic"), F.percentile("ssim", 0.1).alias("ssim"), F.count(F.lit(1)).alias("n"))
    f = f.withColumn("passed", F.col("gate") >= least)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("passed"), F.desc("gate"), F.desc("retained"), F.desc("edged"), F.desc("energetic"), F.desc("ssim"), "candidate")
    r = f.withColumn("rank", F.row_number().over(w))  # as many rows as candidates
    every = Window.partitionBy(F.lit(0))
    pick = lambda cond, what: F.max(F.when(cond, what)).over(every)
    control = F.col("candidate") == 0
    r = r.withColumn("_cg", pick(control, F.col("gate"))).withColumn("_cr", pick(control, F.col("retained"))).withColumn("_cn", pick(control, F.col("n"))).withColumn("_cp", F.coalesce(pick(control, F.col("passed").cast("int")), F.lit(0)) == 1)
    r = r.withColumn("_dr", F.min(F.when(~control & F.col("passed"), F.col("rank"))).over(every))
    gain = F.max(F.when(F.col("rank") == F.col("_dr"), F.col("gate") - F.col("_cg") >= F.greatest(F.lit(material), 2.0 / F.col("_cn"))).cast("int")).over(every) == 1
    kept = F.max(F.when(F.col("rank") == F.col("_dr"), F.col("retained") >= F.col("_cr")).cast("int")).over(every) == 1
    deep = F.coalesce(F.col("rank") == F.col("_dr"), F.lit(False))
    chosen = F.when(F.col("_cp"), F.when(F.coalesce(gain & kept, F.lit(False)), deep).otherwise(control)).otherwise(deep)
    return r.withColumn("selected", chosen).drop("_cg", "_cr", "_cn", "_cp", "_dr")


def after_render(claimed: DataFrame) -> DataFrame:
    """The last word on a candidate: a simulated pass counts only if the written file passes as well. claimed: decision, simulated, verified (null where nothing was written)."""
    return (
        claimed.withColumn("accepted", F.coalesce(F.col("simulated") & F.col("verified"), F.lit(False)))
        .withColumn("reason", F.when(~F.col("simulated"), "no_simulated_restoration_passed").when(F.col("verified").isNull(), "error_not_verified").when(F.col("verified"), "actual_render_gate_passed").otherwise("actual_render_verification_failed"))
        .withColumn("decision", F.when(F.col("accepted"), F.col("decision")).when(F.col("simulated"), "fallback_after_render_verification").otherwise("fallback"))
    )
