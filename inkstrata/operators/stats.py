"""Robust statistics and gates over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def median_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """median, mad and sigma (1.4826 mad) by group. The medians are joined back; a group's rows meet twice, but only in counts by distinct value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    middle = counts.groupBy(*keys).agg(F.percentile(value, 0.5, F.col("n")).alias("median"))
    spread = counts.join(middle, keys).groupBy(*keys, "median").agg(F.percentile(F.abs(F.col(value) - F.col("median")), 0.5, F.col("n")).alias("mad"))
    return spread.withColumn("sigma", 1.4826 * F.col("mad"))


def with_defaults(groups: DataFrame, df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, median, p95 and max by group; 0 for groups without a value."""
    made = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.percentile(value, 0.95).alias("p95"), F.max(value).alias("max"))
    names = ("mean", "median", "p95", "max")
    return groups.join(made, keys, "left").select(*keys, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def winsorized_mean(df: DataFrame, keys: list[str], value: str, proportion: float = 0.10) -> DataFrame:
    """The mean after values outside the two quantiles are moved to them; the plain mean of under four values."""
    cuts = df.groupBy(*keys).agg(F.percentile(value, proportion).alias("lo"), F.percentile(value, 1 - proportion).alias("hi"), F.count(value).alias("n"))
    v = F.when(F.col("n") < 4, F.col(value)).otherwise(F.least(F.greatest(F.col(value), F.col("lo")), F.col("hi")))
    return df.join(cuts, keys).groupBy(*keys).agg(F.avg(v).alias("winsorized_mean"))


def tail_mean(df: DataFrame, keys: list[str], value: str, quantile: float = 0.95) -> DataFrame:
    """The mean of the values from a quantile on."""
    cut = df.groupBy(*keys).agg(F.percentile(value, quantile).alias("cut"))
    return df.join(cut, keys).where(F.col(value) >= F.col("cut")).groupBy(*keys).agg(F.avg(value).alias("tail_mean"), F.count(F.lit(1)).alias("tail_rows"))


def strongest_mean(df: DataFrame, keys: list[str], value: str, order: list[str], share: float = 0.10) -> DataFrame:
    """The mean of the largest ceil(share n) values."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("rank", F.row_number().over(w.orderBy(F.desc(value), *order))).withColumn("n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("rank") <= F.ceil(F.col("n") * share)).groupBy(*keys).agg(F.avg(value).alias("strongest_mean"))


def metric_quantiles(df: DataFrame, metrics: list[str], keys: list[str] | None = None, digits: int = 6, accuracy: int | None = None) -> DataFrame:
    """min, p10, median, p90, max over the finite values of each metric, and how many are finite and not. One pass over unpivoted rows.

    Exact quantiles interpolate, and hold the distinct values of a group in one task: right for crops of an image. With ``accuracy`` they are sketches of bounded size instead.
    """
    keys = keys or []
    long = df.unpivot(keys, metrics, "metric", "value")
    v = F.col("value")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    fine = F.when(ok, v)
    stat = lambda c, n: F.round(c, digits).alias(n)
    q = F.percentile(fine, [0.1, 0.5, 0.9]) if accuracy is None else F.percentile_approx(fine, [0.1, 0.5, 0.9], accuracy)
    made = long.groupBy(*keys, "metric").agg(F.min(fine).alias("lo"), q.alias("q"), F.max(fine).alias("hi"), F.count(fine).alias("finite_count"), (F.count(F.lit(1)) - F.count(fine)).alias("nonfinite_count"))
    return made.select(*keys, "metric", stat(F.col("lo"), "min"), *[stat(F.col("q")[i], n) for i, n in enumerate(("p10", "median", "p90"))], stat(F.col("hi"), "max"), "finite_count", "nonfinite_count")


def pass_fractions(df: DataFrame, keys: list[str], gates: dict[str, Column]) -> DataFrame:
    """The share of rows that pass each gate, and all of them (joint)."""
    whole = None
    for g in gates.values():
        whole = g if whole is None else whole & g
    rate = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 6)
    return df.groupBy(*keys).agg(*[rate(g).alias(n) for n, g in gates.items()], rate(whole).alias("joint"))


def reason_counts(df: DataFrame, reasons: str, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    return df.select(*keys, F.explode(reasons).alias("reason")).groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))


def dominant_bin(df: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    """The fullest bin of each group (the lowest of several), and the median of the values in it and its two neighbours."""
    binned = df.withColumn("bin", F.floor(F.col(value) / width))
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("bin")).alias("minus"))).alias("t")).select(*keys, (-F.col("t.minus")).alias("dominant"), F.col("t.n").alias("in_bin"))
    near = binned.join(top, keys).where(F.abs(F.col("bin") - F.col("dominant")) <= 1)
    return near.groupBy(*keys, "dominant", "in_bin").agg(F.median(value).alias("centre"))


def weighted_confidence(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Confidence weighted by pixels, and the one method or what the methods have in common."""
    m = F.col("method")
    return parts.groupBy(*keys).agg(
        (F.sum(F.col("confidence") * F.col("pixels")) / F.greatest(F.lit(1), F.sum("pixels"))).alias("confidence"),
        F.when(F.count_distinct("method") == 1, F.min("method"))
        .when(F.bool_and(m.startswith("validated_surface_")), "componentwise_validated_surface")
        .when(F.bool_and(m.startswith("poster_surface_")), "componentwise_poster_surface")
        .otherwise("componentwise_mixed")
        .alias("method"),
    )


def image_error(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """mae, p95 and max of the absolute difference, mse and psnr (infinite for equal images)."""
    d = F.col(a).cast("double") - F.col(b).cast("double")
    mse = F.avg(d * d)
    return pairs.groupBy(*keys).agg(
        F.avg(F.abs(d)).alias("mae"), F.percentile(F.abs(d), 0.95).alias("p95"), F.max(F.abs(d)).alias("max_error"), mse.alias("mse"),
        F.when(mse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(65025.0) / mse)).alias("psnr"),
    )


def over_budget(records: DataFrame, done: DataFrame, layer: str, most: int) -> DataFrame:
    """How many removals each layer has with those already made, and whether that is over its cap."""
    new = records.groupBy(layer).agg(F.count(F.lit(1)).alias("new"))
    both = new.join(done, layer, "full").select(layer, (F.coalesce("new", F.lit(0)) + F.coalesce("removed", F.lit(0))).alias("total"))
    return both.withColumn("over", F.col("total") > most)


def duplicate_stems(files: DataFrame, parent: str, stem: str) -> DataFrame:
    """How many entries share an entry's folder and stem, whatever the case. Counted by key and joined back, so a full folder is no hot window."""
    keyed = files.withColumn("_p", F.lower(parent)).withColumn("_s", F.lower(stem))
    n = keyed.groupBy("_p", "_s").agg(F.count(F.lit(1)).alias("same_stem"))
    return keyed.join(n, ["_p", "_s"]).drop("_p", "_s")
