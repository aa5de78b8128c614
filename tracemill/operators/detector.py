"""Detector calibration: head scores, nested top-k, configuration, threshold and frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import vectors


def head_scores(mass: DataFrame, gold: DataFrame, method: str = "shape") -> DataFrame:
    """Mean score of each (layer, head): mass has sample_id, layer, head, mass; gold has sample_id, mask."""
    score = vectors.shape_score if method == "shape" else vectors.contrast_score
    joined = mass.join(gold, "sample_id")
    return joined.groupBy("layer", "head").agg(F.avg(score(F.col("mass"), F.col("mask"))).alias("score"))


def top_heads(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "layer", "head").limit(k)


def nested_top(scores: DataFrame, ks: list[int]) -> DataFrame:
    """(top_k, layer, head, score) for every k at once; ranks only the largest k."""
    ranked = top_heads(scores, max(ks)).withColumn("rn", F.row_number().over(Window.orderBy(F.desc("score"), "layer", "head")))
    grid = scores.sparkSession.createDataFrame([(k,) for k in sorted(set(ks))], "top_k int")
    return ranked.join(F.broadcast(grid), F.col("rn") <= F.col("top_k")).select("top_k", "layer", "head", "score")


def combined(mass: DataFrame, heads: DataFrame, weighted: bool = True) -> DataFrame:
    """(top_k, sample_id, pos, score): weighted mean of the chosen heads' mass; the plain mean if all weights are 0."""
    rows = mass.join(F.broadcast(heads), ["layer", "head"]).select("top_k", "sample_id", "score", F.posexplode("mass").alias("pos", "x"))
    w = F.greatest(F.coalesce("score", F.lit(1.0)), F.lit(0.0)) if weighted else F.lit(1.0)
    out = rows.groupBy("top_k", "sample_id", "pos").agg(F.sum(w * F.col("x")).alias("wx"), F.sum(w).alias("w"), F.avg("x").alias("plain"))
    return out.select("top_k", "sample_id", "pos", F.when(F.col("w") > 0, F.col("wx") / F.col("w")).otherwise(F.col("plain")).alias("score"))


def best_config(experiments: DataFrame) -> DataFrame:
    """Largest (mean, median, -window, -k)."""
    return experiments.orderBy(F.desc("mean_score"), F.desc("median_score"), "window_size", "top_k").limit(1)


def best_threshold(metrics: DataFrame, least_recall: float) -> DataFrame:
    """Largest harmonic score among rows of enough recall; if none, by recall first."""
    m = metrics.withColumn("harmonic", vectors.harmonic(F.col("precision"), F.col("recall"))).withColumn("feasible", F.col("recall") >= least_recall)
    first: Column = F.when(F.col("feasible"), F.lit(2.0)).otherwise(F.col("recall"))
    return m.orderBy(F.desc("feasible"), F.desc(first), F.desc("harmonic"), F.desc("precision"), F.desc("threshold")).limit(1)


def pareto(points: DataFrame, group: list[str], recall: str = "recall", precision: str = "precision") -> DataFrame:
    """Rows that raise the best precision as recall falls."""
    w = Window.partitionBy(*group).orderBy(F.desc(recall), F.desc(precision)).rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("_best", F.coalesce(F.max(precision).over(w), F.lit(-1.0))).where(F.col(precision) > F.col("_best")).drop("_best")
