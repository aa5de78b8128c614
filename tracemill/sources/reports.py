"""Metric files of many runs as one table, each row with where it came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def experiments(spark: SparkSession, paths: list[str], *, model: str | None = None, lowest_full_recall: float | None = None, common: str = "output") -> DataFrame:
    """Rows of JSON-lines files with precision and recall, beside the experiment that wrote them.

    An experiment is the name of a file's folder, or the file's own without its ending where the folder has the common name. A column that some files lack is null
    there; a row without precision or recall, or of another model, goes, and one without full_recall counts as 0. Bad lines raise.
    """
    rows = spark.read.option("mode", "FAILFAST").json(paths).withColumn("_file", F.col("_metadata.file_path"))
    part = lambda n: F.url_decode(F.regexp_extract("_file", r"([^/]+)/([^/]+)$", n))
    name = F.when(part(1) == common, F.regexp_replace(part(2), r"\.[^.]*$", "")).otherwise(part(1))
    for c in ("precision", "recall"):
        rows = rows.where(F.col(c).isNotNull()) if c in rows.columns else rows.where("false").withColumn(c, F.lit(None).cast("double"))
    if model is not None:
        rows = rows.where(F.col("model") == model) if "model" in rows.columns else rows.where("false")
    if lowest_full_recall is not None:
        rows = rows.where((F.coalesce("full_recall", F.lit(0)) if "full_recall" in rows.columns else F.lit(0)) >= lowest_full_recall)
    return rows.withColumn("experiment", name).drop("_file")
