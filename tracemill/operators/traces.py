"""Rows of traces: what is kept, where a repair goes back to, and figures of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import vectors
from tracemill.operators import jobs

# ---- filters


def with_spans(rows: DataFrame, spans: str, keep_missing: bool = False) -> DataFrame:
    """Rows whose array of spans has one; those with a null array stay only if asked."""
    return rows.where(F.coalesce(F.size(F.col(spans)) > 0, F.lit(False)) | (F.col(spans).isNull() & F.lit(keep_missing)))


def fit_for_training(rows: DataFrame, tokens: Column, most: int, *parts: Column) -> DataFrame:
    """Rows of at most so many tokens in which every part (context, response) holds; null counts as not."""
    ok = tokens <= most
    for part in parts:
        ok = ok & part
    return rows.where(F.coalesce(ok, F.lit(False)))


def leaks(score: Column, threshold: float | Column, strict: bool = False) -> Column:
    """True from the threshold on, or with strict (as for divergences) above it; null scores give null."""
    return score > threshold if strict else score >= threshold


def measured(rows: DataFrame, *, model: str | None = None, lowest_full_recall: float | None = None, model_col: str = "model", precision: str = "precision", recall: str = "recall", full_recall: str = "full_recall") -> DataFrame:
    """Rows with precision and recall, of one model and of enough full recall where asked; a null full recall counts as 0."""
    out = rows.where(F.col(precision).isNotNull() & F.col(recall).isNotNull())
    out = out if model is None else out.where(F.col(model_col) == model)
    return out if lowest_full_recall is None else out.where(F.coalesce(full_recall, F.lit(0)) >= lowest_full_recall)


# ---- positions


def backtrack_start(position: Column, window: Column | int) -> Column:
    """Where a repair begins that was detected at a position: half a window back, not before 0."""
    width = F.lit(window) if isinstance(window, int) else window
    return F.greatest(F.lit(0), position - F.floor((width.cast("int") - 1) / 2).cast("int"))


def first_safe(rows: DataFrame, key: str, pos: str, safe: Column, window: int, name: str = "first_safe") -> DataFrame:
    """rows with the first safe position among the window rows up to each, by key; null where none is."""
    frame = Window.partitionBy(key).orderBy(pos).rowsBetween(1 - window, 0)
    return rows.withColumn(name, F.min(F.when(safe, F.col(pos))).over(frame))


# ---- sets and orders


def distinctness(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, different, all_different) of the values of each group; nulls count as no value, and a group with one has not all different."""
    n, different = F.count(F.lit(1)), F.count_distinct(value)
    return rows.groupBy(*keys).agg(n.alias("n"), different.alias("different"), (n == different).alias("all_different"))


def token_masks(rows: DataFrame, keys: list[str], predicted: Column, gold: Column) -> DataFrame:
    """(keys, predicted, both): is any span predicted, and is any gold besides; null flags count as false."""
    p, g = F.bool_or(F.coalesce(predicted, F.lit(False))), F.bool_or(F.coalesce(gold, F.lit(False)))
    return rows.groupBy(*keys).agg(p.alias("predicted"), (p & g).alias("both"))


def lowest(rows: DataFrame, score: str, tie: str, n: int) -> DataFrame:
    """The n rows of least score, ties by another column; null scores come last."""
    return rows.orderBy(F.col(score).asc_nulls_last(), tie).limit(n)


def first_valid(rows: DataFrame, valid: Column, order: list[str], most: int) -> DataFrame:
    """The first valid rows in an order."""
    return rows.where(valid).orderBy(*order).limit(most)


def seeded_examples(rows: DataFrame, key: str, start: int, end: int, valid: Column, most: int, seed: int = 42) -> DataFrame:
    """Rows start..end - 1 of a seeded order of all rows, of them the first valid ones."""
    placed = rows.withColumn("_order", jobs.seeded_order(F.col(key), seed))
    return first_valid(jobs.ordered_slice(placed, ["_order", key], start, end), valid, ["_order", key], most).drop("_order")


def for_each_model(seeds: DataFrame, models: DataFrame, most: int = 1000) -> DataFrame:
    """Every seed with every model. Models are a list in a configuration: more than most raise ValueError, the others go to all tasks."""
    n = models.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} models")
    return seeds.crossJoin(F.broadcast(models))


def batches(rows: DataFrame, order: list[str], size: int, name: str = "batch") -> DataFrame:
    """rows with the number (from 0) of their batch of so many rows in an order; the last batch may be smaller."""
    return jobs.with_rank(rows, order).withColumn(name, F.floor((F.col("rn") - 1) / size)).drop("rn")


def merged(old: Column, new: Column) -> Column:
    """Map of both, of equal keys the new one's value; a null map counts as empty."""
    kind = lambda m, other: F.coalesce(m, F.map_filter(other, lambda k, v: F.lit(False)))
    a, b = kind(old, new), kind(new, old)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


# ---- figures


def rates(runs: DataFrame, keys: list[Column], tokens: Column, seconds: Column) -> DataFrame:
    """(keys, tokens_per_second, samples_per_second) of the rows of each group; null where no time passed."""
    time = F.nullif(F.sum(seconds), F.lit(0))
    return runs.groupBy(*keys).agg((F.sum(tokens) / time).alias("tokens_per_second"), (F.count(F.lit(1)) / time).alias("samples_per_second"))


def shape_summary(rows: DataFrame, keys: list[str], score: str, leaking: Column) -> DataFrame:
    """Mean, lower median and least score of each group, counts and means of its leaking and other samples (null without one); null scores are left out."""
    rows = rows.where(F.col(score).isNotNull())
    median = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{score}`)")
    when = lambda c: F.when(c, F.col(score))
    leak = F.coalesce(leaking, F.lit(False))
    return rows.groupBy(*keys).agg(
        F.avg(score).alias("mean_score"), median.alias("median_score"), F.min(score).alias("min_score"), F.count(when(leak)).alias("leakage_samples"), F.count(when(~leak)).alias("non_leakage_samples"),
        F.avg(when(leak)).alias("mean_leakage"), F.avg(when(~leak)).alias("mean_non_leakage"), F.count(F.lit(1)).alias("samples"),
    )


def full_recall(scores: DataFrame, thresholds: DataFrame, *, key: str = "sample_id", pos: str = "pos", score: str = "score", gold: str = "gold") -> DataFrame:
    """(threshold, samples, full_hits, full_recall): the share of samples of which every gold span's first position is predicted, those without gold included."""
    begins = (F.col(gold) > 0) & (F.coalesce(F.lag(gold).over(Window.partitionBy(key).orderBy(pos)), F.lit(0)) == 0)
    least = scores.withColumn("_b", begins).groupBy(key).agg(F.min(F.when(F.col("_b"), F.col(score))).alias("_least"))
    # a sample is hit at every threshold up to the least score at which one of its spans begins
    met = least.join(thresholds, F.coalesce(F.col("_least") >= F.col("threshold"), F.lit(True)), "inner").groupBy("threshold").agg(F.count(F.lit(1)).alias("full_hits"))
    n = least.agg(F.count(F.lit(1)).alias("samples"))
    out = thresholds.join(met, "threshold", "left").join(n)
    hits = F.coalesce("full_hits", F.lit(0))
    return out.select("threshold", "samples", hits.alias("full_hits"), (hits / F.greatest("samples", F.lit(1))).alias("full_recall"))


def filtered_text(tokens: Column, blind: Column, told: Column) -> Column:
    """(text, removed_fraction): the tokens of a trace joined again without those that the told context raises most; null for empty or unequal arrays."""
    kept = vectors.without_top(blind, told)
    text = F.array_join(F.transform(kept["kept"], lambda i: F.get(tokens, i)), "")
    same = (F.size(blind) == F.size(told)) & (F.size(blind) > 0) & (F.size(tokens) == F.size(blind))
    return F.when(same, F.struct(text.alias("text"), kept["removed_fraction"].alias("removed_fraction")))


def answer_gains(base: Column, reasoned: Column, filtered: Column) -> Column:
    """(galg, lf_galg): mean log-likelihood of the answer after the whole and after the filtered trace, above that without one; each null where lengths differ or nothing was scored."""
    return F.struct(vectors.gain(base, reasoned).alias("galg"), vectors.gain(base, filtered).alias("lf_galg"))


def merge_notes(df: DataFrame, key: str, note: str = "note") -> DataFrame:
    """(key, start, end, notes): overlapping spans merged, with their notes in order; touching ones stay apart, and empty ones go. Null notes are left out."""
    order = Window.partitionBy(key).orderBy("start", "end", note)
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.where("end > start").withColumn("_new", F.coalesce((F.col("start") >= before).cast("int"), F.lit(1)))
    rows = rows.withColumn("_n", F.row_number().over(order)).withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(key, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.when(F.col(note).isNotNull(), F.struct("_n", note)))).alias("_notes"))
    return out.select(key, "start", "end", F.transform("_notes", lambda x: x[note]).alias("notes"))


def known_heads(mass: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows of mass of the chosen (layer, head); a head that mass has nowhere raises."""
    found = mass.select("layer", "head").distinct().withColumn("_there", F.lit(True))
    said = F.concat(F.lit("no head "), F.col("head").cast("string"), F.lit(" in layer "), F.col("layer").cast("string"))
    checked = heads.join(found, ["layer", "head"], "left").withColumn("layer", F.when(F.col("_there"), F.col("layer")).otherwise(F.raise_error(said).cast(heads.schema["layer"].dataType)))
    return mass.join(checked.drop("_there"), ["layer", "head"])
