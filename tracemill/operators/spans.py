"""Span algebra: tokens, occurrences, interval joins, islands, merges and span metrics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.vectors import bound
from tracemill.operators import literals


def tokens(df: DataFrame, key: str, text: str, pattern: str = r"\S+") -> DataFrame:
    """(key, pos, start, end, token) of each match; offsets count code points."""
    found = df.select(key, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    rows = found.select(key, F.posexplode(F.arrays_zip("m", F.slice("p", F.lit(1), F.size("m")).alias("p"))).alias("pos", "t"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("t.p") + F.length("t.m")).over(w)
    return rows.select(key, "pos", (end - F.length("t.m")).alias("start"), end.alias("end"), F.col("t.m").alias("token"))


def occurrences(docs: DataFrame, needles: DataFrame, *, key: str, text: str, needle_key: str, needle: str, first: bool = False) -> DataFrame:
    """(key, needle_key, start, end): every occurrence of a needle in a text, those of one needle without overlap from the left; or the first one alone.

    Offsets count code points. Null and empty needles and texts have none; needles of one text each have their own rows. Texts meet needles through an index of
    words (or of first characters, for needles without a whole word inside); only texts that may hold one move.
    """
    rows = docs.where(F.length(text) > 0).select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(key, text).alias("h"))
    found = needles.where(F.length(needle) > 0).select(F.col(needle).alias("needle"), F.col(needle_key).alias("name"), F.xxhash64(needle).alias("p"))
    met = literals.candidates(rows, found.select("p", "needle").distinct())
    both = met.join(found, "p").where(F.contains("text", F.col("needle")))
    start = (F.instr("text", F.col("needle")) - 1).cast("long") if first else F.explode(_places("text", "needle"))
    cut = both.select("key", "name", F.length("needle").cast("long").alias("n"), start.alias("start"))
    return cut.select(F.col("key").alias(key), F.col("name").alias(needle_key), "start", (F.col("start") + F.col("n")).alias("end"))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _places(texts: pd.Series, needles: pd.Series) -> pd.Series:
    """Where each text holds its needle: the next place begins behind the last one."""

    def of(text, needle):
        out, at = [], text.find(needle)
        while at >= 0:
            out.append(at)
            at = text.find(needle, at + len(needle))
        return out

    return pd.Series(map(of, texts, needles))


def overlapping(toks: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Distinct tokens that overlap a span of the same key: end > s and start < e.

    One sweep by key over tokens, at their ends, and spans, at their starts: a token overlaps one if the furthest end of the spans that began before its
    own end lies behind its start. So the work grows with tokens and spans, not with their product. Null bounds overlap nothing.
    """
    token = F.struct(*(F.col(f"`{c}`") for c in toks.columns))
    both = toks.select(F.col(key).alias("_k"), F.col("end").alias("_v"), F.lit(0).alias("_kind"), token.alias("_t"), F.lit(None).cast("long").alias("_e"))
    both = both.unionByName(spans.select(F.col(key).alias("_k"), F.col("start").alias("_v"), F.lit(1).alias("_kind"), F.lit(None).cast(toks.select(token.alias("t")).schema["t"].dataType).alias("_t"), F.col("end").cast("long").alias("_e")))
    upto = Window.partitionBy("_k").orderBy("_v", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.where("_v is not null").withColumn("_far", F.max("_e").over(upto))
    return swept.where("_kind = 0 and _far > _t.start").select("_t.*").distinct()


def first_token(toks: DataFrame, points: DataFrame, key: str, at: str, name: str = "token", ending: bool = True) -> DataFrame:
    """points with the first token of their key that ends behind the place at (or, not ending, that starts there or later); null where none does.

    One sweep by key from the last place back; tokens (pos, start, end) must not overlap. Points of a null key or place have no token.
    """
    point = F.struct(*(F.col(f"`{c}`") for c in points.columns))
    kind = points.select(point.alias("p")).schema["p"].dataType
    none = F.lit(None)
    both = toks.select(F.col(key).alias("_k"), F.col("end" if ending else "start").alias("_v"), F.lit(0).alias("_kind"), F.col("pos").alias("_pos"), none.cast(kind).alias("_p"))
    both = both.unionByName(points.select(F.col(key).alias("_k"), F.col(at).alias("_v"), F.lit(1 if ending else -1).alias("_kind"), none.cast(toks.schema["pos"].dataType).alias("_pos"), point.alias("_p")))
    back = Window.partitionBy("_k").orderBy(F.col("_v").desc_nulls_last(), F.col("_kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_first", F.when(F.col("_k").isNotNull() & F.col("_v").isNotNull(), F.min("_pos").over(back)))
    return found.where("_kind <> 0").select("_p.*", F.col("_first").alias(name))


def islands(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Runs of consecutive positions as half-open [start_token, end_token)."""
    w = Window.partitionBy(key).orderBy(pos)
    run = df.select(key, pos).distinct().withColumn("run", F.col(pos) - F.row_number().over(w))
    return run.groupBy(key, "run").agg(F.min(pos).alias("start_token"), (F.max(pos) + 1).alias("end_token")).drop("run")


def merge_spans(df: DataFrame, key: str, touching: bool = True) -> DataFrame:
    """Union of spans by key; touching ones merge if asked. Empty spans go."""
    w = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max("end").over(w)
    apart = F.col("start") > before if touching else F.col("start") >= before
    rows = df.where("end > start").withColumn("new", F.coalesce(apart.cast("int"), F.lit(1)))
    rows = rows.withColumn("g", F.sum("new").over(Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("g")


def rolling_max(value: Column, key: str, pos: str, width: int) -> Column:
    """Centred maximum, zero beyond the ends; even widths lean left."""
    if width <= 1:
        return value
    left, right = width // 2, width - 1 - width // 2
    w = Window.partitionBy(key).orderBy(pos)
    frame = w.rowsBetween(-left, right)
    full = F.count(F.lit(1)).over(frame) == width
    top = F.max(value).over(frame)
    return F.when(full, top).otherwise(F.greatest(top, F.lit(0.0)))


def span_metrics(scores: DataFrame, thresholds: DataFrame, *, key: str = "sample_id", pos: str = "pos", score: str = "score", gold: str = "gold") -> DataFrame:
    """Pooled span metrics at each threshold: a score at or above it is predicted.

    A gold span is detected if its first position is predicted; a predicted span is correct if it holds a
    gold span's first position.
    """
    w = Window.partitionBy(key).orderBy(pos)
    begins = F.when((F.col(gold) > 0) & (F.coalesce(F.lag(gold).over(w), F.lit(0)) == 0), 1).otherwise(0)
    base = scores.withColumn("begins", begins)
    grid = base.join(F.broadcast(thresholds)).withColumn("hit", (F.col(score) >= F.col("threshold")).cast("int"))
    wt = Window.partitionBy(key, "threshold").orderBy(pos)
    grid = grid.withColumn("opens", F.when((F.col("hit") == 1) & (F.coalesce(F.lag("hit").over(wt), F.lit(0)) == 0), 1).otherwise(0))
    grid = grid.withColumn("span", F.sum("opens").over(wt.rowsBetween(Window.unboundedPreceding, 0)))
    spans = grid.groupBy("threshold", key, F.when(F.col("hit") == 1, F.col("span")).alias("span")).agg(
        F.sum("begins").alias("gold_starts"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(gold) > 0, 1).otherwise(0)).alias("gold_tokens")
    )
    predicted = F.col("span").isNotNull()
    out = spans.groupBy("threshold").agg(
        F.sum(F.when(predicted, F.col("gold_starts")).otherwise(0)).alias("detected_gold_spans"),
        F.sum("gold_starts").alias("total_gold_spans"),
        F.count_if(predicted & (F.col("gold_starts") > 0)).alias("correct_pred_spans"),
        F.count_if(predicted).alias("total_pred_spans"),
        F.sum(F.when(predicted, F.col("n")).otherwise(0)).alias("predicted_tokens"),
        F.sum(F.when(predicted, F.col("gold_tokens")).otherwise(0)).alias("correct_pred_tokens"),
    )
    return out.withColumn("precision", F.col("correct_pred_spans") / F.greatest("total_pred_spans", F.lit(1))).withColumn("recall", F.col("detected_gold_spans") / F.greatest("total_gold_spans", F.lit(1)))


def sample_metrics(score: Column, gold: Column, threshold: Column) -> Column:
    """Span metrics of one sample from its arrays of scores and gold flags (numbers); a score at or above the threshold is predicted.

    No predicted spans give a precision of 0, no gold ones a recall of 0 and a full recall of 1.
    """
    flag = lambda x, i: F.coalesce(F.try_element_at(x, i), F.lit(0))
    at = lambda x, f: F.filter(F.when(F.size(x) > 0, F.sequence(F.lit(1), F.size(x))).otherwise(F.array().cast("array<int>")), f)
    begins = lambda x: at(x, lambda i: (flag(x, i) == 1) & ((i == 1) | (flag(x, F.greatest(i - 1, F.lit(1))) == 0)))
    ends = lambda x: at(x, lambda i: (flag(x, i) == 1) & (flag(x, i + 1) == 0))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)

    def metrics(x):
        hit, g, golds, starts, stops = (x[c] for c in ("hit", "gold", "golds", "starts", "stops"))
        found = F.size(F.filter(golds, lambda i: F.element_at(hit, i) == 1))
        right = F.size(F.filter(F.arrays_zip(starts.alias("starts"), stops.alias("stops")), lambda s: F.exists(golds, lambda i: (s["starts"] <= i) & (i <= s["stops"]))))
        n, m, both = F.size(golds), F.size(starts), total(F.zip_with(hit, g, lambda a, b: a * b))
        return F.struct(
            found.alias("detected_gold_spans"), (n - found).alias("missed_gold_spans"), n.alias("total_gold_spans"), right.alias("correct_pred_spans"), (m - right).alias("false_pred_spans"), m.alias("total_pred_spans"), both.alias("correct_pred_tokens"),
            total(hit).alias("predicted_tokens"), (right / F.greatest(m, F.lit(1))).alias("precision"), (found / F.greatest(n, F.lit(1))).alias("recall"), (found == n).cast("double").alias("full_recall"),
        )

    parts = lambda x: F.struct(x["hit"].alias("hit"), x["gold"].alias("gold"), begins(x["gold"]).alias("golds"), begins(x["hit"]).alias("starts"), ends(x["hit"]).alias("stops"))
    flags = F.struct(F.transform(score, lambda v: (v >= threshold).cast("int")).alias("hit"), F.transform(gold, lambda v: (v > 0).cast("int")).alias("gold"))
    return bound(flags, lambda x: bound(parts(x), metrics))


def first_after(toks: DataFrame, limits: DataFrame, key: str, limit: str, name: str = "first") -> DataFrame:
    """(key, name): the first token of each key that ends behind its limit; null where none does."""
    return first_token(toks, limits.select(key, limit), key, limit, name).select(key, name)
