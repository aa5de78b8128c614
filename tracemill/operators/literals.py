"""An index of literals that lets many patterns meet many texts by equi-joins: nothing of either reaches the driver.

Each pattern names words that a text must hold as whole words. Words are counted over the texts, and a pattern is met by its rarest one
alone, so a frequent word brings no pairs unless a pattern has no other. What meets is a candidate, which the caller verifies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: As many words of patterns in all, each with its pattern, go to all tasks (some ten MB); with more, the words of texts are dealt out to meet them.
BROADCAST_WORDS = 300_000
#: Needles without a whole word inside meet texts by their first characters, this many at most.
GRAM = 6


def meet(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows of texts (h, words, and other columns) with p of each pattern (p, words) whose rarest word they hold; words and h go. Null and empty words meet nothing.

    Patterns of few words go to all tasks, and no text moves. With more, words of texts are dealt out to meet them, and texts are found again by h, a hash of the
    row; rows of one hash share their patterns, which is one more reason to verify.
    """
    kept = [c for c in texts.columns if c not in ("h", "words")]
    needed = patterns.select("p", F.explode(F.array_distinct("words")).alias("word"))
    wanted = needed.select("word").distinct()
    few = needed.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS  # so neither words nor patterns are more
    held = texts.select("h", F.explode(F.array_distinct("words")).alias("word")).join(F.broadcast(wanted) if few else wanted, "word", "left_semi")
    rare = needed.join(held.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word").groupBy("p").agg(F.min_by("word", F.struct("n", "word")).alias("word"), F.count(F.lit(1)).alias("found"))
    every = needed.groupBy("p").agg(F.count(F.lit(1)).alias("words"))
    anchors = rare.join(every, "p").where("found = words").select("p", "word")  # a word that no text holds ends it
    if few:
        own = anchors.groupBy("word").agg(F.collect_list("p").alias("ps"))
        met = texts.select(*kept, F.explode(F.array_distinct("words")).alias("word")).join(F.broadcast(own), "word")
        return met.select(*kept, F.explode("ps").alias("p"))
    pairs = held.join(anchors, "word").select("h", "p").distinct()
    return texts.drop("words").join(pairs, "h").select(*kept, "p")


def inner_words(needle: Column) -> Column:
    """Words of a needle with a blank on both sides: wherever the needle lies in a text, they are whole words of it."""
    parts = F.split(needle, r"\s+", -1)
    return F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda w: w != "")


def grams(text: Column, size: int) -> Column:
    """All runs of as many characters, from each character on, found in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def candidates(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """Rows of texts (h, text, and other columns), without h, with p of each needle (p, needle) that they may hold, exact strings."""
    needles = needles.withColumn("words", inner_words(F.col("needle")))
    out = meet(texts.withColumn("words", F.split("text", r"\s+", -1)), needles.where(F.size("words") > 0).select("p", "words"))
    short = needles.where(F.size("words") == 0).select("p", "needle", F.least(F.length("needle"), F.lit(GRAM)).alias("size"))
    for r in short.select("size").distinct().collect():  # GRAM sizes at most
        leads = short.where(F.col("size") == r[0]).select("p", F.array(F.substring("needle", 1, r[0])).alias("words"))
        out = out.unionByName(meet(texts.withColumn("words", grams(F.col("text"), r[0])), leads))
    return out
