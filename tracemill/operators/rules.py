"""Rule baseline: learn phrase patterns from labelled spans and apply them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions import text
from tracemill.operators import literals, spans

#: Rules without a word that a text must hold are tried on all texts, as many to a block.
BLOCK = 200


def learn(found: DataFrame, *, least_chars: int = 6, least_words: int = 2, least_support: int = 1, exact_only: bool = False, max_rules: int | None = None) -> DataFrame:
    """(pattern, kind, support, examples, words): exact and generalised patterns of spans (seq, span), most supported first, then the longest.

    words: what a text must hold as whole words for a match. A span without a value has no generalised pattern; null spans have none. max_rules keeps
    the first rules; without it all stay.
    """

    @F.pandas_udf("array<struct<pattern:string,kind:string,words:array<string>>>")
    def patterns(s: pd.Series) -> pd.Series:
        def of(t):
            exact, general = text.exact_pattern(t), None if exact_only else text.general_pattern(t)
            out = [{"pattern": exact, "kind": "exact", "words": text.needed_words(t, values=False)}]
            return out + ([{"pattern": general, "kind": "generalized", "words": text.needed_words(t, values=True)}] if general not in (None, exact) else [])

        return s.map(of)

    enough = (F.length("span") >= least_chars) & (F.regexp_count("span", F.lit(r"(?U)\w+")) >= least_words)
    rows = found.withColumn("span", text.normal_space(F.col("span"))).where(enough).select("seq", "span", F.explode(patterns("span")).alias("p"))
    first = rows.groupBy("p.pattern", "span").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"), F.min_by("p.kind", "seq").alias("kind"), F.min_by("p.words", "seq").alias("words"))
    ranked = first.withColumn("k", F.row_number().over(Window.partitionBy("pattern").orderBy("seq", "span")))
    out = ranked.groupBy("pattern").agg(F.sum("n").alias("support"), F.min_by("kind", "seq").alias("kind"), F.sort_array(F.collect_list(F.when(F.col("k") <= 5, F.struct("k", "span")))).alias("e"), F.min_by("words", "seq").alias("words"))
    out = out.where(F.col("support") >= least_support).select("pattern", "kind", "support", F.col("e.span").alias("examples"), "words").orderBy(F.desc("support"), F.desc(F.length("pattern")), "pattern")
    return out if max_rules is None else out.limit(max_rules)


@F.pandas_udf(T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())))
def matches(s: pd.Series, patterns: pd.Series) -> pd.Series:
    """Matches of each of a row's patterns in its text, without outer white space."""
    out = []
    for t, own in zip(s, patterns):
        found = []
        for p in own:
            for m in re.finditer(p, t):  # the module keeps compiled patterns
                a, b = m.span()
                piece = t[a:b]
                a, b = a + len(piece) - len(piece.lstrip()), b - len(piece) + len(piece.rstrip())
                if a < b:
                    found.append({"start": a, "end": b})
        out.append(found)
    return pd.Series(out)


def apply(responses: DataFrame, rules: DataFrame, *, key: str, text_col: str, merge: bool = False) -> DataFrame:
    """(key, start, end) of every match of any rule, distinct; with merge, their union by key, touching ones joined. Offsets count code points.

    A rule meets the texts that hold its rarest word, and its pattern runs on those alone. Rules without words (an empty or null array, or no such column) run
    on all texts, a block of rules at a time. Null and empty texts have no match.
    """
    needed = F.col("words") if "words" in rules.columns else F.lit(None).cast("array<string>")
    own = rules.select("pattern", F.xxhash64("pattern").alias("p"), F.coalesce(needed, F.array().cast("array<string>")).alias("words"))
    rows = responses.where(F.length(text_col) > 0).select(F.col(key).alias("_key"), F.col(text_col).alias("_text"), F.xxhash64(key, text_col).alias("h"))
    bound = own.where(F.size("words") > 0)
    met = literals.meet(rows.withColumn("words", F.regexp_extract_all("_text", F.lit(r"(?U)\w+"), F.lit(0))), bound.select("p", "words"))
    tried = met.join(bound.select("p", "pattern"), "p").select("_key", "_text", F.array("pattern").alias("patterns"))
    free = own.where(F.size("words") == 0)
    n = free.count()
    if n:
        blocks = free.groupBy(F.pmod("p", F.lit(-(-n // BLOCK))).alias("b")).agg(F.collect_list("pattern").alias("patterns")).select("patterns")
        tried = tried.unionByName(rows.select("_key", "_text").crossJoin(blocks))
    out = tried.select(F.col("_key").alias(key), F.explode(matches("_text", "patterns")).alias("s")).select(key, "s.start", "s.end").distinct()
    return spans.merge_spans(out, key) if merge else out


def token_hits(toks: DataFrame, found: DataFrame, key: str, shift: Column, first: Column) -> DataFrame:
    """Tokens from the first of the response on that overlap a match; matches count from the response's start, which lies at shift."""
    moved = found.select(key, (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"))
    return spans.overlapping(toks, moved, key).where(F.col("pos") >= first)
