"""Folds over repair events: structs of start and the number of replacement tokens, in the order in which they happened."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.vectors import bound


def replaced(event: Column, new: str = "after", old: str = "replacement_token_ids") -> Column:
    """Token ids that an event put in, from either shape of event: after.token_ids or replacement_token_ids."""
    return F.coalesce(event[new]["token_ids"], event[old])


def surviving(events: Column, length: Column) -> Column:
    """(start, end, limit, whole) of what later backtracks leave of each event, in order: a fold from the last event back.

    An event's part of the tokens goes from its start to limit, where the next such part begins; its own tokens end at end. Null events leave nothing.
    """
    kind = "array<struct<start:int,end:int,limit:int,whole:boolean>>"
    begin = F.struct(length.cast("int").alias("limit"), F.array().cast(kind).alias("out"))

    def back(a, e):
        end, start = (e["start"] + e["n"]).cast("int"), e["start"].cast("int")
        part = F.struct(start.alias("start"), F.least(end, a["limit"]).alias("end"), a["limit"].alias("limit"), (end <= a["limit"]).alias("whole"))
        return F.struct(F.least(a["limit"], start).alias("limit"), F.when(start < a["limit"], F.array_append(a["out"], part)).otherwise(a["out"]).alias("out"))

    plain = F.transform(events, lambda e: F.struct(e["start"].cast("int").alias("start"), e["n"].cast("int").alias("n")))
    return F.reverse(F.aggregate(F.reverse(F.coalesce(plain, F.array().cast("array<struct<start:int,n:int>>"))), begin, back, lambda a: a["out"]))


def mask(events: Column, length: Column) -> Column:
    """0 or 1 for each token: 1 where the last event that starts at or before it covers it. Null events leave nothing marked; a negative start raises."""
    checked = F.transform(events, lambda e: F.struct(F.when(e["start"] < 0, F.raise_error(F.lit("negative start"))).otherwise(e["start"]).alias("start"), e["n"].alias("n")))

    def runs(parts):
        first = F.coalesce(F.try_element_at(parts, F.lit(1))["start"], length.cast("int"))
        own = F.transform(parts, lambda p: F.concat(F.array_repeat(F.lit(1), p["end"] - p["start"]), F.array_repeat(F.lit(0), p["limit"] - p["end"])))
        return F.concat(F.array_repeat(F.lit(0), first), F.flatten(own))

    return bound(surviving(checked, length), runs)


def visible(events: Column, length: Column) -> Column:
    """(start, end, whole) of the event ranges that survive later backtracks; whole: nothing of it was cut."""
    shown = F.filter(surviving(events, length), lambda r: r["start"] < r["end"])
    return F.transform(shown, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["whole"].alias("whole")))


def matching_blocks(a: list, b: list) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of the blocks that two sequences share, in order, none touching the next.

    The longest block is taken first, of equal ones that which begins first in a, then in b; what lies before it and after it in both is aligned in the same way. Where each value lies in b is
    looked up; runs of equal values grow by one from each place of a to the next.
    """
    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    found, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        best, before = (0, 0, 0), {}
        for i in range(a0, a1):
            here = {j: before.get(j - 1, 0) + 1 for j in places.get(a[i], ()) if b0 <= j < b1}
            for j, n in here.items():
                if n > best[0]:
                    best = (n, i - n + 1, j - n + 1)
            before = here
        n, i, j = best
        if n:
            found.append((i, j, n))
            open_ += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
    out: list = []
    for i, j, n in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


@F.pandas_udf(T.ArrayType(T.StructType().add("a", T.IntegerType()).add("b", T.IntegerType()).add("size", T.IntegerType())))
def align(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching blocks of two arrays of tokens; null arrays count as empty."""
    empty = lambda x: [] if x is None else list(x)
    return pd.Series([[{"a": i, "b": j, "size": n} for i, j, n in matching_blocks(empty(x), empty(y))] for x, y in zip(a, b)])


def undone(events: Column, ids: Column) -> Column:
    """For each event, latest first, (start, end, history): the tokens as they were when it began, what it removed at their end; events: structs of start and before.

    A fold undoes the events from the last one back: what an event removed takes the place of all from its start on.
    """
    kind = "array<struct<start:int,end:int,history:array<bigint>>>"
    begin = F.struct(ids.cast("array<bigint>").alias("now"), F.array().cast(kind).alias("out"))

    def back(a, e):
        start = e["start"].cast("int")
        history = F.concat(F.slice(a["now"], F.lit(1), start), e["before"].cast("array<bigint>"))
        row = F.struct(start.alias("start"), (start + F.size(e["before"])).alias("end"), history.alias("history"))
        return F.struct(history.alias("now"), F.array_append(a["out"], row).alias("out"))

    return F.aggregate(F.reverse(events), begin, back, lambda a: a["out"])


def baseline_mask(events: Column, ids: Column, baseline: Column) -> Column:
    """(mask, unmatched): tokens of an independent baseline that repairs removed from ids, and how many repairs have no place in it.

    A repair's removed tokens are marked where one block of the alignment of its history with the baseline holds them all; repairs that removed nothing are
    passed over. Null events and ids count as empty; a null baseline gives an empty mask and no unmatched repair.
    """
    none = F.coalesce(baseline, F.array().cast("array<bigint>")).cast("array<bigint>")
    steps = F.filter(undone(F.coalesce(events, F.array().cast("array<struct<start:int,before:array<bigint>>>")), F.coalesce(ids, F.array().cast("array<bigint>"))), lambda s: s["end"] > s["start"])
    return F.when(baseline.isNull(), F.struct(F.array().cast("array<int>").alias("mask"), F.lit(0).alias("unmatched"))).otherwise(_marked(steps, none))


@F.pandas_udf(T.StructType().add("mask", T.ArrayType(T.IntegerType())).add("unmatched", T.IntegerType()))
def _marked(steps: pd.Series, baseline: pd.Series) -> pd.DataFrame:
    rows = []
    for own, ids in zip(steps, baseline):
        ids, unmatched = list(ids), 0
        mask = [0] * len(ids)
        for s in own:
            for i, j, n in matching_blocks(list(s["history"]), ids):
                if i <= s["start"] and s["end"] <= i + n:
                    at = j + s["start"] - i
                    mask[at : at + s["end"] - s["start"]] = [1] * (s["end"] - s["start"])
                    break
            else:
                unmatched += 1
        rows.append((mask, unmatched))
    return pd.DataFrame(rows, columns=["mask", "unmatched"])


def stages(response: Column, spans: Column, most: int) -> Column:
    """Up to most + 1 stages (stage, text, spans): each ends with its first span still open, the last clean one has no span."""
    from tracemill.functions.text import prefix_cut

    size = F.least(F.size(spans), F.lit(most))
    open_ = F.transform(F.slice(spans, F.lit(1), size), lambda s, i: F.struct(i.alias("stage"), prefix_cut(response, F.array(s)).alias("text"), F.array(s).alias("spans")))
    clean = F.array(F.struct(size.alias("stage"), response.alias("text"), F.array().cast("array<string>").alias("spans")))
    return F.when(F.size(spans) <= most, F.concat(open_, clean)).otherwise(open_)
