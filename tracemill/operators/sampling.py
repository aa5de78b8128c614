"""Draws of tokens from logits, repeatable for each row and position whatever the partitioning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: Column, *counters: Column) -> Column:
    """A number from 0 up to but not 1, made from the first 52 bits of sha256 of seed and counters joined by colons."""
    text = F.concat_ws(":", seed.cast("string"), *(c.cast("string") for c in counters))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _draw(x: np.ndarray, u: float, temperature: float, top_k: int, top_p: float) -> int:
    p = np.exp((x - x.max()) / temperature)
    if top_k > 0 and top_k < len(x):
        p[x < np.partition(x, -top_k)[-top_k]] = 0.0  # those equal to the last one stay
    if top_p < 1.0:
        order = np.argsort(-x, kind="stable")
        falling = p[order] / p.sum()
        before = np.cumsum(falling) - falling
        p[order[1:][before[1:] > top_p]] = 0.0  # the token that crosses top_p stays
    total = np.cumsum(p)
    return int(min(np.searchsorted(total, u * total[-1], side="right"), np.flatnonzero(p)[-1]))


def sample_token(logits: Column, u: Column, *, temperature: float = 0.7, top_k: int = 0, top_p: float = 1.0, greedy: bool = False) -> Column:
    """Index drawn from an array of logits by a number u from 0 up to 1 (see uniform); the first largest one if greedy.

    Logits are divided by the temperature, which must be positive; those below the top_k-th largest go; sorted by falling probability, a token goes if those
    before it already exceed top_p. u then falls into the running sums of what is left, in the order of indices. Null or empty logits, a null among them, and a null u (unless
    greedy) give null.
    """
    if not greedy and temperature <= 0:
        raise ValueError("the temperature must be positive when sampling")

    @F.pandas_udf("int")
    def drawn(rows: pd.Series, us: pd.Series) -> pd.Series:
        out = []
        for row, u in zip(rows, us):
            x = None if row is None else np.asarray(row, float)
            if x is None or not len(x) or np.isnan(x).any() or (not greedy and (u is None or np.isnan(u))):
                out.append(None)
            else:
                out.append(int(x.argmax()) if greedy else _draw(x, u, temperature, top_k, top_p))
        return pd.Series(out, dtype="Int32")

    return drawn(logits.cast("array<double>"), u.cast("double"))
