"""Column functions over arrays of doubles: detector scores and trace quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def bound(value: Column, f) -> Column:
    """f(value) with value computed once: inside a lambda a plain column would be computed again for each element."""
    return F.transform(F.array(value), f)[0]


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return F.when(F.size(x) > 0, total(x) / F.size(x))


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def cosine(x: Column, y: Column) -> Column:
    return dot(x, y) / F.greatest(F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)), F.lit(EPS))


def variation(x: Column) -> Column:
    """Population deviation over the mean; 0 for an empty array."""
    spread = lambda m: F.sqrt(total(F.transform(x, lambda v: (v - m) * (v - m))) / F.greatest(F.size(x), F.lit(1))) / F.greatest(m, F.lit(EPS))
    return F.when(F.size(x) == 0, F.lit(0.0)).otherwise(bound(F.coalesce(mean(x), F.lit(0.0)), spread))


def lower_median(x: Column) -> Column:
    return F.get(F.sort_array(x), F.floor((F.size(x) - 1) / 2).cast("int"))


def median_normal(x: Column) -> Column:
    """max(0, v - lower median) of each value."""
    return bound(lower_median(x), lambda m: F.transform(x, lambda v: F.greatest(F.lit(0.0), v - m)))


def shape_score(x: Column, gold: Column) -> Column:
    """Cosine with the gold mask, or minus the variation where no token is gold."""
    return F.when(total(gold) > 0, cosine(x, gold)).otherwise(-variation(x))


def contrast_score(x: Column, gold: Column) -> Column:
    """Cosine of the normalised scores times the positive gap of their conditional means."""

    def score(n):
        on, off = total(gold), F.size(x) - total(gold)
        gap = dot(n, gold) / F.greatest(on, F.lit(1.0)) - (total(n) - dot(n, gold)) / F.greatest(off, F.lit(1.0))
        return cosine(n, gold) * F.greatest(F.lit(0.0), gap)

    return bound(median_normal(x), score)


def softmax(x: Column) -> Column:
    scaled = lambda e: bound(total(e), lambda s: F.transform(e, lambda v: v / s))
    return bound(F.array_max(x), lambda top: bound(F.transform(x, lambda v: F.exp(v - top)), scaled))


def js_divergence(x: Column, y: Column) -> Column:
    """Jensen-Shannon divergence of two logit vectors, natural log, not below 0; null for a null vector, 0 for empty ones."""
    side = lambda a, b: total(F.zip_with(a, b, lambda u, v: F.when(u > 0, u * F.log(2 * u / (u + v))).otherwise(F.lit(0.0))))
    both = bound(softmax(x), lambda p: bound(softmax(y), lambda q: F.greatest(F.lit(0.0), 0.5 * side(p, q) + 0.5 * side(q, p))))
    return F.when(x.isNotNull() & y.isNotNull(), both)


def perplexity(logp: Column) -> Column:
    return F.exp(-mean(logp))


def gains(blind: Column, told: Column) -> Column:
    """max(0, told - blind) by position; null for empty or unequal arrays."""
    return F.when((F.size(blind) == F.size(told)) & (F.size(blind) > 0), F.zip_with(told, blind, lambda t, b: F.greatest(F.lit(0.0), t - b)))


def top_count(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(0.05 * n + 0.999999).cast("int"))


def pcs(blind: Column, told: Column) -> Column:
    """Mean of the largest twentieth (one at least) of the gains."""
    g = gains(blind, told)
    k = top_count(F.size(g))
    return total(F.slice(F.sort_array(g, False), F.lit(1), k)) / k


def without_top(blind: Column, told: Column) -> Column:
    """(kept positions, removed fraction): drops the largest positive gains, first position first among equals."""
    return bound(gains(blind, told), _without_top)


def _without_top(g: Column) -> Column:
    ranked = F.transform(F.array_sort(F.transform(g, lambda v, i: F.struct((-v).alias("v"), i.alias("i")))), lambda s: F.struct((-s["v"]).alias("v"), s["i"].alias("i")))
    gone = F.transform(F.filter(F.slice(ranked, F.lit(1), top_count(F.size(g))), lambda s: s["v"] > 0), lambda s: s["i"])
    kept = lambda gone: F.array_except(F.sequence(F.lit(0), F.size(g) - 1), gone)
    return bound(gone, lambda x: F.struct(kept(x).alias("kept"), (F.size(x) / F.size(g)).alias("removed_fraction")))


def gain(base: Column, reasoned: Column) -> Column:
    """Difference of means; null unless both have the same positive length."""
    return F.when((F.size(base) == F.size(reasoned)) & (F.size(base) > 0), mean(reasoned) - mean(base))


def harmonic(a: Column, b: Column) -> Column:
    return 2 * a * b / F.greatest(a + b, F.lit(EPS))


def linspace(top: Column, steps: int) -> Column:
    """Ascending distinct thresholds from 0 to top; 0 alone where top is not positive."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: top * i / max(steps - 1, 1))
    return F.when(top <= 0, F.array(F.lit(0.0))).otherwise(F.array_sort(F.array_distinct(grid)))


def attention_mass(mass: Column, context: Column) -> Column:
    """Sum of the mass at the 0-based positions of a context; 0 for none."""
    return total(F.transform(context, lambda i: F.coalesce(F.try_element_at(mass, (i + 1).cast("int")), F.lit(0.0))))
