"""Scalar functions on probabilities and vectors, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-10


def signed_ratio(a: Column, b: Column) -> Column:
    """How many times a is b; negative, and the other way round, unless a is larger."""
    return F.when(a > b, a / (b + F.lit(TINY))).otherwise(-(b / (a + F.lit(TINY))))


def trajectory(base: Column, sft: Column | None, dpo: Column, t: float = 0.005) -> Column:
    """Shape of a word's way through the stages (without sft: through two)."""
    if sft is None:
        return F.when(base - dpo > t, "decline").when(dpo - base > t, "rise").otherwise("flat")
    return (
        F.when((base - sft > t) & (sft - dpo > t), "decline")
        .when((sft - base > t) & (dpo - sft > t), "rise")
        .when((base - sft > t) & (dpo - sft > t), "V")
        .when((sft - base > t) & (sft - dpo > t), "peak")
        .when((base > t) & (sft < t) & (dpo < t), "eliminated")
        .when((base < t) & (sft < t) & (dpo > t), "superego_only")
        .otherwise("flat")
    )


def role(raw: Column, displaced: Column, shift: float = 0.01, gain: float = 0.003) -> Column:
    return F.when(raw > shift, "repressed").when(raw < -shift, "amplified").when(displaced > gain, "symptomatic").otherwise("neutral")


def drive_weight(base: Column, mean_base: Column) -> Column:
    return F.lit(1.0) + F.ln(F.lit(1.0) + base / (mean_base + F.lit(TINY)))


def floored(p: Column, least: float = TINY) -> Column:
    return F.greatest(p, F.lit(least))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))


def log_perplexity(p: Column) -> Column:
    return F.ln(p)


def number_or_zero(x: Column) -> Column:
    """A number from any column; what is none, or NaN, is 0."""
    value = x.try_cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(0.0)).otherwise(value)


def log_change(a: Column, b: Column) -> Column:
    """log10(b / a), floored and scaled to -1 .. 1 (for colours)."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.log10(F.greatest(b, F.lit(1e-7)) / F.greatest(a, F.lit(1e-7))) / F.lit(1.5)))


def change_colour(a: Column, b: Column, alpha: str = "0.6") -> Column:
    """Colour of a change: blue for a rise, red for a fall, grey between (as ``rgba(r,g,b,alpha)``)."""
    t = F.round(log_change(a, b), 9)
    grey = F.lit(1.0) - F.abs(t)
    shade = lambda x: F.floor(x).cast("string")
    red, blue = (F.lit(200.0) * F.greatest(s, F.lit(0.0)) + F.lit(120.0) * grey for s in (-t, t))
    return F.concat(F.lit("rgba("), shade(red), F.lit(","), shade(F.lit(100.0) * grey + F.lit(80.0)), F.lit(","), shade(blue), F.lit(f",{alpha})"))


def ordering(base: Column, sft: Column, dpo: Column) -> Column:
    """How three stages follow each other, without a threshold."""
    return (
        F.when((base > sft) & (sft > dpo), "falls")
        .when((base < sft) & (sft < dpo), "rises")
        .when((base > sft) & (sft < dpo), "falls, then rises")
        .when((base < sft) & (sft > dpo), "rises, then falls")
        .otherwise("other")
    )
