"""Reproducible random draws as plain expressions of the row's key."""

from pyspark.sql import Column, functions as F

TWO_52 = float(1 << 52)


def uniform_draw(*parts) -> Column:
    """52 bits of md5 over the colon-joined parts, scaled to [0, 1).

    The draw depends on the key of the row alone, never on partitioning or retries.
    """
    cols = [p if isinstance(p, Column) else F.col(p) for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(TWO_52)


def exponential_draw(*parts) -> Column:
    """Standard exponential variate of the same key; half a step is added so that the logarithm is finite."""
    return -F.ln(uniform_draw(*parts) + F.lit(0.5 / TWO_52))
