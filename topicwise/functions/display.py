"""Lag severities and meters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lag_severity(lag: Column, high: int = 50, low: int = 10, names=("red", "yellow", "green")) -> Column:
    """Console thresholds by default; the page used (100, 30, ("danger", "warn", ""))."""
    return F.when(lag > high, names[0]).when(lag > low, names[1]).otherwise(names[2])


def lag_meter(lag: Column, unit: int = 10, width: int = 25) -> Column:
    """One ``#`` per ``unit`` records of lag, at most ``width``."""
    bars = F.least(F.lit(width), F.greatest(F.lit(0), F.floor(lag / unit))).cast("int")
    return F.repeat(F.lit("#"), bars)


def lag_percent(lag: Column, full: int = 300) -> Column:
    """Share of the expected maximum in percent, halves rounded up, at most 100."""
    return F.least(F.lit(100), F.floor(lag * 100 / full + 0.5)).cast("bigint")


def lag_bar_percent(lag: Column, full: int = 300) -> Column:
    """Drawn width of the bar: never below 5."""
    return F.greatest(F.lit(5), lag_percent(lag, full)).cast("bigint")
