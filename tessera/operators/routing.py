"""Routing of rows to children, as Column expressions and equi-joins.

A value's cell on its set's grid is plain arithmetic (whole-stage code); children
are then found by an equi-join on the cell's number. Only bounds that fit no grid
need a range join.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boundaries import IdGrid, TimeGrid
from ..functions.intervals import SECOND

#: Divisor of an integer control to whole seconds.
EPOCHS = {"seconds": 1, "milliseconds": 1_000, "nanoseconds": 1_000_000_000}
#: Most children that a join may broadcast.
MOST_BROADCAST_CHILDREN = 100_000
_ZERO = datetime(1970, 1, 1)


def micros(t: datetime) -> int:
    d = t - _ZERO
    return (d.days * 86_400 + d.seconds) * SECOND + d.microseconds


def whole(control: Column) -> Column:
    """A number control as a whole number, cut towards zero."""
    return control.cast("bigint")


def as_time(control: Column, epoch: str = "none") -> Column:
    """A time or epoch control as a timestamp without zone; the session's zone is UTC."""
    if epoch == "none":
        return control.cast("timestamp_ntz")
    return F.timestamp_seconds((whole(control) - F.pmod(whole(control), F.lit(EPOCHS[epoch]))) / EPOCHS[epoch]).cast("timestamp_ntz")


def _floor_div(x: Column, n: int) -> Column:
    return ((x - F.pmod(x, F.lit(n))) / F.lit(n)).cast("bigint") if n != 1 else x


def grid_index(control: Column, grid: TimeGrid | IdGrid, epoch: str = "none") -> Column:
    """Number of the value's cell; values before the anchor have negative numbers."""
    if isinstance(grid, IdGrid):
        # Decimals are floored, so that each value is inside its cell's bounds.
        return _floor_div(F.floor(control).cast("bigint") - grid.anchor, grid.step)
    t = as_time(control, epoch)
    if grid.interval.fixed():
        step = grid.interval.days * 86_400 * SECOND + grid.interval.micros
        return _floor_div(F.unix_micros(t.cast("timestamp")) - micros(grid.anchor), step)
    a = grid.anchor
    months = (F.year(t) - a.year) * 12 + F.month(t) - a.month
    since = micros(a) - micros(datetime(a.year, a.month, 1))
    within = F.unix_micros(t.cast("timestamp")) - F.unix_micros(F.date_trunc("month", t))
    return _floor_div((months - (within < since).cast("int")).cast("bigint"), grid.interval.months)


def child_start(control: Column, grid: TimeGrid | IdGrid, epoch: str = "none") -> Column:
    """Lower bound of the value's cell."""
    n = grid_index(control, grid, epoch)
    if isinstance(grid, IdGrid):
        return n * grid.step + grid.anchor
    if grid.interval.fixed():
        step = grid.interval.days * 86_400 * SECOND + grid.interval.micros
        return F.timestamp_micros(n * step + micros(grid.anchor)).cast("timestamp_ntz")
    a = grid.anchor
    start = F.add_months(F.lit(a.date()), (n * grid.interval.months).cast("int")).cast("timestamp")
    return F.timestamp_micros(F.unix_micros(start) + micros(a) - micros(datetime(a.year, a.month, a.day))).cast("timestamp_ntz")


def century_start(t: Column) -> Column:
    """Start of the century, which begins at year ...01."""
    return F.make_timestamp_ntz(F.floor((F.year(t) - 1) / 100).cast("int") * 100 + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def suffix_column(start: Column, pattern: str) -> Column:
    return F.date_format(start, "yyyyMMdd" if pattern == "YYYYMMDD" else "yyyyMMdd_HHmmss")


def route(df: DataFrame, control: str, grid: TimeGrid | IdGrid, children: DataFrame, default: str | None, n_children: int, epoch: str = "none", out: str = "child") -> DataFrame:
    """Add each row's child from ``children`` (cell, name); no child: the default. Null controls go to the default."""
    small = F.broadcast(children) if n_children <= MOST_BROADCAST_CHILDREN else children
    right = small.select(F.col("cell").alias("__cell"), F.col("name").alias("__name"))
    joined = df.withColumn("__at", grid_index(F.col(f"`{control}`"), grid, epoch)).join(right, F.col("__at") == F.col("__cell"), "left")
    return joined.withColumn(out, F.coalesce("__name", F.lit(default))).drop("__at", "__cell", "__name")


def route_by_bounds(df: DataFrame, value: Column, bounds: DataFrame, default: str | None, out: str = "child") -> DataFrame:
    """As ``route`` for bounds (lo, hi, name) that fit no grid: a range join."""
    right = bounds.select(F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("name").alias("__name"))
    joined = df.join(F.broadcast(right), (value >= F.col("__lo")) & (value < F.col("__hi")), "left")
    return joined.withColumn(out, F.coalesce("__name", F.lit(default))).drop("__lo", "__hi", "__name")
