"""Parsing and rounding helpers that respect the exact input rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def int_div(a: Column | str, n: int) -> Column:
    """Integer division, exact for every long."""
    return F.call_function("div", as_col(a), F.lit(n))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once; for short texts such as loci, not for hot columns."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_u32(c: Column | str) -> Column:
    """Unsigned 32-bit parse: digits with an optional plus sign, no blanks, else null.

    The range check goes through a failing int cast, so the number is written
    once; repeated arguments would multiply in nested expressions.
    """
    c = as_col(c)
    half = F.lit(1 << 31)
    n = F.when(c.rlike(r"^\+?[0-9]+$"), c.try_cast("bigint"))
    return F.try_subtract(n, half).try_cast("int").cast("bigint") + half


def parse_decimal(c: Column | str) -> Column:
    """Floating point parse without the JVM's type suffixes or blank trimming."""
    c = as_col(c)
    return F.when(
        c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), c.try_cast("double")
    )


def round_places(c: Column | str, places: int) -> Column:
    """Half-up rounding of a non-negative number."""
    scale = float(10**places)
    return F.floor(as_col(c).cast("double") * scale + 0.5) / scale


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(as_col(c), F.lit(""))
