"""Number cleaning expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_valid_number(c: Column) -> Column:
    """Only digits, commas and at most one dot, with at least one digit; no sign."""
    t = F.btrim(c, F.lit("".join(chr(i) for i in range(33))))
    shaped = t.rlike(r"^[0-9,]*\.?[0-9,]*$") & t.rlike(r"[0-9]")
    return F.coalesce(shaped, F.lit(False))


def parse_number(c: Column) -> Column:
    """The number a text starts with, grouping commas dropped; 0 when it starts with none."""
    head = F.regexp_extract(c, r"^(-?(?:[0-9,]*[0-9](?:\.[0-9]*)?|\.[0-9]+)(?:E-?[0-9]+)?)", 1)
    return F.coalesce(F.translate(head, ",", "").try_cast("double"), F.lit(0.0))


def parse_whole(c: Column) -> Column:
    """As `parse_number`, cut to a whole number."""
    return parse_number(c).cast("long")


def _scaled(c: Column, places: int, to_whole) -> Column:
    scale = float(10 ** places)
    return F.signum(c) * to_whole(F.abs(c * scale)) / scale


def round_half_away(c: Column, places: int) -> Column:
    return _scaled(c, places, lambda v: F.floor(v + 0.5))


def round_up(c: Column, places: int) -> Column:
    """Away from zero."""
    return _scaled(c, places, F.ceil)


def round_down(c: Column, places: int) -> Column:
    """Towards zero."""
    return _scaled(c, places, F.floor)


def whole_part(c: Column) -> Column:
    """The next whole number at or below."""
    return F.floor(c).cast("double")
