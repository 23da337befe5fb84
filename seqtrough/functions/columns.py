"""Column expressions that every operator shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .params import MICRO


def micro(x: Column) -> Column:
    """``x`` in whole millionths; the same arithmetic gives the same number in any engine."""
    return F.floor(x * float(MICRO) + 0.5).cast("long")


def rounded(x: Column, digits: int = 6) -> Column:
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def sanitised(text: Column) -> Column:
    """Upper case, U as T, everything but A, C, G, T and N deleted."""
    return F.regexp_replace(F.translate(F.upper(text), "U", "T"), "[^ACGTN]+", "")


def gc_count(seq: Column) -> Column:
    return F.length(seq) - F.length(F.translate(seq, "GC", ""))


def gc_percent(seq: Column) -> Column:
    return rounded(100.0 * gc_count(seq) / F.greatest(F.length(seq), F.lit(1)), 2)
