"""Months of activity as bits: one long per user and 63 months.

A calendar month has a number (``month_index``); month i is bit i % ``WIDTH`` of the column ``months_<i // WIDTH>``. The bits of
a user's events are put together by ``bit_or``, which aggregates map-side, so a user with very many events is one row
a task, and "active in month m" is a bit test without a join or a distinct.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 63
PREFIX = "months_"
MEAN_MONTH = 30.436875  # days; the first days of months d months apart lie within 4 days of d times this


def month_index(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date) - 1


def slots_of(first: int | None, last: int | None) -> list[int]:
    """Numbers of the columns that hold the months first to last."""
    return [] if first is None or last is None else list(range(first // WIDTH, last // WIDTH + 1))


def slots_in(columns: Iterable[str]) -> list[int]:
    return sorted(int(c[len(PREFIX) :]) for c in columns if c.startswith(PREFIX))


def month_bits(date: Column, when: Column, slots: Sequence[int]) -> list[Column]:
    """Aggregates: the months of the rows for which ``when`` holds, as one long each slot (NULL: none)."""
    index = month_index(date)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(index, F.lit(WIDTH)).cast("int"))
    return [F.bit_or(F.when(when & (F.floor(index / WIDTH) == s), bit)).alias(f"{PREFIX}{s}") for s in slots]


def has_month(index: Column, slots: Sequence[int]) -> Column:
    """Whether the month of that number is among the bits; false where no slot holds it."""
    shift = F.pmod(index, F.lit(WIDTH)).cast("int")
    found = F.lit(0).cast("long")
    for s in slots:
        here = F.call_function("shiftright", F.coalesce(F.col(f"{PREFIX}{s}"), F.lit(0).cast("long")), shift).bitwiseAND(F.lit(1).cast("long"))
        found = F.when(F.floor(index / WIDTH) == s, here).otherwise(found)
    return found == 1


def offsets(number: int, days: float) -> list[int]:
    """Distances in calendar months that can have the month number ``number``: whole periods of ``days`` days, cut toward zero."""
    low, high = (number * days, (number + 1) * days) if number > 0 else ((number - 1) * days, number * days) if number < 0 else (-days, days)
    around = range(math.floor(low / MEAN_MONTH) - 2, math.ceil(high / MEAN_MONTH) + 3)
    return [d for d in around if d * MEAN_MONTH + 4 >= low and d * MEAN_MONTH - 4 <= high]


def active_numbers(start: Column, numbers: Sequence[int], days: float, slots: Sequence[int]) -> Column:
    """Those of ``numbers`` that the months among the bits have, counted from the month that begins at ``start`` (an array)."""
    around = [d for n in numbers for d in offsets(n, days)]
    if not around or not slots:
        return F.array().cast("array<int>")
    index = month_index(start)
    held = F.filter(F.sequence(F.lit(min(around)), F.lit(max(around))), lambda d: has_month(index + d, slots))
    number = F.transform(held, lambda d: (F.datediff(F.add_months(start, d), start) / F.lit(float(days))).cast("int"))
    return F.array_intersect(F.array(*map(F.lit, numbers)), number)


def slots_around(starts: DataFrame, column: str, numbers: Sequence[int], days: float) -> list[int]:
    """Slots that can hold the months of ``numbers`` counted from any date of the column. Reads their first and last
    value (one small aggregate, while the plan is built)."""
    first, last = starts.agg(F.min(month_index(F.col(column))), F.max(month_index(F.col(column)))).first()
    if first is None or not numbers:
        return []
    around = [d for n in numbers for d in offsets(n, days)]
    return slots_of(first + min(around), last + max(around))
