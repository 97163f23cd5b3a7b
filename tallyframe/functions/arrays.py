"""Expressions on strings and arrays: tokens, characters, padding, search, counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_tokens(c: Column, sep: str, n: int, prefix: str) -> dict[str, Column]:
    """``prefix0`` ... for the first ``n`` tokens, '' where there are fewer or the value is null."""
    parts = F.split(c, f"\\Q{sep}\\E")
    return {f"{prefix}{i}": F.coalesce(F.get(parts, F.lit(i)), F.lit("")) for i in range(n)}


def char_positions(c: Column, n: int, prefix: str) -> dict[str, Column]:
    """One column a character position; null beyond the end."""
    return {f"{prefix}{i}": F.nullif(F.substring(c, i + 1, 1), F.lit("")) for i in range(n)}


def pad(c: Column, n: int, value: Column) -> Column:
    """The first ``n`` elements, filled up with ``value``."""
    return F.slice(F.concat(c, F.array_repeat(value, n)), 1, n)


def find(c: Column, part: Column) -> Column:
    """0-based place of the first occurrence of array ``part`` in ``c``; -1 if there is none."""
    starts = F.sequence(F.lit(0), F.size(c) - F.size(part))
    hits = F.filter(starts, lambda i: F.slice(c, i + 1, F.size(part)) == part)
    return F.when(F.size(c) < F.size(part), F.lit(-1)).otherwise(F.coalesce(F.get(hits, F.lit(0)), F.lit(-1)))


def bincount(c: Column, n: int) -> Column:
    """How often each of 0 to n - 1 is in an integer array."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.size(F.filter(c, lambda x: x == k)))


def sorted_unique(c: Column) -> Column:
    """An aggregate: the sorted distinct values of a group."""
    return F.array_sort(F.collect_set(c))


def repair_age(age: Column, year: int) -> Column:
    """Ages given as years of birth turned into ages; what is beyond 15 to 100 becomes null."""
    fixed = F.when(age.between(1900, year), F.lit(year) - age).otherwise(age)
    return F.when(fixed.between(15, 100), fixed)


def ladder(rules: list[tuple[Column, object]], other: object) -> Column:
    """The value of the first rule that holds, else ``other``; a null test doesn't hold."""
    out = F.lit(other)
    for test, value in reversed(rules):
        out = F.when(test, F.lit(value)).otherwise(out)
    return out
