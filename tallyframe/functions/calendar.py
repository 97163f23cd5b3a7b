"""Calendar columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar(day: Column) -> dict[str, Column]:
    """year, month, day, weekday (Monday 0), day to and from the month's ends, season by month and day, packed date."""
    md = F.month(day) * 100 + F.dayofmonth(day)
    season = F.when((md >= 321) & (md < 621), "spring").when((md >= 621) & (md < 923), "summer").when((md >= 923) & (md < 1221), "autumn").otherwise("winter")
    return {
        "year": F.year(day), "month": F.month(day), "day": F.dayofmonth(day), "weekday": F.weekday(day), "is_weekend": (F.weekday(day) >= 5).cast("int"),
        "to_month_end": F.datediff(F.last_day(day), day), "from_month_start": F.dayofmonth(day) - 1, "season": season, "packed": F.date_format(day, "yyyyMMdd").cast("int"),
    }


def packed_hour(c: Column) -> Column:
    """A timestamp from YYMMDDHH."""
    return F.to_timestamp(F.concat(F.lit("20"), c.cast("string")), "yyyyMMddHH")


def recency_weight(days: Column, rate: float) -> Column:
    """rate ** ((365 - days) // 60), 1 beyond a year."""
    return F.when(days > 365, 1.0).otherwise(F.pow(F.lit(rate), F.floor((365 - days) / 60)))
