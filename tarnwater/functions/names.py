"""File and feature names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def satellite(scene: Column) -> Column:
    """The digits of a scene id's first part."""
    return F.regexp_replace(F.split(scene, "_")[0], r"\D", "").try_cast("int")


def acquisition(scene: Column) -> Column:
    """The first eight digits in a row, as a date."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(scene, r"(\d{8})", 1), F.lit("")), F.lit("yyyyMMdd")).cast("date")


def slc_off(scene: Column) -> Column:
    """A scene of satellite 7 from 31 May 2003 on."""
    return F.coalesce((satellite(scene) == 7) & (acquisition(scene) >= F.lit("2003-05-31").cast("date")), F.lit(False))


def month_key(day: Column) -> Column:
    return (F.year(day) * 100 + F.month(day)).cast("int")


def fraction(text: Column) -> Column:
    """'3/4' or '0.75' as a number."""
    parts = F.split(text, "/")
    return F.when(F.size(parts) == 2, F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))).otherwise(text.try_cast("double"))


def epoch_minutes(stamp: Column) -> Column:
    """Minutes since 2023-01-01."""
    return F.timestamp_diff("MINUTE", F.lit("2023-01-01 00:00:00").cast("timestamp_ntz"), stamp).cast("int")


def from_epoch_minutes(minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes, F.lit("2023-01-01 00:00:00").cast("timestamp_ntz"))


def decimal_year(day: Column) -> Column:
    start = F.make_date(F.year(day), F.lit(1), F.lit(1))
    return F.year(day) + F.datediff(day, start) / F.datediff(F.add_months(start, 12), start)


def simple_lake(name: Column) -> Column:
    """The name before ';', and of that before ','."""
    return F.trim(F.split(F.split(name, ";")[0], ",")[0])


def orbit(file: Column) -> Column:
    """Cycle, pass and time of an altimetry file name: its sixth and seventh parts, and the first that begins with 20 and holds a T."""
    parts = F.split(file, "_")
    stamp = F.get(F.filter(parts, lambda p: p.startswith("20") & p.contains("T")), F.lit(0))
    return F.struct(F.get(parts, F.lit(5)).alias("cycle"), F.get(parts, F.lit(6)).alias("pass"), stamp.alias("stamp"))


def clean_number(text: Column) -> Column:
    """Without hard spaces and thousands commas; '--' and what isn't a number are null."""
    return F.regexp_replace(text, "[ ,]", "").try_cast("float")


def gauge_metres(feet: Column, offset: float = 0.0) -> Column:
    """A gauge's feet as metres; 0 and what isn't a number are missing."""
    return F.nullif(feet.try_cast("double"), F.lit(0.0)) * 0.3048 + offset


def field_value(fields: Column, name: str) -> Column:
    """The value of a named entry in an array of struct<fieldName, value>."""
    return F.get(F.filter(fields, lambda f: f["fieldName"] == name), F.lit(0))["value"]
