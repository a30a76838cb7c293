"""Dates of partial precision: a struct of start (date) and precision (1 year, 2 month, 3 day)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTIAL = r"^(\d{4})(?:[-/](\d{1,2})(?:[-/](\d{1,2}))?)?$"
FORMATS = {1: "yyyy", 2: "yyyy-MM", 3: "yyyy-MM-dd"}


def parse_date(text: Column) -> Column:
    """struct<start date, precision int> of YYYY[-M[-D]]; months are held to 1-12 and days to 1-31; null if impossible."""
    part = lambda i: F.regexp_extract(text, PARTIAL, i)
    precision = F.when(~text.rlike(PARTIAL), F.lit(None)).when(part(2) == "", 1).when(part(3) == "", 2).otherwise(3).cast("int")
    held = lambda i, most: F.least(F.greatest(F.coalesce(F.try_to_number(F.nullif(part(i), F.lit("")), F.lit("99")).cast("int"), F.lit(1)), F.lit(1)), F.lit(most))
    start = F.try_to_date(F.format_string("%s-%02d-%02d", part(1), held(2, 12), held(3, 31)), "yyyy-MM-dd")
    return F.when(precision.isNotNull() & start.isNotNull(), F.struct(start.alias("start"), precision.alias("precision")))


def format_date(start: Column, precision: Column) -> Column:
    """The date as text, as far as its precision goes."""
    return F.when(precision == 1, F.date_format(start, FORMATS[1])).when(precision == 2, F.date_format(start, FORMATS[2])).when(precision == 3, F.date_format(start, FORMATS[3]))


def year_length(year: Column) -> Column:
    return F.when((year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0)), 366.0).otherwise(365.0)


def fractional_year(day: Column) -> Column:
    """The year and the share of it that has gone, leap years included."""
    year = F.year(day)
    return year + (F.dayofyear(day) - 1) / year_length(year)


def span(start: Column, precision: Column) -> Column:
    """struct<v, sd>: the middle of the period in years and the standard deviation of a uniform one of its width."""
    width = F.when(precision == 1, 1.0).when(precision == 2, 1 / 12).otherwise(1 / 365)
    return F.struct((fractional_year(start) + width / 2).alias("v"), (width / 12**0.5).alias("sd"))


def window_of(start: Column, precision: Column) -> Column:
    """struct<lo, hi>: the period, a day wider on either side; hi is exclusive."""
    end = F.when(precision == 1, F.add_months(start, 12)).when(precision == 2, F.add_months(start, 1)).otherwise(F.date_add(start, 1))
    return F.struct(F.date_sub(start, 1).alias("lo"), F.date_add(end, 1).alias("hi"))


def date_from_name(name: Column) -> Column:
    """The date a folder's name begins with: a year 1800-2099, then month and day if they are valid; otherwise an empty string."""
    pattern = r"^\s*((?:18|19|20)\d\d)(?:[-._](\d{1,2})(?:[-._](\d{1,2}))?)?(?!\d)"  # a fixed value
    part = lambda i: F.regexp_extract(name, pattern, i)
    month, day = (F.coalesce(F.nullif(part(i), F.lit("")).cast("int"), F.lit(0)) for i in (2, 3))
    whole = F.try_to_date(F.format_string("%s-%02d-%02d", part(1), month, day), "yyyy-MM-dd")
    return F.when(month.between(1, 12) & whole.isNotNull(), F.date_format(whole, FORMATS[3])).when(month.between(1, 12), F.format_string("%s-%02d", part(1), month)).otherwise(part(1))
