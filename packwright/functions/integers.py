"""Whole-number arithmetic that never passes through a double."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(number: Column, by: Column | int) -> Column:
    by = by if isinstance(by, Column) else F.lit(by)
    return F.call_function("div", number, by)
