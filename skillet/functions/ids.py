"""Ids written as text: two ids are the same when their digits are the same number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_in(c: Column | str) -> Column:
    """The number in an id as bigint; null for null, no digits, or more than 18 digits."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c.cast("string"), "[^0-9]", "").try_cast("bigint")
