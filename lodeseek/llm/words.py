"""Word columns: runs of anything but ASCII white space, on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space: 0x20 and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
_SPLIT = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Array of the words of a text; null counts as none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPLIT))


def held(value: Column) -> Column:
    """``value``, always. Being formally indeterminate, it is computed where it stands: a filter above is not pushed below it,
    which would put the expressions of whole arrays into the lambdas that run for each of their elements."""
    return F.when(F.spark_partition_id() >= 0, value)
