"""Words as every operator here takes them: runs without space, tab, line feed, VT, FF or CR."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of the contract, U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words of a text; none where it is null or blank."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, whatever the optimizer inlines."""
    return F.transform(F.array(value), body)[0]
