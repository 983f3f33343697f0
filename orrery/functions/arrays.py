"""Arrays of structs in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_order(items: Column, key: str) -> Column:
    """An array of structs sorted by one field; the others need no order of their own, as maps have none."""
    return F.array_sort(items, lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0))
