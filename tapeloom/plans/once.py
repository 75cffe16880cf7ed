"""Columns evaluated once per row.

A filter on a computed column is pushed below the projection that computes it, which
evaluates a costly expression in both places. A generator stops that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, keep: list[str], computed: list[Column]) -> DataFrame:
    """``keep`` as they are, plus ``computed`` (named columns) behind a one-row generator."""
    return df.select(*keep, F.inline(F.array(F.struct(*computed))))
