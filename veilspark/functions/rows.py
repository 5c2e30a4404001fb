"""Array -> rows without optimizer surprises.

A plain ``explode`` makes Catalyst infer ``size(arr) > 0`` and push that
predicate below the projections that compute ``arr`` — for span arrays that
means the whole detection pipeline is re-evaluated inside upstream joins and
filters.  ``explode_outer`` has no inferred filter; the empty/null rows it
yields are dropped *above* the generator instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keep: list, arr: Column | str, alias: str | tuple[str, str]) -> DataFrame:
    col = F.explode_outer(arr)
    names = (alias,) if isinstance(alias, str) else alias
    out = df.select(*keep, col.alias(*names))
    return out.filter(F.col(names[0]).isNotNull())
