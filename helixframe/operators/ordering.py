"""Ranks and running sums over a whole table without a single ordered partition: buckets in order, their totals added up apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of equal width that a numeric order is cut into.
BUCKETS = 4096


def _with_ahead(df: DataFrame, bucket: Column, values: dict[str, Column], inside) -> DataFrame:
    """Add for every value the sum of it over the rows that come before; inside: the order of a bucket's rows."""
    df = df.withColumn("_bucket", bucket)
    totals = df.groupBy("_bucket").agg(*(F.sum(v).alias(f"_total_{n}") for n, v in values.items()))
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_bucket", *(F.coalesce(F.sum(f"_total_{n}").over(ahead), F.lit(0)).alias(f"_ahead_{n}") for n in values))
    own = Window.partitionBy("_bucket").orderBy(*inside).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumns({n: F.coalesce(F.sum(v).over(own), F.lit(0)) for n, v in values.items()}).join(F.broadcast(totals), "_bucket")
    return rows.withColumns({n: F.col(n) + F.col(f"_ahead_{n}") for n in values}).drop("_bucket", *(f"_ahead_{n}" for n in values))


def before(df: DataFrame, column: str, values: dict[str, Column], descending: bool = False, ties: tuple[str, ...] = (), buckets: int = BUCKETS) -> DataFrame:
    """Add sums of values over the rows before each one in the order of a numeric column, then of `ties`. Nulls come first going up, last going down."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    width = float(high) - float(low) if low is not None else 0.0
    place = F.floor((F.col(column) - F.lit(low)) / F.lit(width) * buckets) if width > 0 else F.when(F.col(column).isNotNull(), 0)
    place = F.coalesce(place.cast("long"), F.lit(-1))
    return _with_ahead(df, -place if descending else place, values, [F.desc(column) if descending else F.asc(column), *ties])


def numbered(df: DataFrame, column: str, name: str, prefix: int = 4) -> DataFrame:
    """Add 1, 2, ... in the order of a string column; buckets are its prefixes, at most the alphabet's size to the power `prefix`."""
    out = _with_ahead(df, F.substring(column, 1, prefix), {name: F.lit(1).cast("long")}, [F.asc(column)])
    return out.withColumn(name, (F.col(name) + 1).cast("long"))
