"""Columns by name from tables whose other columns may have any names, dots and names that differ by case included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def place(df: DataFrame, name: str) -> int:
    """Where a column is: the first of exactly this name, else the first of this name in any case."""
    if name in df.columns:
        return df.columns.index(name)
    return [c.lower() for c in df.columns].index(name.lower())


def numbered(df: DataFrame) -> DataFrame:
    """The same columns as ``c0``, ``c1`` and so on."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, under these names."""
    return numbered(df).select(*(F.col(f"c{place(df, name)}").alias(name) for name in names))


def carried(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, of which ``text`` is one, and all others as one struct ``rest``, which ``restored`` takes apart. A
    text that isn't a string is in there too."""
    rest = [F.col(f"c{i}") for i in range(len(df.columns)) if not _once(df, i)]
    named = [F.col(f"c{place(df, name)}").alias(name) for name in names]
    return numbered(df).select(*named, F.struct(*(rest or [F.lit(0).alias("nothing")])).alias("rest"))


def _once(df: DataFrame, i: int) -> bool:
    return i == place(df, "text") and isinstance(df.schema[i].dataType, StringType)


def restored(rows: DataFrame, df: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``df`` from ``rows(text, rest)``, which ``carried`` began."""
    return rows.select(*(F.col(text) if _once(df, i) else F.col(f"rest.c{i}") for i in range(len(df.columns)))).toDF(*df.columns)
