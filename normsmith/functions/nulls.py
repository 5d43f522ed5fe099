"""Null conventions.

Three conventions meet in the source data: the CSV reader's empty/``NA``
tokens, the text ``NULL`` written by the export, and recode tables where the
text ``NA`` is a real label.  One function normalises them at the source.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalise_nulls(df: DataFrame, tokens: Iterable[str] = ("", "NA", "NULL"), columns: Iterable[str] | None = None) -> DataFrame:
    """Every string column (or ``columns``): a value equal to a token becomes
    null.  Non-string columns are left alone."""
    toks = list(tokens)
    names = set(columns) if columns is not None else {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    sel = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in names:
            c = F.when(c.isin(toks), F.lit(None).cast("string")).otherwise(c)
        sel.append(c.alias(f.name))
    return df.select(*sel)


def to_double(col: Column) -> Column:
    """Numeric cast where bad text becomes null (plain ``cast`` throws
    under ANSI mode)."""
    return col.try_cast("double")


def to_int_truncating(col: Column) -> Column:
    """R ``as.integer('25.7') == 25``: parse as double, then truncate."""
    return col.try_cast("double").cast("int")
