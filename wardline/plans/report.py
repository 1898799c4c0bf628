"""Presentation helpers for checked outputs: arrays as text, doubles rounded."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 9


def comparable(df: DataFrame, digits: int = DIGITS, sep: str = "|") -> DataFrame:
    """Round DOUBLE columns and join array<string> columns so that two engines can be
    compared value by value. Other types pass unchanged."""
    cols = []
    for name, typ in df.dtypes:
        c = F.col(f"`{name}`")
        if typ in ("double", "float"):
            c = F.round(c.cast("double"), digits)
        elif typ.startswith("array<"):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), sep)
        elif typ.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        cols.append(c.alias(name))
    return df.select(*cols)
