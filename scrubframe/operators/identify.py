"""Consistent replacement of study, series and object identifiers, in columns and in paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubframe.functions.text import pseudonymise_uid

ID_COLUMNS = ["study", "series", "sop"]


def pseudonymise_ids(df: DataFrame, salt: str, mode: str = "decimal", path: str = "path") -> DataFrame:
    """Hash the three identifier columns, and every path element that equals one of them.

    An element's extension is kept. The hash depends only on the identifier and the salt, so
    rows agree without a mapping table.
    """
    hashed = df
    for c in ID_COLUMNS:
        hashed = hashed.withColumn(f"_{c}", pseudonymise_uid(F.col(c), salt, mode))

    def element(e):
        out = e
        for c in reversed(ID_COLUMNS):
            named = F.when(e == F.col(c), F.col(f"_{c}"))
            with_suffix = F.when(e == F.concat(F.col(c), F.lit(".dcm")), F.concat(F.col(f"_{c}"), F.lit(".dcm")))
            out = F.coalesce(named, with_suffix, out)
        return out

    renamed = F.array_join(F.transform(F.split(F.col(path), "/"), element), "/")
    # The path is rewritten while the columns still hold the original identifiers.
    moved = hashed.withColumn(path, renamed)
    return moved.select(*(F.col(f"_{c}").alias(c) if c in ID_COLUMNS else F.col(c) for c in df.columns))
