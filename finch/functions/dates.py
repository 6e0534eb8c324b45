"""Date parsing with bad values turned into NULL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DATE_FORMATS = ("MM/dd/yyyy", "yyyy-MM-dd")


def coerce_date(col, formats=DATE_FORMATS) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])
