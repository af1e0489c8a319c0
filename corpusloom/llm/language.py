"""The language that a label names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def language(lang: Column) -> Column:
    """en for `EN`, ` en`, `en-EN` and `en_x`; und for NULL."""
    return F.coalesce(F.regexp_replace(F.lower(F.trim(lang)), "[-_].*$", ""), F.lit("und"))
