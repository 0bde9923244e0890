"""Punycode of domain names: the one scalar function that Spark has no expression for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F


def to_ascii(name: str | None) -> str | None:
    """ASCII form of a domain name; null if there is none."""
    if not name:
        return None
    if name.isascii():
        return name
    try:
        return name.encode("idna").decode()
    except UnicodeError:
        return None


def ascii_domain(name):
    """ASCII names pass in the JVM; only others reach Python, as Arrow batches."""

    @F.pandas_udf("string")
    def convert(names: pd.Series) -> pd.Series:
        return names.map(to_ascii)

    plain = name.rlike(r"^[\x00-\x7f]*$")
    return F.when(plain, name).otherwise(convert(F.when(~plain, name)))
