"""The rules of ``naming`` as column expressions, for catalogs whose names are themselves a table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import naming


def _any(low: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(low, F.lit(p))
    return out


def identity_strength(name: Column, mode: str = "textbook") -> Column:
    """'high', 'moderate' or '': see ``naming.identity``."""
    low = F.lower(name)
    loose = "|".join(naming.MODERATE_PARTS)
    moderate = low.rlike(f"(^|[^a-z0-9])({loose})([^a-z0-9]|$)")
    if mode == "compat":
        moderate = moderate | low.rlike(f"^({loose})|({loose})$")
    return F.when(_any(low, naming.IDENTITY_PARTS), "high").when(moderate, "moderate").otherwise("")


def business_name(name: Column) -> Column:
    low = F.lower(name)
    return ~low.endswith("_id") & _any(low, naming.BUSINESS_WORDS)


def is_child_table(name: Column) -> Column:
    return _any(F.lower(name), naming.CHILD_SUFFIXES)


def is_reserved(name: Column) -> Column:
    return F.upper(name).isin(sorted(naming.RESERVED))


def sanitized(name: Column, reserved_suffix: str = "_col") -> Column:
    """A valid identifier: see ``naming.sanitize``."""
    plain = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_]", "_"), "_+", "_")
    started = F.when(plain.rlike("^[A-Za-z]"), plain).otherwise(F.concat(F.lit("col_"), plain))
    safe = F.when(is_reserved(started), F.concat(started, F.lit(reserved_suffix))).otherwise(started)
    short = F.concat(F.substring(safe, 1, 25), F.lit("_"), F.substring(F.md5(name.cast("binary")), 1, 4))
    return F.when(F.length(safe) <= naming.MAX_IDENTIFIER, safe).otherwise(short)
