"""Normalisation of loosely typed log fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings read as booleans.
TRUE_WORDS = ["true", "1", "yes", "y"]
FALSE_WORDS = ["false", "0", "no", "n"]
# end of fixed values


def strip(x: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def loose_bool_text(x: Column) -> Column:
    word = F.lower(strip(x))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def loose_bool_number(x: Column) -> Column:
    return F.when(x == 1, True).when(x == 0, False)


def loose_bool_variant(doc: Column, field: str) -> Column:
    """Boolean from a JSON field: number 1.0 counts as true, the text "1.0" does not."""
    value = F.try_variant_get(doc, f"$.{field}", "string")
    kind = F.schema_of_variant(F.try_variant_get(doc, f"$.{field}", "variant"))
    as_number = loose_bool_number(value.try_cast("double"))
    return (F.when(kind == "BOOLEAN", value.try_cast("boolean"))
            .when(kind == "STRING", loose_bool_text(value))
            .when(kind.isin("VOID", "NULL"), F.lit(None).cast("boolean"))
            .otherwise(as_number))


def loose_double(x: Column) -> Column:
    return x.try_cast("double")


def loose_ts(x: Column) -> Column:
    return F.try_to_timestamp(x)


def loose_text(x: Column) -> Column:
    return strip(F.coalesce(x, F.lit("")))
