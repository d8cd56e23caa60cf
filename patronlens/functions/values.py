"""Number, key and text helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens.fixed_values import NULL_KEY_PART, WHITE_SPACE

def whole_number(df: DataFrame, name: str) -> Column:
    """Text or number column to LONG, rounding half away from zero; garbage is an error."""
    value = F.col(name)
    if dict(df.dtypes)[name] != "double":
        return F.round(value.cast("decimal(38,6)")).cast("long")
    # the same in plain arithmetic: the fraction of a double is exact
    whole = value.cast("long")
    return F.when(F.abs(value - whole) >= 0.5, whole + F.signum(value).cast("long")).otherwise(whole)


def exact_sum(value: Column) -> Column:
    """Sum of a double column that does not depend on the order of the rows.

    Adding in decimal makes a recomputed task give bit-identical totals.
    """
    return F.sum(value.cast("decimal(20,6)")).cast("double")


def exact_mean(value: Column) -> Column:
    """Mean of probabilities, added in decimal with 18 places."""
    total = F.sum(value.cast("decimal(28,18)")).cast("double")
    return F.when(F.count(value) > 0, total / F.count(value))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division; NULL where the denominator is zero."""
    return F.when(denominator != 0, numerator.cast("double") / denominator)


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def surrogate_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("-", *[F.coalesce(p.cast("string"), F.lit(NULL_KEY_PART)) for p in parts]))


def stripped(text: Column) -> Column:
    """Text without surrounding white space of any kind, that of other scripts included."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def title_case(text: Column) -> Column:
    """Upper-case every letter that follows a non-letter, as in ``180D``."""
    pieces = F.split(text, r"(?<=\P{L})|(?=\P{L})")
    return F.array_join(F.transform(pieces, F.initcap), "")


def pretty_name(name: Column) -> Column:
    return title_case(F.replace(name, F.lit("_"), F.lit(" ")))


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])
