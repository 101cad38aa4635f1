"""Column expressions shared by the operators. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words accepted as explicit booleans.
TRUE_WORDS = ["true", "t", "yes", "y", "1"]
FALSE_WORDS = ["false", "f", "no", "n", "0"]

PROBLEM_WORDS = "problematic|contaminated|misidentified"


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log2p1(c: str | Column) -> Column:
    return F.log2(as_col(c) + F.lit(1.0))


def log1p(c: str | Column) -> Column:
    return F.log1p(as_col(c))


def finite(c: str | Column) -> Column:
    """A double when the text or number is finite; booleans, NaN, infinities and words become null."""
    c = as_col(c)
    text = F.lower(F.trim(c.cast("string")))
    number = text.try_cast("double")
    return F.when(text.isin("true", "false"), None).when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)


def explicit_bool(c: str | Column) -> Column:
    """Only known true/false words count; anything else is unknown (null)."""
    word = F.lower(F.trim(as_col(c).cast("string")))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def explicit_true(c: str | Column) -> Column:
    return F.coalesce(explicit_bool(c), F.lit(False))


def null_if_not_finite(c: str | Column) -> Column:
    c = as_col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def formula_guard(c: str | Column) -> Column:
    """Prefix cells that a spreadsheet would run as a formula."""
    c = as_col(c)
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def hash_uniform(*parts: str | Column | int) -> Column:
    """A uniform number in (0, 1) that depends only on the given values.

    The same draw comes out on any partitioning and after any retry, which a generator seeded
    per partition cannot promise.
    """
    cols = [F.lit(str(p)) if isinstance(p, int) else as_col(p).cast("string") for p in parts]
    head = F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 8), 16, 10).cast("double")
    return (head + 0.5) / F.lit(4294967296.0)


def ramp(y: Column, low: Column, target: Column, role: Column, exponent: float = 1.0) -> Column:
    """Desirability of ``y`` between a floor and a target; null where the ends do not separate."""
    fraction = F.least(F.greatest(F.try_divide(y - low, target - low), F.lit(0.0)), F.lit(1.0))
    if exponent != 1.0:
        fraction = F.pow(fraction, F.lit(exponent))
    return F.when(y.isNotNull() & (target > low), F.when(role == "exclusion", F.lit(1.0) - fraction).otherwise(fraction))


def flip_role(role: Column) -> Column:
    return F.when(role == "inclusion", F.lit("exclusion")).otherwise(F.lit("inclusion"))


def sign(c: Column) -> Column:
    return F.when(c > 0, 1).when(c < 0, -1).otherwise(0)


def clean_key(c: str | Column) -> Column:
    """Lower-cased, trimmed text with runs of blanks collapsed."""
    return F.regexp_replace(F.lower(F.trim(as_col(c))), r"\s+", " ")
