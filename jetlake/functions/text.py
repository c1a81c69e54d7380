"""Scalar expressions of the result-table scripts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from jetlake.constants import (CODE_BACKENDS, CODE_LABELS, DEFAULT_SCHEDULE, PREFERRED_CODES,
                               STATIC_SCHEDULE_CODE)


def text_or(value: Column, default) -> Column:
    """The text, or a default where it is NULL or empty."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), default)


def divide_or_null(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b of floating-point values, infinite or NaN for a zero denominator."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a == 0, float("nan"))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def positive_or_null(value: Column, name="time_per_event") -> Column:
    """NULL passes; zero and below is an error."""
    v = value.cast("double")
    bad = F.raise_error(F.concat(F.lit(f"{name} must be positive, got "), v.cast("string")))
    return F.when(v <= 0, bad.cast("double")).otherwise(v)


def one_of(value: Column, allowed, name) -> Column:
    """A value out of a closed list; anything else is an error."""
    bad = F.raise_error(F.concat(F.lit(f"invalid value for {name}: "), value))
    return F.when(value.isNull() | value.isin(*allowed), value).otherwise(bad)


def _lookup(mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def default_backend(code: Column) -> Column:
    return F.coalesce(_lookup(CODE_BACKENDS)[code], F.lit("unknown"))


def schedule_label(code: Column, schedule: Column) -> Column:
    fallback = F.when(code == STATIC_SCHEDULE_CODE, F.lit("static")).otherwise(F.lit(DEFAULT_SCHEDULE))
    return text_or(schedule, fallback)


def code_label(code: Column, labels=None) -> Column:
    return F.coalesce(_lookup(labels or CODE_LABELS)[code], code)


def code_order(code: Column, preferred=PREFERRED_CODES) -> Column:
    """1-based place in the preferred order; 0 for codes outside it."""
    return F.array_position(F.array(*[F.lit(c) for c in preferred]), code)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """The suffix with its dot, in lower case; empty when there is none."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]*)$", 1))


def unpacked_name(path: Column) -> Column:
    return F.regexp_replace(path, r"\.gz$|\.zst$", "")


def safe_filename(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_"), F.lit("_.-"))


def captured(text: Column, pattern: str, group=1) -> Column:
    """A regex group, NULL when the pattern does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def number_or_null(text: Column) -> Column:
    return text.try_cast("double")


def comma_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def value_label(value: Column, kind: str) -> Column:
    """A value as text; fractions to four digits, half to even."""
    if kind in ("double", "float"):
        return F.bround(value.cast("double"), 4).cast("string")
    return value.cast("string")


def row_label(df, columns, separator=",\n") -> Column:
    """``name=value`` of several columns; input files by their base name."""
    kinds = dict(df.dtypes)
    parts = []
    for c in columns:
        shown = basename(F.col(c)) if c == "input_file" else value_label(F.col(c), kinds[c])
        parts.append(F.concat(F.lit(f"{c}="), F.coalesce(shown, F.lit("missing"))))
    return F.concat_ws(separator, *parts)


def wrap(n: Column, size: int) -> Column:
    """n folded into 1..size."""
    return F.pmod(n - 1, F.lit(size)) + 1


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
