"""Scalar column expressions (string, math, cast, null, conditional, array).

All helpers build Catalyst expressions, so they stay inside whole-stage
codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip_lower(c: str | Column, lower: float = 0) -> Column:
    """``x < lower -> lower``; null stays null (``greatest`` would turn it into ``lower``)."""
    c = col_of(c)
    return F.when(c < F.lit(lower), F.lit(lower)).otherwise(c)


def clip_upper(c: str | Column, upper: float) -> Column:
    """``x > upper -> upper``; null stays null."""
    c = col_of(c)
    return F.when(c > F.lit(upper), F.lit(upper)).otherwise(c)


def coerce_int(c: str | Column) -> Column:
    """Lenient numeric coercion to int: text that is not a number -> null.

    Goes through double first so that ``'90001.0'`` becomes 90001 (a direct
    ``try_cast(... AS int)`` gives null for it under ANSI mode).
    """
    return col_of(c).cast("string").try_cast("double").try_cast("int")


def coerce_key_text(c: str | Column) -> Column:
    """Numeric-looking key -> canonical integer text (``'90001.0'`` -> ``'90001'``)."""
    return coerce_int(c).cast("string")


def year_from_text(c: str | Column) -> Column:
    """First four characters of a ``YYYY-MM`` text as int; bad text -> null."""
    return F.substring(col_of(c).cast("string"), 1, 4).try_cast("double").try_cast("int")


def round_half_even(c: str | Column, scale: int) -> Column:
    """Python/numpy rounding (banker's); ``F.round`` is half-up."""
    return F.bround(col_of(c), scale)


def lookup(c: str | Column, mapping: Mapping, default: Column | None = None) -> Column:
    """Map a code to a label through a literal map; unmatched -> ``default`` (null)."""
    if not mapping:
        return F.lit(None) if default is None else default
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    out = F.try_element_at(m, col_of(c))
    return out if default is None else F.coalesce(out, default)


def abbreviate_list(arr: str | Column, mapping: Mapping, sep: str = "; ") -> Column:
    """Replace each list item by its short name when one exists, join with ``sep``."""
    if mapping:
        m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
        items = F.transform(col_of(arr), lambda x: F.coalesce(F.try_element_at(m, x), x))
    else:
        items = col_of(arr)
    return F.array_join(items, sep)


def leading_code(c: str | Column, pattern: str = "^([A-D])") -> Column:
    """First regex group, null when the pattern does not match (pandas ``str.extract``)."""
    return F.nullif(F.regexp_extract(col_of(c), pattern, 1), F.lit(""))


def sorted_union(a: str | Column, b: str | Column) -> Column:
    """U4: sorted union of two arrays, duplicates removed."""
    return F.array_sort(F.array_union(col_of(a), col_of(b)))


def fixed_width(c: str | Column, width: int, align: str = "left") -> Column:
    """Pad (or cut) text to ``width`` characters for printed tables."""
    text = col_of(c).cast("string")
    return F.rpad(text, width, " ") if align == "left" else F.lpad(text, width, " ")


def number_text(c: str | Column, decimals: int) -> Column:
    """Number with thousands separators and fixed decimals (``1,234.57``)."""
    return F.format_number(col_of(c), decimals)


def utc_stamp() -> Column:
    """Run timestamp as ``YYYY-MM-DDTHH:MM:SSZ`` (session time zone is UTC)."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
