"""Column-level helpers; every one returns a Spark ``Column`` (JVM side)."""

from cindergrid.functions.scalars import (  # noqa: F401
    abbreviate_list,
    clip_lower,
    clip_upper,
    coerce_int,
    coerce_key_text,
    col_of,
    leading_code,
    lookup,
    round_half_even,
    fixed_width,
    number_text,
    sorted_union,
    utc_stamp,
    year_from_text,
)
