"""Scalar column functions: paths, null-safe predicates, safe arithmetic.

Predicates are two-valued: a null operand gives false, never null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """Filename without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(filename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Lower-cased suffix with its dot, or an empty string."""
    return F.lower(F.regexp_extract(filename(path), r"(?<=.)(\.[^.]*)$", 1))


def bare_extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the path, null without a dot."""
    return F.when(F.instr(path, ".") > 0, F.lower(F.substring_index(path, ".", -1)))


def plain_path(path: Column) -> Column:
    """Path whose ``file:`` scheme, in any of its spellings, is left out."""
    return F.regexp_replace(path, "^file:/+", "/")


def normalized_path(path: Column) -> Column:
    """Path without empty and ``.`` parts; a scheme and a leading slash stay. Paths without such parts are only looked at."""
    scheme = F.regexp_extract(path, r"^[A-Za-z][A-Za-z0-9+.-]*:/*", 0)
    rest = F.substring(path, F.length(scheme) + 1, F.length(path))
    root = F.when(rest.startswith("/"), "/").otherwise("")
    parts = F.filter(F.split(rest, "/"), lambda x: (x != "") & (x != "."))
    return F.when(path.rlike(r"//|/\.(?:/|$)|^\./|.+/$"), F.concat(scheme, root, F.array_join(parts, "/"))).otherwise(path)


def resolved_path(path: Column) -> Column:
    """Normalised path whose ``..`` parts are undone with the part before them."""
    clean = normalized_path(path)
    scheme = F.regexp_extract(clean, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:/*|/)", 0)
    parts = F.split(F.substring(clean, F.length(scheme) + 1, F.length(clean)), "/")
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        parts, none, lambda got, x: F.when(x == "..", F.slice(got, 1, F.greatest(F.size(got) - 1, F.lit(0)))).otherwise(F.array_append(got, x))
    )
    return F.when(clean.rlike(r"(?:^|/)\.\.(?:/|$)"), F.concat(scheme, F.array_join(kept, "/"))).otherwise(clean)


def has_extension(path: Column, extensions: tuple[str, ...]) -> Column:
    return F.coalesce(extension(path).isin(*extensions), F.lit(False))


def normalized_class_name(name: Column) -> Column:
    return F.translate(F.lower(F.trim(name)), "- ", "__")


def as_array(value: Column, is_array: bool) -> Column:
    """An array as it is, anything else as an array of one; null as an empty one."""
    listed = value if is_array else F.when(value.isNotNull(), F.array(value))
    return F.coalesce(listed, F.array())


def field_or(struct: Column, names: list[str], name: str, default=None) -> Column:
    """A field of a struct with the fields ``names``, or a default where it lacks the field or is null."""
    return F.coalesce(struct[name], F.lit(default)) if name in names else F.lit(default)


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)))


def percentage(part: Column, total: Column) -> Column:
    return safe_divide(part * 100.0, total)


def is_true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def is_positive(value: Column) -> Column:
    return is_true(value > 0)


def is_non_negative(value: Column) -> Column:
    return is_true(value >= 0)


def is_between(value: Column, low, high) -> Column:
    return is_true(value.between(low, high))


def is_normalized(value: Column) -> Column:
    return is_between(value, 0.0, 1.0)


def is_blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value) == "")


def is_empty(value: Column) -> Column:
    """Null or the empty string; blanks count as a value."""
    return value.isNull() | (value == "")


def valid_size(width: Column, height: Column) -> Column:
    return is_positive(width) & is_positive(height)


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.when(is_true(height == 0) | height.isNull(), F.lit(0.0)).otherwise(width / F.nullif(height, F.lit(0)))


def grade(index: Column) -> Column:
    """Letter grade of a quality index between 0 and 100."""
    bounds = ((60, "D"), (70, "C"), (80, "B"), (90, "A"), (95, "A+"))
    out = F.lit("F")
    for least, letter in bounds:
        out = F.when(index >= least, letter).otherwise(out)
    return out


def clamp(value: Column, low, high) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


# Steps of ``uniform``, within 64-bit integers.
_MODULUS = 1 << 31
_STEP, _SHIFT = 1103515245, 12345
_MIX = ((15, 739982445), (12, 695872825))


def uniform(seed: int, *keys: Column) -> Column:
    """A repeatable number in [0, 1) from integer keys.

    A linear congruential step takes up each key; shifts and products then mix the bits,
    so neighbouring seeds and keys give unrelated numbers. All stays within 64-bit
    integers, so any SQL engine can repeat it.
    """
    state = F.lit(seed % _MODULUS).cast("long")
    for key in keys:
        key = F.pmod(key.cast("long"), F.lit(_MODULUS))
        state = F.pmod((state + key) * F.lit(_STEP) + F.lit(_SHIFT), F.lit(_MODULUS))
    for shift, factor in _MIX:
        state = F.pmod(state.bitwiseXOR(F.shiftright(state, shift)) * F.lit(factor), F.lit(_MODULUS))
    return state.bitwiseXOR(F.shiftright(state, 15)) / F.lit(float(_MODULUS))


def value_range(value: Column) -> Column:
    """A non-decreasing whole number of a numeric value: its power of two and the seven bits after it.

    Each power of two is dealt to 128 ranges, so consecutive numbers, hashes and prices
    alike spread over many ranges without a look at the data. Null stays null.
    """
    v = value.cast("double")
    size = F.abs(v)
    power = F.floor(F.log2(size))
    place = F.floor(size / F.pow(F.lit(2.0), power - 7))
    ranged = (power + 1100) * 1024 + place
    return F.when(v > 0, ranged).when(v < 0, -ranged).when(v == 0, F.lit(0).cast("long"))
