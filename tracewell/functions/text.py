"""Text forms of values, labels and case folding."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, functions as F


def scientific_text(v: Column) -> Column:
    """Shortest ``d.ddde±xx`` text of values below 1e-3 or from 1e7 on; NULL for all others.

    In between, the engine's own number text is already the shortest positional one. Its text
    of large numbers can carry needless digits, so there fewer digits are tried first.
    """
    digits15, digits16, digits17 = (F.format_string(f"%.{n}e", v) for n in (14, 15, 16))
    size = F.abs(v)
    return (
        F.when((size == 0) | (size >= 1e-3) & (size < 1e7), F.lit(None).cast("string"))
        .when(size < 1e-3, F.lower(v.cast("string")))
        .when(digits15.try_cast("double") == v, digits15)
        .when(digits16.try_cast("double") == v, digits16)
        .otherwise(digits17)
    )


def scientific_digits(scientific: Column) -> Column:
    """Significant digits of :func:`scientific_text`, at least one."""
    mantissa = F.substring_index(scientific, "e", 1)
    kept = F.rtrim(F.translate(mantissa, "-.", ""), F.lit("0"))
    return F.when(kept == "", F.lit("0")).otherwise(kept)


def scientific_exponent(scientific: Column) -> Column:
    return F.substring_index(scientific, "e", -1).try_cast("int")


def float_text(v: Column, digits: Column, exponent: Column) -> Column:
    """Positional text from 1e-4 up to 1e16, ``1e+16`` / ``1e-05`` beyond; NULL stays NULL."""
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))
    whole_len = exponent + 1
    at_or_above_one = F.when(
        F.length(digits) <= whole_len, F.concat(F.rpad(digits, whole_len, F.lit("0")), F.lit(".0"))
    ).otherwise(
        F.concat(
            F.substring(digits, F.lit(1), whole_len),
            F.lit("."),
            F.substring(digits, whole_len + 1, F.length(digits)),
        )
    )
    below_one = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    fraction = F.substring(digits, F.lit(2), F.length(digits))
    scientific = F.concat(
        F.substring(digits, 1, 1),
        F.when(fraction == "", F.lit("")).otherwise(F.concat(F.lit("."), fraction)),
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.format_string("%02d", F.abs(exponent)),
    )
    return (
        F.when(F.isnan(v), F.lit("nan"))
        .when(v == float("inf"), F.lit("inf"))
        .when(v == float("-inf"), F.lit("-inf"))
        .when(exponent.isNull(), v.cast("string"))
        .when((exponent < -4) | (exponent >= 16), F.concat(sign, scientific))
        .when(exponent < 0, F.concat(sign, below_one))
        .otherwise(F.concat(sign, at_or_above_one))
    )


def boolean_text(value: Column) -> Column:
    return F.when(value, F.lit("True")).when(~value, F.lit("False"))


def display_label(name: Column, units: Column) -> Column:
    """``name (units)``, or the bare name when there are no units."""
    return F.when(
        F.coalesce(units, F.lit("")) != "", F.concat(name, F.lit(" ("), units, F.lit(")"))
    ).otherwise(name)


@cache
def _foldings() -> tuple[str, str, dict[str, str]]:
    """Characters whose full Unicode case folding isn't their lower case: to one character, as
    two strings for ``translate``, and to several, as a mapping."""
    found = {}
    for code in range(0x110000):
        char = chr(code)
        if char.casefold() != char.lower():
            found[char] = char.casefold()
    single = {c: f for c, f in found.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in found.items() if len(f) > 1}


def fold_case(text: Column) -> Column:
    """Caseless form for matching by full Unicode case folding, such as ``ss`` for sharp s."""
    ones, folded, several = _foldings()
    low = F.lower(text)  # first, as it turns a last capital sigma into its final form
    long = low
    for char, form in several.items():
        long = F.replace(long, F.lit(char), F.lit(form))
    rare = low.rlike(f"[{''.join(several)}]")
    return F.translate(F.when(rare, long).otherwise(low), ones, folded)
