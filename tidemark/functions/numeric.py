"""Column functions over vectors, rounding, time and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays; fails when their sizes differ."""
    checked = F.when(
        F.size(a) != F.size(b),
        F.raise_error(
            F.concat(
                F.lit("vector sizes differ: "),
                F.size(a).cast("string"),
                F.lit(" and "),
                F.size(b).cast("string"),
            )
        ),
    ).otherwise(a)
    products = F.zip_with(checked, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(
        F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def l2_normalize(v: Column) -> Column:
    """The vector scaled to length one; a zero vector is returned unchanged.

    The norm is bound once with an outer ``transform`` over a one-element array: inlined in the
    inner lambda it would be recomputed per element.
    """
    scaled = F.transform(
        F.array(l2_norm(v)),
        lambda n: F.transform(
            v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))
        ),
    )
    return F.element_at(scaled, 1)


def half_even(value: Column) -> Column:
    """Nearest whole number, ties to even."""
    return F.bround(value, 0)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, for timestamps with or without zone (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def fingerprint(*fields: Column) -> Column:
    """SHA-256 of the fields, each length-prefixed, so null differs from '' and no text collides."""
    parts = [
        F.coalesce(
            F.concat(F.length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")),
            F.lit("null"),
        )
        for f in fields
    ]
    return F.sha2(F.concat_ws("|", *parts), 256)


def first_reason(*conditions: tuple[Column, str]) -> Column:
    """Array of the reason codes whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(reason)) for c, reason in conditions]))
