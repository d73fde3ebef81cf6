"""Money as integer paise: column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.config import MAX_ABS_PAISE


def rupee_text_to_paise(text: Column) -> Column:
    """Rupee text to paise: currency sign, commas and blanks dropped, ``(1,200)`` negative.

    Text that is not a number counts as zero.
    """
    bare = F.regexp_replace(text, r"[₹,\s]", "")
    signed = F.regexp_replace(bare, r"^\((.*)\)$", "-$1")
    return F.coalesce(
        F.round(signed.try_cast("decimal(24,6)") * 100).cast("bigint"), F.lit(0).cast("bigint")
    )


def paise_text(text: Column) -> Column:
    """Text already in paise; anything unreadable counts as zero."""
    return F.coalesce(F.round(text.try_cast("decimal(24,6)")).cast("bigint"), F.lit(0).cast("bigint"))


def float_rupees_to_paise(value: Column) -> Column:
    """Floating rupees to the nearest paisa, halves away from zero."""
    return F.round(value.cast("decimal(20,6)") * 100).cast("bigint")


def paise_to_rupees(paise: Column) -> Column:
    return (paise.cast("decimal(20,2)") / 100).cast("decimal(20,2)")


def exact_rupees_to_paise(text: Column) -> Column:
    """Exact conversion: null where the text is no number or finer than a paisa."""
    scaled = text.try_cast("decimal(30,8)") * 100
    return F.when(scaled == F.floor(scaled), scaled.cast("bigint"))


def money_problem(text: Column) -> Column:
    """Why a rupee text is refused, or null when it is acceptable."""
    number = text.try_cast("decimal(30,8)")
    scaled = number * 100
    return (
        F.when(number.isNull(), "not_a_finite_number")
        .when(scaled != F.floor(scaled), "finer_than_a_paisa")
        .when(F.abs(scaled) > MAX_ABS_PAISE, "beyond_the_sanity_limit")
    )


def amount_digits(paise: Column) -> Column:
    """The digits of ``format_inr``, without its grouping: at least one of rupees, always two of paise."""
    size = F.abs(paise.cast("bigint"))
    return F.when(size < 100, F.lpad(size.cast("string"), 3, "0")).otherwise(size.cast("string"))


def format_inr(paise: Column) -> Column:
    """Rupees with Indian 2-2-3 digit grouping, for example ₹1,23,456.78."""
    size = F.abs(paise.cast("bigint"))
    whole = size - F.pmod(size, F.lit(100))
    rupees = F.regexp_replace(whole.cast("string"), r"..$", "")
    rupees = F.when(rupees == "", "0").otherwise(rupees)
    grouped = F.regexp_replace(rupees, r"(\d)(?=(\d\d)+\d$)", "$1,")
    cents = F.lpad(F.pmod(size, F.lit(100)).cast("string"), 2, "0")
    return F.concat(F.when(paise < 0, "-").otherwise(""), F.lit("₹"), grouped, F.lit("."), cents)
