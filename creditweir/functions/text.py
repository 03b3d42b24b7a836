"""Number and JSON text helpers for the report jobs."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditweir import fixed_values as fv


def plain_decimal(value: Column) -> Column:
    """A 4-digit rounded number as plain text: no exponent, no padding zeros.

    One decimal is always kept, so 2 reads ``2.0``.
    """
    text = F.round(value, 4).cast("decimal(38,4)").cast("string")
    # The bar marks the end, so that a point left there gets its zero back.
    ended = F.concat(F.rtrim(text, F.lit("0")), F.lit("|"))
    return F.rtrim(F.replace(ended, F.lit(".|"), F.lit(".0")), F.lit("|"))


def strip_fences(raw: Column) -> Column:
    """The reply without outer blanks and, if it opens with ``` or ```json, without its fence."""
    fenced = F.regexp_extract(raw, r"(?s)\A\s*```(?:json)?\s*(.*?)\s*(?:```)?\s*\z", 1)
    plain = F.btrim(raw, F.lit(" \t\n\x0b\f\r"))  # as \s
    return F.when(raw.rlike(r"\A\s*```"), fenced).otherwise(plain)


def numbers_in(text: Column) -> Column:
    """Every number written in ``text``, as decimals so that 0.50 equals 0.5.

    A number beyond 26 digits before the point or 12 decimals is null: it can't be told
    from its neighbours, so an audit must not accept it.
    """
    found = F.regexp_extract_all(text, F.lit(fv.NUMBER_PATTERN), F.lit(0))
    return F.transform(found, lambda n: F.when(~n.rlike(r"\.\d{12}0*[1-9]"), n.try_cast("decimal(38,12)")))
