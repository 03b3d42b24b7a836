"""Column expressions shared by the jobs. All stay inside the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditweir import fixed_values as fv


def is_true(condition: Column) -> Column:
    """A comparison with null counts as false."""
    return F.coalesce(condition, F.lit(False))


def to_number(text: Column) -> Column:
    """Text to double; blanks, words, NaN and Java-style suffixes give null."""
    trimmed = F.trim(text)
    # Blanks are common, so they are told apart before the parser fails on them.
    number = F.when(trimmed != "", trimmed.try_cast("double"))
    return F.when(~F.isnan(number) & ~trimmed.rlike(r"[0-9.][dDfF]$"), number)


def clip(value: Column, lower=None, upper=None) -> Column:
    """Bound a value on either side; null stays null."""
    out = value
    if lower is not None:
        out = F.when(out < lower, F.lit(lower).cast("double")).otherwise(out)
    if upper is not None:
        out = F.when(out > upper, F.lit(upper).cast("double")).otherwise(out)
    return out


def whole_number(value: Column, kind: str) -> Column:
    """Round before narrowing, because a bare cast would truncate."""
    return F.rint(value).cast(kind)


def age_band(age: Column) -> Column:
    chain = F.when(age.isNull(), fv.UNKNOWN_BAND)
    for label, lower, upper in fv.AGE_BANDS:
        chain = chain.when((age >= lower) & (age < upper), label)
    return chain


def dependents_band(count: Column) -> Column:
    return (
        F.when(count.isNull(), fv.UNKNOWN_BAND)
        .when(count.isin(0, 1, 2), count.cast("int").cast("string"))
        .otherwise("3+")
    )


def date_key(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd").cast("int")


def dataset_split(applicant_id: Column) -> Column:
    """Stable split from the md5 of the id's decimal text."""
    digest = F.md5(applicant_id.cast("string"))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100
    chain = None
    for bound, name in fv.SPLIT_BUCKETS:
        test = bucket < bound
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain


def total_late_events() -> Column:
    """Sum of the three late counters, null counted as zero."""
    total = F.lit(0)
    for name in fv.LATE_COUNTERS:
        total = total + F.coalesce(F.col(name), F.lit(0))
    return total.cast("int")


NO_BUCKET = "revolving_utilisation has no bucket: null or below range"


def has_no_bucket(utilisation: Column) -> Column:
    return is_true(utilisation <= fv.UTILISATION_BUCKET_FLOOR) | utilisation.isNull()


def utilisation_bucket(utilisation: Column, strict: bool = True) -> Column:
    """Right-closed buckets 0..4; null or below the floor is an error or, if not ``strict``, null."""
    none = F.raise_error(F.lit(NO_BUCKET)) if strict else F.lit(None)
    chain = F.when(has_no_bucket(utilisation), none.cast("int"))
    for number, end in enumerate(fv.UTILISATION_BUCKET_ENDS):
        chain = chain.when(utilisation <= end, number)
    return chain.otherwise(len(fv.UTILISATION_BUCKET_ENDS))


def risk_band(probability: Column) -> Column:
    chain = None
    for bound, name in fv.RISK_BANDS:
        test = probability < bound
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain.otherwise(fv.TOP_RISK_BAND)


def predicted_class(probability: Column, threshold=fv.DECISION_THRESHOLD) -> Column:
    return (probability >= threshold).cast("int")


def drift_status(psi: Column, warn=fv.DRIFT_WARN, alert=fv.DRIFT_ALERT) -> Column:
    return F.when(psi >= alert, "ALERT").when(psi >= warn, "WARN").otherwise("OK")


def json_number(value: Column) -> Column:
    """NaN and infinities have no JSON form and become null."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)

