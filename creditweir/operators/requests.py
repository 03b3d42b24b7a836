"""Scoring-request tables: header aliases, validation, derived total."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweir import fixed_values as fv
from creditweir.functions.columns import total_late_events


def resolve_aliases(requests: DataFrame) -> DataFrame:
    """Either spelling of a field is accepted; the business name wins."""
    present = set(requests.columns)
    others = [c for c in requests.columns if c not in fv.REQUEST_ALIASES and c not in fv.REQUEST_ALIASES.values()]
    fields = []
    for name, header in fv.REQUEST_ALIASES.items():
        spellings = [F.col(f"`{c}`").try_cast("double") for c in dict.fromkeys((name, header)) if c in present]
        value = F.coalesce(*spellings) if spellings else F.lit(None).cast("double")
        fields.append(value.alias(name))
    return requests.select(*others, *fields)


def request_errors():
    """Array of error texts for one request row; empty when it is valid."""
    checks = []
    for name, low, high, nullable, integer in fv.REQUEST_RULES:
        value = F.col(name)
        if not nullable:
            checks.append(F.when(value.isNull(), f"{name}: required"))
        checks.append(F.when(value < low, f"{name}: below {low}"))
        if high != math.inf:
            checks.append(F.when(value > high, f"{name}: above {high}"))
        if integer:
            checks.append(F.when(value != F.rint(value), f"{name}: not a whole number"))
        if name in fv.LATE_COUNTERS:
            checks.append(F.when(value.isin(*fv.SENTINEL_CODES), f"{name}: sentinel code"))
    return F.filter(F.array(*checks), lambda text: text.isNotNull())


def unreadable_fields(requests: DataFrame):
    """Array of the names of fields whose text, in the spelling that counts, is no number."""
    kinds = dict(requests.dtypes)
    bad = []
    for name, header in fv.REQUEST_ALIASES.items():
        for spelling in dict.fromkeys((name, header)):
            if kinds.get(spelling) == "string":
                text = F.col(f"`{spelling}`")
                bad.append(F.when(text.isNotNull() & text.try_cast("double").isNull(), name))
    return F.array_distinct(F.array_compact(F.array(*bad))) if bad else F.array().cast("array<string>")


def validate(requests: DataFrame) -> DataFrame:
    """Requests under business names with an ``errors`` array.

    A text that is no number is an error of its row, in either spelling; it is not reported as missing too.
    """
    resolved = resolve_aliases(requests.withColumn("errors", unreadable_fields(requests)))
    told = F.transform("errors", lambda name: F.concat(name, F.lit(": not a number")))
    missing = F.transform("errors", lambda name: F.concat(name, F.lit(": required")))
    return resolved.withColumn("errors", F.concat(told, F.array_except(request_errors(), missing)))


def accepted(validated: DataFrame) -> DataFrame:
    """Valid requests with the derived total the model needs."""
    valid = validated.filter(F.size("errors") == 0).drop("errors")
    return valid.withColumn("total_delinquency_events", total_late_events())


def rejected(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("errors") > 0)
