"""Audit of written reports against the payload they were written from."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditweir import fixed_values as fv
from creditweir.functions.text import numbers_in, strip_fences

REPORT_TYPE = (
    "struct<summary string, "
    "key_risk_factors array<struct<factor string, observation string, reason_code string>>, "
    "mitigating_factors array<struct<factor string, observation string>>, "
    "data_quality_notes array<string>, recommended_checks array<string>, confidence string>"
)
NUMBER = "decimal(38,12)"


def parse_reports(rows: DataFrame, raw: str = "reply") -> DataFrame:
    """Add ``reply_json``, the VARIANT of a JSON reply, fenced or not, and ``report``, its fields as columns.

    Each reply is parsed once: Spark keeps a projection whose column is used more than once.
    Both are null for a reply that is no JSON object or names a key twice. A field of
    another type is null in ``report`` or, where a text is asked for, written as text.
    """
    parsed = rows.withColumn("reply_json", F.try_parse_json(strip_fences(F.col(raw))))
    return parsed.withColumn("report", F.try_variant_get("reply_json", "$", REPORT_TYPE))


def _is_text(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def _wrong_list(json: Column, name: str, sound) -> Column:
    """A list that is present but null, no list, or has an element that is not ``sound``."""
    given = F.try_variant_get(json, f"$.{name}", "variant").isNotNull()
    elements = F.try_variant_get(json, f"$.{name}", "array<variant>")
    return given & (elements.isNull() | F.exists(elements, lambda e: ~sound(e)))


def type_problems(parsed: str = "reply_json") -> Column:
    """Texts for values whose JSON type is not the one asked for; the columns of ``report`` hide them."""
    json = F.col(parsed)

    def texts(*names):
        def sound(element):
            parts = [_is_text(F.try_variant_get(element, f"$.{n}", "variant")) for n in names]
            return reduce(lambda a, b: a & b, parts)

        return sound

    summary = F.try_variant_get(json, "$.summary", "variant")
    found = [
        F.when(summary.isNotNull() & ~_is_text(summary), "summary not a text"),
        F.when(_wrong_list(json, "key_risk_factors", texts("factor", "observation", "reason_code")), "key_risk_factors not texts"),
        F.when(_wrong_list(json, "mitigating_factors", texts("factor", "observation")), "mitigating_factors not texts"),
        F.when(_wrong_list(json, "data_quality_notes", _is_text), "data_quality_notes not texts"),
        F.when(_wrong_list(json, "recommended_checks", _is_text), "recommended_checks not texts"),
    ]
    return F.array_compact(F.array(*found))


def _empty_if_null(column: str, element: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast(f"array<{element}>"))


def schema_problems(report: str = "report") -> Column:
    """Texts for every way in which the parsed report breaks its schema."""
    factors = F.col(f"{report}.key_risk_factors")
    lacking = F.exists(
        factors, lambda f: f["factor"].isNull() | f["observation"].isNull() | f["reason_code"].isNull()
    )
    mitigating = F.exists(
        _empty_if_null(f"{report}.mitigating_factors", "struct<factor:string,observation:string>"),
        lambda f: f["factor"].isNull() | f["observation"].isNull(),
    )
    broken = F.col(report).isNull()
    inner = [
        F.when(F.col(f"{report}.summary").isNull(), "summary missing"),
        F.when(factors.isNull(), "key_risk_factors missing"),
        F.when(~F.size(factors).between(1, fv.MAX_RISK_FACTORS), "key_risk_factors not 1 to 5"),
        F.when(lacking, "key_risk_factors incomplete"),
        F.when(mitigating, "mitigating_factors incomplete"),
        F.when(
            F.coalesce(~F.col(f"{report}.confidence").isin(*fv.CONFIDENCE_LEVELS), F.lit(True)),
            "confidence not in set",
        ),
    ]
    listed = F.filter(F.array(*inner), lambda text: text.isNotNull())
    return F.when(broken, F.array(F.lit("not valid JSON"))).otherwise(listed)


def fabricated_codes(report: str = "report", payload: str = "payload") -> Column:
    """Reason codes used in the report but not supplied by the payload."""
    used = F.transform(F.col(f"{report}.key_risk_factors"), lambda f: f["reason_code"])
    supplied = F.filter(
        F.transform(F.col(f"{payload}.contributions"), lambda c: c["reason_code"]), lambda c: c.isNotNull()
    )
    return F.array_sort(F.array_except(used, supplied))


def _forms(value: Column) -> Column:
    """The ways a payload number may be quoted, as decimals.

    Its magnitude, rounded to 2 or 1 places, and as a percentage with 2, 1 or no
    places (the last one truncated).
    """
    size = F.abs(value)
    percent = size * 100
    forms = [size, F.round(size, 2), F.round(size, 1), F.round(percent, 2), F.round(percent, 1), F.floor(percent)]
    return F.array(*[f.cast(NUMBER) for f in forms])


def _numbers_in_all(texts: Column) -> Column:
    """The numbers of all texts, found in one search: none goes on across a line break. A null has none."""
    return numbers_in(F.array_join(texts, "\n", ""))


def payload_numbers(payload: str = "payload") -> Column:
    """Every number a report on this payload may contain, some of them more than once."""
    contributions = F.col(f"{payload}.contributions")
    values = F.concat(
        F.array(
            F.col(f"{payload}.prediction.probability_of_default"),
            F.col(f"{payload}.prediction.threshold"),
            F.col(f"{payload}.population_baseline.average_probability_of_default"),
        ),
        F.transform(contributions, lambda c: c["value"]),
        F.transform(contributions, lambda c: c["contribution"]),
    )
    # A whole number has two forms only, itself and as a percentage.
    ranks = F.transform(contributions, lambda c: F.array(c["rank"].cast(NUMBER), (c["rank"] * 100).cast(NUMBER)))
    texts = F.concat(
        F.array(
            F.col(f"{payload}.request_id"),
            F.col(f"{payload}.model.pipeline"),
            F.col(f"{payload}.model.version"),
            F.col(f"{payload}.model.algorithm"),
            F.col(f"{payload}.prediction.risk_band"),
        ),
        F.transform(contributions, lambda c: c["factor"]),
        F.transform(contributions, lambda c: c["direction"]),
        F.transform(contributions, lambda c: F.coalesce(c["reason_code"], F.lit(""))),
    )
    quoted = F.flatten(F.concat(F.transform(values, _forms), ranks))
    incidental = F.array(*[F.lit(n).cast(NUMBER) for n in fv.INCIDENTAL_NUMBERS])
    # A null stands for a number too long to compare; none may cover for one in the report.
    return F.array_compact(F.concat(quoted, _numbers_in_all(texts), incidental))


def report_numbers(report: str = "report") -> Column:
    """Every number written in the five narrative fields."""
    texts = F.concat(
        F.array(F.coalesce(F.col(f"{report}.summary"), F.lit(""))),
        F.transform(F.col(f"{report}.key_risk_factors"), lambda f: f["observation"]),
        F.transform(
            _empty_if_null(f"{report}.mitigating_factors", "struct<factor:string,observation:string>"),
            lambda f: f["observation"],
        ),
        _empty_if_null(f"{report}.data_quality_notes", "string"),
        _empty_if_null(f"{report}.recommended_checks", "string"),
    )
    return _numbers_in_all(texts)


def _without(numbers: Column, known: Column) -> Column:
    """``array_except`` of numbers, by their texts: at one scale equal numbers read alike, and texts are far quicker to hash."""
    return F.array_except(numbers.cast("array<string>"), known.cast("array<string>")).cast(f"array<{NUMBER}>")


def audit(rows: DataFrame, reply: str = "reply", payload: str = "payload") -> DataFrame:
    """Add ``problems``, ``fabricated``, ``unsupported`` and ``is_valid``.

    A reply that breaks the schema is not checked further. Types are looked at only
    where the fields are there.
    """
    parsed = parse_reports(rows, reply).withColumn("problems", schema_problems())
    typed = F.when(F.size("problems") == 0, type_problems()).otherwise(F.col("problems"))
    parsed = parsed.withColumn("problems", typed).drop("reply_json")
    sound = F.size("problems") == 0
    none_text = F.array().cast("array<string>")
    none_number = F.array().cast(f"array<{NUMBER}>")
    checked = parsed.select(
        "*",
        F.when(sound, fabricated_codes(payload=payload)).otherwise(none_text).alias("fabricated"),
        F.when(sound, _without(report_numbers(), payload_numbers(payload)))
        .otherwise(none_number)
        .alias("unsupported"),
    )
    clean = reduce(lambda a, b: a & b, [F.size(c) == 0 for c in ("problems", "fabricated", "unsupported")])
    return checked.withColumn("is_valid", clean)


def outcome(enabled: Column) -> Column:
    """ok, fallback or disabled for an audited row; no reply is a fallback."""
    return (
        F.when(~enabled, "disabled").when(F.coalesce(F.col("is_valid"), F.lit(False)), "ok").otherwise("fallback")
    )


def final_report(enabled: Column, template: Column) -> Column:
    """The report a reader gets for an audited row: the written one if it is valid, else the template.

    ``llm_status`` tells which: ok, fallback or disabled.
    """
    status = outcome(enabled)
    lists = {
        "mitigating_factors": "struct<factor:string,observation:string>",
        "data_quality_notes": "string",
        "recommended_checks": "string",
    }
    written = F.struct(
        F.col("report.summary").alias("summary"),
        F.col("report.key_risk_factors").alias("key_risk_factors"),
        *[_empty_if_null(f"report.{name}", kind).alias(name) for name, kind in lists.items()],
        F.col("report.confidence").alias("confidence"),
        status.alias("llm_status"),
    )
    return F.when(status == "ok", written).otherwise(template.withField("llm_status", status))
