import json

import pytest
from pyspark.sql import functions as F

from creditweir.functions.text import plain_decimal, strip_fences
from creditweir.operators import audit, reasons

CONTRIBUTION = (
    "array<struct<feature:string, display_name:string, value:double, shap_value:double, direction:string, rank:int>>"
)
ENTRIES = [
    ("revolving_utilisation", "Credit utilisation ratio", 0.95, 0.62, "increases_risk", 1),
    ("times_90_days_late", "Payments 90+ days late", 2.0, 0.41, "increases_risk", 2),
    ("debt_ratio", "Debt-to-income ratio", 0.89, 0.22, "increases_risk", 3),
    ("monthly_income", "Monthly income", 2500.0, -0.13, "decreases_risk", 4),
]
FLAGS = ["monthly_income_imputed", "dependents_missing"]


@pytest.fixture
def explained(spark):
    schema = f"request_id string, p double, contributions {CONTRIBUTION}"
    frame = spark.createDataFrame([("test-request", 0.4213, ENTRIES)], schema)
    flags = F.struct(F.lit(False).alias(FLAGS[0]), F.lit(True).alias(FLAGS[1]))
    payload = reasons.payload(
        F.col("contributions"), F.col("request_id"), F.col("p"), F.lit("very_high"), F.lit(0.5), flags, "credit", "test", "xgboost"
    )
    return frame.withColumn("payload", payload)


def test_payload_holds_only_the_model_output(explained):
    body = json.loads(explained.select(reasons.payload_json("payload")).first()[0])
    assert set(body) == {"request_id", "model", "prediction", "population_baseline", "contributions", "data_quality"}
    assert body["population_baseline"] == {"average_probability_of_default": 0.0668}
    for c in body["contributions"]:
        assert ("reason_code" in c) == (c["direction"] == "increases_risk")
    assert "applicant_id" not in json.dumps(body)


def test_reason_codes_in_rank_order(explained):
    codes = explained.select(reasons.reason_codes(F.col("contributions"))).first()[0]
    assert [(c["code"], c["rank"]) for c in codes] == [("R01", 1), ("R02", 2), ("R03", 3)]


def test_unknown_feature_is_an_error_only_when_strict(explained):
    odd = explained.select(F.transform("contributions", lambda c: c.withField("feature", F.lit("new"))).alias("c"))
    assert [c["code"] for c in odd.select(reasons.reason_codes(F.col("c"), strict=False)).first()[0]] == [None] * 3
    with pytest.raises(Exception, match="no reason code for new"):
        odd.select(reasons.reason_codes(F.col("c"))).collect()
    with pytest.raises(reasons.UnknownFeatureError, match="other"):
        reasons.ranked_contributions(["age", "other"], F.col, F.col)


def test_ranking_by_size_with_ties_in_feature_order(spark):
    names = ["age", "debt_ratio", "monthly_income", "real_estate_loans"]
    frame = spark.createDataFrame([(0.2, -0.5, 0.5, 0.0)], "age double, debt_ratio double, monthly_income double, real_estate_loans double")
    top = frame.select(reasons.ranked_contributions(names, F.col, F.col, top=3)).first()[0]
    assert [(c["feature"], c["rank"], c["direction"]) for c in top] == [
        ("debt_ratio", 1, "decreases_risk"), ("monthly_income", 2, "increases_risk"), ("age", 3, "increases_risk")
    ]


def test_template_report(explained):
    report = explained.select(reasons.template_report("payload", FLAGS, "disabled").alias("r")).first()["r"]
    assert "0.4213" in report["summary"] and "very_high" in report["summary"] and "0.0668" in report["summary"]
    assert [f["reason_code"] for f in report["key_risk_factors"]] == ["R01", "R02", "R03"]
    assert report["key_risk_factors"][1]["observation"] == "Recorded value 2.0; contribution to modelled risk 0.41."
    assert [f["factor"] for f in report["mitigating_factors"]] == ["Monthly income"]
    assert report["data_quality_notes"] == ["Field flagged as imputed or missing: dependents_missing."]
    assert (report["confidence"], report["llm_status"], len(report["recommended_checks"])) == ("low", "disabled", 3)


@pytest.mark.parametrize("value,text", [(2.0, "2.0"), (0.42130, "0.4213"), (1e7, "10000000.0"), (-0.13, "-0.13"), (0.00001, "0.0")])
def test_numbers_as_plain_text(spark, value, text):
    assert spark.range(1).select(plain_decimal(F.lit(value))).first()[0] == text


@pytest.mark.parametrize(
    "raw,text", [("```json\n{}\n```", "{}"), ("```\n{}```", "{}"), (" {} ", "{}"), ("{}", "{}")]
)
def test_fences(spark, raw, text):
    assert spark.createDataFrame([(raw,)], "r string").select(strip_fences(F.col("r"))).first()[0] == text


def good():
    return {
        "summary": "Modelled probability of default is 0.4213, against a threshold of 0.5.",
        "key_risk_factors": [
            {"factor": "Credit utilisation ratio", "observation": "Utilisation is elevated.", "reason_code": "R01"},
            {"factor": "Payments 90+ days late", "observation": "Serious delinquency is present.", "reason_code": "R02"},
        ],
        "mitigating_factors": [{"factor": "Monthly income", "observation": "Income of 2500 is recorded."}],
        "data_quality_notes": ["Dependents were not supplied."],
        "recommended_checks": ["Verify income against documentation."],
        "confidence": "medium",
    }


def judged(explained, reply):
    rows = explained.withColumn("reply", F.lit(reply if isinstance(reply, str) else json.dumps(reply)))
    return audit.audit(rows).select("problems", "fabricated", "unsupported", "is_valid", audit.outcome(F.lit(True)).alias("o")).first()


def changed(**parts):
    return {**good(), **parts}


def test_valid_replies_pass(explained):
    assert judged(explained, good())["is_valid"]
    assert judged(explained, "```json\n" + json.dumps(good()) + "\n```")["o"] == "ok"
    assert judged(explained, changed(summary="The probability is 42.13 percent, about 42."))["is_valid"]
    assert judged(explained, changed(summary="Payments 30 to 59 days: see 90 and 0.50."))["unsupported"] != []
    assert judged(explained, changed(summary="See 90 and 0.50."))["is_valid"]


def test_fabrications_are_found(explained):
    bad = good()
    bad["key_risk_factors"][0]["reason_code"] = "R99"
    found = judged(explained, bad)
    assert found["fabricated"] == ["R99"] and found["o"] == "fallback"
    assert [float(n) for n in judged(explained, changed(summary="It is 87.5 percent."))["unsupported"]] == [87.5]
    bad = good()
    bad["mitigating_factors"][0]["observation"] = "Utilisation is 73.4 percent."
    assert not judged(explained, bad)["is_valid"]


@pytest.mark.parametrize(
    "reply",
    ["not json at all", changed(key_risk_factors=[]), changed(key_risk_factors=good()["key_risk_factors"] * 3),
     changed(confidence="certain"), {k: v for k, v in good().items() if k != "summary"},
     changed(key_risk_factors=[{"factor": "x", "observation": "y"}]),
     changed(summary=5), changed(data_quality_notes=None), changed(recommended_checks=["a", None]),
     changed(data_quality_notes=[1]), changed(mitigating_factors=[{"factor": "x", "observation": 2}]),
     changed(key_risk_factors=[{"factor": "x", "observation": "y", "reason_code": 1}])],
)
def test_broken_replies_fall_back(explained, reply):
    found = judged(explained, reply)
    assert found["problems"] and found["o"] == "fallback"


def test_disabled(explained):
    assert explained.select(F.lit(True).alias("is_valid")).select(audit.outcome(F.lit(False))).first()[0] == "disabled"


def test_lists_may_be_absent_or_empty(explained):
    assert judged(explained, changed(mitigating_factors=[], data_quality_notes=[]))["is_valid"]
    assert judged(explained, {k: v for k, v in good().items() if k not in ("data_quality_notes", "recommended_checks")})["is_valid"]


def test_final_report_is_the_written_one_or_the_template(explained):
    def final(reply, enabled=True):
        rows = audit.audit(explained.withColumn("reply", F.lit(json.dumps(reply) if reply else None).cast("string")))
        template = reasons.template_report("payload", [], "disabled")
        return rows.select(audit.final_report(F.lit(enabled), template).alias("r")).select("r.*").first()

    written = final(good())
    assert written["llm_status"] == "ok" and written["summary"] == good()["summary"] and written["confidence"] == "medium"
    for reply in (changed(summary="It is 87.5 percent."), None):
        assert final(reply)["llm_status"] == "fallback" and final(reply)["confidence"] == "low"
    assert final(good(), enabled=False)["llm_status"] == "disabled"
    assert final({k: v for k, v in good().items() if k != "data_quality_notes"})["data_quality_notes"] == []


def test_replies_of_other_json_types_are_no_reports(explained):
    for reply in ("[1]", '"text"', "null", "5", '{"summary": "a", "summary": "b"}', "", "{"):
        assert judged(explained, reply)["problems"] == ["not valid JSON"], reply
    assert judged(explained, changed(key_risk_factors="none"))["problems"]
    assert judged(explained, changed(data_quality_notes={"a": 1}))["problems"] == ["data_quality_notes not texts"]
    assert judged(explained, changed(summary={"a": 1}))["problems"] == ["summary not a text"]


def test_each_reply_is_parsed_once(explained):
    rows = explained.withColumn("reply", F.concat(F.lit("x"), F.rand().cast("string")))
    plan = audit.audit(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.lower().count("parsejson") == 1 and "from_json" not in plan


def test_final_reports_job(spark, explained):
    from creditweir.plans import serving

    rows = explained.select("payload", F.col("payload.request_id").alias("request_id"))
    rows = rows.withColumn("report", reasons.template_report("payload", [], "disabled"))
    key = rows.first()["request_id"]
    bad, fine = json.dumps(changed(summary="It is 87.5 percent.")), json.dumps(good())

    def status(found, **options):
        replies = spark.createDataFrame(found, "request_id string, reply string")
        out = serving.final_reports(rows, replies, **options)
        assert out.count() == rows.count()
        return out.filter(F.col("request_id") == key).select("report.llm_status", "report.confidence").first()

    assert tuple(status([(key, fine)])) == ("ok", "medium")
    assert tuple(status([(key, bad)])) == ("fallback", "low")
    assert tuple(status([])) == ("fallback", "low")
    assert tuple(status([(key, fine), (key, fine), (None, bad), ("other", bad)])) == ("ok", "medium")
    assert tuple(status([(key, fine)], enabled=False)) == ("disabled", "low")
