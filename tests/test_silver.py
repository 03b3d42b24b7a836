import pytest
from pyspark.sql import functions as F

from creditweir.functions.columns import dataset_split, to_number
from creditweir.operators import silver
from tests.conftest import raw


def load(make_bronze, rows):
    df = silver.to_silver(make_bronze(rows), F.lit("2026-01-01"))
    return {r["applicant_id"]: r for r in df.collect()}


@pytest.mark.parametrize(
    "text,value",
    [("5", 5.0), (" 5.5 ", 5.5), ("1e3", 1000.0), ("", None), ("  ", None), ("not a number", None), ("NaN", None),
     ("5d", None), ("5F", None), ("2.f", None), ("inf", float("inf")), ("-3", -3.0), (None, None)],
)
def test_text_to_number(spark, text, value):
    row = spark.createDataFrame([(text,)], "t string").select(to_number(F.col("t")).alias("n")).first()
    assert row["n"] == value


def test_rows_are_never_dropped_and_flags_follow_the_rules(make_bronze, bronze_rows):
    rows = load(make_bronze, bronze_rows)
    assert len(rows) == 20
    assert rows[15]["dq_income_missing"] and rows[15]["monthly_income"] is None
    assert rows[16]["dq_dependents_missing"]
    assert rows[17]["dq_age_invalid"] and rows[17]["age"] is None
    assert rows[18]["dq_utilisation_outlier"] and float(rows[18]["revolving_utilisation"]) == 50000
    assert rows[19]["dq_delinquency_sentinel"] and rows[19]["times_90_days_late"] is None
    assert rows[19]["times_30_59_days_late"] == 0
    clean = rows[0]
    assert not any(clean[c] for c in clean.asDict() if c.startswith("dq_"))


def test_boundaries(make_bronze):
    rows = load(
        make_bronze,
        [
            raw(0, 0, age="110"),
            raw(1, 1, age="111"),
            raw(2, 2, age=""),
            raw(3, 3, revolving_utilization_unsecured_lines="1.0"),
            raw(4, 4, serious_dlqin_2yrs=""),
            raw(5, 5, serious_dlqin_2yrs="2"),
            raw(6, 6, times_30_59_days_past_due="96", times_60_89_days_past_due="97"),
        ],
    )
    assert not rows[0]["dq_age_invalid"] and rows[0]["age"] == 110
    assert rows[1]["dq_age_invalid"]
    assert not rows[2]["dq_age_invalid"] and rows[2]["age"] is None
    assert not rows[3]["dq_utilisation_outlier"]
    assert rows[4]["dq_row_quarantined"]
    assert rows[5]["dq_row_quarantined"] and rows[5]["is_serious_delinquency"] is None
    assert rows[6]["times_30_59_days_late"] is None and rows[6]["times_60_89_days_late"] == 97


def test_highest_bronze_id_wins(make_bronze, bronze_rows):
    rows = load(make_bronze, bronze_rows + [raw(999, 3, monthly_income="9999")])
    assert len(rows) == 20 and float(rows[3]["monthly_income"]) == 9999


def test_one_applicant_with_most_rows(make_bronze):
    many = [raw(i, 7, monthly_income=str(i)) for i in range(300)] + [raw(1000 + i, 100 + i) for i in range(50)]
    rows = load(make_bronze, many)
    assert len(rows) == 51 and float(rows[7]["monthly_income"]) == 299


def test_rows_without_id_are_set_aside(make_bronze):
    frame = make_bronze([raw(0, 1), raw(1, 2, raw_row_id=""), raw(2, 3, raw_row_id="x")])
    keyed, unkeyed = silver.split_unkeyed(frame)
    assert keyed.count() == 1 and unkeyed.count() == 2


def test_quality_counts_after_dedupe(make_bronze, bronze_rows):
    repeated = bronze_rows + [raw(500, 15, monthly_income="")]
    counts = silver.quality_counts(silver.to_silver(make_bronze(repeated), F.lit("2026-01-01"))).collect()
    found = {r["rule_name"]: r["rows_affected"] for r in counts}
    assert found == {
        "income_missing": 1, "dependents_missing": 1, "age_invalid": 1, "utilisation_outlier": 1,
        "delinquency_sentinel": 1, "row_quarantined": 0,
    }


def test_split_is_stable_and_near_its_shares(spark):
    import hashlib

    rows = spark.range(10000).select("id", dataset_split(F.col("id")).alias("s")).collect()
    for r in rows[:200]:
        h = int(hashlib.md5(str(r["id"]).encode()).hexdigest()[:8], 16) % 100
        assert r["s"] == ("train" if h < 70 else "valid" if h < 85 else "test")
    share = {s: sum(r["s"] == s for r in rows) / 10000 for s in ("train", "valid", "test")}
    assert abs(share["train"] - 0.70) < 0.02 and abs(share["valid"] - 0.15) < 0.02 and abs(share["test"] - 0.15) < 0.02


def test_values_beyond_their_column_are_rejected(spark, make_bronze):
    rows = [
        raw(0, 1), raw(1, 1, open_credit_lines_and_loans="40000"), raw(2, 2, revolving_utilization_unsecured_lines="inf"),
        raw(3, 3, debt_ratio="1e12"), raw(4, 4, number_of_dependents="32767"), raw(5, 5, age="40000"), raw(6, 6, monthly_income="123456789.5"),
        raw(7, 7, revolving_utilization_unsecured_lines="0.123456789"),
    ]
    frame = make_bronze(rows)
    stored = silver.to_silver(frame, F.lit("2026-01-01")).collect()
    assert sorted(r["applicant_id"] for r in stored) == [1, 4, 5, 6, 7]
    assert {r["applicant_id"]: r["open_credit_lines"] for r in stored}[1] == 6
    assert sorted(r["bronze_id"] for r in silver.split_unkeyed(frame)[1].collect()) == [1, 2, 3]
