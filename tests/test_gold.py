import datetime as dt

import pytest
from pyspark.sql import functions as F

from creditweir import schemas
from creditweir.operators import assertions, dimensions, scd2
from creditweir.operators.upsert import insert_if_absent, upsert

DAY = dt.date


def test_calendar(spark):
    days = {r["date_key"]: r for r in dimensions.calendar(spark).collect()}
    assert len(days) == 1461
    leap = days[20240229]
    assert leap["is_month_end"] and leap["month_name"] == "February" and leap["quarter"] == 1
    assert days[20240101]["day_of_week"] == 0 and days[20240107]["day_of_week"] == 6


def test_delinquency_profiles_cover_all_flags(spark):
    rows = dimensions.delinquency_profiles(spark).collect()
    assert len({tuple(r[1:5]) for r in rows}) == 16 and [r[0] for r in rows] == list(range(1, 17))
    for r in rows:
        want = (
            "unreliable" if r["has_sentinel_code"] else "severe" if r["has_90_plus_late"]
            else "moderate" if r["has_60_89_late"] else "mild" if r["has_30_59_late"] else "none"
        )
        assert r["severity_label"] == want


@pytest.mark.parametrize(
    "income,label",
    [(None, "unknown"), (0.0, "0-2000"), (1999.99, "0-2000"), (2000.0, "2000-4000"), (10000.0, "10000+"), (-5.0, "10000+")],
)
def test_income_band(spark, income, label):
    bands = dimensions.band_rows(dimensions.income_bands(spark))
    key = dimensions.band_lookup(F.col("v"), bands, "income_band_key")
    row = spark.createDataFrame([(income,)], "v double").select(key.alias("k")).first()
    assert {b["income_band_key"]: b["band_label"] for b in bands}[row["k"]] == label


@pytest.mark.parametrize("value,key", [(0.0, 1), (0.1, 2), (0.3, 3), (0.6, 4), (1.0, 5), (50.0, 5)])
def test_utilisation_band_is_left_closed(spark, value, key):
    bands = dimensions.band_rows(dimensions.utilisation_bands(spark))
    got = spark.range(1).select(dimensions.band_lookup(F.lit(value), bands, "utilisation_band_key")).first()[0]
    assert got == key


def test_null_utilisation_is_an_error(spark):
    bands = dimensions.band_rows(dimensions.utilisation_bands(spark))
    frame = spark.createDataFrame([(None,)], "v double")
    with pytest.raises(Exception, match="utilisation_band_key"):
        frame.select(dimensions.band_lookup(F.col("v"), bands, "utilisation_band_key")).collect()


def incoming(spark, rows, day):
    frame = spark.createDataFrame(rows, "applicant_id bigint, age smallint, age_band string, number_of_dependents smallint, dependents_band string")
    return frame.withColumn("snapshot_date", F.lit(day).cast("date"))


def test_history_of_two_loads(spark):
    empty = spark.createDataFrame([], schemas.DIM_BORROWER)
    first = scd2.merge_versions(empty, incoming(spark, [(1, 30, "25-34", 0, "0"), (2, 40, "35-44", 1, "1"), (3, 50, "45-54", 2, "2")], "2026-01-01"))
    assert first.count() == 3 and first.filter("is_current").count() == 3
    second_rows = incoming(spark, [(1, 31, "25-34", 0, "0"), (2, 40, "35-44", 2, "2"), (4, 20, "<25", None, "unknown")], "2026-02-01")
    counts = scd2.change_counts(first, second_rows).first()
    assert (counts["n_new"], counts["n_changed"]) == (1, 1)
    second = scd2.merge_versions(first, second_rows)
    rows = {(r["applicant_id"], r["effective_from"]): r for r in second.collect()}
    assert len(rows) == 5
    closed, opened = rows[(2, DAY(2026, 1, 1))], rows[(2, DAY(2026, 2, 1))]
    assert closed["effective_to"] == DAY(2026, 1, 31) and not closed["is_current"]
    assert opened["effective_to"] == DAY(9999, 12, 31) and opened["dependents_band"] == "2"
    assert rows[(1, DAY(2026, 1, 1))]["age"] == 30, "an unchanged band keeps the stored age"
    assert rows[(3, DAY(2026, 1, 1))]["is_current"], "absent borrowers are untouched"
    assert assertions.duplicate_keys(second, ["borrower_key"]).count() == 0
    assert assertions.duplicate_keys(second, ["applicant_id"], where="is_current").count() == 0
    third = scd2.merge_versions(second, second_rows)
    assert third.count() == 5, "loading the same snapshot again changes nothing"
    asked = spark.createDataFrame([(2, DAY(2026, 1, 15)), (2, DAY(2026, 2, 1)), (4, DAY(2026, 1, 1))], "applicant_id bigint, day date")
    found = {(r["applicant_id"], r["day"]): r["dependents_band"] for r in scd2.version_at(asked, second, "day").collect()}
    assert found == {(2, DAY(2026, 1, 15)): "1", (2, DAY(2026, 2, 1)): "2", (4, DAY(2026, 1, 1)): None}


def test_two_changes_on_one_day_are_rejected(spark):
    empty = spark.createDataFrame([], schemas.DIM_BORROWER)
    first = scd2.merge_versions(empty, incoming(spark, [(1, 30, "25-34", 0, "0")], "2026-01-01"))
    again = scd2.merge_versions(first, incoming(spark, [(1, 30, "25-34", 1, "1")], "2026-01-01"))
    with pytest.raises(Exception, match="changed twice"):
        again.collect()


def test_upsert_and_insert_if_absent(spark):
    target = spark.createDataFrame([(1, "a", "t1"), (2, "b", "t1")], "id int, v string, processed string")
    staged = spark.createDataFrame([(2, "B", "t2"), (3, "C", "t2")], "id int, v string, processed string")
    got = sorted(map(tuple, upsert(target, staged, ["id"]).collect()))
    assert got == [(1, "a", "t1"), (2, "B", "t2"), (3, "C", "t2")]
    kept = sorted(map(tuple, upsert(target, staged, ["id"], keep=("processed",)).collect()))
    assert kept == [(1, "a", "t1"), (2, "B", "t1"), (3, "C", "t2")]
    fresh = sorted(map(tuple, insert_if_absent(target, staged, ["id"]).collect()))
    assert fresh == [(1, "a", "t1"), (2, "b", "t1"), (3, "C", "t2")]


def test_assertions(spark):
    frame = spark.createDataFrame([(1, 1, "a"), (1, 2, "x"), (2, None, None)], "id int, fk int, code string")
    dim = spark.createDataFrame([(1,)], "key int")
    report = assertions.constraint_report(frame, [["id"]], [("fk", dim, "key")], ["fk"], {"code": ["a", "b"]})
    assert {(r["kind"], r["violations"]) for r in report.collect()} == {("unique", 1), ("reference", 1), ("not_null", 1), ("domain", 1)}
    with pytest.raises(assertions.ConstraintError, match="1 rows have NULL fk"):
        assertions.require_no_nulls(frame, ["id", "fk"])
    with pytest.raises(assertions.ConstraintError):
        assertions.require_clean(report)


def test_conform_names_missing_and_null_columns(spark):
    with pytest.raises(ValueError, match="borrower_key"):
        schemas.conform(spark.range(1), schemas.DIM_BORROWER)
    frame = spark.createDataFrame([(None, "x", "WARN", 1)], "ingestion_id string, rule_name string, severity string, rows_affected int")
    with pytest.raises(Exception, match="null in required column ingestion_id"):
        schemas.conform(frame.withColumn("checked_at", F.current_timestamp()), schemas.DATA_QUALITY_LOG).collect()


def test_keys_of_the_largest_ids_do_not_overflow(spark):
    from creditweir.operators.scd2 import borrower_key

    ids = [2**53 + 1, 2**63 - 1, -(2**63), 0, -1]
    rows = spark.createDataFrame([(i,) for i in ids], "applicant_id bigint")
    keys = rows.select(borrower_key(F.col("applicant_id"), F.lit("2026-01-01").cast("date")).alias("k")).collect()
    assert [int(r["k"]) for r in keys] == [i * 100000 + 20454 for i in ids]
