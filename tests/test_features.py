import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditweir import fixed_values as fv
from creditweir.operators import attribution, features, models, requests, scoring

COLUMNS = "is_serious_delinquency smallint, dataset_split string, " + ", ".join(f"{c} double" for c in fv.CREDIT_REQUIRED)


def applicants(spark, n=300, seed=7):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        late = [int(v) for v in rng.poisson(0.4, 3)]
        util = float(rng.uniform(0, 1.4))
        income = None if i % 10 == 0 else float(rng.integers(500, 12000))
        age = None if i % 25 == 0 else float(rng.integers(10, 105))
        dependents = None if i % 15 == 0 else float(rng.integers(0, 4))
        label = int(rng.uniform() < 0.05 + 0.3 * util / 1.4 + 0.2 * (sum(late) > 1))
        split = "train" if i % 10 < 7 else "valid" if i % 10 < 9 else "test"
        rows.append((label, split, util, age, float(rng.uniform(0, 2)), income, float(rng.integers(0, 15)), 1.0, *map(float, late), float(sum(late)), dependents))
    return spark.createDataFrame(rows, COLUMNS)


def test_cleaning_rules(spark):
    rows = spark.createDataFrame(
        [(1, "train", 0.5, 12.0, 0.1, None, -3.0, 1.0, 0.0, 0.0, 0.0, 0.0, None), (None, "train", 0.5, 40.0, 0.1, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)],
        COLUMNS,
    )
    cleaned = features.clean_credit(rows).collect()
    assert len(cleaned) == 1
    assert cleaned[0]["age"] == 18 and cleaned[0]["open_credit_lines"] == 0
    assert cleaned[0]["monthly_income"] is None and cleaned[0]["number_of_dependents"] is None
    served = features.clean_credit(rows.drop("is_serious_delinquency"))
    assert served.count() == 2
    text = rows.withColumn("debt_ratio", F.lit("oops"))
    assert features.clean_credit(text).first()["debt_ratio"] is None


def test_features_use_the_stored_parameters(spark):
    rows = applicants(spark)
    cleaned = features.clean_credit(rows)
    params = features.fit_credit(cleaned.filter("dataset_split = 'train'"))
    train = [r for r in cleaned.collect() if r["dataset_split"] == "train"]
    assert params.values["median_income"] == np.median([r["monthly_income"] for r in train if r["monthly_income"] is not None])
    cap = np.quantile([r["revolving_utilisation"] for r in train], 0.99)
    assert params.values["utilisation_cap"] == pytest.approx(cap)
    out = features.credit_features(cleaned, params)
    assert out.columns == fv.CREDIT_FEATURES
    found = out.collect()
    assert all(v is not None for r in found for v in r)
    assert max(r["revolving_utilisation"] for r in found) <= params.values["utilisation_cap"]
    missing = [r for r in found if r["income_missing"]]
    assert {r["monthly_income"] for r in missing} == {params.values["median_income"]}
    other = features.FeatureParams(params.feature_names, {**params.values, "median_income": 1.0})
    assert {r["monthly_income"] for r in features.credit_features(cleaned, other).collect() if r["income_missing"]} == {1.0}
    with pytest.raises(features.NotFittedError):
        features.credit_features(cleaned, None)


@pytest.mark.parametrize("value,bucket", [(0.0, 0), (0.1, 0), (0.1001, 1), (0.3, 1), (0.6, 2), (1.0, 3), (1.2, 4)])
def test_utilisation_bucket_is_right_closed(spark, value, bucket):
    from creditweir.functions.columns import utilisation_bucket

    assert spark.range(1).select(utilisation_bucket(F.lit(value))).first()[0] == bucket


def test_missing_utilisation_has_no_bucket(spark):
    from creditweir.functions.columns import utilisation_bucket

    with pytest.raises(Exception, match="no bucket"):
        spark.createDataFrame([(None,)], "u double").select(utilisation_bucket(F.col("u"))).collect()


@pytest.mark.parametrize("p,band,klass", [(0.0, "low", 0), (0.05, "medium", 0), (0.15, "high", 0), (0.35, "very_high", 0), (0.5, "very_high", 1)])
def test_decision(spark, p, band, klass):
    row = scoring.decide(spark.createDataFrame([(p,)], "probability_default double")).first()
    assert (row["risk_band"], row["predicted_class"], row["threshold_used"]) == (band, klass, 0.5)


def brute_force_shapley(nodes, row, feature, n):
    """Shapley value from the definition, with covers for unknown features."""

    def value(node, known):
        if node["leftChild"] < 0:
            return node["prediction"]
        left, right = nodes[node["leftChild"]], nodes[node["rightChild"]]
        f, t = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
        if f in known:
            return value(left if row[f] <= t else right, known)
        a, b = left["w"], right["w"]
        return (a * value(left, known) + b * value(right, known)) / (a + b)

    others = [f for f in range(n) if f != feature]
    total = 0.0
    for size in range(n):
        for known in itertools.combinations(others, size):
            weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
            total += weight * (value(nodes[0], {*known, feature}) - value(nodes[0], set(known)))
    return total


def node(i, left, right, feature=0, threshold=0.0, prediction=0.0, w=1.0):
    return {"id": i, "leftChild": left, "rightChild": right, "prediction": prediction, "w": w,
            "split": {"featureIndex": feature, "leftCategoriesOrThreshold": [threshold]}}


def test_leaf_games_equal_the_definition():
    nodes = {
        0: node(0, 1, 2, 0, 0.5, w=10), 1: node(1, 3, 4, 1, 2.0, w=6), 2: node(2, 5, 6, 0, 0.8, w=4),
        3: node(3, -1, -1, prediction=1.0, w=2), 4: node(4, 7, 8, 2, 1.0, w=4), 5: node(5, -1, -1, prediction=-3.0, w=1),
        6: node(6, -1, -1, prediction=5.0, w=3), 7: node(7, -1, -1, prediction=0.3, w=1), 8: node(8, -1, -1, prediction=2.0, w=3),
    }
    leaves = attribution.tree_leaves(nodes, 1.0, lambda n: n["w"], lambda n: n["prediction"])
    built = attribution.Attributor.build(["a", "b", "c"], leaves)
    rng = np.random.default_rng(0)
    matrix = np.column_stack([rng.uniform(0, 1, 40), rng.uniform(0, 4, 40), rng.uniform(0, 2, 40)])
    got = built.contributions(matrix)
    for i, row in enumerate(matrix):
        want = [brute_force_shapley(nodes, row, f, 3) for f in range(3)]
        assert got[i] == pytest.approx(want, abs=1e-12)


def test_attribution_adds_up_and_batches_do_not_matter(spark):
    rows = applicants(spark)
    cleaned = features.clean_credit(rows)
    params = features.fit_credit(cleaned)
    names = params.feature_names
    ready = features.credit_features(cleaned, params, ("is_serious_delinquency", "dataset_split")).cache()
    model = models.boosted_trees(4).fit(models.training_rows(ready, names, "is_serious_delinquency", 3.0))
    scored = models.score(ready, model, names)
    filled = scored.withColumns({n: F.col(n).cast("double") for n in names})
    built = models.boosted_attributor(model, names)
    out = attribution.attribute(filled, built).collect()
    for r in out:
        margin = r["base_value"] + sum(r[f"shap_{n}"] for n in names)
        assert margin == pytest.approx(math.log(r["probability_default"] / (1 - r["probability_default"])), abs=1e-9)
    with pytest.raises(ValueError, match="no model"):
        models.score(ready, None, names)


def test_class_balance_and_counts(spark):
    row = features.class_balance(spark.createDataFrame([(0,), (0,), (0,), (1,)], "is_serious_delinquency int")).first()
    assert (row["n_negative"], row["n_positive"], row["scale_pos_weight"]) == (3, 1, 3.0)
    none = features.class_balance(spark.createDataFrame([(0,)], "is_serious_delinquency int")).first()
    assert none["scale_pos_weight"] is None


def test_unknown_pipeline_names_the_known():
    with pytest.raises(models.UnknownPipelineError, match="credit.*dummy"):
        models.get_pipeline("fraud")


REQUEST = {
    "RevolvingUtilizationOfUnsecuredLines": 0.5, "age": 40.0, "DebtRatio": 0.4, "MonthlyIncome": 5000.0,
    "NumberOfOpenCreditLinesAndLoans": 6.0, "NumberRealEstateLoansOrLines": 1.0,
    "NumberOfTime30-59DaysPastDueNotWorse": 0.0, "NumberOfTime60-89DaysPastDueNotWorse": 0.0,
    "NumberOfTimes90DaysLate": 0.0, "NumberOfDependents": 1.0,
}


def check_request(spark, **changes):
    body = {**REQUEST, **changes}
    schema = ", ".join(f"`{n}` double" for n in body)
    return requests.validate(spark.createDataFrame([tuple(body.values())], schema)).first()["errors"]


@pytest.mark.parametrize(
    "field,value,part",
    [("age", 12.0, "below 18"), ("age", 200.0, "above 110"), ("age", None, "required"), ("age", 40.5, "whole"),
     ("RevolvingUtilizationOfUnsecuredLines", -0.5, "below 0"), ("MonthlyIncome", -1000.0, "below 0"),
     ("NumberOfOpenCreditLinesAndLoans", -1.0, "below 0"), ("NumberOfTimes90DaysLate", 96.0, "sentinel"),
     ("NumberOfTimes90DaysLate", 98.0, "sentinel"), ("NumberOfTime60-89DaysPastDueNotWorse", 96.0, "sentinel"),
     ("NumberOfTime30-59DaysPastDueNotWorse", 98.0, "sentinel")],
)
def test_bad_requests(spark, field, value, part):
    errors = check_request(spark, **{field: value})
    assert len(errors) == 1 and part in errors[0]


def test_good_requests_and_both_spellings(spark):
    assert check_request(spark) == []
    assert check_request(spark, MonthlyIncome=None, NumberOfDependents=None) == []
    assert len(check_request(spark, age=12.0, MonthlyIncome=-1.0)) == 2
    business = {name: REQUEST[header] for name, header in fv.REQUEST_ALIASES.items()}
    frame = spark.createDataFrame([tuple(business.values())], ", ".join(f"`{n}` double" for n in business))
    accepted = requests.accepted(requests.validate(frame)).first()
    assert accepted["total_delinquency_events"] == 0 and accepted["age"] == 40


def test_scenarios_keep_nulls_and_round_counts(spark):
    rows = applicants(spark, 40).limit(40)
    out = scoring.scenario_rows(rows).collect()
    assert len(out) == 120
    severe = {i: r for i, r in enumerate(x for x in out if x["scenario"] == "severe")}
    plain = {i: r for i, r in enumerate(x for x in out if x["scenario"] == "none")}
    for i, r in plain.items():
        if r["monthly_income"] is None:
            assert severe[i]["monthly_income"] is None
        assert severe[i]["revolving_utilisation"] == pytest.approx(3 * r["revolving_utilisation"])
