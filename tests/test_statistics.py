import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditweir.operators import drift, evaluation, longform, quantiles
from creditweir.operators.ranking import global_row_number, running_totals
from creditweir.plans import catalog_models

TENTHS = [i / 10 for i in range(11)]


def frame(spark, values, parts=4):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double").repartition(parts)


def samples():
    rng = np.random.default_rng(3)
    return {
        "normal": rng.normal(100, 15, 5000).tolist(),
        "small": [3.0, 1.0, 2.0],
        "one": [7.0],
        "hot": [5.0] * 4000 + rng.normal(5, 2, 2000).tolist(),
        "ties": rng.integers(0, 4, 3000).astype(float).tolist(),
        "nulls": [None, float("nan"), 1.0, 2.0, 4.0, None],
        "infinite": [-math.inf, math.inf, 0.0, 1.0, 2.0],
    }


@pytest.mark.parametrize("name", samples())
@pytest.mark.parametrize("accuracy,listed", [(10000, 20000), (20, 5)])
def test_quantiles_equal_pandas(spark, monkeypatch, name, accuracy, listed):
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "MAX_LISTED_VALUES", listed)
    values = samples()[name]
    probabilities = TENTHS + [0.99] if name != "infinite" else [0.25, 0.5, 0.75]
    got = quantiles.exact_quantiles(frame(spark, values), {"x": probabilities})["x"]
    want = pd.Series(values, dtype=float).quantile(probabilities).tolist()
    assert got == pytest.approx(want, rel=1e-12, nan_ok=True)


def test_quantiles_of_nothing(spark):
    assert quantiles.exact_quantiles(frame(spark, [None, None]), {"x": [0.5]}) == {"x": [None]}


@pytest.mark.parametrize("parts", [1, 7])
def test_row_numbers_and_totals_do_not_depend_on_partitions(spark, parts):
    rng = np.random.default_rng(5)
    scores = [0.5] * 700 + rng.integers(0, 50, 1300).tolist()
    rows = [(i, float(s)) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "id int, score double").repartition(parts)
    got = {r["id"]: r["n"] for r in global_row_number(df, ["score", "id"], "n").collect()}
    want = {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1)}
    assert got == want
    groups = df.groupBy("score").agg(F.count("*").alias("n"))
    below = {r["score"]: r["below_n"] for r in running_totals(groups, "score", ["n"]).collect()}
    assert below == {s: sum(x < s for x in scores) for s in set(map(float, scores))}


@pytest.mark.parametrize("n", [10, 11, 19, 20, 101, 1234])
def test_deciles_equal_qcut(spark, n):
    rng = np.random.default_rng(n)
    y = rng.integers(0, 2, n)
    y[0], y[1] = 0, 1
    score = rng.integers(0, max(n // 3, 2), n) / 7
    df = spark.createDataFrame(list(zip(range(n), map(int, y), map(float, score))), "id int, y int, score double")
    got = {r["decile"]: r for r in evaluation.decile_lift(df, "y", "score", "id").collect()}
    pdf = pd.DataFrame({"y": y, "score": score})
    pdf["d"] = 9 - pd.qcut(pdf["score"].rank(method="first"), 10, labels=False)
    want = pdf.groupby("d").agg(n=("y", "size"), p=("y", "sum"), s=("score", "mean"))
    assert {d: (r["n"], r["actual_positives"]) for d, r in got.items()} == {
        d: (w["n"], w["p"]) for d, w in want.iterrows()
    }
    for d, w in want.iterrows():
        assert got[d]["mean_score"] == pytest.approx(w["s"])
        assert got[d]["lift"] == pytest.approx(w["p"] / w["n"] / y.mean())


def test_auc_and_ks_by_brute_force(spark):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 400)
    score = (rng.integers(0, 30, 400) + 8 * y) / 40
    df = spark.createDataFrame(list(zip(map(int, y), map(float, score))), "y int, score double")
    got = evaluation.rank_metrics(df, "y", "score").first()
    pos, neg = score[y == 1], score[y == 0]
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    assert got["auc"] == pytest.approx(wins / (len(pos) * len(neg)))
    ks = max((pos >= t).mean() - (neg >= t).mean() for t in set(score))
    assert got["ks"] == pytest.approx(ks)


def test_threshold_metrics_and_zero_division(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.2), (0, 0.6), (0, 0.1)], "y int, s double")
    row = evaluation.threshold_metrics(evaluation.confusion_counts(df, "y", "s")).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (1, 1, 1, 1)
    assert (row["precision"], row["recall"], row["f1"]) == (0.5, 0.5, 0.5)
    none = evaluation.threshold_metrics(evaluation.confusion_counts(df, "y", "s", 2.0)).first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("split", ["test", "valid"])
def test_boosted_evaluation_has_the_metrics_of_the_test_split(spark, monkeypatch, split):
    rows = [(k, int(k % 3 == 0), (11 * k % 20) // 2 / 10, split if k < 20 else "train") for k in range(30)]
    scored = spark.createDataFrame(rows, "applicant_id int, is_serious_delinquency int, probability_default double, dataset_split string")
    metadata = {"metrics": {"auc": 0.75, "threshold": 0.5}}
    monkeypatch.setattr(catalog_models, "_trained", lambda *_: (None, None, None, metadata, scored))
    got = catalog_models.boosted_evaluation(spark, "").collect()
    own = [(y, p) for _, y, p, s in rows if s == "test"]
    counts = {k: sum((y, p >= 0.5) == v for y, p in own) for k, v in {"tn": (0, False), "fp": (0, True), "fn": (1, False), "tp": (1, True)}.items()}
    assert all({k: r[k] for k in counts} == counts and r["threshold"] == 0.5 for r in got)
    if not own:
        assert len(got) == 1 and got[0]["decile"] is None and got[0]["auc"] is None
        return
    assert sorted(r["decile"] for r in got) == list(range(10)) and sum(r["n"] for r in got) == len(own)
    wins = [(a > b) + 0.5 * (a == b) for y, a in own for z, b in own if y > z]
    auc = sum(wins) / len(wins)
    for r in got:
        assert r["auc"] == pytest.approx(auc, abs=1e-6) and r["auc_gap"] == pytest.approx(0.75 - auc, abs=1e-6)
        assert r["precision"] == pytest.approx(counts["tp"] / (counts["tp"] + counts["fp"]), abs=1e-6)
        assert r["recall"] == pytest.approx(counts["tp"] / (counts["tp"] + counts["fn"]), abs=1e-6)
        assert r["gap_warning"] == (abs(0.75 - auc) > 0.02) and 0 <= r["ks"] <= 1 and 0 < r["f1"] < 1


def numpy_psi(reference, current, edges):
    r = np.histogram(reference, edges)[0] / len(reference)
    c = np.histogram(current, edges)[0] / len(current)
    r, c = np.where(r == 0, 1e-6, r), np.where(c == 0, 1e-6, c)
    return float(np.sum((c - r) * np.log(c / r)))


def test_psi_equals_numpy_and_reacts_to_shift(spark):
    rng = np.random.default_rng(1)
    reference, same, moved = rng.normal(100, 15, 4000), rng.normal(100, 15, 1000), rng.normal(160, 15, 1000)
    ref = frame(spark, reference)
    edges = drift.quantile_edges(ref, ["x"])["x"]
    assert edges[0] == -math.inf and edges[-1] == math.inf and len(edges) == 11
    for current in (reference, same, moved):
        got = drift.psi_between(ref, frame(spark, current), "x", edges)
        assert got == pytest.approx(numpy_psi(reference, current, edges), abs=1e-9)
        assert got >= 0
    assert drift.psi_between(ref, frame(spark, moved), "x") > 0.25
    assert drift.psi_between(ref, frame(spark, same), "x") < 0.10


def test_psi_of_empty_and_constant_samples(spark):
    ref = frame(spark, [0.0] * 50 + [1.0] * 50)
    empty = frame(spark, [None])
    assert drift.psi_between(ref, empty, "x", [-math.inf, 0.5, math.inf]) == 0.0
    assert drift.psi_between(empty, ref, "x") == 0.0
    assert math.isfinite(drift.psi_between(ref, frame(spark, [0.0] * 20), "x"))
    assert drift.quantile_edges(frame(spark, [7.0] * 500), ["x"])["x"] == [-math.inf, math.inf]
    assert drift.psi_between(frame(spark, [7.0] * 50), frame(spark, [99.0] * 50), "x") == 0.0, "one open bin sees nothing"


def test_values_outside_the_reference_are_counted(spark):
    rng = np.random.default_rng(2)
    ref = frame(spark, rng.uniform(0, 1, 500))
    assert drift.psi_between(ref, frame(spark, [99.0] * 500), "x") > 0.25


@pytest.mark.parametrize(
    "psi,status", [(0, "OK"), (0.05, "OK"), (0.099, "OK"), (0.10, "WARN"), (0.20, "WARN"), (0.249, "WARN"), (0.25, "ALERT"), (1.0, "ALERT")]
)
def test_drift_status(spark, psi, status):
    df = drift.with_status(spark.createDataFrame([(float(psi),)], "psi double"))
    assert df.first()["drift_status"] == status


def test_logged_psi_needs_enough_rows_and_skips_unknown_features(spark):
    rng = np.random.default_rng(4)
    ref = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(0, 1, (2000, 2))], "a double, b double")
    profile = drift.reference_profile(ref, ["a", "b"])
    logged = [('{"a": %f, "zz": 1}' % v if i % 10 else '{"a": null}',) for i, v in enumerate(rng.normal(0, 1, 300))]
    log = spark.createDataFrame(logged, "feature_vector string")
    rows = drift.logged_psi(log, profile).collect()
    assert [r["feature"] for r in rows] == ["a"]
    assert rows[0]["n_current"] == 270 and rows[0]["n_reference"] == 2000
    assert drift.logged_psi(log.limit(99), profile).count() == 0


def _jobs(spark, work) -> int:
    group = f"jobs-{id(work)}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_grow_with_columns_and_quantiles(spark, monkeypatch):
    """Crowded brackets of all columns are narrowed together."""
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 20)
    monkeypatch.setattr(quantiles, "MAX_LISTED_VALUES", 40)
    values = [(i * 7919) % 5000 / 7 for i in range(5000)]
    df = spark.createDataFrame([(v,) * 6 for v in values], ", ".join(f"x{i} double" for i in range(6)))
    tenths = [i / 10 for i in range(11)]
    want = pd.Series(values).quantile(tenths).tolist()

    def one():
        assert quantiles.exact_quantiles(df, {"x0": tenths})["x0"] == pytest.approx(want)

    def six():
        found = quantiles.exact_quantiles(df, {f"x{i}": tenths for i in range(6)})
        assert all(found[f"x{i}"] == pytest.approx(want) for i in range(6))

    assert _jobs(spark, six) <= _jobs(spark, one) + 2


def test_bins_by_halving_equal_a_search(spark):
    edges = [-math.inf, -1.5, 0.0, 0.25, 3.0, math.inf]
    closed = [-1.0, 0.0, 2.0]
    values = [-math.inf, -9.0, -1.5, -1.0, -0.0, 0.0, 0.1, 0.25, 2.0, 2.1, 3.0, math.inf, math.nan, None]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", longform.bin_of(F.col("x"), edges), longform.bin_of(F.col("x"), closed)).collect()
    for x, a, b in got:
        if x is None or math.isnan(x):
            assert (a, b) == (None, None)
            continue
        assert a == min(sum(x >= e for e in edges) - 1, len(edges) - 2)
        assert b == (min(sum(x >= e for e in closed) - 1, 1) if -1.0 <= x <= 2.0 else None)


def test_histograms_in_one_shuffle(spark):
    """One aggregate that combines before its only shuffle, and no join."""
    df = spark.createDataFrame([(i % 2, float(i % 13), float(i % 7) if i % 5 else None) for i in range(200)], "g int, a double, b double")
    edges = {"a": [-math.inf, 3.0, 6.0, math.inf], "b": [-math.inf, 2.0, math.inf]}
    counts = drift.bin_counts(df, edges, ("g",))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1 and "partial_count" in plan
    got = {(r["g"], r["feature"], r["bin"]): r["n"] for r in counts.collect()}
    want = {}
    for g, a, b in df.collect():
        for f, x in (("a", a), ("b", b)):
            if x is not None:
                key = g, f, sum(x >= e for e in edges[f][1:-1])
                want[key] = want.get(key, 0) + 1
    assert got == want
