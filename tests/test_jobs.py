import csv
import hashlib

import pytest
from pyspark.sql import functions as F

from creditweir import fixed_values as fv
from creditweir import schemas
from creditweir.operators import assertions, registry
from creditweir.plans import etl, monitoring, portfolio, serving, training
from creditweir.sources import artifacts, files, ingest, runs
from creditweir.sources.tables import Tables
from creditweir.streaming import jobs as streams

HEADERS = ["", *list(fv.SOURCE_HEADERS)[1:]]


def write_csv(path, n=400, start=0, dependents=1):
    with open(path, "w", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(HEADERS)
        for i in range(start, start + n):
            late = (i * 7) % 5 if i % 3 == 0 else 0
            bad = 1 if late >= 2 or (i * 13) % 17 == 0 else 0
            income = "" if i % 9 == 0 else 2000 + (i * 37) % 9000
            writer.writerow(
                [i, bad, ((i * 29) % 120) / 100, 20 + i % 60, late, ((i * 3) % 50) / 40, income, i % 12, late // 2, i % 3, 0, dependents]
            )
    return str(path)


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    """One full load of a small CSV file."""
    folder = tmp_path_factory.mktemp("load")
    tables = Tables(spark, str(folder / "tables"))
    path = write_csv(folder / "first.csv")
    etl.run(tables, files.csv_source(path), "2026-01-01")
    return tables, path, folder


def test_csv_keeps_text_and_counts_rows_over_splits(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", 3000)
    write_csv(tmp_path / "b.csv", 500, start=5000)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        rows = files.csv_source(str(tmp_path)).read(spark)
        assert rows.rdd.getNumPartitions() > 2
        got = rows.select("raw_row_id", "source_row_number", "position", "monthly_income", F.element_at(F.split("source_file", "/"), -1).alias("f")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", "4194304")
    assert all(int(r["raw_row_id"]) == r["source_row_number"] + (5000 if r["f"] == "b.csv" else 0) for r in got)
    assert sorted(r["position"] for r in got) == list(range(3500))
    assert any(r["monthly_income"] == "" for r in got) and not any(r["monthly_income"] is None for r in got)
    digest = hashlib.sha256(open(path, "rb").read()).hexdigest()
    assert files.fingerprints(spark, path).first()["file_sha256"] == digest


def test_fingerprints_of_any_size(spark, tmp_path):
    """Files are digested in pieces; a sparse one is larger than a row can be."""
    small, empty, large = tmp_path / "a b%.bin", tmp_path / "empty", tmp_path / "large"
    small.write_bytes(bytes(range(256)) * 41)
    empty.write_bytes(b"")
    with open(large, "wb") as out:
        out.truncate((1 << 31) + 12345)
    zeros = hashlib.sha256()
    for _ in range(1 << 8):
        zeros.update(bytes(1 << 23))
    zeros.update(bytes(12345))
    got = {r["source_file"].rsplit("/", 1)[1]: r["file_sha256"] for r in files.fingerprints(spark, str(tmp_path)).collect()}
    # Spark lists no empty files, which bring no rows either.
    assert set(got.values()) == {hashlib.sha256(small.read_bytes()).hexdigest(), zeros.hexdigest()}
    assert got["large"] == zeros.hexdigest()
    assert files.streamed_digest(f"file://{tmp_path}/empty", 7) == hashlib.sha256().hexdigest()


def test_full_load(loaded):
    tables, path, _ = loaded
    log = runs.current_state(tables.read_appended(ingest.RUNS, schemas.INGESTION_RUNS)).collect()
    assert [(r["status"], r["row_count"]) for r in log] == [("SUCCESS", 400)]
    assert log[0]["file_sha256"] == hashlib.sha256(open(path, "rb").read()).hexdigest()
    assert tables.read(etl.SILVER).count() == 400
    fact = etl.read_fact(tables)
    assert fact.count() == 400
    assertions.require_clean(etl.fact_report(tables))
    view = etl.read_model_view(tables)
    assert view.count() == 400 and "age" in view.columns
    summary = portfolio.portfolio_summary(fact).first()
    assert summary["train_rows"] + summary["valid_rows"] + summary["test_rows"] == 400
    rules = {r["rule_name"]: r["rows_affected"] for r in tables.read_appended(etl.DQ_LOG, schemas.DATA_QUALITY_LOG).collect()}
    assert rules["income_missing"] == 45


def test_loading_again_changes_nothing_but_bronze(loaded):
    tables, path, _ = loaded
    before = sorted(map(tuple, etl.read_fact(tables).collect()))
    etl.run(tables, files.csv_source(path), "2026-01-01")
    assert tables.read_appended(ingest.BRONZE, schemas.BRONZE_APPLICATIONS).count() == 800
    ids = tables.read_appended(ingest.BRONZE, schemas.BRONZE_APPLICATIONS).select("bronze_id").distinct().count()
    assert ids == 800
    assert sorted(map(tuple, etl.read_fact(tables).collect())) == before
    assert tables.read(etl.BORROWERS).count() == 400
    assert tables.read("gold/dim_date").count() == 1461


def test_later_snapshot_opens_versions_and_keeps_the_old_fact(loaded):
    tables, _, folder = loaded
    later = write_csv(folder / "second.csv", 100, dependents=2)
    etl.run(tables, files.csv_source(later), "2026-02-01")
    dim = etl.read_borrowers(tables)
    assert assertions.duplicate_keys(dim, ["borrower_key"]).count() == 0
    assert dim.count() == 500 and dim.filter("is_current").count() == 400
    dates = {r["snapshot_date_key"]: r["count"] for r in etl.read_fact(tables).groupBy("snapshot_date_key").count().collect()}
    assert dates == {20260101: 400, 20260201: 100}
    assertions.require_clean(etl.fact_report(tables))


def test_failed_run_is_recorded_and_raised(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"))
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="lacks the columns"):
        ingest.ingest(tables, files.csv_source(str(bad)))
    row = runs.current_state(tables.read_appended(ingest.RUNS, schemas.INGESTION_RUNS)).first()
    assert row["status"] == "FAILED" and "lacks the columns" in row["error_message"] and row["completed_at"] is None
    with pytest.raises(LookupError, match="no successful"):
        ingest.run_to_load(tables)


def test_train_register_score_explain_and_check_drift(loaded, spark):
    tables, _, folder = loaded
    root = str(folder / "artifacts")
    view = etl.read_model_view(tables).filter("snapshot_date_key = 20260101")
    metadata = training.run_training(tables, view, root, "credit", "v1", trees=4, maxDepth=3)
    assert 0.5 < metadata["metrics"]["auc"] <= 1 and metadata["training_rows"] == view.filter("dataset_split = 'train'").count()
    known = tables.read(training.REGISTRY)
    with pytest.raises(registry.NoActiveModelError):
        registry.active_model(known, "credit")
    training.activate(tables, "credit", "v1")
    training.run_training(tables, view, root, "credit", "v2", trees=2, maxDepth=2)
    with pytest.raises(ValueError, match="not registered"):
        training.activate(tables, "credit", "v9")
    assert registry.active_model(tables.read(training.REGISTRY), "credit")["model_version"] == "v1"
    training.activate(tables, "credit", "v2")
    training.run_training(tables, view, root, "credit", "v1", trees=4, maxDepth=3)
    active = tables.read(training.REGISTRY).filter("is_active").collect()
    assert [(r["pipeline_name"], r["model_version"]) for r in active] == [("credit", "v2")]

    metrics, deciles = training.evaluate(view, root, "credit", "v1", "test")
    row = metrics.first()
    assert 0 <= row["ks"] <= 1 and deciles.agg(F.sum("n")).first()[0] == view.filter("dataset_split = 'test'").count()

    with pytest.raises(artifacts.ArtifactNotFoundError, match="reference profile"):
        artifacts.load_profile(root, "credit", "v1")
    profile = training.build_reference(view, root, "credit", "v1")
    shares = profile.groupBy("feature").agg(F.sum("reference_share").alias("s")).collect()
    assert len(shares) == 17 and all(abs(r["s"] - 1) < 1e-9 for r in shares)

    raw = view.withColumn("request_id", F.col("applicant_id").cast("string")).drop("is_serious_delinquency")
    raw = raw.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in fv.LATE_COUNTERS})
    accepted, rejected = serving.validated(raw.withColumn("age", F.when(F.col("applicant_id") == 1, 12).otherwise(F.col("age"))))
    assert rejected.count() == 1
    scored = serving.score_requests(accepted, root, "credit", "v1").cache()
    assert scored.count() == 399
    for r in scored.limit(50).collect():
        assert [c["rank"] for c in r["contributions"]] == [1, 2, 3, 4, 5]
    model, params, _ = artifacts.load(root, "credit", "v1")
    direct = training.predict(accepted, training.models.get_pipeline("credit"), model, params)
    gap = direct.join(scored.select("request_id", F.col("probability_default").alias("q")), "request_id").agg(
        F.max(F.abs(F.col("probability_default") - F.col("q")))
    )
    assert gap.first()[0] < 1e-12, "the job and a direct prediction agree"

    report = serving.reports(scored, "credit", "v1", "GBTClassifier").select("report.llm_status", "reason_codes").first()
    assert report["llm_status"] == "disabled"

    broken = accepted.withColumn(
        "revolving_utilisation",
        F.when(F.col("request_id") == "2", float("nan")).otherwise(F.col("revolving_utilisation").cast("double")),
    )
    mixed = serving.score_requests(broken, root, "credit", "v1").cache()
    failed = mixed.filter("error_message is not null").collect()
    assert mixed.count() == 399 and [r["request_id"] for r in failed] == ["2"]
    assert failed[0]["probability_default"] is None and failed[0]["contributions"] is None
    assert serving.reports(mixed, "credit", "v1", "GBTClassifier").count() == 398
    names = [f.name for f in mixed.schema["features"].dataType]
    logged = serving.scoring.log_rows(mixed, list(fv.REQUEST_ALIASES), names, "credit", "v1", F.current_timestamp())
    entry = logged.filter("status = 'ERROR'").collect()
    assert [(r["request_id"], r["feature_vector"], r["risk_band"]) for r in entry] == [("2", "{}", None)]

    stressed = serving.stress(broken, root).cache()
    summary = {r["scenario"]: r for r in serving.scoring.stress_summary(stressed).collect()}
    assert {s: (r["n"], r["n_failed"]) for s, r in summary.items()} == {s: (399, 1) for s, _, _ in fv.SCENARIOS}
    assert summary["none"]["n_changed"] == 0 and abs(summary["none"]["largest_shift"]) < 1e-12
    gap = stressed.join(scored.select("request_id", F.col("probability_default").alias("q")), "request_id").agg(
        F.max(F.abs(F.col("own_probability") - F.col("q")))
    )
    assert gap.first()[0] < 1e-12, "the own probability is the job's"
    cells = serving.scoring.band_migration(stressed).collect()
    assert all(r["own_band"] == r["stressed_band"] and r["share"] == 1 for r in cells if r["scenario"] == "none")
    assert sum(r["n"] for r in cells) == 3 * 398

    noon = F.lit("2026-03-01 12:00:00").cast("timestamp")
    serving.log_predictions(tables, scored, "credit", "v1", noon)
    batch = serving.check_drift(tables, root, "credit", "v1", F.lit("2026-03-01 18:00:00").cast("timestamp"))
    assert batch.count() == 17
    assert {r["drift_status"] for r in batch.collect()} == {"OK"}
    late = serving.check_drift(tables, root, "credit", "v1", F.lit("2026-03-09 18:00:00").cast("timestamp"))
    assert late.count() == 0, "an empty window writes nothing"
    written = tables.read_appended(serving.DRIFT_REPORT, schemas.DRIFT_REPORT)
    skips = tables.read_appended(serving.SERVICE_EVENT, schemas.SERVICE_EVENT).filter("event_type = 'drift_skipped'")
    assert skips.count() == 0, "all profiled features were logged"
    assert monitoring.worst_status(written).first()[0] == "OK"

    applicants = scored.select("request_id", F.col("request_id").cast("long").alias("applicant_id"))
    report = serving.load_predictions(tables, "2026-03-01", "2026-03-01", applicants)
    assert {r["violations"] for r in report.collect()} == {0}
    fact = tables.read_appended(serving.PREDICTION_FACT, schemas.FACT_PREDICTION)
    assert fact.count() == 399 and fact.filter("borrower_key is null or model_key is null").count() == 0
    stored = sorted(map(tuple, fact.collect()))
    serving.log_predictions(tables, scored.limit(3), "credit", "not registered", noon)
    with pytest.raises(assertions.ConstraintError, match="not_null model_key: 3"):
        serving.load_predictions(tables, "2026-03-01", "2026-03-01", applicants)
    again = tables.read_appended(serving.PREDICTION_FACT, schemas.FACT_PREDICTION)
    assert sorted(map(tuple, again.collect())) == stored, "a load that fails its audit stores nothing"
    assert monitoring.worst_status(written.limit(0)).first()[0] == "UNKNOWN"


def test_second_domain_through_the_same_protocol(loaded):
    tables, _, folder = loaded
    root = str(folder / "artifacts2")
    fact = etl.read_fact(tables).filter("snapshot_date_key = 20260101")
    metadata = training.run_training(tables, fact, root, "dummy", "v1", minInstancesPerNode=5)
    assert metadata["algorithm"] == "DecisionTreeClassifier" and metadata["metrics"]["auc"] > 0.5
    model, params, _ = artifacts.load(root, "dummy", "v1")
    assert params.feature_names == fv.TREE_FEATURES
    with pytest.raises(training.SchemaError, match="total_delinquency_events"):
        training.require_columns(training.models.get_pipeline("dummy"), fact.drop("total_delinquency_events"))
    with pytest.raises(artifacts.ArtifactNotFoundError):
        artifacts.load(root, "dummy", "v2")


def test_log_json_has_no_nan(spark):
    from creditweir.operators import scoring

    frame = spark.createDataFrame([(float("nan"), float("inf"), 1.5)], "a double, b double, c double")
    assert frame.select(scoring.json_object(["a", "b", "c"])).first()[0] == '{"a":null,"b":null,"c":1.5}'


def events(spark, n=4000):
    seconds = F.col("id") * 97
    return spark.range(n).select(
        (F.lit("2026-01-01").cast("timestamp") + F.make_dt_interval(secs=seconds)).alias("received_at"),
        F.when(F.col("id") % 2 == 0, "v1").otherwise("v2").alias("model_version"),
        ((F.col("id") * 13) % 100 / 100).alias("probability_default"),
        F.when(F.col("id") % 11 == 0, "ERROR").otherwise("OK").alias("status"),
        F.format_string('{"k": %d}', (F.col("id") * 31) % 100).alias("feature_vector"),
    )


def test_streams_equal_batch_on_closed_windows(spark, tmp_path):
    source = str(tmp_path / "log")
    events(spark).repartition(5).write.parquet(source)
    batch = spark.read.parquet(source)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 10).parquet(source)
    streams.start_volume(stream, str(tmp_path / "volume")).awaitTermination()
    got = {r["hour"]: (r["n"], round(r["avg_probability"], 9)) for r in spark.read.parquet(str(tmp_path / "volume")).collect()}
    want = {r["hour"]: (r["n"], round(r["avg_probability"], 9)) for r in monitoring.hourly_volume(batch).collect()}
    assert got.items() <= want.items() and len(want) - len(got) <= 2

    from creditweir.operators import drift

    values = batch.select(F.get_json_object("feature_vector", "$.k").cast("double").alias("k"))
    profile = drift.reference_profile(values, ["k"])
    stream = spark.readStream.schema(batch.schema).parquet(source)
    streams.start_drift(stream, profile, str(tmp_path / "drift")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "drift")).collect()
    by = ("window_end", "model_version")
    daily = batch.filter("status = 'OK'").withColumn("window_end", F.window("received_at", "1 day")["end"])
    wanted = {tuple(r[c] for c in by): r["psi"] for r in drift.logged_psi(daily, profile, by).collect()}
    assert len(rows) >= 6
    for r in rows:
        assert r["psi"] == pytest.approx(wanted[tuple(r[c] for c in by)])


def test_rejects_are_kept_once_and_null_utilisation_is_counted(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "tables"))
    path = write_csv(tmp_path / "a.csv", 120)
    with open(path, "a") as out:
        out.write(",0,0.5,40,0,0.3,5000,6,0,1,0,1\n900,0,0.5,40,0,0.3,5000,40000,0,1,0,1\n901,0,,40,0,0.3,5000,6,0,1,0,1\n")
    with pytest.raises(assertions.ConstraintError, match="1 rows have NULL"):
        etl.run(tables, files.csv_source(path), "2026-01-01")
    for _ in range(2):
        etl.load_silver(tables, snapshot_date="2026-01-01")
    assert tables.read_appended(etl.REJECTS, schemas.BRONZE_APPLICATIONS).count() == 2


def test_rows_without_a_probability_are_logged_as_errors(spark):
    from creditweir.operators import scoring

    rows = spark.createDataFrame([("a", 0.3), ("b", float("nan")), ("c", None)], "request_id string, probability_default double")
    rows = rows.select("*", F.struct(F.lit(1.0).alias("x")).alias("request"), F.struct(F.lit(1.0).alias("x")).alias("features"))
    logged = scoring.log_rows(scoring.decide(rows, threshold=0.2), ["x"], ["x"], "credit", "v1", F.current_timestamp())
    found = {r["request_id"]: r for r in logged.collect()}
    assert [found[k]["status"] for k in "abc"] == ["OK", "ERROR", "ERROR"]
    assert found["a"]["predicted_class"] == 1 and found["b"]["risk_band"] is None and found["b"]["error_message"]


def test_a_text_that_is_no_number_rejects_its_request_only(spark):
    names = list(fv.REQUEST_ALIASES)
    fine = {n: "20" for n in names}
    header = fv.REQUEST_ALIASES["debt_ratio"]
    sent = [fine, {**fine, "debt_ratio": "n/a"}, {**fine, "monthly_income": ""}, {**fine, "age": None}]
    rows = spark.createDataFrame([(str(i), *[r[n] for n in names]) for i, r in enumerate(sent)], ["request_id", *names])
    accepted, rejected = serving.validated(rows.withColumnRenamed("debt_ratio", header))
    assert [r["request_id"] for r in accepted.collect()] == ["0"]
    assert {r["request_id"]: r["errors"] for r in rejected.collect()} == {
        "1": ["debt_ratio: not a number"], "2": ["monthly_income: not a number"], "3": ["age: required"],
    }


def test_csv_rows_are_numbered_without_a_shuffle_of_rows(spark, tmp_path, monkeypatch):
    for name, n in (("a", 500), ("b", 3)):
        write_csv(tmp_path / f"{name}.csv", n)
    read = lambda: files.read_csv_text(spark, str(tmp_path / "*.csv"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        plan = read()._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        columns = ["source_file", "source_row_number", "position"]
        found = sorted(map(tuple, read().select(*columns).collect()))
        assert [r[2] for r in found] == list(range(503))
        assert [r[1] for r in found] == list(range(500)) + list(range(3))
        monkeypatch.setattr(files, "MAX_SPLITS", 0)
        assert sorted(map(tuple, read().select(*columns).collect())) == found
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_boosting_stops_by_auc(spark):
    from creditweir.operators import models

    x = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(40)).cast("double").alias(f"x{i}") for i in range(3)]
    noise = F.pmod(F.xxhash64("id", F.lit("noise")), F.lit(60))
    rows = spark.range(900).select("id", *x).withColumn("label", (F.col("x0") + F.col("x1") / 2 + noise > 70).cast("double"))
    rows = models.assembled(rows, ["x0", "x1", "x2"]).select("id", "label", F.lit(1.0).alias("weight"), "features")
    train, valid = rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0")
    model = models.boosted_trees(trees=9, maxDepth=2).fit(train)

    def plain(margin, labels):
        pairs = [(a, b) for a, y in zip(margin, labels) if y for b, z in zip(margin, labels) if not z]
        return sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)

    labels = [r["label"] for r in valid.orderBy("id").collect()]
    margin, want = [0.0] * len(labels), []
    for tree, weight in zip(model.trees, model.treeWeights):
        found = [r["prediction"] for r in tree.transform(valid).orderBy("id").select("prediction").collect()]
        margin = [m + weight * p for m, p in zip(margin, found)]
        want.append(plain(margin, labels))
    got = {r["trees"]: r["auc"] for r in models.auc_by_trees(valid, model).collect()}
    assert [got[t] for t in range(1, 10)] == pytest.approx(want, abs=1e-12)
    later = {r["trees"]: r["auc"] for r in models.auc_by_trees(valid, model, 4).collect()}
    assert sorted(later) == list(range(4, 10)) and all(later[t] == pytest.approx(want[t - 1]) for t in later)

    chosen, aucs = models.fit_boosted(train, valid, trees=9, patience=2, maxDepth=2)
    best, _ = models.best_count(want, 2)
    assert len(chosen.treeWeights) == best and aucs == pytest.approx(want[: len(aucs)], abs=1e-12)
    assert models.best_count([0.5, 0.7, 0.7, 0.6, 0.9], 2) == (2, True)
    assert models.best_count([0.5, 0.7, 0.6, 0.9], 3) == (4, False)
    alone, none = models.fit_boosted(train, valid.filter("label = 1"), trees=3, patience=1, maxDepth=2)
    assert len(alone.treeWeights) == 3 and none == []


def test_a_fact_that_breaks_a_constraint_is_not_stored(loaded, monkeypatch):
    tables, _, _ = loaded
    before = sorted(map(tuple, etl.read_fact(tables).collect()))
    build = etl.facts.build_fact
    monkeypatch.setattr(etl.facts, "build_fact", lambda *a: build(*a).withColumn("dataset_split", F.lit("other")))
    with pytest.raises(assertions.ConstraintError, match="domain dataset_split"):
        etl.load_fact(tables)
    assert sorted(map(tuple, etl.read_fact(tables).collect())) == before
    stamped = tables.read(etl.SILVER, schemas.SILVER_APPLICATIONS)
    assert stamped.filter("processed_at is null").count() == 0


def test_features_that_are_not_logged_leave_a_trace(spark):
    from creditweir.operators import drift

    profile = drift.reference_profile(spark.range(500).select(F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b")), ["a", "b"])
    log = spark.range(150).select(F.lit("v1").alias("version"), F.when(F.col("id") < 149, '{"a": null}').otherwise(None).alias("feature_vector"))
    few = spark.range(5).select(F.lit("v2").alias("version"), F.lit("{}").alias("feature_vector"))
    skipped = drift.skipped_features(log.unionByName(few), profile, ("version",))
    assert [tuple(r) for r in skipped.collect()] == [("v1", "b", 150)]
    batch = skipped.selectExpr("timestamp'2026-01-01' AS computed_at", "'credit' AS pipeline_name", "version AS model_version",
                               "24 AS window_hours", "feature", "n_rows")
    event = monitoring.skipped_event(batch).collect()
    assert [e["event_type"] for e in event] == ["drift_skipped"] and '"features":["b"]' in event[0]["details"]
    assert monitoring.skipped_event(batch.limit(0)).count() == 0
