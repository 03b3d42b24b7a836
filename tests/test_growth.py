"""What a job does once however large its input is."""

import pytest
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from creditweir.operators import audit, drift, longform, models, quantiles, silver
from creditweir.plans import given_tables
from __spark_entry__ import queries


def _rows(spark, seed):
    rows = spark.range(600).select(
        (F.rand(seed) * 10).alias("a"), (F.rand(seed + 1) * 10).alias("b"), F.rand(seed + 2).alias("noise"), F.lit(1.0).alias("weight")
    )
    labelled = rows.withColumn("label", (F.col("a") + F.col("b") + 8 * F.col("noise") > 14).cast("double"))
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(labelled).select("label", "weight", "features").localCheckpoint()


def test_the_chosen_trees_are_cut_from_the_fitted_model(spark, monkeypatch, tmp_path):
    train, valid = _rows(spark, 1), _rows(spark, 11)
    sizes, fit = [], GBTClassifier.fit

    def counted(self, rows, params=None):
        sizes.append(self.getMaxIter())
        return fit(self, rows, params)

    monkeypatch.setattr(GBTClassifier, "fit", counted)
    model, aucs = models.fit_boosted(train, valid, trees=40, patience=4, maxDepth=2)
    best, stopped = models.best_count(aucs, 4)
    assert len(model.treeWeights) == best == model.getNumTrees == model.getMaxIter() < sizes[-1]
    # No size twice, and no fit of the chosen number of trees.
    assert sizes == [s for s in (9, 18, 40) if s <= sizes[-1]]
    again = models.boosted_trees(trees=best, maxDepth=2).fit(train)
    path = str(tmp_path / "model")
    model.write().save(path)

    def scores(m):
        return [r[0][1] for r in m.transform(valid).select("probability").collect()]

    assert scores(model) == scores(again) == scores(GBTClassificationModel.load(path))
    assert models._leaf_values(model).tolist() == models._leaf_values(again).tolist()
    assert model.featureImportances.toArray() == pytest.approx(again.featureImportances.toArray())


@pytest.mark.parametrize("name", ["model_payload", "reason_codes"])
def test_contributions_are_ranked_once(spark, name):
    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # A filter on the size of the list would hold the whole ranking.
    assert "Generate inline" in plan and "size(" not in plan


def test_a_null_payload_text_has_no_number(spark):
    contribution = "named_struct('factor', 'Age', 'value', 51.0D, 'contribution', -0.25D, 'direction', 'lowers', 'rank', 3, 'reason_code', CAST(NULL AS STRING))"
    payload = spark.range(1).selectExpr(
        "named_struct('request_id', CAST(NULL AS STRING), 'model', named_struct('pipeline', 'credit', 'version', 'v1', 'algorithm', 'l2'),"
        " 'prediction', named_struct('probability_of_default', 0.125D, 'threshold', 0.5D, 'risk_band', 'low'),"
        f" 'population_baseline', named_struct('average_probability_of_default', 0.0668D), 'contributions', array({contribution})) AS payload"
    )
    found = {float(n) for n in payload.select(audit.payload_numbers()).first()[0]}
    assert found == {0, 1, 2, 3, 4, 5, 0.125, 0.13, 0.1, 12.5, 12, 0.5, 50, 0.0668, 0.07, 6.68, 6.7, 6, 51, 5100, 0.25, 0.3, 25, 300}
    known = spark.sql("SELECT array(0.5, NULL, 1.50, 0.5) AS a, array(1.5, 2) AS b").select(
        audit._without(F.col("a").cast(f"array<{audit.NUMBER}>"), F.col("b").cast(f"array<{audit.NUMBER}>"))
    )
    assert [None if n is None else float(n) for n in known.first()[0]] == [0.5, None]


def test_pipeline_stages_join_alike_at_any_size(spark):
    pytest.importorskip("tokenizers")
    import corpus_pipeline

    docs = spark.range(40).selectExpr("id AS doc_id", "concat('a plain text of a few words, number ', id) AS text", "'en' AS lang", "'web' AS source", "9L AS n_chars")
    rows, view, key = corpus_pipeline._keyed(docs)
    kept = corpus_pipeline._kept(rows, view.where("text LIKE '%7'"), key)
    # Four keys are little enough to broadcast, and were: what a small table spent told nothing of a large one.
    assert "BroadcastHashJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in kept.collect()) == [7, 17, 27, 37] and kept.columns == docs.columns


def _longest_method(spark, df) -> int:
    """Bytes of the longest generated method; the JVM interprets those above 8000."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = df.select("*")._jdf.queryExecution().debug().codegenToSeq()
        return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def _features(spark, count=17):
    names = [f"f{i}" for i in range(count)]
    return names, spark.range(100).select(F.lit("a").alias("g"), *[(F.col("id") * (i + 1) / 7).alias(n) for i, n in enumerate(names)])


def test_methods_of_histograms_and_quantiles_are_compiled(spark, monkeypatch):
    names, df = _features(spark)
    edges = {n: [float("-inf"), *map(float, range(9)), float("inf")] for n in names}
    assert _longest_method(spark, drift.bin_counts(df, edges, ("g",))) < 8000  # 13802 before
    written, cut = [], quantiles.cut
    monkeypatch.setattr(quantiles, "cut", lambda df: written.append(df) or cut(df))
    profile = drift.reference_profile(df, names)
    assert written and max(_longest_method(spark, tally) for tally in written) < 8000  # 53241 before
    assert _longest_method(spark, profile) < 8000
    assert {r["feature"]: r["mean"] for r in profile.collect()} == pytest.approx({n: 49.5 * (i + 1) / 7 for i, n in enumerate(names)})


def test_methods_of_silver_are_compiled(spark):
    bronze = given_tables.bronze_applications(spark, "/root/testdata/sf0.001")
    assert _longest_method(spark, silver.to_silver(bronze, F.lit("2026-01-01"))) < 8000  # 19106 before


def test_bins_of_batches_equal_the_expression(spark):
    inf, nan = float("inf"), float("nan")
    edges = {"x": [-inf, -1.5, 0.0, 0.25, 3.0, inf], "y": [-1.0, 0.0, 2.0], "z": [-inf, inf]}
    values = [None, nan, -inf, inf, -0.0, 0.0, -1.5, -1.0, 0.25, 2.0, 2.1, 3.0]
    rows = [(None if i % 5 == 0 else i % 3, v, values[-i % len(values)], None) for i, v in enumerate(values * 2)]
    df = spark.createDataFrame(rows, "g int, x double, y double, z double").repartition(3)
    expected = longform.cell_counts(longform.binned(df, {f: F.col(f) for f in edges}, edges, ("g",)), edges, ("g",))
    got = drift.bin_counts(df, edges, ("g",))
    assert got.columns == expected.columns and sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    assert drift.bin_counts(df.limit(0), edges).collect() == []
