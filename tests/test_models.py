"""Isolation forest, boosted model and ARIMA."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skuflow.operators import anomaly, arima, demand_model, features, forecast, isolation_forest
from skuflow.plans import answers, training
from skuflow.plans.queries import SKU_IN_TEXT, _chunks
from skuflow.sources import tables
from tests.conftest import SMALL

COLUMNS = ["a", "b"]


@pytest.fixture(scope="module")
def points(spark):
    draw = np.random.default_rng(4)
    values = draw.normal(size=(3000, 2))
    values[:15] += 12.0
    frame = pd.DataFrame(values, columns=COLUMNS)
    frame["id"] = range(3000)
    return spark.createDataFrame(frame)


def scores(rows):
    nodes = isolation_forest.fit_forest(rows, ["id"], COLUMNS, trees=100)
    return isolation_forest.decide(isolation_forest.score_rows(rows, nodes, COLUMNS), 0.05)


def test_forest_finds_spikes_and_flags_the_share(points):
    scored = scores(points)
    lowest = {r.id for r in scored.orderBy("anomaly_score").limit(15).collect()}
    assert len(lowest & set(range(15))) >= 14
    assert scored.where("is_anomaly").count() == 150
    assert scored.where("is_anomaly").agg(F.max("anomaly_score")).first()[0] < 0


def test_forest_does_not_depend_on_partitions(points):
    one = {r.id: r.anomaly_score for r in scores(points.coalesce(1)).collect()}
    many = {r.id: r.anomaly_score for r in scores(points.repartition(8, "b")).collect()}
    assert one == many


def test_forest_sample_sizes(points):
    nodes = isolation_forest.fit_forest(points, ["id"], COLUMNS, trees=64, sample_size=128)
    roots = nodes.where("node = 0")
    assert roots.count() == 64
    assert {r.row_count for r in roots.collect()} == {128}
    assert nodes.agg(F.max("depth")).first()[0] <= 7


def test_forest_on_few_rows_and_constant_columns(spark):
    rows = spark.createDataFrame([(i, 1.0, float(i % 2)) for i in range(10)], "id long, a double, b double")
    assert scores(rows).count() == 10


def test_forest_save_and_load(spark, points, tmp_path):
    path = str(tmp_path / "forest")
    assert isolation_forest.load_forest(spark, path) is None
    nodes = isolation_forest.fit_forest(points, ["id"], COLUMNS, trees=5)
    isolation_forest.save_forest(nodes, path)
    assert sorted(map(tuple, isolation_forest.load_forest(spark, path).collect())) == sorted(map(tuple, nodes.collect()))


def test_trained_forest_flags_single_rows_alike(points):
    forest = isolation_forest.train_forest(points, ["id"], COLUMNS, trees=50)
    everything = {r.id: (r.anomaly_score, r.is_anomaly) for r in isolation_forest.apply_forest(points, forest, COLUMNS).collect()}
    assert sum(flag for _, flag in everything.values()) == 150
    some = isolation_forest.apply_forest(points.where("id < 40"), forest, COLUMNS).collect()
    assert all(everything[r.id] == (r.anomaly_score, r.is_anomaly) for r in some)


def test_average_path():
    np.testing.assert_allclose(isolation_forest.average_path([0, 1, 2, 256]), [0, 0, 1, 10.244770920116851])


def test_severity_limits(spark):
    rows = spark.createDataFrame([(-0.3,), (-0.2,), (-0.15,), (-0.1,), (0.0,)], "s double")
    assert [r[0] for r in rows.select(anomaly.anomaly_severity(F.col("s"))).collect()] == [
        "high", "medium", "medium", "low", "low"
    ]


@pytest.fixture(scope="module")
def demand(spark):
    return tables.demand_history(spark, SMALL).cache()


@pytest.fixture(scope="module")
def model(demand):
    return demand_model.train(features.sku_features(demand), trees=10)


def test_model_beats_the_mean(demand):
    rows = demand_model.holdout_predictions(features.sku_features(demand), trees=20)
    mean = demand.agg(F.avg("net_units")).first()[0]
    baseline = forecast.evaluate(rows.withColumn("prediction", F.lit(mean))).first()
    assert forecast.evaluate(rows).first().rmse < baseline.rmse


@pytest.mark.parametrize("roll", ["lag1", "full"])
def test_model_forecast(demand, model, roll):
    lonely = demand.limit(1).withColumn("sku_id", F.lit("ONE"))
    points = demand_model.forecast_model(model, demand.unionByName(lonely), horizon=4, roll=roll).cache()
    skus = demand.select("sku_id").distinct().count() + 1
    assert points.count() == 4 * skus
    assert points.where("forecast < 0 or lower_ci < 0 or lower_ci > forecast or forecast > upper_ci").count() == 0
    assert {r.model for r in points.where("sku_id = 'ONE'").collect()} == {forecast.ROLLING_MEAN_LABEL}


@pytest.mark.parametrize("horizon", [0, 13])
def test_model_forecast_bounds_the_horizon(demand, model, horizon):
    with pytest.raises(ValueError):
        demand_model.forecast_model(model, demand, horizon)


def test_model_save_and_load(spark, demand, model, tmp_path):
    path = str(tmp_path / "model")
    assert demand_model.load_model(path, spark) is None
    demand_model.save_model(model, path)
    table = features.sku_features(demand)
    again = demand_model.predict(demand_model.load_model(path, spark), table)
    assert again.agg(F.sum("prediction")).first()[0] == pytest.approx(
        demand_model.predict(model, table).agg(F.sum("prediction")).first()[0]
    )


def test_importances_cover_all_columns(model):
    found = demand_model.feature_importance(model)
    assert sum(v for _, v in found) == pytest.approx(1.0)
    assert [v for _, v in found] == sorted((v for _, v in found), reverse=True)


def test_cv_train(demand):
    rows = demand_model.cv_train(features.sku_features(demand), trees=3).collect()
    assert sorted(r.fold for r in rows) == [0, 1, 2, 3]
    folds = [r.rmse for r in rows if r.fold]
    assert next(r.rmse for r in rows if r.fold == 0) == pytest.approx(np.mean(folds))


def simulated_changes(phi, theta, count):
    draw = np.random.default_rng(6)
    noise = draw.normal(size=count)
    change = np.zeros(count)
    for t in range(1, count):
        change[t] = phi * change[t - 1] + noise[t] + theta * noise[t - 1]
    return change


@pytest.mark.parametrize("phi, theta", [(0.6, 0.3), (-0.5, -0.3), (0.7, -0.2)])
def test_arima_recovers_coefficients(phi, theta):
    change = simulated_changes(phi, theta, 2000)
    fitted = arima.fit_arima([np.cumsum(change), np.cumsum(change[:900])], 2)
    assert fitted["phi"].iloc[0] == pytest.approx(phi, abs=0.08)
    assert fitted["theta"].iloc[0] == pytest.approx(theta, abs=0.08)
    assert len(fitted["forecasts"].iloc[0]) == 2


@pytest.mark.parametrize("phi, theta", [(0.6, 0.3), (-0.4, 0.5), (0.9, -0.8), (0.0, 0.0)])
def test_arima_is_at_least_as_likely_as_the_truth(phi, theta):
    change = simulated_changes(phi, theta, 400)
    fitted = arima.fit_arima([np.concatenate([[0.0], np.cumsum(change)])], 1)
    cost, _, _ = arima._innovations(np.array([phi]), np.array([theta]), change[None, :], np.array([400]))
    assert fitted["log_likelihood"].iloc[0] >= -cost[0] - 1e-6


def test_arima_likelihood_matches_the_joint_normal():
    """The innovations give the same likelihood as the full covariance matrix."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=12)
    phi, theta = 0.5, -0.3
    n = len(x)
    weights = [1.0, phi + theta]
    while len(weights) < 400:
        weights.append(weights[-1] * phi)
    weights = np.array(weights)
    covariance = np.array([[weights[: 400 - abs(i - j)] @ weights[abs(i - j):] for j in range(n)] for i in range(n)])
    variance = x @ np.linalg.solve(covariance, x) / n
    expected = 0.5 * (n * (np.log(2 * np.pi * variance) + 1) + np.linalg.slogdet(covariance)[1])
    cost, _, _ = arima._innovations(np.array([phi]), np.array([theta]), x[None, :], np.array([n]))
    assert cost[0] == pytest.approx(expected)


def test_arima_failures_are_null(spark):
    rows = [("short", f"2020-0{m}-01", 1.0) for m in range(1, 4)] + [("flat", f"2020-0{m}-01", 2.0) for m in range(1, 10)]
    df = spark.createDataFrame(rows, "sku_id string, period string, net_units double")
    found = {r.sku_id: (r.phi, r.forecasts) for r in arima.arima_by_sku(df).collect()}
    assert found == {"short": (None, None), "flat": (None, None)}


def test_training_job(spark, demand, tmp_path):
    training.train_models(spark, demand, str(tmp_path), trees=3)
    metrics = {k: v for r in spark.read.parquet(str(tmp_path / "runs")).collect() for k, v in r.metrics.items()}
    assert set(metrics) == {"cv_rmse", "cv_mape", "flagged_share"}
    assert metrics["flagged_share"] == pytest.approx(0.05, abs=0.002)
    assert demand_model.load_model(str(tmp_path / "demand_model"), spark) is not None


def test_answers_with_trained_models(spark, demand, model):
    questions = spark.createDataFrame(
        [("a", "forecast demand for SKU-000007"), ("b", "any unusual spike for SKU-000007?"), ("c", "any unusual outlier?"),
         ("d", "forecast demand for SKU-999999"), ("e", "who is the best supplier for SKU-999999?"),
         ("f", "check stock of SKU-999999")],
        "query_id string, question string",
    )
    rows = anomaly.anomaly_features(features.sku_features(demand))
    scored = isolation_forest.apply_forest(rows, isolation_forest.train_forest(rows, ["sku_id", "period"], trees=20))
    found = answers.answer_queries(
        questions, demand, tables.inventory(spark, SMALL), tables.supplier_terms(spark, SMALL),
        tables.supplier_directory(spark, SMALL), tables.supplier_sku(spark, SMALL), _chunks(spark, SMALL), SKU_IN_TEXT,
        points=demand_model.forecast_model(model, demand), scored=scored,
    )
    texts = {r.query_id: r.answer for r in found.collect()}
    assert texts["a"].startswith("📊 Demand Forecast — SKU-000007\n\nDemand forecast for SKU-000007 (next 3 months):\n  Month +1: ")
    assert "for SKU-000007" in texts["b"] or "detected for SKU SKU-000007" in texts["b"]
    assert "anomalous data point(s) detected" in texts["c"]
    assert "No forecast data available for SKU SKU-999999." in texts["d"]
    assert texts["e"] == "No supplier mapping found for the specified SKU."
    assert texts["f"] == "SKU SKU-999999 not found in inventory.\n\nNo demand history for SKU-999999."
