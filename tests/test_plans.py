"""Both pipelines from files to files."""

import glob
import random

import pytest

from paneloom import PanelSpec
from paneloom.operators.trees import MAIN, SCREENING, quick
from paneloom.plans import customer_features, screening

SPEC = PanelSpec(key="who", order="month", tie=("seq",), categoricals=("kind",))


def lines(path):
    return [l for name in sorted(glob.glob(f"{path}/part-*")) for l in open(name).read().splitlines()]


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    rng = random.Random(4)
    folder = tmp_path_factory.mktemp("in")
    rows, labels, seq = [], [], 0
    for c in range(150):
        risk = rng.random()
        for m in range(rng.randrange(1, 9)):
            seq += 1
            x = risk + rng.gauss(0, 0.1)
            rows.append((f"c{c}", m, seq, x, 2 * x, rng.random(), float("nan") if m % 2 else rng.random(),
                         None, rng.choice("ab")))
        if c % 10:
            labels.append((f"c{c}", int(risk > 0.6)))
    schema = "who string, month int, seq long, x double, twice double, noise double, holes double, empty double, kind string"
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{folder}/statements/data_0.parquet")
    spark.createDataFrame(labels, "who string, target int").write.parquet(f"{folder}/labels/data_0.parquet")
    return str(folder), len(rows), len(labels)


def test_customer_features(spark, inputs, tmp_path):
    folder, _, n_labels = inputs
    out = str(tmp_path / "out")
    got = customer_features.run(
        spark, f"{folder}/statements/data_*.parquet", f"{folder}/labels/data_*.parquet", out, SPEC,
        settings=quick(MAIN, 3, 8), top=12,
    )
    assert got.customers.count() == 150
    assert len(got.customers.columns) == 1 + 5 * 18 + 7
    assert got.train.count() + got.valid.count() == n_labels
    assert len(got.train.columns) == len(got.customers.columns) + 1
    assert got.selected[:2] == ["who", "target"] and 3 <= len(got.selected) <= 14
    assert not any(c.startswith("empty") or "diff1_total_delta" in c for c in got.selected)
    assert any(c.startswith(("x_", "twice_")) for c in got.selected)
    assert got.train_selected.columns == got.valid_selected.columns == got.selected
    assert got.valid_selected.count() == got.valid.count()
    assert lines(f"{out}/selected_features") == got.selected
    assert not {r[0] for r in got.train.select("who").collect()} & {
        r[0] for r in got.valid.select("who").collect()
    }


def test_screening(spark, inputs, tmp_path):
    folder, n_rows, _ = inputs
    out = str(tmp_path / "out")
    got = screening.run(
        spark, f"{folder}/statements/data_*.parquet", f"{folder}/labels/data_*.parquet", out, SPEC,
        settings=quick(SCREENING, 4, 8),
    )
    reasons = {r["feature"]: r["reason"] for r in got.removals.collect()}
    assert reasons["empty"] == "Missing 100%" and reasons["seq"].startswith("ID")
    # continuous columns count as IDs by this rule; the one with holes stays
    assert reasons["x"].startswith("ID") and "holes" not in reasons
    assert lines(f"{out}/removed_features")[0] == "Feature,Motivo"
    assert lines(f"{out}/importance")[0] == "Feature,Importance,Normalized_Importance"
    assert lines(f"{out}/attribution")[0] == "Feature,Mean_Abs_SHAP"
    assert lines(f"{out}/selected_features")[0] == f"SELECTED FEATURES ({len(got.selected)} total)"
    assert 0 <= got.auc <= 1
    stages = [r["n_features"] for r in got.funnel.orderBy("position").collect()]
    assert stages == sorted(stages, reverse=True)
