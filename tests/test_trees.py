"""Boosted trees against plain versions: growth, losses, blocks of rounds, attribution."""

import pickle
import threading
import tracemalloc
import zlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import numpy as np
import plain_trees
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paneloom import PanelSpec
from paneloom.catalog import models
from paneloom.operators import attribution as at
from paneloom.operators import boosting
from paneloom.operators import trees as tr
from paneloom.operators.boosting import Alone, Grower, Growth, Tree, gradients, losses, shares
from paneloom.operators.correlation import roc_auc, roc_aucs
from paneloom.operators.trees import (
    MAIN,
    SCREENING,
    TOP_FEATURES,
    best_features,
    best_round,
    category_features,
    fit_trees,
    gain_importance,
    quick,
)


def table(n, seed, levels=6):
    """Bins of two numbers with missing values, a flat one, and a category; a target."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 9, n)
    category = rng.integers(0, levels, n)
    bins = np.column_stack([x, rng.integers(0, 5, n), np.ones(n), category]).astype("<u2")
    y = ((x == 0) | (x > 5)) ^ (category % 3 == 1) ^ (rng.random(n) < 0.1)
    return bins, [10, 6, 3, levels + 1], [False, False, False, True], y.astype(float)


@pytest.mark.parametrize("seed, levels", [(1, 3), (2, 6), (3, 12)])
def test_a_tree_equals_the_plain_one(seed, levels):
    bins, sizes, is_category, y = table(160, seed, levels)
    growth = Growth(leaves=9, min_rows=5, smooth=2.0, penalty=1.5, most_levels=4)
    g, h = (a[:, 0] for a in gradients("binary", y, np.zeros((len(y), 1))))
    rows = np.arange(len(y))
    grower = Grower(bins, sizes, is_category, growth)
    tree, leaves = grower.grow(g, h, rows, np.arange(4), 0.5)
    want, sets = plain_trees.gains(bins, rows, sizes, is_category, g, h, growth)
    got = [(tree.feature[n], tree.gain[n]) for n in range(len(tree.feature)) if tree.feature[n] >= 0]
    # Nodes are numbered when they are made, so compare as sets of splits.
    assert [f for f, _ in sorted(got, key=lambda s: -s[1])] == [
        f for f, _ in sorted(want, key=lambda s: -s[1])
    ]
    assert np.allclose(sorted(s[1] for s in got), sorted(s[1] for s in want))
    assert sorted(sorted(r.tolist()) for _, r in leaves) == sorted(sets)
    for node, own in leaves:
        assert np.isclose(tree.value[node], -0.5 * g[own].sum() / h[own].sum())
        assert (tree.leaf_of(bins)[own] == node).all() and tree.cover[node] == len(own)


def test_rows_are_counted_and_parted_some_at_a_time(monkeypatch):
    bins, sizes, is_category, y = table(900, 8)
    g, h = (a[:, 0] for a in gradients("binary", y, np.zeros((len(y), 1))))
    rows = np.flatnonzero(np.arange(900) % 5)
    grown = []
    for some in (1 << 16, 900, 7, 1):
        monkeypatch.setattr(boosting, "SOME_ROWS", some)
        grower = Grower(bins, sizes, is_category, Growth(leaves=25, min_rows=5))
        grown.append(grower.grow(g, h, rows, np.arange(4), 0.5))
    tree, leaves = grown[0]
    assert len(leaves) == 25 and sorted(np.concatenate([r for _, r in leaves])) == rows.tolist()
    for other, of_other in grown[1:]:
        assert (other.feature, other.border, other.cover) == (tree.feature, tree.border, tree.cover)
        assert np.allclose(other.value, tree.value)
        assert [(n, r.tolist()) for n, r in of_other] == [(n, r.tolist()) for n, r in leaves]


def test_a_tree_needs_few_bytes_for_each_of_its_rows():
    rng = np.random.default_rng(9)
    n = 400_000
    bins = np.asfortranarray(rng.integers(1, 200, (n, 3)).astype(np.uint8))
    g, h, rows = rng.normal(size=n), np.ones(n), np.arange(n)
    grower = Grower(bins, [201] * 3, [False] * 3, Growth(leaves=8))
    tracemalloc.start()
    grower.grow(g, h, rows, np.arange(3), 0.1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The list of rows has 4 bytes for each, and while it is parted at most that again.
    assert peak < 16 * n


def test_many_levels_are_ordered_in_each_leaf():
    rng = np.random.default_rng(4)
    n, levels = 4000, 500
    code = rng.integers(0, levels, n)
    y = (code % 7 == 0).astype(float)
    bins = code[:, None].astype("<u2")
    g, h = (a[:, 0] for a in gradients("binary", y, np.zeros((n, 1))))
    growth = Growth(leaves=2, smooth=10, penalty=10, most_levels=80)
    tree, _ = Grower(bins, [levels + 1], [True], growth).grow(g, h, np.arange(n), np.arange(1), 1.0)
    ratio = {c: g[code == c].sum() / (h[code == c].sum() + 10) for c in set(code)}
    up = sorted(ratio, key=ratio.get)
    def gain(side):
        at = np.isin(code, side)
        return sum(g[p].sum() ** 2 / (h[p].sum() + 10) for p in (at, ~at)) - g.sum() ** 2 / h.sum()
    want = max(gain(o[:k]) for o in (up, up[::-1]) for k in range(1, 81))
    assert np.isclose(tree.gain[0], want)
    assert all(c % 7 == 0 for c in tree.levels[0])  # what a hash of levels would mix up


def test_missing_values_choose_their_side():
    bins = np.array([[0]] * 30 + [[1]] * 30 + [[2]] * 30, "<u2")
    for with_low in (True, False):
        y = np.array([1.0 if with_low else 0.0] * 30 + [1.0] * 30 + [0.0] * 30)
        g, h = (a[:, 0] for a in gradients("binary", y, np.zeros((90, 1))))
        tree, _ = Grower(bins, [4], [False], Growth(leaves=2)).grow(g, h, np.arange(90), np.arange(1), 1.0)
        assert tree.border[0] == 1 and tree.missing_left[0] == with_low


def test_no_rows_no_split():
    grower = Grower(np.zeros((0, 2), "<u2"), [3, 3], [False, True], Growth())
    tree, leaves = grower.grow(np.zeros(0), np.zeros(0), np.arange(0), np.arange(2), 0.1)
    assert tree.feature == [-1] and tree.value == [0.0] and len(leaves) == 1


def test_losses_and_their_slopes():
    rng = np.random.default_rng(0)
    for task, classes in (("regression", 1), ("binary", 1), ("multiclass", 3)):
        y = rng.integers(0, max(2, classes), 20).astype(float)
        m = rng.normal(size=(20, classes))
        g, h = gradients(task, y, m)
        for k in range(classes):
            step = np.zeros_like(m)
            step[:, k] = 1e-6
            slope = (losses(task, y, m + step) - losses(task, y, m - step)) / 2e-6
            assert np.allclose(slope, g[:, k] * (2 if task == "regression" else 1), atol=1e-6)
        assert (h > 0).all()
    assert np.allclose(shares(np.array([[1000.0, 1000.0]])), 0.5)


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    return (
        spark.range(600)
        .select(
            i,
            F.when(i % 11 != 0, F.rand(1)).alias("x"),
            F.rand(2).alias("noise"),
            F.when(i % 5 == 0, None).otherwise(F.concat(F.lit("k"), (i % 3).cast("string"))).alias("kind"),
            F.lit(1.0).alias("flat"),
        )
        .withColumn(
            "y",
            ((F.coalesce("x", F.lit(0.9)) + F.when(F.col("kind") == "k1", 0.4).otherwise(0.0)) > 0.7).cast("int"),
        )
        .cache()
    )


FEATURES = ["x", "noise", "kind", "flat"]
SMALL = quick(MAIN, 4, 6)


@pytest.fixture(scope="module")
def model(rows):
    return fit_trees(rows, FEATURES, ["kind"], "y", SMALL)


def test_gain_ranks_what_matters(spark, model):
    score = {r["feature"]: r["score"] for r in gain_importance(spark, model).collect()}
    assert set(score) == set(FEATURES)
    assert score["x"] > score["noise"] and score["kind"] > score["noise"]
    assert score["flat"] == 0
    best = best_features(gain_importance(spark, model), 2)
    assert best == sorted(["x", "kind"], key=lambda f: -score[f])


def test_bins(spark):
    df = spark.createDataFrame(
        [(1.0, "a"), (2.0, "b"), (2.0, None), (float("nan"), "b"), (None, "zz"), (9.0, "a")],
        "x double, k string",
    )
    encoding = tr.learn_encoding(df.where("k IS NULL OR k <> 'zz'"), ["x", "k"], ["k"])
    assert encoding.borders["x"].tolist() == [1.0, 2.0] and len(encoding.levels["k"]) == 3
    got = encoding.apply(df, {"x": F.col("x")}).collect()
    codes = [tuple(np.frombuffer(r["bins"], "<u2")) for r in got]
    assert [c[0] for c in codes] == [1, 2, 2, 0, 0, 3]
    assert codes[4][1] == 3 and codes[0][1] == codes[5][1] and codes[2][1] not in (codes[0][1], codes[1][1])


@pytest.mark.parametrize("settings", [SMALL, replace(SMALL, row_share=0.7, row_every=2, column_share=0.5)])
def test_tasks_grow_the_same_trees(rows, settings):
    one = fit_trees(rows, FEATURES, ["kind"], "y", settings, tasks=1)
    three = fit_trees(rows.repartition(5), FEATURES, ["kind"], "y", settings, tasks=3)
    if settings.row_share < 1:  # the drawn rows differ with the numbers they got
        assert len(three.trees) == len(one.trees)
        return
    for a, b in zip(one.trees, three.trees):
        assert a[0].feature == b[0].feature and a[0].border == b[0].border
        assert np.allclose(a[0].value, b[0].value) and a[0].cover == b[0].cover


class Beside:
    """The context of a task among threads; counts Spark's exchanges, which wait a second each."""

    def __init__(self, own, tasks, meeting, told):
        self.own, self.tasks, self.meeting, self.sent, self.calls = own, tasks, meeting, told, 0

    def partitionId(self):
        return self.own

    def getTaskInfos(self):
        return [None] * self.tasks

    def allGather(self, message):
        self.calls += 1
        self.sent[self.own] = message
        self.meeting.wait()
        return [self.sent[i] for i in range(self.tasks)]


@pytest.mark.parametrize("tasks", [2, 3, 6])
def test_tasks_exchange_by_files_and_search_their_share_of_the_features(tmp_path, tasks):
    bins, sizes, is_category, y = table(900, 5)
    growth = Growth(leaves=12, min_rows=5)
    g, h = (a[:, 0] for a in gradients("binary", y, np.zeros((len(y), 1))))
    every = np.arange(4)
    alone, _ = Grower(bins, sizes, is_category, growth).grow(g, h, np.arange(900), every, 0.1)
    meeting, told = threading.Barrier(tasks), {}
    contexts = [Beside(i, tasks, meeting, told) for i in range(tasks)]

    def grown(i):
        exchange = tr._Files(contexts[i], f"file:{tmp_path}")
        mine = slice(i, None, tasks)
        grower = Grower(bins[mine], sizes, is_category, growth, exchange)
        rows = np.arange(len(bins[mine]))
        tree = grower.grow(g[mine], h[mine], rows, every, 0.1)[0]
        exchange.told(None)
        return tree

    with ThreadPoolExecutor(tasks) as pool:
        trees = list(pool.map(grown, range(tasks), timeout=60))
    for tree in trees:
        assert tree.feature == alone.feature and tree.border == alone.border
        assert tree.levels == alone.levels and tree.cover == alone.cover
        assert np.allclose(tree.value, alone.value)
    assert [c.calls for c in contexts] == [1] * tasks  # of Spark's, whatever the tree
    assert len([f for f in tmp_path.rglob("*") if f.is_file()]) == tasks  # the last step's


def test_a_tree_takes_about_as_many_exchanges_as_it_is_deep():
    rng = np.random.default_rng(4)
    bins = rng.integers(1, 200, (20_000, 3)).astype("<u2")
    y = (bins[:, 0].astype(float) + bins[:, 1] + rng.normal(0, 40, len(bins)) > 200).astype(float)
    g, h = (a[:, 0] for a in gradients("binary", y, np.zeros((len(y), 1))))

    class Counting(Alone):
        steps = 0

        def summed(self, parts):
            self.steps += 1
            return parts[0]

    exchange = Counting()
    grower = Grower(bins, [201] * 3, [False] * 3, Growth(leaves=127), exchange)
    tree, _ = grower.grow(g, h, np.arange(len(bins)), np.arange(3), 0.1)

    def depth(node):
        if tree.feature[node] < 0:
            return 0
        return 1 + max(depth(tree.left[node]), depth(tree.right[node]))

    assert tree.feature.count(-1) == 127 and exchange.steps <= depth(0) + 8


def test_attribution_by_pattern_equals_the_walk():
    bins, sizes, is_category, y = table(900, 6)
    g, h = (a[:, 0] for a in gradients("binary", y, np.zeros((len(y), 1))))
    grower = Grower(bins, sizes, is_category, Growth(leaves=25, min_rows=5))
    tree, _ = grower.grow(g, h, np.arange(900), np.arange(4), 0.1)
    features = at.depth_in_features(tree)
    assert 3 <= features <= at.PATTERN_FEATURES
    columns = np.ascontiguousarray(bins.T)
    pattern, walk = np.zeros((4, 900)), np.zeros((4, 900))
    at._by_pattern(tree, columns, pattern)
    at._by_walk(tree, columns, walk, features)
    assert np.abs(walk).max() > 0 and np.allclose(pattern, walk, rtol=1e-9, atol=1e-13)


def test_round_aucs_in_slots_equal_the_ranks(spark):
    rng = np.random.default_rng(2)
    rows = [(float(rng.integers(0, 2)), [float(v) for v in rng.integers(0, 40, 3)]) for _ in range(700)]
    held = spark.createDataFrame(rows, "y double, history array<double>").repartition(3)
    wide = held.select("y", *(F.get("history", F.lit(i)).alias(f"r{i}") for i in range(3)))
    want = {r["feature"]: r["auc"] for r in roc_aucs(wide, ["r0", "r1", "r2"], "y").collect()}
    for rows_per_slot in (10, 100, 1000):
        got = tr._round_aucs(held, 3, rows_per_slot)
        assert got == pytest.approx([want[f"r{i}"] for i in range(3)], abs=1e-12)
    assert tr._round_aucs(held.where("y = 1"), 3, 100) == [None] * 3


def test_blocks_continue_from_their_margins(rows, model, monkeypatch):
    monkeypatch.setattr(tr, "BLOCK", 3)
    again = fit_trees(rows, FEATURES, ["kind"], "y", SMALL)
    assert len(again.trees) == 4
    for a, b in zip(model.trees, again.trees):
        assert a[0].feature == b[0].feature and np.allclose(a[0].value, b[0].value)


def test_three_classes_equal_plain_boosting(spark, rows):
    df = rows.withColumn("c", F.when(F.col("x") > 0.6, "b").when(F.col("kind") == "k1", "c").otherwise("a"))
    settings = replace(quick(SCREENING, 3, 4), row_share=1.0, column_share=1.0)
    model = fit_trees(df, ["x", "kind"], ["kind"], "c", settings, "multiclass", valid=df)
    assert model.classes == ["a", "b", "c"] and all(len(r) == 3 for r in model.trees)
    data = model.encoding.apply(df, {"c": F.col("c")}).collect()
    bins = np.array([np.frombuffer(r["bins"], "<u2") for r in data])
    y = np.array(["abc".index(r["c"]) for r in data], float)
    margins = np.tile(np.array(model.start), (len(y), 1))
    loss = []
    for _ in range(3):
        g, h = gradients("multiclass", y, margins)
        for k in range(3):
            grower = Grower(bins, model.encoding.sizes, model.encoding.is_category, Growth(leaves=4))
            tree, _ = grower.grow(g[:, k], h[:, k], np.arange(len(y)), np.arange(2), 0.05)
            margins[:, k] += tree.predict(bins)
        loss.append(-np.log(shares(margins)[np.arange(len(y)), y.astype(int)]).mean())
    assert np.allclose([-m for m in model.metric], loss)
    scores = [r["score"] for r in model.scored(df, ["id"]).collect()]
    assert np.allclose(sorted(scores), sorted(shares(margins).max(axis=1)))
    phi = at.row_attributions(df.where("id < 40"), model, ["id"]).collect()
    told = {r["id"]: r["margins"] for r in model.margins(df.where("id < 40"), ["id"]).collect()}
    assert len(phi) == 120 and {r["class"] for r in phi} == {0, 1, 2}
    assert all(abs(r["rest"] + sum(r["phi"]) - told[r["id"]][r["class"]]) < 1e-9 for r in phi)
    assert at.attribution(df, model, of_class=2).count() == 2


def test_a_number_is_learned(spark, rows):
    df = rows.where("x IS NOT NULL").withColumn("z", F.col("x") * 2 + 1)
    model = fit_trees(df, ["x", "kind"], ["kind"], "z", quick(SCREENING, 60, 8), "regression", valid=df)
    got = model.scored(df, ["id", "z"]).select(F.avg(F.abs(F.col("score") - F.col("z")))).first()[0]
    assert got < 0.12 and model.metric[-1] > model.metric[0]
    assert at.attribution(df, model).count() == 2


def test_attribution_equals_the_definition(rows, model):
    """Against the sum over all sets of known features, and it adds up to the score."""
    sample = rows.where("id < 25")
    data = model.encoding.apply(sample, {"id": F.col("id")}).collect()
    bins = np.array([np.frombuffer(r["bins"], "<u2") for r in data])
    for of_round in model.trees:
        out = np.zeros((4, len(bins)))
        at.shapley(of_round[0], bins, out)
        for row, phi in zip(bins, out.T):
            want, _ = plain_trees.shapley(of_round[0], row, 4)
            assert np.allclose(phi, want, atol=1e-12)
    score = {r["id"]: r["score"] for r in model.scored(sample, ["id"]).collect()}
    got = at.row_attributions(sample, model, ["id"]).collect()
    assert {r["class"] for r in got} == {1}
    assert all(abs(r["rest"] + sum(r["phi"]) - score[r["id"]]) < 1e-9 for r in got)


def test_deep_paths_with_repeated_features():
    rng = np.random.default_rng(7)
    n, wide = 400, 7
    bins = rng.integers(0, 12, (n, wide)).astype("<u2")
    y = (bins.sum(axis=1) + rng.normal(size=n) * 4 > 38).astype(float)
    g, h = (a[:, 0] for a in gradients("binary", y, np.zeros((n, 1))))
    growth = Growth(leaves=40, min_rows=4)
    tree, _ = Grower(bins, [13] * wide, [False] * wide, growth).grow(g, h, np.arange(n), np.arange(wide), 1.0)
    assert at.depth_in_features(tree) > 3
    out = np.zeros((wide, 10))
    at.shapley(tree, bins[:10], out)
    for row, phi in zip(bins, out.T):
        want, rest = plain_trees.shapley(tree, row, wide)
        assert np.allclose(phi, want, atol=1e-12)
        assert np.isclose(rest, at._expected(tree))
    lone = Tree()
    lone.add(0.5, 10)
    at.shapley(lone, bins, out := np.zeros((wide, n)))
    assert not out.any() and at._expected(lone) == 0.5


def test_attribution_table(rows, model):
    table = {r["feature"]: r for r in at.attribution(rows, model).collect()}
    assert set(table) == set(FEATURES)
    assert table["x"]["mean_abs"] > table["noise"]["mean_abs"]
    assert table["x"]["direction"] > 0.5
    assert table["flat"]["mean_abs"] == 0 and table["flat"]["direction"] is None
    assert at.attribution(rows.limit(0), model).count() == 0


def test_held_rows_stay_out_of_the_training_stage(rows, monkeypatch):
    kept, save = [], tr.saved
    monkeypatch.setattr(tr, "saved", lambda df: kept.append(save(df)) or kept[-1])
    monkeypatch.setattr(tr, "BLOCK", 3)
    settings = replace(quick(SCREENING, 6, 4), patience=100)
    valid = rows.where("id < 100")
    model = fit_trees(rows, ["x", "kind"], ["kind"], "y", settings, valid=valid)
    blocks = [df for df in kept if "trees" in df.columns]
    assert len(blocks) == 2 and len(model.metric) == 6
    assert all(df.count() == 600 + 1 for df in blocks)  # the training rows, and the trees
    lists = [f for df in kept for f in df.dtypes if f[1].startswith("array")]
    assert {name for name, _ in lists} == {"margins"}  # no number for each round of a block
    # Margins of the held part are those that its trees add up to.
    continued = [df for df in kept if df.columns == ["y", "bins", "row_id", "margins"]][-1]
    packed = blocks[0].where("trees IS NOT NULL").first()["trees"]
    full = replace(model, trees=pickle.loads(zlib.decompress(packed)))
    assert len(full.trees) == 3
    want = sorted(r["margins"][0] for r in full.margins(valid, ["id"]).collect())
    assert np.allclose(sorted(r["margins"][0] for r in continued.collect()), want)


def test_what_a_task_trains_on_is_held_in_few_bytes():
    n, classes = 5000, 2
    rng = np.random.default_rng(3)
    ids = rng.permutation(n)
    columns = {
        "row_id": pa.array(ids),
        "y": pa.array((ids % 2).astype(float)),
        "weight": pa.array(np.ones(n)),
        "bins": pa.array([np.array([i % 256, i % 7], "<u2").tobytes() for i in ids], pa.binary()),
        "margins": tr._lists(np.column_stack([ids * 1.0, -ids * 1.0])),
    }
    whole = pa.RecordBatch.from_pydict(columns)
    batches = [whole.slice(0, 2000), whole.slice(0, 0), whole.slice(2000)]
    own = tr._Rows(iter(batches), [256, 8], classes)
    assert own.ids.tolist() == list(range(n)) and own.bins.dtype == np.uint8
    assert (own.bins == np.column_stack([np.arange(n) % 256, np.arange(n) % 7])).all()
    assert own.y.dtype == np.uint8 and (own.y == np.arange(n) % 2).all()
    assert (own.margins == [np.arange(n), -np.arange(n)]).all()
    told = pa.RecordBatch.from_pydict(own.written(slice(0, n)))
    back = whole.take(pa.array(np.argsort(ids)))
    assert all(told[c].to_pylist() == back[c].to_pylist() for c in columns)
    wide = tr._Rows(iter([whole]), [257, 8], classes)
    assert wide.bins.dtype == np.uint16
    uneven = pa.RecordBatch.from_pydict(columns | {"y": pa.array(ids + 0.5), "weight": pa.array(ids * 1.0)})
    odd = tr._Rows(iter([uneven]), [256, 8], classes)
    assert (odd.y == np.arange(n) + 0.5).all() and (odd.weight == np.arange(n)).all()
    assert len(tr._Rows(iter([]), [256, 8], classes).bins) == 0


def test_a_value_of_many_held_rows_is_ranked_from_counts(spark, monkeypatch):
    monkeypatch.setattr(tr, "HELD_ROWS", 50)
    rng = np.random.default_rng(4)
    x = np.where(rng.random(2000) < 0.7, 0.0, rng.integers(-9, 9, 2000) / 2)
    rows = [(float(rng.random() < 0.3 + 0.02 * v), [float(v), 1.0]) for v in x]
    held = spark.createDataFrame(rows, "y double, history array<double>").repartition(3)
    want = roc_auc(held.select("y", F.col("history")[0].alias("s")), "s", "y").first()["auc"]
    for rows_per_slot in (100, 5000):
        got = tr._round_aucs(held, 2, rows_per_slot)
        assert got == pytest.approx([want, 0.5], abs=1e-12)


def test_patience():
    falling = [1.0, 0.9, 0.95, 0.8, 0.85, 0.9, 0.7]
    assert best_round(falling, 50) == (7, False)
    assert best_round(falling, 3) == (7, False)
    assert best_round(falling, 2) == (4, True)
    assert best_round([0.5, 0.5, 0.5], 2) == (1, True)


def test_rounds_up_to_the_best_auc_are_kept(rows, monkeypatch):
    monkeypatch.setattr(tr, "BLOCK", 5)
    settings = replace(quick(SCREENING, 20, 3), patience=4)
    against = rows.withColumn("y", 1 - F.col("y"))
    model = fit_trees(rows, ["x", "kind"], ["kind"], "y", settings, valid=against)
    assert len(model.trees) == best_round([-m for m in model.metric], 4)[0] and len(model.metric) < 20
    learnable = fit_trees(rows, ["x", "kind"], ["kind"], "y", settings, valid=rows)
    auc = roc_auc(learnable.scored(rows, ["id", "y"]), "score", "y").first()["auc"]
    assert abs(auc - learnable.metric[len(learnable.trees) - 1]) < 1e-12


def test_aucs_of_many_scores_equal_those_of_one(rows):
    df = rows.select("x", "noise", F.lit(None).cast("double").alias("none"), "y")
    for limits in ({}, {"slots": 4, "rows_per_slot": 10}):
        got = {r["feature"]: (r["n_rows"], r["auc"]) for r in roc_aucs(df, ["x", "noise", "none"], "y", **limits).collect()}
        assert set(got) == {"x", "noise"}
        for c in got:
            one = roc_auc(df, c, "y").first()
            assert got[c][0] == one["n_rows"] and abs(got[c][1] - one["auc"]) < 1e-12


def test_category_features_by_name():
    spec = PanelSpec()
    columns = [
        c + s for c in (*spec.categoricals, "P_2")
        for s in ("_first", "_last", "_nunique", "_count", "_changed_changed_recently")
    ]
    found = category_features(columns, spec)
    assert len(found) == 22 and "P_2_last" not in found


@pytest.mark.parametrize("name, settings", [
    ("gain_importance", MAIN), ("selected_train", MAIN), ("selected_valid", MAIN),
    ("importance_norm", SCREENING), ("importance_cut", SCREENING), ("validation_auc", SCREENING),
    ("mean_abs_attribution", SCREENING), ("attribution_direction", SCREENING),
])
def test_registered_queries_train_with_the_full_settings(monkeypatch, rows, name, settings):
    class Trained(Exception):
        pass

    def fit(train, features, categories, target, settings, **_):
        raise Trained(settings)

    monkeypatch.setattr(models, "shared_folder", lambda spark: None)
    monkeypatch.setattr(models, "_customers", lambda spark, sf_dir: (rows, rows))
    monkeypatch.setattr(models, "static_filter", lambda *_: rows.selectExpr("'x' feature", "id position"))
    monkeypatch.setattr(models, "screened", lambda spark, sf_dir: rows.localCheckpoint())
    monkeypatch.setattr(models, "sized_split", lambda *_: (rows, rows))
    monkeypatch.setattr(rows.__class__, "checkpoint", lambda df: df)
    monkeypatch.setattr(models, "fit_trees", fit)
    with pytest.raises(Trained) as trained:
        models.QUERIES[name].run(None, None)
    assert trained.value.args == (settings,)


@pytest.mark.parametrize("name", ["selected_train", "selected_valid"])
def test_registered_queries_keep_as_many_features_as_the_full_run(monkeypatch, rows, name):
    kept = []
    monkeypatch.setattr(models, "_customers", lambda spark, sf_dir: (rows, rows))
    monkeypatch.setattr(models, "_main_model", lambda train: None)
    monkeypatch.setattr(models, "gain_importance", lambda spark, model: None)
    monkeypatch.setattr(models, "best_features", lambda scores, most: kept.append(most) or ["x"])
    monkeypatch.setattr(models, "rounded", lambda df: df)
    monkeypatch.setattr(models, "KEY", "id")
    monkeypatch.setattr(models, "TARGET", "y")
    models.QUERIES[name].run(None, None)
    assert kept == [TOP_FEATURES]
